"""The fill-in-the-middle forms against a plain version, and the rank index on hard boundaries."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from seamline.llm import fill_middle
from seamline.llm.fill_middle import RankIndex, TextIndex, fill_in_middle, restored
from seamline.llm.queries import QUERIES


def plain_form(doc, text, seed=1):
    text = text or ""
    digest = hashlib.sha256(f"{seed}:{'' if doc is None else doc}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(text)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(mark in text for mark in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    p, m, s = text[:a], text[a:b], text[b:]
    if h[3] % 100 < 20:
        return n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}"


ALPHABETS = ["ab c\n", "aé漢🎉", "🎉", "<PSM>a", "\x00é́"]


def test_forms_match_the_plain_version(make, odd):
    random.seed(8)
    rows = [(k - 40, "".join(random.choice(random.choice(ALPHABETS)) for _ in range(random.choice([0, 1, 2, 9, 200, 3000])))) for k in range(300)]
    rows += [*odd, (7001, "a <P> b"), (7002, "<M>"), (2**63 - 1, "漢字 " * 5), (-(2**63), "漢字 " * 5)]
    out = fill_in_middle(make(rows)).withColumn("restored", restored())
    assert {"token", "score", "__x"} <= set(out.columns)
    found = out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output", "restored").collect()
    expected = [(doc, *plain_form(doc, text), text or "") for doc, text in rows]
    key = repr
    assert sorted(map(tuple, found), key=key) == sorted(expected, key=key)


def test_long_texts_cross_blocks(make, monkeypatch):
    text = "".join(random.Random(1).choices("aé漢🎉 ", k=700_000))
    rows = [(k, text) for k in range(1, 4)]
    found = fill_in_middle(make(rows, extra=False)).select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output").collect()
    assert sorted(map(tuple, found)) == sorted((k, *plain_form(k, t)) for k, t in rows)


def test_empty_table_and_own_columns(make):
    docs = make([]).withColumns({"form": F.lit(1), "output": F.lit(2)})
    out = fill_in_middle(docs)
    assert out.count() == 0 and out.columns.count("form") == 1 and dict(out.dtypes)["form"] == "string"


@pytest.mark.parametrize("error", [2, 3, 127])
def test_index_is_exact_within_its_error(error):
    rng = np.random.default_rng(error)
    for _ in range(40):
        runs = [rng.choice(["a", "é", "漢", "🎉"]) * int(rng.integers(1, 400)) for _ in range(rng.integers(0, 12))]
        data = np.frombuffer("".join(runs).encode(), np.uint8)
        index = RankIndex(data, error)
        offsets = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
        assert (index.offsets(np.arange(len(offsets))) == offsets).all()
        assert np.abs(index.residuals.astype(int)).max() <= error
    assert len(RankIndex(np.frombuffer(b"x" * 100_000, np.uint8)).starts) == 1


def test_blocks_never_split_a_code_point(monkeypatch):
    monkeypatch.setattr(fill_middle, "BLOCK", 7)
    text = "a漢🎉é" * 20
    index, data = TextIndex(np.frombuffer(text.encode(), np.uint8)), text.encode()
    places = index.offsets(np.arange(len(text) + 1))
    assert [data[a:b].decode() for a, b in zip(places[:-1], places[1:], strict=True)] == list(text)


def test_query_restores_every_text(shipped, data):
    texts = dict(map(tuple, shipped.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()))
    rows = QUERIES["op11_fill_middle"](shipped, data).collect()
    assert len(rows) == len(texts) and {r.form for r in rows} == {"plain", "psm", "spm"}
    assert all(r.restored_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest() for r in rows)
