"""Importance resampling and the radix sort against plain versions."""

import hashlib
import math
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from seamline.llm import radix
from seamline.llm.importance import features, _Buckets, resample
from seamline.llm.radix import sorted_positions

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def plain_runs(text, longest):
    words = WORD.findall((text or "").encode().lower())
    return words, [b" ".join(words[k : k + w]) for w in range(1, longest + 1) for k in range(len(words) - w + 1)]


def plain_resample(rows, target, percent=10, least=20, longest=1, buckets=10_000, seed=2024):
    runs = {k: plain_runs(text, longest) for k, (_, text) in enumerate(rows)}
    s, t = [0] * buckets, [0] * buckets
    for _, found in runs.values():
        for run in found:
            s[zlib.crc32(run) % buckets] += 1
    for text in target:
        for run in plain_runs(text, longest)[1]:
            t[zlib.crc32(run) % buckets] += 1
    gain = [math.floor(1000 * math.log((b + 1) * (sum(s) + buckets) / ((a + 1) * (sum(t) + buckets)))) for a, b in zip(s, t, strict=True)]
    out = []
    for k, (doc, _) in enumerate(rows):
        words, found = runs[k]
        weight = sum(gain[zlib.crc32(run) % buckets] for run in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"{seed}:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        out.append((doc, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words) >= least))
    fit = sorted((r for r in out if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    ranks = {}
    for rank, r in enumerate(fit[: percent * len(fit) // 100], 1):
        ranks.setdefault(r, []).append(rank)
    return [(*r[:4], ranks[r].pop(0) if ranks.get(r) else None) for r in sorted(out, key=repr)]


def some_rows(rng, n):
    words = ["alpha", "Beta", "gamma9", "δέλτα", "x", "漢字", "e-f", "re\x00ad"] + [f"w{k}" for k in range(300)]
    return [(k * 7 - 50, " ".join(rng.choice(words) for _ in range(rng.choice([0, 3, 19, 20, 21, 80])))) for k in range(n)]


COLUMNS = ["doc_id", "n_features", "weight", "score", "rank"]


@pytest.mark.parametrize(("longest", "percent"), [(1, 10), (2, 50), (3, 100)])
def test_draw_matches_the_plain_version(make, odd, longest, percent):
    rng = random.Random(longest)
    rows = [*odd, *some_rows(rng, 150), (2**63 - 1, "w1 " * 30), (-(2**63), "w1 " * 30), (None, "w2 " * 25)]
    target = [None, "", *(text for _, text in some_rows(rng, 20))]
    goal = make([(k, text) for k, text in enumerate(target)])
    found = resample(make(rows), goal, percent=percent, longest=longest).select(*COLUMNS).collect()
    assert sorted(map(tuple, found), key=repr) == sorted(plain_resample(rows, target, percent, longest=longest), key=repr)


def test_repeated_rows_count_one_each(make):
    rows = [(3, "word " * 40)] * 50 + [(4, "other " * 40)] * 50
    found = resample(make(rows), make([]), percent=75).select(*COLUMNS).collect()
    assert len(found) == 100 and sorted(r["rank"] for r in found if r["rank"]) == list(range(1, 76))


def test_empty_tables(make):
    assert resample(make([]), make([(1, "a")])).collect() == []
    assert resample(make([]), make([])).collect() == []


def test_long_texts_are_read_in_blocks():
    text = " ".join(random.Random(5).choices(["a", "bb", "c" * 300, "é"], k=60_000))
    for longest in (1, 3):
        found = [b for _, part in features(text, _Buckets(1000), longest) for b in part.tolist()]
        assert sorted(found) == sorted(zlib.crc32(run) % 1000 for run in plain_runs(text, longest)[1])


def placed(df, keys):
    return [tuple(r) for r in sorted_positions(df, keys).orderBy("position").collect()]


@pytest.mark.parametrize("span", [0, 1, 3000, 2**40, 2**63])
def test_positions_sort(shipped, monkeypatch, span):
    monkeypatch.setattr(radix, "MOST_ROWS", 37)
    rng = random.Random(span)
    rows = [(rng.randint(-span, span - 1 if span else 0), rng.randint(0, 3), k) for k in range(1500)]
    found = placed(shipped.createDataFrame(rows, "a long, b long, c long"), ["b", "a", "c"])
    assert [r[:3] for r in found] == sorted(rows, key=lambda r: (r[1], r[0], r[2])) and [r[3] for r in found] == list(range(1500))


def test_positions_of_equal_keys_and_of_nothing(shipped):
    same = shipped.range(500).select(F.lit(4).alias("a"))
    assert [r[1] for r in placed(same, ["a"])] == list(range(500))
    assert placed(same.where("a > 4"), ["a"]) == []
    with pytest.raises(Exception, match="a is null"):
        placed(same.select(F.lit(None).cast("long").alias("a")), ["a"])


def test_a_hot_key_leaves_positions_dense(shipped):
    rows = shipped.range(20_000).select(F.when(F.col("id") % 3 == 0, 5).otherwise(F.col("id") * 7919 % 10_007).alias("a"), "id")
    found = placed(rows, ["a", "id"])
    assert [r[2] for r in found] == list(range(20_000)) and [r[:2] for r in found] == sorted(r[:2] for r in found)
