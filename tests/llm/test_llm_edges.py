"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing names in every operator."""

import hashlib
import json
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline
from seamline.llm import byte_bpe, quality, sharding, texts, token_counts, tool_chat, toxicity
from seamline.llm.decontaminate import align, benchmark_matches, drop_contaminated
from seamline.llm.exact_dedup import exact_groups
from seamline.llm.graph import components
from seamline.llm.line_dedup import dedup_lines, digests
from seamline.llm.ngram_join import SKETCH, choose_prefix, ngram_components
from seamline.llm.perfect_hash import PerfectHash
from seamline.llm.prefilter import maybe_in
from seamline.session import cut_lineage

MODEL = open(public_tokenizers.path("piece_bpe_32k.model"), "rb").read()
RANKS = byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


def rows_of(df, *names):
    return sorted((tuple(r) for r in df.select(*names).collect()), key=lambda r: tuple((v is None, v) for v in r))


def test_word_hashes_follow_the_words():
    seen = {}
    random.seed(3)
    for _ in range(300):
        text = "".join(random.choice("aAbB \n\t\x0bé ") for _ in range(random.randint(0, 50)))
        words = text.encode().lower().split()
        found = texts.word_hashes(text)
        assert len(found) == len(words)
        assert all(seen.setdefault(w, h) == h for w, h in zip(words, found, strict=True))
    assert len(set(seen.values())) == len(seen)
    long = " ".join(w.decode() for w in seen) + " " + "y" * 300_000 + " ab"
    assert texts.word_hashes(long)[-2] == texts.word_hashes("y" * 300_000)[0]


def test_ngram_components_odd_rows(make, odd):
    got = rows_of(ngram_components(make(odd)), "doc_id", "n_shingles", "component_id")
    assert got == [
        (1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 1, 4), (5, 1, 4), (5, 1, 4), (6, 1, 6), (7, 1, 7), (8, 3, 8), (9, 3, 8), (10, 2, 10),
        (None, None, None), (None, None, None),
    ]


def jaccard_groups(rows, percent=80):
    sets = texts.shingles_of([t for _, t in rows])
    group = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            shared = len(np.intersect1d(sets[a], sets[b]))
            if shared and 100 * shared >= percent * (len(sets[a]) + len(sets[b]) - shared):
                old, new = group[a], group[b]
                group = [new if g == old else g for g in group]
    return sorted((rows[k][0], len(sets[k]), min(rows[j][0] for j in range(len(rows)) if group[j] == group[k])) for k in range(len(rows)))


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_ngram_components_match_all_pairs(make, seed):
    """Chains of edits around the limit, passages that many share, short texts."""
    random.seed(seed)
    words = [f"w{k}" for k in range(400)]
    passage = [random.choice(words) for _ in range(30)]
    rows = []
    for _ in range(12):
        now = [random.choice(words) for _ in range(random.choice([3, 6, 20, 60, 150]))]
        for _ in range(random.choice([1, 2, 6])):
            for _ in range(random.choice([0, 1, 1, 2])):
                now = list(now)
                now[random.randrange(len(now))] = random.choice(words)
            rows.append((len(rows) * 7 % 1009, " ".join(now + (passage if random.random() < 0.3 else []))))
    assert rows_of(ngram_components(make(rows)), "doc_id", "n_shingles", "component_id") == jaccard_groups(rows)


def test_prefix_asks_for_no_more_than_the_overlap():
    random.seed(5)
    counts = np.zeros(SKETCH, np.int32)
    for n in (1, 2, 3, 4, 5, 9, 10, 50, 1000):
        found = np.unique(np.array([random.getrandbits(64) for _ in range(n)], np.uint64))
        for hot in (0, n // 2, n):
            counts[:] = 0
            counts[(found[:hot] & np.uint64(SKETCH - 1)).astype(int)] = 5000
            prefix, need, _ = choose_prefix(found, counts, 10.0, 80)
            overlap = -(-80 * n // 100)
            assert 1 <= need <= overlap and len(prefix) == n - overlap + need and len(set(prefix.tolist())) == len(prefix)


def test_components(shipped):
    edges = [(k, k + 1) for k in range(1, 40)] + [(100, 101), (101, 100), (7, 7), (200, 199), (None, 3)]
    got = dict(rows_of(components(shipped.createDataFrame(edges, "a long, b long")), "node", "component"))
    assert got == {**{k: 1 for k in range(1, 41)}, 100: 100, 101: 100, 200: 199, 199: 199}
    assert components(shipped.createDataFrame([], "a long, b long")).count() == 0


def test_prefilter_keeps_all_listed(shipped):
    df = shipped.range(5000).withColumnRenamed("id", "k")
    kept = {r.k for r in maybe_in(df, df.where("k % 50 = 0"), "k").collect()}
    assert {k for k in range(0, 5000, 50)} <= kept and len(kept) < 200


def test_line_dedup_odd_rows(make, odd):
    out = dedup_lines(make([*odd, (11, "Shared line of text\nshort\nown line here"), (12, " shared LINE of text\t\nshort"), (12, "Shared line of text"), (None, "shared line of text\nlast")]))
    assert set(out.columns) >= {"n", "node", "token", "score", "n_lines", "n_dropped"}
    got = {r for r in rows_of(out, "doc_id", "n_lines", "n_dropped", "text") if r[0] in (11, 12, 1, 2, None)}
    assert {(11, 3, 0, "Shared line of text\nshort\nown line here"), (12, 2, 1, "short"), (12, 1, 1, ""), (None, 2, 1, "last"), (1, 1, 0, None), (2, 1, 0, "")} <= got
    assert rows_of(digests(out.where("doc_id = 2"), "text", "d"), "d") == [(hashlib.sha256(b"").hexdigest(),)]


def test_line_dedup_of_many_rows_without_id(make):
    """A row gets its own lines back, not those of all rows that share its id."""
    rows = [(None, f"own line number {k}\nshared line of text {k}") for k in range(2500)] + [(k, f"shared line of text {k}") for k in range(2500)]
    found = {(r.doc_id is None, r.n_dropped, r.text.count("\n")) for r in dedup_lines(make(rows, extra=False)).collect()}
    assert found == {(True, 1, 0), (False, 0, 0)}


def test_a_cycle_costs_the_rounds_of_its_conversation(shipped, monkeypatch):
    """Raised calls of other conversations add none."""
    rows = [(c, "a", 0, ["b"]) for c in range(200)] + [(c, "b", 1, []) for c in range(200)]
    rows += [(900, "x", 0, ["y"]), (900, "y", 1, ["x"]), (900, "z", 1, ["y"]), (900, "w", 3, [])]
    cuts = []
    monkeypatch.setattr(tool_chat, "cut_lineage", lambda df: cuts.append(1) or cut_lineage(df))
    found = tool_chat.order(shipped.createDataFrame(rows, "conv_id long, call_id string, position long, depends_on array<string>")).collect()
    assert {(r.conv_id, r.call_id) for r in found if r.cyclic} == {(900, "x"), (900, "y"), (900, "z")}
    assert all((r.order_major, r.order_minor) == (1, int(r.call_id == "a")) for r in found if r.conv_id < 200)
    assert len(cuts) < 16


def test_perfect_hash():
    keys = np.unique(np.random.default_rng(1).integers(0, 1 << 63, 20_000).astype(np.uint64))
    index = PerfectHash.load(PerfectHash.build(keys).dump())
    assert sorted(index.find(keys).tolist()) == list(range(len(keys)))
    assert len(PerfectHash.build(keys[:0]).find(keys)) == len(keys)


def test_exact_groups_odd_rows(make, odd):
    got = rows_of(exact_groups(make(odd)), "doc_id", "keep_id", "group_size", "kept")
    assert (1, 1, 3, True) in got and (2, 1, 3, False) in got and (None, 1, 3, False) in got
    assert (5, 4, 4, False) in got and (None, 4, 4, False) in got and (3, 3, 1, True) in got


def test_exact_groups_hot_copies(make):
    rows = [(k, "same text") for k in range(3000)] + [(5000 + k, f"text {k}") for k in range(50)]
    got = rows_of(exact_groups(make(rows)), "doc_id", "keep_id", "group_size", "kept")
    assert got == [(k, 0, 3000, k == 0) for k in range(3000)] + [(5000 + k, 5000 + k, 1, True) for k in range(50)]


def test_alignment_matches_the_plain_table():
    random.seed(2)
    for _ in range(60):
        a = [random.randint(1, 5) for _ in range(random.randint(1, 12))]
        b = [random.randint(1, 6) for _ in range(15)]
        table = [[0] * 16 for _ in range(len(a) + 1)]
        for i in range(1, len(a) + 1):
            for j in range(1, 16):
                table[i][j] = max(0, table[i - 1][j - 1] + (2 if a[i - 1] == b[j - 1] else -1), table[i - 1][j] - 1, table[i][j - 1] - 1)
        assert align(np.array(a, np.uint64), np.array([b], np.uint64))[0] == max(map(max, table))


def test_decontamination_of_edited_copies(make, shipped, odd):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi"
    edited = item.replace("delta", "CHANGED").replace("iota", "iota, more").upper()
    bench = shipped.createDataFrame([(7, item), (8, None), (None, item), (9, ""), (10, "two words")], "item_id long, text string")
    docs = make([*odd, (20, f"before {edited} after"), (21, "filler " * 5000 + item), (22, "alpha beta gamma only"), (None, item), (23, "these two words here")])
    got = {r[:2]: r[2] for r in rows_of(benchmark_matches(docs, bench), "doc_id", "item_id", "score")}
    assert set(got) == {(20, 7), (21, 7), (None, 7), (23, 10)} and got[21, 7] == 1.0 and 0.7 < got[20, 7] < 1
    kept = drop_contaminated(docs, bench)
    assert kept.columns == docs.columns and kept.count() == docs.count() - 4
    assert benchmark_matches(docs, bench.limit(0)).count() == 0 and drop_contaminated(docs, bench.limit(0)).count() == docs.count()


def test_token_counts_odd_rows(make, odd):
    library = sentencepiece.SentencePieceProcessor(model_proto=MODEL)
    got = token_counts.count_tokens(make(odd), MODEL).collect()
    assert len(got) == len(odd)
    for r in got:
        assert r.n_tokens == len(library.encode(r.text or "")) and r.n_bytes == len((r.text or "").encode())


def test_byte_bpe_round_trip(make, odd):
    coded = byte_bpe.encode(make([*odd, (30, "<|endoftext|> \x1c\x85")]), RANKS, public_tokenizers.PATTERN)
    got = byte_bpe.decode(coded, RANKS, public_tokenizers.PATTERN).collect()
    assert len(got) == len(odd) + 1 and all(bytes(r.decoded) == (r.text or "").encode() for r in got)


def test_sharding_rules(make, odd):
    names = [f"s{k}" for k in range(10)]
    table = sharding.fill(names, 1009)
    sizes = [table.count(k) for k in range(10)]
    assert max(sizes) - min(sizes) <= 1 and -1 not in table
    fewer = sharding.fill(names[:-1], 1009)
    moved = sum(a != b for a, b in zip(table, fewer, strict=True) if a != 9)
    assert moved < 1009 * 0.25
    placed = sharding.place(make(odd), names, 1009).collect()
    assert len(placed) == len(odd) and len({r["shard"] for r in placed if r.doc_id == 5}) == 1
    with pytest.raises(ValueError):
        sharding.fill(names, 1000)


SCHEMAS = {"add": {"x": ("bigint", True), "y": ("double", True), "note": ("string", False)}}


def test_tool_chat(shipped):
    calls = shipped.createDataFrame(
        [
            (1, "a", 0, "add", '{"y": 2.5, "x": 1}', ["c"]), (1, "b", 1, "add", '{"x": "1", "z": 0}', ["a", "zz", None]), (1, "c", 2, "add", "{bad", None),
            (1, "d", 3, "other", "{}", []), (2, "p", 0, "add", None, ["q"]), (2, "q", 1, "add", '{"x":1,"y":null}', ["p"]), (None, None, None, None, None, None),
        ],
        "conv_id long, call_id string, position long, tool string, arguments string, depends_on array<string>",
    )
    results = shipped.createDataFrame([(1, "a", 9, "late"), (1, "a", 5, "early"), (1, "zz", 1, "lost"), (None, "a", 1, "x"), (2, "q", 4, None)], "conv_id long, call_id string, turn long, content string")
    out = {(r.conv_id, r.call_id): r for r in tool_chat.format_calls(calls, results, SCHEMAS).collect()}
    assert len(out) == 7
    order = sorted("abcd", key=lambda k: (out[1, k].order_major, out[1, k].order_minor, out[1, k].position))
    assert order.index("c") < order.index("a") < order.index("b")
    assert [out[2, k].cyclic for k in "pq"] == [True, True] and not out[1, "a"].cyclic
    assert out[1, "a"].valid and out[1, "b"].problems == ["x", "y", "z"] and out[1, "c"].problems == ["json"] and out[1, "d"].problems == ["tool"]
    assert out[2, "q"].problems == ["y"] and out[1, "a"].n_results == 2
    record = json.loads(out[1, "a"].json)
    assert record["result"] == "early" and list(record) == sorted(record)
    assert '"arguments":{"x":1,"y":2.5}' in out[1, "a"].json
    assert tool_chat.format_calls(calls.limit(0), results.limit(0), SCHEMAS).count() == 0


@pytest.mark.parametrize("kind", [quality, toxicity])
def test_classifiers_odd_rows(shipped, make, odd, kind):
    docs = make([*odd, *[(100 + k, ("awful " if k % 2 else "fine ") + f"text number {k} of some words") for k in range(200)]])
    labels = shipped.createDataFrame([(100 + k, k % 2, "x") for k in range(200)] + [(None, 1, "x"), (100, None, "x"), (9_999, 1, "x")], "doc_id long, target int, score string")
    model = kind.train(docs, labels, "target")
    out = kind.score(docs, model)
    got = out.collect()
    assert len(got) == len(odd) + 200 and all(0 <= r.score <= 1 for r in got) and out.columns.count("score") == 1
    if kind is toxicity:
        assert all((r.score >= 0.5) == (r.doc_id % 2 == 1) for r in got if r.doc_id and r.doc_id >= 100)
    for none in (labels.limit(0), labels.where("target = 1")):
        assert kind.score(docs, kind.train(docs, none, "target")).count() == len(got)


def test_edited_copies_that_share_only_a_common_seed_are_found(shipped):
    rng = random.Random(9)
    items = [[f"w{i}x{k}" for k in range(16)] for i in range(40)]
    docs = []
    for i, item in enumerate(items):
        for _ in range(6):
            text = list(item)
            for k in range(len(text) - 1, -1, -1):
                turn = rng.random()
                text[k : k + 1] = ["other"] if turn < 0.15 else [text[k], "more"] if turn < 0.35 else [] if turn < 0.4 else [text[k]]
            docs.append(" ".join(["before"] * 30 + text + ["after"] * 30))
        # the first words of an item are the commonest
        docs += [" ".join(item[k : k + 4]) for k in (0, 2)] * 8
        # of this copy, two runs of three common words and single words are left
        docs.append(" ".join([*item[:3], "x", *item[4:6], "y", *item[7:9], "z", *item[10:12], "u", *item[13:15], "v"]))
    table = shipped.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    bench = shipped.createDataFrame([(i, " ".join(t)) for i, t in enumerate(items)], "item_id long, text string")
    codes = {}
    coded = [np.array([codes.setdefault(w, len(codes)) for w in text.split()], np.uint64) for text in docs]
    plain = [np.array([codes[w] for w in item], np.uint64) for item in items]
    expected = set()
    for d, text in enumerate(docs):
        for i in range(len(items)):
            words = text.split()
            if {" ".join(words[k : k + 3]) for k in range(len(words) - 2)} & {" ".join(items[i][k : k + 3]) for k in range(14)}:
                if align(item_words := plain[i], coded[d][None])[0] >= len(item_words):
                    expected.add((d, i))
    got = {(r.doc_id, r.item_id) for r in benchmark_matches(table, bench).collect()}
    assert len(expected) > 100 and got == expected


def test_near_copies_are_dropped_row_by_row(shipped, make):
    a, b, c, d = (" ".join(f"{name}{k}" for k in range(30)) for name in "abcd")
    rows = [(1, a), (5, a + " end"), (5, b), (6, c), (6, c), (6, c.upper()), (7, c), (None, b + " end"), (None, d), (None, d), (8, ""), (8, ""), (None, None)]
    docs = make(rows)
    kept = corpus_pipeline.drop_near_copies(shipped, docs, "")
    assert kept.columns == docs.columns
    got = sorted(((r.doc_id, r.text) for r in kept.collect()), key=str)
    assert got == sorted([(1, a), (5, b), (6, c.upper()), (None, d), (8, ""), (8, ""), (None, None)], key=str)


def test_few_toxic_rows_among_many_have_voters(shipped):
    random.seed(5)
    words = ["".join(random.choices("bcdfgklmnprst", k=6)) for _ in range(300)]
    rows = [(k, " ".join(random.choices(words, k=12)), int(k % 500 == 3)) for k in range(5_000)]
    toxic = [k for k, _, y in rows if y and zlib.crc32(str(k).encode()) % 5]
    # a word in three toxic rows and in no other, together with a second word, and one in a single toxic row
    rows = [(k, t + (" xyzzy quuxly" if k in toxic[:3] else " plughy" if k == toxic[3] else ""), y) for k, t, y in rows]
    docs = shipped.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    model = toxicity.train(docs, shipped.createDataFrame([(k, y) for k, _, y in rows], "doc_id long, toxic int"))
    scores = model.scores(["some xyzzy", "some quuxly", "some plughy"])
    assert (scores[:2].max() >= 0.5) and scores[2] < 0.5
    # clues with the same documents are one voter: words, beginnings
    assert len(np.intersect1d(toxicity.clues(["xyzzy quuxly"])[1], model.voters)) == 1


def test_evidence_bar_follows_the_sample():
    # no clue beats chance: the strongest step stays
    assert toxicity.evidence_bar({2: 1_000}, {8: 3}, 5, 30) == 8
    # three documents of three toxic ones are next to impossible by chance among many others
    assert toxicity.evidence_bar({2: 10_000, 3: 10_000}, {30: 1, 80: 2}, 16, 16_368) <= 80
    assert toxicity.evidence_bar({}, {}, 1, 1) == toxicity.TOP_STEP


def test_empty_tables(make):
    none = make([])
    for out in (
        ngram_components(none), dedup_lines(none), exact_groups(none), token_counts.count_tokens(none, MODEL),
        byte_bpe.encode(none, RANKS, public_tokenizers.PATTERN), sharding.place(none, ["a"]),
    ):
        assert out.count() == 0
