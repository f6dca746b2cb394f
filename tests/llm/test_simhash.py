"""SimHash fingerprints and components against plain versions."""

import random

import numpy as np
import pytest
import xxhash

from seamline.llm import simhash
from seamline.llm.graph import looked_up
from seamline.llm.queries import QUERIES
from seamline.llm.simhash import distance_table, fingerprint, linked, near_links, simhash_components, surviving


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[k : k + 3]) for k in range(len(words) - 2)] if len(words) > 2 else [b" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def plain_components(rows, distance=3):
    """Smallest id by all pairs of distinct fingerprints."""
    prints = {}
    for doc, text in rows:
        prints.setdefault(plain_fingerprint(text), []).append(doc)
    nodes = list(prints)
    group = {n: n for n in nodes}
    for k, x in enumerate(nodes):
        for y in nodes[:k]:
            if (x ^ y).bit_count() <= distance and group[x] != group[y]:
                old, new = group[x], group[y]
                group = {n: new if g == old else g for n, g in group.items()}
    least = {}
    for n, docs in prints.items():
        least.setdefault(group[n], []).extend(d for d in docs if d is not None)
    return sorted(((d, f"{n:016x}", min(least[group[n]], default=None)) for n, docs in prints.items() for d in docs), key=repr)


def test_fingerprints_match_the_plain_version(monkeypatch):
    random.seed(4)
    texts = ["", None, " \t", "a", "a b", "a b c", "A  b\tc d\n", "naïve café 漢字 🎉 \x00 end", "word " * 40_000, "x" * 200_000 + " y z"]
    texts += [" ".join(random.choice("abcdefgh") * random.randint(1, 4) for _ in range(random.randint(1, 60))) for _ in range(60)]
    texts += [" ".join(str(random.random()) for _ in range(20_000))]
    for text in texts:
        assert fingerprint(text) == plain_fingerprint(text)


def edited(rng, words, times):
    words = list(words)
    for _ in range(times):
        words[rng.randrange(len(words))] = rng.choice("abcdefghij") * 3
    return " ".join(words)


def test_components_match_all_pairs(make, odd):
    rng = random.Random(6)
    rows = list(odd)
    for _ in range(25):
        base = [rng.choice(["alpha", "beta", "gamma", "delta", "eps"]) + str(rng.randrange(300)) for _ in range(rng.choice([8, 60, 400]))]
        rows += [(rng.randrange(10**6), edited(rng, base, rng.choice([0, 1, 1, 2]))) for _ in range(rng.choice([1, 3, 12]))]
    found = simhash_components(make(rows)).select("doc_id", "fingerprint", "component_id").collect()
    assert sorted(map(tuple, found), key=repr) == plain_components(rows)


def joined(nodes, links):
    group = {n: n for n in nodes}
    for a, b in links:
        old, new = group[a], group[b]
        group = {n: new if g == old else g for n, g in group.items()}
    sets = {}
    for n, g in group.items():
        sets.setdefault(g, set()).add(n)
    return sorted(map(sorted, sets.values()))


@pytest.mark.parametrize("block", [2048, 20])
def test_links_join_what_all_pairs_join(shipped, monkeypatch, block):
    """Balls of fingerprints around a few centres: many meet, in blocks that do not hold them all."""
    monkeypatch.setattr(simhash, "BLOCK", block)
    rng = random.Random(block)
    nodes = set()
    for _ in range(12):
        centre = rng.getrandbits(64)
        for _ in range(rng.choice([1, 10, 150])):
            for bit in rng.sample(range(64), rng.choice([0, 1, 2, 3, 5])):
                nodes.add(centre ^ 1 << bit)
                centre ^= (1 << bit) if rng.random() < 0.05 else 0
    signed = {n: n - (1 << 64) if n >> 63 else n for n in nodes}
    links = [tuple(r) for r in near_links(shipped.createDataFrame([(n,) for n in signed.values()], "node long")).collect()]
    all_pairs = [(signed[a], signed[b]) for a in nodes for b in nodes if a < b and (a ^ b).bit_count() <= 3]
    assert all(((a ^ b) & (1 << 64) - 1).bit_count() <= 3 for a, b in links)
    assert joined(signed.values(), links) == joined(signed.values(), all_pairs)


def test_coordinates_never_lose_a_near_pair():
    rng = np.random.default_rng(3)
    found = rng.integers(0, 1 << 63, 400).astype(np.uint64)
    found = np.concatenate([found, found ^ (np.uint64(1) << rng.integers(0, 64, 400).astype(np.uint64))])
    a, b = np.triu_indices(len(found), 1)
    kept = set(zip(*(x.tolist() for x in surviving(distance_table(found), a, b, 3)), strict=True))
    near = np.bitwise_count(found[a] ^ found[b]) <= 3
    assert set(zip(a[near].tolist(), b[near].tolist(), strict=True)) <= kept
    assert len(kept) < 1.02 * near.sum() + 50  # of 319,600 pairs


def test_sides_of_two_blocks_do_not_meet_themselves():
    found = np.array([0, 1, 3], np.uint64)
    group = np.zeros(3, int)
    assert sorted(linked(found, group, np.array([1, 1, 2]), 1)) == [(1, 2)]
    assert len(linked(found, group, np.zeros(3, int), 3)) == 2


def test_frequent_keys_are_looked_up_apart(shipped):
    rows = shipped.range(5000).selectExpr("id", "if(id < 4000, 7L, id) AS node")
    known = rows.groupBy("node").count().withColumnRenamed("count", "times").selectExpr("node", "times", "node * 2 AS double")
    found = looked_up(rows, known, "node").collect()
    assert len(found) == 5000 and all(r.double == 2 * r.node for r in found)


def test_empty_table_and_distance(make):
    assert simhash_components(make([])).collect() == []
    with pytest.raises(ValueError, match="0 to 3 bits"):
        near_links(make([]).selectExpr("doc_id AS node"), 4)


def test_query_matches_all_pairs(shipped, data):
    rows = [tuple(r) for r in shipped.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()]
    found = QUERIES["op12_simhash"](shipped, data).select("doc_id", "fingerprint", "component_id").collect()
    assert sorted(map(tuple, found), key=repr) == plain_components(rows)
