"""Near copies by 64-bit SimHash fingerprints, linked when they differ in few bits.

Method: pivot distance tables. The Hamming distances of a fingerprint to fixed reference fingerprints are its
coordinates; two fingerprints within ``d`` bits have no coordinate further apart than ``d``. Pairs are discarded
coordinate by coordinate, and those that survive all of them are verified on the fingerprints themselves.

The distances of unrelated fingerprints crowd around 32, so coordinates alone cannot deal pairs out to tasks: of
six parts of the bits, three are equal in any pair within three bits, and fingerprints meet where they agree on
some three parts. A meeting of many fingerprints is cut into blocks and every two blocks meet in a task of their
own. A task passes on the links of a spanning forest only, which keeps all components.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seamline.llm.graph import components, looked_up
from seamline.llm.texts import blocks, encoded, mixed
from seamline.session import cut_lineage, shuffle_partitions

#: Bits that linked fingerprints may differ in, and parts of the bits: three of six stay equal.
DISTANCE, PARTS = 3, 6
#: Reference fingerprints, and fingerprints in a block of a large meeting.
PIVOTS, BLOCK = 32, 2048
#: Shingle hashes that are counted at once.
COUNTED = 1 << 14
REFERENCES = mixed(np.arange(1, PIVOTS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_EDGES = [round(k * 64 / PARTS) for k in range(PARTS + 1)]
#: For each choice of three parts, the mask of their bits.
MASKS = [sum(((1 << (_EDGES[k + 1] - _EDGES[k])) - 1) << _EDGES[k] for k in some) for some in combinations(range(PARTS), PARTS - DISTANCE)]


class _Votes:
    """How many of the hashes seen so far have each bit."""

    def __init__(self) -> None:
        self.counts, self.total = np.zeros(64, np.int64), 0

    def add(self, hashes: list[int]) -> None:
        for start in range(0, len(hashes), COUNTED):
            part = np.array(hashes[start : start + COUNTED], ">u8")
            self.counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
        self.total += len(hashes)

    def bits(self) -> int:
        return int.from_bytes(np.packbits(2 * self.counts > self.total).tobytes(), "big")


def fingerprint(text: str | None, width: int = 3, seed: int = 42) -> int:
    """The SimHash of a text's shingles of ``width`` words, repeats included; zero without words.

    Words are runs without ASCII white space, A-Z lower-cased. A text of fewer words is one shingle. The text is
    read in blocks, each with the last words of the one before it.
    """
    votes, last = _Votes(), []
    hashed = xxhash.xxh64_intdigest
    for part in blocks(np.frombuffer(encoded(text).lower(), np.uint8)):
        words = last + part.tobytes().split()
        if len(words) >= width:
            joined = b" ".join(words)
            ends = np.cumsum([len(word) + 1 for word in words])
            starts = np.concatenate(([0], ends))[: len(words) - width + 1].tolist()
            votes.add([hashed(joined[a:b], seed) for a, b in zip(starts, (ends[width - 1 :] - 1).tolist(), strict=True)])
            last = words[len(words) - width + 1 :]
        else:
            last = words
    if not votes.total and last:
        votes.add([hashed(b" ".join(last), seed)])
    return votes.bits()


def _fingerprinted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = np.array([fingerprint(text.as_py()) for text in batch.column(1)], np.uint64)
        yield pa.record_batch([batch.column(0), pa.array(found.view(np.int64))], names=["doc_id", "node"])


def distance_table(found: np.ndarray) -> np.ndarray:
    """Hamming distances of fingerprints (uint64) to the references, a row for each reference."""
    return np.bitwise_count(found[None, :] ^ REFERENCES[:, None])


class _Forest:
    """Trees over positions 0..n-1, joined by links."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def flatten(self) -> None:
        while True:
            up = self.parent[self.parent]
            if (up == self.parent).all():
                return
            self.parent = up

    def _root(self, k: int) -> int:
        parent = self.parent
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    def join(self, a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
        """The links that join two trees."""
        used = []
        for x, y in zip(a.tolist(), b.tolist(), strict=True):
            p, q = self._root(x), self._root(y)
            if p != q:
                self.parent[max(p, q)] = min(p, q)
                used.append((x, y))
        self.flatten()
        return used


def surviving(table: np.ndarray, a: np.ndarray, b: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of positions no coordinate of which is further apart than ``distance``."""
    for row in table:
        near = np.abs(row[a].view(np.int8) - row[b].view(np.int8)) <= distance
        if not near.all():
            a, b = a[near], b[near]
        if not len(a):
            break
    return a, b


def linked(found: np.ndarray, group: np.ndarray, side: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Links (positions) of a spanning forest of the fingerprints that meet; ``group`` is sorted.

    A side of 0 meets all of its group, 1 and 2 meet each other only.
    """
    table, forest, links = distance_table(found), _Forest(len(found)), []
    ends = np.searchsorted(group, group, "right")
    left = np.arange(len(found))
    step = 1
    while True:
        left = left[left + step < ends[left]]
        if not len(left):
            return links
        a, b = left, left + step
        apart = (forest.parent[a] != forest.parent[b]) & ((side[a] == 0) | (side[a] != side[b]))
        a, b = surviving(table, a[apart], b[apart], distance)
        near = np.bitwise_count(found[a] ^ found[b]) <= distance
        if near.any():
            links += forest.join(a[near], b[near])
        step += 1


def _met(distance: int):
    """Links among rows (choice, part, low, high, side, node) that come sorted by their first four columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            now = [column.to_numpy(zero_copy_only=False) for column in batch.columns]
            if held:
                now = [np.concatenate(pair) for pair in zip(held, now, strict=True)]
            # the last group may go on in the next batch
            same = np.ones(len(now[0]), bool)
            for column in now[:4]:
                same &= column == column[-1]
            cut = int(np.argmax(same))
            held = [column[cut:] for column in now]
            yield from solved([column[:cut] for column in now])
        if held:
            yield from solved(held)

    def solved(columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        if len(columns[0]) < 2:
            return
        new = np.zeros(len(columns[0]), bool)
        for column in columns[:4]:
            new[1:] |= column[1:] != column[:-1]
        group = np.cumsum(new)
        sizes = np.bincount(group)[group]
        some = sizes > 1
        nodes = columns[5][some]
        if len(nodes):
            links = linked(nodes.view(np.uint64), group[some], columns[4][some], distance)
            if links:
                a, b = np.array(links).T
                yield pa.record_batch([pa.array(nodes[a]), pa.array(nodes[b])], names=["a", "b"])

    return run


def near_links(nodes: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """Links (a, b) between the distinct ``nodes`` (node long) within ``distance`` bits, enough for all components.

    A null node is an error. An empty table gives an empty result.
    """
    if not 0 <= distance <= DISTANCE:
        raise ValueError(f"a distance of 0 to {DISTANCE} bits, not {distance}")
    choices = F.array(*[F.lit(mask - (1 << 64) if mask >> 63 else mask) for mask in MASKS])
    dealt = nodes.select("node", F.posexplode(choices).alias("choice", "mask")).select("choice", F.col("node").bitwiseAND(F.col("mask")).alias("part"), "node")
    sizes = dealt.groupBy("choice", "part").agg(F.count("*").alias("members")).where("members > 1")
    met = dealt.join(sizes, ["choice", "part"])
    # blocks of a meeting: a row goes to every pair of blocks that its own is in
    cut = met.withColumn("blocks", F.ceil(F.col("members") / BLOCK).cast("int")).withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    rows = cut.select("choice", "part", "node", "own", other).select(
        "choice",
        "part",
        F.least("own", "other").alias("low"),
        F.greatest("own", "other").alias("high"),
        F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), 1).otherwise(2).alias("side"),
        "node",
    )
    keys = ["choice", "part", "low", "high"]
    dealt_out = rows.repartition(shuffle_partitions(nodes.sparkSession), *keys).sortWithinPartitions(*keys)
    return dealt_out.mapInArrow(_met(distance), "a long, b long").distinct()


def simhash_components(docs: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row of ``docs`` (doc_id, text; other columns are ignored).

    The fingerprint is 16 lowercase hex digits, see ``fingerprint``; documents whose fingerprints differ in at most
    ``distance`` bits link, equal ones included, and component_id is the smallest id reachable by links.

    Null, empty and blank texts have fingerprint zero and link like any other. Rows that repeat an id are documents
    of their own with that id. A row with a null id links too; its component_id is the smallest id it reaches,
    null if there is none. An empty table gives an empty result.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    named = cut_lineage(texts.mapInArrow(_fingerprinted, "doc_id long, node long"))
    nodes = cut_lineage(named.groupBy("node").agg(F.min("doc_id").alias("least"), F.count("*").alias("times")))
    placed = nodes.join(components(near_links(nodes.select("node"), distance)), "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = placed.groupBy("component").agg(F.min("least").alias("component_id"))
    known = cut_lineage(placed.join(least, "component").select("node", "times", "component_id"))
    found = looked_up(named, known, "node")
    return found.select("doc_id", F.lower(F.lpad(F.hex("node"), 16, "0")).alias("fingerprint"), "component_id")
