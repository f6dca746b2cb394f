"""Whole texts in Arrow batches, and vectorised hashes of their words."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: White space of the word rule ``[^\x20\x09-\x0D]+``.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
_P = 0x9E3779B97F4A7C15 | 1
_BLOCK = 1 << 15


def mixed(x: np.ndarray) -> np.ndarray:
    """Bijective mixing of 64-bit integers (the murmur finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


_VALUE = mixed(np.arange(1, 257, dtype=np.uint64))
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64; the tables grow to the longest block seen."""
    if len(_powers[0]) < n:
        size = 1 << max(17, (n - 1).bit_length())
        for k, base in enumerate((_P, pow(_P, -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0], _powers[1]


class Words:
    """Words of one block of bytes: starts, ends, and hashes of any part counted from a start."""

    def __init__(self, data: np.ndarray, inside: np.ndarray):
        step = np.diff(np.concatenate(([0], inside.view(np.int8), [0])))
        self.starts = np.flatnonzero(step == 1)
        self.ends = np.flatnonzero(step == -1)
        up, self._down = _power_tables(len(data) + 1)
        self._sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_VALUE[data] * up[: len(data)], out=self._sums[1:])

    def hashes(self, ends: np.ndarray | None = None, which: np.ndarray | slice = slice(None)) -> np.ndarray:
        starts = self.starts[which]
        ends = self.ends[which] if ends is None else ends
        return mixed((self._sums[ends] - self._sums[starts]) * self._down[starts] + (ends - starts).astype(np.uint64))


def blocks(data: np.ndarray, space: np.ndarray = SPACE) -> Iterator[np.ndarray]:
    """Parts of a text, cut behind white space, so that tables of positions stay small; a long word stays whole."""
    at = 0
    while len(data) - at > 2 * _BLOCK:
        size = _BLOCK
        while True:
            cut = np.flatnonzero(space[data[at + _BLOCK : at + _BLOCK + size]])
            if len(cut) or at + _BLOCK + size >= len(data):
                break
            size *= 4
        end = at + _BLOCK + int(cut[0]) + 1 if len(cut) else len(data)
        yield data[at:end]
        at = end
    yield data[at:]


def encoded(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def word_hashes_of(texts: Iterable[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of many texts, A-Z lower-cased, and where each text's words begin.

    Words are runs without ASCII white space. The texts are hashed as one buffer, block by block.
    """
    parts = [encoded(text).lower() for text in texts]
    ends = np.cumsum([len(part) + 1 for part in parts])
    data = np.frombuffer(b" ".join(parts), np.uint8)
    at, hashes, starts = 0, [], []
    for part in blocks(data):
        found = Words(part, ~SPACE[part])
        hashes.append(found.hashes())
        starts.append(found.starts + at)
        at += len(part)
    offsets = np.concatenate(([0], np.searchsorted(np.concatenate(starts), ends, "left")))
    return np.concatenate(hashes), offsets


def word_hashes(text: str | None) -> np.ndarray:
    return word_hashes_of([text])[0]


def gram_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hash of every run of ``width`` words, in order; none for shorter sequences."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = words[:n].copy()
    for k in range(1, width):
        out *= np.uint64(_P)
        out += words[k : k + n]
    return mixed(out)


def shingles_of(texts: list[str | None], width: int = 5) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text.

    A text with fewer words than ``width`` is one shingle, one without words has none.
    """
    words, offsets = word_hashes_of(texts)
    grams = gram_hashes(words, width)
    out = []
    for start, end in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        if end - start >= width:
            found = np.sort(grams[start : end - width + 1])
            keep = np.empty(len(found), bool)
            keep[0] = True
            np.not_equal(found[1:], found[:-1], out=keep[1:])
            out.append(found[keep])
        else:
            out.append(gram_hashes(words[start:end], end - start) if end > start else words[:0])
    return out


def pieces(values: list, sizes: list[int], limit: int = 1 << 20) -> Iterator[list]:
    """Runs of ``values`` of about ``limit`` bytes together; a larger value is a run of its own."""
    run: list = []
    total = 0
    for value, size in zip(values, sizes, strict=True):
        if run and total + size > limit:
            yield run
            run, total = [], 0
        run.append(value)
        total += size
    if run:
        yield run


def map_batches(
    df: DataFrame, fn: Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: T.StructType | str
) -> DataFrame:
    return df.mapInArrow(fn, schema)


def held_out(column: str = "doc_id", folds: int = 5) -> Column:
    """Whether crc32 of the id as text leaves no remainder; rows with a null id are held out."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % folds == 0, F.lit(True))


def labelled_sample(docs: DataFrame, labels: DataFrame, target: str, rows: int) -> DataFrame:
    """At most ``rows`` labelled documents outside the held-out fold: (doc_id, text, label).

    The bound is the only sample in the classifiers: it fixes the size of what is fitted on the driver. The
    rows with the smallest hash of their id are taken, so that the choice does not depend on partitions.
    """
    chosen = (
        labels.select("doc_id", F.col(target).cast("int").alias("label"))
        .where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & ~held_out())
        .groupBy("doc_id")
        .agg(F.max("label").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(rows)
    )
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return texts.join(F.broadcast(chosen), "doc_id")


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Positions ``starts[k] .. starts[k] + sizes[k]`` of every run, one after the other."""
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(starts - (ends - sizes), sizes)
