"""Resampling of a corpus towards a target distribution, by hashed word runs.

Method: word runs fall into buckets by hash; a bucket's gain is the log ratio of its smoothed shares in the target
and in the corpus. Documents are scored by looking their buckets up in an array of gains, Gumbel noise from the id
makes the highest scores a weighted sample without replacement, and a distributed radix sort ranks all scores.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seamline.llm.radix import sorted_positions
from seamline.llm.texts import blocks, encoded

BUCKETS = 10_000
#: Distinct runs whose buckets a task remembers, and the longest of them in bytes.
REMEMBERED, SHORT = 200_000, 64
#: Bytes outside words become spaces, A-Z become a-z; digits, letters and bytes from 0x80 stay.
_PLAIN = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))
_SPACE = np.zeros(256, bool)
_SPACE[0x20] = True


class _Buckets(dict):
    """Bucket of a run of words; short ones are remembered."""

    def __init__(self, buckets: int):
        super().__init__()
        self.buckets = buckets

    def __missing__(self, run: bytes) -> int:
        bucket = zlib.crc32(run) % self.buckets
        if len(run) <= SHORT:
            if len(self) >= REMEMBERED:
                self.clear()
            self[run] = bucket
        return bucket


def features(text: str | None, known: _Buckets, longest: int) -> Iterator[tuple[int, np.ndarray]]:
    """Buckets of all runs of 1 to ``longest`` words of a text, repeats included, by their width, block by block.

    A block begins with the last words of the one before it, whose runs of their own are not given again.
    """
    last: list[bytes] = []
    find = known.__getitem__
    for part in blocks(np.frombuffer(encoded(text).translate(_PLAIN), np.uint8), _SPACE):
        words = last + part.tobytes().split()
        for width in range(1, longest + 1):
            runs = words[len(last) :] if width == 1 else [b" ".join(words[k : k + width]) for k in range(max(0, len(last) - width + 1), len(words) - width + 1)]
            if runs:
                yield width, np.fromiter(map(find, runs), np.int64, len(runs))
        last = words[len(words) - longest + 1 :] if longest > 1 else []


def _counted(buckets: int, longest: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, known = np.zeros(buckets, np.int64), _Buckets(buckets)
        for batch in batches:
            for text in batch.column(0):
                for _, found in features(text.as_py(), known, longest):
                    counts += np.bincount(found, minlength=buckets)
        some = np.flatnonzero(counts)
        yield pa.record_batch([pa.array(some.astype(np.int32)), pa.array(counts[some])], names=["bucket", "times"])

    return run


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS, longest: int = 1) -> np.ndarray:
    """Features in each bucket over all of ``texts`` (text); only the ``buckets`` sums reach the driver."""
    found = texts.select("text").mapInArrow(_counted(buckets, longest), "bucket int, times long")
    counts = np.zeros(buckets, np.int64)
    for row in found.groupBy("bucket").agg(F.sum("times").alias("times")).collect():
        counts[row["bucket"]] = row["times"]
    return counts


def gains_of(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of each bucket's smoothed shares, rounded down."""
    s_all, t_all, n = int(corpus.sum()), int(target.sum()), len(corpus)
    pairs = zip(corpus.tolist(), target.tolist(), strict=True)
    return np.array([math.floor(1000 * math.log((t + 1.0) * (s_all + n) / ((s + 1.0) * (t_all + n)))) for s, t in pairs], np.int64)


def _weighed(gains, longest: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = gains.value
        known = _Buckets(len(table))
        for batch in batches:
            counts, words, weights = [], [], []
            for text in batch.column(1):
                n = single = total = 0
                for width, found in features(text.as_py(), known, longest):
                    n += len(found)
                    single += len(found) if width == 1 else 0
                    total += int(table[found].sum())
                counts.append(n)
                words.append(single)
                weights.append(total // n if n else 0)
            yield pa.record_batch([batch.column(0), pa.array(counts, pa.int64()), pa.array(words, pa.int64()), pa.array(weights, pa.int64())], names=["doc_id", "n_features", "n_words", "weight"])

    return run


def noise(seed: int) -> Column:
    """Thousandths of Gumbel noise from the first 32 bits of the SHA-256 of ``<seed>:<doc_id>``, rounded down."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256)
    uniform = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") + F.lit(0.5)) / F.lit(4294967296.0)
    return F.floor(F.lit(-1000.0) * F.log(-F.log(uniform))).cast("long")


def resample(docs: DataFrame, target: DataFrame, percent: int = 10, least: int = 20, longest: int = 1, buckets: int = BUCKETS, seed: int = 2024) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every row of ``docs`` (doc_id, text), drawn towards ``target`` (text).

    Words are runs of ASCII letters and digits and of characters outside ASCII, A-Z lower-cased; features are all
    runs of 1 to ``longest`` words. ``weight`` is the mean gain of a document's features rounded down, 0 without
    any; ``score`` adds the noise of its id. Of the N documents with at least ``least`` words,
    ``floor(percent * N / 100)`` are drawn: rank 1, 2, 3... by falling score, equal ones by rising id. All others
    have a null rank.

    A null text has no features. A null id has the noise of an empty string and comes after all others of its
    score. Rows that repeat an id count one each; their order among equal scores is not stated. Other columns are
    ignored. An empty table gives an empty result, and an empty target weighs by rarity in the corpus alone.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    gains = gains_of(bucket_counts(texts, buckets, longest), bucket_counts(target, buckets, longest))
    sent = docs.sparkSession.sparkContext.broadcast(gains)  # one number for each bucket
    weighed = texts.mapInArrow(_weighed(sent, longest), "doc_id long, n_features long, n_words long, weight long")
    scored = weighed.withColumn("score", F.col("weight") + noise(seed))
    # scores fall, then ids rise, those without an id last; documents of few words come after all others
    keyed = scored.select(
        *["doc_id", "n_features", "weight", "score", (F.col("n_words") < least).cast("long").alias("short"), F.bitwise_not("score").alias("falling")],
        *[F.col("doc_id").isNull().cast("long").alias("unnamed"), F.coalesce("doc_id", F.lit(0)).alias("rising")],
    )
    placed = sorted_positions(keyed, ["short", "falling", "unnamed", "rising"])
    drawn = percent * placed.where("short = 0").count() // 100
    return placed.select("doc_id", "n_features", "weight", "score", F.when(F.col("position") < drawn, F.col("position") + 1).alias("rank"))
