"""Exact duplicates by partial aggregates of digests along a tree; nothing is sorted or merged in order.

Method: rows are dealt to runs; a run is its distinct digests with the smallest id and the number of rows of
each. In every round, runs whose numbers differ in the lowest digits only are merged, several at once, until
one run is left. What it says of a digest then goes down the same tree, so that no step sees a digest more
often than there are runs, however many copies it has. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seamline.session import shuffle_partitions

#: Runs that are merged into one in a round.
FAN_IN = 8
#: Two hashes and a length tell texts apart: equal SHA-256 digests are checked by the others at every level.
KEY = ("digest", "check", "length")


def normalised(column: str = "text") -> Column:
    """The text with each run of ASCII white space replaced by one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(F.col(column), F.lit("")), r"[\x20\x09-\x0D]+", " ")


def run_count(partitions: int) -> int:
    """Runs at the leaves: the least power of the fan-in that is not below the number of partitions."""
    runs = FAN_IN
    while runs < partitions:
        runs *= FAN_IN
    return runs


def exact_groups(docs: DataFrame) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) of every row of ``docs`` (doc_id, text).

    Texts are equal when they are the same after replacing each run of ASCII white space by one space. Of
    equal texts the row with the smallest id stays. Null and empty texts are equal; a text of white space only
    is one space. A null id is larger than all others: such a row stays only in a group without ids, where
    ``keep_id`` is null and all rows are kept, as nothing tells them apart. Rows that repeat id and text are
    all kept or all dropped, and count one each. Other columns are ignored; an empty table gives none.
    """
    runs = run_count(shuffle_partitions(docs.sparkSession))
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), normalised().alias("plain"))
    rows = plain.select(
        "doc_id",
        F.sha2(F.col("plain").cast("binary"), 256).alias("text_sha256"),
        F.xxhash64("plain").alias("check"),
        F.octet_length("plain").alias("length"),
    ).withColumns(
        {"digest": F.unhex("text_sha256"), "run": F.pmod(F.xxhash64("doc_id"), F.lit(runs)).cast("int")}
    ).drop("text_sha256")
    merged = rows.groupBy(*KEY, "run").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    levels = [merged]
    while runs > 1:
        runs //= FAN_IN
        level = levels[-1].withColumn("run", F.shiftright("run", FAN_IN.bit_length() - 1))
        levels.append(level.groupBy(*KEY, "run").agg(F.min("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size")))
    down = levels.pop()
    for level in reversed(levels):
        above = down.select(*KEY, F.col("run").alias("__above"), "keep_id", "group_size")
        below = level.select(*KEY, "run", F.shiftright("run", FAN_IN.bit_length() - 1).alias("__above"))
        down = below.join(above, [*KEY, "__above"]).drop("__above")
    found = rows.join(down, [*KEY, "run"])
    return found.select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )
