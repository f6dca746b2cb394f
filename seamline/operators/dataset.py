"""Capture datasets: splits without leakage, counts by name parts, clashing targets."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from seamline.functions.hashing import hash_split
from seamline.functions.text import parse_capture_name, prepared_target
from seamline.operators.ordered import RUN, ordered_runs, session_numbers


def sessions(
    df: DataFrame, keys: list[str], ts_us: str, unique: str, gap_us: int, runs: int | None = None
) -> DataFrame:
    """Number the sessions of each key: a pause longer than ``gap_us`` starts a new one (from 1)."""
    order = [ts_us, unique]
    ordered = ordered_runs(df, keys, order, runs)
    return session_numbers(ordered, keys, order, gap_us).drop(RUN)


def sequence_split(
    df: DataFrame, keys: list[str], ts_us: str, unique: str, gap_us: int, runs: int | None = None
) -> DataFrame:
    """Split whole sequences of similar shots, so that none is torn between splits."""
    grouped = sessions(df, keys, ts_us, unique, gap_us, runs)
    group = F.concat_ws("-", *keys, "session")
    return grouped.withColumn("sequence", group).withColumn("split", hash_split(group))


def split_leaks(assigned: DataFrame, group: str = "sequence", split: str = "split") -> DataFrame:
    """Groups seen in more than one split."""
    seen = assigned.groupBy(group).agg(
        F.min(split).alias("first_split"), F.max(split).alias("last_split"), F.count("*").alias("shots")
    )
    return seen.filter(F.col("first_split") != F.col("last_split"))


def capture_cube(captures: DataFrame) -> DataFrame:
    """Counts over every combination of garment, defect and split; ``all`` marks a subtotal."""
    names = ["garment", "defect", "split"]
    cubed = captures.cube(*names).agg(F.count("*").alias("captures"), F.grouping_id().alias("level"))
    # grouping_id has one bit per column, first column highest
    marked = [
        F.when(F.col("level").bitwiseAND(1 << (len(names) - 1 - i)) != 0, "all")
        .otherwise(F.col(name))
        .alias(name)
        for i, name in enumerate(names)
    ]
    return cubed.select(*marked, "captures")


def parsed_captures(files: DataFrame, name: str = "file_name") -> DataFrame:
    return files.withColumn("parsed", parse_capture_name(F.col(name))).select("*", "parsed.*").drop("parsed")


def duplicate_targets(files: DataFrame, relative: str = "relative_path") -> DataFrame:
    """Prepared images that several sources would be written to."""
    grouped = files.groupBy(prepared_target(F.col(relative)).alias("target")).agg(
        F.count("*").alias("sources"), F.min(relative).alias("first_source"), F.max(relative).alias("last_source")
    )
    return grouped.filter(F.col("sources") > 1)


def require_min_rows(df: DataFrame, minimum: int = 10, what: str = "rows") -> DataFrame:
    """``df``, or an error when it has fewer than ``minimum`` rows (stops counting there)."""
    found = df.limit(minimum).count()
    if found < minimum:
        raise ValueError(f"at least {minimum} {what} are needed, found {found}")
    return df
