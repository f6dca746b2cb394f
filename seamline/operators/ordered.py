"""Order-dependent work (lag, running totals, exact quantiles) that survives hot keys.

A window partitioned by a key sorts all rows of that key in one task. Here the rows are instead
range-partitioned on the full order, so that a hot key spreads over many *runs*; work inside a run
is an ordinary window, and what crosses a run border is carried by a summary of one row per
(key, run). A null key is a key like any other. The runs are checkpointed, which pins the run borders and cuts the lineage.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from seamline.session import cut_lineage, shuffle_partitions

RUN = "_run"


def ordered_runs(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], runs: int | None = None
) -> DataFrame:
    """``df`` in runs sorted by ``keys`` and ``order``; ``order`` should end in a unique column."""
    runs = runs or shuffle_partitions(df.sparkSession)
    ranged = df.repartitionByRange(runs, *keys, *order)
    return cut_lineage(ranged.withColumn(RUN, F.spark_partition_id()))


def join_on(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on ``keys`` where null equals null; the keys come from the left side."""
    own = right.withColumnsRenamed({k: "_r_" + k for k in keys})
    same = [left[k].eqNullSafe(own["_r_" + k]) for k in keys]
    return left.join(own, same, how).drop(*["_r_" + k for k in keys])


def _in_run(keys, order) -> Window:
    return Window.partitionBy(*keys, RUN).orderBy(*order)


def _across_runs(keys) -> Window:
    return Window.partitionBy(*keys).orderBy(RUN)


def with_history(
    runs: DataFrame,
    keys,
    order,
    previous: Sequence[str] = (),
    name: str = "previous",
    totals: dict[str, str] | None = None,
) -> DataFrame:
    """Add ``name``, the struct of ``previous`` columns in the row before (null in the first row of a
    key), and inclusive running totals (input column to output column).

    The rows are shuffled once, by (key, run); what a run needs from earlier ones comes from its
    summary row, in one join.
    """
    totals = totals or {}
    inside, value = _in_run(keys, order), F.struct(*previous)
    so_far = inside.rowsBetween(Window.unboundedPreceding, 0)
    before = _across_runs(keys).rowsBetween(Window.unboundedPreceding, -1)
    local = [F.sum(c).over(so_far).alias("_local_" + c) for c in totals]
    summary = [F.sum(c).alias("_sum_" + c) for c in totals]
    offsets = [F.coalesce(F.sum("_sum_" + c).over(before), F.lit(0)).alias("_offset_" + c) for c in totals]
    columns = [(F.col("_local_" + c) + F.col("_offset_" + c)).alias(out) for c, out in totals.items()]
    if previous:
        local.append(F.lag(value).over(inside).alias("_before"))
        summary.append(F.max_by(value, F.struct(*order)).alias("_tail"))
        offsets.append(F.lag("_tail").over(_across_runs(keys)).alias("_carried"))
        columns.append(F.coalesce("_before", "_carried").alias(name))
    carried = runs.groupBy(*keys, RUN).agg(*summary).select(*keys, RUN, *offsets)
    joined = join_on(runs.select("*", *local), carried, [*keys, RUN], "left")
    return joined.select(*runs.columns, *columns)


def session_numbers(runs: DataFrame, keys, order, gap, name: str = "session") -> DataFrame:
    """Number the sessions of each key from 1; a step of more than ``gap`` in the first order column
    starts a new one.

    Inside a run sessions count from 0; a run's summary tells how many came before it and whether its
    first row starts one.
    """
    at, inside = order[0], _in_run(keys, order)
    step = F.col(at) - F.lag(at).over(inside)
    local = runs.withColumn("_new", F.when(step > gap, 1).otherwise(0).cast("long"))
    local = local.withColumn("_inner", F.sum("_new").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    summary = local.groupBy(*keys, RUN).agg(
        F.min(at).alias("_head"), F.max(at).alias("_tail"), F.max("_inner").alias("_inside")
    )
    across = _across_runs(keys)
    jump = F.col("_head") - F.lag("_tail").over(across)
    opened = summary.withColumn("_opens", F.when(jump <= gap, 0).otherwise(1).cast("long"))
    through = across.rowsBetween(Window.unboundedPreceding, 0)
    earlier = F.sum(F.col("_opens") + F.col("_inside")).over(through) - F.col("_inside")
    offsets = opened.select(*keys, RUN, earlier.alias("_earlier"))
    joined = join_on(local, offsets, [*keys, RUN])
    return joined.select(*runs.columns, (F.col("_earlier") + F.col("_inner")).alias(name))


def percentile_by_runs(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    unique: str,
    share: float,
    name: str = "percentile",
    runs: int | None = None,
) -> DataFrame:
    """Linearly interpolated quantile per key, with count, minimum, maximum and mean.

    Only the runs that hold one of the two ranks in question are sorted: at most two per key.
    """
    narrow = df.select(*keys, value, unique).filter(F.col(value).isNotNull())
    sorted_runs = ordered_runs(narrow, keys, [value, unique], runs)
    per_run = sorted_runs.groupBy(*keys, RUN).agg(
        F.count("*").alias("_rows"),
        F.min(value).alias("_min"),
        F.max(value).alias("_max"),
        F.sum(value).alias("_sum"),
    )
    whole = Window.partitionBy(*keys)
    before = _across_runs(keys).rowsBetween(Window.unboundedPreceding, -1)
    placed = per_run.select(
        *keys,
        RUN,
        "_rows",
        F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset"),
        F.sum("_rows").over(whole).alias("n"),
        F.min("_min").over(whole).alias("min_value"),
        F.max("_max").over(whole).alias("max_value"),
        (F.sum("_sum").over(whole) / F.sum("_rows").over(whole)).alias("mean_value"),
    )
    position = (F.col("n") - 1) * F.lit(float(share))
    ranked = placed.withColumn("_low", F.floor(position)).withColumn("_high", F.ceil(position))
    ranked = ranked.withColumn("_share", position - F.col("_low"))

    def inside(rank: str) -> Column:
        start = F.col("_offset")
        return (F.col(rank) >= start) & (F.col(rank) < start + F.col("_rows"))

    needed = ranked.filter(inside("_low") | inside("_high"))
    rows = join_on(sorted_runs, needed, [*keys, RUN])
    row_no = F.row_number().over(_in_run(keys, [value, unique])) - 1 + F.col("_offset")
    picked = rows.withColumn("_rank", row_no).filter(
        (F.col("_rank") == F.col("_low")) | (F.col("_rank") == F.col("_high"))
    )
    stats = ["n", "min_value", "max_value", "mean_value"]
    low = F.max(F.when(F.col("_rank") == F.col("_low"), F.col(value)))
    high = F.max(F.when(F.col("_rank") == F.col("_high"), F.col(value)))
    return picked.groupBy(*keys).agg(
        (low + (high - low) * F.max("_share")).alias(name),
        *[F.max(c).alias(c) for c in stats],
    )


def block_count(rows: int, rows_per_block: int) -> int:
    return max(1, math.ceil(rows / rows_per_block))
