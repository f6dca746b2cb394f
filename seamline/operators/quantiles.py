"""Exact quantiles by histograms that narrow down on the ranks in question.

A round counts the values of every open range in bins, and a range becomes the bin that holds its rank; it is closed
when all its values are one. Values stay where they are: what is shuffled is a count, a minimum and a maximum for
each bin, which combine before the shuffle. Three rounds narrow a range of a million values down to one; whatever
the values, no more than about twenty are needed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from seamline.operators.ordered import join_on, percentile_by_runs
from seamline.session import cut_lineage

#: Bins of a range at least, bins of all ranges together that are aimed at (few ranges have finer bins), and open
#: ranges that are broadcast at most (beyond that, values are sorted in runs).
BINS, ALL_BINS, MOST_RANGES = 256, 1 << 20, 50_000


def _half(name: str) -> Column:
    """Halved, so that differences stay finite."""
    return F.col(name) / 2


def _magnitude(name: str) -> Column:
    """The exponent with the sign of the number; it never falls where numbers rise."""
    return F.when(F.col(name) == 0, 0.0).otherwise(F.signum(name) * (F.log2(F.abs(F.col(name))) + 1100))


def values_at_ranks(values: DataFrame, keys: Sequence[str], value: str, ranges: DataFrame) -> DataFrame:
    """``ranges`` (keys, which, rank, low, high) with the exact ``value`` of each ``rank`` (from 0) among its key's values.

    ``low`` and ``high``: the least and largest value of the key. Values are finite numbers without nulls; ranges are
    at most MOST_RANGES, which the caller makes sure of. A null key is a key like any other.
    """
    own = [*keys, "which"]
    state = cut_lineage(ranges.withColumn("below", F.lit(0).cast("long")))
    done = state.where("low = high")
    narrow = values.select(*keys, F.col(value).cast("double").alias("_value"))
    magnitudes = False
    while True:
        state = state.where("low < high")
        left = state.count()
        if not left:
            return done.select(*own, F.col("low").alias("value"))
        inside = join_on(narrow, F.broadcast(state), keys).where("_value BETWEEN low AND high")
        bins = min(1 << 16, max(BINS, ALL_BINS // left))
        # every second round has bins by magnitude, which part values of very different sizes
        scale = _magnitude if magnitudes else _half
        share = F.try_divide(scale("_value") - scale("low"), scale("high") - scale("low"))
        inner = F.least(F.floor(F.coalesce(share, F.lit(0.0)) * bins), F.lit(bins - 1))
        binned = inside.withColumn("_bin", F.when(F.col("_value") == F.col("low"), -1).otherwise(inner))
        magnitudes = not magnitudes
        counts = binned.groupBy(*own, "rank", "below", "_bin").agg(
            F.count("*").alias("_times"), F.min("_value").alias("low"), F.max("_value").alias("high")
        )
        earlier = Window.partitionBy(*own).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
        placed = counts.withColumn("below", F.col("below") + F.coalesce(F.sum("_times").over(earlier), F.lit(0)))
        state = cut_lineage(placed.where("below <= rank AND rank < below + _times").drop("_times", "_bin").select(*state.columns))
        done = done.unionByName(state.where("low = high"))


def exact_percentile(
    df: DataFrame, keys: Sequence[str], value: str, unique: str, share: float, name: str = "percentile",
    runs: int | None = None, most_ranges: int = MOST_RANGES,
) -> DataFrame:
    """Linearly interpolated quantile per key, with count (n), minimum, maximum and mean. Nulls are left out.

    With more keys than ``most_ranges``, or values that are not finite, the values are sorted in runs instead
    (``unique`` breaks ties there): the same result, with a shuffle of all values.
    """
    narrow = cut_lineage(df.where(F.col(value).isNotNull()).select(*keys, value, unique))  # read once a round
    finite = F.abs(F.col(value)) < float("inf")
    stats = cut_lineage(
        narrow.groupBy(*keys).agg(
            F.count("*").alias("n"), F.min(value).alias("min_value"), F.max(value).alias("max_value"),
            (F.sum(value) / F.count("*")).alias("mean_value"), F.count_if(~finite).alias("_odd"),
        )
    )
    size = stats.agg(F.count("*").alias("keys"), F.sum("_odd").alias("odd")).first()
    if size["keys"] > most_ranges or size["odd"]:
        return percentile_by_runs(narrow, keys, value, unique, share, name, runs)
    position = (F.col("n") - 1) * F.lit(float(share))
    ends = [F.col("min_value").cast("double").alias("low"), F.col("max_value").cast("double").alias("high")]
    ranks = F.explode(F.array_distinct(F.array(F.floor(position), F.ceil(position)))).alias("rank")
    ranges = stats.select(*keys, ranks, *ends).withColumn("which", F.col("rank"))
    found = values_at_ranks(narrow, keys, value, ranges).groupBy(*keys).agg(F.min("value").alias("_low"), F.max("value").alias("_high"))
    joined = join_on(stats, found, keys)
    between = F.col("_low") + (F.col("_high") - F.col("_low")) * (position - F.floor(position))
    return joined.select(*keys, between.alias(name), "n", "min_value", "max_value", "mean_value")
