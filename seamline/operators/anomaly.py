"""Memory-bank anomaly scores: bank reduction, patch distances, image scores and maps."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from seamline.functions.hashing import hash_bucket
from seamline.functions.scores import IMAGE_THRESHOLD, first_score, has_anomaly
from seamline.functions.vectors import euclidean
from seamline.operators.nearest import EUCLIDEAN, nearest
from seamline.operators.ordered import block_count
from seamline.operators.pivots import MOST_PIVOTS, farthest_order, farthest_points, pivot_cells
from seamline.operators.quantiles import values_at_ranks
from seamline.session import cut_lineage, spread

# --- fixed values -----------------------------------------------------------------------------
BANK_RATIO = 0.10
BANK_NEIGHBOURS = 9
# --- end of fixed values ----------------------------------------------------------------------
CORESET_ROWS = 4096


def coreset(
    bank: DataFrame, ratio: float = BANK_RATIO, seed: int = 42, block_rows: int = CORESET_ROWS
) -> DataFrame:
    """A ``ratio`` of the bank that covers it well (farthest-point selection).

    The selection is sequential, so it runs inside hash blocks of about ``block_rows``; small banks are one
    block. Each block is covered by its own selection, so the bank is covered within the largest of the
    blocks' radii, and no task holds more than a block. The block of an item is the hash bucket (``hash_bucket``) of
    ``<seed>:<item_id>``; it starts with its smallest id, and the smaller id wins among equally far ones. Each block gives its rounded share, one row at least.
    """
    blocks = block_count(bank.count(), block_rows)

    def pick(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("item_id", ignore_index=True)
        wanted = min(len(rows), max(1, round(ratio * len(rows))))
        vectors = np.stack(rows["embedding"].to_numpy()).astype(np.float64)
        return rows.iloc[np.sort(farthest_points(vectors, wanted)[0])][["item_id", "embedding"]]

    block = hash_bucket(F.concat_ws(":", F.lit(seed), F.col("item_id").cast("string")), blocks).alias("block")
    grouped = spread(bank.select("item_id", "embedding", block), "block").groupBy("block")
    return grouped.applyInPandas(pick, "item_id long, embedding array<float>")


def coreset_union(
    bank: DataFrame, ratio: float = BANK_RATIO, seed: int = 42, block_rows: int = CORESET_ROWS, ahead: float = 2.0
) -> DataFrame:
    """(item_id, embedding, gap): a ``ratio`` of the bank that covers it, chosen again from what blocks have chosen.

    Hash blocks first pick ``ahead`` times their share, each by farthest points. What they picked is dealt out by
    nearest pivot, so that points that are near each other meet again whichever block they came from; a cell too
    large for a task is cut by hash. Every cell orders its points by farthest points too, and a point's ``gap`` is how
    far the ones before it left it. The first points of the cells and the largest gaps of all cells are chosen: every
    cell stops at one radius, however unevenly the bank lies. The bank is covered within the largest radius of a
    block plus the largest gap left out; ``cover_radius`` gives the exact figure.

    Equal gaps at the end are all taken; points on top of a chosen one are not. An empty bank gives an empty result.
    """
    kinds = "item_id long, embedding array<float>"
    wanted = max(1, round(ratio * bank.count()))
    first = coreset(bank, min(1.0, ahead * ratio), seed, block_rows)
    # of equal vectors one is enough
    first = cut_lineage(first.groupBy("embedding").agg(F.min("item_id").alias("item_id")).select("item_id", "embedding"))
    chosen = first.count()
    if not chosen:
        return first.withColumn("gap", F.lit(0.0))
    cells = pivot_cells(first, min(MOST_PIVOTS, block_count(4 * chosen, block_rows)))
    sizes = cells.groupBy("pivot").agg(F.ceil(F.count("*") / block_rows).cast("int").alias("slices"))
    sliced = cells.join(sizes, "pivot").withColumn("slice", F.pmod(F.xxhash64("item_id", F.lit(seed)), F.col("slices")))

    def ordered(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("item_id", ignore_index=True)
        order, gaps = farthest_order(np.stack(rows["embedding"].to_numpy()).astype(np.float64))
        return rows.iloc[order][["item_id", "embedding"]].assign(gap=gaps, first=np.arange(len(order)) == 0)

    grouped = spread(sliced.select("item_id", "embedding", "pivot", "slice"), "pivot", "slice").groupBy("pivot", "slice")
    gaps = cut_lineage(grouped.applyInPandas(ordered, f"{kinds}, gap double, first boolean"))
    others = gaps.where("NOT first AND gap > 0")
    count = others.count()
    left = min(count, wanted - gaps.where("first").count())
    if left <= 0:
        return gaps.where("first").drop("first")
    least = _nth_largest(others, "gap", count, left)
    return gaps.where(F.col("first") | (F.col("gap") >= least)).where("first OR gap > 0").drop("first")


def _nth_largest(rows: DataFrame, value: str, count: int, n: int) -> float:
    """The ``n``-th largest of ``count`` values, without sorting them."""
    known = rows.withColumn("every", F.lit(1))
    ends = known.groupBy("every").agg(F.min(value).alias("low"), F.max(value).alias("high"))
    ranges = ends.select("every", F.lit(0).alias("which"), F.lit(count - n).cast("long").alias("rank"), "low", "high")
    return values_at_ranks(known, ["every"], value, ranges).first()["value"]


def least_cover_radius(bank: DataFrame, size: int, **blocking) -> float:
    """What no choice of ``size`` bank items can cover the bank more closely than.

    An item that is not chosen is no nearer to a chosen one than to its nearest neighbour, and of the ``size + 1``
    items with the farthest neighbours one is not chosen. Equal vectors count once; 0 if all others can be chosen.
    """
    points = cut_lineage(bank.groupBy("embedding").agg(F.min("item_id").alias("item_id")).select("item_id", "embedding"))
    count = points.count()
    if count <= max(size, 1):
        return 0.0
    gaps = patch_distances(points.withColumnRenamed("item_id", "patch_id"), points, skip_self=True, **blocking)
    return _nth_largest(cut_lineage(gaps.select("distance")), "distance", count, size + 1)


def covers_within(bank: DataFrame, chosen: DataFrame, factor: float, ratio: float = BANK_RATIO, **blocking) -> bool:
    """Whether ``chosen`` covers the bank within ``factor`` times the radius of a ``coreset`` picked in one block.

    That pick is one task with the whole bank, and quadratic. It is made only if the bound on every choice of that size
    leaves the answer open.
    """
    radius, wanted = cover_radius(bank, chosen, **blocking), max(1, round(ratio * bank.count()))
    if radius is None or radius <= factor * least_cover_radius(bank, wanted, **blocking):
        return True
    return radius <= factor * cover_radius(bank, coreset(bank, ratio, block_rows=1 << 62), **blocking)


def cover_radius(bank: DataFrame, chosen: DataFrame, **blocking) -> float | None:
    """The largest distance of a bank item to the nearest chosen one; null for an empty bank."""
    patches = bank.select(F.col("item_id").alias("patch_id"), "embedding")
    return patch_distances(patches, chosen.select("item_id", "embedding"), **blocking).agg(F.max("distance")).first()[0]


def patch_distances(patches: DataFrame, bank: DataFrame, skip_self: bool = False, **blocking) -> DataFrame:
    """Distance of each patch (patch_id, embedding) to its nearest bank item."""
    queries = patches.select(F.col("patch_id").alias("query_id"), "embedding")
    found = nearest(queries, bank, 1, EUCLIDEAN, skip_self=skip_self, **blocking)
    return found.select(F.col("query_id").alias("patch_id"), "item_id", F.col("score").alias("distance"))


def image_scores(
    patches: DataFrame,
    bank: DataFrame,
    neighbours: int = BANK_NEIGHBOURS,
    skip_self: bool = False,
    **blocking,
) -> DataFrame:
    """Score of each image: its most distant patch, re-weighted by how crowded the bank is there.

    weight = 1 - exp(d) / sum(exp(distances to the bank items around the matched one)), over the
    ``neighbours`` items nearest to the matched item, itself included. ``patches``: image_id,
    patch_id, embedding.
    """
    distances = patch_distances(patches, bank, skip_self, **blocking)
    located = distances.join(patches.select("patch_id", "image_id"), "patch_id")
    farthest = F.max_by(
        F.struct("patch_id", "item_id", "distance"), F.struct(F.col("distance"), -F.col("patch_id"))
    )
    # written out, as the second search and the join after it would each make the first search again
    worst = cut_lineage(located.groupBy("image_id").agg(farthest.alias("w")).select("image_id", "w.*"))
    matched = worst.select(F.col("item_id").alias("query_id")).distinct()
    anchors = matched.join(
        bank.select(F.col("item_id").alias("query_id"), "embedding"), "query_id"
    )
    around = nearest(anchors, bank, neighbours, EUCLIDEAN, **blocking)
    around = around.select(F.col("query_id").alias("item_id"), F.col("item_id").alias("support_id"))
    pairs = (
        worst.join(around, "item_id")
        .join(patches.select("patch_id", F.col("embedding").alias("patch")), "patch_id")
        .join(bank.select(F.col("item_id").alias("support_id"), F.col("embedding").alias("support")), "support_id")
    )
    spread = pairs.withColumn("near", euclidean(F.col("patch"), F.col("support")))
    weighed = spread.groupBy("image_id").agg(
        F.max("patch_id").alias("patch_id"),
        F.max("distance").alias("distance"),
        F.sum(F.exp("near")).alias("total"),
    )
    weight = 1 - F.exp("distance") / F.col("total")
    return weighed.select(
        "image_id", "patch_id", "distance", (weight * F.col("distance")).alias("pred_score")
    )


def patch_maps(patches: DataFrame, distances: DataFrame, height: int, width: int) -> DataFrame:
    """Patch distances laid out as one ``height`` x ``width`` map per image.

    ``patches``: image_id, patch_no, patch_id. The grid bounds the array of an image, whatever the
    number of rows that share an image id; a cell given twice keeps the larger distance, and a cell that is
    not given is null. A patch outside the grid is an error.
    """
    cells = height * width
    wrong = F.concat(F.lit(f"patch outside the grid of {height} x {width}: "), F.col("patch_id").cast("string"))
    number = F.when(F.col("patch_no").between(0, cells - 1), F.col("patch_no")).otherwise(F.raise_error(wrong).cast(dict(patches.dtypes)["patch_no"]))
    placed = patches.withColumn("patch_no", number).join(distances, "patch_id")
    per_cell = placed.groupBy("image_id", "patch_no").agg(F.max("distance").alias("distance"))
    cell = F.struct("patch_no", "distance")
    listed = per_cell.groupBy("image_id").agg(F.map_from_entries(F.collect_list(cell)).alias("cells"))
    key = dict(patches.dtypes)["patch_no"]
    filled = F.transform(
        F.sequence(F.lit(0), F.lit(cells - 1)),
        lambda i: F.try_element_at("cells", i.cast(key)).cast("float"),
    )
    return listed.select(
        "image_id", F.lit(height).alias("height"), F.lit(width).alias("width"), filled.alias("map")
    )


def score_gate(predictions: DataFrame, threshold: float = IMAGE_THRESHOLD) -> DataFrame:
    """Scalar score and anomaly flag of each prediction; missing scores count as 0."""
    scored = predictions.withColumn("pred_score", first_score(F.col("pred_score")))
    return scored.withColumn("has_anomaly", has_anomaly(F.col("pred_score"), threshold))


def score_bounds(scores: DataFrame, score: str = "pred_score") -> DataFrame:
    """Smallest and largest score of a validation set, for ``normalised_score``."""
    return scores.agg(F.min(score).alias("low"), F.max(score).alias("high"))


