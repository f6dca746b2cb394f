"""Anomaly maps to ranked regions and the localisation report."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from seamline.functions import raster
from seamline.functions.scores import (
    IMAGE_THRESHOLD,
    REGION_FLOOR,
    REGION_MAX_SHARE,
    REGION_PERCENTILE,
    dynamic_threshold,
    ranking_score,
)
from seamline.operators.anomaly import score_gate
from seamline.operators.quantiles import exact_percentile
from seamline.session import bound_batches

# --- fixed values -----------------------------------------------------------------------------
MIN_AREA, MAX_REGIONS = 20, 1
# --- end of fixed values ----------------------------------------------------------------------

PART = (
    "struct<component_no:int,x:int,y:int,width:int,height:int,area:int,mean_score:double,"
    "max_score:double,median_edge_distance:double,runs:array<int>>"
)


def pixel_thresholds(pixels: DataFrame, unique: str, percentile: float = REGION_PERCENTILE) -> DataFrame:
    """Local threshold of each image from one row per pixel (image_id, v, in_mask); exact."""
    masked = pixels.filter("in_mask")
    stats = exact_percentile(masked, ["image_id"], "v", unique, percentile / 100)
    images = pixels.select("image_id").distinct()
    joined = images.join(stats, "image_id", "left")
    threshold = dynamic_threshold(F.col("percentile"), F.col("max_value"))
    return joined.select("image_id", F.coalesce("n", F.lit(0)).alias("pixels"), threshold.alias("threshold"))


def region_stats(pixels: DataFrame, unique: str) -> DataFrame:
    """Figures of each component from one row per pixel (image_id, component, v, edge_distance)."""
    key = ["image_id", "component"]
    median = exact_percentile(pixels, key, "edge_distance", unique, 0.5, "median_edge_distance")
    scores = pixels.groupBy(*key).agg(
        F.count("*").alias("pixels"), F.avg("v").alias("mean_score"), F.max("v").alias("max_score")
    )
    joined = scores.join(median.select(*key, "median_edge_distance"), key)
    ranking = ranking_score(F.col("max_score"), F.col("mean_score"), F.col("median_edge_distance"))
    return joined.withColumn("ranking_score", ranking)


def find_parts(values: np.ndarray, mask: np.ndarray, threshold: float, min_area: int) -> list[tuple]:
    """Candidate regions of one map at or above ``threshold``, numbered in raster order."""
    candidate = (values >= threshold) & mask
    ys, xs = np.nonzero(candidate)
    if not len(ys):
        return []
    # the few candidates with a rim that stays empty: the rest of the map changes nothing
    top, left = max(0, ys.min() - 3), max(0, xs.min() - 3)
    window = candidate[top : ys.max() + 4, left : xs.max() + 4]
    labels, areas = raster.outlines(raster.closed(raster.opened(window, 3), 3))
    gaps = raster.column_gaps(mask) if len(areas) else None
    parts = []
    for number, polygon in enumerate(areas, start=1):
        area = round(float(polygon))
        if area < min_area:
            continue
        ys, xs = np.nonzero(labels == number)
        ys, xs = ys + top, xs + left
        scores = values[ys, xs]
        edges = np.flatnonzero(np.r_[True, (np.diff(ys) != 0) | (np.diff(xs) != 1)])
        lengths = np.diff(np.r_[edges, len(ys)])
        runs = np.stack([ys[edges], xs[edges], lengths], axis=1).ravel()
        box = (xs.min(), ys.min(), xs.max() - xs.min() + 1, ys.max() - ys.min() + 1)
        edge = float(np.median(raster.edge_distance(gaps, ys, xs)))
        stats = (float(scores.mean(dtype=np.float64)), float(scores.max()), edge)
        parts.append((number, *map(int, box), area, *stats, runs.tolist()))
    return parts


def region_candidates(
    maps: DataFrame,
    masks: DataFrame | None = None,
    min_area: int = MIN_AREA,
    percentile: float = REGION_PERCENTILE,
    floor: float = REGION_FLOOR,
    keep: list[str] = (),
) -> DataFrame:
    """Threshold and candidate regions of each anomaly map: image_id, kept columns, threshold, parts.

    ``maps``: image_id, height, width, map; a null map gives threshold 0 and no parts. ``masks``:
    image_id, mask_height, mask_width and packed bits, as ``garment_masks`` gives them; the map is
    resized to its mask. Without a mask the whole map counts. Only packed masks and maps are joined,
    never pictures.
    """
    if masks is not None:
        joined = maps.join(masks.select("image_id", "mask_height", "mask_width", "mask"), "image_id", "left")
    else:
        empty = F.lit(None)
        joined = maps.withColumns(
            {"mask_height": empty.cast("int"), "mask_width": empty.cast("int"), "mask": empty.cast("binary")}
        )
    bound_batches(maps.sparkSession)
    kept = ["image_id", *keep]
    kept_schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in maps.select(*kept).schema)

    def one(row) -> tuple:
        if row.map is None:
            return 0.0, []
        values = np.asarray(row.map, np.float32).reshape(int(row.height), int(row.width))
        if row.mask is None:
            mask = np.ones(values.shape, bool)
        else:
            shape = (int(row.mask_height), int(row.mask_width))
            bits = np.unpackbits(np.frombuffer(row.mask, np.uint8), count=shape[0] * shape[1])
            mask = bits.astype(bool).reshape(shape)
            if values.shape != shape:
                values = raster.resize(values.astype(np.float64), *shape, "linear").astype(np.float32)
        inside = values[mask]
        if not len(inside):
            return floor, []
        threshold = max(floor, float(np.percentile(inside, percentile)), float(inside.max()) * REGION_MAX_SHARE)
        return threshold, find_parts(values, mask, threshold, min_area)

    def scan(batches):
        for batch in batches:
            found = [one(row) for row in batch.itertuples(index=False)]
            done = pd.DataFrame(found, columns=["threshold", "parts"], index=batch.index)
            yield pd.concat([batch[kept], done], axis=1)

    columns = [*kept, "height", "width", "map", "mask_height", "mask_width", "mask"]
    schema = f"{kept_schema}, threshold double, parts array<{PART}>"
    return joined.select(*columns).mapInPandas(scan, schema)


def _scored(part: Column) -> Column:
    """Region with its ranking score, every figure rounded as reported."""
    ranking = ranking_score(part["max_score"], part["mean_score"], part["median_edge_distance"])
    whole = [part[c].alias(c) for c in ("x", "y", "width", "height", "area")]
    return F.struct(
        (-F.round(ranking, 6)).alias("order"),
        part["component_no"].alias("component_no"),
        *whole,
        F.round(part["mean_score"], 6).alias("mean_score"),
        F.round(part["max_score"], 6).alias("max_score"),
        F.round(part["median_edge_distance"], 2).alias("median_edge_distance"),
        F.round(ranking, 6).alias("ranking_score"),
        part["runs"].alias("runs"),
    )


def localize(
    predictions: DataFrame,
    masks: DataFrame | None = None,
    min_area: int = MIN_AREA,
    max_regions: int = MAX_REGIONS,
    percentile: float = REGION_PERCENTILE,
    floor: float = REGION_FLOOR,
    image_threshold: float = IMAGE_THRESHOLD,
) -> DataFrame:
    """Score gate, then the ``max_regions`` strongest regions of each anomalous image.

    ``predictions``: image_id, height, width, map, pred_score (array). Images below the gate keep a
    row without regions; their maps are not even sent to Python. Ranking uses the rounded score; ties keep the order in
    which the regions appear.
    """
    gated = score_gate(predictions, image_threshold)
    gated = gated.withColumn("map", F.when(F.col("has_anomaly"), F.col("map")))
    keep = ["pred_score", "has_anomaly"]
    found = region_candidates(gated, masks, min_area, percentile, floor, keep)
    ranked = F.array_sort(F.transform("parts", _scored))
    return found.select("image_id", *keep, "threshold", F.slice(ranked, 1, max_regions).alias("regions"))


def report(localised: DataFrame, image: Column | None = None) -> DataFrame:
    """Report rows; working fields of a region (order, number, pixel runs) are left out."""
    public = F.transform("regions", lambda r: r.dropFields("order", "component_no", "runs"))
    name = image if image is not None else F.col("image_id").cast("string")
    return localised.select(
        name.alias("image"),
        F.round("pred_score", 6).alias("pred_score"),
        "has_anomaly",
        F.round("threshold", 6).alias("threshold_used"),
        F.size("regions").alias("region_count"),
        public.alias("regions"),
        F.concat(name, F.lit("_resultado.png")).alias("result_path"),
        F.concat(name, F.lit("_mascara.png")).alias("mask_path"),
    )


def region_rows(localised: DataFrame) -> DataFrame:
    return localised.select("image_id", F.inline("regions")).drop("order", "runs")


def filtered_mask(localised: DataFrame) -> DataFrame:
    """The mask of the kept regions as runs of pixels: image_id, y, x, length. An image without regions has no row."""
    flat = localised.select("image_id", F.explode("regions").alias("region")).select("image_id", F.col("region.runs").alias("runs"))
    places = F.filter(F.sequence(F.lit(0), F.size("runs") - 1), lambda k: k % 3 == 0)
    triples = F.transform(places, lambda k: F.struct(*[F.get("runs", k + i).alias(n) for i, n in enumerate(("y", "x", "length"))]))
    return flat.where(F.size("runs") > 0).select("image_id", F.inline(triples))


def mask_runs(masks: DataFrame) -> DataFrame:
    """Packed masks (image_id, mask_height, mask_width, mask) as runs of set pixels: image_id, y, x, length."""
    kind = dict(masks.dtypes)["image_id"]

    def scan(batches):
        for batch in batches:
            found = [np.zeros((0, 4), np.int64)]
            for number, row in enumerate(batch.itertuples(index=False)):
                if row.mask is None:
                    continue
                height, width = int(row.mask_height), int(row.mask_width)
                bits = np.unpackbits(np.frombuffer(row.mask, np.uint8), count=height * width).reshape(height, width)
                step = np.diff(np.pad(bits, ((0, 0), (1, 1))).astype(np.int8), axis=1)
                (ys, starts), (_, ends) = np.nonzero(step == 1), np.nonzero(step == -1)
                found.append(np.stack([np.full(len(ys), number), ys, starts, ends - starts], axis=1))
            runs = np.concatenate(found)
            ids = batch["image_id"].to_numpy()[runs[:, 0]]
            yield pd.DataFrame({"image_id": ids, "y": runs[:, 1], "x": runs[:, 2], "length": runs[:, 3]})

    bound_batches(masks.sparkSession)
    return masks.select("image_id", "mask_height", "mask_width", "mask").mapInPandas(scan, f"image_id {kind}, y int, x int, length int")


def overlapping_runs(runs: DataFrame, others: DataFrame) -> DataFrame:
    """What two masks share, as runs: image_id, y, x, length. Runs meet by image and row, at most width / 2 of each."""
    other = others.select("image_id", "y", F.col("x").alias("_x"), F.col("length").alias("_length"))
    start, end = F.greatest("x", "_x"), F.least(F.col("x") + F.col("length"), F.col("_x") + F.col("_length"))
    met = runs.select("image_id", "y", "x", "length").join(other, ["image_id", "y"]).where(start < end)
    return met.select("image_id", "y", start.alias("x"), (end - start).alias("length"))


def top_regions(regions: DataFrame, max_regions: int = MAX_REGIONS) -> DataFrame:
    """Strongest regions per image from one row per region.

    A ranking window with a limit: each task drops all but its own best before the shuffle.
    """
    ranking = ranking_score(F.col("max_score"), F.col("mean_score"), F.col("median_edge_distance"))
    scored = regions.withColumn("ranking_score", F.round(ranking, 6))
    order = Window.partitionBy("image_id").orderBy(F.desc("ranking_score"), "component_no")
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= max_regions)
