"""Image work: one row per image, pixels handled in Arrow batches, image bytes never shuffled."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from seamline import schema as S
from seamline.functions import raster
from seamline.functions.geometry import DEFAULT_ROI, roi_bounds, zone
from seamline.functions.scores import heuristic_confidence, heuristic_min_area
from seamline.functions.vectors import l2_normalise
from seamline.operators.ordered import RUN, ordered_runs
from seamline.session import bound_batches, cut_lineage

# --- fixed values -----------------------------------------------------------------------------
DARK, SATURATED = 65, 120
PIXEL_CHANGE, MOTION_PIXELS = 25, 18_000
CHANNEL_MEAN, CHANNEL_STD = [0.485, 0.456, 0.406], [0.229, 0.224, 0.225]
# --- end of fixed values ----------------------------------------------------------------------

PIXELS = ["height", "width", "nChannels", "data"]


def _per_image(df: DataFrame, keys: list[str], work, fields: str, extra: list[str] = ()) -> DataFrame:
    """Apply ``work(pixels, row) -> dict`` to each image; a failing image gives a row with ``error``."""
    bound_batches(df.sparkSession)
    columns = [*keys, *PIXELS, *extra]
    key_schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.select(*keys).schema)
    schema = f"{key_schema}, error string, {fields}"
    names = [part.split()[0] for part in fields.split(", ")]

    def one(row) -> dict:
        try:
            if row.height <= 0 or row.data is None:
                raise ValueError("image could not be read")
            return {"error": None, **work(raster.decode(row.data, row.height, row.width, row.nChannels), row)}
        except Exception as problem:  # whatever is wrong with one picture is that picture's result
            return {"error": str(problem) or type(problem).__name__, **dict.fromkeys(names)}

    def scan(batches):
        for batch in batches:
            # a few images at a time, so that results of a batch do not pile up
            for at in range(0, len(batch), 64):
                part = batch.iloc[at : at + 64].reset_index(drop=True)
                results = [one(row) for row in part.itertuples(index=False)]
                done = pd.DataFrame(results, columns=["error", *names], dtype=object)
                yield pd.concat([part[keys], done], axis=1)

    # nulls would turn whole columns of numbers into floats
    whole = {c: F.coalesce(c, F.lit(-1)) for c in ("height", "width", "nChannels")}
    return df.select(*columns).withColumns(whole).mapInPandas(scan, schema)


def prepare_images(
    images: DataFrame, keys: list[str], size: int = 512, background: int = raster.CANVAS_GRAY
) -> DataFrame:
    """Crop to the object, lay on the canvas colour and fit into a square.

    ``images``: the key columns and the fields of Spark's image struct, optionally ``orientation``.
    Results are BGR bytes again, with their mean level; failures keep their row, with ``status``
    ``failed``.
    """
    turned = "orientation" in images.columns

    def work(pixels, row):
        if turned:
            pixels = raster.upright(pixels, int(row.orientation))
        boxed = raster.boxed(pixels, size, background)
        bgr = np.empty_like(boxed)  # far faster than bytes of a reversed view
        for channel in range(3):
            bgr[:, :, channel] = boxed[:, :, 2 - channel]
        return {
            "height": size,
            "width": size,
            "nChannels": 3,
            "data": bgr.tobytes(),
            "mean_level": float(boxed.mean()),
        }

    source = images.withColumn("orientation", F.coalesce("orientation", F.lit(1))) if turned else images
    fields = "height int, width int, nChannels int, data binary, mean_level double"
    done = _per_image(source, keys, work, fields, ["orientation"] if turned else [])
    return done.withColumn("status", F.when(F.col("error").isNull(), "success").otherwise("failed"))


def preparation_summary(prepared: DataFrame) -> DataFrame:
    return prepared.groupBy("status").agg(F.count("*").alias("images"))


def garment_masks(images: DataFrame, background: int = raster.CANVAS_GRAY, tolerance: int = 8) -> DataFrame:
    """Garment mask of each image as packed bits: 1/24 of the image, small enough to be joined."""

    def work(pixels, row):
        mask = raster.garment_mask(pixels, background, tolerance)
        return {
            "mask_height": mask.shape[0],
            "mask_width": mask.shape[1],
            "pixels": int(mask.sum()),
            "mask": np.packbits(mask).tobytes(),
        }

    fields = "mask_height int, mask_width int, pixels long, mask binary"
    return _per_image(images, ["image_id"], work, fields)


ROI_COLUMNS = ["roi_x1", "roi_y1", "roi_x2", "roi_y2"]


def _with_roi(images: DataFrame, roi) -> DataFrame:
    """Bounds of the region of interest as plain columns, all 0 where it is empty."""
    bounds = roi_bounds(F.col("width"), F.col("height"), roi)
    return images.withColumns({c: F.coalesce(bounds[c[4:]], F.lit(0)) for c in ROI_COLUMNS})


def _inside(pixels: np.ndarray, row) -> np.ndarray:
    if row.roi_x2 <= row.roi_x1:
        raise ValueError("the region of interest is empty")
    return pixels[row.roi_y1 : row.roi_y2, row.roi_x1 : row.roi_x2, :3]


def heuristic_parts(images: DataFrame, roi=DEFAULT_ROI) -> DataFrame:
    """Largest dark or saturated part inside the region of interest: area and box, or null."""

    def work(pixels, row):
        inner = _inside(pixels, row)
        mask = (raster.gray(inner) <= DARK) | (raster.saturation(inner) >= SATURATED)
        mask = raster.dilate(raster.opened(raster.majority(mask, 5), 5), 5)
        labels, areas = raster.outlines(mask)
        found = dict.fromkeys(["x", "y", "w", "h", "area"])
        if len(areas):
            best = int(areas.argmax())
            ys, xs = np.nonzero(labels == best + 1)
            left, top = xs.min() + row.roi_x1, ys.min() + row.roi_y1
            box = (left, top, xs.max() - xs.min() + 1, ys.max() - ys.min() + 1)
            found = {**dict(zip("xywh", map(int, box))), "area": float(areas[best])}
        return {"img_w": row.width, "img_h": row.height, **found}

    fields = "img_w int, img_h int, x int, y int, w int, h int, area double"
    return _per_image(_with_roi(images, roi), ["image_id"], work, fields, ROI_COLUMNS)


def heuristic_verdict(images: DataFrame, roi=DEFAULT_ROI) -> DataFrame:
    """Verdict without a trained detector; always for review."""
    parts = heuristic_parts(images, roi)
    size = (F.col("img_w"), F.col("img_h"))
    found = F.coalesce(F.col("area") > heuristic_min_area(*size), F.lit(False))
    invalid = F.col("error").isNotNull()
    return parts.select(
        "image_id",
        F.lit(S.REVIEW).alias("status"),
        F.when(invalid, S.INVALID_IMAGE)
        .when(found, S.HEURISTIC_ANOMALY)
        .otherwise(S.HEURISTIC_CLEAR)
        .alias("defect_type"),
        F.when(found, heuristic_confidence(F.col("area"), *size)).otherwise(0.0).alias("confidence"),
        F.when(invalid, S.ZONE_UNDEFINED)
        .when(found, zone(F.col("x") + F.col("w") / 2, F.col("img_w")))
        .otherwise(S.ZONE_CENTER)
        .alias("zone"),
        F.when(found, "area").otherwise("none").alias("confidence_kind"),
    )


def frame_signals(frames: DataFrame, keys: list[str], roi=DEFAULT_ROI, blur: int = 21) -> DataFrame:
    """Blurred gray region of interest of each frame, the input of motion detection."""

    def work(pixels, row):
        return {"signal": raster.blur(raster.gray(_inside(pixels, row)), blur).tobytes()}

    return _per_image(_with_roi(frames, roi), keys, work, "signal binary", ROI_COLUMNS)


def changed_pixels(before: bytes | None, after: bytes, change: int = PIXEL_CHANGE) -> int:
    """Pixels of two signals that differ by more than ``change``."""
    a, b = np.frombuffer(before, np.uint8), np.frombuffer(after, np.uint8)
    if len(a) != len(b):
        raise ValueError("frames of different size")
    return int((np.abs(a.astype(np.int16) - b) > change).sum())


@F.pandas_udf(T.LongType())
def motion_pixels(before: pd.Series, after: pd.Series) -> pd.Series:
    """Changed pixels between two signals; null where there is none to compare with."""
    return pd.Series(
        [None if a is None or b is None else changed_pixels(a, b) for a, b in zip(before, after)],
        dtype="Int64",
    )


PLACE = "_place"


def _same(a, b) -> bool:
    """Whether two keys are one: nulls are, and numbers that are none."""
    return a == b or (a != a and b != b)


def _changes(station: str, kept: list[str]):
    """Frames of a run, in order, with their changed pixels; ``head`` and ``tail`` are the signals at its two ends."""

    def scan(batches):
        before, last, waiting = None, -1, None
        for batch in batches:
            if not batch.num_rows:
                continue
            places = batch.column(PLACE).to_numpy()
            if places[0] <= last or (np.diff(places) <= 0).any():
                raise ValueError("the frames of a run are no longer in order")
            last, changed, heads = places[-1], [], [None] * len(places)
            for at, (key, signal) in enumerate(zip(batch.column(station).to_pylist(), batch.column("signal").to_pylist())):
                if before is None:
                    heads[at] = signal
                follows = before is not None and _same(before[0], key)
                changed.append(changed_pixels(before[1], signal) if follows else None)
                before = key, signal
            if waiting:
                yield _with_tail(waiting, None)
            waiting = {name: batch.column(name) for name in kept}
            waiting |= {"changed_pixels": pa.array(changed, pa.int64()), "head": pa.array(heads, pa.binary())}
        if waiting:
            yield _with_tail(waiting, before[1])

    return scan


def _with_tail(columns: dict, tail: bytes | None) -> pa.RecordBatch:
    tails = [None] * (len(columns["head"]) - 1) + [tail]
    return pa.RecordBatch.from_pydict({**columns, "tail": pa.array(tails, pa.binary())})


def frame_motion(
    frames: DataFrame,
    station: str,
    ts_us: str,
    unique: str,
    roi=DEFAULT_ROI,
    runs: int | None = None,
    pixels: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Pixels changed since the frame before at the same station; null for a station's first frame.

    Unreadable frames are skipped. ``pixels`` adds the fields of Spark's image struct to frames that only say where
    their picture comes from; it must keep all columns and the order of the rows. The frames are then put in order as they are and each
    picture is made in its place, once; signals are written at the two ends of a run only. Without it the frames bring
    their pixels along: only the blurred regions are shuffled, and they are written out first, since range partitioning
    looks at its input twice, which must not repeat the pixel work.
    """
    keys = [station, ts_us, unique]

    def readable(images: DataFrame, names: list[str]) -> DataFrame:
        return frame_signals(images, names, roi).filter(F.col("error").isNull()).drop("error")

    rows = frames if pixels else cut_lineage(readable(frames, keys))
    ordered = ordered_runs(rows, [station], [ts_us, unique], runs).sortWithinPartitions(*keys)
    placed = ordered.withColumn(PLACE, F.monotonically_increasing_id())
    signals = readable(pixels(placed), [*keys, RUN, PLACE]) if pixels else placed
    kept = [f for f in signals.schema if f.name in (*keys, RUN)]
    ends = [T.StructField("changed_pixels", T.LongType()), T.StructField("head", T.BinaryType()), T.StructField("tail", T.BinaryType())]
    found = cut_lineage(signals.mapInArrow(_changes(station, [f.name for f in kept]), T.StructType([*kept, *ends])))
    # the frame before the first one of a run is the last one of the run before, if their station is the same
    heads = found.where("head IS NOT NULL").select(*keys, RUN, "head")
    before = heads.select(RUN, F.lag(RUN).over(Window.orderBy(RUN)).alias("_run_before"))
    tails = found.where("tail IS NOT NULL").select(F.col(RUN).alias("_run_before"), F.col(station).alias("_tail_of"), "tail")
    linked = heads.join(before, RUN).join(tails, "_run_before", "left")
    tail = F.when(F.col(station).eqNullSafe(F.col("_tail_of")), F.col("tail"))
    crossing = linked.select(*keys, motion_pixels(tail, F.col("head")).alias("changed_pixels"))
    return found.where("head IS NULL").select(*keys, "changed_pixels").unionByName(crossing)


def model_inputs(images: DataFrame, keys: list[str], side: int = 224) -> DataFrame:
    """Square, scaled, normalised channel-first tensors for an embedding model."""

    def work(pixels, row):
        scaled = raster.squared(pixels, side)
        tensor = (np.rint(scaled) / 255 - CHANNEL_MEAN) / CHANNEL_STD
        return {"tensor": np.moveaxis(tensor, 2, 0).astype(np.float32).ravel()}

    return _per_image(images, keys, work, "tensor array<float>")


def embed_images(
    images: DataFrame, keys: list[str], make_predict_fn, side: int = 224, batch_size: int = 8
) -> DataFrame:
    """Unit embeddings from a user's model; unreadable images are left out.

    ``make_predict_fn`` loads the model once per worker and returns a function from a batch
    [n, 3, side, side] to [n, d].
    """
    from pyspark.ml.functions import predict_batch_udf
    from pyspark.sql.types import ArrayType, FloatType

    predict = predict_batch_udf(
        make_predict_fn,
        return_type=ArrayType(FloatType()),
        batch_size=batch_size,
        input_tensor_shapes=[[3, side, side]],
    )
    tensors = model_inputs(images, keys, side).filter(F.col("error").isNull())
    scored = tensors.select(*keys, predict("tensor").alias("output"))
    return scored.select(*keys, l2_normalise(F.col("output")).alias("embedding"))
