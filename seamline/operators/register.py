"""Turning captures, verdicts and identity results into inspection records."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from seamline import schema as S
from seamline.functions.scores import percent
from seamline.functions.text import inspection_code, station_image_path

STATION, AUTOMATIC, FORM = "station", "automatic", "form"


IDENTITY = {
    "identified": "identity_identified",
    "model_name": "model_name",
    "similarity": "identity_similarity",
    "threshold": "identity_threshold",
}


def register(
    captures: DataFrame,
    verdicts: DataFrame | None = None,
    identity: DataFrame | None = None,
    mode: str = AUTOMATIC,
    notes: str | None = None,
) -> DataFrame:
    """One inspection row per capture that has an image.

    ``captures``: image_id, captured_at and optionally ``image_original``, ``has_image``;
    ``verdicts``: what ``verdict_from_boxes`` or ``heuristic_verdict`` return, or None when captures
    already carry those columns; ``identity``: image_id, identified, model_name, similarity, threshold,
    or None when captures carry them — used in station mode only, where an unidentified garment goes to
    review whatever the detector said.
    """
    joined = captures.filter("has_image") if "has_image" in captures.columns else captures
    if verdicts is not None:
        joined = joined.join(verdicts, "image_id", "left")
    if mode == STATION:
        if identity is not None:
            joined = joined.join(identity.select("image_id", *IDENTITY), "image_id", "left")
        elif not set(IDENTITY) <= set(captures.columns):
            raise ValueError("station mode needs identity results")
        joined = joined.withColumnsRenamed(IDENTITY)
        known = F.coalesce("identity_identified", F.lit(False))
    else:
        kinds = {"identity_identified": "boolean", "identity_similarity": "double", "identity_threshold": "double"}
        joined = joined.withColumns({name: F.lit(None).cast(kind) for name, kind in kinds.items()})
        known = F.lit(True)
    garment = F.coalesce("model_name", F.lit(S.INSPECTED_GARMENT)) if mode == STATION else F.lit(S.INSPECTED_GARMENT)
    original = (
        F.col("image_original")
        if "image_original" in captures.columns
        else station_image_path(F.col("captured_at"), F.col("image_id"))
    )
    # a failed reading of the image gives a verdict but no result picture
    drawn = known & (F.col("defect_type") != S.INVALID_IMAGE)
    note = notes or (S.STATION_NOTES if mode != AUTOMATIC else S.AUTO_NOTES)

    def unless_unknown(column, value):
        return F.when(known, F.col(column)).otherwise(value)

    return joined.select(
        (F.col("image_id") + 1).alias("id"),
        inspection_code(F.col("captured_at"), F.col("image_id")).alias("code"),
        F.date_trunc("second", F.col("captured_at")).cast("timestamp_ntz").alias("created_at"),
        F.when(known, garment).otherwise(S.UNIDENTIFIED).alias("garment_type"),
        F.lit(S.DEFAULT_SIZE).alias("size"),
        unless_unknown("status", S.REVIEW).alias("status"),
        unless_unknown("defect_type", S.UNIDENTIFIED).alias("defect_type"),
        unless_unknown("confidence", percent(F.col("identity_similarity")))
        .cast("decimal(5,2)")
        .alias("confidence"),
        unless_unknown("zone", S.ZONE_NOT_APPLICABLE).alias("zone"),
        original.alias("image_original"),
        F.when(drawn, F.concat(F.lit("results/result_"), F.col("image_id"), F.lit(".jpg"))).alias("image_result"),
        F.lit(S.PENDING).alias("human_validation"),
        F.lit(note).alias("notes"),
        unless_unknown("confidence_kind", "similarity").alias("confidence_kind"),
        "identity_identified",
        F.round("identity_similarity", 4).alias("identity_similarity"),
        F.round("identity_threshold", 4).alias("identity_threshold"),
    )


def with_defaults(rows: DataFrame) -> DataFrame:
    """Rows in the full record schema, missing columns and values filled with the table defaults."""
    defaults = {
        "garment_type": F.lit(S.INSPECTED_GARMENT),
        "size": F.lit(S.DEFAULT_SIZE),
        "human_validation": F.lit(S.PENDING),
        "created_record_at": F.localtimestamp(),
    }
    columns = []
    for field in S.INSPECTIONS.fields:
        value = F.col(field.name) if field.name in rows.columns else F.lit(None)
        if field.name in defaults:
            value = F.coalesce(value, defaults[field.name])
        columns.append(value.cast(field.dataType).alias(field.name))
    return rows.select(*columns)
