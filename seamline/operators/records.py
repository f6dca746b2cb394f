"""Search, figures and human validation over inspection records."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, functions as F

from seamline import schema as S
from seamline.functions.text import display_code, folded, folded_text, strip

CASE_AND_ACCENT_BLIND = "UNICODE_CI_AI"
CASE_BLIND = "UTF8_LCASE"
SEARCHED = ("code", "defect_type", "zone")


def latest(records: DataFrame, n: int) -> DataFrame:
    """The ``n`` newest records by id."""
    return records.orderBy(F.desc("id")).limit(n)


def alerts(records: DataFrame, n: int | None = None) -> DataFrame:
    """Records that call for attention, newest ``n`` when given."""
    found = records.filter(F.col("status").isin(S.ALERT_STATUSES))
    return found if n is None else latest(found, n)


def search(
    records: DataFrame,
    q: str = "",
    status: str = "",
    garment_type: str = "",
    limit: int | None = 200,
    collation: str | None = None,
    wildcards: bool = False,
) -> DataFrame:
    """Records matching every given criterion; blank criteria do not restrict.

    ``q`` is looked for in code, defect and zone. ``collation`` compares text under a Spark collation
    (case- or accent-blind); ``wildcards`` reads ``%`` and ``_`` in ``q`` as in LIKE.
    """

    def collated(name: str) -> Column:
        return F.collate(F.col(name), collation) if collation else F.col(name)

    def holds(name: str, text: str) -> Column:
        if not wildcards:
            return F.contains(collated(name), F.lit(text))
        if collation == CASE_AND_ACCENT_BLIND:
            return folded(F.col(name)).like(f"%{folded_text(text)}%")
        return collated(name).like(f"%{text}%")

    q, status, garment_type = q.strip(), status.strip(), garment_type.strip()
    conditions = []
    if q:
        conditions.append(reduce(or_, [holds(name, q) for name in SEARCHED]))
    if status:
        conditions.append(collated("status") == status)
    if garment_type:
        conditions.append(collated("garment_type") == garment_type)
    found = records.filter(reduce(and_, conditions)) if conditions else records
    return found if limit is None else latest(found, limit)


def kpis(records: DataFrame) -> DataFrame:
    """All headline counts in one pass: by status and still pending validation."""

    def having(name: str, value: str) -> Column:
        return F.count_if(F.col(name) == value)

    return records.agg(
        F.count("*").alias("total"),
        having("status", S.DEFECT).alias("defects"),
        having("status", S.APPROVED).alias("approved"),
        having("status", S.REVIEW).alias("review"),
        having("human_validation", S.PENDING).alias("pending"),
    )


def health(records: DataFrame, detection_mode: str) -> DataFrame:
    return records.agg(
        F.count("*").alias("inspections"), F.lit(detection_mode).alias("detection_mode")
    )


def by_garment(records: DataFrame, collation: str | None = None) -> DataFrame:
    """Records and defects per garment; under a collation, spellings that compare equal are one."""
    key = F.collate(F.col("garment_type"), collation) if collation else F.col("garment_type")
    grouped = records.groupBy(key.alias("garment_type")).agg(
        F.count("*").alias("total"), F.count_if(F.col("status") == S.DEFECT).alias("defects")
    )
    return grouped.orderBy("garment_type")


def by_defect(records: DataFrame) -> DataFrame:
    """Records per defect, most frequent first; a missing defect is a group of its own."""
    grouped = records.groupBy("defect_type").agg(F.count("*").alias("total"))
    return grouped.orderBy(F.desc("total"), F.asc("defect_type"))


def _cell(status: str, validation: str) -> Column:
    return F.count_if((F.col("status") == status) & (F.col("human_validation") == validation))


def confusion(records: DataFrame, *keys: str) -> DataFrame:
    """System verdict against human validation, with derived rates (null where undefined)."""
    undecided = F.col("human_validation") == S.PENDING
    cells = [
        _cell(S.DEFECT, S.CORRECT).alias("vp"),
        _cell(S.DEFECT, S.INCORRECT).alias("fp"),
        _cell(S.APPROVED, S.CORRECT).alias("vn"),
        _cell(S.APPROVED, S.INCORRECT).alias("fn"),
        F.count_if((F.col("status") == S.REVIEW) & ~undecided).alias("review"),
        F.count_if(undecided).alias("pending"),
    ]
    counted = records.groupBy(*keys).agg(*cells) if keys else records.agg(*cells)

    def rate(part: Column, whole: Column) -> Column:
        return F.round(F.try_divide(part, whole), 4)

    vp, fp, vn, fn = (F.col(c) for c in ("vp", "fp", "vn", "fn"))
    return counted.select(
        "*",
        rate(vp, vp + fp).alias("precision"),
        rate(vp, vp + fn).alias("recall"),
        rate(vp + vn, vp + fp + vn + fn).alias("accuracy"),
    )


def latest_validations(events: DataFrame, order: list[str]) -> DataFrame:
    """Last validation per inspection; values outside the vocabulary count as pending.

    ``max_by`` combines on the map side, so an inspection with very many events costs nothing extra.
    """
    known = F.when(F.col("value").isin(S.VALIDATIONS), F.col("value")).otherwise(S.PENDING)
    newest = F.max_by(known, F.struct(*order))
    return events.groupBy("inspection_id").agg(newest.alias("validation"))


def apply_validations(records: DataFrame, events: DataFrame, order: list[str]) -> DataFrame:
    """Overlay validation events; events without a record change nothing."""
    newest = latest_validations(events, order)
    joined = records.join(newest, records["id"] == newest["inspection_id"], "left")
    overlaid = F.coalesce("validation", "human_validation")
    return joined.withColumn("human_validation", overlaid).drop("inspection_id", "validation")


def code_collisions(records: DataFrame) -> DataFrame:
    """Codes used more than once: they carry a time of day but no date."""
    grouped = records.groupBy("code").agg(
        F.count("*").alias("uses"), F.min("id").alias("first_id"), F.max("id").alias("last_id")
    )
    return grouped.filter(F.col("uses") > 1)


def garment_vocabulary_gap(records: DataFrame, vocabulary: list[str] | None = None) -> DataFrame:
    """Recorded garments the search form does not offer, with how many records they hide."""
    grouped = records.groupBy("garment_type").agg(F.count("*").alias("records"))
    return grouped.filter(~F.col("garment_type").isin(vocabulary or S.GARMENT_FILTERS))


def vocabulary_violations(records: DataFrame) -> DataFrame:
    """Values outside the closed vocabularies, one row per field and value."""
    closed = {"status": S.STATUSES, "zone": S.ZONES, "human_validation": S.VALIDATIONS}
    fields = F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(name).alias("field"),
                    F.col(name).alias("value"),
                    F.col(name).isin(words).alias("known"),
                )
                for name, words in closed.items()
            ]
        )
    )
    return (
        records.select(fields.alias("f"))
        .filter(~F.col("f.known"))
        .groupBy("f.field", "f.value")
        .agg(F.count("*").alias("records"))
    )


def as_json(records: DataFrame) -> DataFrame:
    """Each record as one JSON document: decimals as numbers, times to the second."""
    columns = [
        F.col(f.name).cast("double").alias(f.name)
        if f.dataType.typeName() == "decimal"
        else F.col(f.name)
        for f in records.schema.fields
    ]
    options = {
        "timestampNTZFormat": "yyyy-MM-dd HH:mm:ss",
        "timestampFormat": "yyyy-MM-dd HH:mm:ss",
        "ignoreNullFields": "false",
    }
    return records.select("id", F.to_json(F.struct(*columns), options).alias("json"))


def for_display(records: DataFrame) -> DataFrame:
    """Short code, lower-case status and text for missing values, as list pages show them."""
    confidence = F.concat(F.col("confidence").cast("string"), F.lit("%"))
    return records.select(
        "id",
        display_code(F.col("code")).alias("short_code"),
        F.lower(strip(F.col("status"))).alias("status_class"),
        F.coalesce(F.col("defect_type"), F.lit(S.DEFAULT_SIZE)).alias("defect_type"),
        F.coalesce(F.col("zone"), F.lit(S.DEFAULT_SIZE)).alias("zone"),
        F.coalesce(confidence, F.lit(S.DEFAULT_SIZE)).alias("confidence"),
    )
