"""Label files: reading lines, checking them, matching them to images."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from seamline import schema as S
from seamline.functions.text import label_float, label_int, strip

FIELDS = ("x_center", "y_center", "width", "height")
KEY = ["split", "stem"]


def label_lines(files: DataFrame) -> DataFrame:
    """One row per line of every label file (split, stem, content), numbered from 1.

    Blank ends of a file are dropped first, blank lines inside it are kept; an empty file gives no
    rows.
    """
    body = strip(F.col("content"))
    lines = F.split(body, r"\r\n|\r|\n")
    numbered = files.filter(body != "").select("split", "stem", F.posexplode(lines).alias("pos", "line"))
    return numbered.select("split", "stem", (F.col("pos") + 1).alias("line_no"), "line")


def parse_lines(lines: DataFrame) -> DataFrame:
    """Typed columns of label lines; null where a token is missing or not a number."""
    # a column of its own, so that the line is split once and not once per token
    split = lines.withColumn("_tokens", F.split(strip(F.col("line")), r"\s+"))
    found = F.col("_tokens")
    blank = F.get(found, F.lit(0)) == ""
    fields = [label_float(F.get(found, F.lit(i))).alias(f) for i, f in enumerate(FIELDS, start=1)]
    return split.select(
        *lines.columns,
        F.when(blank, 0).otherwise(F.size(found)).alias("tokens"),
        label_int(F.get(found, F.lit(0))).alias("class_id"),
        *fields,
    )


def line_errors(lines: DataFrame, classes: list[int] | None = None) -> DataFrame:
    """Every rule a label line breaks: split, stem, line_no, rule, field.

    Token count and number format end the check of a line; the other rules are independent. One pass
    over the lines: the broken rules of a line are an array that is exploded.
    """
    classes = classes if classes is not None else sorted(S.CLASS_NAMES)
    parsed = parse_lines(lines)
    numeric = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in ("class_id", *FIELDS)])

    none = F.array().cast("array<struct<rule:string,field:string>>")

    def error(broken: Column, rule: str, field: str = "") -> Column:
        found = F.array(F.struct(F.lit(rule).alias("rule"), F.lit(field).alias("field")))
        return F.when(broken, found).otherwise(none)

    ranged = [
        error(~((F.col(f) >= 0) & (F.col(f) <= 1) & ~F.isnan(f)), "range", f) for f in FIELDS
    ]
    values = F.concat(
        error(~F.col("class_id").isin(classes), "class"),
        *ranged,
        error((F.col("width") <= 0) | (F.col("height") <= 0), "size"),
    )
    errors = (
        F.when(F.col("tokens") != 5, error(F.lit(True), "tokens"))
        .when(~numeric, error(F.lit(True), "numeric"))
        .otherwise(values)
    )
    exploded = parsed.select(*lines.columns, F.explode(errors).alias("e"))
    return exploded.select("split", "stem", "line_no", "e.rule", "e.field")


def missing_labels(images: DataFrame, files: DataFrame) -> DataFrame:
    """Images without a label file of the same split and stem."""
    return images.select(*KEY).join(files.select(*KEY).distinct(), KEY, "left_anti")


def orphan_labels(images: DataFrame, files: DataFrame) -> DataFrame:
    """Label files no image asks for."""
    return files.select(*KEY).distinct().join(images.select(*KEY).distinct(), KEY, "left_anti")


def split_summary(images: DataFrame, files: DataFrame) -> DataFrame:
    """Images per split, with and without defects; all three splits appear, even when empty.

    ``files`` has one row per label file with ``content``. Images without a label count in
    ``images`` only.
    """
    marked = F.max(strip(F.col("content")) != "").alias("marked")
    state = files.groupBy(*KEY).agg(marked)
    return summarise(images.select(*KEY).join(state, KEY, "left"))


def summarise(joined: DataFrame) -> DataFrame:
    """:func:`split_summary` from image rows that already carry ``marked`` (null: no label)."""
    counted = joined.groupBy("split").agg(
        F.count("*").alias("images"),
        F.count_if(F.col("marked")).alias("with_defects"),
        F.count_if(~F.col("marked")).alias("without_defects"),
    )
    splits = joined.sparkSession.createDataFrame([(s,) for s in S.SPLITS], "split string")
    return splits.join(counted, "split", "left").na.fill(0)


def dataset_errors(images: DataFrame, files: DataFrame) -> DataFrame:
    """Everything that keeps a dataset from being ready; an empty result means ready.

    Only label files that belong to an image are checked, as orphans do not matter to training.
    """
    used = files.join(images.select(*KEY).distinct(), KEY, "left_semi")
    lines = line_errors(label_lines(used))
    missing = missing_labels(images, files).select(
        *KEY, F.lit(0).alias("line_no"), F.lit("missing_label").alias("rule"), F.lit("").alias("field")
    )
    empty = split_summary(images, files).filter((F.col("images") == 0) & (F.col("split") != "test"))
    empty = empty.select(
        "split",
        F.lit("").alias("stem"),
        F.lit(0).alias("line_no"),
        F.lit("empty_split").alias("rule"),
        F.lit("").alias("field"),
    )
    return lines.unionByName(missing).unionByName(empty)


def is_ready(images: DataFrame, files: DataFrame) -> bool:
    return dataset_errors(images, files).isEmpty()


def error_preview(errors: DataFrame, shown: int = 50) -> DataFrame:
    """The first errors in file order, each with the number of errors left out."""
    order = ["split", "stem", "line_no", "rule", "field"]
    total = errors.agg(F.count("*")).scalar()
    more = F.greatest(total - shown, F.lit(0)).alias("more")
    return errors.orderBy(*order).limit(shown).select(*order, more)


def six_decimals(value: Column) -> Column:
    """Text of a non-negative number with six decimals, rounded on its exact binary value.

    Spark rounds the shortest decimal form instead, which differs in the last digit near ties. Two
    million times the value is ``value * 128 * 15625``; scaling by 128 is exact, and so is each half
    of the fraction times 15625 when the fraction is cut after 26 bits.
    """
    scaled = value * 128
    whole = F.floor(scaled)
    fraction = scaled - whole
    coarse = F.floor(fraction * (1 << 26)) / (1 << 26)
    high, low = coarse * 15625, (fraction - coarse) * 15625
    rest = high - F.floor(high)
    carry = low >= 1 - rest
    halves = whole * 15625 + F.floor(high) + F.when(carry, 1).otherwise(0)
    beyond = F.when(carry, low > 1 - rest).otherwise((rest > 0) | (low > 0))
    lower = F.floor(halves / 2)
    up = (halves % 2 == 1) & (beyond | (lower % 2 == 1))
    units = lower + F.when(up, 1).otherwise(0)
    return F.format_string("%d.%06d", F.floor(units / 1_000_000), units % 1_000_000)


def format_lines(boxes: DataFrame, *kept: str) -> DataFrame:
    """Label line of each box (split, stem, class_id, xc, yc, w, h) with six decimals, and the ``kept`` columns."""
    sides = [six_decimals(F.col(c)) for c in ("xc", "yc", "w", "h")]
    return boxes.select(*KEY, F.concat_ws(" ", F.col("class_id"), *sides).alias("line"), *kept)
