"""Writers of inspections, reports, profiles, labels and prepared images."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from seamline.operators.register import with_defaults


def append_inspections(rows: DataFrame, path: str) -> None:
    """Append rows in the full schema, by day of creation; a day with very many rows is split."""
    full = with_defaults(rows).withColumn("created_day", F.to_date("created_at"))
    full = full.hint("rebalance", "created_day")
    full.write.mode("append").partitionBy("created_day").parquet(path)


def append_inspections_jdbc(rows: DataFrame, url: str, table: str = "inspections", **options: str) -> None:
    with_defaults(rows).write.format("jdbc").option("url", url).option("dbtable", table).options(
        **options
    ).mode("append").save()


def write_report(report: DataFrame, path: str) -> None:
    """Localisation report as JSON lines in UTF-8."""
    report.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_profiles(gallery: DataFrame, profile: DataFrame, path: str) -> None:
    rows = gallery.select("model_name", "image_name", "embedding").hint("rebalance", "model_name")
    rows.write.mode("overwrite").partitionBy("model_name").parquet(f"{path}/gallery")
    profile.select("model_name", "n", "min_sim", "mean_sim", "threshold").write.mode("overwrite").parquet(
        f"{path}/profile"
    )


def write_label_rows(lines: DataFrame, images: DataFrame, path: str) -> None:
    """Label lines (split, stem, line_no, line) as one table, with an empty line for clean images.

    Range partitioning keeps the lines of an image together and in order, and still splits an image
    with very many lines.
    """
    key = ["split", "stem"]
    clean = images.select(*key).distinct().join(lines.select(*key).distinct(), key, "left_anti")
    empty = clean.select(*key, F.lit(1).alias("line_no"), F.lit("").alias("line"))
    rows = lines.select(*key, F.col("line_no").cast("int").alias("line_no"), "line").unionByName(empty)
    ordered = rows.repartitionByRange(*key, "line_no").sortWithinPartitions(*key, "line_no")
    ordered.write.mode("overwrite").parquet(path)


def export_label_files(rows: DataFrame, path: str) -> None:
    """Text files for a training tool, in one folder per image (``split=…/stem=…``)."""
    ordered = rows.repartitionByRange("split", "stem", "line_no").sortWithinPartitions("split", "stem", "line_no")
    ordered.select("split", "stem", F.col("line").alias("value")).write.mode("overwrite").partitionBy(
        "split", "stem"
    ).text(path)


def write_prepared(prepared: DataFrame, path: str) -> None:
    """Successfully prepared images (Spark image fields and target path), by split."""
    done = prepared.filter(F.col("status") == "success").drop("error", "status")
    done.write.mode("overwrite").partitionBy("split").parquet(path)
