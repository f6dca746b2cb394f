"""Readers of image folders and label files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from seamline import schema as S
from seamline.functions.text import path_split, path_stem
from seamline.session import shuffle_partitions


def _suffix_glob(extensions: list[str]) -> str:
    """Path filter for the extensions in either case, applied when the folder is listed."""
    either = ["".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in e) for e in extensions]
    return "*.{" + ",".join(either) + "}"


def list_images(
    spark: SparkSession, folder: str, recursive: bool = True, extensions: list[str] | None = None
) -> DataFrame:
    """Paths, sizes and derived split and stem of the images under a folder; contents are not read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    reader = reader.option("pathGlobFilter", _suffix_glob(extensions or S.IMAGE_EXTENSIONS))
    found = reader.load(folder).select("path", "length", "modificationTime")
    return found.withColumn("split", path_split(F.col("path"))).withColumn("stem", path_stem(F.col("path")))


def read_images(
    spark: SparkSession,
    folder: str,
    recursive: bool = True,
    extensions: list[str] | None = None,
    source_kind: str = "folder",
) -> DataFrame:
    """Decoded images under a folder, one row each; files that cannot be decoded have height -1.

    Colours are in Spark's order (BGR or BGRA). ``orientation`` is 1: files carry their own tag only
    where the writer of the table fills it in.
    """
    reader = spark.read.format("image").option("recursiveFileLookup", str(recursive).lower())
    reader = reader.option("pathGlobFilter", _suffix_glob(extensions or S.IMAGE_EXTENSIONS))
    found = reader.load(folder).select("image.*").withColumnRenamed("origin", "path")
    return found.select(
        "path",
        path_split(F.col("path")).alias("split"),
        path_stem(F.col("path")).alias("stem"),
        "height",
        "width",
        "nChannels",
        "data",
        F.lit(1).alias("orientation"),
        F.lit(source_kind).alias("source_kind"),
        (F.col("height") > 0).alias("has_image"),
    )


def relative_path(path, folder: str):
    """Part of a ``file:`` path below ``folder``, as a column."""
    prefix = folder.rstrip("/") + "/"
    return F.substring_index(path, prefix, -1)


def read_label_files(spark: SparkSession, folder: str, pattern: str = "*/*.txt") -> DataFrame:
    """One row per label file below a folder: split, stem and whole content.

    The file sources of DataFrames leave out empty files, and an empty label file means a clean image;
    reading whole text files keeps them. For large sets, keep labels as rows (``read_label_rows``).
    """
    files = spark.sparkContext.wholeTextFiles(f"{folder.rstrip('/')}/{pattern}", shuffle_partitions(spark))
    found = spark.createDataFrame(files, "path string, content string")
    return found.select(
        path_split(F.col("path")).alias("split"), path_stem(F.col("path")).alias("stem"), "content"
    )


def read_label_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Label lines written by ``write_label_rows``; clean images have one empty line."""
    return spark.read.schema("split string, stem string, line_no int, line string").parquet(folder)
