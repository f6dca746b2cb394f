"""Label files written and read by the executors."""

import os

import pytest

from seamline.sources.files import read_label_files
from seamline.sources.label_files import read_label_folder, write_label_folder

LINES = "split string, stem string, line_no int, line string"


def test_files_of_all_kinds(spark, tmp_path):
    lines = [("train", "a", k, f"{k} 0.5 0.5 0.1 0.1") for k in range(20)] + [("train", "blank", 1, ""), ("val", "año 1", 1, "3 é"), ("test", "x", 1, None)]
    images = [("train", "a"), ("train", "a"), ("train", "clean"), ("val", "año 1"), ("test", "x")]
    folder = str(tmp_path / "labels")
    for _ in range(2):  # the second write replaces the first
        write_label_folder(spark.createDataFrame(lines[::-1], LINES).repartition(5), spark.createDataFrame(images, "split string, stem string"), folder)
    text = {f"{s}/{n}": open(f"{folder}/{s}/{n}", encoding="utf-8").read() for s in ("train", "val", "test") for n in os.listdir(f"{folder}/{s}")}
    expected = {"train/a.txt": "".join(f"{k} 0.5 0.5 0.1 0.1\n" for k in range(20)), "train/clean.txt": "", "train/blank.txt": "\n", "val/año 1.txt": "3 é\n", "test/x.txt": ""}
    assert text == expected
    assert open(f"{folder}/_SUCCESS").read() == "5 files, 22 lines\n"
    for read in (read_label_folder, read_label_files):
        found = {f"{r.split}/{r.stem}.txt": r.content for r in read(spark, folder).collect()}
        assert found == expected


def test_one_large_file_and_empty_folder(spark, tmp_path):
    rows = spark.range(40_000).selectExpr("'train' AS split", "'hot' AS stem", "cast(id AS int) AS line_no", "cast(id AS string) AS line")
    folder = f"file://{tmp_path}/hot"
    write_label_folder(rows, rows.select("split", "stem").limit(1), folder)
    (row,) = read_label_folder(spark, folder).collect()
    assert row.content == "".join(f"{k}\n" for k in range(40_000))
    write_label_folder(rows.limit(0), rows.limit(0), str(tmp_path / "none"))
    assert read_label_folder(spark, str(tmp_path / "none")).count() == 0


def test_names_are_needed(spark, tmp_path):
    lines = spark.createDataFrame([("train", None, 1, "x")], LINES)
    with pytest.raises(Exception, match="without stem"):
        write_label_folder(lines, lines.select("split", "stem").limit(0), str(tmp_path / "bad"))
