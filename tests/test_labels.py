import pytest

from seamline.operators import labels
from seamline.sinks.tables import export_label_files, write_label_rows
from seamline.sources.files import read_label_files, read_label_rows


def files(spark, **contents):
    rows = [("train", stem, text) for stem, text in contents.items()]
    return spark.createDataFrame(rows, "split string, stem string, content string")


def errors(spark, text):
    found = labels.line_errors(labels.label_lines(files(spark, a=text)))
    return sorted((r.line_no, r.rule, r.field) for r in found.collect())


GOOD = "0 0.5 0.5 0.2 0.2"


@pytest.mark.parametrize(
    "text, expected",
    [
        ("", []),
        (" \n\t\r\n", []),
        (GOOD, []),
        (f"\n{GOOD}\n\n", []),
        (f"{GOOD}\n\n{GOOD}", [(2, "tokens", "")]),
        ("0 0.5 0.5 0.2", [(1, "tokens", "")]),
        (f"{GOOD} 1", [(1, "tokens", "")]),
        ("a b c d e", [(1, "numeric", "")]),
        ("1.0 0.5 0.5 0.2 0.2", [(1, "numeric", "")]),
        ("1 0.5d 0.5 0.2 0.2", [(1, "numeric", "")]),
        ("1_0 0.5 0.5 0.2 0.2", [(1, "numeric", "")]),
        ("+1\t5e-1  .5 0.2 0.2", []),
        ("7 0.5 0.5 0.2 0.2", [(1, "class", "")]),
        ("-1 0.5 0.5 0.2 0.2", [(1, "class", "")]),
        ("0 nan 0.5 0.2 0.2", [(1, "range", "x_center")]),
        ("0 0.5 0.5 nan 0.2", [(1, "range", "width")]),
        ("0 0.5 inf 0.2 0.2", [(1, "range", "y_center")]),
        ("0 0.5 0.5 0 0.2", [(1, "size", "")]),
        ("9 1.5 -0.1 -0.2 1.0001", [
            (1, "class", ""), (1, "range", "height"), (1, "range", "width"), (1, "range", "x_center"),
            (1, "range", "y_center"), (1, "size", ""),
        ]),
        (f"{GOOD}\r\n4 0.5 0.5 0.2 0.2\r{GOOD}", [(2, "class", "")]),
    ],
)
def test_rules(spark, text, expected):
    assert errors(spark, text) == expected


def test_dataset(spark):
    images = spark.createDataFrame(
        [("train", "a"), ("train", "b"), ("train", "c"), ("test", "d")], "split string, stem string"
    )
    label = files(spark, a=GOOD, b="\n", orphan="x")
    summary = {r.split: (r["images"], r.with_defects, r.without_defects) for r in labels.split_summary(images, label).collect()}
    assert summary == {"train": (3, 1, 1), "val": (0, 0, 0), "test": (1, 0, 0)}
    found = {(r.split, r.stem, r.rule) for r in labels.dataset_errors(images, label).collect()}
    assert found == {("train", "c", "missing_label"), ("test", "d", "missing_label"), ("val", "", "empty_split")}
    assert not labels.is_ready(images, label)
    assert [r.stem for r in labels.orphan_labels(images, label).collect()] == ["orphan"]
    ready = spark.createDataFrame([("train", "a"), ("val", "a")], "split string, stem string")
    both = label.unionByName(spark.createDataFrame([("val", "a", "")], label.schema))
    assert labels.is_ready(ready, both)


def test_preview(spark):
    text = "\n".join(["x"] * 60)
    found = labels.line_errors(labels.label_lines(files(spark, a=text)))
    preview = labels.error_preview(found).collect()
    assert len(preview) == 50 and {r.more for r in preview} == {10} and preview[0].line_no == 1


def test_write_and_read(spark, tmp_path):
    boxes = spark.createDataFrame(
        [("train", "a", 2, 0.5, 0.0390625, 1.0, 0.2603125), ("train", "a", 0, 1 / 3, 2 / 3, 0.1, 0.25)],
        "split string, stem string, class_id int, xc double, yc double, w double, h double",
    )
    lines = labels.format_lines(boxes)
    wanted = [f"{r.class_id} {r.xc:.6f} {r.yc:.6f} {r.w:.6f} {r.h:.6f}" for r in boxes.collect()]
    assert [r.line for r in lines.collect()] == wanted
    numbered = lines.selectExpr("split", "stem", "case when line like '2%' then 1 else 2 end as line_no", "line")
    images = spark.createDataFrame([("train", "a"), ("val", "clean")], "split string, stem string")
    write_label_rows(numbered, images, str(tmp_path / "rows"))
    rows = read_label_rows(spark, str(tmp_path / "rows"))
    assert sorted((r.stem, r.line_no, r.line) for r in rows.collect()) == [
        ("a", 1, wanted[0]), ("a", 2, wanted[1]), ("clean", 1, ""),
    ]
    export_label_files(rows, str(tmp_path / "text"))
    text = [p for p in (tmp_path / "text").rglob("*.txt") if "stem=a" in str(p)]
    assert "\n".join(p.read_text().strip() for p in sorted(text)).splitlines() == wanted


def test_random_numbers_are_written_as_printf_does(spark):
    import random

    from pyspark.sql import functions as F

    random.seed(3)
    values = [random.random() for _ in range(2000)] + [i / 1280 for i in range(1281)] + [(2 * i + 1) / 2e6 for i in range(0, 999999, 997)]
    frame = spark.createDataFrame([(v,) for v in values], "v double")
    got = [r.t for r in frame.select(labels.six_decimals(F.col("v")).alias("t")).collect()]
    assert got == [f"{v:.6f}" for v in values]


def test_label_files(spark, tmp_path):
    for split, stem, text in [("train", "a", GOOD + "\n"), ("val", "b", "")]:
        folder = tmp_path / "labels" / split
        folder.mkdir(parents=True, exist_ok=True)
        (folder / f"{stem}.txt").write_text(text)
    found = {(r.split, r.stem): r.content for r in read_label_files(spark, str(tmp_path / "labels")).collect()}
    assert found == {("train", "a"): GOOD + "\n", ("val", "b"): ""}


def test_pixel_and_normalised_boxes(spark):
    from pyspark.sql import functions as F

    from seamline.functions.geometry import normalised_box, pixel_box, roi_bounds

    row = spark.createDataFrame([(100.0, 50.0, 40.0, 20.0, 1280, 720)], "x double, y double, w double, h double, iw int, ih int")
    box = normalised_box(*[F.col(c) for c in ("x", "y", "w", "h", "iw", "ih")]).alias("b")
    back = row.select("*", box).select(
        pixel_box(F.col("b.xc"), F.col("b.yc"), F.col("b.w"), F.col("b.h"), F.col("iw"), F.col("ih")).alias("p")
    ).first().p
    assert (back.x1, back.y1, back.x2, back.y2) == pytest.approx((100, 50, 140, 70))
    roi = row.select(roi_bounds(F.col("iw"), F.col("ih")).alias("r"), roi_bounds(F.col("iw"), F.col("ih"), (0.9, 0.1, 0.2, 0.9)).alias("bad")).first()
    assert tuple(roi.r) == (128, 72, 1152, 648) and roi.bad is None
