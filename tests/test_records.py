import datetime as dt
import json
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from seamline import schema as S
from seamline.operators import detections, records
from seamline.operators.register import AUTOMATIC, FORM, STATION, register, with_defaults
from seamline.sinks.tables import append_inspections, append_inspections_jdbc, write_profiles
from seamline.sources.tables import read_inspections, read_inspections_jdbc, read_profiles

AT = dt.datetime(2024, 5, 6, 7, 8, 9, 123456)


@pytest.fixture(scope="module")
def captures(spark):
    rows = [(i, AT, True) for i in range(1, 6)] + [(6, AT, False)]
    return spark.createDataFrame(rows, "image_id long, captured_at timestamp_ntz, has_image boolean")


def box(image, number, class_id, conf, x1, x2):
    return (image, number, class_id, conf, float(x1), 0.0, float(x2), 10.0, 1000, 500)


@pytest.fixture(scope="module")
def verdicts(spark, captures):
    rows = [
        box(1, 0, 1, 0.7, 0, 100),
        box(1, 1, 2, 0.7, 900, 1000),  # ties with the first, which wins
        box(2, 0, 0, 0.69999, 320, 340),  # centre exactly at 0.33 of the width
        box(3, 0, 0, 0.39, 0, 10),  # below the floor
        box(4, 0, 9, 0.95, 700, 800),  # unknown class
        box(5, 0, 3, 0.4, 650, 670),  # centre exactly at 0.66, confidence exactly at the floor
    ]
    return detections.verdict_from_boxes(captures, spark.createDataFrame(rows, S.BOXES))


def test_verdicts(verdicts):
    found = {r.image_id: (r.status, r.defect_type, r.confidence, r.zone) for r in verdicts.collect()}
    assert found[1] == ("Defecto", "rotura", 70.0, "Lateral izquierdo")
    assert found[2] == ("Revisar", "mancha", 70.0, "Zona frontal")
    assert found[3] == ("Aprobado", "Sin defecto", 90.0, "Centro")
    assert found[4] == ("Defecto", "Defecto visible", 95.0, "Lateral derecho")
    assert found[5] == ("Revisar", "variacion_color", 40.0, "Zona frontal")


def test_registration_modes(spark, captures, verdicts):
    identity = spark.createDataFrame(
        [(1, True, "blusa_modelo_01", 0.9, 0.8), (2, False, None, 0.61239, 0.8)],
        "image_id long, identified boolean, model_name string, similarity double, threshold double",
    )
    station = {r.id: r for r in register(captures, verdicts, identity, STATION).collect()}
    assert len(station) == 5  # the capture without a picture is not registered
    assert station[2].garment_type == "blusa_modelo_01" and station[2].status == "Defecto"
    unknown = station[3]
    assert (unknown.garment_type, unknown.status, unknown.defect_type, unknown.zone) == (
        "Prenda no identificada", "Revisar", "Prenda no identificada", "No aplica",
    )
    assert unknown.confidence == Decimal("61.24") and unknown.image_result is None
    assert unknown.confidence_kind == "similarity" and unknown.identity_similarity == 0.6124
    for mode in (AUTOMATIC, FORM):
        rows = {r.id: r for r in register(captures, verdicts, mode=mode).collect()}
        assert rows[3].garment_type == "Prenda inspeccionada" and rows[3].status == "Revisar"
        assert rows[3].identity_identified is None
    assert rows[2].code.startswith("INS-070809-") and len(rows[2].code) == 15
    assert rows[2].created_at == dt.datetime(2024, 5, 6, 7, 8, 9)
    again = register(captures.repartition(3), verdicts, mode=FORM).collect()
    assert sorted(r.code for r in again) == sorted(r.code for r in rows.values())
    with pytest.raises(ValueError):
        register(captures, verdicts, mode=STATION)


def test_append_overlay_and_read_back(spark, captures, verdicts, tmp_path):
    path = str(tmp_path / "records")
    append_inspections(register(captures, verdicts), path)
    append_inspections(register(captures.withColumn("image_id", F.col("image_id") + 100), verdicts), path)
    rows = read_inspections(spark, path)
    assert rows.schema == S.INSPECTIONS and rows.count() == 10
    assert {r.human_validation for r in rows.collect()} == {"Pendiente"}
    events = [(2, "Correcto", 1), (2, "Incorrecto", 2), (3, "nonsense", 1), (999, "Correcto", 1)]
    overlay = spark.createDataFrame(events, "inspection_id long, value string, n int")
    once = records.apply_validations(rows, overlay, ["n"])
    more = spark.createDataFrame([(2, "Correcto", 3)], overlay.schema)
    twice = records.apply_validations(once, more, ["n"])
    assert {r.id: r.human_validation for r in once.collect() if r.id < 5}[2] == "Incorrecto"
    final = {r.id: r.human_validation for r in twice.collect()}
    assert final[2] == "Correcto" and final[3] == "Pendiente" and len(final) == 10


def test_defaults(spark):
    row = with_defaults(spark.createDataFrame([(1, "c")], "id long, code string")).first()
    assert (row.garment_type, row.size, row.human_validation) == ("Prenda inspeccionada", "N/A", "Pendiente")
    assert row.created_record_at is not None and row.confidence is None


def test_jdbc_round_trip(spark, captures, verdicts, tmp_path):
    url = f"jdbc:derby:{tmp_path / 'db'};create=true"
    rows = register(captures, verdicts).drop("notes")
    append_inspections_jdbc(rows, url, driver="org.apache.derby.iapi.jdbc.AutoloadedDriver")
    back = read_inspections_jdbc(
        spark, url, bounds=(1, 10), partitions=3, driver="org.apache.derby.iapi.jdbc.AutoloadedDriver"
    )
    assert {r.code for r in back.collect()} == {r.code for r in rows.collect()}
    assert back.schema["confidence"].dataType == S.INSPECTIONS["confidence"].dataType


def test_profiles_round_trip(spark, tmp_path):
    gallery = spark.createDataFrame([("m/1", "a.jpg", [0.5, 0.25])], S.GALLERY)
    profile = spark.createDataFrame([("m/1", 12, 0.5, 0.7, 0.72)], S.PROFILE)
    write_profiles(gallery, profile, str(tmp_path))
    got_gallery, got_profile = read_profiles(spark, str(tmp_path))
    assert got_gallery.first() == gallery.first() and got_profile.first() == profile.first()


@pytest.fixture(scope="module")
def shop(spark):
    rows = [
        (1, "INS-1", "Blusa", "Defecto", "mancha", "Zona frontal", "Pendiente"),
        (2, "INS_2", "blusa", "Revisar", None, None, "Correcto"),
        (3, "INS%3", "BLÚSA", "Aprobado", "Sin defecto", "Centro", "Incorrecto"),
        (4, "ins-4", "Top corto", "defecto", "rotura", "Lateral izquierdo", "Pendiente"),
    ]
    columns = "id long, code string, garment_type string, status string, defect_type string, zone string, human_validation string"
    return spark.createDataFrame(rows, columns)


@pytest.mark.parametrize(
    "arguments, expected",
    [
        ({}, [4, 3, 2, 1]),
        ({"q": "  "}, [4, 3, 2, 1]),
        ({"q": "INS"}, [3, 2, 1]),
        ({"q": "%"}, [3]),
        ({"q": "S%", "wildcards": True}, [3, 2, 1]),
        ({"q": "INS_", "wildcards": True}, [3, 2, 1]),
        ({"q": "INS_"}, [2]),
        ({"q": "ins", "collation": "UNICODE_CI_AI"}, [4, 3, 2, 1]),
        ({"q": "ins_", "collation": "UNICODE_CI_AI", "wildcards": True}, [4, 3, 2, 1]),
        ({"q": " mancha "}, [1]),
        ({"q": "izquierdo"}, [4]),
        ({"status": "Defecto"}, [1]),
        ({"status": "defecto", "collation": "UTF8_LCASE"}, [4, 1]),
        ({"garment_type": "blusa", "collation": "UNICODE_CI_AI"}, [3, 2, 1]),
        ({"status": "Defecto", "garment_type": "Top corto"}, []),
        ({"limit": 2}, [4, 3]),
    ],
)
def test_search(shop, arguments, expected):
    assert [r.id for r in records.search(shop, **arguments).orderBy(F.desc("id")).collect()] == expected


def test_reports(spark, shop):
    assert records.kpis(shop).first().asDict() == {"total": 4, "defects": 1, "approved": 1, "review": 1, "pending": 2}
    assert [r.total for r in records.by_garment(shop, "UNICODE_CI_AI").collect()] == [3, 1]
    by_defect = records.by_defect(shop).collect()
    assert [r.defect_type for r in by_defect] == [None, "Sin defecto", "mancha", "rotura"]
    assert [r.id for r in records.alerts(shop, 1).collect()] == [2]
    empty = records.kpis(shop.filter("id > 9")).first()
    assert empty.total == 0 and empty.defects == 0
    broken = {(r.field, r.value) for r in records.vocabulary_violations(shop).collect()}
    assert broken == {("status", "defecto")}
    rates = records.confusion(shop.filter("id = 9")).first()
    assert rates.precision is None and rates.vp == 0


def test_json(spark, captures, verdicts):
    row = register(captures, verdicts).filter("id = 2").select("id", "created_at", "confidence", "zone", "identity_similarity")
    text = records.as_json(row).first().json
    assert json.loads(text) == {
        "id": 2, "created_at": "2024-05-06 07:08:09", "confidence": 70.0, "zone": "Lateral izquierdo",
        "identity_similarity": None,
    }


def test_kpis_scan_once(shop):
    plan = records.kpis(shop)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == 1


def test_detection_matching(spark):
    truth = spark.createDataFrame(
        [(1, 0, 0, 0.0, 0.0, 10.0, 10.0), (1, 1, 0, 300.0, 0.0, 310.0, 10.0)],
        "image_id long, truth_no int, class_id int, x1 double, y1 double, x2 double, y2 double",
    )
    rows = [
        (1, 0, 0, 0.9, 1.0, 0.0, 11.0, 10.0),  # overlap 0.82
        (1, 1, 0, 0.8, 0.0, 0.0, 10.0, 10.0),  # perfect, but less confident
        (1, 2, 0, 0.7, 300.0, 0.0, 310.0, 10.0),
        (1, 3, 1, 0.6, 0.0, 0.0, 10.0, 10.0),  # other class
        (2, 0, 0, 0.5, 0.0, 0.0, 10.0, 10.0),  # other image
    ]
    boxes = spark.createDataFrame(
        rows, "image_id long, box_no int, class_id int, conf double, x1 double, y1 double, x2 double, y2 double"
    )
    hits = {(r.iou, r.truth_no): r.box_no for r in detections.match_boxes(boxes, truth, [0.5, 0.9]).collect()}
    assert hits == {(0.5, 0): 0, (0.5, 1): 2, (0.9, 0): 1, (0.9, 1): 2}
    average = {r.iou: r.ap for r in detections.detection_map(boxes, truth, [0.5, 0.9]).collect()}
    # at 0.5: precision 1, 1/2, 2/3, 2/4 with recall 1/2, 1/2, 1, 1
    assert average[0.5] == pytest.approx((51 * 1 + 50 * 2 / 3) / 101)
    # at 0.9: precision 0, 1/2, 2/3, 2/4
    assert average[0.9] == pytest.approx(2 / 3)
    with pytest.raises(ValueError):
        detections.match_boxes(boxes, truth, [0.0])


BOXES_SCHEMA = "image_id long, box_no int, class_id int, conf double, x1 double, y1 double, x2 double, y2 double"
TRUTH_SCHEMA = "image_id long, truth_no int, class_id int, x1 double, y1 double, x2 double, y2 double"


def plain_matches(boxes, truth, threshold):
    """Predictions by falling confidence, each with the free label it overlaps most."""

    def overlap(p, t):
        w, h = min(p[6], t[5]) - max(p[4], t[3]), min(p[7], t[6]) - max(p[5], t[4])
        shared = max(0, w) * max(0, h)
        both = (p[6] - p[4]) * (p[7] - p[5]) + (t[5] - t[3]) * (t[6] - t[4]) - shared
        return shared / both if both > 0 else 0

    taken, hits = set(), set()
    for p in sorted(boxes, key=lambda p: (-p[3], p[1])):
        free = [(-overlap(p, t), t[1]) for t in truth if (t[0], t[2]) == (p[0], p[2]) and (*t[:3],) not in taken and overlap(p, t) >= threshold]
        if free:
            number = min(free)[1]
            taken.add((p[0], number, p[2]))
            hits.add((threshold, p[0], p[2], number, p[1]))
    return hits


def test_rejected_predictions_take_their_next_label(spark):
    truth = [(1, 0, 0, 0.0, 0.0, 100.0, 100.0), (1, 1, 0, 20.0, 0.0, 120.0, 100.0), (1, 2, 0, 40.0, 0.0, 140.0, 100.0)]
    boxes = [(1, k, 0, 0.9 - k / 10, float(k), 0.0, 100.0 + k, 100.0) for k in range(4)]
    found = detections.match_boxes(spark.createDataFrame(boxes, BOXES_SCHEMA), spark.createDataFrame(truth, TRUTH_SCHEMA), [0.4, 0.6, 0.9])
    hits = {(r.iou, r.box_no): r.truth_no for r in found.collect()}
    assert hits == {(0.4, 0): 0, (0.4, 1): 1, (0.4, 2): 2, (0.6, 0): 0, (0.6, 1): 1, (0.9, 0): 0}


def test_matching_equals_taking_turns(spark):
    """Crowds with equal confidences and overlaps, boxes of all sizes, some far outside their picture."""
    rng = random.Random(11)

    def box(size):
        x, y = rng.randrange(-50, 400), rng.randrange(0, 80)
        return float(x), float(y), float(x + rng.choice(size)), float(y + rng.choice(size))

    boxes = [(k % 5, k, k % 2, rng.randrange(10) / 10, *box([40, 60, 90, 500])) for k in range(160)]
    truth = [(k % 5, k, k % 2, *box([40, 60, 90])) for k in range(110)]
    thresholds = [0.1, 0.3, 0.5, 0.7]
    for least in (0, 2):
        wanted = thresholds[least:]
        found = detections.match_boxes(spark.createDataFrame(boxes, BOXES_SCHEMA), spark.createDataFrame(truth, TRUTH_SCHEMA), wanted)
        rows = [(r.iou, r.image_id, r.class_id, r.truth_no, r.box_no) for r in found.collect()]
        assert len(rows) == len(set(rows)) and set(rows) == set().union(*(plain_matches(boxes, truth, t) for t in wanted))


def test_huge_boxes_are_clamped_to_their_picture(spark):
    boxes = spark.createDataFrame([(1, 0, 0, 0.9, -1e8, -1e8, 1e8, 1e8)], BOXES_SCHEMA).selectExpr("*", "640 AS img_w", "480 AS img_h")
    truth = spark.createDataFrame([(1, 0, 0, 0.0, 0.0, 640.0, 480.0)], TRUTH_SCHEMA)
    assert detections._candidate_pairs(boxes, truth, 0.5, 128).collect()[0].overlap == 1.0
    assert detections.match_boxes(boxes, truth, [0.1, 0.95]).count() == 2


def test_capture_names(spark):
    from seamline.functions.text import capture_name, parse_capture_name, slug

    row = spark.createDataFrame([(AT,)], "at timestamp_ntz").select(
        capture_name(F.lit("top_corto"), F.lit("variacion_color"), F.col("at"), F.lit("3f")).alias("n")
    )
    got = row.select("n", parse_capture_name(F.col("n")).alias("p"), parse_capture_name(F.lit("x_y.jpg")).alias("bad")).first()
    assert got.n == "top_corto_variacion_color_20240506_070809_3f.jpg"
    assert (got.p.garment, got.p.defect, got.p.suffix) == ("top_corto", "variacion_color", "3f")
    assert got.p.captured_at == dt.datetime(2024, 5, 6, 7, 8, 9)
    assert got.bad.garment is None and got.bad.captured_at is None
    names = spark.createDataFrame([("  Blusa Ñandú #1! ",), ("***",), (None,)], "n string")
    assert [r.s for r in names.select(slug(F.col("n")).alias("s")).collect()] == ["blusa_ñandú_1", "modelo_prenda", "modelo_prenda"]
