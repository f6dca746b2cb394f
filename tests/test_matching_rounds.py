"""Rounds of box matching: what is written after the first one, and the same matches however rounds are joined."""

import pytest

from seamline.operators import detections

BOXES = "image_id long, box_no int, class_id int, conf double, x1 double, y1 double, x2 double, y2 double"
TRUTH = "image_id long, truth_no int, class_id int, x1 double, y1 double, x2 double, y2 double"


def tables(spark, calm, crowd):
    """``calm`` pictures where the only box has the only label, and one where every box wants the first label."""
    boxes = [(i, 0, 0, 0.5, 0.0, 0.0, 100.0, 100.0) for i in range(1, calm + 1)]
    truth = [(i, 0, 0, 0.0, 0.0, 100.0, 100.0) for i in range(1, calm + 1)]
    boxes += [(0, n, 0, 0.9 - n / 100, 0.0, 0.0, 100.0, 100.0) for n in range(crowd)]
    truth += [(0, n, 0, float(n), 0.0, 100.0 + n, 100.0) for n in range(crowd)]
    return spark.createDataFrame(boxes, BOXES), spark.createDataFrame(truth, TRUTH)


def test_rounds_write_only_what_they_change(spark, monkeypatch):
    written, cut = [], detections.cut_lineage
    monkeypatch.setattr(detections, "cut_lineage", lambda df: written.append(cut(df)) or written[-1])
    found = detections.match_boxes(*tables(spark, 300, 4)).collect()
    assert len(found) == 304
    rows = [df.count() for df in written]
    assert rows[1] == 301 and max(rows[2:]) <= 4


@pytest.mark.parametrize(("few", "kept"), [(0, 1), (0, 8), (100_000, 1), (100_000, 2)])
def test_ways_to_join_rounds_agree(spark, monkeypatch, few, kept):
    monkeypatch.setattr(detections, "FEW", few)
    monkeypatch.setattr(detections, "WRITTEN", kept)
    found = detections.match_boxes(*tables(spark, 5, 6)).where("image_id = 0").collect()
    # the surer box comes first and takes the nearest label that is left
    assert sorted((r.box_no, r.truth_no) for r in found) == [(n, n) for n in range(6)]
