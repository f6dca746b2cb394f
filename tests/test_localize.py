import json

import numpy as np
import pytest
from pyspark.sql import Row, functions as F

from seamline.operators import localize
from seamline.sinks.tables import write_report


def prediction(image_id, values, score):
    values = np.asarray(values, float)
    return Row(
        image_id=image_id,
        height=values.shape[0],
        width=values.shape[1],
        map=[float(v) for v in values.ravel()],
        pred_score=score,
    )


SCHEMA = "image_id long, height int, width int, map array<float>, pred_score array<double>"


def run(spark, rows, masks=None, **options):
    return localize.localize(spark.createDataFrame(rows, SCHEMA), masks, **options)


def rectangle():
    values = np.full((12, 12), 0.1)
    values[3:7, 2:7] = 0.9
    return values


def test_rectangle(spark):
    found = run(spark, [prediction(1, rectangle(), [0.9])], min_area=1).first()
    region = found.regions[0]
    assert (region.x, region.y, region.width, region.height, region.area) == (2, 3, 5, 4, 12)
    assert region.mean_score == region.max_score == 0.9
    assert found.threshold == pytest.approx(0.9)
    assert region.runs == [3, 2, 5, 4, 2, 5, 5, 2, 5, 6, 2, 5]


def test_small_region_is_dropped_by_default(spark):
    found = run(spark, [prediction(1, rectangle(), [0.9])]).first()
    assert found.has_anomaly and found.regions == []


def test_hole_counts_in_the_mean(spark):
    values = np.full((30, 30), 0.1)
    values[5:16, 5:16] = 0.9
    values[8:13, 8:13] = 0.3
    region = run(spark, [prediction(1, values, [0.9])], percentile=50.0).first().regions[0]
    assert region.area == 100
    assert region.mean_score == pytest.approx((96 * 0.9 + 25 * 0.3) / 121, abs=1e-6)


def test_tie_keeps_order_and_limit(spark):
    values = np.full((20, 40), 0.1)
    values[3:9, 3:9] = 0.9
    values[10:16, 20:26] = 0.9
    options = {"min_area": 1, "percentile": 90.0}
    one = run(spark, [prediction(1, values, [0.9])], **options).first().regions
    two = run(spark, [prediction(1, values, [0.9])], max_regions=5, **options).first().regions
    assert [(r.x, r.y) for r in one] == [(3, 3)]
    assert [(r.x, r.y) for r in two] == [(3, 3), (20, 10)]


def test_gate_and_missing_scores(spark):
    rows = [prediction(1, rectangle(), [0.49]), prediction(2, rectangle(), []), prediction(3, rectangle(), None)]
    for row in run(spark, rows).collect():
        assert not row.has_anomaly and row.threshold == 0.0 and row.regions == []
    assert run(spark, [prediction(4, rectangle(), [0.5, 0.1])]).first().has_anomaly


def test_masks(spark):
    values = np.full((6, 6), 0.8)
    inside = np.zeros((12, 12), bool)
    inside[2:9, 2:9] = True
    rows = [(1, 12, 12, np.packbits(inside).tobytes()), (2, 12, 12, np.packbits(np.zeros(144, bool)).tobytes())]
    masks = spark.createDataFrame(rows, "image_id long, mask_height int, mask_width int, mask binary")
    predictions = [prediction(1, values, [0.9]), prediction(2, values, [0.9])]
    first, second = run(spark, predictions, masks).orderBy("image_id").collect()
    # the map grew to its mask, and distances are those to the edge of the mask
    region = first.regions[0]
    assert (region.x, region.y, region.width, region.height) == (2, 2, 7, 7)
    assert region.median_edge_distance == 2.0
    assert second.threshold == 0.2 and second.regions == []


@pytest.mark.parametrize("seed", range(6))
def test_window_of_candidates_gives_what_the_whole_map_gives(seed):
    from seamline.functions import raster

    rng = np.random.default_rng(seed)
    values = raster.blur(rng.integers(0, 255, (40, 50)).astype(np.uint8), 5).astype(np.float32) / 255
    values[rng.integers(0, 40, 30), rng.integers(0, 50, 30)] += 0.4
    mask = np.ones((40, 50), bool)
    mask[:, :5] = False
    threshold = float(np.percentile(values, 60 + 6 * seed))
    whole = raster.closed(raster.opened((values >= threshold) & mask, 3), 3)
    labels, areas = raster.outlines(whole)
    parts = localize.find_parts(values, mask, threshold, 1)
    expected = [i + 1 for i, a in enumerate(areas) if round(float(a)) >= 1]
    assert len(parts) == len(expected)
    for part, number in zip(parts, expected):
        ys, xs = np.nonzero(labels == number)
        assert part[1:5] == (xs.min(), ys.min(), xs.max() - xs.min() + 1, ys.max() - ys.min() + 1)
        assert part[6] == pytest.approx(values[ys, xs].mean())


def test_report_example(spark, tmp_path):
    """Ranking of the one published example region, and the shape of the report."""
    part = spark.createDataFrame(
        [(1, 0, 0.442625, 0.461491, 79.0)],
        "image_id long, component_no int, mean_score double, max_score double, median_edge_distance double",
    )
    assert localize.top_regions(part).first().ranking_score == 0.508739
    values = np.full((20, 20), 0.1)
    values[3:13, 3:13] = 0.9
    found = run(spark, [prediction(1, values, [0.893481]), prediction(2, values, [0.171302])])
    report = localize.report(found, F.concat(F.lit("prenda_ñ_"), "image_id"))
    write_report(report, str(tmp_path / "report"))
    lines = [
        json.loads(line)
        for path in (tmp_path / "report").glob("*.json")
        for line in path.read_text(encoding="utf-8").splitlines()
    ]
    clean, marked = sorted(lines, key=lambda r: r["pred_score"])
    assert list(clean) == [
        "image", "pred_score", "has_anomaly", "threshold_used", "region_count", "regions", "result_path", "mask_path",
    ]
    assert clean["image"] == "prenda_ñ_2" and clean["threshold_used"] == 0.0 and clean["regions"] == []
    assert marked["region_count"] == 1
    assert list(marked["regions"][0]) == [
        "x", "y", "width", "height", "area", "mean_score", "max_score", "median_edge_distance", "ranking_score",
    ]


def test_pixel_thresholds(spark):
    rows = [(1, i, i / 100, True) for i in range(100)] + [(1, 200, 9.0, False), (2, 300, 0.5, False)]
    pixels = spark.createDataFrame(rows, "image_id long, pixel long, v double, in_mask boolean")
    found = {r.image_id: r for r in localize.pixel_thresholds(pixels, "pixel").collect()}
    assert found[1].threshold == pytest.approx(np.percentile(np.arange(100) / 100, 99.5))
    assert found[2].threshold == 0.2 and found[2].pixels == 0


def test_top_regions_limits_before_the_shuffle(spark, data):
    from seamline.plans import fixtures

    top = localize.top_regions(fixtures.regions(spark, data), 3)
    plan = top._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 2
