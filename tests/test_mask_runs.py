"""Masks as runs against plain pixel sets."""

import numpy as np
from pyspark.sql import functions as F

from seamline.operators.localize import filtered_mask, mask_runs, overlapping_runs


def pixels(rows):
    return {(r.image_id, r.y, r.x + k) for r in rows for k in range(r.length)}


def packed(spark, masks):
    rows = [(k, m.shape[0], m.shape[1], bytearray(np.packbits(m).tobytes())) for k, m in masks.items()]
    return spark.createDataFrame([*rows, (99, 3, 3, None)], "image_id long, mask_height int, mask_width int, mask binary")


def test_runs_and_what_masks_share(spark):
    rng = np.random.default_rng(1)
    left = {k: rng.random((7, 13)) < p for k, p in enumerate((0.0, 0.3, 0.7, 1.0))}
    right = {k: rng.random((7, 13)) < 0.6 for k in range(1, 5)}
    sets = [{(k, y, x) for k, m in masks.items() for y, x in zip(*np.nonzero(m))} for masks in (left, right)]
    a, b = mask_runs(packed(spark, left)), mask_runs(packed(spark, right))
    assert pixels(a.collect()) == sets[0] and len(a.where("image_id = 3").collect()) == 7
    shared = overlapping_runs(a, b).collect()
    assert pixels(shared) == sets[0] & sets[1] and sum(r.length for r in shared) == len(sets[0] & sets[1])


def test_filtered_mask_lists_the_runs_of_all_kept_regions(spark):
    regions = spark.createDataFrame([(1, [([2, 5, 3, 3, 4, 1],), ([9, 0, 2],)]), (2, []), (3, None)], "image_id long, regions array<struct<runs:array<int>>>")
    rows = filtered_mask(regions).orderBy("y").collect()
    assert [(r.image_id, r.y, r.x, r.length) for r in rows] == [(1, 2, 5, 3), (1, 3, 4, 1), (1, 9, 0, 2)]
    assert filtered_mask(regions.where(F.col("image_id") > 1)).count() == 0
