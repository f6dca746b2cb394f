"""Motion of frames whose pictures are made in their place in the order: same figures, no stored signals."""

import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from seamline.functions import raster
from seamline.operators import images
from seamline.plans import fixtures as X
from seamline.plans.queries import QUERIES

FIELDS = "height int, width int, nChannels int, data binary"


def stored_bytes(folder) -> int:
    return sum(os.path.getsize(os.path.join(at, name)) for at, _, names in os.walk(folder) for name in names)


@pytest.fixture()
def checkpoints(spark, tmp_path):
    context, known = spark.sparkContext, spark.sparkContext.getCheckpointDir()
    context.setCheckpointDir(str(tmp_path))
    yield tmp_path
    if known:
        context.setCheckpointDir(known)


def test_signals_are_not_stored(spark, data, checkpoints):
    """250 pictures have 2.3 MB of signals; 8 runs have two ends each."""
    rows = QUERIES["frame_motion"](spark, data).collect()
    assert len(rows) == X.captures(spark, data).count() == 250
    assert stored_bytes(checkpoints) < 250 * 128 * 72 / 4


def drawn_from(rows):
    """Pictures from a seed; none at all for seeds divisible by 5."""

    def draw(batches):
        for batch in batches:
            made = [np.kron(np.random.default_rng(int(s)).integers(0, 4, (4, 5, 3)) * 64, np.ones((10, 10, 1))).astype(np.uint8) for s in batch["seed"]]
            lost = batch["seed"] % 5 == 0
            yield batch.assign(
                height=np.where(lost, -1, 40), width=np.where(lost, -1, 50), nChannels=np.where(lost, -1, 3),
                data=[None if gone else m[:, :, ::-1].tobytes() for gone, m in zip(lost, made)],
            )

    return rows.mapInPandas(draw, f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in rows.schema)}, {FIELDS}")


def signal(seed):
    made = np.kron(np.random.default_rng(seed).integers(0, 4, (4, 5, 3)) * 64, np.ones((10, 10, 1))).astype(np.uint8)
    return raster.blur(raster.gray(made[4:36, 5:45])).astype(int)


@pytest.mark.parametrize("lazily", [True, False])
@pytest.mark.parametrize("runs", [1, 3, 40])
def test_motion_across_runs(spark, runs, lazily):
    """Stations of very different size, one of them null, times that repeat, and runs without a readable frame."""
    stations = ["a"] * 20 + ["b"] + [None] * 6 + ["c"] * 3
    table = pd.DataFrame({"station": stations, "ts": np.arange(30) // 2, "n": np.arange(30), "seed": [5 if 4 <= k < 9 else k + 1 for k in range(30)]})
    frames = spark.createDataFrame(table, "station string, ts long, n long, seed long").orderBy(F.rand(3))
    if lazily:
        found = images.frame_motion(frames, "station", "ts", "n", runs=runs, pixels=drawn_from)
    else:
        found = images.frame_motion(drawn_from(frames), "station", "ts", "n", runs=runs)
    assert found.columns == ["station", "ts", "n", "changed_pixels"]
    expected, before = {}, {}
    for row in table.itertuples():
        if row.seed % 5:
            own = signal(row.seed)
            known = before.get(row.station)
            expected[row.n] = None if known is None else int((np.abs(known - own) > 25).sum())
            before[row.station] = own
    rows = found.collect()
    assert len(rows) == len(expected) and {r.n: r.changed_pixels for r in rows} == expected


def test_pictures_that_leave_the_order_are_refused(spark):
    table = pd.DataFrame({"station": ["a"] * 30, "ts": np.arange(30), "n": np.arange(30), "seed": np.arange(30) * 5 + 1})
    frames = spark.createDataFrame(table, "station string, ts long, n long, seed long")
    with pytest.raises(Exception, match="no longer in order"):
        images.frame_motion(frames, "station", "ts", "n", runs=1, pixels=lambda rows: drawn_from(rows.sortWithinPartitions(F.desc("n"))))
