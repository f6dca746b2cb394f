"""Bank reduction over the whole bank: exact in rounds, against its SQL and against one loop over all items."""

import duckdb
import numpy as np
import pandas as pd
import pytest

from seamline.operators.farthest import farthest_items
from seamline.operators.pivots import farthest_points
from seamline.plans.oracle import SQL
from seamline.plans.queries import QUERIES


def frame(spark, vectors, ids=None):
    ids = np.arange(len(vectors)) if ids is None else ids
    table = pd.DataFrame({"item_id": ids, "embedding": [v.tolist() for v in vectors]})
    return spark.createDataFrame(table, "item_id long, embedding array<float>").repartition(5)


def test_over_4096_items_are_one_bank(spark, tmp_path):
    """5,000 vectors, some of them equal: a tenth of the whole, not of two halves."""
    rng = np.random.default_rng(3)
    vectors = rng.normal(size=(5000, 4)).astype(np.float32)
    vectors[4000:] = vectors[:1000]
    table = pd.DataFrame({"vec_id": np.arange(5000), "embedding": [v.tolist() for v in vectors], "label": np.arange(5000) % 9})
    spark.createDataFrame(table, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    expected = sorted(r[0] for r in con.execute(SQL["coreset"]).fetchall())
    found = sorted(r.item_id for r in QUERIES["coreset"](spark, str(tmp_path)).collect())
    bank = np.flatnonzero(np.arange(5000) % 9 < 8)
    assert found == expected == sorted(bank[farthest_points(vectors[bank].astype(float), 444)[0]])


@pytest.mark.parametrize("offered", [1, 12, 150, 8192])
@pytest.mark.parametrize("kind", ["apart", "clusters", "grid"])
def test_rounds_choose_what_one_loop_does(spark, kind, offered):
    """Also with equally far items (a grid), in blocks of 70 and whatever a round is offered."""
    rng = np.random.default_rng(4)
    vectors = {
        "apart": rng.normal(size=(600, 32)),
        "clusters": rng.normal(size=(9, 3))[rng.integers(0, 9, 600)] + 1e-3 * rng.normal(size=(600, 3)),
        "grid": rng.integers(0, 6, (600, 3)),
    }[kind].astype(np.float32)
    wanted = 18 if offered == 1 else 60
    found = {r.item_id: r.embedding for r in farthest_items(frame(spark, vectors), wanted / 600, 70, offered).collect()}
    expected = farthest_points(vectors.astype(float), wanted)[0]
    assert sorted(found) == sorted(set(expected.tolist()))
    assert all(np.array_equal(np.float32(found[i]), vectors[i]) for i in found)


def test_copies_are_chosen_once(spark):
    vectors = np.repeat(np.eye(4, dtype=np.float32), 50, axis=0)
    ids = 1000 - np.arange(200)
    found = sorted(r.item_id for r in farthest_items(frame(spark, vectors, ids), 0.1, 16, 3).collect())
    assert found == [801, 851, 901, 951]


def test_small_and_odd_banks(spark):
    one = frame(spark, np.ones((1, 3)), [7])
    assert [r.item_id for r in farthest_items(one, 0.1).collect()] == [7]
    assert farthest_items(one.limit(0), 0.1).count() == 0
    rows = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, float("nan")]), (3, [0.0, 1.0])], "item_id long, embedding array<float>")
    with pytest.raises(Exception, match="finite numbers"):
        farthest_items(rows, 0.1)
