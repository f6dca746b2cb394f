"""Bank reduction in several blocks against its SQL, and the bound on what any selection can cover."""

import duckdb
import numpy as np
import pandas as pd

from seamline.operators import anomaly
from seamline.plans.oracle import SQL
from seamline.plans.queries import QUERIES


def test_two_blocks_against_sql(spark, tmp_path):
    """Over 4,096 items, some of them equal: two blocks, and ties of distances."""
    rng = np.random.default_rng(3)
    vectors = rng.normal(size=(5000, 4)).astype(np.float32)
    vectors[4000:] = vectors[:1000]
    table = pd.DataFrame({"vec_id": np.arange(5000), "embedding": [v.tolist() for v in vectors], "label": np.arange(5000) % 9})
    kinds = "vec_id long, embedding array<float>, label int"
    spark.createDataFrame(table, kinds).coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    expected = sorted(r[0] for r in con.execute(SQL["coreset"]).fetchall())
    found = sorted(r.item_id for r in QUERIES["coreset"](spark, str(tmp_path)).collect())
    assert found == expected and len(found) == 445


def frame(spark, vectors):
    return spark.createDataFrame(pd.DataFrame({"item_id": np.arange(len(vectors)), "embedding": [v.tolist() for v in vectors]}), "item_id long, embedding array<float>")


def test_bound_on_every_choice_of_a_size(spark):
    rng = np.random.default_rng(5)
    vectors = np.concatenate([rng.normal(size=(90, 3)), np.zeros((30, 3))]).astype(np.float32)
    bank, points = frame(spark, vectors), vectors[:91].astype(float)
    gaps = np.linalg.norm(points[:, None] - points, axis=2)
    np.fill_diagonal(gaps, np.inf)
    assert abs(anomaly.least_cover_radius(bank, 12) - np.sort(gaps.min(axis=1))[-13]) < 1e-9
    assert anomaly.least_cover_radius(bank, 12) <= anomaly.cover_radius(bank, anomaly.coreset(bank, 0.1))
    assert anomaly.least_cover_radius(bank, 91) == 0.0


def test_one_block_is_picked_only_if_the_bound_leaves_it_open(spark, monkeypatch):
    """Random directions are decided by the bound, a few close clusters are not."""
    rng = np.random.default_rng(6)
    single, picked = [], anomaly.coreset
    monkeypatch.setattr(anomaly, "coreset", lambda *a, **o: single.append(o) or picked(*a, **o))
    around = rng.normal(size=(400, 40))
    bank = frame(spark, around / np.linalg.norm(around, axis=1, keepdims=True))
    assert anomaly.covers_within(bank, picked(bank, block_rows=100), 2) and not single
    near = frame(spark, rng.normal(size=(5, 3))[rng.integers(0, 5, 400)] + 1e-3 * rng.normal(size=(400, 3)))
    assert anomaly.covers_within(near, picked(near), 1) and len(single) == 1
    assert not anomaly.covers_within(near, near.where("item_id < 1"), 2)
