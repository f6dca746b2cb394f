"""Neighbours by pivots against all pairs."""

import numpy as np
import pandas as pd
import pytest

from seamline.operators import anomaly, pivots as module
from seamline.operators.nearest import COSINE, EUCLIDEAN, nearest
from seamline.operators.pivots import Search, bounds, farthest_points, nearest_by_pivots


def frame(spark, vectors, key, ids=None):
    data = {key: np.arange(len(vectors)) if ids is None else ids, "embedding": [v.tolist() for v in vectors]}
    return spark.createDataFrame(pd.DataFrame(data), f"{key} long, embedding array<double>")


def rows_of(found):
    return sorted((r.query_id, r.item_id, round(r.score, 9)) for r in found.collect())


def clusters(rng, n, spread=0.05, d=6):
    centres = rng.normal(size=(9, d))
    return centres[rng.integers(0, 9, n)] + spread * rng.normal(size=(n, d))


@pytest.mark.parametrize("skip_self", [False, True])
@pytest.mark.parametrize("spread", [0.05, 3.0])
def test_same_rows_as_all_pairs(spark, spread, skip_self):
    rng = np.random.default_rng(3)
    items, queries = frame(spark, clusters(rng, 300, spread), "item_id"), frame(spark, clusters(rng, 120, spread), "query_id")
    search = Search(queries, items, 5, skip_self=skip_self, block_rows=20)
    assert rows_of(search.rows) == rows_of(nearest(queries, items, 5, EUCLIDEAN, skip_self=skip_self))
    assert search.pairs == 300 * 120 and (spread > 1 or search.compared < 0.4 * search.pairs)


def test_cosines_of_unit_vectors(spark):
    rng = np.random.default_rng(4)
    vectors = clusters(rng, 200)
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    items, queries = frame(spark, vectors, "item_id"), frame(spark, vectors[:60], "query_id")
    assert rows_of(nearest_by_pivots(queries, items, 4, COSINE)) == rows_of(nearest(queries, items, 4, COSINE))
    with pytest.raises(Exception, match="not a unit vector: item_id 1"):
        nearest_by_pivots(queries, frame(spark, np.array([[1.0, 0], [2.0, 0]]), "item_id"), 1, COSINE)


def test_a_third_of_the_items_in_one_point(spark):
    """Equal distances fill one ring, which is cut into blocks; the smallest ids win."""
    rng = np.random.default_rng(5)
    vectors = np.concatenate([np.ones((100, 3)), rng.normal(size=(200, 3))])
    items, queries = frame(spark, vectors, "item_id"), frame(spark, vectors[50:150], "query_id")
    found = nearest_by_pivots(queries, items, 7, block_rows=16)
    assert rows_of(found) == rows_of(nearest(queries, items, 7, EUCLIDEAN))
    assert {r.item_id for r in found.where("query_id = 3").collect()} == set(range(7))


def test_few_or_no_items(spark):
    queries = frame(spark, np.eye(3), "query_id")
    assert len(nearest_by_pivots(queries, frame(spark, np.eye(3)[:2], "item_id"), 9).collect()) == 6
    empty = frame(spark, np.eye(3), "item_id").limit(0)
    assert nearest_by_pivots(queries, empty, 2).columns == ["query_id", "item_id", "score"]
    assert nearest_by_pivots(queries, empty, 2).count() == 0
    assert nearest_by_pivots(queries.limit(0), frame(spark, np.eye(3), "item_id"), 2).count() == 0


def test_bounds_never_pass_a_distance():
    rng = np.random.default_rng(6)
    items, queries = clusters(rng, 400, 1.0), clusters(rng, 90, 1.0)
    points = items[farthest_points(items, 20)[0]]
    to = np.linalg.norm(items[:, None] - points, axis=2)
    own = to.argmin(axis=1)
    low = np.array([to[own == p, p].min() for p in range(20)])
    high = np.array([to[own == p, p].max() for p in range(20)])
    least = bounds(np.linalg.norm(queries[:, None] - points, axis=2), points, low, high)
    true = np.linalg.norm(queries[:, None] - items, axis=2)
    assert all((true[:, own == p].min(axis=1) >= least[:, p] - 1e-6).all() for p in range(20))
    assert least.mean() > 0.1


def test_points_cover_all_rows():
    vectors = np.random.default_rng(7).normal(size=(200, 3))
    picked, radius = farthest_points(vectors, 25)
    assert len(set(picked)) == 25
    assert np.linalg.norm(vectors[:, None] - vectors[picked], axis=2).min(axis=1).max() == pytest.approx(radius)


@pytest.mark.parametrize("block_rows", [60, 4096])
def test_union_of_blocks_covers_like_one_block(spark, block_rows):
    """Uneven clusters: each block alone would give every cluster its share."""
    rng = np.random.default_rng(8)
    vectors = np.concatenate([rng.normal(size=(500, 4)) * 0.01, rng.normal(size=(60, 4)) + 9, np.zeros((40, 4))])
    bank = frame(spark, vectors.astype(np.float32), "item_id")
    chosen = anomaly.coreset_union(bank, 0.1, block_rows=block_rows)
    rows = chosen.collect()
    assert len({r.item_id for r in rows}) == len(rows) == 60
    radius = anomaly.cover_radius(bank, chosen)
    picked = np.array([r.item_id for r in rows])
    assert radius == pytest.approx(np.linalg.norm(vectors[:, None] - vectors[picked], axis=2).min(axis=1).max(), abs=1e-5)
    assert radius <= 2 * farthest_points(vectors, 60)[1] + 1e-6
    assert radius <= anomaly.cover_radius(bank, anomaly.coreset(bank, 0.1, block_rows=60)) + 1e-6


def test_union_of_nothing_and_of_one_point(spark):
    same = frame(spark, np.ones((50, 2)), "item_id")
    assert anomaly.coreset_union(same, 0.2, block_rows=16).count() == 1
    assert anomaly.coreset_union(same.limit(0), 0.2).count() == 0


@pytest.mark.parametrize("metric", [EUCLIDEAN, COSINE])
def test_a_query_goes_to_few_blocks(spark, metric, monkeypatch):
    """Vectors in all directions, where nothing can be left out: with rings of one row a query visited 400 of them."""
    sent, spread = [], module.spread
    monkeypatch.setattr(module, "spread", lambda df, *keys: sent.append(df) or spread(df, *keys))
    vectors = np.random.default_rng(9).normal(size=(400, 30))
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    items, queries = frame(spark, vectors, "item_id"), frame(spark, vectors[:150], "query_id")
    search = Search(queries, items, 5, metric, skip_self=True, block_rows=1)
    assert rows_of(search.rows) == rows_of(nearest(queries, items, 5, metric, skip_self=True))
    assert sum(df.count() for df in sent[0::2]) <= 10 * 150 and all(df.count() <= 10 * 400 for df in sent[1::2])
    assert 0 < search.compared <= search.pairs
