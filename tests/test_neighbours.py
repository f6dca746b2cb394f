import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from seamline.operators import anomaly, identity
from seamline.operators.nearest import COSINE, EUCLIDEAN, nearest

BLOCKED = {"broadcast_bytes": 0, "block_rows": 17}


def unit(rng, n, d=8):
    vectors = rng.normal(size=(n, d)).astype(np.float32)
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


@pytest.fixture(scope="module")
def vectors():
    """Model ``a`` holds two thirds of the items."""
    rng = np.random.default_rng(11)
    items = unit(rng, 150)
    models = np.where(np.arange(150) % 3 < 2, "a", np.where(np.arange(150) % 2, "b", "c"))
    return items, models


def frame(spark, vectors, names=None, key="item_id"):
    data = {key: np.arange(len(vectors)), "embedding": list(vectors)}
    if names is not None:
        data["model_name"] = names
    kinds = f"{key} long, embedding array<float>" + (", model_name string" if names is not None else "")
    return spark.createDataFrame(pd.DataFrame(data), kinds)


@pytest.mark.parametrize("blocking", [{}, BLOCKED], ids=["broadcast", "blocks"])
@pytest.mark.parametrize("metric", [COSINE, EUCLIDEAN])
def test_nearest_matches_brute_force(spark, vectors, metric, blocking):
    items, models = vectors
    queries = frame(spark, items, key="query_id")
    found = nearest(
        queries, frame(spark, items, models), 4, metric, group="model_name", skip_self=True, **blocking
    ).toPandas()
    wide = items.astype(float)
    scores = wide @ wide.T if metric == COSINE else -np.linalg.norm(wide[:, None] - wide, axis=2)
    np.fill_diagonal(scores, -np.inf)
    for (query, model), part in found.groupby(["query_id", "model_name"]):
        own = np.flatnonzero(models == model)
        best = own[np.argsort(-scores[query, own], kind="stable")[:4]]
        assert set(part["item_id"]) == set(best)
        expected = np.sort(np.abs(scores[query, best]) if metric == EUCLIDEAN else scores[query, best])
        assert np.allclose(np.sort(part["score"]), expected)
    assert len(found) == 150 * 3 * 4


@pytest.mark.parametrize("blocking", [{}, BLOCKED], ids=["broadcast", "blocks"])
def test_ties_go_to_the_smaller_id(spark, blocking):
    items = np.tile(np.array([[1, 0]], np.float32), (60, 1))
    queries = frame(spark, items[:3], key="query_id")
    found = nearest(queries, frame(spark, items), 5, **blocking).toPandas()
    for _, part in found.groupby("query_id"):
        assert sorted(part["item_id"]) == [0, 1, 2, 3, 4]


@pytest.mark.parametrize("blocking", [{}, BLOCKED], ids=["broadcast", "blocks"])
def test_internal_scores_and_profiles(spark, vectors, blocking):
    items, models = vectors
    gallery = frame(spark, items, models)
    scores = identity.internal_scores(gallery, **blocking).toPandas().set_index("item_id")["score"].sort_index()
    wide = items.astype(float)
    for i in range(150):
        others = np.flatnonzero((models == models[i]) & (np.arange(150) != i))
        assert scores[i] == pytest.approx(np.sort(wide[others] @ wide[i])[-3:].mean())
    found = {r.model_name: r for r in identity.profiles(gallery, **blocking).collect()}
    for model in "abc":
        own = scores[models == model]
        assert found[model].threshold == pytest.approx(np.clip(np.percentile(own, 5) - 0.04, 0.72, 0.90))
        assert found[model].n == len(own)
        assert (found[model].min_sim, found[model].mean_sim) == pytest.approx((own.min(), own.mean()))


def test_models_with_too_few_images_have_no_profile(spark):
    vectors = unit(np.random.default_rng(0), 19)
    gallery = frame(spark, vectors, ["big"] * 10 + ["small"] * 9)
    assert [r.model_name for r in identity.profiles(gallery).collect()] == ["big"]


def test_fewer_references_than_k(spark):
    items = np.array([[1, 0], [0, 1]], np.float32)
    found = identity.similarity(frame(spark, items[:1], key="query_id"), frame(spark, items, ["m", "m"]))
    assert found.first().similarity == pytest.approx(0.5)


def test_identify_compares_before_rounding(spark):
    items = np.tile(np.array([[1, 0]], np.float32), (3, 1))
    near = np.array([[0.74996, 0.0], [0.75, 0.0], [0.9, 0.0]], np.float32)
    profile = spark.createDataFrame([("m", 0.75)], "model_name string, threshold double")
    found = identity.identify(frame(spark, near, key="query_id"), frame(spark, items, ["m"] * 3), profile)
    rows = {r.query_id: r for r in found.collect()}
    assert (rows[0].identified, rows[0].similarity, rows[0].result) == (False, 0.75, "prenda_no_identificada")
    assert rows[0].model_name is None
    assert (rows[1].identified, rows[1].result) == (True, "m")
    assert rows[2].similarity == 0.9


def test_best_passing_model_wins(spark):
    items = np.array([[1, 0], [0.6, 0.8]], np.float32)
    profile = spark.createDataFrame([("strict", 0.99), ("loose", 0.5)], "model_name string, threshold double")
    query = frame(spark, np.array([[0.98, 0.199]], np.float32), key="query_id")
    assert identity.identify(query, frame(spark, items, ["strict", "loose"]), profile).first().result == "loose"


@pytest.mark.parametrize("blocking", [{}, BLOCKED], ids=["broadcast", "blocks"])
def test_image_scores(spark, vectors, blocking):
    bank, rng = vectors[0][:60].astype(float), np.random.default_rng(2)
    patches = unit(rng, 24)
    rows = frame(spark, patches, key="patch_id").withColumn("image_id", F.expr("patch_id div 6"))
    found = anomaly.image_scores(rows, frame(spark, vectors[0][:60]), neighbours=5, **blocking)
    got = {r.image_id: r for r in found.collect()}
    gaps = np.linalg.norm(patches.astype(float)[:, None] - bank, axis=2)
    for image in range(4):
        own = np.arange(image * 6, image * 6 + 6)
        patch = own[gaps[own].min(axis=1).argmax()]
        match = gaps[patch].argmin()
        around = np.argsort(np.linalg.norm(bank - bank[match], axis=1))[:5]
        weight = 1 - np.exp(gaps[patch, match]) / np.exp(gaps[patch, around]).sum()
        assert got[image].patch_id == patch
        assert got[image].pred_score == pytest.approx(weight * gaps[patch, match])


def cover(points, chosen):
    return np.linalg.norm(points[:, None] - points[chosen], axis=2).min(axis=1).max()


@pytest.mark.parametrize("block_rows", [4096, 60])
def test_coreset_covers_the_bank(spark, block_rows):
    points = np.random.default_rng(4).normal(size=(400, 3)).astype(np.float32)
    found = anomaly.coreset(frame(spark, points), 0.1, block_rows=block_rows).toPandas()
    chosen = found["item_id"].to_numpy()
    assert abs(len(chosen) - 40) <= 8 and len(set(chosen)) == len(chosen)
    greedy = [0]
    while len(greedy) < 40:
        greedy.append(int(np.linalg.norm(points[:, None] - points[greedy], axis=2).min(axis=1).argmax()))
    assert cover(points, chosen) <= 3 * cover(points, greedy)
    if block_rows == 4096:
        assert set(chosen) == set(greedy)


def test_patch_maps(spark):
    patches = spark.createDataFrame([(1, i, 10 + i) for i in range(4)], "image_id long, patch_no int, patch_id long")
    distances = spark.createDataFrame([(10, 0.5), (12, 0.25), (13, 1.0)], "patch_id long, distance double")
    row = anomaly.patch_maps(patches, distances, 2, 2).first()
    assert (row.height, row.width, row.map) == (2, 2, [0.5, None, 0.25, 1.0])
    with pytest.raises(Exception, match="outside the grid"):
        anomaly.patch_maps(patches, distances, 1, 2).collect()


@pytest.mark.parametrize("vectors", [[[1.0, 2.0, 3.0], [9.0]], [[1.0, 2.0], None], [[1.0, float("nan")], [1.0, 2.0]], [[1.0, None], [1.0, 2.0]]])
@pytest.mark.parametrize("limit", [0, 1 << 20])
def test_other_vectors_are_refused(spark, vectors, limit):
    items = spark.createDataFrame([(k, v) for k, v in enumerate(vectors)], "item_id long, embedding array<float>")
    queries = spark.createDataFrame([(9, [1.0] * max(len(v or []) for v in vectors))], "query_id long, embedding array<float>")
    with pytest.raises(Exception, match="not a vector of"):
        nearest(queries, items, 1, broadcast_bytes=limit).collect()


def test_vectors(spark):
    from seamline.functions.vectors import dot, euclidean, l2_normalise

    row = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0])], "a array<float>, b array<float>")
    got = row.select(
        l2_normalise(F.col("a")).alias("unit"), l2_normalise(F.col("b")).alias("zero"),
        dot(F.col("a"), F.col("a")).alias("dot"), euclidean(F.col("a"), F.col("b")).alias("gap"),
    ).first()
    assert got.unit == pytest.approx([0.6, 0.8]) and got.zero == [0.0, 0.0]
    assert (got.dot, got.gap) == (25.0, 5.0)
