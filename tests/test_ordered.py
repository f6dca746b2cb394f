import numpy as np
import pandas as pd
import pytest

from seamline.functions.scores import normalised_score
from seamline.operators import capture, dataset
from seamline.operators.ordered import ordered_runs, with_history
from seamline.operators.quantiles import exact_percentile


@pytest.fixture(scope="module")
def rows():
    """One key holds most rows."""
    rng = np.random.default_rng(7)
    key = np.where(rng.random(600) < 0.6, 0, rng.integers(1, 30, 600))
    return pd.DataFrame({"key": key, "ts": rng.integers(0, 400, 600), "id": np.arange(600), "v": rng.integers(0, 9, 600)})


@pytest.mark.parametrize("runs", [1, 5, 40])
def test_lag_and_running_sum(spark, rows, runs):
    ordered = ordered_runs(spark.createDataFrame(rows), ["key"], ["ts", "id"], runs)
    summed = with_history(ordered, ["key"], ["ts", "id"], ["v"], "before", {"v": "total"})
    found = summed.select("id", "before.v", "total").toPandas().sort_values("id")
    expected = rows.sort_values(["key", "ts", "id"])
    expected = expected.assign(
        before=expected.groupby("key")["v"].shift(), total=expected.groupby("key")["v"].cumsum()
    ).sort_values("id")
    assert found["total"].tolist() == expected["total"].tolist()
    assert found["v"].fillna(-1).tolist() == expected["before"].fillna(-1).tolist()


@pytest.mark.parametrize("share", [0.0, 0.05, 0.5, 0.995, 1.0])
@pytest.mark.parametrize("runs", [1, 6, 50])
def test_exact_percentile(spark, rows, runs, share):
    found = exact_percentile(spark.createDataFrame(rows), ["key"], "v", "id", share, runs=runs)
    got = {r.key: (r.percentile, r.n, r.min_value, r.max_value) for r in found.collect()}
    for key, part in rows.groupby("key"):
        value, n, low, high = got[key]
        assert value == pytest.approx(np.percentile(part["v"], share * 100))
        assert (n, low, high) == (len(part), part["v"].min(), part["v"].max())


@pytest.mark.parametrize("most_ranges", [0, 100], ids=["runs", "bins"])
def test_exact_percentile_of_odd_values(spark, most_ranges):
    rng = np.random.default_rng(9)
    groups = {
        1: [5.0] * 40, 2: [1e308, -1e308, 0.0, 5e-324], 3: np.exp(rng.normal(size=500) * 60).tolist(), 4: [0.1 + 0.2, 0.3, 0.1 + 0.2],
        None: [-3.0, 4.0], 5: [1.0, None, 2.0], 6: [7.0],
    }
    rows = [(k, k and k * 1000 + i, v) for k, values in groups.items() for i, v in enumerate(values)]
    frame = spark.createDataFrame([(a, b if b is not None else i, c) for i, (a, b, c) in enumerate(rows)], "key long, id long, v double")
    for share in (0.0, 0.3):
        found = {r.key: r for r in exact_percentile(frame, ["key"], "v", "id", share, most_ranges=most_ranges).collect()}
        assert set(found) == set(groups)
        for key, values in groups.items():
            known = [v for v in values if v is not None]
            assert found[key].percentile == pytest.approx(np.percentile(known, share * 100)) and found[key].n == len(known)


def test_infinite_values_and_no_rows(spark):
    frame = spark.createDataFrame([(1, k, v) for k, v in enumerate([1.0, float("inf"), 2.0])], "key long, id long, v double")
    assert [r.percentile for r in exact_percentile(frame, ["key"], "v", "id", 0.5).collect()] == [2.0]
    assert exact_percentile(frame.limit(0), ["key"], "v", "id", 0.5).collect() == []


def test_no_value_is_shuffled(spark):
    frame = spark.range(50_000).selectExpr("id % 7 AS key", "id", "rand(3) AS v")
    plan = exact_percentile(frame, ["key"], "v", "id", 0.9)._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan


@pytest.mark.parametrize("runs", [1, 9])
def test_sessions_and_split(spark, rows, runs):
    found = dataset.sequence_split(spark.createDataFrame(rows), ["key"], "ts", "id", 3, runs).toPandas()
    expected = rows.sort_values(["key", "ts", "id"])
    starts = ~(expected.groupby("key")["ts"].diff() <= 3)
    expected = expected.assign(session=starts.groupby(expected["key"]).cumsum()).sort_values("id")
    found = found.sort_values("id")
    assert found["session"].tolist() == expected["session"].tolist()
    assert found.groupby("sequence")["split"].nunique().max() == 1


def test_split_is_stable_under_repartitioning(spark):
    from pyspark.sql import functions as F

    from seamline.functions.hashing import hash_split, holdout_split

    keys = spark.range(2000).select(F.col("id").cast("string").alias("k"))
    def split(df):
        return {r.k: (r.a, r.b) for r in df.select("k", hash_split(F.col("k")).alias("a"), holdout_split(F.col("k")).alias("b")).collect()}

    first, second = split(keys), split(keys.repartition(7))
    assert first == second
    shares = pd.Series([a for a, _ in first.values()]).value_counts(normalize=True)
    assert abs(shares["train"] - 0.7) < 0.05 and abs(shares["val"] - 0.2) < 0.05
    held = pd.Series([b for _, b in first.values()]).value_counts(normalize=True)
    assert abs(held["train"] - 0.8) < 0.05 and abs(held["val"] - held["test"]) < 0.05


@pytest.mark.parametrize("runs", [1, 4])
def test_null_keys_are_a_key(spark, runs):
    rows = [(k, t * 5_000_000, 100 * (k or 7) + t, t % 2) for k in (None, 1) for t in range(1, 6)]
    frames = spark.createDataFrame(rows, "key long, ts long, id long, v long")
    kept = dataset.sessions(frames, ["key"], "ts", "id", 6_000_000, runs).collect()
    assert len(kept) == 10 and {r.session for r in kept} == {1}
    found = {r.key: r.n for r in exact_percentile(frames, ["key"], "v", "id", 0.5, runs=runs).collect()}
    assert found == {None: 5, 1: 5}
    for cooldown in (0, 1_000_000):
        taken = capture.auto_captures(frames, "key", "ts", "id", "v", lambda a, b: a != b, cooldown, runs).collect()
        assert sorted(r.id for r in taken) == [102, 104, 702, 704]


def test_equal_bounds_scale_to_a_side(spark):
    from pyspark.sql import functions as F

    scored = spark.createDataFrame([(0.2,), (0.5,), (0.9,)], "s double")
    scaled = scored.select(normalised_score(F.col("s"), F.lit(0.5), F.lit(0.5), F.lit(0.5)).alias("x"))
    assert [r.x for r in scaled.collect()] == [0.0, 0.5, 1.0]
