"""Captures of stored frames and of frames out of order, against the plain fold."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from seamline.operators import capture
from seamline.operators.capture import auto_captures, stored_outcomes
from seamline.operators.capture_rule import CaptureRule, StationState
from seamline.streaming.capture import capture_stream

SECOND = 1_000_000


def _motion():
    def byte_motion(before, after):  # a local function goes to the workers by value
        return abs(before[0] - after[0]) > 40

    return byte_motion


byte_motion = _motion()


def fold(rows, rule):
    """(ts, seq, outcome, trigger) of the frames (ts, seq, readable, signal, error) of one station."""
    state, found = StationState(), []
    for ts, seq, readable, signal, error in rows:
        trigger, state.seen_us = state.pending_us, None
        outcome = rule.advance(state, ts, readable, signal, error)
        if outcome:
            found.append((ts, seq, outcome, trigger if trigger is not None else ts if outcome == "captured" else None))
    return found


def some_frames(seed, count=700, stations=4):
    """One station has most frames; some frames share a time, are unreadable or have a problem."""
    rng = np.random.default_rng(seed)
    station = np.where(rng.random(count) < 0.6, 0, rng.integers(0, stations, count))
    ts = np.cumsum(rng.choice([0, 1, 1, 2, 25], count)) * SECOND
    readable = rng.random(count) > 0.15
    signal = [bytes([v]) if ok and v % 11 else None for v, ok in zip(rng.integers(0, 100, count), readable)]
    error = ["broken" if ok and s is None else None for ok, s in zip(readable, signal)]
    return pd.DataFrame({"station_id": station, "ts_us": ts, "seq": np.arange(count), "readable": readable, "signal": signal, "error": error})


SCHEMA = "station_id long, ts_us long, seq long, readable boolean, signal binary, error string"


def expected_outcomes(frames, rule):
    out = []
    for station, part in frames.groupby("station_id", dropna=False):
        rows = part.sort_values(["ts_us", "seq"])[["ts_us", "seq", "readable", "signal", "error"]].itertuples(index=False)
        out += [(station, *found) for found in fold(list(rows), rule)]
    return sorted(out, key=lambda r: r[2])


@pytest.mark.parametrize(("runs", "cooldown", "still"), [(1, 9, 2), (60, 0, None), (25, 9, 2), (4, 400, 30)])
def test_stored_outcomes_equal_the_fold(spark, runs, cooldown, still):
    frames = some_frames(runs + cooldown)
    rule = CaptureRule(byte_motion, cooldown * SECOND, still and still * SECOND)
    found = stored_outcomes(spark.createDataFrame(frames, SCHEMA), "station_id", "ts_us", "seq", rule, runs)
    rows = sorted((tuple(r) for r in found.collect()), key=lambda r: r[2])
    assert rows == expected_outcomes(frames, rule)
    assert {r[3] for r in rows} >= {"captured", "unreadable", "problem"}


def test_stations_without_name_and_without_frames(spark):
    frames = spark.createDataFrame(some_frames(1, 90), SCHEMA).withColumn("station_id", F.when(F.col("station_id") > 0, F.col("station_id")))
    rule = CaptureRule(byte_motion, 0, SECOND)
    rows = stored_outcomes(frames, "station_id", "ts_us", "seq", rule, 8).collect()
    assert any(r.station_id is None and r.outcome == "captured" for r in rows)
    assert stored_outcomes(frames.limit(0), "station_id", "ts_us", "seq", rule).collect() == []


@pytest.mark.parametrize(("cooldown", "runs"), [(0, 100), (7, 100), (300, 70), (5000, 20)])
def test_linking_up_a_tree_equals_the_fold(spark, monkeypatch, cooldown, runs):
    """One station holds all frames; parts are put together two or three at a time."""
    monkeypatch.setattr(capture, "FAN", 3 if runs == 70 else 2)
    rng = np.random.default_rng(runs + cooldown)
    ts = np.cumsum(rng.choice([1, 1, 2, 30], 900)) * SECOND
    frames = pd.DataFrame({"station_id": 5, "ts_us": ts, "seq": np.arange(900), "value": rng.integers(0, 100, 900).astype(float)})
    rule = CaptureRule(lambda a, b: abs(a - b) > 40, cooldown * SECOND, None)
    expected = [r[1] for r in fold([(r.ts_us, r.seq, True, r.value, None) for r in frames.itertuples()], rule)]
    found = auto_captures(spark.createDataFrame(frames), "station_id", "ts_us", "seq", "value", lambda a, b: F.abs(b - a) > 40, cooldown * SECOND, runs)
    assert sorted(r.seq for r in found.collect()) == expected


@pytest.mark.parametrize("order", ["in time", "late", "twice"])
def test_frames_in_any_order_give_the_same_captures(spark, tmp_path, order):
    rng = np.random.default_rng(2)
    count = 120
    ts = np.cumsum(rng.integers(1, 4, count))
    table = pd.DataFrame({
        "station_id": rng.integers(0, 2, count), "frame_seq": np.arange(count), "ts": pd.Timestamp("2024-01-01") + pd.to_timedelta(ts, "s"),
        "readable": rng.random(count) > 0.1, "level": rng.integers(0, 100, count), "error": None,
    })
    table["signal"] = [bytes([v]) if ok else None for v, ok in zip(table["level"], table["readable"])]
    rule = CaptureRule(byte_motion, 9 * SECOND, 2 * SECOND)
    expected = []
    for _, part in table.groupby("station_id"):
        times = part["ts"].astype("datetime64[us]").astype("int64")
        expected += [r[1] for r in fold(list(zip(times, part["frame_seq"], part["readable"], part["signal"], part["error"])), rule) if r[2] == "captured"]
    columns = ["station_id", "frame_seq", "ts", "readable", "signal", "error"]
    arrival = table.iloc[np.argsort(ts + (0 if order == "in time" else rng.integers(0, 50, count)), kind="stable")][columns]
    files = [arrival.iloc[:40], arrival.iloc[40:80], arrival.iloc[80:]]
    if order == "twice":
        files.insert(1, files[0].iloc[::-1])
    clock = pd.DataFrame([(9, None, table["ts"].max() + pd.Timedelta("1h") * k, False, None, None) for k in (1, 2)], columns=columns)
    folder = str(tmp_path / "in")
    schema = "station_id long, frame_seq long, ts timestamp, readable boolean, signal binary, error string"
    for part in [*files, clock.iloc[:1], clock.iloc[1:]]:
        rows = [tuple(None if v is None or v is pd.NA or (not isinstance(v, bytes) and pd.isna(v)) else v for v in r) for r in part.itertuples(index=False)]
        rows = [(int(a), None if b is None else int(b), c.to_pydatetime(), bool(d), e, f) for a, b, c, d, e, f in rows]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    query = (
        capture_stream(stream, rule, "60 seconds", ordered=True).writeStream.format("parquet").option("path", str(tmp_path / "out"))
        .option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    found = [r.frame_seq for r in spark.read.parquet(str(tmp_path / "out")).collect()]
    assert sorted(found) == sorted(expected) and len(expected) > 3
