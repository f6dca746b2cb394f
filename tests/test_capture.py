import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from seamline.operators.capture import auto_captures, motion_candidates
from seamline.streaming.capture import CaptureRule, StationState, capture_stream

SECOND = 1_000_000


def fold(rows, rule):
    """Frames (ts_us, seq, readable, signal) of one station, one after the other."""
    state, taken = StationState(), []
    for ts, seq, readable, signal in rows:
        if rule.step(state, ts, readable, signal):
            taken.append(seq)
    return taken, state


def differs(a, b):
    return abs(a - b) > 40


@pytest.fixture(scope="module")
def frames():
    """Station 0 has most frames, at very uneven intervals."""
    rng = np.random.default_rng(5)
    station = np.where(rng.random(1500) < 0.7, 0, rng.integers(1, 12, 1500))
    ts = np.cumsum(rng.choice([1, 1, 2, 30], 1500)) * SECOND
    return pd.DataFrame(
        {"station_id": station, "ts_us": ts, "seq": np.arange(1500), "value": rng.integers(0, 100, 1500).astype(float)}
    )


@pytest.mark.parametrize("runs", [1, 7, 60])
@pytest.mark.parametrize("cooldown", [0, 4, 45, 400])
def test_parallel_captures_equal_the_fold(spark, frames, runs, cooldown):
    rule = CaptureRule(differs, cooldown * SECOND, None)
    expected = []
    for _, part in frames.groupby("station_id"):
        ordered = part.sort_values("ts_us")
        expected += fold([(r.ts_us, r.seq, True, r.value) for r in ordered.itertuples()], rule)[0]
    found = auto_captures(
        spark.createDataFrame(frames), "station_id", "ts_us", "seq", "value",
        lambda a, b: F.abs(b - a) > 40, cooldown * SECOND, runs,
    )
    assert sorted(r.seq for r in found.collect()) == sorted(expected)


def test_motion_candidates(spark, frames):
    found = motion_candidates(
        spark.createDataFrame(frames), "station_id", "ts_us", "seq", "value", lambda a, b: F.abs(b - a) > 40, 9
    )
    ordered = frames.sort_values("ts_us")
    gap = ordered.groupby("station_id")["value"].diff().abs()
    assert sorted(r.seq for r in found.collect()) == sorted(ordered["seq"][gap > 40])


# --- rules, one by one ------------------------------------------------------------------------

RULE = CaptureRule(differs, 4 * SECOND, 600_000)


def at(second, signal, readable=True, _count=[0]):
    _count[0] += 1
    return (int(second * SECOND), int(second * 10), readable, signal)


def test_still_scene_is_never_captured():
    assert fold([at(i, 10) for i in range(20)], RULE)[0] == []


def test_capture_waits_for_a_stable_new_frame():
    taken, state = fold([at(0, 10), at(0.5, 90), at(1.0, 90), at(1.1, 90), at(1.6, 90)], RULE)
    assert taken == [11]
    assert state.last_us == 1_100_000 and state.baseline == 90  # 1.6 only seeded the comparison


def test_cooldown_counts_from_the_capture_and_may_be_met_exactly():
    first = [at(0, 10), at(0.5, 90), at(1.1, 90), at(1.6, 10)]
    inside = fold([*first, at(5.0, 90), at(6, 90)], RULE)[0]
    exact = fold([*first, at(5.1, 90), at(5.7, 90)], RULE)[0]
    assert inside == [11] and exact == [11, 57]


def test_unreadable_frame_keeps_the_comparison_and_reports():
    taken, state = fold([at(0, 10), at(0.5, None, False), at(1.0, 90), at(1.6, 90)], RULE)
    assert taken == [16] and state.error is None
    _, state = fold([at(0, 10), at(0.5, None, False), at(1.0, 10)], RULE)
    assert state.error == "Cámara no disponible." and state.baseline == 10


def test_failed_stable_frame_moves_on_without_cooldown():
    taken, state = fold([at(0, 10), at(0.5, 90), at(1.1, None, False), at(1.5, 10), at(2.1, 10)], RULE)
    assert taken == [21]


def test_problem_with_a_frame_keeps_the_comparison():
    state = StationState(baseline=10)
    RULE.step(state, SECOND, True, None, "broken")
    assert state.error == "broken" and state.baseline == 10


def test_late_frames_are_ignored():
    assert fold([at(0, 10), at(2, 10), at(1, 90), at(3, 10)], RULE)[0] == []


# --- the stream -------------------------------------------------------------------------------


def level(value):
    return None if value is None else bytes([int(value)]) * 4


@pytest.mark.parametrize("cuts", [1, 4])
@pytest.mark.parametrize("stabilisation", [None, 2 * SECOND])
def test_stream_equals_the_fold_for_any_batches(spark, tmp_path, cuts, stabilisation):
    def byte_motion(before, after):
        return abs(before[0] - after[0]) > 40

    rng = np.random.default_rng(cuts)
    count = 160
    table = pd.DataFrame(
        {
            "station_id": rng.integers(0, 3, count),
            "frame_seq": np.arange(count),
            "ts": pd.Timestamp("2024-01-01") + pd.to_timedelta(np.cumsum(rng.integers(1, 4, count)), "s"),
            "readable": rng.random(count) > 0.1,
            "level": rng.integers(0, 100, count),
        }
    )
    table["signal"] = [level(v) if ok else None for v, ok in zip(table["level"], table["readable"])]
    table["error"] = None
    schema = "station_id long, frame_seq long, ts timestamp, readable boolean, signal binary, error string"
    columns = ["station_id", "frame_seq", "ts", "readable", "signal", "error"]
    rule = CaptureRule(byte_motion, 9 * SECOND, stabilisation)
    expected = []
    for _, part in table.groupby("station_id"):
        times = part["ts"].astype("datetime64[us]").astype("int64")
        expected += fold(list(zip(times, part["frame_seq"], part["readable"], part["signal"])), rule)[0]
    folder = str(tmp_path / "in")
    for number, cut in enumerate(np.array_split(np.arange(count), cuts)):
        part = table.iloc[cut]
        rows = spark.createDataFrame(part[columns].sample(frac=1, random_state=1), schema)
        rows.coalesce(1).write.mode("append").parquet(f"{folder}/part={number}")
    name = f"captures_{cuts}_{'still' if stabilisation else 'now'}"
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/part=*")
    query = (
        capture_stream(stream, rule)
        .writeStream.format("memory").queryName(name).outputMode("append")
        .option("checkpointLocation", str(tmp_path / "state")).start()
    )
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    assert sorted(r.frame_seq for r in spark.table(name).collect()) == sorted(expected)
    assert len(expected) > 5
