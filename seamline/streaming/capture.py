"""Motion-gated capture as a stateful stream, with stabilisation and failure rules."""

from __future__ import annotations

import pickle
from collections.abc import Iterable, Iterator
from typing import Any, NamedTuple

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from seamline.operators.capture_rule import CaptureRule, StationState

STATE = "baseline binary, last_us long, pending_us long, pending binary, seen_us long, error string"
#: Frames of a station that arrived together, as one value: a value for each frame costs far more than the frame.
FRAMES = "frames binary"
OUTPUT = "station_id long, frame_seq long, ts timestamp, trigger_us long, error string"


class MotionCapture(StatefulProcessor):
    """One state row per station; frames of a micro-batch are put in time order first."""

    def __init__(self, rule: CaptureRule):
        self.rule = rule

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("station", STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frames = pd.concat(list(rows), ignore_index=True)
        yield self.captured(key, frames.sort_values(["ts_us", "frame_seq"]).itertuples(index=False))

    def captured(self, key, frames: Iterable, ordered: bool = False) -> pd.DataFrame:
        """Captures among frames in time order; with ``ordered`` none of them is late, whatever its time."""
        state = StationState(*(self.state.get() or ()))
        captures = []
        for frame in frames:
            trigger = state.pending_us
            signal = None if frame.signal is None else bytes(frame.signal)
            if ordered:
                state.seen_us = None
            if self.rule.step(state, int(frame.ts_us), bool(frame.readable), signal, frame.error):
                at = frame.ts_us if trigger is None else trigger
                captures.append((key[0], frame.frame_seq, frame.ts, at, state.error))
        self.state.update(tuple(vars(state).values()))
        return pd.DataFrame(captures, columns=["station_id", "frame_seq", "ts", "trigger_us", "error"])

    def close(self) -> None:
        pass


class OrderedCapture(MotionCapture):
    """Frames wait in a list until the watermark has passed them, and are then taken in time order.

    A timer stands at the earliest waiting frame of a station; the list holds what arrives within the lateness.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.handle = handle
        self.waiting = handle.getListState("waiting", FRAMES)

    def _await(self, ts_us: int) -> None:
        self.handle.registerTimer(-(-ts_us // 1000) + 1)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for frames in rows:
            columns = [frames[name] for name in WaitingFrame._fields]
            # a row without a number only tells the time
            kept = [
                (int(ts_us), int(seq), ts.to_pydatetime(), bool(readable), None if signal is None else bytes(signal), error)
                for ts_us, seq, ts, readable, signal, error in zip(*columns, strict=True)
                if not pd.isna(seq)
            ]
            if kept:
                self.waiting.appendValue((pickle.dumps(kept),))
                earliest = min(frame[0] for frame in kept)
                first = earliest if first is None else min(first, earliest)
        if first is not None:
            self._await(first)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        frames = [WaitingFrame(*frame) for chunk in self.waiting.get() for frame in pickle.loads(bytes(chunk[0]))]
        # a frame that was delivered again counts once
        ready = {(frame.ts_us, frame.frame_seq): frame for frame in frames if frame.ts_us <= passed}
        later = [frame for frame in frames if frame.ts_us > passed]
        if not ready:
            return
        if later:
            self.waiting.put([(pickle.dumps([tuple(frame) for frame in later]),)])
            self._await(min(frame.ts_us for frame in later))
        else:
            self.waiting.clear()
        captures = self.captured(key, [ready[at] for at in sorted(ready)], ordered=True)
        if len(captures):
            yield captures


class WaitingFrame(NamedTuple):
    ts_us: int
    frame_seq: int
    ts: Any
    readable: bool
    signal: bytes | None
    error: str | None


def capture_stream(
    signals: DataFrame, rule: CaptureRule | None = None, lateness: str = "10 seconds", ordered: bool = False
) -> DataFrame:
    """Captured frames of a stream of frame signals.

    With ``ordered`` a frame waits until the watermark has passed it, so that frames may arrive in any order within
    the lateness: the captures are those of all frames in time order (equal times by frame_seq). Captures then come
    that much later, and carry no watermark of their own. Frames later than the lateness are left out. At the end
    of a stream a row with a later time and a null frame_seq releases what still waits. Without ``ordered``, frames
    not later than the newest of their station are left out.

    ``signals``: station_id, frame_seq, ts, readable, signal, error — what ``frame_signals`` makes of
    frames, so that the pixel work is done before the keyed step and in parallel.
    """
    rows = signals.withWatermark("ts", lateness).withColumn("ts_us", F.unix_micros("ts"))
    keyed = rows.groupBy("station_id")
    return keyed.transformWithStateInPandas(
        statefulProcessor=(OrderedCapture if ordered else MotionCapture)(rule or CaptureRule()),
        outputStructType=OUTPUT,
        outputMode="Append",
        timeMode="EventTime",
        **({} if ordered else {"eventTimeColumnName": "ts"}),
    )
