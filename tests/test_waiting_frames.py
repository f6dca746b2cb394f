"""Frames that wait for the watermark: what a station's state is asked for, and in which order the frames are taken."""

import pandas as pd

from seamline.operators.capture_rule import CaptureRule
from seamline.streaming.capture import OrderedCapture


class Handle:
    """State of one station in memory, with the number of values that were handed over to it."""

    def __init__(self):
        self.value, self.values, self.timers, self.written = None, [], [], 0

    def getValueState(self, name, schema):
        return State(self)

    def getListState(self, name, schema):
        return Waiting(self)

    def registerTimer(self, at):
        self.timers.append(at)


class State:
    def __init__(self, handle):
        self.handle = handle

    def exists(self):
        return self.handle.value is not None

    def get(self):
        return self.handle.value

    def update(self, value):
        self.handle.value = value


class Waiting:
    def __init__(self, handle):
        self.handle = handle

    def get(self):
        return iter(self.handle.values)

    def appendValue(self, value):
        self.appendList([value])

    def appendList(self, values):
        self.handle.values += values
        self.handle.written += len(values)

    def put(self, values):
        self.handle.values = []
        self.appendList(values)

    def clear(self):
        self.handle.values = []


class Clock:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):
        return self.ms


def frames(numbers):
    seconds = list(numbers)
    return pd.DataFrame({
        "station_id": 7, "frame_seq": pd.array([s if s >= 0 else None for s in seconds], "Int64"),
        "ts": [pd.Timestamp(abs(s), unit="s") for s in seconds], "ts_us": [abs(s) * 1_000_000 for s in seconds],
        "readable": True, "signal": [str(s % 3).encode() for s in seconds], "error": None,
    })


def test_frames_that_arrive_together_are_one_value():
    handle, processor = Handle(), OrderedCapture(CaptureRule(lambda a, b: a != b, 0, None))
    processor.init(handle)
    list(processor.handleInputRows((7,), iter([frames([*range(40, 0, -1), -90])]), Clock(0)))
    assert handle.written == 1 and handle.timers == [1001]
    list(processor.handleInputRows((7,), iter([frames([0, 5, 5])]), Clock(0)))  # late, and delivered again
    taken = pd.concat(processor.handleExpiredTimer((7,), Clock(20_000), None))
    assert handle.written == 3 and handle.timers[-1] == 21_001  # what still waits is one value again
    taken = pd.concat([taken, *processor.handleExpiredTimer((7,), Clock(50_000), None)])
    # every second frame differs from the one before it, which it is compared with
    assert taken["frame_seq"].tolist() == list(range(1, 41, 2)) and not handle.values
