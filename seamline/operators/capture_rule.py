"""The rule that turns the frames of one station into captures, as an automaton over frames in time order."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from seamline import schema as S
from seamline.operators.images import MOTION_PIXELS, changed_pixels

# --- fixed values -----------------------------------------------------------------------------
COOLDOWN_US, STABILISATION_US = 4_000_000, 600_000
# --- end of fixed values ----------------------------------------------------------------------

#: What a frame can come to: captured, not readable, not readable when the scene should be stable, or not comparable.
CAPTURED, UNREADABLE, FAILED_READ, PROBLEM = "captured", "unreadable", "failed_read", "problem"


def pixel_motion(before: bytes, after: bytes) -> bool:
    return changed_pixels(before, after) > MOTION_PIXELS


@dataclass
class StationState:
    """What a station remembers between frames; a stream keeps them in this order."""

    baseline: Any = None
    last_us: int | None = None
    pending_us: int | None = None
    pending: Any = None
    seen_us: int | None = None
    error: str | None = None


@dataclass(frozen=True)
class CaptureRule:
    """Cooldown, stabilisation (None: the moving frame itself is taken) and the motion test."""

    moved: Callable[[Any, Any], bool] = pixel_motion
    cooldown_us: int = COOLDOWN_US
    stabilisation_us: int | None = STABILISATION_US

    def step(self, state: StationState, ts_us: int, readable: bool, signal: Any, problem: str | None = None) -> bool:
        """Advance by one frame; true when this frame is captured."""
        return self.advance(state, ts_us, readable, signal, problem) == CAPTURED

    def advance(self, state: StationState, ts_us: int, readable: bool, signal: Any, problem: str | None = None) -> str | None:
        """Advance by one frame; what it came to, if anything."""
        if state.seen_us is not None and ts_us <= state.seen_us:
            return None
        state.seen_us = ts_us
        if state.pending_us is not None:
            return self._stable(state, ts_us, readable)
        if not readable or signal is None:
            state.error = (problem or S.CAMERA_ERROR) if readable else S.CAMERA_ERROR
            return PROBLEM if readable else UNREADABLE
        if state.baseline is None:
            state.baseline = signal
            return None
        try:
            moving = self.moved(state.baseline, signal)
        except ValueError as failure:
            state.error = str(failure)
            return PROBLEM
        rested = state.last_us is None or ts_us - state.last_us >= self.cooldown_us
        if not (moving and rested):
            state.baseline = signal
            return None
        if self.stabilisation_us is None:
            return self._take(state, ts_us)
        state.pending_us, state.pending = ts_us, signal
        return None

    def _stable(self, state: StationState, ts_us: int, readable: bool) -> str | None:
        if ts_us < state.pending_us + self.stabilisation_us:
            return None
        signal, state.pending_us, state.pending = state.pending, None, None
        if readable:
            return self._take(state, ts_us)
        state.baseline = signal
        return FAILED_READ

    @staticmethod
    def _take(state: StationState, ts_us: int) -> str:
        state.baseline, state.error, state.last_us = None, None, ts_us
        return CAPTURED
