"""A minimal perfect hash of 64-bit keys, built and probed with whole arrays.

Level by level, keys that land alone in a bitmap stay there and the others move on to the next bitmap; the
number of a key is the rank of its bit. Keys that survive every level are kept sorted behind the bitmaps.
"""

from __future__ import annotations

import numpy as np

from seamline.llm.texts import mixed

LEVELS = 24


def _places(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    return (mixed(keys + np.uint64((level + 1) * 0x9E3779B97F4A7C15 % (1 << 64))) % np.uint64(size)).astype(np.int64)


class PerfectHash:
    """Numbers 0..n-1 of n distinct keys; for other keys any number, or -1."""

    def __init__(self, levels: list[np.ndarray], rest: np.ndarray):
        self.levels, self.rest = levels, rest
        self._ranks, total = [], 0
        for bits in levels:
            self._ranks.append(np.cumsum(bits) - bits + total)
            total += int(bits.sum())
        self._total = total

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        left, levels = keys, []
        while len(left) and len(levels) < LEVELS:
            size = max(64, 2 * len(left))
            places = _places(left, len(levels), size)
            alone = np.bincount(places, minlength=size) == 1
            levels.append(alone)
            left = left[~alone[places]]
        return cls(levels, np.sort(left))

    def find(self, keys: np.ndarray) -> np.ndarray:
        out = np.full(len(keys), -1, np.int64)
        todo = np.arange(len(keys))
        for level, bits in enumerate(self.levels):
            places = _places(keys[todo], level, len(bits))
            here = bits[places]
            out[todo[here]] = self._ranks[level][places[here]]
            todo = todo[~here]
        if len(self.rest) and len(todo):
            at = np.minimum(np.searchsorted(self.rest, keys[todo]), len(self.rest) - 1)
            here = self.rest[at] == keys[todo]
            out[todo[here]] = self._total + at[here]
        return out

    def dump(self) -> list[bytes]:
        return [np.packbits(bits).tobytes() + len(bits).to_bytes(8, "little") for bits in self.levels] + [self.rest.tobytes()]

    @classmethod
    def load(cls, parts: list[bytes]) -> PerfectHash:
        levels = [np.unpackbits(np.frombuffer(p[:-8], np.uint8), count=int.from_bytes(p[-8:], "little")).astype(bool) for p in parts[:-1]]
        return cls(levels, np.frombuffer(parts[-1], np.uint64))
