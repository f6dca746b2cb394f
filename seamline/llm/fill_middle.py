"""Fill-in-the-middle forms of whole texts, cut between code points.

Method: the byte offsets of all code-point boundaries of a block of texts are learnt as a piecewise-linear
function of their rank. Each segment predicts its boundaries to within a fixed error, and the residuals of that
prediction are stored, one byte a boundary. A cut is looked up by its segment, predicted and corrected exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seamline.llm.texts import encoded, pieces

#: The marks of the three parts.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Shares of a hundred: texts that are not left as they are, and the suffix-first form among them.
TURNED, SUFFIX_FIRST = 90, 20
#: Largest error of a segment, so that a residual fits one byte.
ERROR = 127
#: Bytes of text that are indexed at once; a longer text is indexed block by block.
BLOCK = 1 << 20
_MARKS = [mark.encode() for mark in (PREFIX, SUFFIX, MIDDLE)]


class RankIndex:
    """Byte offset of every code-point boundary of ``data`` by its rank; the end of the data is the last one.

    Segments are grown greedily: one starts at a boundary and goes on while some slope through its start stays
    within ``error`` of every boundary on the way.
    """

    def __init__(self, data: np.ndarray, error: int = ERROR):
        offsets = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
        starts, slopes, at = [], [], 0
        while at < len(offsets):
            end, slope = self._segment(offsets, at, error)
            starts.append(at)
            slopes.append(slope)
            at = end
        self.starts, self.slopes = np.array(starts, np.int64), np.array(slopes)
        self.bases = offsets[self.starts]
        self.boundaries = len(offsets)
        self.residuals = (offsets - self._predicted(np.arange(len(offsets)))).astype(np.int8)

    @staticmethod
    def _segment(offsets: np.ndarray, at: int, error: int) -> tuple[int, float]:
        """Where the segment from ``at`` ends, and its slope; windows double until a boundary is out of reach."""
        low, high, slope, done, size = 0.0, np.inf, 1.0, at + 1, 64
        room = error - 1  # predictions are rounded down
        while done < len(offsets):
            part = np.arange(done, min(done + size, len(offsets)))
            run, rise = part - at, offsets[part] - offsets[at]
            lows = np.maximum(np.maximum.accumulate((rise - room) / run), low)
            highs = np.minimum(np.minimum.accumulate((rise + room) / run), high)
            out = np.flatnonzero(lows > highs)
            inside = int(out[0]) if len(out) else len(part)
            if inside:
                low, high = float(lows[inside - 1]), float(highs[inside - 1])
                slope = (low + high) / 2
                done += inside
            if len(out):
                break
            size *= 2
        return done, slope

    def _predicted(self, ranks: np.ndarray) -> np.ndarray:
        segment = np.searchsorted(self.starts, ranks, "right") - 1
        return self.bases[segment] + np.floor(self.slopes[segment] * (ranks - self.starts[segment])).astype(np.int64)

    def offsets(self, ranks: np.ndarray) -> np.ndarray:
        """Exact offsets of the boundaries of these ranks."""
        return self._predicted(ranks) + self.residuals[ranks]


class TextIndex:
    """Rank indexes of consecutive blocks of about BLOCK bytes; no block ends inside a code point."""

    def __init__(self, data: np.ndarray):
        ends = []
        for at in range(BLOCK, len(data), BLOCK):
            while (data[at] & 0xC0) == 0x80:
                at -= 1
            ends.append(at)
        self.starts = np.array([0, *ends], np.int64)
        self.blocks = [RankIndex(data[a:b]) for a, b in zip(self.starts.tolist(), [*ends, len(data)], strict=True)]
        self.firsts = np.concatenate(([0], np.cumsum([block.boundaries - 1 for block in self.blocks])[:-1]))

    def offsets(self, ranks: np.ndarray) -> np.ndarray:
        of = np.searchsorted(self.firsts, ranks, "right") - 1
        out = np.empty(len(ranks), np.int64)
        for k in np.unique(of).tolist():
            here = of == k
            out[here] = self.starts[k] + self.blocks[k].offsets(ranks[here] - self.firsts[k])
        return out


def _numbers(ids: list, seed: int) -> np.ndarray:
    """The first four 32-bit numbers of each id's digest."""
    digests = [sha256(f"{seed}:{'' if doc is None else doc}".encode()).digest()[:16] for doc in ids]
    return np.frombuffer(b"".join(digests), ">u4").reshape(-1, 4).astype(np.int64)


def _formed(schema: T.StructType, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            keys = _numbers(batch.column(names.index("doc_id")).to_pylist(), seed)
            texts = [encoded(t) for t in batch.column(names.index("text")).to_pylist()]
            at = 0
            for part in pieces(texts, list(map(len, texts)), BLOCK) if texts else ():
                rows = batch.slice(at, len(part))
                n, forms, prefixes, middles, outputs = _turned(part, keys[at : at + len(part)])
                at += len(part)
                new = [pa.array(n, pa.int64()), pa.array(forms, pa.string()), pa.array(prefixes, pa.int64()), pa.array(middles, pa.int64())]
                yield pa.record_batch([*rows.columns, *new, pa.array(outputs, pa.binary()).cast(pa.string())], names=schema.names)

    return run


def _turned(texts: list[bytes], keys: np.ndarray) -> tuple[list, list, list, list, list]:
    """n, form, prefix_chars, middle_chars and output of each text."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    sizes = np.array(list(map(len, texts)), np.int64)
    starts = np.cumsum(sizes) - sizes
    leading = np.append((data & 0xC0) != 0x80, False).view(np.int8)
    n = np.where(sizes > 0, np.add.reduceat(leading, starts, dtype=np.int64), 0)
    cut = keys[:, :2] % (n + 1)[:, None]
    first, second = cut.min(axis=1), cut.max(axis=1)
    plain = (n == 0) | (keys[:, 2] % 100 >= TURNED) | np.array([any(mark in text for mark in _MARKS) for text in texts], bool)
    spm = keys[:, 3] % 100 < SUFFIX_FIRST
    turned = np.flatnonzero(~plain)
    places = np.zeros((2, len(texts)), np.int64)
    if len(turned):
        before = (np.cumsum(n) - n)[turned]
        found = TextIndex(data).offsets(np.concatenate((before + first[turned], before + second[turned])))
        places[:, turned] = found.reshape(2, -1) - starts[turned]
    forms, prefixes, middles, outputs = [], [], [], []
    p, s, m = _MARKS
    for k, text in enumerate(texts):
        if plain[k]:
            forms.append("plain")
            prefixes.append(None)
            middles.append(None)
            outputs.append(text)
            continue
        a, b = int(places[0, k]), int(places[1, k])
        prefixes.append(int(first[k]))
        middles.append(int(second[k] - first[k]))
        if spm[k]:
            forms.append("spm")
            outputs.append(b"".join((s, text[b:], p, text[:a], m, text[a:b])))
        else:
            forms.append("psm")
            outputs.append(b"".join((p, text[:a], s, text[b:], m, text[a:b])))
    return n.tolist(), forms, prefixes, middles, outputs


def fill_in_middle(docs: DataFrame, seed: int = 1) -> DataFrame:
    """``docs`` with columns n (code points), form, prefix_chars, middle_chars and output of each whole ``text``.

    Four 32-bit numbers come from the SHA-256 of ``<seed>:<doc_id>``. The first two choose the cuts, the third
    whether the text is turned at all, the fourth which form it takes: psm is ``<P>prefix<S>suffix<M>middle``,
    spm is ``<S>suffix<P>prefix<M>middle``. Plain are empty texts, texts that hold one of the marks, and a tenth
    of all others; their output is the text, and their prefix_chars and middle_chars are null.

    A null text counts as empty. A null id counts as an empty string. Rows that repeat an id are cut alike as far
    as their lengths agree. Columns with the names of the results are replaced, all others are passed on. An
    empty table gives an empty result.
    """
    docs = docs.drop("n", "form", "prefix_chars", "middle_chars", "output")
    added = [("n", T.LongType()), ("form", T.StringType()), ("prefix_chars", T.LongType()), ("middle_chars", T.LongType()), ("output", T.StringType())]
    schema = T.StructType([*docs.schema.fields, *[T.StructField(name, kind) for name, kind in added]])
    return docs.mapInArrow(_formed(schema, seed), schema)


def restored(output: str = "output", form: str = "form") -> Column:
    """The text that an output stands for; the marks of a form that is not plain occur once each."""
    out, kind = F.col(output), F.col(form)
    head, middle = F.substring_index(out, MIDDLE, 1), F.substring_index(out, MIDDLE, -1)
    psm = F.concat(F.substring_index(F.substring_index(head, SUFFIX, 1), PREFIX, -1), middle, F.substring_index(head, SUFFIX, -1))
    spm = F.concat(F.substring_index(head, PREFIX, -1), middle, F.substring_index(F.substring_index(head, PREFIX, 1), SUFFIX, -1))
    return F.when(kind == "psm", psm).when(kind == "spm", spm).otherwise(out)
