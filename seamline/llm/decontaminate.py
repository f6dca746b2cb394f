"""Documents that hold passages of test items, copied or edited.

Method: every run of three words of a test item is a seed. Where a document holds a seed, the stretch around it is
aligned with the item by Smith-Waterman over words; the score is the alignment's share of a full match. An edited
copy in which no three words of the item follow each other holds no seed and is not found.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seamline.llm.texts import Words, blocks, gram_hashes, pieces

#: Words of a seed, and bytes of test items looked for in one pass.
SEED, ITEM_BYTES = 3, 8 << 20
#: Points of equal words, other words and gaps.
MATCH, MISMATCH, GAP = 2, -1, -1
_BETWEEN = np.ones(256, bool)
_BETWEEN[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False


def content_words(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of many texts and where each text's words begin.

    Words are runs of ASCII letters, digits and characters beyond ASCII, lower-cased.
    """
    parts = [text.lower().encode("utf-8", "surrogatepass") for text in texts]
    ends = np.cumsum([len(part) + 1 for part in parts])
    data = np.frombuffer(b" ".join(parts), np.uint8)
    at, hashes, starts = 0, [], []
    for part in blocks(data, _BETWEEN):
        found = Words(part, ~_BETWEEN[part])
        hashes.append(found.hashes())
        starts.append(found.starts + at)
        at += len(part)
    return np.concatenate(hashes), np.concatenate(([0], np.searchsorted(np.concatenate(starts), ends, "left")))


def align(item: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """Best local alignment score of an item with each row of ``windows``, a row at a time for all windows.

    A gap in the item is a running maximum along the window, so each word of the item is one array step.
    """
    width = windows.shape[1]
    slope = -GAP * np.arange(width)
    above = np.zeros(windows.shape, np.int32)
    best = np.zeros(len(windows), np.int32)
    for word in item:
        row = np.where(windows == word, MATCH, MISMATCH).astype(np.int32)
        row[:, 1:] += above[:, :-1]
        np.maximum(row, above + GAP, out=row)
        np.maximum(row, 0, out=row)
        row = np.maximum.accumulate(row + slope, axis=1) - slope
        above = row.astype(np.int32)
        np.maximum(best, above.max(axis=1), out=best)
    return best


class Items:
    """Words and seeds of a bounded set of test items."""

    def __init__(self, rows: list[tuple[int, str]]):
        self.ids = [k for k, _ in rows]
        words, starts = content_words([t for _, t in rows]) if rows else (np.zeros(0, np.uint64), np.zeros(1, int))
        self.words = [words[a:b] for a, b in zip(starts[:-1], starts[1:], strict=True)]
        grams, owner, offset = [], [], []
        for k, found in enumerate(self.words):
            seeds = gram_hashes(found, min(SEED, max(1, len(found)))) if len(found) else found
            grams.append(seeds)
            owner.append(np.full(len(seeds), k))
            offset.append(np.arange(len(seeds)))
        self.seeds = np.concatenate(grams) if grams else words
        self.owner = np.concatenate(owner).astype(np.int64) if grams else np.zeros(0, np.int64)
        self.offset = np.concatenate(offset).astype(np.int64) if grams else np.zeros(0, np.int64)
        self.widths = sorted({min(SEED, len(found)) for found in self.words if len(found)})
        order = np.argsort(self.seeds, kind="stable")
        self.seeds, self.owner, self.offset = self.seeds[order], self.owner[order], self.offset[order]
        self.bits = np.zeros(1 << 20, bool)
        self.bits[(self.seeds & np.uint64((1 << 20) - 1)).astype(np.int64)] = True

    def hits(self, words: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in ``words`` where a seed begins, with the seed's hash; seeds do not cross texts."""
        places, found = [], []
        for width in self.widths:
            grams = gram_hashes(words, width)
            at = np.flatnonzero(self.bits[(grams & np.uint64((1 << 20) - 1)).astype(np.int64)])
            known = np.searchsorted(self.seeds, grams[at])
            at = at[self.seeds[np.minimum(known, len(self.seeds) - 1)] == grams[at]] if len(self.seeds) else at[:0]
            text = np.searchsorted(starts, at, "right") - 1
            at = at[at + width <= starts[text + 1]]
            places.append(at)
            found.append(grams[at])
        return (np.concatenate(places), np.concatenate(found)) if places else (np.zeros(0, int), words[:0])


def _texts(batches) -> Iterator[tuple[list, list[str]]]:
    for batch in batches:
        ids, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
        for part in pieces(list(range(len(ids))), list(map(len, texts))):
            yield [ids[k] for k in part], [texts[k] for k in part]


def matched(look: Items, texts: list[str], least: float) -> dict[tuple[int, int], float]:
    """Scores by (number of the text, number of the item)."""
    words, starts = content_words(texts)
    places, found = look.hits(words, starts)
    text = np.searchsorted(starts, places, "right") - 1
    first, last = np.searchsorted(look.seeds, found, "left"), np.searchsorted(look.seeds, found, "right")
    stretches: dict[int, set[tuple[int, int, int]]] = {}
    for place, t, a, b in zip(places.tolist(), text.tolist(), first.tolist(), last.tolist(), strict=True):
        for k in range(a, b):
            size = len(look.words[look.owner[k]])
            slack = size // 2 + 1
            begin = place - int(look.offset[k])
            window = (t, max(int(starts[t]), begin - slack), min(int(starts[t + 1]), begin + size + slack))
            stretches.setdefault(int(look.owner[k]), set()).add(window)
    out: dict[tuple[int, int], float] = {}
    for owner, windows in stretches.items():
        item = look.words[owner]
        full = MATCH * len(item)
        # only equal words add to a score
        rich = [w for w in sorted(windows) if MATCH * int(np.isin(words[w[1] : w[2]], item).sum()) >= least * full]
        for some in pieces(rich, [b - a for _, a, b in rich]):
            table = np.zeros((len(some), max(b - a for _, a, b in some)), np.uint64)
            for row, (_, a, b) in zip(table, some, strict=True):
                row[: b - a] = words[a:b]
            for (t, _, _), score in zip(some, (align(item, table) / full).tolist(), strict=True):
                if score >= least:
                    out[t, owner] = max(score, out.get((t, owner), 0.0))
    return out


def _matches(items, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look = items.value
        for ids, texts in _texts(batches):
            out = matched(look, texts, least)
            yield pa.record_batch(
                [pa.array([ids[t] for t, _ in out], pa.int64()), pa.array([look.ids[k] for _, k in out], pa.int64()), pa.array(list(out.values()), pa.float64())],
                names=["doc_id", "item_id", "score"],
            )

    return run


def _without_matches(items, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look = items.value
        for batch in batches:
            texts = [t or "" for t in batch.column(batch.schema.names.index("text")).to_pylist()]
            clean = np.ones(len(texts), bool)
            for part in pieces(list(range(len(texts))), list(map(len, texts))):
                clean[[part[t] for t, _ in matched(look, [texts[k] for k in part], least)]] = False
            yield batch.filter(pa.array(clean))

    return run


def _blocks_of_items(benchmark: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """Test items in blocks of bounded bytes, read one after the other; each block is looked for in a pass of its own."""
    run: list = []
    total = 0
    rows = benchmark.select(F.col("item_id").cast("long"), "text").where("item_id is not null and text is not null")
    for row in rows.toLocalIterator():
        if run and total + len(row[1]) > ITEM_BYTES:
            yield run
            run, total = [], 0
        run.append((row[0], row[1]))
        total += len(row[1])
    if run:
        yield run


def benchmark_matches(docs: DataFrame, benchmark: DataFrame, least: float = 0.5) -> DataFrame:
    """(doc_id, item_id, score) of the documents that hold a test item with at least the score ``least``.

    The score is the Smith-Waterman score over words (2 for equal words, -1 for others and for gaps) divided by
    that of the whole item, so 1.0 is a full copy. Found are the pairs that share three words in a row. Words are letters and digits, lower-cased: punctuation, case
    and line breaks do not matter. Items of fewer than three words are one seed; items without words, or with
    a null id or text, are never found. Null and empty texts match nothing; rows with a null id are reported
    with a null id, and rows that repeat an id once each. Either table may be empty.

    Items are broadcast in blocks of at most 8 MB of text; more items mean more passes over the documents.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text is not null")
    found = docs.sparkSession.createDataFrame([], "doc_id long, item_id long, score double")
    for items in _sent_items(benchmark):
        found = found.unionByName(texts.mapInArrow(_matches(items, least), found.schema))
    return found


def _sent_items(benchmark: DataFrame) -> Iterator:
    """Blocks of test items, broadcast."""
    context = benchmark.sparkSession.sparkContext
    for rows in _blocks_of_items(benchmark):
        items = Items(rows)
        if len(items.seeds):
            yield context.broadcast(items)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose text holds no test item, judged row by row; see ``benchmark_matches``.

    Columns stay as they are. Rows with a null text, and rows with null or repeated ids, are judged like others.
    """
    for items in _sent_items(benchmark):
        docs = docs.mapInArrow(_without_matches(items, least), docs.schema)
    return docs
