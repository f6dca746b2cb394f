"""Byte-level BPE: ids of whole texts by a rank file, and texts of ids.

Method: each match of the split pattern is a sequence of bytes. A segment tree over its byte positions holds,
at each leaf, the rank of the pair that starts there, and at its root the leftmost pair of least rank. A merge
updates three leaves (the merged pair, the one before it, the swallowed one) and their paths to the root. The
trees of many sequences of about one length are rows of one array, so a step merges one pair of each.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seamline.llm.texts import encoded, pieces, ragged

#: White space of the rank files' own library; Python's also has four control characters.
WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Distinct pre-tokens a task remembers and their characters together, and cells of the trees merged at once.
REMEMBERED, CHARACTERS, CELLS = 200_000, 1 << 22, 1 << 19
#: Fewer sequences than this are merged one after the other: array steps would cost more than the work in them.
FEW = 24
_NEVER = np.int64(1) << np.int64(60)


def read_ranks(path: str) -> bytes:
    """The rank file, read on the driver; a vocabulary is small and sent to the executors."""
    with open(path, "rb") as file:
        return file.read()


class Ranks:
    """Ranks of byte strings, with the rank of every pair of them that a merge may join."""

    def __init__(self, content: bytes, pattern: str):
        self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, content.splitlines()) if a}
        self.strings = {rank: text for text, rank in self.ranks.items()}
        found = [
            (self.ranks[text[:k]] << 32 | self.ranks[text[k:]], rank)
            for text, rank in self.ranks.items()
            for k in range(1, len(text))
            if text[:k] in self.ranks and text[k:] in self.ranks
        ]
        found.sort()
        self._keys = np.array([a for a, _ in found] or [0], np.int64)
        self._joined = np.array([b for _, b in found] or [_NEVER], np.int64)
        self._bytes = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        # all strings of the vocabulary in one array, by rank; ranks that are not used have a negative size
        last = max(self.ranks.values(), default=-1)
        self._sizes = np.full(last + 1, -1, np.int64)
        self._sizes[list(self.strings)] = [len(text) for text in self.strings.values()]
        self._places = np.cumsum(np.maximum(self._sizes, 0)) - np.maximum(self._sizes, 0)
        self._letters = np.frombuffer(b"".join(self.strings[rank] for rank in sorted(self.strings)), np.uint8)
        self.pattern = regex.compile(pattern.replace(r"[^\s", "[^" + WHITE).replace(r"\S", f"[^{WHITE}]").replace(r"\s", f"[{WHITE}]"))

    def joined(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair joined; a negative side joins with nothing."""
        keys = left << 32 | right
        at = np.minimum(np.searchsorted(self._keys, keys), len(self._keys) - 1)
        return np.where((self._keys[at] == keys) & (left >= 0) & (right >= 0), self._joined[at], _NEVER)

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all sequences of bytes, one after the other, and how many each has."""
        whole = np.array([self.ranks.get(word, -1) for word in words], np.int64)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        bits = np.ceil(np.log2(np.maximum(lengths, 2))).astype(np.int64)
        bits[whole >= 0] = 0
        done = np.flatnonzero(whole >= 0)
        members, flats, counts = [done], [whole[done]], [np.ones(len(done), np.int64)]
        for power in np.unique(bits[bits > 0]).tolist():
            of = np.flatnonzero(bits == power)
            rows = max(1, CELLS >> power)
            for start in range(0, len(of), rows):
                part = of[start : start + rows]
                some = [words[k] for k in part.tolist()]
                flat, count = self._merged(some, 1 << power) if len(some) >= FEW else self._one_by_one(some, 1 << power)
                members.append(part)
                flats.append(flat)
                counts.append(count)
        order = np.argsort(np.concatenate(members))
        sizes = np.concatenate(counts)
        starts = np.cumsum(sizes) - sizes
        return np.concatenate(flats)[ragged(starts[order], sizes[order])], sizes[order]

    def decode(self, ids: np.ndarray, starts: np.ndarray) -> pa.Array:
        """The bytes of runs of ``ids`` that begin at ``starts`` (with the end as its last)."""
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self._sizes) or self._sizes[ids].min() < 0):
            raise ValueError("an id that is not in the vocabulary")
        ends = np.concatenate(([0], np.cumsum(self._sizes[ids])))
        parts = []
        for at in range(0, len(ids), CELLS):
            part = ids[at : at + CELLS]
            parts.append(self._letters[ragged(self._places[part], self._sizes[part])].tobytes())
        offsets = ends[starts].astype(np.int32)
        return pa.Array.from_buffers(pa.binary(), len(starts) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(b"".join(parts))])

    def _merged(self, words: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
        count = len(words)
        lengths = np.fromiter(map(len, words), np.int64, count)
        # symbols by their first byte; two more columns stand for "before the first" and "after the last"
        symbols = np.full((count, width + 2), -1, np.int64)
        symbols[:, :width][np.arange(width) < lengths[:, None]] = self._bytes[np.frombuffer(b"".join(words), np.uint8)]
        after = np.broadcast_to(np.arange(1, width + 3), symbols.shape).copy()
        after[after >= lengths[:, None]] = width + 1
        before = np.broadcast_to(np.arange(-1, width + 1), symbols.shape).copy()
        before[:, 0] = width
        tree = np.full((count, 2 * width), _NEVER, np.int64)
        ranks = self.joined(symbols[:, : width - 1].ravel(), symbols[:, 1:width].ravel()).reshape(count, width - 1)
        tree[:, width : 2 * width - 1] = np.where(ranks < _NEVER, ranks * width + np.arange(width - 1), _NEVER)
        level = width
        while level > 1:
            half = level // 2
            np.minimum(tree[:, level : 2 * level : 2], tree[:, level + 1 : 2 * level : 2], out=tree[:, half:level])
            level = half
        rows = np.flatnonzero(tree[:, 1] < _NEVER)
        while len(rows):
            best = tree[rows, 1]
            first = best % width
            second = after[rows, first]
            behind, ahead = before[rows, first], after[rows, second]
            symbols[rows, first] = best // width
            symbols[rows, second] = -1
            after[rows, first] = ahead
            before[rows, ahead] = first
            joined = symbols[rows, first]
            self._update(tree, width, rows, second, np.full(len(rows), _NEVER))
            ranks = self.joined(joined, symbols[rows, ahead])
            self._update(tree, width, rows, first, np.where(ranks < _NEVER, ranks * width + first, _NEVER))
            ranks = self.joined(symbols[rows, behind], joined)
            has = behind < width
            place = np.where(has, behind, first)
            value = np.where(has, np.where(ranks < _NEVER, ranks * width + behind, _NEVER), tree[rows, width + first])
            self._update(tree, width, rows, place, value)
            rows = rows[tree[rows, 1] < _NEVER]
        left = symbols[:, :width] >= 0
        return symbols[:, :width][left], left.sum(axis=1)

    def _one_by_one(self, words: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
        """The same merges on a tree of plain numbers for each sequence."""
        out, pairs, never = [], {}, int(_NEVER)

        def joined(left: int, right: int) -> int:
            if (left, right) not in pairs:
                pairs[left, right] = self.ranks.get(self.strings[left] + self.strings[right], never)
            return pairs[left, right]

        for word in words:
            size = len(word)
            symbols = self._bytes[np.frombuffer(word, np.uint8)].tolist()
            after, before = list(range(1, size + 1)), list(range(-1, size - 1))
            tree = [never] * (2 * width)

            def put(place: int, rank: int, tree=tree) -> None:
                node = width + place
                tree[node] = rank * width + place if rank < never else never
                while node > 1:
                    node >>= 1
                    best = min(tree[2 * node], tree[2 * node + 1])
                    if tree[node] == best:
                        break
                    tree[node] = best

            for place in range(size - 1):
                rank = joined(symbols[place], symbols[place + 1])
                tree[width + place] = rank * width + place if rank < never else never
            for node in range(width - 1, 0, -1):
                tree[node] = min(tree[2 * node], tree[2 * node + 1])
            while tree[1] < never:
                rank, first = divmod(tree[1], width)
                second = after[first]
                ahead = after[second]
                symbols[first], symbols[second], after[first] = rank, None, ahead
                put(second, never)
                if ahead < size:
                    before[ahead] = first
                put(first, joined(rank, symbols[ahead]) if ahead < size else never)
                if before[first] >= 0:
                    put(before[first], joined(symbols[before[first]], rank))
            out.append([s for s in symbols if s is not None])
        return np.array([s for found in out for s in found], np.int64), np.array([len(found) for found in out], np.int64)

    @staticmethod
    def _update(tree: np.ndarray, width: int, rows: np.ndarray, place: np.ndarray, value: np.ndarray) -> None:
        node = width + place
        tree[rows, node] = value
        while node[0] > 1:
            node = node >> 1
            tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])


@lru_cache(maxsize=2)
def loaded(content: bytes, pattern: str) -> Ranks:
    return Ranks(content, pattern)


class _Numbered(dict):
    def __missing__(self, word: str) -> int:
        self[word] = number = len(self)
        return number


class Encoder:
    """Ids of texts; remembers a bounded number of distinct pre-tokens."""

    def __init__(self, ranks: Ranks):
        self.ranks = ranks
        self._reset()

    def _reset(self) -> None:
        self.numbers, self.ids, self.starts = _Numbered(), np.zeros(0, np.int32), np.zeros(1, np.int64)
        self.characters = 0

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one array, and where each text's ids begin."""
        if len(self.numbers) > REMEMBERED or self.characters > CHARACTERS:
            self._reset()
        known = len(self.numbers)
        words = [self.ranks.pattern.findall(text) for text in texts]
        find = self.numbers.__getitem__
        codes = np.fromiter(map(find, chain.from_iterable(words)), np.int64)
        new = list(islice(self.numbers, known, None))
        if new:
            self.characters += sum(map(len, new))
            found, sizes = self.ranks.encode([encoded(word) for word in new])
            self.ids = np.concatenate([self.ids, found.astype(np.int32)])
            self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(sizes)])
        sizes = self.starts[codes + 1] - self.starts[codes]
        flat = self.ids[ragged(self.starts[codes], sizes)]
        counts = np.concatenate(([0], np.cumsum(sizes)))
        return flat, counts[np.concatenate(([0], np.cumsum(list(map(len, words)))))]


def _encoded(ranks, pattern: str, decoded: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = loaded(ranks.value, pattern)
        encoder = Encoder(coder)
        for batch in batches:
            column = batch.column(batch.schema.names.index("text"))
            sizes = pc.binary_length(column).fill_null(0).to_pylist()
            at = 0
            for part in pieces(sizes, sizes) if sizes else ():
                rows = batch.slice(at, len(part))
                ids, starts = encoder([t or "" for t in column.slice(at, len(part)).to_pylist()])
                at += len(part)
                new = [pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(ids))]
                if decoded:
                    new.append(coder.decode(ids, starts))
                yield pa.record_batch([*rows.columns, *new], names=[*batch.schema.names, "ids", "decoded"][: len(rows.columns) + len(new)])

    return run


def encode(docs: DataFrame, ranks: bytes, pattern: str, decoded: bool = False) -> DataFrame:
    """``docs`` with a column ``ids`` array<int>: the BPE ids of each whole ``text``, without special tokens.

    With ``decoded`` a column of that name has the bytes that the ids stand for, made in the same pass. A null or
    empty text has an empty list. A column named ids (or decoded) is replaced; every other column, rows with null
    or repeated ids included, is passed on. Special strings in a text are ordinary text. An empty table gives
    an empty result.
    """
    docs = docs.drop("ids", *["decoded"] * decoded)
    sent = docs.sparkSession.sparkContext.broadcast(ranks)
    added = [T.StructField("ids", T.ArrayType(T.IntegerType())), *[T.StructField("decoded", T.BinaryType())] * decoded]
    return docs.mapInArrow(_encoded(sent, pattern, decoded), T.StructType([*docs.schema.fields, *added]))


def _decoded(ranks, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = loaded(ranks.value, pattern)
        for batch in batches:
            lists = batch.column(batch.schema.names.index("ids"))
            sizes = lists.value_lengths().fill_null(0).to_pylist()
            at = 0
            for part in pieces(sizes, sizes, 1 << 18) if sizes else ():
                rows, some = batch.slice(at, len(part)), lists.slice(at, len(part))
                at += len(part)
                texts = coder.decode(some.flatten().to_numpy(zero_copy_only=False), np.concatenate(([0], np.cumsum(part))))
                yield pa.record_batch([*rows.columns, pc.if_else(some.is_valid(), texts, None)], names=[*batch.schema.names, "decoded"])

    return run


def decode(coded: DataFrame, ranks: bytes, pattern: str) -> DataFrame:
    """``coded`` with a column ``decoded``: the bytes that its ``ids`` stand for; null for null, else never null.

    An id outside the vocabulary, or a null among the ids, is an error. A column named decoded is replaced.
    """
    coded = coded.drop("decoded")
    sent = coded.sparkSession.sparkContext.broadcast(ranks)
    schema = T.StructType([*coded.schema.fields, T.StructField("decoded", T.BinaryType())])
    return coded.mapInArrow(_decoded(sent, pattern), schema)


def id_digest(column: str = "ids"):
    """Lowercase hex SHA-256 of the decimal ids joined by commas."""
    return F.sha2(F.concat_ws(",", F.col(column).cast("array<string>")).cast("binary"), 256)


def digested(coded: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of documents with ``ids`` and ``decoded``."""
    counted = F.size("ids").cast("long").alias("n_tokens")
    return coded.select("doc_id", counted, id_digest().alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
