"""Token counts of whole texts under a sentence-piece BPE model.

Method: rank-synchronous merging. Distinct pre-tokens of a batch lie one behind the other in one array of
symbols; each round joins, in every sequence at once, the pair of least rank, until no pair can be joined.
The surviving symbols are counted; those outside the vocabulary count their bytes.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seamline.llm.texts import encoded, pieces

#: What the model writes for a space, and distinct pre-tokens a task remembers.
MARK, REMEMBERED = "\N{LOWER ONE EIGHTH BLOCK}", 400_000
#: Characters of the pre-tokens that are remembered.
CHARACTERS = 1 << 23
#: Sequences of more symbols are merged one pair at a time, from a heap: a round over them costs their length.
LONG = 1_000
_NEVER = np.int64(1) << np.int64(60)


class PieceModel:
    """Symbols, pair ranks and pre-token rule of a BPE model that leaves texts unchanged and falls back to bytes.

    Such a model puts a mark before the text and in place of spaces. Its pieces hold marks at their start only,
    so that no merge crosses from a word to the mark behind it: pre-tokens end there.
    """

    def __init__(self, content: bytes):
        model = sentencepiece.SentencePieceProcessor(model_proto=content)
        if model.normalize("  a \N{LATIN SMALL LIGATURE FI} ") != MARK * 3 + "a" + MARK + "\N{LATIN SMALL LIGATURE FI}" + MARK:
            raise ValueError("only models that keep texts as they are and put a space before them are counted")
        plain = [k for k in range(model.get_piece_size()) if not (model.is_control(k) or model.is_unknown(k) or model.is_byte(k) or model.is_unused(k))]
        names = {model.id_to_piece(k): k for k in plain}
        if any(MARK in name.lstrip(MARK) for name in names):
            raise ValueError("a piece spans two words")
        self.symbols = {name: k for name, k in names.items() if len(name) == 1}
        ids = dict(names)
        for char in sorted(set(chain.from_iterable(names)) - set(ids)):  # known inside longer pieces only
            ids[char] = self.symbols[char] = model.get_piece_size() + len(ids)
        self.known = np.zeros(max(ids.values(), default=0) + 1, bool)
        self.known[list(names.values())] = True
        # a higher score joins first; of equal scores, the pair further left
        order = sorted(names.values(), key=lambda k: -model.get_score(k))
        rank = np.zeros(len(self.known), np.int64)
        start = 0
        for k, piece in enumerate(order):
            if k and model.get_score(piece) != model.get_score(order[k - 1]):
                start = k
            rank[piece] = start
        pairs = sorted((ids[n[:k]] << 32 | ids[n[k:]], piece) for n, piece in names.items() for k in range(1, len(n)) if n[:k] in ids and n[k:] in ids)
        self._keys = np.array([a for a, _ in pairs] or [0], np.int64)
        self._pieces = np.array([b for _, b in pairs] or [0], np.int64)
        self._ranks = rank[self._pieces] if pairs else np.array([_NEVER])
        # a piece is safe if no pair with it joins earlier than the piece itself: then all its places join at once
        self._safe = np.ones(len(self.known), bool)
        for side in (self._keys >> 32, self._keys & 0xFFFFFFFF):
            early = self.known[side] & (self._ranks <= rank[side]) if pairs else np.zeros(1, bool)
            self._safe[side[early]] = False
        if len(set(rank[order].tolist())) < len(order):
            self._safe[:] = False
        breaks = not any("\n" in name and len(name) > 1 for name in names)
        self.pretokens = regex.compile(f"\n|{MARK}*[^{MARK}\n]+|{MARK}+" if breaks else f"{MARK}*[^{MARK}]+|{MARK}+")

    def _pair(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys = left << 32 | right
        at = np.minimum(np.searchsorted(self._keys, keys), len(self._keys) - 1)
        found = (self._keys[at] == keys) & (left >= 0) & (right >= 0)
        return np.where(found, self._ranks[at], _NEVER), self._pieces[at]

    def counts(self, words: list[str]) -> np.ndarray:
        """Tokens of each pre-token."""
        return self._merged([w if len(w) <= LONG else "" for w in words]) + np.array([self._long(w) if len(w) > LONG else 0 for w in words], np.int64)

    def _long(self, word: str) -> int:
        symbols = [self.symbols.get(c, -len(encoded(c))) for c in word]
        after, before = list(range(1, len(word) + 1)), list(range(-1, len(word) - 1))
        ranks, pieces_ = self._pair(np.array(symbols[:-1]), np.array(symbols[1:]))
        heap = [(rank, at, symbols[at], symbols[at + 1], piece) for at, (rank, piece) in enumerate(zip(ranks.tolist(), pieces_.tolist(), strict=True)) if rank < _NEVER]
        heapq.heapify(heap)
        pairs: dict[tuple[int, int], tuple[int, int]] = {}
        while heap:
            _, at, left, right, piece = heapq.heappop(heap)
            other = after[at]
            if symbols[at] != left or other >= len(word) or symbols[other] != right:
                continue
            symbols[at], symbols[other] = piece, None
            after[at] = after[other]
            if after[at] < len(word):
                before[after[at]] = at
            for place in (before[at], at):
                if place < 0 or after[place] >= len(word):
                    continue
                pair = symbols[place], symbols[after[place]]
                if pair not in pairs:
                    rank, joined = self._pair(np.array(pair[:1]), np.array(pair[1:]))
                    pairs[pair] = int(rank[0]), int(joined[0])
                if pairs[pair][0] < _NEVER:
                    heapq.heappush(heap, (pairs[pair][0], place, *pair, pairs[pair][1]))
        return sum(1 if s >= 0 else -s for s in symbols if s is not None)

    def _merged(self, words: list[str]) -> np.ndarray:
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        chars = "".join(words)
        points = np.frombuffer(chars.encode("utf-32-le", "surrogatepass"), np.uint32)
        distinct, inverse = np.unique(points, return_inverse=True)
        # a symbol outside the model is minus its number of bytes
        table = np.array([self.symbols.get(c, -len(encoded(c))) for c in map(chr, distinct.tolist())], np.int64)
        symbols = table[inverse]
        owner = np.repeat(np.arange(len(words)), lengths)
        total = np.zeros(len(words), np.int64)
        while len(symbols):
            rank = np.full(len(symbols), _NEVER)
            piece = np.zeros(len(symbols), np.int64)
            if len(symbols) > 1:
                rank[:-1], piece[:-1] = self._pair(symbols[:-1], symbols[1:])
                rank[:-1][owner[:-1] != owner[1:]] = _NEVER
            first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            least = np.minimum.reduceat(rank, first)
            size = np.diff(np.r_[first, len(owner)])
            going = np.repeat(least < _NEVER, size)
            if not going.all():
                ended = ~going
                tokens = np.where(symbols[ended] < 0, -symbols[ended], 1)
                total += np.bincount(owner[ended], tokens, minlength=len(words)).astype(np.int64)
                symbols, owner, rank, piece = symbols[going], owner[going], rank[going], piece[going]
                least, size = least[least < _NEVER], size[least < _NEVER]
                if not len(symbols):
                    break
            joins = rank == np.repeat(least, size)
            where = np.flatnonzero(joins)
            # of overlapping places the first, third, ... join, as they would from left to right
            begins = np.flatnonzero(np.r_[True, np.diff(where) != 1])
            odd = (np.arange(len(where)) - np.repeat(begins, np.diff(np.r_[begins, len(where)]))) % 2 == 1
            leftmost = np.r_[True, owner[where[1:]] != owner[where[:-1]]]
            where = where[leftmost | self._safe[piece[where]] & ~odd]
            symbols[where] = piece[where]
            keep = np.ones(len(symbols), bool)
            keep[where + 1] = False
            symbols, owner = symbols[keep], owner[keep]
        return total


@lru_cache(maxsize=2)
def loaded(content: bytes) -> PieceModel:
    return PieceModel(content)


class _Numbered(dict):
    def __missing__(self, word: str) -> int:
        self[word] = number = len(self)
        return number


class Counter:
    """Token counts of texts; remembers a bounded number of distinct pre-tokens."""

    def __init__(self, model: PieceModel):
        self.model = model
        self.numbers, self.sizes, self.characters = _Numbered(), np.zeros(0, np.int64), 0

    def __call__(self, texts: list[str]) -> np.ndarray:
        if len(self.numbers) > REMEMBERED or self.characters > CHARACTERS:
            self.numbers, self.sizes, self.characters = _Numbered(), np.zeros(0, np.int64), 0
        known = len(self.numbers)
        words = [self.model.pretokens.findall(MARK + text.replace(" ", MARK)) if text else [] for text in texts]
        codes = np.fromiter(map(self.numbers.__getitem__, chain.from_iterable(words)), np.int64)
        new = list(islice(self.numbers, known, None))
        if new:
            self.characters += sum(map(len, new))
            self.sizes = np.concatenate([self.sizes, self.model.counts(new)])
        sums = np.concatenate(([0], np.cumsum(self.sizes[codes])))
        ends = np.cumsum([len(found) for found in words])
        return sums[ends] - sums[np.concatenate(([0], ends[:-1]))]


def _counted(content):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(loaded(content.value))
        for batch in batches:
            texts = [t or "" for t in batch.column(batch.schema.names.index("text")).to_pylist()]
            counts = [counter(part) for part in pieces(texts, list(map(len, texts)))]
            n = np.concatenate(counts) if counts else np.zeros(0, np.int64)
            yield pa.record_batch([*batch.columns, pa.array(n, pa.int64())], names=[*batch.schema.names, "n_tokens"])

    return run


def count_tokens(docs: DataFrame, model: bytes) -> DataFrame:
    """``docs`` with n_bytes (UTF-8) and n_tokens of each whole ``text``, without begin, end or special tokens.

    A null text counts as empty: no bytes, no tokens. Columns named n_bytes or n_tokens are replaced; every
    other column, and rows with null or repeated ids, are passed on. An empty table gives an empty result.
    """
    docs = docs.drop("n_bytes", "n_tokens")
    sent = docs.sparkSession.sparkContext.broadcast(model)
    counted = docs.mapInArrow(_counted(sent), T.StructType([*docs.schema.fields, T.StructField("n_tokens", T.LongType())]))
    return counted.withColumn("n_bytes", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long"))
