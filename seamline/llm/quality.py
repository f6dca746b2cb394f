"""Quality of documents by the votes of their nearest labelled neighbours.

Method: a document is its counts of character patterns, weighted and projected on the leading singular vectors
of a labelled sample. The sample's vectors are broadcast; blocks of documents are multiplied with all of them,
which gives exact cosines, and the nearest neighbours' labels are averaged, weighted by similarity.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from seamline.llm.texts import encoded, labelled_sample, pieces, word_hashes_of
from seamline.session import cut_lineage

#: Labelled documents that are fitted on at most, hashed patterns, latent dimensions, and neighbours that vote.
SAMPLE_ROWS, PATTERNS, DIMENSIONS, NEIGHBOURS = 4_096, 4_096, 48, 32
#: Of each byte, what the patterns tell apart: letters by case, digits, blanks, line ends, every other sign.
_KIND = np.arange(256)
_KIND[0x41:0x5B], _KIND[0x61:0x7B], _KIND[0x30:0x3A], _KIND[0x80:] = 0x41, 0x61, 0x30, 0x61


def patterns(texts: list[str]) -> np.ndarray:
    """A row of counts per text: runs of three kinds of bytes, hashed, and how often words and lines repeat."""
    out = np.zeros((len(texts), PATTERNS), np.float32)
    words, starts = word_hashes_of(texts)
    for row, text, a, b in zip(out, texts, starts[:-1].tolist(), starts[1:].tolist(), strict=True):
        kinds = _KIND[np.frombuffer(encoded(text), np.uint8)]
        if len(kinds) >= 3:
            code = (kinds[:-2] * 256 + kinds[1:-1]) * 256 + kinds[2:]
            row[:-8] = np.bincount(code * 2654435761 % (1 << 32) % (PATTERNS - 8), minlength=PATTERNS - 8)
        found = words[a:b]
        if len(found) > 1:
            distinct = len(np.unique(found))
            row[-8] = (found[1:] == found[:-1]).sum() * 3
            row[-7] = (len(found) - distinct) / len(found) * len(kinds)
            row[-6] = (len(found) >= 40) * (distinct < len(found) / 3) * len(kinds)
        lines = text.split("\n")
        row[-5] = (len(lines) - len(set(lines))) / len(lines) * len(kinds)
        row[-4 + (len(found) >= 8) + (len(found) >= 32) + (len(found) >= 256)] = len(kinds) * 0.1
    return out


def weighted(counts: np.ndarray) -> np.ndarray:
    """Damped shares of the patterns, so that long and short documents compare."""
    return np.sqrt(counts / np.maximum(counts.sum(axis=1, keepdims=True), 1))


def normed(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


class Model:
    """Pattern weights, the projection, and the labelled vectors with their labels."""

    def __init__(self, weights, mean, projection, vectors, labels):
        self.weights, self.mean, self.projection, self.vectors, self.labels = weights, mean, projection, vectors, labels

    def vectors_of(self, counts: np.ndarray) -> np.ndarray:
        return normed((weighted(counts) * self.weights - self.mean) @ self.projection)

    def scores(self, texts: list[str]) -> np.ndarray:
        if not len(self.labels):
            return np.full(len(texts), 0.5)
        out = []
        for start in range(0, len(texts), 512):
            cosines = self.vectors_of(patterns(texts[start : start + 512])) @ self.vectors.T
            k = min(NEIGHBOURS, len(self.labels))
            nearest = np.argpartition(-cosines, k - 1, axis=1)[:, :k]
            weight = np.maximum(np.take_along_axis(cosines, nearest, axis=1), 1e-6) ** 4
            out.append((weight * self.labels[nearest]).sum(axis=1) / weight.sum(axis=1))
        return np.concatenate(out).astype(float)


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text").to_pylist()
        labels = batch.column("label").to_pylist()
        for part in pieces(list(range(len(texts))), [len(t) for t in texts]):
            rows = [row.astype(np.float16).tobytes() for row in weighted(patterns([texts[k] for k in part]))]
            yield pa.record_batch([pa.array([labels[k] for k in part], pa.int32()), pa.array(rows, pa.binary())], names=["label", "counts"])


def train(docs: DataFrame, labels: DataFrame, target: str = "quality", rows: int = SAMPLE_ROWS) -> Model:
    """Latent vectors of at most ``rows`` labelled documents outside the held-out fold.

    Without labelled rows every score is 0.5; with rows of one class only, every score is that class.
    """
    found = cut_lineage(labelled_sample(docs, labels, target, rows)).mapInArrow(_sampled, "label int, counts binary").collect()
    if not found:
        return Model(*[np.zeros(0)] * 5)
    shares = np.stack([np.frombuffer(r["counts"], np.float16) for r in found]).astype(np.float32)
    y = np.array([r["label"] for r in found], np.float32)
    weights = np.log((1 + len(y)) / (1 + (shares > 0).sum(axis=0))).astype(np.float32) + 1
    x = shares * weights
    mean = x.mean(axis=0)
    x -= mean
    # leading singular vectors by subspace iteration
    basis = np.random.default_rng(7).standard_normal((x.shape[1], min(DIMENSIONS + 16, *x.shape))).astype(np.float32)
    for _ in range(5):
        basis, _ = np.linalg.qr(x.T @ (x @ basis))
    _, strength, right = np.linalg.svd(x @ basis, full_matrices=False)
    projection = (basis @ right.T)[:, :DIMENSIONS].astype(np.float32)
    return Model(weights, mean, projection, normed(x @ projection).astype(np.float32), y)


def _scored(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(batch.schema.names.index("text")).to_pylist()]
            parts = [model.value.scores(part) for part in pieces(texts, list(map(len, texts)))]
            yield pa.record_batch([*batch.columns, pa.array(np.concatenate(parts) if parts else np.zeros(0))], names=[*batch.schema.names, "score"])

    return run


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with a column ``score`` between 0 and 1 from each whole ``text`` alone; higher is likelier good.

    Null and empty texts have no patterns and get the votes nearest to such a text. A column named score is
    replaced; other columns, and rows with null or repeated ids, are passed on. An empty table gives none.
    """
    docs = docs.drop("score")
    sent = docs.sparkSession.sparkContext.broadcast(model)
    return docs.mapInArrow(_scored(sent), T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType())]))
