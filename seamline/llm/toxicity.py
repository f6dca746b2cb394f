"""Toxicity of documents from weak supervision.

Method: many voters, each a lexicon word or a word-beginning pattern, vote "toxic" on the documents they find
or abstain; a generative label model with two hidden classes estimates each voter's rates in both classes by
expectation maximisation and, from the correlations that the classes leave between voters, how much of a vote
is its own. A linear classifier is trained on the posterior labels and scores every document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seamline.llm.texts import Words, blocks, labelled_sample, pieces
from seamline.session import cut_lineage

#: A clue counts as frequent from two on, if it is at least one word in so many.
FREQUENT = 150
#: Labelled documents that are fitted on at most, voters at most, and characters' bytes of the beginnings.
SAMPLE_ROWS, VOTERS, BEGINNINGS = 16_384, 768, (3, 4, 5, 6, 7, 8)
#: A voter must speak so many times as often in toxic documents as in others, and in two toxic ones at least. Among
#: the voters, at most this share may be expected by chance; evidence is compared in steps, up to a top step.
LEAST_RATIO, BY_CHANCE, STEPS, TOP_STEP = 6.0, 0.5, 4, 200
#: A clue is a hash below its kind: the whole word, beginnings from the longest, then the same for frequent ones.
_HASH, _OFTEN = np.uint64((1 << 59) - 1), np.uint64(1 << 62)
#: Rows are told apart by sums of hashes of so many bits.
_MARK = (1 << 48) - 1
_OUTSIDE = np.ones(256, bool)
_OUTSIDE[[*range(0x61, 0x7B), *range(0x80, 0x100)]] = False


def clues(texts: list[str], wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(number of the text, clue), distinct and sorted: the words of the texts and their beginnings, hashed.

    Words are runs of letters, lower-cased. A clue that is frequent in a text gives a second clue. With
    ``wanted`` (sorted hashes) only clues found there are given, by their place in it.
    """
    parts = [text.lower().encode("utf-8", "surrogatepass") for text in texts]
    ends = np.cumsum([len(part) + 1 for part in parts])
    data = np.frombuffer(b" ".join(parts), np.uint8)
    if wanted is not None:
        bits = np.zeros(1 << 18, bool)
        bits[(wanted & np.uint64((1 << 18) - 1)).astype(np.int64)] = True
    at, owners, found = 0, [], []
    total = np.zeros(len(texts), np.int64)
    for part in blocks(data, _OUTSIDE):
        words = Words(part, ~_OUTSIDE[part])
        owner = np.searchsorted(ends, words.starts + at, "right")
        total += np.bincount(owner, minlength=len(texts))
        sizes = words.ends - words.starts
        for kind, size in enumerate((None, *reversed(BEGINNINGS))):
            which = slice(None) if size is None else np.flatnonzero(sizes > size)
            hashes = words.hashes() if size is None else words.hashes(words.starts[which] + size, which)
            hashes = hashes & _HASH | np.uint64(kind << 59)
            whose = owner[which]
            if wanted is not None:
                keep = np.flatnonzero(bits[(hashes & np.uint64((1 << 18) - 1)).astype(np.int64)])
                hashes, whose = hashes[keep], whose[keep]
            owners.append(whose)
            found.append(hashes)
        at += len(part)
    owner, hashes = np.concatenate(owners), np.concatenate(found)
    order = np.lexsort((hashes, owner))
    owner, hashes = owner[order], hashes[order]
    first = np.flatnonzero(np.r_[True, (np.diff(owner) != 0) | (hashes[1:] != hashes[:-1])]) if len(owner) else order
    times = np.diff(np.r_[first, len(owner)])
    owner, hashes = owner[first], hashes[first]
    often = (times >= 2) & (times * FREQUENT >= total[owner])
    owner, hashes = np.concatenate((owner, owner[often])), np.concatenate((hashes, hashes[often] | _OFTEN))
    if wanted is not None:
        place = np.minimum(np.searchsorted(wanted, hashes), max(len(wanted) - 1, 0))
        keep = wanted[place] == hashes if len(wanted) else np.zeros(len(hashes), bool)
        owner, hashes = owner[keep], place[keep].astype(np.uint64)
    order = np.lexsort((hashes, owner))
    return owner[order], hashes[order]


def _clue_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each clue, the toxic and other documents of the task that hold it, and the sum of their marks."""
    for batch in batches:
        texts, labels = batch.column("text").to_pylist(), batch.column("label").to_numpy(zero_copy_only=False)
        marks = batch.column("mark").to_numpy().astype(np.uint64)
        for part in pieces(list(range(len(texts))), [len(t) for t in texts], 8 << 20):
            owner, found = clues([texts[k] for k in part])
            toxic = labels[np.array(part)][owner] == 1
            distinct, place = np.unique(found, return_inverse=True)
            bad = np.bincount(place, toxic, minlength=len(distinct)).astype(np.int64)
            times = np.bincount(place, minlength=len(distinct))
            held = np.zeros(len(owner) + 1, np.uint64)
            np.cumsum(marks[np.array(part)][owner][np.argsort(place, kind="stable")], out=held[1:])
            ends = np.cumsum(times)
            mark = ((held[ends] - held[ends - times]) & np.uint64(_MARK)).astype(np.int64)
            yield pa.record_batch([pa.array(distinct.view(np.int64)), pa.array(bad), pa.array(times - bad), pa.array(mark)], names=["clue", "toxic", "other", "mark"])


def evidence_bar(held: dict[int, int], steps: dict[int, int], toxic: int, other: int) -> int:
    """The lowest step of evidence from which on at most ``BY_CHANCE`` of the clues are expected by chance.

    ``held`` has the number of clues by the documents that hold them, ``steps`` that of possible voters by the step
    of their evidence, ``toxic`` and ``other`` are the documents. By chance, each document that holds a clue is
    toxic with the share of the toxic ones, so a clue's toxic documents are binomial. On so few rows that no step
    will do, it is the highest step that has a clue: the likeliest voters that there are.
    """
    share = toxic / (toxic + other)
    chance = np.zeros(TOP_STEP + 1)
    logs = np.concatenate(([0.0], np.cumsum(np.log(np.arange(1, max(held, default=0) + 1)))))
    for times, clues_ in held.items():
        k = np.arange(times + 1)
        at_least = np.cumsum(np.exp(logs[times] - logs[k] - logs[times - k] + k * np.log(share) + (times - k) * np.log1p(-share))[::-1])[::-1]
        rate = k / times
        with np.errstate(divide="ignore", invalid="ignore"):
            evidence = k * np.log(rate / share) + np.where(k < times, (times - k) * np.log((1 - rate) / (1 - share)), 0)
        # both rise with the toxic documents
        fit = np.flatnonzero((k >= 2) & (k / toxic >= LEAST_RATIO * (times - k + 0.5) / other))
        first = np.searchsorted(np.minimum(np.floor(STEPS * evidence[fit]), TOP_STEP), np.arange(TOP_STEP + 1))
        able = first < len(fit)
        chance[able] += clues_ * at_least[fit[first[able]]]
    found = np.zeros(TOP_STEP + 1)
    for step, clues_ in steps.items():
        found[step] += clues_
    found = np.cumsum(found[::-1])[::-1]
    good = np.flatnonzero((found > 0) & (chance <= BY_CHANCE * found))
    return int(good[0]) if len(good) else max(steps, default=TOP_STEP)


def _votes(voters: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, labels = batch.column("text").to_pylist(), batch.column("label").to_pylist()
            for part in pieces(list(range(len(texts))), [len(t) for t in texts]):
                owner, found = clues([texts[k] for k in part], voters)
                cut = np.searchsorted(owner, np.arange(len(part) + 1))
                lists = [found[a:b].astype(np.int32) for a, b in zip(cut[:-1], cut[1:], strict=True)]
                yield pa.record_batch([pa.array([labels[k] for k in part], pa.int32()), pa.array(lists, pa.list_(pa.int32()))], names=["label", "votes"])

    return run


class LabelModel:
    """Two hidden classes; each voter speaks at one rate in each, and its weight shrinks with its correlations.

    A silent voter abstains. Only the silence of all voters counts, at one rate in each class. The labels the
    sample has are one more voter, with a fixed accuracy, as labels err too.
    """

    #: Log odds of a given label.
    GIVEN = float(np.log(0.98 / 0.02))

    def __init__(self, votes: np.ndarray, first: np.ndarray, rounds: int = 12):
        posterior = np.clip(first.astype(float), 0.02, 0.98)
        self.heard = votes.any(axis=1)
        for k in range(rounds):
            self.prior = float(np.clip(posterior.mean(), 1e-3, 1 - 1e-3))
            known = posterior.astype(votes.dtype)
            self.rate = (votes.T @ known + 0.5) / (posterior.sum() + 1)
            self.usual = (votes.T @ (1 - known) + 0.05) / ((1 - posterior).sum() + 1)
            self.silence = ((~self.heard) @ posterior + 0.5) / (posterior.sum() + 1), ((~self.heard) @ (1 - posterior) + 0.5) / ((1 - posterior).sum() + 1)
            if k % 6 == 0:
                self.share = self._shares(votes[self.heard], posterior[self.heard])
            posterior = self.posterior(votes, first)

    def _shares(self, votes: np.ndarray, posterior: np.ndarray) -> np.ndarray:
        """Of each vote, the part that other voters do not repeat: strong correlations within the toxic class."""
        weight = np.sqrt(posterior.astype(np.float32))[:, None]
        left = weight * (votes - (weight**2 * votes).sum(axis=0) / max(float((weight**2).sum()), 1.0))
        left /= np.maximum(np.sqrt((left**2).sum(axis=0)), 1e-6)
        alike = left.T @ left
        return 1 / np.maximum(1, np.where(alike > 0.5, alike, 0).sum(axis=0))

    def posterior(self, votes: np.ndarray, given: np.ndarray) -> np.ndarray:
        odds = np.log(self.prior / (1 - self.prior)) + np.where(votes.any(axis=1), votes @ (self.share * np.log(self.rate / self.usual)).astype(votes.dtype), np.log(self.silence[0] / self.silence[1]))
        return 1 / (1 + np.exp(-np.clip(odds + self.GIVEN * (2 * given - 1), -30, 30)))


def linear_classifier(x: np.ndarray, y: np.ndarray, penalty: float = 0.1, rounds: int = 400) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels, by accelerated gradient steps."""
    x = np.hstack([x, np.ones((len(x), 1), x.dtype)]).astype(np.float32)
    y = y.astype(np.float32)
    ridge = (np.r_[np.full(x.shape[1] - 1, penalty), 0.0] / len(x)).astype(np.float32)
    probe = np.ones(x.shape[1], np.float32)
    for _ in range(20):  # the largest curvature
        probe = x.T @ (x @ (probe / np.linalg.norm(probe))) / np.float32(len(x))
    step = np.float32(1 / (0.3 * np.linalg.norm(probe) + ridge[0]))
    weights = np.zeros(x.shape[1], np.float32)
    ahead, speed = weights, 1.0
    for _ in range(rounds):
        error = 1 / (1 + np.exp(-np.clip(x @ ahead, -30, 30))) - y
        new = ahead - step * (x.T @ error / np.float32(len(x)) + ridge * ahead)
        quicker = (1 + np.sqrt(1 + 4 * speed**2)) / 2
        ahead, weights, speed = new + np.float32((speed - 1) / quicker) * (new - weights), new, quicker
    return weights[:-1].astype(float), float(weights[-1])


class Model:
    """Voters (sorted hashes), their weights in the linear classifier, and its bias."""

    def __init__(self, voters: np.ndarray, weights: np.ndarray, bias: float):
        self.voters, self.weights, self.bias = voters, weights, bias

    def scores(self, texts: list[str]) -> np.ndarray:
        odds = np.full(len(texts), self.bias)
        if len(self.voters):
            owner, found = clues(texts, self.voters)
            odds += np.bincount(owner, self.weights[found.astype(np.int64)], minlength=len(texts))
        return 1 / (1 + np.exp(-np.clip(odds, -30, 30)))


def train(docs: DataFrame, labels: DataFrame, target: str = "toxic", rows: int = SAMPLE_ROWS) -> Model:
    """Fit on at most ``rows`` labelled documents outside the held-out fold.

    A voter's evidence is the log likelihood ratio of its own share of toxic documents against the sample's; how
    much is asked for follows from the sample (``evidence_bar``). Of clues with the same documents, one votes.
    Without labelled rows of either class, or without any voter (as when no clue is in two toxic documents), every
    score is the share of positive rows (0.0 if there are none).
    """
    sample = cut_lineage(labelled_sample(docs, labels, target, rows))
    tally = sample.groupBy().agg(F.sum("label").alias("toxic"), F.count("*").alias("all")).first()
    toxic, other = int(tally["toxic"] or 0), int(tally["all"]) - int(tally["toxic"] or 0)
    plain = np.zeros(0, np.uint64)
    if not toxic or not other:
        return Model(plain, np.zeros(0), 30.0 if toxic else -30.0)
    marked = sample.select("text", "label", F.xxhash64("doc_id", "text").bitwiseAND(F.lit(_MARK)).alias("mark"))
    counts = marked.mapInArrow(_clue_counts, "clue long, toxic long, other long, mark long").groupBy("clue").agg(
        F.sum("toxic").alias("toxic"), F.sum("other").alias("other"), (F.sum("mark") % (_MARK + 1)).alias("mark")
    )
    ratio = (F.col("toxic") / toxic) / ((F.col("other") + 0.5) / other)
    times, share = F.col("toxic") + F.col("other"), toxic / (toxic + other)
    evidence = F.col("toxic") * F.log(F.col("toxic") / times / share) + F.when(
        F.col("other") > 0, F.col("other") * F.log(F.col("other") / times / (1 - share))
    ).otherwise(0.0)
    step = F.when((ratio >= LEAST_RATIO) & (F.col("toxic") >= 2), F.least(F.floor(STEPS * evidence), F.lit(TOP_STEP)).cast("int"))
    alone = counts.where(times >= 2).groupBy("toxic", "other", "mark").agg(F.min("clue").alias("clue"))
    alone = cut_lineage(alone.select("clue", times.alias("times"), step.alias("step"), evidence.alias("evidence")))
    # a row per number of documents, and one per step; then a fixed number of voters comes to the driver
    held = {r["times"]: r["count"] for r in alone.groupBy("times").count().collect()}
    steps = {r["step"]: r["count"] for r in alone.where("step >= 0").groupBy("step").count().collect()}
    best = alone.where(F.col("step") >= evidence_bar(held, steps, toxic, other)).orderBy(F.desc("evidence"), "clue").limit(VOTERS)
    voters = np.sort(np.array([r["clue"] for r in best.collect()], np.int64).view(np.uint64))
    if not len(voters):
        return Model(plain, np.zeros(0), float(np.log(toxic / other)))
    found = sample.mapInArrow(_votes(voters), "label int, votes array<int>").collect()
    votes = np.zeros((len(found), len(voters)), np.float32)
    for row, r in zip(votes, found, strict=True):
        row[r["votes"]] = 1
    first = np.array([r["label"] for r in found])
    posterior = LabelModel(votes, first).posterior(votes, first)
    return Model(voters, *linear_classifier(votes, posterior))


def _scored(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(batch.schema.names.index("text")).to_pylist()]
            parts = [model.value.scores(part) for part in pieces(texts, list(map(len, texts)))]
            yield pa.record_batch([*batch.columns, pa.array(np.concatenate(parts) if parts else np.zeros(0))], names=[*batch.schema.names, "score"])

    return run


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with a column ``score`` between 0 and 1 from each whole ``text`` alone; higher is likelier toxic.

    Null and empty texts have no votes and get the score of such a text. A column named score is replaced;
    other columns, and rows with null or repeated ids, are passed on. An empty table gives an empty result.
    """
    docs = docs.drop("score")
    sent = docs.sparkSession.sparkContext.broadcast(model)
    return docs.mapInArrow(_scored(sent), T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType())]))
