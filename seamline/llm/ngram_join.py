"""Documents whose sets of word shingles have a Jaccard similarity of at least a threshold.

Method: adaptive multi-match prefixes. All shingles have one global order, rare ones first. If two sets of
sizes p and q are similar enough, they share at least ``o = ceil(t * max(p, q))`` shingles, so for any
``l <= o`` their first ``p - o + l`` and ``q - o + l`` shingles share at least ``l``. Each document chooses its
own ``l`` by estimated cost: a longer prefix costs more postings but asks candidates for more shared shingles.
Two documents are compared when they share at least the smaller of their two ``l`` within the prefixes that the
overlap for their two sizes leaves.

Identical sets are one node. Within a posting list not all pairs are made: first every member is compared
with the list's most typical member only; a list whose members are then one component is done, since more links
inside it change nothing; in the others, members outside the list's largest component meet the members of
other components. Every link between different components is thus found, so the components are exact.
"""

from __future__ import annotations

import zlib
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seamline.llm.graph import components
from seamline.llm.prefilter import maybe_in
from seamline.llm.texts import pieces, shingles_of
from seamline.session import cut_lineage

#: Counters of the sketch of shingle frequencies, and the slices it is summed in.
SKETCH = 1 << 22
SLICES = 16
#: Candidates by chance that a set expects, as a share of its size: documents repeat passages of others.
CHANCE = 1.35
#: Cost of a posting that a frequent shingle meets, in postings of the set itself.
MET = 0.1
#: Sets a task remembers, so that copies of a document give its postings once.
REMEMBERED = 20_000


def _rows(batches, percent: int) -> Iterator[tuple[list, list, list]]:
    """(ids, texts, sets) of bounded pieces of the batches; rows without an id are left out."""
    for batch in batches:
        ids, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
        rows = [(i, t or "") for i, t in zip(ids, texts, strict=True) if i is not None]
        for part in pieces(rows, [len(t) for _, t in rows]):
            yield [i for i, _ in part], [t for _, t in part], shingles_of([t for _, t in part])


def fingerprint(found: np.ndarray) -> int:
    """64-bit name of a set: two independent sums over its members, mixed."""
    with np.errstate(over="ignore"):
        rolled = (found ^ (found >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
        total = found.sum(dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.bitwise_xor.reduce(rolled, initial=np.uint64(len(found)))
        total = (total ^ (total >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return int((total ^ (total >> np.uint64(29))).view(np.int64))


def _surveyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row (doc_id, n, node) per document, and the task's counts of hashed shingles in slices."""
    counts = np.zeros(SKETCH, np.int32)
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("node", pa.int64()), ("slice", pa.int32()), ("counts", pa.binary())])
    for ids, _, sets in _rows(batches, 80):
        if not ids:
            continue
        full = np.concatenate(sets)
        np.add.at(counts, (full & np.uint64(SKETCH - 1)).astype(np.int64), 1)
        none = [None] * len(ids)
        yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(list(map(len, sets)), pa.int64()), pa.array(list(map(fingerprint, sets)), pa.int64()), pa.array(none, pa.int32()), pa.array(none, pa.binary())], schema=schema)
    if counts.any():
        slices = [zlib.compress(part.tobytes(), 1) for part in counts.reshape(SLICES, -1)]
        none = [None] * SLICES
        yield pa.record_batch([pa.array(none, pa.int64()), pa.array(none, pa.int64()), pa.array(none, pa.int64()), pa.array(range(SLICES), pa.int32()), pa.array(slices, pa.binary())], schema=schema)


def _unpacked(counts: bytes) -> np.ndarray:
    plain = zlib.decompress(counts)
    return np.frombuffer(plain, np.int64 if len(plain) == SKETCH // SLICES * 8 else np.int32).astype(np.int64)


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for key, counts in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            sums[key] = sums.get(key, 0) + _unpacked(counts.as_py())
    if sums:
        yield pa.record_batch([pa.array(list(sums), pa.int32()), pa.array([zlib.compress(v.tobytes(), 1) for v in sums.values()], pa.binary())], names=["slice", "counts"])


def choose_prefix(found: np.ndarray, counts: np.ndarray, bar: float, percent: int) -> tuple[np.ndarray, int, int]:
    """The prefix of a set in the global order, the number ``l`` of shared shingles it asks for, and how many
    shingles of the prefix are frequent.

    The estimated cost of ``l`` is the length of its prefix, the postings it meets through frequent shingles,
    and the candidates that share passages by chance, fewer the more shared shingles are asked for. Counters
    below ``bar`` say nothing: their shingles count as rare and are ordered by hash, before the others.
    """
    n = len(found)
    overlap = -(-percent * n // 100)
    load = counts[(found & np.uint64(SKETCH - 1)).astype(np.int64)]
    frequent = load > bar
    order, extra = found, np.zeros(1)
    rare = n
    if frequent.any():
        hot, weight = found[frequent], load[frequent] - bar
        by = np.lexsort((hot, weight))
        rare = n - len(hot)
        order = np.concatenate((found[~frequent], hot[by]))
        extra = np.concatenate((np.zeros(rare), np.cumsum(weight[by])))
    choices = np.unique(np.minimum(1 << np.arange(16), overlap))
    ends = n - overlap + choices
    cost = ends + MET * extra[np.minimum(ends, len(extra)) - 1] + CHANCE * n / choices
    best = int(np.argmin(cost))
    return order[: ends[best]], int(choices[best]), max(0, int(ends[best]) - rare)


def _postings(sketch, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = sketch.value
        mean = counts.mean(dtype=np.float64)
        bar = mean + 3 * np.sqrt(mean) + 1  # chance alone seldom fills a counter so far
        seen: OrderedDict[int, None] = OrderedDict()
        for _, _, sets in _rows(batches, percent):
            tokens, nodes, sizes, needs, hots, places = [], [], [], [], [], []
            for found in sets:
                if not len(found):
                    continue
                node = fingerprint(found)
                if node in seen:
                    seen.move_to_end(node)
                    continue
                seen[node] = None
                if len(seen) > REMEMBERED:
                    seen.popitem(last=False)
                prefix, need, hot = choose_prefix(found, counts, bar, percent)
                tokens.append(prefix)
                nodes.append(np.full(len(prefix), node, np.int64))
                sizes.append(np.full(len(prefix), len(found), np.int32))
                needs.append(np.full(len(prefix), need, np.int32))
                hots.append(np.full(len(prefix), hot, np.int32))
                places.append(np.arange(len(prefix), dtype=np.int32))
            if tokens:
                yield pa.record_batch(
                    [pa.array(np.concatenate(tokens).view(np.int64)), *(pa.array(np.concatenate(c)) for c in (nodes, sizes, needs, hots, places))],
                    names=["token", "node", "n", "need", "hot", "place"],
                )

    return run


def _verified(percent: int):
    """Keeps pairs whose texts are similar enough; texts that do not belong to the node are passed over."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[int, np.ndarray] | None = None
        for batch in batches:
            a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
            x, y = batch.column("text_a").to_pylist(), batch.column("text_b").to_pylist()
            keep = []
            for part in pieces(list(range(len(a))), [len(t) for t in y]):
                for k, other in zip(part, shingles_of([y[k] for k in part]), strict=True):
                    if last is None or last[0] != a[k]:
                        last = (a[k], shingles_of([x[k]])[0])
                    mine = last[1]
                    if fingerprint(mine) != a[k]:
                        last = None
                        continue
                    if fingerprint(other) != b[k]:
                        continue
                    shared = len(mine) + len(other) - len(np.union1d(mine, other))
                    if 100 * shared >= percent * (len(mine) + len(other) - shared):
                        keep.append(k)
            yield pa.record_batch([pa.array([a[k] for k in keep], pa.int64()), pa.array([b[k] for k in keep], pa.int64())], names=["a", "b"])

    return run


def _similar(pairs: DataFrame, texts: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of nodes that are similar enough; only the texts of these nodes are shuffled."""
    needed = members.join(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct(), "node")
    held = cut_lineage(maybe_in(texts, needed, "doc_id").join(needed, "doc_id").select("node", "text"))
    left = held.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
    right = held.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
    return pairs.select("a", "b").join(right, "b").join(left, "a").sortWithinPartitions("a").mapInArrow(_verified(percent), "a long, b long").distinct()


def _placed(texts: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, n, node) of the texts that have an id, and those of them with shingles with their component."""
    spark = texts.sparkSession
    survey = cut_lineage(texts.mapInArrow(_surveyed, "doc_id long, n long, node long, slice int, counts binary"))
    named = survey.where("slice is null").select("doc_id", "n", "node")
    # one fixed-size sketch (16 MB), whatever the number of documents
    slices = survey.where("slice is not null").select("slice", "counts").mapInArrow(_summed, "slice int, counts binary")
    sums = slices.repartition(SLICES, "slice").mapInArrow(_summed, "slice int, counts binary").collect()
    counts = np.zeros((SLICES, SKETCH // SLICES), np.int32)
    for row in sums:
        counts[row["slice"]] = np.minimum(np.frombuffer(zlib.decompress(row["counts"]), np.int64), 2**31 - 1)
    sketch = spark.sparkContext.broadcast(counts.ravel())
    postings = texts.mapInArrow(_postings(sketch, percent), "token long, node long, n int, need int, hot int, place int")
    # a shingle in the prefix of one set only leads nowhere
    token = Window.partitionBy("token")
    shared = cut_lineage(
        postings.withColumn("least", F.min("node").over(token)).withColumn("last", F.max("node").over(token))
        .withColumn("lead", F.max(F.struct("hot", "node")).over(token)["node"])
        .where("least <> last").drop("least", "last", "hot").distinct()
    )
    members = named.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("doc_id"))
    # one comparison per set: with the lead that it shares most prefix shingles with; the lead of a list is its
    # most typical member, whose prefix holds most frequent shingles
    facts = shared.groupBy("node").agg(F.first("n").alias("n"), F.first("need").alias("need"))
    lead = facts.select(F.col("node").alias("lead"), F.col("n").alias("n_lead"), F.col("need").alias("need_lead"))
    stars = (
        shared.where("node <> lead").groupBy("node", "lead").agg(F.count("*").alias("times"), F.first("n").alias("n"), F.first("need").alias("need"))
        .join(lead, "lead")
        .where(f"times >= least(need, need_lead) and 100 * n_lead >= {percent} * n and 100 * n >= {percent} * n_lead")
        .groupBy("node").agg(F.max(F.struct("times", "lead")).alias("best"))
        .select(F.col("best.lead").alias("a"), F.col("node").alias("b"))
    )
    links = cut_lineage(_similar(cut_lineage(stars), texts, members, percent))
    first = components(links)
    # what is left: pairs from different components that share enough
    placed = shared.drop("lead").join(first, "node", "left").withColumn("component", F.coalesce("component", "node"))
    sizes = placed.groupBy("token", "component").agg(F.count("*").alias("times"))
    main = (
        sizes.groupBy("token").agg(F.max(F.struct("times", "component")).alias("main"), F.min("component").alias("low"), F.max("component").alias("high"))
        .where("low <> high").select("token", F.col("main.component").alias("main"))
    )
    open_ = cut_lineage(placed.join(main, "token"))
    minor = open_.where("component <> main").select("token", F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("need").alias("need_a"), F.col("place").alias("p_a"), F.col("component").alias("c_a"))
    every = open_.select("token", F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("need").alias("need_b"), F.col("place").alias("p_b"), F.col("component").alias("c_b"), (F.col("component") != F.col("main")).alias("minor_b"))

    # what two sets of these sizes share at least if they are similar enough: shared shingles count where their
    # place is in the prefix for that overlap
    overlap = f"ceil({percent} * (n_a + n_b) / {100 + percent})"

    pairs = (
        minor.join(every, "token")
        .where(
            f"c_a <> c_b and (not minor_b or a < b) and 100 * n_b >= {percent} * n_a and 100 * n_a >= {percent} * n_b"
            f" and p_a < n_a - {overlap} + least(need_a, need_b) and p_b < n_b - {overlap} + least(need_a, need_b)"
        )
        .groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        .agg(F.count("*").alias("times"), F.min(F.least("need_a", "need_b")).alias("need"))
        .where("times >= need")
    )
    more = _similar(cut_lineage(pairs), texts, members, percent)
    joined = components(links.unionByName(more))
    placed = named.where("n > 0").join(joined, "node", "left").withColumn("component", F.coalesce("component", "node"))
    return named, placed


def ngram_components(docs: DataFrame, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of ``docs`` (doc_id, text; other columns are ignored).

    Words are runs without ASCII white space, A-Z lower-cased; a set holds the distinct five-word shingles, or
    the whole sequence of a shorter text. Sets are compared by 64-bit hashes. Two documents link when
    ``100 * intersection >= percent * union``; ``component_id`` is the smallest id reachable by links.

    Null or empty texts and texts without words have ``n_shingles`` 0 and link with nothing. Rows with a null
    id have null results, one row each. Rows that repeat an id are one document each way: all rows of an id
    whose texts differ keep their own set, and the smallest id of their component. An empty table gives none.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    named, placed = _placed(texts, percent)
    least = placed.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    # copies of one set may be many: only the few nodes are joined with the least ids, then looked up by node
    nodes = placed.groupBy("node", "component").agg(F.lit(1).alias("one")).join(least, "component").select("node", "component_id")
    known = named.join(nodes, "node", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
    without = texts.where("doc_id is null").select("doc_id", F.lit(None).cast("long").alias("n_shingles"), F.lit(None).cast("long").alias("component_id"))
    return known.unionByName(without)


def _noded(schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(batch.schema.names.index("text")).to_pylist()]
            nodes = [fingerprint(found) for part in pieces(texts, list(map(len, texts))) for found in shingles_of(part)]
            yield pa.record_batch([*batch.columns, pa.array(nodes, pa.int64())], names=schema.names)

    return run


def first_of_components(docs: DataFrame, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` without near copies: of each component of ``ngram_components``, one row.

    It is a row with the smallest id, and among the rows of that id one of the smallest set's name, then text. Rows
    are told apart by id and set, so a row is not dropped for another with its id; rows that repeat both are copies. Rows
    with a null id are compared too and come after those with an id. Rows without words have no copies: all stay.
    """
    # a null id gets a number from the text: rows of one text are copies, and sets tell apart what meets by chance
    number = F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("text").bitwiseAND(F.lit((1 << 62) - 1)) + F.lit(1 << 62))
    _, placed = _placed(docs.select(number.alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")), percent)
    # both sides hold an id and set once, however large a component is
    times = placed.groupBy("doc_id", "node").agg(F.count("*").alias("times"))
    firsts = placed.groupBy("component").agg(F.min(F.struct("doc_id", "node")).alias("first")).select("first.*", F.lit(True).alias("kept"))
    told = times.join(firsts, ["doc_id", "node"], "left").select(
        F.col("doc_id").alias("__id"), F.col("node").alias("__node"), "times", F.col("kept").isNotNull().alias("kept")
    )
    told = cut_lineage(told.where("not kept or times > 1"))
    numbered = docs.withColumn("__id", number)
    schema = T.StructType([*numbered.schema.fields, T.StructField("__node", T.LongType())])
    rows = numbered.mapInArrow(_noded(schema), schema)
    alone = rows.join(told.select("__id", "__node"), ["__id", "__node"], "left_anti").select(*docs.columns)
    # one of the rows that repeat id and set; they combine before the shuffle
    again = told.where("kept").select("__id", "__node")
    same = maybe_in(numbered, again, "__id")
    same = same.mapInArrow(_noded(schema), schema).groupBy("__id", "__node").agg(F.min_by(F.struct(*docs.columns), "text").alias("row"))
    return alone.unionByName(same.join(again, ["__id", "__node"], "left_semi").select("row.*"))
