"""Exact top-k neighbours that compare only the items a query can still need.

Every item belongs to the pivot it is nearest to. Two bounds hold for all items of a pivot: the triangle inequality
with the pivot's distances, and the distance to the plane half way between two pivots. Pivots that are near each other
share a block of items, and there are few blocks. A query goes to the block of its nearest pivot first, and then once to
each other block that holds a pivot within its k-th distance. Inside a block the items of a pivot lie in rings of like
distance, and a ring is compared only with the queries whose bound is within their k-th distance by then.

Vectors that lie in all directions alike (random ones of many dimensions) are about equally far from every pivot:
nothing can be left out there, and ``nearest`` does the same work in one round.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from seamline.operators.nearest import COSINE, EUCLIDEAN, TILE_ITEMS, TILE_QUERIES, Kept, block_number, matrix
from seamline.session import bound_batches, cut_lineage, spread

#: Pivots at most, and sampled items for each of them.
MOST_PIVOTS, SAMPLED = 256, 16
#: Rounding errors of distances, in parts of the vectors' lengths, and of squared distances of unit vectors.
SLACK, UNIT_SLACK = 1e-6, 1e-5


FOUND = "query_id long, item_id long, score double"


def farthest_points(vectors: np.ndarray, wanted: int) -> tuple[np.ndarray, float]:
    """Positions of ``wanted`` rows, each the farthest from those before, from row 0 on, and the distance within
    which they cover all rows."""
    picked = [0]
    gap = np.linalg.norm(vectors - vectors[0], axis=1)
    while len(picked) < wanted:
        picked.append(int(gap.argmax()))
        gap = np.minimum(gap, np.linalg.norm(vectors - vectors[picked[-1]], axis=1))
    return np.asarray(picked), float(gap.max())


def farthest_order(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All rows in the order of ``farthest_points``, and how far those before had left each; infinity for the first."""
    order, gaps = [0], [np.inf]
    gap = np.linalg.norm(vectors - vectors[0], axis=1)
    gap[0] = -1.0
    while len(order) < len(vectors):
        order.append(int(gap.argmax()))
        gaps.append(max(0.0, float(gap[order[-1]])))
        gap = np.minimum(gap, np.linalg.norm(vectors - vectors[order[-1]], axis=1))
        gap[order[-1]] = -1.0
    return np.asarray(order), np.asarray(gaps)


def _distances(vectors: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    squares = (vectors**2).sum(axis=1)[:, None] + (pivots**2).sum(axis=1) - 2 * vectors @ pivots.T
    return np.sqrt(np.maximum(squares, 0))


def _placed(pivots, width: int, unit: bool):
    """Items with their pivot and their distance to it."""

    def run(batches):
        points = pivots.value
        for batch in batches:
            vectors = matrix(batch, "item_id", width)
            _check_units(batch, "item_id", vectors, unit)
            own = _distances(vectors, points).argmin(axis=1) if len(vectors) else np.zeros(0, np.int64)
            away = np.linalg.norm(vectors - points[own], axis=1)
            yield pa.record_batch(
                [*batch.columns, pa.array(own.astype(np.int32)), pa.array(away)], names=[*batch.schema.names, "pivot", "away"]
            )

    return run


def _check_units(batch: pa.RecordBatch, name: str, vectors: np.ndarray, unit: bool) -> None:
    wrong = np.flatnonzero(np.abs(np.linalg.norm(vectors, axis=1) - 1) > SLACK) if unit else ()
    if len(wrong):
        raise ValueError(f"not a unit vector: {name} {batch.column(name)[int(wrong[0])].as_py()}")


def bounds(distances: np.ndarray, points: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Of each query (row) and pivot (column), what every item of the pivot is away from the query at least.

    ``distances``: of queries to pivots; ``low`` and ``high``: of the items of each pivot to it.
    """
    ring = np.maximum(distances - high, low - distances)
    own = distances.argmin(axis=1)
    nearest = distances[np.arange(len(own)), own][:, None]
    apart = _distances(points, points)[own]
    plane = np.divide(distances**2 - nearest**2, 2 * apart, out=np.zeros_like(distances), where=apart > 0)
    return np.maximum(np.maximum(ring, plane), 0)


def _slack(vectors: np.ndarray, points: np.ndarray) -> np.ndarray:
    return SLACK * (1 + np.linalg.norm(vectors, axis=1) + np.linalg.norm(points, axis=1).max())


def _visits(pivots, low: np.ndarray, high: np.ndarray, held: np.ndarray, width: int, unit: bool, first: bool):
    """The blocks that queries go to: the one of the nearest pivot, or the others within reach.

    ``low``, ``high``: of the items of each pivot to it; ``held``: which blocks (columns) hold items of a pivot."""

    def run(batches):
        points, full = pivots.value, held.any(axis=1)
        for whole in batches:
            for at in range(0, len(whole), TILE_QUERIES):
                batch = whole.slice(at, TILE_QUERIES)
                vectors = matrix(batch, "query_id", width)
                _check_units(batch, "query_id", vectors, unit)
                reach = batch.column(batch.schema.names.index("reach")).to_numpy(zero_copy_only=False)
                least = np.where(full, bounds(_distances(vectors, points), points, low, high), np.inf)
                home = held[least.argmin(axis=1)].argmax(axis=1)
                within = (least <= (reach + _slack(vectors, points))[:, None]) & full
                blocks = within @ held
                blocks[np.arange(len(home)), home] = False
                asked = [[block] for block in home] if first else [np.flatnonzero(row) for row in blocks]
                new = pa.array(asked, pa.list_(pa.int32()))
                yield pa.record_batch([*batch.columns, new], names=[*batch.schema.names, "blocks"])

    return run


def _meeting(pivots, low: np.ndarray, high: np.ndarray, width: int, k: int, metric: str, skip_self: bool, ring_rows: int):
    """What a task does with queries and the items of a block: the neighbours found, and in a row without a query the
    number of pairs compared."""

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[list] = [[], [], []]
        compared = 0
        if len(left) and len(right):
            points, unit = pivots.value, metric == COSINE
            right = right.sort_by([("pivot", "ascending"), ("away", "ascending"), ("item_id", "ascending")])
            items, item_ids = matrix(right, "item_id", width), right["item_id"].to_numpy()
            squares, own, away = (items**2).sum(axis=1), right["pivot"].to_numpy(), right["away"].to_numpy()
            cells = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
            starts = np.concatenate([np.arange(a, b, ring_rows) for a, b in zip(cells, [*cells[1:], len(own)])])
            ends = np.r_[starts[1:], len(own)]
            pivot, inner, outer = own[starts], away[starts], away[ends - 1]
            queries, reach = matrix(left, "query_id", width), left["reach"].to_numpy()
            order = np.argsort(_nearest_pivot(queries, points), kind="stable")  # queries of one pivot together
            for at in range(0, len(order), TILE_QUERIES):
                rows = order[at : at + TILE_QUERIES]
                kept = Kept(left["query_id"].to_numpy()[rows], queries[rows], k, metric, skip_self)
                slack, to = _slack(queries[rows], points), _distances(queries[rows], points)
                far = reach[rows] + slack
                kept.within = far**2 / 2 - 1 if unit else far
                least = np.maximum(bounds(to, points, low, high)[:, pivot], np.maximum(to[:, pivot] - outer, inner - to[:, pivot]))
                for ring in np.argsort(least.mean(axis=0), kind="stable"):
                    worst = kept.costs[:, -1]
                    worst = np.sqrt(np.maximum(0, 2 + 2 * worst) + UNIT_SLACK) if unit else worst
                    asking = np.flatnonzero(least[:, ring] <= np.minimum(worst + slack, far))
                    if len(asking):
                        part = slice(starts[ring], ends[ring])
                        compared += len(asking) * int(ends[ring] - starts[ring])
                        kept.offer(item_ids[part], items[part], squares[part], asking)
                for column, values in zip(out, kept.found()):
                    column.append(values)
        query, item, score = (np.concatenate(v) if v else np.array([], np.int64) for v in out)
        count = pa.array([None], pa.int64())
        return pa.table({
            "query_id": pa.chunked_array([pa.array(query, pa.int64()), count]),
            "item_id": pa.chunked_array([pa.array(item, pa.int64()), count]),
            "score": pa.chunked_array([pa.array(score, pa.float64()), pa.array([float(compared)])]),
        })

    return meet


def _nearest_pivot(vectors: np.ndarray, points: np.ndarray) -> np.ndarray:
    """The number of the pivot each vector is nearest to."""
    tiles = [_distances(vectors[at : at + TILE_QUERIES], points).argmin(axis=1) for at in range(0, len(vectors), TILE_QUERIES)]
    return np.concatenate(tiles)


def chain(points: np.ndarray) -> np.ndarray:
    """Positions of the points in an order in which each is followed by the nearest one left."""
    order, left = [0], np.ones(len(points), bool)
    gaps = _distances(points, points)
    while len(order) < len(points):
        left[order[-1]] = False
        order.append(int(np.where(left, gaps[order[-1]], np.inf).argmin()))
    return np.asarray(order)


def choose_pivots(items: DataFrame, count: int, width: int) -> np.ndarray:
    """``count`` far points of a sample of 16 times as many items: those with the smallest hash of their id."""
    sample = items.select("item_id", "embedding").orderBy(F.xxhash64("item_id"), "item_id").limit(count * SAMPLED).toArrow()
    known = matrix(sample, "item_id", width)
    return known[np.unique(farthest_points(known, min(count, len(known)))[0])]


def pivot_cells(items: DataFrame, count: int) -> DataFrame:
    """``items`` (item_id, embedding) with the ``pivot`` each is nearest to, and the distance ``away`` from it."""
    width = items.agg(F.max(F.size("embedding"))).first()[0] or 1
    sent = items.sparkSession.sparkContext.broadcast(choose_pivots(items, count, width))
    return items.mapInArrow(_placed(sent, width, False), _wider(items, pivot=T.IntegerType(), away=T.DoubleType()))


def _wider(df: DataFrame, **columns: T.DataType) -> T.StructType:
    return T.StructType([*df.schema.fields, *[T.StructField(name, kind) for name, kind in columns.items()]])


class Search:
    """A search by pivots. ``rows`` has the result; ``compared`` and ``pairs`` count the pairs that were compared, and
    all pairs of queries and items."""

    def __init__(
        self, queries: DataFrame, items: DataFrame, k: int, metric: str = EUCLIDEAN, skip_self: bool = False,
        pivots: int | None = None, block_rows: int | None = None,
    ):
        """``queries``: query_id, embedding; ``items``: item_id, embedding. Results and errors are those of ``nearest``
        without groups; cosines ask for unit vectors. A query without any item has no row.

        ``pivots``: the square root of the number of items unless given, 256 at most; they come from a sample of 16
        items for each, which changes what is left out, never the result. ``block_rows``: items in a ring; there is a
        block for every so many items too, but no more than ``nearest`` has.
        """
        self.spark, self.k, self.unit = queries.sparkSession, k, metric == COSINE
        bound_batches(self.spark)
        self.queries, items = queries.select("query_id", "embedding"), items.select("item_id", "embedding")
        size = items.agg(F.count("*").alias("n"), F.max(F.size("embedding")).alias("d")).first()
        self.width, self.args = size["d"] or 1, (k, metric, skip_self)
        self.block_rows = block_rows or TILE_ITEMS
        self.asked = self.queries.count()
        self.compared, self.pairs = 0, size["n"] * self.asked
        self.rows = self.spark.createDataFrame([], FOUND)
        if size["n"]:
            self._place(items, size["n"], min(pivots or math.isqrt(size["n"]), MOST_PIVOTS))
            self._search()

    def _place(self, items: DataFrame, total: int, count: int) -> None:
        points = choose_pivots(items, count, self.width)
        points = points[chain(points)]
        self.sent = self.spark.sparkContext.broadcast(points)  # at most 256 vectors
        schema = _wider(items, pivot=T.IntegerType(), away=T.DoubleType())
        placed = cut_lineage(items.mapInArrow(_placed(self.sent, self.width, self.unit), schema))
        found = placed.groupBy("pivot").agg(F.count("*").alias("n"), F.min("away").alias("low"), F.max("away").alias("high")).collect()
        self.low, self.high, sizes = np.zeros(len(points)), np.zeros(len(points)), np.zeros(len(points), np.int64)
        for row in found:
            self.low[row["pivot"]], self.high[row["pivot"]], sizes[row["pivot"]] = row["low"], row["high"], row["n"]
        # pivots one after the other along the chain, cut into blocks of equal size wherever a cut falls
        blocks = block_number(total, self.block_rows, self.width)
        rows, offsets = -(-total // blocks), np.cumsum(sizes) - sizes
        self.held = np.zeros((len(points), blocks), bool)
        for pivot in np.flatnonzero(sizes):
            self.held[pivot, offsets[pivot] // rows : (offsets[pivot] + sizes[pivot] - 1) // rows + 1] = True
        known = [(int(p), int(offsets[p]), int(sizes[p])) for p in np.flatnonzero(sizes)]
        place = F.col("offset") + F.pmod(F.xxhash64("item_id"), F.col("n"))
        joined = placed.join(F.broadcast(self.spark.createDataFrame(known, "pivot int, offset long, n long")), "pivot")
        self.items = joined.select("item_id", "embedding", "pivot", "away", F.floor(place / rows).cast("int").alias("block"))

    def _search(self) -> None:
        first = self._round(self.queries.withColumn("reach", F.lit(float("inf"))), True)
        ends = first.groupBy("query_id").agg(F.count("*").alias("n"), self._farthest().alias("end"))
        reach = F.when(F.col("n") >= self.k, F.col("end")).otherwise(float("inf"))
        state = self.queries.join(ends, "query_id", "left").select("query_id", "embedding", reach.alias("reach"))
        found = first.unionByName(self._round(state, False))
        order = F.desc("score") if self.unit else F.asc("score")
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(order, "item_id"))
        self.rows = found.withColumn("_rank", rank).filter(F.col("_rank") <= self.k).drop("_rank")

    def _farthest(self):
        """The distance of the worst of some neighbours."""
        if self.unit:
            return F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * F.min("score")) + UNIT_SLACK)
        return F.max("score")

    def _round(self, state: DataFrame, first: bool) -> DataFrame:
        """What queries find in the blocks they go to. Queries of a block are cut into parts, its items go to each."""
        visits = _visits(self.sent, self.low, self.high, self.held, self.width, self.unit, first)
        schema = _wider(self.queries, reach=T.DoubleType(), blocks=T.ArrayType(T.IntegerType()))
        left = cut_lineage(state.mapInArrow(visits, schema)).withColumn("block", F.explode("blocks")).drop("blocks")
        part_rows = -(-self.asked // block_number(self.asked, self.block_rows, self.width)) or 1
        parts = F.broadcast(left.groupBy("block").agg(F.ceil(F.count("*") / part_rows).cast("int").alias("parts")))
        left = left.join(parts, "block").withColumn("part", F.pmod(F.xxhash64("query_id"), F.col("parts")).cast("int"))
        right = self.items.join(parts, "block").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        key = ["block", "part"]
        sides = [(left, ["query_id", "embedding", "reach"]), (right, ["item_id", "embedding", "pivot", "away"])]
        sides = [spread(side.select(*[F.col(c).alias(c) for c in [*key, *names]]), *key).groupBy(*key) for side, names in sides]
        meet = _meeting(self.sent, self.low, self.high, self.width, *self.args, self.block_rows)
        found = cut_lineage(sides[0].cogroup(sides[1]).applyInArrow(meet, FOUND))
        self.compared += int(found.where("query_id is null").agg(F.sum("score")).first()[0] or 0)
        return found.where("query_id is not null")


def nearest_by_pivots(queries: DataFrame, items: DataFrame, k: int, metric: str = EUCLIDEAN, **options) -> DataFrame:
    """(query_id, item_id, score) of the ``k`` best items of every query; see ``Search``."""
    return Search(queries, items, k, metric, **options).rows
