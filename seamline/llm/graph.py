"""Connected components of an edge table, as joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seamline.session import cut_lineage


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of the undirected ``edges`` (a, b); a component is named by its smallest node.

    Alternates the large-star and small-star rewriting: each node's neighbours are linked to its smallest
    neighbour, first the larger ones, then the smaller ones, until every edge points at the root of its star.
    A hub is one row per neighbour and a minimum per node, never a collected group; both minima combine before
    the shuffle. Rounds grow with the logarithm of the largest component.

    Self loops, repeated edges and edges with a null end add nothing; an empty table gives an empty result.
    """
    now = cut_lineage(_distinct(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))))
    state = _state(now)
    while state[0]:
        now = cut_lineage(_small_star(_large_star(now)))
        before, state = state, _state(now)
        if state == before:
            break
    stars = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component"))
    return _distinct(stars.unionByName(roots))


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def _distinct(edges: DataFrame) -> DataFrame:
    return edges.distinct()


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    return _distinct(both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b"))


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    linked = edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
    return _distinct(linked.unionByName(least.select("a", F.col("m").alias("b"))))


def looked_up(rows: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """``rows`` with the columns that ``known`` has for their ``key``; its ``times`` says how many rows have that key.

    Keys of more than a thousandth of all rows are at most a thousand: these are broadcast, so that no task gets all
    rows of a frequent key. All others are joined by shuffle. Rows with a null or unknown key go.
    """
    total = known.agg(F.sum("times")).first()[0] or 0
    often = F.col("times") * 1000 > total
    few = F.broadcast(known.where(often).drop("times"))
    rest = rows.join(few.select(key), key, "left_anti").join(known.where(~often).drop("times"), key)
    return rows.join(few, key).unionByName(rest)
