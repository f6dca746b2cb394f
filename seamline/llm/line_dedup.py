"""Lines that several documents hold stay in one of them.

Method: a sharded minimal perfect hash over the hashes of repeated lines indexes arrays of fingerprints,
counts and keeping documents. Documents send the hashes of their lines to the shards and probe the arrays;
line texts are never joined or shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seamline.llm.perfect_hash import PerfectHash
from seamline.llm.texts import encoded
from seamline.session import cut_lineage

BLANKS = " \t\n\x0b\x0c\r"
#: Distinct repeated lines in a shard, the most shards (they bound the table of salts), and probes in a group.
SHARD_LINES, MOST_SHARDS, GROUP_PROBES = 1 << 15, 1 << 16, 200_000
#: Stands for a null id; such rows count as one document, ordered last.
NO_ID = (1 << 63) - 1


def line_hash(line: str, shortest: int) -> tuple[int, int] | None:
    """Two 64-bit hashes of a line's key, as signed numbers; none for a key of too few code points."""
    key = line.strip(BLANKS)
    if len(key) < shortest:
        return None
    whole = xxhash.xxh3_128_intdigest(encoded(key).lower())
    return (whole >> 64) - (1 << 63), (whole & (1 << 64) - 1) - (1 << 63)


def _hashed(shortest: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows, places, prints = [], [], [], []
            for doc, row, text in zip(*(column.to_pylist() for column in batch.columns), strict=True):
                found = {line_hash(line, shortest) for line in (text or "").split("\n")} - {None}
                ids += [doc] * len(found)
                rows += [row] * len(found)
                places += [a for a, _ in found]
                prints += [b for _, b in found]
            yield pa.record_batch([pa.array(c, pa.int64()) for c in (ids, rows, places, prints)], names=["doc", "row", "place", "print"])

    return run


def _built(key, table):
    places = table["place"].to_numpy().view(np.uint64)
    prints, keepers, counts = (table[name].to_numpy() for name in ("print", "keeper", "times"))
    # two keys that share the placing hash cannot share a slot: the second goes to the overflow arrays
    order = np.lexsort((prints, places))
    twin = np.zeros(len(order), bool)
    twin[1:] = places[order][1:] == places[order][:-1]
    plain, over = order[~twin], order[twin]
    index = PerfectHash.build(places[plain])
    slots = index.find(places[plain])
    arrays = {}
    for name, values, kind in (("prints", prints, np.int64), ("keepers", keepers, np.int64), ("counts", np.minimum(counts, 2**32 - 1), np.uint32)):
        ordered = np.empty(len(plain), kind)
        ordered[slots] = values[plain].astype(kind)
        arrays[name] = ordered.tobytes()
    extra = np.stack([places.view(np.int64)[over], prints[over], keepers[over]]).tobytes()
    return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), "index": pa.array([index.dump()], pa.list_(pa.binary())), **{k: pa.array([v], pa.binary()) for k, v in arrays.items()}, "extra": pa.array([extra], pa.binary())})


def _probed(key, probes, shards):
    """Probes whose line another document keeps."""
    drop = np.zeros(probes.num_rows, bool)
    docs, places, prints = (probes[name].to_numpy() for name in ("doc", "place", "print"))
    for shard in shards.to_pylist():
        slots = PerfectHash.load(shard["index"]).find(places.view(np.uint64))
        at = np.flatnonzero(slots >= 0)
        if len(at):
            slots = slots[at]
            known = np.frombuffer(shard["prints"], np.int64)[slots] == prints[at]
            drop[at] |= known & (np.frombuffer(shard["keepers"], np.int64)[slots] != docs[at])
        for place, print_, keeper in np.frombuffer(shard["extra"], np.int64).reshape(3, -1).T:
            drop |= (places == place) & (prints == print_) & (docs != keeper)
    rows = probes["row"].to_numpy()
    return pa.table({name: pa.array(values[drop], pa.int64()) for name, values in (("doc", docs), ("row", rows), ("print", prints))})


def _rewritten(shortest: int, schema: pa.Schema | None = None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            drops = batch.column(names.index("__drops")).to_pylist()
            texts, lines, dropped = [], [], []
            for text, gone in zip(batch.column(names.index("text")).to_pylist(), drops, strict=True):
                parts = (text or "").split("\n")
                lines.append(len(parts))
                if gone:
                    gone = set(gone)
                    kept = [p for p in parts if (h := line_hash(p, shortest)) is None or h[1] not in gone]
                    dropped.append(len(parts) - len(kept))
                    texts.append("\n".join(kept))
                else:
                    dropped.append(0)
                    texts.append(text)
            columns = {n: batch.column(k) for k, n in enumerate(names) if n != "__drops"}
            columns |= {"text": pa.array(texts, pa.string()), "n_lines": pa.array(lines, pa.int64()), "n_dropped": pa.array(dropped, pa.int64())}
            yield pa.record_batch(list(columns.values()), names=list(columns))

    return run


def dedup_lines(docs: DataFrame, shortest: int = 10) -> DataFrame:
    """``docs`` with repeated lines taken out of ``text``, and columns n_lines (before) and n_dropped.

    A line's key is the line without ASCII white space at its ends, A-Z lower-cased. Keys of at least
    ``shortest`` code points that two or more documents hold lose all their lines except in the smallest
    ``doc_id`` holding them, where every occurrence stays. Other lines stay, joined by ``\\n``.

    A null text is one empty line and stays null; so does a text that loses nothing, byte for byte. A document
    that loses all lines gets an empty text. Rows with a null id count as one document, ordered after all
    others; rows that repeat an id count as one document as well, and each is rewritten. Columns named n_lines
    or n_dropped are replaced; all others are passed on. An empty table gives an empty result.
    """
    docs = docs.drop("n_lines", "n_dropped")
    # rows of one id, as those without any, get their own lines back: they are told apart by their texts
    keyed = docs.withColumns({"__doc": F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)), "__row": F.xxhash64("text")})
    hashed = cut_lineage(keyed.select("__doc", "__row", "text").mapInArrow(_hashed(shortest), "doc long, row long, place long, print long"))
    repeated = cut_lineage(
        hashed.groupBy("place", "print").agg(F.min("doc").alias("keeper"), F.max("doc").alias("last"), F.count("*").alias("times"))
        .where("keeper <> last").drop("last")
    )
    n = repeated.count()
    shards = min(MOST_SHARDS, -(-n // SHARD_LINES) or 1)
    shard = F.pmod("place", F.lit(shards)).cast("int").alias("shard")
    index = repeated.select(shard, "place", "print", "keeper", "times").groupBy("shard").applyInArrow(
        _built, "shard int, index array<binary>, prints binary, keepers binary, counts binary, extra binary"
    )
    # a frequent line sends one probe per document: its shard is probed in several groups
    usual = -(-hashed.count() // shards)
    salts = repeated.select(shard, "times").groupBy("shard").agg((F.sum("times") / GROUP_PROBES + usual / GROUP_PROBES + 1).cast("int").alias("salts"))
    probes = (
        hashed.select(shard, "doc", "row", "place", "print").join(F.broadcast(salts), "shard")
        .withColumn("salt", F.pmod(F.xxhash64("doc", "row"), F.col("salts")).cast("int")).drop("salts")
    )
    copies = index.join(F.broadcast(salts), "shard").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")
    drops = (
        probes.groupBy("shard", "salt").cogroup(copies.groupBy("shard", "salt")).applyInArrow(_probed, "doc long, row long, print long")
        .groupBy(F.col("doc").alias("__doc"), F.col("row").alias("__row")).agg(F.collect_set("print").alias("__drops"))
    )
    joined = keyed.join(drops, ["__doc", "__row"], "left").drop("__doc", "__row")
    fields = [f for f in docs.schema.fields] + [T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())]
    return joined.mapInArrow(_rewritten(shortest), T.StructType(fields))


def digests(docs: DataFrame, column: str, name: str) -> DataFrame:
    """``docs`` with the lowercase hex SHA-256 of a text column in UTF-8; null counts as empty."""
    return docs.withColumn(name, F.sha2(F.coalesce(F.col(column), F.lit("")).cast("binary"), 256))
