"""Placement of documents in shards by a permutation-filled lookup table.

Method: each shard has its own order of the slots of a prime-sized table (an offset and a step from hashes of
its name). The shards take turns; each claims the first slot of its order that is free. A document's hash
names a slot and the slot its shard: one lookup in a broadcast table. Taking a shard away moves its own
documents and few others. DataFrame functions only.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Slots, a prime; the broadcast table has this many rows at any number of documents. The shares of shards
#: differ by at most one slot, so a table should have a hundred slots a shard or more.
SLOTS = 65_537


def _number(text: str) -> int:
    """The first 60 bits of the MD5 digest."""
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def fill(shards: Sequence[str], slots: int = SLOTS) -> list[int]:
    """The shard (by its place in ``shards``) of every slot."""
    if not shards or len(set(shards)) < len(shards):
        raise ValueError("shards need different names")
    if len(shards) > slots or slots < 2 or any(slots % k == 0 for k in range(2, int(slots**0.5) + 1)):
        raise ValueError("the number of slots is to be a prime, and not below that of shards")
    at = [_number(f"{name}/offset") % slots for name in shards]
    step = [_number(f"{name}/step") % (slots - 1) + 1 for name in shards]
    table = [-1] * slots
    for turn in range(slots):
        shard = turn % len(shards)
        while table[at[shard]] >= 0:
            at[shard] = (at[shard] + step[shard]) % slots
        table[at[shard]] = shard
    return table


def lookup_table(spark: SparkSession, shards: Sequence[str], slots: int = SLOTS) -> DataFrame:
    return spark.createDataFrame([(slot, shards[shard]) for slot, shard in enumerate(fill(shards, slots))], "__slot long, __shard string")


def place(docs: DataFrame, shards: Sequence[str], slots: int = SLOTS, key: str = "doc_id") -> DataFrame:
    """``docs`` with the columns ``slot`` and ``shard``, which depend on the key's value alone.

    Rows that repeat a key go to one shard; a null key counts as the empty text. Columns named slot or shard are
    replaced; all others are passed on. An empty table gives an empty result.
    """
    docs = docs.drop("slot", "shard")
    digest = F.substring(F.md5(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")), 1, 15)
    keyed = docs.withColumn("slot", F.pmod(F.conv(digest, 16, 10).cast("long"), F.lit(slots)))
    table = F.broadcast(lookup_table(docs.sparkSession, shards, slots))
    return keyed.join(table, F.col("slot") == F.col("__slot")).drop("__slot").withColumnRenamed("__shard", "shard")
