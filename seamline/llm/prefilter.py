"""Rows that may have a partner in another table, without a shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits of the filter; it is this large whatever the number of keys, 4 KB for each row of 32,768 bits.
BITS = 1 << 24


def maybe_in(df: DataFrame, keys: DataFrame, column: str) -> DataFrame:
    """Rows of ``df`` whose key is in ``keys``, and some others: a semi-join against a bitmap of hashed keys.

    For use before a join of wide rows. The bitmap is at most 2 MB, so it is broadcast at any scale; with many
    more keys than bits it lets everything through and the join that follows does the work. Null keys go.
    """
    spot = F.pmod(F.xxhash64(column), F.lit(BITS))
    bits = keys.where(F.col(column).isNotNull()).groupBy(F.bitmap_bucket_number(spot).alias("__bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(spot)).alias("__bits"))
    place = F.bitmap_bit_position(spot).cast("int")
    byte = F.conv(F.hex(F.substring("__bits", F.shiftright(place, 3) + 1, F.lit(1))), 16, 10).cast("int")
    placed = df.where(F.col(column).isNotNull()).withColumn("__bucket", F.bitmap_bucket_number(spot))
    found = placed.join(F.broadcast(bits), "__bucket").where(F.getbit(byte, F.pmod(place, F.lit(8))) == 1)
    return found.drop("__bucket", "__bits")
