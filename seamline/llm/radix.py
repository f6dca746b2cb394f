"""Positions of rows in a sort order, by a distributed radix sort.

Method: least significant digit first. In every pass the rows lie in blocks of consecutive positions. A pass
counts each block's rows by digit, turns the counts into offsets (rows of smaller digits anywhere, then rows of
the same digit in earlier blocks), and sends each row to its offset plus its number within block and digit. The
order of rows that share a digit is kept, so after the last digit the rows are sorted.

The position is a column, not the place of a row in a partition: a lost task is run again with the same result.
DataFrame functions only. A pass costs one shuffle of the rows, by block and digit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seamline.session import cut_lineage, shuffle_partitions

#: Bits of a digit, and the most rows in a block.
DIGIT, MOST_ROWS = 12, 1 << 16


def _digits(keys: list[tuple[Column, int]]) -> list[Column]:
    """The digits of the composite of ``keys`` (number without sign, its bits), first key highest; lowest digit first."""
    spans, total = [], 0
    for number, bits in reversed(keys):
        spans.append((number, total, total + bits))
        total += bits
    digits = []
    for low in range(0, total, DIGIT):
        parts = F.lit(0).cast("long")
        for number, start, end in spans:
            first, last = max(low, start), min(low + DIGIT, end)
            if first < last:
                part = F.shiftrightunsigned(number, first - start).bitwiseAND((1 << (last - first)) - 1)
                parts = parts + F.shiftleft(part, first - low)
        digits.append(parts.cast("int"))
    return digits


def _pass(rows: DataFrame, digit: Column, size: int) -> DataFrame:
    """``rows`` with the ``__at`` that a stable counting sort by ``digit`` gives them."""
    placed = rows.withColumns({"__block": F.expr(f"__at div {size}L"), "__digit": digit})
    within = placed.withColumn("__number", F.row_number().over(Window.partitionBy("__block", "__digit").orderBy("__at")))
    counts = within.groupBy("__block", "__digit").agg(F.max("__number").alias("times"))
    # one row for each value of a digit, at most 4,096
    smaller = Window.orderBy("__digit").rowsBetween(Window.unboundedPreceding, -1)
    totals = counts.groupBy("__digit").agg(F.sum("times").alias("times"))
    bases = totals.select("__digit", F.coalesce(F.sum("times").over(smaller), F.lit(0)).alias("base"))
    earlier = Window.partitionBy("__digit").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("before", F.coalesce(F.sum("times").over(earlier), F.lit(0))).join(F.broadcast(bases), "__digit")
    offsets = offsets.select("__block", "__digit", (F.col("base") + F.col("before") - 1).alias("__offset"))
    moved = within.join(offsets, ["__block", "__digit"])
    return cut_lineage(moved.withColumn("__at", F.col("__offset") + F.col("__number")).select(*rows.columns))


def sorted_positions(rows: DataFrame, keys: list[str], name: str = "position") -> DataFrame:
    """``rows`` with a column ``name``: 0, 1, 2... in ascending order of ``keys`` (long columns without nulls).

    The keys are one composite number, of as many bits as the ranges of their values need; every twelve bits take a
    pass. Sort descending by a key's bitwise complement. Rows that agree in all keys get neighbouring positions in
    no stated order. A column called ``name`` is replaced; names of other columns must not begin with ``__``. An
    empty table gives an empty result. A null key is an error.
    """
    rows = rows.drop(name)
    checked = [F.coalesce(F.col(key).cast("long"), F.raise_error(F.lit(f"{key} is null")).cast("long")).alias(f"__key{k}") for k, key in enumerate(keys)]
    own = [F.col(column) for column in rows.columns]
    now = cut_lineage(rows.select(*own, *checked, F.monotonically_increasing_id().alias("__at")))
    ends = [end(f"__key{k}").alias(f"{kind}{k}") for k in range(len(keys)) for kind, end in (("min", F.min), ("max", F.max))]
    facts = now.agg(F.count("*").alias("n"), *ends).first()
    size = max(1, min(MOST_ROWS, facts["n"] // (4 * shuffle_partitions(rows.sparkSession))))
    numbers = []
    for k in range(len(keys)):
        low, key = facts[f"min{k}"] or 0, F.col(f"__key{k}")
        bits = ((facts[f"max{k}"] or 0) - low).bit_length()
        # a range of over 63 bits is shifted by flipping the sign
        numbers.append((key - F.lit(low), bits) if bits < 64 else (key.bitwiseXOR(F.lit(-(1 << 63))), 64))
    # the first positions are not dense: the number of a partition fills their upper bits
    for number, digit in enumerate(_digits(numbers) or [F.lit(0)]):
        now = _pass(now, digit, size if number else 1 << 33)
    return now.select(*own, F.col("__at").alias(name))
