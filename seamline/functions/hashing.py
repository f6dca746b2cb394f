"""Reproducible splits: the same key lands in the same split on any partitioning."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def hash_bucket(key: Column, buckets: int = 100) -> Column:
    digest = F.substring(F.md5(key.cast("string")), 1, 8)
    return (F.conv(digest, 16, 10).cast("long") % buckets).cast("int")


def hash_split(key: Column, train: int = 70, val: int = 20) -> Column:
    """``train`` / ``val`` / ``test`` in the given percentages."""
    bucket = hash_bucket(key)
    return F.when(bucket < train, "train").when(bucket < train + val, "val").otherwise("test")


def holdout_split(key: Column, test: float = 0.20, val: float = 0.50, seed: int = 42) -> Column:
    """Share ``test`` of the keys held out, of which share ``val`` validates; the rest trains."""
    salted = F.concat_ws(":", F.lit(seed), key.cast("string"))
    bucket = hash_bucket(salted, 10000)
    held = int(test * 10000)
    return (
        F.when(bucket < int(held * val), "val").when(bucket < held, "test").otherwise("train")
    )
