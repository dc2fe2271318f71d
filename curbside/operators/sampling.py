"""Samples that depend on keys and seeds, not on how rows are dealt."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hash_ordered(df: DataFrame, key: str, limit: int) -> DataFrame:
    """The first ``limit`` rows by the first eight digits of the key's MD5: the same rows in every run."""
    order = F.conv(F.substring(F.md5(F.col(key).cast("string")), 1, 8), 16, 10).cast("bigint")
    return df.orderBy(order, key).limit(limit)


def seeded(df: DataFrame, keys: Sequence[str], share: float, seed: int) -> DataFrame:
    """``share`` of the rows, rounded down, by a seeded hash of their keys."""
    n = int(df.count() * share)
    return df.orderBy(F.xxhash64(F.lit(seed), *keys), *keys).limit(n)


def bernoulli(df: DataFrame, keys: Sequence[str], share: float, seed: int) -> DataFrame:
    """Each row by itself with probability ``share``; one pass, no shuffle."""
    return df.filter(F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(1_000_000)) < int(share * 1_000_000))
