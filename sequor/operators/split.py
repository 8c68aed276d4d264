"""Splits into train, valid and test: disjoint, seeded, and independent of the data's layout."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sequor.functions.seq import uniform


def by_chromosome(df: DataFrame, valid: list[str], test: list[str]) -> DataFrame:
    """A chromosome in both lists is test."""
    c = F.col("chrom")
    return df.withColumn("split", F.when(c.isin(test), "test").when(c.isin(valid), "valid").otherwise("train"))


def by_hash(df: DataFrame, key: str, valid: float, test: float, seed: int = 0) -> DataFrame:
    """Shares hold in expectation; no sort, no shuffle, and rows keep their split when others are added."""
    u = uniform(seed, F.col(key))
    return df.withColumn("split", F.when(u < test, "test").when(u < test + valid, "valid").otherwise("train"))


def _ranked(df: DataFrame, key: str | Column, seed: int, parts: int = 1024) -> DataFrame:
    """_rank from 1 by hash: numbered within slices of the hash, then moved up by the slices before."""
    d = df.withColumn("_key", F.col(key) if isinstance(key, str) else key).withColumn("_h", F.xxhash64(F.lit(seed), F.col("_key")))
    d = d.withColumn("_slice", F.shiftright(F.col("_h"), 64 - int(math.log2(parts))))
    sizes = d.groupBy("_slice").agg(F.count(F.lit(1)).alias("_n"))
    base = sizes.select("_slice", F.coalesce(F.sum("_n").over(Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    inside = Window.partitionBy("_slice").orderBy("_h", "_key")
    return d.join(F.broadcast(base), "_slice").withColumn("_rank", F.col("_base") + F.row_number().over(inside)).drop("_h", "_key", "_slice", "_base")


def permute(df: DataFrame, key: str | Column, seed: int = 0, out: str = "place") -> DataFrame:
    """Add `out`: each row's place, from 0, in a seeded permutation of all rows."""
    return _ranked(df, key, seed).withColumn(out, F.col("_rank") - 1).drop("_rank")


def _cut(df: DataFrame, key: str, seed: int, n_train: int, n_valid: int) -> DataFrame:
    r = F.col("_rank")
    return _ranked(df, key, seed).withColumn("split", F.when(r <= n_train, "train").when(r <= n_train + n_valid, "valid").otherwise("test")).drop("_rank")


def by_fraction(df: DataFrame, key: str, train: float, valid: float, seed: int = 0) -> DataFrame:
    """Exact sizes: borders at floor(n * cumulated share)."""
    n = df.count()
    a, b = math.floor(n * train), math.floor(n * (train + valid))
    return _cut(df, key, seed, a, b - a)


def batch_round(count: int, batch: int) -> int:
    return count - count % batch if batch else count


def by_count(df: DataFrame, key: str, valid: float, test: float, batch: int = 0, seed: int = 0) -> DataFrame:
    """Sizes floor(0.5 + share * n), the rest train, each rounded down to whole batches; leftovers are dropped."""
    if valid + test > 1:
        raise ValueError("shares of valid and test exceed 1")
    n = df.count()
    t, v = math.floor(0.5 + test * n), math.floor(0.5 + valid * n)
    sizes = [batch_round(x, batch) for x in (n - t - v, v, t)]
    d = _ranked(df, key, seed).where(F.col("_rank") <= sum(sizes))
    r: Column = F.col("_rank")
    return d.withColumn("split", F.when(r <= sizes[0], "train").when(r <= sizes[0] + sizes[1], "valid").otherwise("test")).drop("_rank")
