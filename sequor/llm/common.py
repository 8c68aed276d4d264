"""Helpers shared by the corpus operators: shared-storage scratch space, gapless ranks,
blocked groups and connected components.

Nothing here collects per-row data to the driver, and every helper that groups rows either
aggregates partially before the shuffle or splits groups that exceed a stated size.
"""

from __future__ import annotations

import gc
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sequor.session import shared_folder

#: Rows in one Arrow batch handed to a Python worker, at most. Texts can be long.
ARROW_ROWS = 1000
ARROW_BYTES = 16 << 20
#: Keys that a join sends to all tasks, at most, and the least rows that make a key one of them.
HEAVY, HEAVY_ROWS = 200_000, 1000
WORDS = r"[^\x20\x09-\x0D]+"


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared checkpoint folder: the cluster's own; on one machine a temporary one if none is set."""
    return shared_folder(spark)


def prepare(spark: SparkSession) -> None:
    """Set a checkpoint folder if there is none and keep Arrow batches small."""
    checkpoint_folder(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000")) > ARROW_ROWS or int(spark.conf.get(key, "10000")) <= 0:
        spark.conf.set(key, str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


def fresh(df: DataFrame, name: str) -> str:
    """A name for a helper column that is none of df's, in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def cut(df: DataFrame) -> DataFrame:
    """Materialise df in the shared checkpoint folder and cut its lineage."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


class Stash:
    """A Parquet table in the shared folder that lives until drop()."""

    def __init__(self, df: DataFrame):
        self.spark = df.sparkSession
        self.path = f"{checkpoint_folder(self.spark)}/stash-{uuid.uuid4().hex}"
        df.write.parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        jvm = self.spark._jvm
        at = jvm.org.apache.hadoop.fs.Path(self.path)
        at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffle files of plans that are no longer referenced."""
    gc.collect()
    spark._jvm.System.gc()


def ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def gapless_rank(df: DataFrame, group: str, key: Column, order: list, out: str, salts: int = 64) -> DataFrame:
    """Number the rows of each group from 0 without gaps and without one task per group.

    Every group is split into `salts` parts by a hash of key; a part's rows are numbered in a
    window of their own and moved up by the sizes of the parts before. The table of part sizes
    has groups x salts rows; callers pass groups of a fixed small number, which bounds it.
    df is read twice: pass a materialised table.
    """
    d = df.withColumn("_salt", F.pmod(F.xxhash64(key), F.lit(salts)).cast("int"))
    sizes = d.groupBy(group, "_salt").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(group).orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    base = sizes.withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inside = Window.partitionBy(group, "_salt").orderBy(*order)
    return (
        d.join(F.broadcast(base), [group, "_salt"])
        .withColumn(out, F.col("_base") + F.row_number().over(inside) - 1)
        .drop("_salt", "_base")
    )


def join_counted(df: DataFrame, counted: DataFrame, keys: list[str], count: str) -> DataFrame:
    """df joined with a materialised table that has one row per key and counts df's rows of it.

    Keys that hold over 1 / HEAVY of the rows, of which there are HEAVY at most, are broadcast, so that none of
    them meets in one task; the others are shuffled. df is read twice: pass a materialised table.
    """
    total = counted.agg(F.sum(count)).first()[0] or 0
    heavy = F.col(count) > max(HEAVY_ROWS, total // HEAVY)
    large = counted.where(heavy)
    if large.isEmpty():
        return df.join(counted, keys)
    rest = df.join(F.broadcast(large.select(*keys)), keys, "left_anti")
    return df.join(F.broadcast(large), keys).unionByName(rest.join(counted.where(~heavy), keys))


def blocked(df: DataFrame, keys: list[str], row_key: Column, block: int, weight: Column | None = None) -> DataFrame:
    """Split groups of more than `block` rows (or more than that weight in all) so that every two rows of a group still meet.

    Adds _i <= _j: the rows of a job (keys, _i, _j). A group of n rows gets g = ceil(n / block)
    parts; a row of part b is sent to the jobs (b, j >= b) and (i < b, b), g jobs in all. _own is
    the row's part. Groups of up to `block` rows (nearly all) have the one job (0, 0).
    """
    sizes = df.groupBy(*keys).agg((F.count(F.lit(1)) if weight is None else F.sum(weight)).alias("_n")).where(F.col("_n") > block)
    large = sizes.select(*keys, F.ceil(F.col("_n") / F.lit(block)).cast("int").alias("_g"))
    d = df.join(large, keys, "left").withColumn("_g", F.coalesce("_g", F.lit(1)))
    d = d.withColumn("_own", F.pmod(F.xxhash64(row_key), F.col("_g")).cast("int"))
    d = d.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_g") - 1)))
    return d.withColumns({"_i": F.least("_own", "_other"), "_j": F.greatest("_own", "_other")}).drop("_g", "_other")


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Regroup sorted Arrow batches so that no key is split between two tables."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        last, first = [b.column(k)[-1].as_py() for k in keys], [b.column(k)[0].as_py() for k in keys]
        if last == first:
            if held and [held[-1].column(k)[-1].as_py() for k in keys] != first:
                yield pa.Table.from_batches(held)
                held = []
            held.append(b)
            continue
        change = np.zeros(b.num_rows, bool)
        for k in keys:
            v = b.column(k).to_numpy(zero_copy_only=False)
            change[1:] |= v[1:] != v[:-1]
        at = int(np.flatnonzero(change)[-1])
        yield pa.Table.from_batches([*held, b.slice(0, at)])
        held = [b.slice(at)]
    if held:
        yield pa.Table.from_batches(held)


def unite(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Join the trees of i and j, in place; label holds each row's root, the smallest index of its tree."""
    while True:
        a, b = label[i], label[j]
        apart = a != b
        if not apart.any():
            return label
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = label[label]
            if (up == label).all():
                break
            label[:] = up


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) for every node that has an edge and isn't the smallest of its component.

    Alternating large-star and small-star rounds (Kiveris et al., 2014): each round moves edges
    towards the smallest neighbour until every component is a star. Only joins and partial
    aggregations; the number of rounds grows with the logarithm of the component size. A round's table and
    shuffle files go when the next one is there, so that disk holds one round, not all.
    """
    spark = edges.sparkSession
    held = Stash(edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).distinct())
    mark = None
    while True:
        n = held.df.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(hi, lo))"), F.sum(F.pmod(F.xxhash64("lo", "hi"), F.lit(1 << 31)))).first()
        if n == mark or not n[0]:
            release(spark)
            return held.df.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
        mark, before = n, held
        held = Stash(stars(before.df))
        before.drop()
        release(spark)


def stars(e: DataFrame) -> DataFrame:
    """A round on edges (hi, lo)."""
    both = e.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionAll(e.select("lo", "hi"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    large = both.join(least, "u").where("v > u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
    low = large.groupBy("hi").agg(F.min("lo").alias("m"))
    rest = large.join(low, "hi").where("lo <> m").select("lo", "m")
    return low.unionAll(rest).distinct().toDF("hi", "lo")
