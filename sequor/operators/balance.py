"""Balancing negatives against positives by base composition, and sampling that layout can't change."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sequor.functions.seq import uniform
from sequor.operators.rank import smallest


def nearest_counts(wanted: DataFrame, there: DataFrame, col: str = "gc") -> DataFrame:
    """(gc, nearest): for each distinct wanted count the nearest there, the larger one on ties.

    GC counts of sequences of one length are few (length + 1 at most), so both distinct lists are small.
    """
    both = wanted.select(col).distinct().withColumn("_w", F.lit(True)).unionByName(there.select(col).distinct().withColumn("_w", F.lit(False)))
    have = F.when(~F.col("_w"), F.col(col))
    up = Window.orderBy(F.col(col), F.col("_w")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    down = Window.orderBy(F.col(col).desc(), F.col("_w")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    d = both.withColumn("_lo", F.last(have, ignorenulls=True).over(up)).withColumn("_hi", F.last(have, ignorenulls=True).over(down))
    near = F.when(F.col("_lo").isNull() | (F.col("_hi") - F.col(col) <= F.col(col) - F.col("_lo")), F.col("_hi")).otherwise(F.col("_lo"))
    return d.where("_w").select(col, F.coalesce(near, "_lo").alias("nearest"))


def match_gc(positives: DataFrame, negatives: DataFrame, id_col: str, col: str = "gc") -> DataFrame:
    """positives with nearest and match_id: with replacement, the smallest id of the nearest count."""
    table = nearest_counts(positives, negatives, col).join(negatives.groupBy(F.col(col).alias("nearest")).agg(F.min(id_col).alias("match_id")), "nearest")
    return positives.join(F.broadcast(table), col)


def matched_times(df: DataFrame, id_col: str, label: str = "label", col: str = "gc") -> DataFrame:
    """(id, label 0, times): how often match_gc picks each negative of df for its positives (label 1).

    The driver gets a row per label and count, 2 * (length + 1) at most, and so has the result.
    """
    rows = df.groupBy(label, col).agg(F.count(F.lit(1)).alias("n"), F.min(id_col).alias("first")).collect()
    there = {r[col]: r["first"] for r in rows if r[label] == 0}
    times: dict = {}
    for r in rows:
        if r[label] == 1 and there:
            near = min(there, key=lambda c: (abs(c - r[col]), -c))
            times[there[near]] = times.get(there[near], 0) + r["n"]
    kinds = T.StructType([T.StructField(id_col, df.schema[id_col].dataType), T.StructField(label, T.IntegerType()), T.StructField("times", T.LongType())])
    return df.sparkSession.createDataFrame([(k, 0, n) for k, n in sorted(times.items())], kinds)


def kde_weights(a: DataFrame, b: DataFrame, length: int, col: str = "gc") -> DataFrame:
    """(gc, weight): the Gaussian density (Scott's width) of a's GC shares at b's, normalised over b's rows.

    Both sides are histograms over integer counts, length + 1 rows at most, collected to the driver.
    """
    ha = {r[0]: r[1] for r in a.groupBy(col).count().collect()}
    hb = {r[0]: r[1] for r in b.groupBy(col).count().collect()}
    x, w = np.array(sorted(ha)) / length, np.array([ha[k] for k in sorted(ha)], float)
    n = w.sum()
    mean = (w * x).sum() / n
    h = n ** (-0.2) * np.sqrt((w * (x - mean) ** 2).sum() / (n - 1))
    y = np.array(sorted(hb)) / length
    d = (w * np.exp(-0.5 * ((y[:, None] - x[None]) / h) ** 2)).sum(1) / (n * h * np.sqrt(2 * np.pi))
    total = (d * np.array([hb[k] for k in sorted(hb)])).sum()
    return b.sparkSession.createDataFrame([(int(k), float(v / total)) for k, v in zip(sorted(hb), d, strict=True)], f"{col} int, weight double")


def sample_weighted(df: DataFrame, weight: Column, n: int, key: Column, seed: int = 0) -> DataFrame:
    """n rows without replacement, drawn in proportion to weight (exponential keys, Efraimidis and Spirakis 2006)."""
    return smallest(df.where(weight > 0), [-F.log(F.lit(1.0) - uniform(seed, key)) / weight, key], n)


def sample_uniform(df: DataFrame, n: int, key: Column, seed: int = 0) -> DataFrame:
    """n rows by a hash of the key, which should tell rows apart, found by selection: no task holds or sorts the rows."""
    return smallest(df, [F.xxhash64(F.lit(seed), key), key], n)


def sample_like(a: DataFrame, b: DataFrame, length: int, key: str, n: int | None = None, col: str = "gc", seed: int = 0) -> DataFrame:
    """Rows of b whose GC follows a's; all of b if it has no more than n rows (default: as many as a)."""
    have = b.count()
    n = min(a.count(), have) if n is None else n
    if n >= have:
        return b
    d = b.join(F.broadcast(kde_weights(a, b, length, col)), col)
    return sample_weighted(d, F.col("weight"), n, F.col(key), seed).select(*b.columns)


def down_sample(positives: DataFrame, negatives: DataFrame, key: str, seed: int = 0) -> DataFrame:
    """As many negatives as positives if there are more, else all of them."""
    n = positives.count()
    return sample_uniform(negatives, n, F.col(key), seed) if negatives.count() > n else negatives
