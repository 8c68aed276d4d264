"""Numbers of rows along an order, without one task for all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sequor.session import shared_folder


def ranked(df: DataFrame, order: list[Column | str], out: str) -> DataFrame:
    """Add `out`: the rows' places from 0 along `order`, which should tell rows apart.

    Rows are dealt into ranges of the order and numbered within each; ranges are moved up by the sizes of
    those before, of which there are as many as partitions. The dealt rows are checkpointed, so a lost
    executor can't deal them anew.
    """
    shared_folder(df.sparkSession)
    d = df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()).checkpoint()
    sizes = d.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    base = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy("_part").orderBy(*order)
    return d.join(F.broadcast(base), "_part").withColumn(out, F.col("_base") + F.row_number().over(inside) - 1).drop("_part", "_base")


def running_total(df: DataFrame, by: list[str], order: list[Column | str], value: str, out: str) -> DataFrame:
    """Add `out`: the sum of value over the rows of the same `by` before each row along `order`, which should tell rows apart.

    Sums run within ranges of (by, order) and are moved up by a table of one row for each range and group in it, so that
    no task holds a group. The dealt rows are checkpointed.
    """
    shared_folder(df.sparkSession)
    d = df.repartitionByRange(*by, *order).withColumn("_part", F.spark_partition_id()).checkpoint()
    sums = d.groupBy(*by, "_part").agg(F.sum(value).alias("_sum"))
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select(*by, "_part", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy(*by, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return d.join(base, [*by, "_part"]).withColumn(out, F.col("_base") + F.coalesce(F.sum(value).over(inside), F.lit(0))).drop("_part", "_base")


#: Rows among which the last place is found by a sort, and the accuracy of the quantiles that narrow them down.
FEW, ACCURACY = 100_000, 10_000


def smallest(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    """The n rows that come first along order (a number, and what tells equal ones apart), by selection instead of a sort.

    Approximate quantiles bracket the n-th number; the rows between them, some thousandth of all, are bracketed again until
    they are FEW, and of these the n-th is looked up. df is read for its keys, which are checkpointed, and once more by the result, a
    filter of it. Nulls come last and are never chosen. Only many equal numbers at the border are sorted, by ranges.
    """
    k, t = order
    shared_folder(df.sparkSession)
    d = df.withColumns({"_k": k, "_t": t}).where("_k is not null")
    part, need, bound, last = d.select("_k", "_t").checkpoint(), n, None, None
    while True:
        have = part.count()
        if need >= have:
            out = d if bound is None else d.where(bound)
            break
        if need <= 0 or have <= FEW:
            last = part.orderBy("_k", "_t").limit(max(need, 0)).agg(F.max(F.struct("_k", "_t")).alias("m")).first()["m"]
            out = d.where("false")
            break
        share = [max(0.0, need / have - 2 / ACCURACY), min(1.0, need / have + 2 / ACCURACY)]
        a, b = part.agg(F.percentile_approx("_k", share, ACCURACY).alias("q")).first()["q"]
        below, upto = part.agg(F.count_if(F.col("_k") < F.lit(a)), F.count_if(F.col("_k") <= F.lit(b))).first()
        if need <= below:
            part, bound = part.where(F.col("_k") < F.lit(a)), F.col("_k") < F.lit(a)
        elif need > upto:
            part, need = part.where(F.col("_k") > F.lit(b)), need - upto
        elif upto - below == have:
            last = ranked(part, ["_k", "_t"], "_place").where(F.col("_place") == need - 1).first()
            break
        else:
            part, need, bound = part.where((F.col("_k") >= F.lit(a)) & (F.col("_k") <= F.lit(b))), need - below, F.col("_k") <= F.lit(b)
    if last is not None:
        out = d.where((F.col("_k") < F.lit(last["_k"])) | ((F.col("_k") == F.lit(last["_k"])) & (F.col("_t") <= F.lit(last["_t"]))))
    return out.drop("_k", "_t")
