"""Classification and regression metrics as aggregations and windows over distinct scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Score stretches in which running sums start anew; sums of the stretches before are carried on.
STRETCHES = 64


def _curve(df: DataFrame, by: list[str], label: str, score: str) -> DataFrame:
    """A row per distinct score: pos, neg, and tp, fp: positives and negatives with at least that score.

    Rows are first summed by score (partial aggregation). The running sums are then taken
    within stretches of the score, which lie between approximate quantiles of its distinct values, so that no
    window holds all scores of a label. Rows without a score are left out.
    """
    df = df.where(F.col(score).isNotNull())
    g = df.groupBy(*by, F.col(score).cast("double").alias("s")).agg(F.sum(F.col(label).cast("long")).alias("pos"), F.sum((1 - F.col(label)).cast("long")).alias("neg"))
    at = F.percentile_approx("s", [k / STRETCHES for k in range(1, STRETCHES)], 1000)
    g = g.join(g.groupBy(*by).agg(at.alias("_q")), by)
    g = g.withColumn("_st", F.size(F.filter("_q", lambda q: q < F.col("s")))).drop("_q")
    up = Window.partitionBy(*by).orderBy(F.desc("_st")).rowsBetween(Window.unboundedPreceding, -1)
    base = g.groupBy(*by, "_st").agg(F.sum("pos").alias("_p"), F.sum("neg").alias("_n"))
    base = base.select(*by, "_st", F.coalesce(F.sum("_p").over(up), F.lit(0)).alias("_bp"), F.coalesce(F.sum("_n").over(up), F.lit(0)).alias("_bn"))
    inside = Window.partitionBy(*by, "_st").orderBy(F.desc("s")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    d = g.join(base, [*by, "_st"])
    return d.select(*by, "s", "pos", "neg", (F.col("_bp") + F.sum("pos").over(inside)).alias("tp"), (F.col("_bn") + F.sum("neg").over(inside)).alias("fp"))


def auroc(df: DataFrame, by: list[str], label: str = "label", score: str = "score") -> DataFrame:
    """by.., auroc: the chance that a positive scores above a negative, ties half; null with one class only."""
    c = _curve(df, by, label, score)
    # each positive beats the negatives below its score and halves those at it
    lost = F.col("pos").cast("double") * (F.lit(2) * F.col("fp") - F.col("neg"))
    d = c.groupBy(*by).agg(F.sum(lost).alias("_lost"), F.sum("pos").cast("double").alias("_p"), F.sum("neg").cast("double").alias("_n"))
    return d.select(*by, (1 - F.try_divide("_lost", 2 * F.col("_p") * F.col("_n"))).alias("auroc"))


def average_precision(df: DataFrame, by: list[str], label: str = "label", score: str = "score") -> DataFrame:
    """by.., average_precision: sum of recall steps times precision, tied scores together."""
    c = _curve(df, by, label, score)
    d = c.groupBy(*by).agg(F.sum(F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp"))).alias("_s"), F.sum("pos").alias("_p"))
    return d.select(*by, F.try_divide("_s", "_p").alias("average_precision"))


def pr_trapezoid(df: DataFrame, by: list[str], label: str = "label", score: str = "score") -> DataFrame:
    """by.., pr_auc by trapezoids from (recall 0, precision 1); the precision before a score is that of the sums without it."""
    c = _curve(df, by, label, score).withColumn("precision", F.col("tp") / (F.col("tp") + F.col("fp")))
    before = F.try_divide(F.col("tp") - F.col("pos"), F.col("tp") - F.col("pos") + F.col("fp") - F.col("neg"))
    d = c.withColumn("_q", F.coalesce(before, F.lit(1.0)))
    d = d.groupBy(*by).agg(F.sum(F.col("pos") * (F.col("precision") + F.col("_q")) / 2).alias("_s"), F.sum("pos").alias("_p"))
    return d.select(*by, F.try_divide("_s", "_p").alias("pr_auc"))


def accuracy(df: DataFrame, by: list[str], label: str = "label", score: str = "score") -> DataFrame:
    """Share of rows whose score, rounded half to even, is the label."""
    return df.groupBy(*by).agg(F.avg((F.col(label) == F.bround(score)).cast("double")).alias("accuracy"))


def pearson(df: DataFrame, by: list[str], label: str = "label", score: str = "score") -> DataFrame:
    """by.., pearson from centred sums; null if a side is constant."""
    a, b = F.col(score).cast("double"), F.col(label).cast("double")
    return df.groupBy(*by).agg(F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b)).alias("pearson"))


def r_squared_origin(df: DataFrame, by: list[str], label: str = "label", score: str = "score") -> DataFrame:
    """by.., slope of the fit of the labels through the origin, and its rsquare.

    The errors are taken row by row in a second pass, so that a near-perfect fit doesn't cancel.
    """
    a, b = F.col(score).cast("double"), F.col(label).cast("double")
    fit = df.groupBy(*by).agg((F.count(F.lit(1)) * F.var_pop(b)).alias("_sst"), F.try_divide(F.sum(a * b), F.sum(a * a)).alias("slope"))
    off = b - F.col("slope") * a
    d = df.select(*by, label, score).join(fit, by) if by else df.select(label, score).crossJoin(F.broadcast(fit))  # without groups, fit is one row
    g = d.groupBy(*by, "slope", "_sst").agg(F.sum(off * off).alias("_sse"))
    return g.select(*by, "slope", (1 - F.try_divide("_sse", "_sst")).alias("rsquare"))


SUITE = {"auroc": auroc, "average_precision": average_precision, "accuracy": accuracy, "pearson": pearson, "rsquare": r_squared_origin}


def evaluate(df: DataFrame, by: str, metrics: list[str], label: str = "label", score: str = "score") -> DataFrame:
    """metric, mean, std (population) over the values of `by`."""
    out = None
    for m in metrics:
        if m not in SUITE:
            raise KeyError(f"unknown metric {m}; there are {', '.join(sorted(SUITE))}")
        d = SUITE[m](df, [by], label, score).select(F.lit(m).alias("metric"), F.col(m).alias("v"))
        out = d if out is None else out.unionAll(d)
    return out.groupBy("metric").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"))


def standardize(df: DataFrame, cols: list[str], by: list[str] | None = None, scale: bool = True) -> DataFrame:
    """Columns less their mean, and by their population deviation; a deviation of 0 divides by 1."""
    by = by or []
    stats = df.groupBy(*by).agg(*(F.avg(c).alias(f"_m_{c}") for c in cols), *(F.stddev_pop(c).alias(f"_d_{c}") for c in cols))
    d = df.join(stats, by) if by else df.crossJoin(F.broadcast(stats))  # without groups, stats is one row
    new = {c: (F.col(c) - F.col(f"_m_{c}")) / (F.when(F.col(f"_d_{c}") > 1e-12, F.col(f"_d_{c}")).otherwise(F.lit(1.0)) if scale else F.lit(1.0)) for c in cols}
    return d.withColumns(new).select(*df.columns)


def histogram(df: DataFrame, value: str, bins: int, low: float, high: float) -> DataFrame:
    """bin, n: equal bins from low to high; the highest value falls into the last bin."""
    k = F.least(F.floor((F.col(value) - low) / F.lit((high - low) / bins)), F.lit(bins - 1)).cast("int")
    return df.where((F.col(value) >= low) & (F.col(value) <= high)).groupBy(k.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
