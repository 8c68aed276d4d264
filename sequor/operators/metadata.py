"""Experiment metadata: selection, labels and the files that belong to them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def select_experiments(meta: DataFrame, accessions: list[str], assembly: str, criteria: dict[str, str], order: str) -> DataFrame:
    """One row an experiment: BED files of the assembly that meet all criteria, the first by `order`."""
    d = meta.where(F.col("experiment").isin(accessions) & (F.col("assembly") == assembly) & F.col("file_type").startswith("bed"))
    for c, v in criteria.items():
        d = d.where(F.col(c) == v)
    return first_of_group(d, "experiment", [order])


def selected_files(meta: DataFrame, accessions: list[str], assembly: str, criteria: dict[str, str], order: str, listing: DataFrame, label_cols: list[str], name: str = "file") -> DataFrame:
    """select_experiments with label and path. Where path is null the file isn't there: leave such rows out, and warn of them."""
    chosen = select_experiments(meta, accessions, assembly, criteria, order).withColumn("label", label(*label_cols))
    return with_files(chosen, listing, name)


def first_of_group(df: DataFrame, by: str, order: list[str]) -> DataFrame:
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where("_r = 1").drop("_r")


def label(*cols: str) -> Column:
    """Columns joined by '_', spaces as '-', nulls as nan."""
    return F.replace(F.concat_ws("_", *(F.coalesce(F.col(c).cast("string"), F.lit("nan")) for c in cols)), F.lit(" "), F.lit("-"))


def idr_peaks(meta: DataFrame, order: str) -> DataFrame:
    """IDR thresholded peaks of GRCh38 with replicates '1, 2', experiments in the order they first appear."""
    d = meta.where("output_type = 'IDR thresholded peaks' and assembly = 'GRCh38' and replicates = '1, 2'")
    first = d.groupBy("experiment").agg(F.min(order).alias("_first"))
    return d.join(first, "experiment").orderBy("_first", order).drop("_first")


def target_name(target: Column) -> Column:
    """The text before the first '-'."""
    return F.split_part(target, F.lit("-"), F.lit(1))


def with_files(meta: DataFrame, listing: DataFrame, name: str) -> DataFrame:
    """Add path: <name>.bed if it is listed, else <name>.bed.gz, else null. listing(path); of files of one name the first path."""
    files = listing.groupBy(F.element_at(F.split("path", "/"), -1).alias("_file")).agg(F.min("path").alias("path"))
    plain = files.select(F.col("path").alias("_plain"), F.col("_file"))
    gz = files.select(F.col("path").alias("_gz"), F.col("_file").alias("_file2"))
    d = meta.join(plain, F.concat(F.col(name), F.lit(".bed")) == F.col("_file"), "left").join(gz, F.concat(F.col(name), F.lit(".bed.gz")) == F.col("_file2"), "left")
    return d.withColumn("path", F.coalesce("_plain", "_gz")).drop("_plain", "_gz", "_file", "_file2")


def download_plan(meta: DataFrame, root: str) -> DataFrame:
    """url and target (cell/protein/accession.bed.gz) of the files to fetch; nothing is fetched."""
    return meta.select("url", F.concat_ws("/", F.lit(root), "biosample", target_name(F.col("target")), F.concat("file", F.lit(".bed.gz"))).alias("target_path"))
