"""Writers of interval, activity, dataset and motif files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sequor.operators.intervals import activity_row, region_key
from sequor.operators.motif import MEME_HEADER, meme_text


def write_bed(df: DataFrame, path: str, compress: bool = False, single: bool = False) -> None:
    d = df.coalesce(1) if single else df
    d.write.csv(path, sep="\t", header=False, compression="gzip" if compress else "none", emptyValue="")


def merged_bed_lines(df: DataFrame) -> DataFrame:
    """value: chrom, start, end, '.', '1', strand and the targets."""
    return df.select(F.concat_ws("\t", "chrom", F.col("start_pos").cast("string"), F.col("end_pos").cast("string"), F.lit("."), F.lit("1"), "strand", F.array_join(F.transform("activity", lambda x: x.cast("string")), ",")).alias("value"))


def activity_lines(df: DataFrame, n_targets: int) -> DataFrame:
    return df.select(F.concat_ws("\t", region_key(), activity_row(n_targets, F.col("activity"))).alias("value"))


def write_lines(lines: DataFrame, path: str, header: str | None = None, parts: bool = False) -> None:
    """Text files; with a header, one file that begins with it, which a single task writes.

    With parts, the header is a file of its own, the first by name, and the lines keep their partitions: for tables of any size.
    """
    if header is None:
        lines.write.text(path)
        return
    h = lines.sparkSession.createDataFrame([(header,)], "value string").coalesce(1)
    if parts:
        h.unionAll(lines.select("value")).write.text(path)
        return
    d = h.select(F.lit(0).alias("_k"), "value").unionAll(lines.select(F.lit(1).alias("_k"), "value"))
    d.coalesce(1).sortWithinPartitions("_k").select("value").write.text(path)


def write_dataset(df: DataFrame, path: str) -> None:
    """Parquet by split: what is read back by read_dataset."""
    df.write.partitionBy("split").parquet(path)


def read_dataset(spark, path: str, reverse_complements: bool = False) -> DataFrame:
    from sequor.functions.seq import with_reverse_complements

    d = spark.read.parquet(path)
    return with_reverse_complements(d) if reverse_complements else d


def write_meme(rows: DataFrame, by: str, path: str) -> None:
    text = meme_text(rows, by)
    write_lines(text.orderBy("motif").select(F.col("text").alias("value")), path, MEME_HEADER)


def write_table(df: DataFrame, path: str, sep: str = "\t") -> None:
    df.write.csv(path, sep=sep, header=True)


def write_selection(selected: DataFrame, sheet: str, subset: str) -> None:
    """The sample sheet (label, path) of the experiments whose file is there, and their metadata with label and path."""
    there = selected.where("path is not null")
    there.select(F.concat_ws("\t", "label", "path").alias("value")).coalesce(1).write.text(sheet)  # a row an experiment
    write_table(there, subset, sep=",")
