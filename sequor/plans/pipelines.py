"""The library's end-to-end plans: single-task and multi-task datasets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sequor.functions.seq import drop_n, gc_count
from sequor.operators import balance, split
from sequor.operators.genome import TILE, get_sequences
from sequor.operators.intervals import extend, greedy_merge, intersect, keep_chromosomes, max_length, normal_strand, parse_activity, region_key, resize, to_points
from sequor.session import shared_folder
from sequor.sources import sinks, text


def single_task(positives: DataFrame, background: DataFrame, tiles: DataFrame, id_col: str, window: int = 200, limit: int = 300, balance_by: str = "nearest", seed: int = 0, width: int = TILE, reach: int = 0) -> DataFrame:
    """id, chrom, start_pos, end_pos, seq, gc, label: positives and composition-matched negatives.

    Positives are filtered by length; negatives are background intervals that overlap no raw
    positive. Both are resized, looked up and freed of N. balance_by: nearest (with replacement),
    density (sampled like the positives), uniform or none. reach: that of the tiles, if they overlap.

    Both sides are looked up together. nearest reads the rows twice, from a checkpoint: for the histogram of the counts, of which
    the driver gets a row per label and count (window + 1 at most each), and for the result.
    """
    names = [id_col, "chrom", "start_pos", "end_pos", "strand"]
    pos = max_length(positives, limit).select(*names, F.lit(1).alias("label"))
    neg = intersect(background, positives, id_col, nonoverlap=True).select(*names, F.lit(0).alias("label"))
    d = drop_n(get_sequences(resize(pos.unionByName(neg), window), tiles, id_col, width, reach=reach))
    d = d.select(id_col, "chrom", "start_pos", "end_pos", "seq", gc_count(F.col("seq")).alias("gc"), "label")
    if balance_by == "nearest":
        shared_folder(d.sparkSession)
        d = d.checkpoint()
        times = balance.matched_times(d, id_col)
        d = d.join(F.broadcast(times), [id_col, "label"], "left")
        n = F.when(F.col("label") == 1, F.lit(1)).otherwise(F.coalesce("times", F.lit(0)))
        return d.where(n > 0).withColumn("_k", F.explode(F.sequence(F.lit(1), n.cast("int")))).drop("times", "_k")
    pos, neg = d.where("label = 1"), d.where("label = 0")
    if balance_by == "density":
        neg = balance.sample_like(pos, neg, window, id_col, seed=seed)
    elif balance_by == "uniform":
        neg = balance.down_sample(pos, neg, id_col, seed)
    return pos.unionByName(neg)


def split_by_chromosome(df: DataFrame, valid: list[str], test: list[str]) -> DataFrame:
    return split.by_chromosome(df, valid, test)


def multi_task(peaks: DataFrame, length: int, overlap: int, sizes: DataFrame | None = None, stranded: bool = False, ignore_y: bool = False, ignore_auxiliary: bool = False) -> DataFrame:
    """chrom, strand, start_pos, end_pos, activity: regions merged over all targets.

    peaks(chrom, start_pos, end_pos, strand, and target_idx or activity). Peaks become points, then regions of `length`,
    and neighbours are merged greedily while they overlap by at least `overlap`.
    """
    d = keep_chromosomes(peaks, ignore_y, ignore_auxiliary)
    d = d.withColumn("strand", normal_strand(F.col("strand")) if stranded else F.lit("+"))
    d = extend(to_points(d), length, sizes)
    if "activity" not in d.columns:
        d = d.withColumn("activity", F.array(F.col("target_idx").cast("int")))
    return greedy_merge(d.select("chrom", "strand", "start_pos", "end_pos", "activity"), length, overlap, ["chrom", "strand"], sizes)


def _plain(path: Column) -> Column:
    """A path without file: in front and / behind, as a sample sheet may name it."""
    return F.regexp_replace(path, r"^file:(//)?|/+$", "")


def read_targets_of_sheet(spark: SparkSession, sheet: DataFrame) -> DataFrame:
    """chrom, start_pos, end_pos, strand, activity of all files of a sample sheet (target_idx, label, path).

    A path is a BED file, plain or .gz, or a folder of them; a file that two lines name counts for both targets. The driver
    holds the sheet's paths; files are listed, and read in one scan.
    """
    paths = [r["path"] for r in sheet.select("path").distinct().collect()]
    if not paths:
        return spark.createDataFrame([], "chrom string, start_pos long, end_pos long, strand string, activity array<int>")
    files = text.list_files(spark, paths).select("path", _plain(F.col("path")).alias("_file"))
    named = sheet.select(_plain(F.col("path")).alias("_named"), "target_idx")
    inside = files.select("path", F.explode(F.array("_file", F.regexp_replace("_file", "/[^/]*$", ""))).alias("_named"))
    of_file = inside.join(named, "_named").select("path", "target_idx")  # a row a file and target
    lines = text.read_bed(spark, paths, source="path")
    d = lines.join(F.broadcast(of_file), "path") if len(paths) <= 10_000 else lines.join(of_file, "path")
    return d.select("chrom", "start_pos", "end_pos", "strand", F.array("target_idx").alias("activity"))


def multi_task_files(spark: SparkSession, sheet: str, out: str, length: int = 1000, overlap: int = 200, sizes: str | None = None, table: str | None = None, table_bed: str | None = None, table_activity: bool = True, ignore_y: bool = False, ignore_auxiliary: bool = False, valid: list[str] | None = None, test: list[str] | None = None) -> dict[str, str]:
    """A multi-task dataset from files to files: merged BED, activity table and split dataset; returns their paths by name.

    sheet: lines of a label and a path to BED files. table and table_bed: an existing activity table and the BED of its regions, whose targets come
    first; without table_activity its regions take part with no target. sizes: chrom sizes. The merged regions
    are written once, sorted along the genome, and the other two are made from them. Each output is a folder of text or
    Parquet parts whose names follow the order; the activity table's first part is its header.
    """
    old = [r["label"] for r in text.read_targets(spark, table).orderBy("target_idx").collect()] if table and table_bed else []
    targets = text.read_sample_sheet(spark, sheet, len(old))
    labels = old + [r["label"] for r in targets.orderBy("target_idx").select("label").collect()]
    peaks = read_targets_of_sheet(spark, targets)
    if old:
        known = parse_activity(F.coalesce(F.get("extra", 0), F.lit("."))) if table_activity else F.array().cast("array<int>")
        peaks = peaks.unionByName(text.read_bed(spark, table_bed).select("chrom", "start_pos", "end_pos", "strand", known.alias("activity")))
    lengths = text.read_chrom_sizes(spark, sizes) if sizes else None
    regions = multi_task(peaks, length, overlap, lengths, True, ignore_y, ignore_auxiliary)
    at = {k: f"{out}/{k}" for k in ("bed", "activity", "dataset")}
    sinks.merged_bed_lines(regions.repartitionByRange("chrom", "strand", "start_pos").sortWithinPartitions("chrom", "strand", "start_pos")).write.text(at["bed"])
    merged = text.read_bed(spark, at["bed"]).select("chrom", "start_pos", "end_pos", "strand", parse_activity(F.get("extra", 0)).alias("activity"))
    sinks.write_lines(sinks.activity_lines(merged, len(labels)), at["activity"], "\t".join(["", *labels]), parts=True)
    flags = F.transform(F.sequence(F.lit(0), F.lit(len(labels) - 1)), lambda k: F.array_contains("activity", k).cast("tinyint"))
    rows = merged.select(region_key().alias("region"), "chrom", "start_pos", "end_pos", "strand", flags.alias("label"))
    sinks.write_dataset(split.by_chromosome(rows, valid or [], test or []), at["dataset"])
    return at
