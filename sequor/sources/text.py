"""Readers of interval, sequence, metadata and score files. All return DataFrames."""

from __future__ import annotations

import gzip
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sequor.operators.genome import TILE

BED = ["chrom", "start_pos", "end_pos", "name", "score", "strand"]


#: Stores that pyarrow opens by URI; files elsewhere are read by Spark.
OPENED = ("file", "hdfs", "s3", "gs", "abfs")


def is_gzipped(spark: SparkSession, path: str) -> DataFrame:
    """path, gzipped: by the first two bytes, whatever the name. Nothing else is read of files in one of the stores OPENED."""
    d = spark.read.format("binaryFile").load(path)
    if "://" in path and path.split("://")[0] not in OPENED:
        return d.select("path", (F.substring("content", 1, 2) == F.lit(b"\x1f\x8b")).alias("gzipped"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in frames:
            head = []
            for uri in p["path"]:
                store, at = FileSystem.from_uri(uri)
                with store.open_input_stream(at, compression=None) as f:
                    head.append(f.read(2))
            yield p.assign(gzipped=[h == b"\x1f\x8b" for h in head])

    return d.select("path").mapInPandas(run, "path string, gzipped boolean")


def read_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """path, line_no, line of plain files and of gzip files under any name.

    Files named .gz and plain ones could be read by text(); this one looks at the content, one task a
    file, and is meant for the reference files of an experiment, not for bulk data.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in frames:
            for path, raw in zip(p["path"], p["content"], strict=True):
                text = (gzip.decompress(raw) if raw[:2] == b"\x1f\x8b" else raw).decode()
                lines = text.splitlines()
                yield pd.DataFrame({"path": [path] * len(lines), "line_no": range(len(lines)), "line": lines})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, line_no long, line string")


def read_bed(spark: SparkSession, path: str | list[str], sniff: bool = False, source: str | None = None) -> DataFrame:
    """BED3 to BEDn: the six named columns (null where a row is shorter) and extra, the rest. '#' lines are skipped.

    source: a further column with the file's path. sniff: tell gzip files by their content.
    """
    if sniff:
        lines = read_lines(spark, path)
    else:
        lines = spark.read.text(path).select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("path"))
    f = F.split("line", "\t")
    d = lines.where((F.trim("line") != "") & ~F.col("line").startswith("#"))
    cols = [F.get(f, k).cast("long" if k in (1, 2) else "string").alias(c) for k, c in enumerate(BED)]
    return d.select(*cols, F.when(F.size(f) > 6, F.slice(f, 7, F.size(f))).alias("extra"), *([F.col("path").alias(source)] if source else []))


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """path, rec_no, name, seq: lines joined and upper-cased, blanks ignored; a header alone has an empty sequence.

    Plain files are read in Spark's splits: headers are counted within each block, blocks carry on the number of headers
    before, and only the records that a block's borders cut meet again by their numbers, so that a file of any size takes many tasks, none of
    which holds more than a batch of lines and a record. A row holds a record; read_genome tiles chromosomes. Gzip files are one block each; those that aren't named .gz, told by their first bytes, are read one a task.
    """
    packed = [r.path for r in is_gzipped(spark, path).where("gzipped and not endswith(path, '.gz')").collect()]
    # Splits depend on the files of a scan, so packed ones are left out by name: both scans of a plan have to cut the same blocks.
    plain = [r.path for r in list_files(spark, path).collect() if r.path not in set(packed)] if packed else path
    name = F.regexp_replace("_metadata.file_path", "^file:/+", "file:/")  # as listings name local files
    d = None
    if plain:
        d = spark.read.text(plain).select(name.alias("path"), F.col("_metadata.file_block_start").alias("_block"), F.trim("value").alias("_v"))
    if packed:
        whole = read_lines(spark, packed).select("path", F.lit(0).cast("long").alias("_block"), F.trim("line").alias("_v"))
        d = whole if d is None else d.unionByName(whole)
    head = F.col("_v").startswith(">")
    d = d.where("_v <> ''").select("path", "_block", F.when(head, F.col("_v")).otherwise(F.upper("_v")).alias("_v"))
    sums = d.groupBy("path", "_block").agg(F.sum(F.col("_v").startswith(">").cast("long")).alias("_n"))
    before = Window.partitionBy("path").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    base = F.broadcast(sums.select("path", "_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base")))
    name = F.trim(F.substr("_name", F.lit(2))).alias("name")

    def numbered(whole: bool) -> DataFrame:
        x = d.mapInArrow(partial(fasta_records, whole=whole), "path string, _block long, _in long, _name string, seq string")
        return x.join(base, ["path", "_block"]).withColumn("rec_no", F.col("_base") + F.col("_in") - 1)

    pieces = F.array_sort(F.collect_list(F.struct("_block", "seq")))
    g = numbered(False).where("rec_no >= 0").groupBy("path", "rec_no").agg(F.max("_name").alias("_name"), pieces.alias("_l"))
    cut = g.select("path", "rec_no", name, F.array_join(F.transform("_l", lambda x: x["seq"]), "").alias("seq"))
    return numbered(True).select("path", "rec_no", name, "seq").unionAll(cut)


def fasta_records(batches: Iterator[pa.RecordBatch], whole: bool) -> Iterator[pa.RecordBatch]:
    """path, _block, _in, _name (the header) and seq of records, from path, _block and the lines _v of blocks in their order; _in counts a block's headers.

    whole: those that another header of their block follows. Otherwise what may go on beyond the block: its lines before the
    first header (without _name) and its last record. A task holds a batch and the record that is open.
    """
    names = ["path", "_block", "_in", "_name", "seq"]
    at, count, header, parts = None, 0, None, []

    def opened() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip((*at, count, header, "".join(parts)), (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)], names=names)

    for b in batches:
        if not b.num_rows:
            continue
        path, block, v = b.columns
        head = pc.starts_with(v, ">").to_numpy(zero_copy_only=False)
        new = np.empty(len(v), bool)
        new[0] = at != (path[0].as_py(), block[0].as_py())
        new[1:] = pc.or_(pc.not_equal(path[1:], path[:-1]), pc.not_equal(block[1:], block[:-1])).to_numpy(zero_copy_only=False)
        starts = np.flatnonzero(head | new)
        pieces = starts if len(starts) and not starts[0] else np.concatenate([[0], starts])
        lines = np.cumsum(~head) - ~head
        seq = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.append(lines[pieces], (~head).sum()), pa.int32()), v.filter(pa.array(~head))), "")
        heads = np.cumsum(head)
        # Headers of earlier blocks, less those that the open block had in earlier batches.
        passed = np.maximum.accumulate(np.where(new, heads - head + count, 0)) - count
        inside = (heads - passed)[pieces]
        first = 0
        if not len(starts) or starts[0]:
            parts.append(seq[0].as_py())
            first = 1
        if len(pieces) > first:
            if at is not None and (header is not None and not new[pieces[first]]) == whole:
                yield opened()
            done = np.arange(first, len(pieces) - 1)
            done = done[(head[pieces[done]] & ~new[pieces[done + 1]]) == whole]
            if len(done):
                k = pa.array(pieces[done])
                title = pc.if_else(pa.array(head[pieces[done]]), v.take(k), pa.scalar(None, pa.string()))
                yield pa.RecordBatch.from_arrays([path.take(k), block.take(k), pa.array(inside[done]), title, seq.take(pa.array(done))], names=names)
            last = pieces[-1]
            header, parts = (v[int(last)].as_py() if head[last] else None), [seq[-1].as_py()]
        at, count = (path[-1].as_py(), block[-1].as_py()), int(inside[-1])
    if at is not None and not whole:
        yield opened()


def read_genome(spark: SparkSession, path: str, width: int = TILE) -> DataFrame:
    """(chrom, tile, part) of FASTA files of any size, as genome.tile gives them: no row holds a whole record.

    Names are the headers' first words and should differ. Lines are placed within their file's blocks (Spark's
    input splits), each in a window of its own; what a block leaves open is carried on to the next by a
    table of one row a block. A gzip file, told by its name, is one block.
    """
    line = F.trim("value")
    d = spark.read.text(path).select(F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_line"), line.alias("_v"))
    d = d.where("_v <> ''").withColumn("_name", F.when(F.col("_v").startswith(">"), F.split_part(F.trim(F.substr("_v", F.lit(2))), F.lit(" "), F.lit(1))))
    d = d.withColumn("_size", F.when(F.col("_name").isNull(), F.length("_v")).otherwise(0).cast("long"))
    block = ["_path", "_block"]
    d = d.withColumn("_rec", F.count("_name").over(Window.partitionBy(*block).orderBy("_line")))
    inside = Window.partitionBy(*block, "_rec").orderBy("_line")
    d = d.withColumn("_at", F.sum("_size").over(inside) - F.col("_size")).withColumn("_of", F.first("_name").over(inside))
    ends = d.groupBy(*block, "_rec").agg(F.min("_of").alias("_of"), F.sum("_size").alias("_size")).groupBy(*block).agg(F.max_by("_of", "_rec").alias("_of"), F.max_by("_size", "_rec").alias("_tail"))
    along = Window.partitionBy("_path").orderBy("_block")
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumn("_sum", F.sum("_tail").over(along) - F.col("_tail"))
    start = F.last(F.when(F.col("_of").isNotNull(), F.col("_sum")), ignorenulls=True).over(before)
    ends = ends.select(*block, F.last("_of", ignorenulls=True).over(before).alias("_held"), (F.col("_sum") - start).alias("_done"))
    d = d.where("_name is null").join(ends, block)
    first = F.col("_rec") == 0
    d = d.select(F.when(first, F.col("_held")).otherwise(F.col("_of")).alias("chrom"), (F.col("_at") + F.when(first, F.col("_done")).otherwise(0)).alias("_at"), F.upper("_v").alias("_v")).where("chrom is not null")
    room = (F.lit(width) - F.col("_at") % width).cast("int")
    rest = F.regexp_extract_all(F.substr("_v", room + 1), F.lit(f"(?s).{{1,{width}}}"), F.lit(0))
    d = d.select("chrom", "_at", F.posexplode(F.concat(F.array(F.substr("_v", F.lit(1), room)), rest)).alias("_k", "_piece"))
    d = d.groupBy("chrom", (F.floor(F.col("_at") / width) + F.col("_k")).cast("int").alias("tile")).agg(F.array_sort(F.collect_list(F.struct("_at", "_piece"))).alias("_p"))
    return d.select("chrom", "tile", F.array_join(F.transform("_p", lambda x: x["_piece"]), "").alias("part"))


def last_by_name(fasta: DataFrame) -> DataFrame:
    """One row a name: the last sequence, and the first record's number; records without a sequence are dropped.

    Files follow each other by path.
    """
    return fasta.where("seq <> ''").groupBy("name").agg(F.max_by("seq", F.struct("path", "rec_no")).alias("seq"), F.min_by("rec_no", F.struct("path", "rec_no")).alias("rec_no"))


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """A .tsv or .csv with a header; all columns are strings."""
    kinds = {".tsv": "\t", ".csv": ","}
    sep = next((s for e, s in kinds.items() if path.endswith((e, e + ".gz"))), None)
    if sep is None:
        raise ValueError("metadata must be .tsv or .csv")
    return spark.read.csv(path, sep=sep, header=True)


def read_sample_sheet(spark: SparkSession, path: str, offset: int = 0) -> DataFrame:
    """target_idx, label, path: two fields a line, anything else fails; indexes follow the lines from offset."""
    d = read_lines(spark, path).where(F.trim("line") != "").withColumn("f", F.split(F.trim("line"), r"\s+"))
    ok = F.assert_true(F.size("f") == 2, "a sample sheet line needs a label and a path")
    return d.where(ok.isNull()).select((F.col("line_no") + offset).cast("int").alias("target_idx"), F.get("f", 0).alias("label"), F.get("f", 1).alias("path"))


def read_targets(spark: SparkSession, path: str) -> DataFrame:
    """target_idx, label: the names in the header of an activity table, the one line that starts with a tab."""
    f = F.split("value", "\t")
    return spark.read.text(path).where(F.col("value").startswith("\t")).select(F.posexplode(F.slice(f, 2, F.size(f))).alias("target_idx", "label"))


def read_chrom_sizes(spark: SparkSession, path: str) -> DataFrame:
    f = F.split(F.trim("value"), r"\s+")
    return spark.read.text(path).where(F.trim("value") != "").select(F.get(f, 0).alias("chrom"), F.get(f, 1).cast("long").alias("length"))


def read_scores(spark: SparkSession, path: str) -> DataFrame:
    """name, scores (array<double>), integral: whether all scores of the file are whole. Lines that aren't numbers are headers."""
    f = F.split("value", "\t")
    d = spark.read.text(path).select(F.get(f, 0).alias("name"), F.transform(F.slice(f, 2, F.greatest(F.size(f) - 1, F.lit(0))), lambda x: x.try_cast("double")).alias("scores"))
    d = d.where((F.size("scores") > 0) & F.forall("scores", lambda x: x.isNotNull()))
    whole = d.agg(F.bool_and(F.forall("scores", lambda x: x % 1 == 0)).alias("integral"))
    return d.crossJoin(F.broadcast(whole))  # one row


def count_meme_motifs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).where(F.col("value").startswith("letter")).agg(F.count(F.lit(1)).alias("n"))


def read_motif_hits(spark: SparkSession, path: str) -> DataFrame:
    """query_id, target_id, q from a tab-separated table with a header and comment lines."""
    d = spark.read.csv(path, sep="\t", header=True, comment="#")
    return d.select(F.col("Query_ID").alias("query_id"), F.col("Target_ID").alias("target_id"), F.col("q-value").cast("double").alias("q"))


def list_files(spark: SparkSession, folder: str | list[str]) -> DataFrame:
    """path of each file; contents aren't read."""
    return spark.read.format("binaryFile").load(folder).select("path")
