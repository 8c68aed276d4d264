"""Registered queries of readers and writers (write, read again), of random operations and of streams.

Files go to the folder that driver and executors share. Of random operations the queries return what holds for any draw.
"""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sequor import fixtures as fx
from sequor.catalog import ORACLE, PPM, TRUTH, WEIGHTS, encoded, f11_files, greedy_sql, ppm, query
from sequor.fixtures import with_views
from sequor.functions import seq as sq
from sequor.functions.models import Linear
from sequor.operators import attribution, balance, metadata, motif, split
from sequor.plans import pipelines
from sequor.session import shared_folder
from sequor.sources import sinks, text, tfrecord
from sequor.streaming import streams

F11_SQL = ORACLE["f11_selected_files"]


def place(s: SparkSession, name: str) -> str:
    return f"{shared_folder(s)}/files-{uuid.uuid4().hex}/{name}"


def one_file(df: DataFrame, path: str, order: str) -> str:
    """The column value, in one file along order: the small files of an experiment."""
    df.coalesce(1).sortWithinPartitions(order).select("value").write.text(path)
    return path


# readers and writers


@query("s1_k1_bed", with_views("peaks", "SELECT chrom, start_pos, end_pos, peak_id AS name, '0' AS score, strand FROM peaks"))
def s1(s, d):
    at = place(s, "peaks.bed")
    sinks.write_bed(fx.peaks(s, d).select("chrom", "start_pos", "end_pos", "peak_id", F.lit("0"), "strand"), at, compress=True)
    return text.read_bed(s, at).drop("extra")


@query("s2_gzip_sniff", "SELECT * FROM (VALUES ('packed', true), ('plain', false)) v(kind, gzipped)")
def s2(s, d):
    at = place(s, "")
    rows = fx.table(s, d, "nation").select("n_name")
    sinks.write_bed(rows, f"{at}packed", compress=True)
    sinks.write_bed(rows, f"{at}plain")
    return text.is_gzipped(s, f"{at}*").select(F.element_at(F.split("path", "/"), -2).alias("kind"), "gzipped").distinct()


def fasta() -> F.Column:
    return F.concat_ws("\n", F.concat(F.lit(">"), F.col("name")), F.lower(F.substr("seq", F.lit(1), F.lit(25))), F.lit(""), F.substr("seq", F.lit(26), F.lit(15))).alias("value")


@query("s3_fasta", with_views("seq40", "SELECT CAST(seq_id AS VARCHAR) AS name, seq FROM seq40"))
def s3(s, d):
    at = place(s, "a.fa")
    fx.seq40(s, d).withColumn("name", F.col("seq_id").cast("string")).select(fasta()).write.text(at)
    return text.read_fasta(s, at).select("name", "seq")


@query("s3_genome_tiles", with_views("genome", "SELECT chrom, CAST(t AS INT) AS tile, substr(seq, t * 512 + 1, 512) AS part FROM (SELECT chrom, seq, UNNEST(range(0, (length(seq) + 511) // 512)) AS t FROM genome)"))
def s3_genome(s, d):
    at = place(s, "genome.fa")
    head = F.when(F.col("tile") == 0, F.concat(F.lit(">"), "chrom", F.lit(" x")))
    lines = F.concat_ws("\n", head, F.array_join(F.regexp_extract_all("part", F.lit(".{1,60}"), F.lit(0)), "\n"))
    fx.tiles(s, d, 4800).repartition("chrom").sortWithinPartitions("chrom", "tile").select(lines).write.text(at)
    return text.read_genome(s, at, 512)


@query("s4_fasta_last", with_views("seq40", "SELECT CAST(seq_id % 50 AS VARCHAR) AS name, arg_max(seq, seq_id) AS seq FROM seq40 GROUP BY 1"))
def s4(s, d):
    x = fx.seq40(s, d).withColumn("name", (F.col("seq_id") % 50).cast("string")).select("seq_id", fasta())
    at = place(s, "a.fa")
    x.repartitionByRange("seq_id").sortWithinPartitions("seq_id").select("value").write.text(at)
    return text.last_by_name(text.read_fasta(s, at)).select("name", "seq")


@query("s5_k4_metadata", with_views("metadata", "SELECT experiment, assembly, file_type, file, lab, CAST(row_no AS VARCHAR) AS row_no FROM metadata"))
def s5(s, d):
    at = place(s, "metadata.csv")
    sinks.write_table(fx.metadata(s, d), at, sep=",")
    return text.read_metadata(s, at).select("experiment", "assembly", "file_type", "file", "lab", "row_no")


@query("s6_sample_sheet", "SELECT CAST(n_nationkey + 3 AS INT) AS target_idx, n_name AS label, '/data/' || n_nationkey || '.bed' AS path FROM nation")
def s6(s, d):
    x = fx.table(s, d, "nation").select("n_nationkey", F.format_string("%s \t /data/%d.bed", "n_name", "n_nationkey").alias("value"))
    return text.read_sample_sheet(s, one_file(x, place(s, "samples.txt"), "n_nationkey"), 3)


@query("s7_chrom_sizes", with_views("genome", "SELECT chrom, length(seq) AS length FROM genome"))
def s7(s, d):
    at = place(s, "chrom.sizes")
    sizes = fx.pieces(s, d).groupBy("chrom").agg(F.sum(F.length("seq")).cast("string").alias("n"))
    sizes.select(F.concat_ws("\t", "chrom", "n").alias("value")).write.text(at)
    return text.read_chrom_sizes(s, at)


@query("s8_scores", "SELECT CAST(doc_id AS VARCHAR) AS name, CAST(quality AS DOUBLE) AS quality, CAST(toxic AS DOUBLE) AS toxic, true AS integral FROM labels")
def s8(s, d):
    at = place(s, "scores.txt")
    sinks.write_lines(fx.table(s, d, "labels").select(F.concat_ws("\t", *(F.col(c).cast("string") for c in ("doc_id", "quality", "toxic"))).alias("value")), at, "\tquality\ttoxic", parts=True)
    return text.read_scores(s, at).select("name", F.get("scores", 0).alias("quality"), F.get("scores", 1).alias("toxic"), "integral")


@query("s9_existing_targets", "SELECT * FROM (VALUES (0, 'quality'), (1, 'toxic')) v(target_idx, label) UNION ALL SELECT CAST(n_nationkey + 2 AS INT), n_name FROM nation")
def s9(s, d):
    """The targets of an activity table that is there, then those of a sample sheet."""
    db = place(s, "activity.txt")
    sinks.write_lines(fx.table(s, d, "labels").select(F.concat_ws("\t", *(F.col(c).cast("string") for c in ("doc_id", "quality", "toxic"))).alias("value")), db, "\tquality\ttoxic", parts=True)
    there = text.read_targets(s, db)
    x = fx.table(s, d, "nation").select("n_nationkey", F.concat_ws(" ", "n_name", F.lit("x.bed")).alias("value"))
    return there.unionByName(text.read_sample_sheet(s, one_file(x, place(s, "samples.txt"), "n_nationkey"), there.count()).select("target_idx", "label"))


@query("s10_k5_dataset", with_views("seq40", "SELECT seq_id, seq, CASE seq_id % 3 WHEN 0 THEN 'test' WHEN 1 THEN 'valid' ELSE 'train' END AS split FROM seq40"))
def k5(s, d):
    at = place(s, "dataset")
    sinks.write_dataset(fx.seq40(s, d).withColumn("split", F.when(F.col("seq_id") % 3 == 0, "test").when(F.col("seq_id") % 3 == 1, "valid").otherwise("train")), at)
    return sinks.read_dataset(s, at).select("seq_id", "seq", "split")


@query("s11_k6_tfrecord", with_views("seq40", "SELECT seq_id, CAST(40 - length(regexp_replace(seq, '[^N]', '', 'g')) AS DOUBLE) AS ones, CAST(160 AS INT) AS n FROM seq40"))
def s11(s, d):
    at = place(s, "shard-{shard:05d}.tfr.gz")
    folder = at.rsplit("/", 1)[0]
    s.range(0).write.mode("append").parquet(folder)  # makes the folder
    feature, label = F.flatten(sq.one_hot(F.col("seq"))), F.array(F.col("seq_id").cast("double"))
    tfrecord.write_tfrecords(fx.seq40(s, d), at, "seq_id", feature, label, "int8", "float64", chunk=1000).agg(F.sum("n")).collect()
    back = tfrecord.read_tfrecords(s, folder, "int8", "float64", files="*.tfr.gz")
    return back.select(F.get("label", 0).cast("long").alias("seq_id"), F.aggregate("feature", F.lit(0.0), lambda a, v: a + v).alias("ones"), F.size("feature").alias("n"))


@query("s12_k8_meme_count", with_views("seq40", "SELECT count(DISTINCT filter) AS n FROM ppm", PPM))
def s12(s, d):
    at = place(s, "motifs.meme")
    sinks.write_meme(motif.matrix_rows(ppm(s, d), "filter"), "filter", at)
    return text.count_meme_motifs(s, at)


@query("s14_j8_files", with_views("metadata", "SELECT file, CASE WHEN row_no % 2 = 0 THEN '/data/' || file || '.bed' WHEN row_no % 3 = 0 THEN '/data/' || file || '.bed.gz' END AS path FROM metadata"))
def s14(s, d):
    m = fx.metadata(s, d)
    found = m.where("row_no % 2 = 0").selectExpr("concat('/data/', file, '.bed') as path").unionAll(m.where("row_no % 3 = 0").selectExpr("concat('/data/', file, '.bed.gz') as path"))
    return metadata.with_files(m.select("file"), found, "file")


@query("k4_selection", "WITH " + F11_SQL.split("WITH ", 1)[1].replace("SELECT experiment, path, label FROM (", "SELECT label, path, label AS subset_label FROM (", 1))
def k4(s, d):
    """The sample sheet and the metadata of the selection, written and read again."""
    sheet, subset = place(s, "samples.txt"), place(s, "subset.csv")
    sinks.write_selection(f11_files(s, d), sheet, subset)
    back = text.read_metadata(s, subset).select("path", F.col("label").alias("subset_label"))
    return text.read_sample_sheet(s, sheet, 0).select("label", "path").join(back, "path")


@query("k9_filtered_metadata", with_views("metadata", "SELECT file, CAST(row_no AS VARCHAR) AS row_no FROM metadata WHERE output_type = 'IDR thresholded peaks' AND assembly = 'GRCh38' AND replicates = '1, 2'"))
def k9(s, d):
    at = place(s, "metadata_filtered.tsv")
    sinks.write_table(metadata.idr_peaks(fx.metadata(s, d), "row_no"), at)
    return text.read_metadata(s, at).select("file", "row_no")


@query("m17_motif_catalog", with_views("hits", "SELECT target_id, motif, count(*) AS n FROM hits LEFT JOIN truth USING (target_id) GROUP BY target_id, motif", TRUTH))
def m17(s, d):
    """The catalog's motif of every matrix that is hit, null if it has none, and the number of hits."""
    known = motif.ground_truth(s).select("target_id", "motif")
    return fx.hits(s, d).join(F.broadcast(known), "target_id", "left").groupBy("target_id", "motif").agg(F.count(F.lit(1)).alias("n"))


# random operations


@query("w17_uniform_sample", with_views("seq40", "SELECT count(*) // 3 AS n, count(*) // 3 AS different FROM seq40"))
def w17(s, d):
    x = fx.seq40(s, d)
    return balance.sample_uniform(x, x.count() // 3, F.col("seq_id"), 5).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("seq_id").alias("different"))


@query("w20_permutation", "SELECT count(*) AS n, CAST(0 AS BIGINT) AS low, count(*) - 1 AS high, count(*) AS places, true AS moved FROM documents")
def w20(s, d):
    x = split.permute(fx.table(s, d, "documents").select("doc_id"), "doc_id", 11)
    return x.agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("low"), F.max("place").alias("high"), F.count_distinct("place").alias("places"), F.bool_or(F.col("place") != F.col("doc_id")).alias("moved"))


@query("e2_fill_unknown", with_views("seq40", "SELECT seq_id, 40 AS n, true AS kept FROM seq40"))
def e2(s, d):
    """Every letter is in the alphabet, and those that were stay."""
    x = fx.seq40(s, d).withColumn("full", sq.fill_unknown(F.col("seq"), F.col("seq_id"), 3))
    same = F.forall(F.zip_with(F.split("seq", ""), F.split("full", ""), lambda a, b: (a == "N") | (a == b)), lambda v: v)
    return x.select("seq_id", F.length(F.regexp_replace("full", "[^ACGT]", "")).alias("n"), same.alias("kept"))


@query("e7_gumbel_softmax", with_views("", "SELECT vec_id, CAST(1 AS DOUBLE) AS total, true AS inside FROM embeddings", "one AS (SELECT 1)"))
def e7(s, d):
    x = fx.table(s, d, "embeddings").select("vec_id", attribution.gumbel_softmax(F.col("embedding").cast("array<double>"), F.col("vec_id"), 0.5, 2).alias("p"))
    return x.select("vec_id", F.round(F.aggregate("p", F.lit(0.0), lambda a, v: a + v), 6).alias("total"), F.forall("p", lambda v: (v >= 0) & (v <= 1)).alias("inside"))


def total(c: str) -> F.Column:
    return F.round(F.aggregate(F.flatten(c), F.lit(0.0), lambda a, v: a + v), 4) + 0.0


@query("e8_gaussian_noise", with_views("seq40", "SELECT CAST(count(*) AS BIGINT) AS n, true AS centred, true AS spread FROM seq40 WHERE NOT contains(seq, 'N')"))
def e8(s, d):
    x = attribution.add_noise(encoded(s, d), "seq_id", sigma=0.5, seed=4)
    x = x.select("seq_id", F.explode(F.zip_with(F.flatten("noisy"), F.flatten("x"), lambda a, b: a - b)).alias("e"))
    return x.agg(F.count_distinct("seq_id").alias("n"), (F.abs(F.avg("e")) < 0.05).alias("centred"), (F.abs(F.stddev_pop("e") - 0.5) < 0.05).alias("spread"))


# models: for a linear one the results are known


PREDICTED = "round(sum((pos % 5) * 0.25 + (strpos('ACGT', substr(seq, pos + 1, 1)) - 1) * 0.5), 4)"
PLACES = "(SELECT seq_id, seq, UNNEST(range(0, 40)) AS pos FROM seq40 WHERE NOT contains(seq, 'N')) GROUP BY seq_id"


@query("m1_saliency", with_views("seq40", f"SELECT seq_id, {PREDICTED} AS total FROM {PLACES}"))
def m1(s, d):
    x = attribution.saliency(encoded(s, d), Linear(WEIGHTS)).withColumn("t", F.array(attribution.times_input(F.col("x"), F.col("saliency"))))
    return x.select("seq_id", total("t").alias("total"))


@query("m3_smoothgrad", with_views("seq40", f"SELECT seq_id, CAST({float(np.round((WEIGHTS).sum(), 4))} AS DOUBLE) AS total FROM seq40 WHERE NOT contains(seq, 'N')"))
def m3(s, d):
    return attribution.smoothgrad(encoded(s, d), Linear(WEIGHTS), "seq_id", n=5).select("seq_id", total("smoothgrad").alias("total"))


@query("m5_expected_gradients", with_views("seq40", "SELECT seq_id, CAST(0 AS DOUBLE) AS total FROM seq40 WHERE NOT contains(seq, 'N')"))
def m5(s, d):
    """These weights add a place's and a letter's share, so shuffled baselines have the row's own prediction."""
    x = attribution.expected_gradients(encoded(s, d), Linear(WEIGHTS), "seq_id", baselines=3, steps=4)
    return x.select("seq_id", F.abs(total("expected")).alias("total"))


@query("m8_perturb", with_views("seq40", f"SELECT seq_id, CAST({round(0.1 * float(np.sign(WEIGHTS).sum()), 4)} AS DOUBLE) AS moved FROM seq40 WHERE NOT contains(seq, 'N')"))
def m8(s, d):
    x = attribution.perturb(encoded(s, d), Linear(WEIGHTS), eps=0.1, rate=0.1, steps=1)
    return x.select("seq_id", F.round(total("perturbed") - total("x"), 3).alias("moved"))


# plans and streams


@query("multi_task_dataset", greedy_sql(1000, 200, False))
def multi_task(s, d):
    """Regions merged over all targets."""
    return pipelines.multi_task(fx.peaks(s, d), 1000, 200).withColumn("activity", F.array_join(F.transform("activity", lambda x: x.cast("string")), ","))


@query("stream_sequence_features", with_views("seqs", "SELECT seq_id, length(regexp_replace(seq, '[^CG]', '', 'g')) AS gc, length(seq) AS length FROM seqs WHERE NOT contains(seq, 'N')"))
def stream_features(s, d):
    """The documents as a stream, through the stateless operators, to Parquet."""
    at = place(s, "")
    docs = s.readStream.schema(fx.table(s, d, "documents").schema).parquet(f"{d}/documents.parquet*")
    out = streams.sequence_features(fx.letters(docs)).select("seq_id", "gc", "length")
    q = out.writeStream.format("parquet").option("path", f"{at}out").option("checkpointLocation", f"{at}state").trigger(availableNow=True).start()
    q.awaitTermination()
    return s.read.schema(out.schema).parquet(f"{at}out")


def event_stream(s: SparkSession, d: str) -> DataFrame:
    return s.readStream.schema(fx.table(s, d, "events").schema).parquet(f"{d}/events.parquet*")


def finished(s: SparkSession, out: DataFrame) -> DataFrame:
    """The state of a stream's aggregation once all there is has been read."""
    at = place(s, "")
    s.createDataFrame([], out.schema).write.parquet(f"{at}out")
    w = out.writeStream.outputMode("complete").foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(f"{at}out"))
    w.option("checkpointLocation", f"{at}state").trigger(availableNow=True).start().awaitTermination()
    return s.read.schema(out.schema).parquet(f"{at}out")


@query("stream_windows", "SELECT CAST(date_trunc('hour', ts) AS TIMESTAMP) AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2")
def stream_windows(s, d):
    x = streams.windowed_counts(event_stream(s, d), "ts", "event_type")
    return finished(s, x.select("start", "event_type", "n", "total")).select("start", "event_type", "n", F.round("total", 2).alias("total"))


@query("stream_sessions", """WITH e AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    g AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM e)
    SELECT min(ts) AS start, user_id, count(*) AS n FROM g GROUP BY user_id, k""")
def stream_sessions(s, d):
    return finished(s, streams.session_counts(event_stream(s, d), "ts", "user_id").select("start", "user_id", "n"))
