"""Registered queries of motif comparison, two-strand scans, free reducers and streams of intervals."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from sequor import fixtures as fx
from sequor.catalog import WEIGHTS, encoded, greedy_sql, query, r6, sizes
from sequor.catalog_files import PLACES, PREDICTED, place
from sequor.fixtures import WINDOWS, with_views
from sequor.functions import seq as sq
from sequor.functions.models import LinearClasses, ReverseComplementScan
from sequor.operators import attribution, compare, intervals, motif
from sequor.plans import pipelines
from sequor.sources import sinks, text, tfrecord_source
from sequor.streaming import streams

# motif comparison

BASES = ", ".join(f"avg(CASE substr(seq, CAST(p + 1 AS BIGINT), 1) WHEN '{c}' THEN 1.0 ELSE 0.0 END)" for c in "ACGT")
CENTRED = "list_transform(v, lambda x: x - list_avg(v))"
COMPARED = (
    f"w AS (SELECT d.lang, d.source, s.seq FROM seq40 s JOIN documents d ON d.doc_id = s.seq_id // {WINDOWS} WHERE NOT contains(s.seq, 'N'))",
    f"qc AS (SELECT lang AS m, p, [{BASES}] AS v FROM w CROSS JOIN (SELECT UNNEST(range(0, 8)) AS p) GROUP BY lang, p)",
    f"tc AS (SELECT source AS m, p, [{BASES}] AS v FROM w CROSS JOIN (SELECT UNNEST(range(0, 12)) AS p) GROUP BY source, p)",
    f"qs AS (SELECT m, p, {CENTRED} AS c FROM qc)",
    f"ts AS (SELECT m, p, '+' AS strand, {CENTRED} AS c FROM tc UNION ALL SELECT m, 11 - p, '-', list_reverse({CENTRED}) FROM tc)",
    "r AS (SELECT q.m AS query, t.m AS target, q.p AS i, t.p AS j, strand, coalesce(list_inner_product(q.c, t.c) / nullif(sqrt(list_inner_product(q.c, q.c)) * sqrt(list_inner_product(t.c, t.c)), 0), 0) AS r FROM qs q CROSS JOIN ts t)",
    "x AS (SELECT *, CAST(least(99, greatest(0, floor(round((r + 1) * 50, 6)))) AS INT) AS step FROM r)",
    "h AS (SELECT query, i, step, count(*) / sum(count(*)) OVER (PARTITION BY query, i) AS share FROM x GROUP BY query, i, step)",
    "dist AS (SELECT query, i AS a, i + 1 AS b, step AS s, share AS pr FROM h UNION ALL SELECT d.query, d.a, d.b + 1, d.s + h.step, sum(d.pr * h.share) FROM dist d JOIN h ON h.query = d.query AND h.i = d.b GROUP BY d.query, d.a, d.b, d.s + h.step)",
    "al AS (SELECT query, target, strand, i - j AS o, sum(r) AS score, count(*) AS n, sum(step) AS s, min(i) AS a, max(i) + 1 AS b FROM x GROUP BY query, target, strand, i - j HAVING count(*) >= 4)",
    "pv AS (SELECT al.query, al.target, al.strand, al.o, any_value(score) AS score, any_value(n) AS n, coalesce(sum(pr), 0) AS p FROM al LEFT JOIN dist d ON d.query = al.query AND d.a = al.a AND d.b = al.b AND d.s >= al.s GROUP BY al.query, al.target, al.strand, al.o)",
    "ranked AS (SELECT *, row_number() OVER (PARTITION BY query, target ORDER BY round(score, 7) DESC, o, strand) AS k, 1 - product(1 - least(1.0, p)) OVER (PARTITION BY query, target) AS p_best FROM pv)",
)


@query("m15_motif_comparison", with_views("seq40", "SELECT query, target, CAST(o AS INT) AS \"offset\", strand, CAST(n AS INT) AS overlap, round(score, 5) AS score, round(p, 5) AS p_value, round(p_best, 5) AS p_best FROM ranked WHERE k = 1", *COMPARED).replace("WITH ", "WITH RECURSIVE ", 1))
def m15(s, d):
    """Motifs of the languages against motifs of the sources."""
    w = sq.drop_n(fx.seq40(s, d, "lang", "source"))
    matrix = lambda by, width: motif.matrix_rows(motif.position_probabilities(w.select(F.col(by).alias("motif"), F.substr("seq", F.lit(1), F.lit(width)).alias("window")), "motif", "window", width), "motif")
    found = compare.compare_motifs(matrix("lang", 8), matrix("source", 12))
    return found.withColumns({c: F.round(c, 5) + 0.0 for c in ("score", "p_value", "p_best")})


# two-strand scans and free reducers

KERNELS = np.array([[[float((j * 4 + k) * (f + 1) * 7 % 5 - 2) for f in range(2)] for k in range(4)] for j in range(3)])
BIAS = np.array([0.0, -1.0])


def scan_sql(f: int, turned: bool) -> str:
    w = KERNELS[::-1, ::-1] if turned else KERNELS
    terms = " + ".join(f"[{', '.join(str(v) for v in w[j, :, f])}][strpos('ACGT', substr(seq, CAST(i + {j + 1} AS BIGINT), 1))]" for j in range(3))
    return f"list_transform(range(0, 38), lambda i: greatest(0.0, {terms} + {BIAS[f]}))"


SCANS = " UNION ALL ".join(f"SELECT seq_id, {f} AS filter, {scan_sql(f, False)} AS a, list_reverse({scan_sql(f, True)}) AS b FROM seq40 WHERE NOT contains(seq, 'N')" for f in range(2))


@query("m10_reverse_complement_scan", with_views("seq40", "SELECT seq_id, filter, round(list_sum(list_transform(range(1, 39), lambda i: greatest(a[i], b[i]))) / 38, 5) AS top, round((list_sum(a) + list_sum(b)) / 76, 5) AS middle FROM scans", f"scans AS ({SCANS})"))
def m10(s, d):
    """Both poolings of two filters over both strands, a row a filter."""
    x = encoded(s, d)
    for pool, out in (("max", "top"), ("mean", "middle")):
        x = attribution.predict(x, ReverseComplementScan(KERNELS, BIAS, pool), out=out, outputs=True)
    return x.select("seq_id", F.posexplode(F.arrays_zip("top", "middle")).alias("filter", "v")).select("seq_id", "filter", r6(F.round("v.top", 5)).alias("top"), r6(F.round("v.middle", 5)).alias("middle"))


OTHER = np.array([[(p % 3) * 0.5 + k * 0.25 for k in range(4)] for p in range(40)])


@query("m1_free_reducer", with_views("seq40", f"SELECT seq_id, round(2 * (a * a + b * b), 3) AS total FROM (SELECT seq_id, {PREDICTED} / 100 AS a, sum((pos % 3) * 0.5 + (strpos('ACGT', substr(seq, CAST(pos + 1 AS BIGINT), 1)) - 1) * 0.25) / 100 AS b FROM {PLACES})"))
def m1(s, d):
    """Gradients of the squared length of the outputs, times the input: for linear outputs twice that length."""
    explain = attribution.Explainer(LinearClasses(np.stack([WEIGHTS, OTHER]) / 100), reduce=lambda p: (p * p).sum(1))
    x = explain.saliency_maps(encoded(s, d)).withColumn("t", F.array(attribution.times_input(F.col("x"), F.col("saliency"))))
    return x.select("seq_id", F.round(F.aggregate(F.flatten("t"), F.lit(0.0), lambda a, v: a + v), 3).alias("total"))


# TFRecord as a data source


@query("s11_tfrecord_source", with_views("seq40", "SELECT seq_id, seq, CAST(160 AS INT) AS n FROM seq40"))
def s11(s, d):
    """Every value of the examples, written and read through the data source, and decoded again."""
    tfrecord_source.register(s)
    at = place(s, "shards")
    x = fx.seq40(s, d).select(F.flatten(sq.one_hot(F.col("seq"))).alias("feature"), F.array(F.col("seq_id").cast("double")).alias("label"))
    x.write.format("tfrecord").mode("append").option("feature_dtype", "int8").option("label_dtype", "float64").option("chunk", "1000").save(at)
    back = s.read.format("tfrecord").option("feature_dtype", "int8").option("label_dtype", "float64").load(at)
    letters = F.transform(F.sequence(F.lit(0), F.lit(39)), lambda i: F.substr(F.lit("NACGT"), F.array_position(F.slice("feature", i * 4 + 1, F.lit(4)), F.lit(1.0)).cast("int") + 1, F.lit(1)))
    return back.select(F.get("label", 0).cast("long").alias("seq_id"), F.array_join(letters, "").alias("seq"), F.size("feature").alias("n"))


# a multi-task dataset from files to files

FLAGS = "array_to_string(list_transform(range(0, 7), lambda k: CASE WHEN list_contains(x.a, CAST(k AS INT)) THEN '1' ELSE '0' END), '') AS label, CASE chrom WHEN 'chr3' THEN 'test' WHEN 'chr2' THEN 'valid' ELSE 'train' END AS split"


@query("multi_task_files", greedy_sql(200, 50, True, "CASE strand WHEN '-' THEN '-' ELSE '+' END", "CAST((target_idx + 2) % 7 AS INT)", FLAGS))
def multi_task_files(s, d):
    """Five targets as BED folders of a sample sheet and two in an existing table: the dataset that comes out, and its activity table agrees."""
    p = fx.peaks(s, d)
    at = place(s, "build")
    p.where("target_idx < 5").select("target_idx", F.concat_ws("\t", "chrom", "start_pos", "end_pos", "peak_id", F.lit("0"), "strand").alias("value")).write.partitionBy("target_idx").text(f"{at}/beds")
    s.createDataFrame([(f"t{k} {at}/beds/target_idx={k}",) for k in range(5)], "value string").coalesce(1).write.text(f"{at}/sheet")
    old = p.where("target_idx >= 5")
    old.select(F.concat_ws("\t", "chrom", "start_pos", "end_pos", "peak_id", F.lit("0"), "strand", (F.col("target_idx") - 5).cast("string")).alias("value")).write.text(f"{at}/old.bed")
    flags = [F.when(F.col("target_idx") == k, "1").otherwise("0") for k in (5, 6)]
    sinks.write_lines(old.select(F.concat_ws("\t", "peak_id", *flags).alias("value")), f"{at}/old", "\tt5\tt6", parts=True)
    sizes(s, d).select(F.concat_ws("\t", "chrom", F.col("length").cast("string")).alias("value")).write.text(f"{at}/chrom.sizes")
    made = pipelines.multi_task_files(s, f"{at}/sheet", f"{at}/out", 200, 50, f"{at}/chrom.sizes", f"{at}/old", f"{at}/old.bed", valid=["chr2"], test=["chr3"])
    digits = lambda c: F.array_join(F.transform(c, lambda v: v.cast("int").cast("string")), "")
    table = text.read_scores(s, made["activity"]).select(F.col("name").alias("region"), digits(F.col("scores")).alias("flags"))
    rows = sinks.read_dataset(s, made["dataset"]).withColumn("label", digits(F.col("label"))).join(table, "region")
    return rows.where("label = flags").select("chrom", "strand", "start_pos", "end_pos", "label", "split")


# streams of intervals


#: Rows of a file of the peaks' stream, about, if there are more than fit FILES in a batch.
FILE_ROWS, FILES = 1_000_000, 4


def along(s, d, parts: int, *columns: str):
    """The peaks (their columns; all without any named) as a stream that moves along the genome: batches of files, each behind the one before."""
    at, p = place(s, "peaks"), fx.peaks(s, d).select(*(columns or "*"))
    top, n = p.agg(F.coalesce(F.max("start_pos"), F.lit(0)), F.count(F.lit(1))).first()
    files = max(FILES, n // (parts * FILE_ROWS))
    far = F.lit(1 << 33)
    for k in range(parts):
        p.where(F.least(F.lit(parts - 1), F.floor(F.col("start_pos") * parts / (top + 1))) == k).repartition(files).write.mode("append").parquet(at)
    end = {"start_pos": far, "end_pos": far + 1, "peak_id": F.lit("end")}
    p.limit(1).withColumns({c: v for c, v in end.items() if c in p.columns}).repartition(1).write.mode("append").parquet(at)  # moves the watermark past all others
    return s.readStream.schema(p.schema).option("maxFilesPerTrigger", files).parquet(at)


def appended(s, out):
    """What a stream has given out in append mode when all there is has been read."""
    at = place(s, "")
    out.writeStream.outputMode("append").format("parquet").option("path", f"{at}out").option("checkpointLocation", f"{at}state").trigger(availableNow=True).start().awaitTermination()
    return s.read.schema(out.schema).parquet(f"{at}out")


@query("stream_islands", with_views("peaks", "SELECT chrom, island, max(end_pos) AS reach, count(*) AS n FROM i GROUP BY chrom, island",
    "m AS (SELECT *, max(end_pos) OVER (PARTITION BY chrom ORDER BY start_pos, peak_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM peaks)",
    "i AS (SELECT *, max(CASE WHEN reach IS NULL OR reach - 50 <= start_pos THEN start_pos END) OVER (PARTITION BY chrom ORDER BY start_pos, peak_id ROWS UNBOUNDED PRECEDING) AS island FROM m)"))
def stream_islands(s, d):
    """Islands of the peaks, given out batch by batch as the stream moves past them."""
    return appended(s, streams.islands(along(s, d, 5, "chrom", "start_pos", "end_pos"), 50, ["chrom"], 0)).where(F.col("island") < 1 << 33)


@query("stream_overlaps", with_views("peaks", "SELECT a.peak_id, b.peak_id AS b_peak_id FROM peaks a JOIN peaks b ON a.chrom = b.chrom AND a.start_pos < b.end_pos AND b.start_pos < a.end_pos WHERE b.strand = '-' AND b.target_idx = 6"))
def stream_overlaps(s, d):
    """All peaks as a stream against those of one target on one strand."""
    b = fx.peaks(s, d).where("strand = '-' and target_idx = 6")
    levels = sorted({0, *intervals.levels_in_use(fx.peaks(s, d), intervals.BIN)})  # 0: of the row that ends the stream
    return appended(s, streams.overlaps(along(s, d, 3), b, levels=levels).select("peak_id", "b_peak_id"))
