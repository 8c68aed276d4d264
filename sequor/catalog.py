"""The registered queries of the library's operators, each with equivalent SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sequor import fixtures as fx
from sequor.fixtures import with_views
from sequor.functions import seq as sq
from sequor.functions.models import Linear, LinearClasses, Logistic, get_model
from sequor.operators import attribution, balance, genome, intervals, metadata, metrics, motif, split
from sequor.plans import pipelines

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    from sequor import catalog_files, catalog_more  # noqa: F401  add their queries

    return QUERIES


def oracle_sql() -> dict[str, str]:
    queries()
    return ORACLE


def r6(c) -> F.Column:
    return F.round(c, 6)


BED = ["peak_id", "chrom", "start_pos", "end_pos"]


# intervals


@query("f1_max_length", with_views("peaks", "SELECT peak_id, chrom, start_pos, end_pos FROM peaks WHERE end_pos - start_pos < 500"))
def f1(s, d):
    return intervals.max_length(fx.peaks(s, d), 500).select(*BED)


@query("f2_resize", with_views("peaks", "SELECT peak_id, chrom, CAST(round_even((start_pos + end_pos) / 2, 0) AS BIGINT) - 50 AS start_pos, CAST(round_even((start_pos + end_pos) / 2, 0) AS BIGINT) + 51 AS end_pos FROM peaks"))
def f2(s, d):
    return intervals.resize(fx.peaks(s, d), 101).select(*BED)


@query("f3_midpoint", with_views("peaks", "SELECT peak_id, CAST(trunc((start_pos + end_pos) / 2) AS BIGINT) AS mid FROM peaks"))
def f3(s, d):
    return fx.peaks(s, d).select("peak_id", intervals.midpoint().alias("mid"))


@query("f4_points", with_views("peaks", "SELECT peak_id, chrom, CAST(trunc((start_pos + end_pos) / 2) AS BIGINT) AS start_pos, CAST(trunc((start_pos + end_pos) / 2) AS BIGINT) + 1 AS end_pos FROM peaks"))
def f4(s, d):
    return intervals.to_points(fx.peaks(s, d)).select(*BED)


SIZES = "sizes AS (SELECT 'chr' || (l_suppkey % 22 + 1) AS chrom, CAST(max(l_partkey) * 97 + 20000 AS BIGINT) AS length FROM lineitem GROUP BY 1)"


def sizes(s, d):
    return fx.table(s, d, "lineitem").groupBy(F.expr("concat('chr', l_suppkey % 22 + 1)").alias("chrom")).agg((F.max("l_partkey") * 97 + 20000).cast("long").alias("length"))


@query(
    "f5_extend_clamp",
    with_views("peaks", "SELECT peak_id, chrom, CAST(trunc(st) AS BIGINT) AS start_pos, CAST(trunc(st + 1001) AS BIGINT) AS end_pos FROM moved", SIZES,
               "base AS (SELECT peak_id, chrom, length, greatest(0.0, trunc((start_pos + end_pos) / 2) - 500.5) AS st FROM peaks LEFT JOIN sizes USING (chrom))",
               "moved AS (SELECT peak_id, chrom, CASE WHEN st + 1001 > length THEN length - 1001.0 ELSE st END AS st FROM base)"),
)
def f5(s, d):
    return intervals.extend(fx.peaks(s, d), 1001, sizes(s, d)).select(*BED)


@query("f9_strand", with_views("peaks", "SELECT peak_id, CASE WHEN strand IN ('+', '-') THEN strand ELSE '+' END AS strand FROM peaks"))
def f9(s, d):
    return fx.peaks(s, d).select("peak_id", intervals.normal_strand(F.col("strand")).alias("strand"))


@query("f10_chromosomes", "SELECT c_custkey, chrom FROM (SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN 'chrX' WHEN 1 THEN 'chrY' WHEN 2 THEN 'chr1_alt' WHEN 3 THEN 'chrM' ELSE 'chr' || (c_custkey % 22) END AS chrom FROM customer) WHERE regexp_full_match(chrom, 'chr[0-9]+') OR chrom = 'chrX'")
def f10(s, d):
    c = fx.table(s, d, "customer").selectExpr("c_custkey", "case c_custkey % 6 when 0 then 'chrX' when 1 then 'chrY' when 2 then 'chr1_alt' when 3 then 'chrM' else concat('chr', c_custkey % 22) end as chrom")
    return intervals.keep_chromosomes(c, ignore_y=True, ignore_auxiliary=True)


@query("f15_region_key", with_views("peaks", "SELECT peak_id, chrom || ':' || start_pos || '-' || end_pos || '(' || strand || ')' AS region FROM peaks"))
def f15(s, d):
    return fx.peaks(s, d).select("peak_id", intervals.region_key().alias("region"))


@query("f16_activity_parse", with_views("peaks", "SELECT peak_id, CASE WHEN target_idx = 0 THEN '' ELSE target_idx || '-' || (target_idx + 2) END AS targets FROM peaks"))
def f16(s, d):
    p = fx.peaks(s, d).selectExpr("peak_id", "case when target_idx = 0 then '.' else concat(target_idx, ',', target_idx + 2, ',') end as a")
    return p.select("peak_id", F.array_join(intervals.parse_activity(F.col("a")).cast("array<string>"), "-").alias("targets"))


@query("j1_overlap", with_views("peaks", "SELECT a.peak_id, b.peak_id AS b_peak_id FROM peaks a JOIN peaks b ON a.chrom = b.chrom AND a.start_pos < b.end_pos AND b.start_pos < a.end_pos WHERE a.strand = '-' AND b.strand <> '-'"))
def j1(s, d):
    p = fx.peaks(s, d)
    return intervals.overlap_join(p.where("strand = '-'"), p.where("strand <> '-'")).select("peak_id", "b_peak_id")


@query("j2_anti", with_views("peaks", "SELECT peak_id, chrom, start_pos, end_pos FROM peaks a WHERE strand = '-' AND NOT EXISTS (SELECT 1 FROM peaks b WHERE b.strand <> '-' AND a.chrom = b.chrom AND a.start_pos < b.end_pos AND b.start_pos < a.end_pos)"))
def j2(s, d):
    p = fx.peaks(s, d)
    return intervals.intersect(p.where("strand = '-'"), p.where("strand <> '-'"), "peak_id", nonoverlap=True).select(*BED)


@query("w1_islands", with_views("peaks", "SELECT peak_id, chrom, CAST(max(nw) OVER (PARTITION BY chrom ORDER BY st, peak_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS island FROM o",
    "e AS (SELECT peak_id, chrom, greatest(0, CAST(trunc((start_pos + end_pos) / 2) AS BIGINT) - 100) AS st, greatest(0, CAST(trunc((start_pos + end_pos) / 2) AS BIGINT) - 100) + 200 AS en FROM peaks)",
    "m AS (SELECT *, max(en) OVER (PARTITION BY chrom ORDER BY st, peak_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM e)",
    "o AS (SELECT *, CASE WHEN reach IS NULL OR reach - 50 <= st THEN st END AS nw FROM m)"))
def w1(s, d):
    return intervals.islands(intervals.extend(fx.peaks(s, d), 200), 50, ["chrom"], ["peak_id"]).select("peak_id", "chrom", "island")


def greedy_sql(length: int, overlap: int, sized: bool, strand: str = "'+'", target: str = "target_idx", columns: str = "array_to_string(x.a, ',') AS activity") -> str:
    """Regions about all peaks, merged one pair after another: the largest overlap of each island, the first on ties."""
    moved = f"CASE WHEN s + {length} > size THEN CAST(size - {length} AS DOUBLE) ELSE s END"
    mid = lambda x: f"trunc(({x}.s + {x}.e) / 2)"
    a, b = "p[i]", "p[i + 1]"
    middle = f"trunc(0.5 + ((1 + len({a}.a)) * {mid(a)} + (1 + len({b}.a)) * {mid(b)}) / (2 + len({a}.a) + len({b}.a)))"
    start = f"greatest(0.0, {middle} - {length / 2})"
    kept = f"CASE WHEN {start} + {length} > size THEN CAST(size - {length} AS DOUBLE) ELSE {start} END"
    return with_views("peaks", "SELECT chrom, strand, CAST(trunc(x.s) AS BIGINT) AS start_pos, CAST(trunc(x.e) AS BIGINT) AS end_pos, " + columns + " FROM (SELECT chrom, strand, unnest(p) AS x FROM step)",
        SIZES if sized else "sizes AS (SELECT DISTINCT chrom, CAST(NULL AS BIGINT) AS length FROM peaks)",
        f"base AS (SELECT chrom, {strand} AS strand, length AS size, greatest(0.0, trunc((start_pos + end_pos) / 2) - {length / 2}) AS s, {target} AS target_idx FROM peaks JOIN sizes USING (chrom))",
        f"ext AS (SELECT chrom, strand, size, CAST(trunc({moved}) AS BIGINT) AS s, CAST(trunc({moved} + {length}) AS BIGINT) AS e, target_idx FROM base)",
        "reached AS (SELECT *, max(e) OVER (PARTITION BY chrom, strand ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM ext)",
        f"isl AS (SELECT *, max(CASE WHEN reach IS NULL OR reach - {overlap} <= s THEN s END) OVER (PARTITION BY chrom, strand ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM reached)",
        "whole AS (SELECT chrom, strand, island, any_value(size) AS size, list(struct_pack(s := CAST(s AS DOUBLE), e := CAST(e AS DOUBLE), a := [target_idx]) ORDER BY s, e, target_idx) AS p FROM isl GROUP BY chrom, strand, island)",
        f"""step(chrom, strand, island, size, p) USING KEY (chrom, strand, island) AS (SELECT * FROM whole UNION
        SELECT chrom, strand, island, size, list_concat(p[:i - 1], [struct_pack(s := {kept}, e := {kept} + {length}, a := list_sort(list_distinct(list_concat({a}.a, {b}.a))))], p[i + 2:])
        FROM (SELECT *, list_position(o, m) AS i FROM (SELECT *, list_max(o) AS m FROM (SELECT *, list_transform(range(1, len(p)), lambda k: p[k].e - p[k + 1].s) AS o FROM step WHERE len(p) > 1)) WHERE m >= {overlap}))""").replace("WITH ", "WITH RECURSIVE ", 1)  # fmt: skip


@query("w2_greedy_merge", greedy_sql(200, 50, True))
def w2(s, d):
    return pipelines.multi_task(fx.peaks(s, d), 200, 50, sizes(s, d)).withColumn("activity", F.array_join(F.col("activity").cast("array<string>"), ","))


@query("w3_merge_at_once", with_views("peaks", """SELECT chrom, grp, CAST(greatest(0, floor(0.5 + sum(2 * trunc((start_pos + end_pos - 1) / 2.0 * 2) / 2) / sum(2)) - 100) AS BIGINT) AS start_pos,
    CAST(greatest(0, floor(0.5 + sum(2 * trunc((start_pos + end_pos - 1) / 2.0 * 2) / 2) / sum(2)) - 100) + 200 AS BIGINT) AS end_pos, string_agg(DISTINCT target_idx, ',' ORDER BY target_idx) AS activity
    FROM (SELECT *, start_pos // 2000 AS grp FROM peaks) GROUP BY chrom, grp"""))  # fmt: skip
def w3(s, d):
    p = fx.peaks(s, d).withColumns({"grp": F.floor(F.col("start_pos") / 2000), "activity": F.array("target_idx")})
    return intervals.merge_at_once(p, 200, ["chrom", "grp"]).withColumn("activity", F.array_join(F.col("activity").cast("array<string>"), ","))


@query("w4_sort", with_views("peaks", "SELECT peak_id, chrom, CAST(row_number() OVER (PARTITION BY chrom, strand ORDER BY start_pos, end_pos, peak_id) AS BIGINT) AS place FROM peaks"))
def w4(s, d):
    return intervals.sort_places(fx.peaks(s, d), ["chrom", "strand"], ["start_pos", "end_pos", "peak_id"]).select("peak_id", "chrom", "place")


@query("k3_activity_matrix", with_views("peaks", "SELECT region || chr(9) || array_to_string(list_transform(range(0, 7), lambda i: CASE WHEN list_contains(acts, i) THEN '1' ELSE '0' END), chr(9)) AS value FROM (SELECT chrom || ':' || (start_pos // 1000 * 1000) || '-' || (start_pos // 1000 * 1000 + 1000) || '(+)' AS region, list(DISTINCT target_idx) AS acts FROM peaks GROUP BY 1)"))
def k3(s, d):
    from sequor.sources.sinks import activity_lines

    p = fx.peaks(s, d).select("chrom", (F.floor(F.col("start_pos") / 1000) * 1000).alias("start_pos"), F.array("target_idx").alias("a"))
    g = p.groupBy("chrom", "start_pos").agg(intervals.union_activity(F.col("a")).alias("activity")).withColumns({"end_pos": F.col("start_pos") + 1000, "strand": F.lit("+")})
    return activity_lines(g, 7)


@query("k2_merged_bed", with_views("peaks", "SELECT concat_ws(chr(9), chrom, g * 1000, g * 1000 + 1000, '.', '1', '+', string_agg(DISTINCT target_idx, ',' ORDER BY target_idx)) AS value FROM (SELECT *, start_pos // 1000 AS g FROM peaks) GROUP BY chrom, g"))
def k2(s, d):
    from sequor.sources.sinks import merged_bed_lines

    p = fx.peaks(s, d).select("chrom", (F.floor(F.col("start_pos") / 1000) * 1000).alias("start_pos"), F.array("target_idx").alias("a"))
    g = p.groupBy("chrom", "start_pos").agg(intervals.union_activity(F.col("a")).alias("activity")).withColumns({"end_pos": F.col("start_pos") + 1000, "strand": F.lit("+")})
    return merged_bed_lines(g)


@query("a15_activity_union", with_views("peaks", "SELECT chrom, string_agg(DISTINCT target_idx, ',' ORDER BY target_idx) AS activity FROM peaks GROUP BY chrom"))
def a15(s, d):
    return fx.peaks(s, d).groupBy("chrom").agg(F.array_join(intervals.union_activity(F.array("target_idx")).cast("array<string>"), ",").alias("activity"))


# sequences

RC = "reverse(translate(seq, 'ACGT', 'TGCA'))"
LETTER = "UNNEST(range(1, length(seq) + 1))"


@query("f6_n_filter", with_views("seqs", "SELECT seq_id, seq FROM seqs WHERE NOT contains(seq, 'N')"))
def f6(s, d):
    return sq.drop_n(fx.seqs(s, d))


@query("f7_gc", with_views("seqs", "SELECT seq_id, length(regexp_replace(seq, '[^CG]', '', 'g')) AS gc, round(length(regexp_replace(seq, '[^CG]', '', 'g')) / nullif(length(seq), 0), 6) AS share FROM seqs"))
def f7(s, d):
    return fx.seqs(s, d).select("seq_id", sq.gc_count(F.col("seq")).cast("long").alias("gc"), r6(sq.gc_content(F.col("seq"))).alias("share"))


@query("f8_reverse_complement", with_views("seqs", f"SELECT seq_id, {RC} AS rc FROM seqs"))
def f8(s, d):
    return fx.seqs(s, d).select("seq_id", sq.reverse_complement(F.col("seq")).alias("rc"))


@query("f17_crop_pad", with_views("seqs", "SELECT seq_id, CASE WHEN length(seq) >= 1000 THEN substr(seq, (length(seq) - 1000) // 2 + 1, 1000) ELSE rpad(repeat('.', (1000 - length(seq)) // 2) || seq, 1000, '.') END AS seq FROM seqs"))
def f17(s, d):
    return fx.seqs(s, d).select("seq_id", sq.crop_or_pad(F.col("seq"), 1000).alias("seq"))


@query("e1_one_hot", with_views("seq40", "SELECT seq_id, array_to_string(list_transform(string_split(seq, ''), lambda c: CASE c WHEN 'A' THEN '1000' WHEN 'C' THEN '0100' WHEN 'G' THEN '0010' WHEN 'T' THEN '0001' ELSE '0000' END), '') AS bits FROM seq40"))
def e1(s, d):
    x = sq.one_hot_equal_length(fx.seq40(s, d))
    return x.select("seq_id", F.array_join(F.transform(F.flatten("x"), lambda v: v.cast("int").cast("string")), "").alias("bits"))


@query("e3_decode", with_views("seqs", "SELECT seq_id, replace(seq, 'N', 'A') AS seq FROM seqs"))
def e3(s, d):
    return fx.seqs(s, d).select("seq_id", sq.decode(sq.one_hot(F.col("seq"), unknown="uniform")).alias("seq"))


@query("e4_shuffle", with_views("seqs", "SELECT seq_id, array_to_string(list_sort(string_split(seq, '')), '') AS letters, length(seq) AS n FROM seqs"))
def e4(s, d):
    x = fx.seqs(s, d).select("seq_id", sq.shuffled(F.col("seq"), F.col("seq_id"), 7).alias("t"))
    return x.select("seq_id", F.array_join(F.array_sort(F.filter(F.split("t", ""), lambda c: c != "")), "").alias("letters"), F.length("t").cast("long").alias("n"))


@query("e5_klet_shuffle", with_views("seqs", "SELECT seq_id, k, count(*) AS n FROM (SELECT seq_id, substr(seq, i, 2) AS k FROM (SELECT seq_id, seq, UNNEST(range(1, length(seq))) AS i FROM seqs)) GROUP BY seq_id, k"))
def e5(s, d):
    x = sq.klet_shuffle(fx.seqs(s, d), "seq_id", k=2, seed=3).where(F.length("shuffled") > 1)
    k = F.transform(F.sequence(F.lit(1), F.length("shuffled") - 1), lambda i: F.substr("shuffled", i, F.lit(2)))
    return x.select("seq_id", F.explode(k).alias("k")).groupBy("seq_id", "k").agg(F.count(F.lit(1)).alias("n"))


@query("e6_mutants", with_views("seq40", "SELECT seq_id, pos, nt, substr(seq, 1, pos) || nt || substr(seq, pos + 2) AS mutant FROM (SELECT seq_id, seq, CAST(UNNEST(range(0, 40)) AS INT) AS pos FROM seq40) CROSS JOIN (VALUES ('A'), ('C'), ('G'), ('T')) v(nt)"))
def e6(s, d):
    return sq.mutants(fx.seq40(s, d)).select("seq_id", "pos", "nt", "mutant")


@query("s10_augmented", with_views("seqs", f"SELECT seq_id, seq, false AS is_rc FROM seqs UNION ALL SELECT seq_id, {RC}, true FROM seqs"))
def s10(s, d):
    return sq.with_reverse_complements(fx.seqs(s, d))


@query("j3_get_sequences", with_views("near genome", f"SELECT peak_id, CASE WHEN strand = '-' THEN {RC} ELSE seq END AS seq FROM g", "g AS (SELECT peak_id, strand, substr(seq, start_pos + 1, end_pos - start_pos) AS seq FROM near JOIN genome USING (chrom) WHERE end_pos <= length(seq))"))
def j3(s, d):
    of = fx.held_pieces(s, d)
    return genome.get_sequences(fx.near_peaks(s, d, of), fx.tiles(s, d, 2048, 1150, of), "peak_id", 2048, reach=1150).select("peak_id", "seq")


@query("j4_align", with_views("seqs", "SELECT s.seq_id, seq, quality FROM seqs s JOIN labels l ON s.seq_id = l.doc_id"))
def j4(s, d):
    """Every listed score must have its sequence's row; sequences without scores are left out first."""
    scores = fx.table(s, d, "labels").select(F.col("doc_id").alias("seq_id"), "quality")
    x = fx.seqs(s, d).join(scores.select("seq_id"), "seq_id", "left_semi").join(scores, "seq_id", "left")
    return x.where(F.assert_true(F.col("quality").isNotNull()).isNull()).select("seq_id", "seq", "quality")


GC40 = f"""g AS (SELECT seq_id, CAST(length(regexp_replace(seq, '[^CG]', '', 'g')) AS INT) AS gc, coalesce(lang = 'en', false) AS is_pos
    FROM seq40 JOIN (SELECT doc_id, lang FROM documents) ON doc_id = seq_id // {fx.WINDOWS})"""


def sides(s, d):
    """seq_id, gc of the windows of English documents, and of all others."""
    g = fx.seq40(s, d, "lang").select("seq_id", sq.gc_count(F.col("seq")).alias("gc"), F.coalesce(F.col("lang") == "en", F.lit(False)).alias("is_pos"))
    return g.where("is_pos").drop("is_pos"), g.where("not is_pos").drop("is_pos")


@query("j5_nearest_gc", with_views("seq40", "SELECT p.seq_id, p.gc, n.gc AS nearest, n.m AS match_id FROM (SELECT * FROM g WHERE is_pos) p CROSS JOIN (SELECT gc, min(seq_id) AS m FROM g WHERE NOT is_pos GROUP BY gc) n QUALIFY row_number() OVER (PARTITION BY p.seq_id ORDER BY abs(p.gc - n.gc), n.gc DESC) = 1", GC40))
def j5(s, d):
    return balance.match_gc(*sides(s, d), "seq_id").select("seq_id", "gc", "nearest", "match_id")


@query("a18_kde", with_views("seq40", """SELECT gc, round(w / (SELECT sum(w * n) FROM k JOIN (SELECT gc, count(*) AS n FROM b GROUP BY gc) USING (gc)), 6) AS weight FROM k""", GC40,
    "a AS (SELECT gc / 40 AS x FROM g WHERE is_pos)", "b AS (SELECT gc FROM g WHERE NOT is_pos)", "h AS (SELECT pow(count(*), -0.2) * stddev_samp(x) AS h FROM a)",
    "k AS (SELECT gc, sum(exp(-0.5 * pow((gc / 40 - x) / h, 2))) AS w FROM (SELECT DISTINCT gc FROM b) CROSS JOIN a CROSS JOIN h GROUP BY gc)"))
def a18(s, d):
    return balance.kde_weights(*sides(s, d), 40).select("gc", r6("weight").alias("weight"))


@query("w18_weighted_sample", with_views("seq40", "SELECT CAST(least(count(*) FILTER (is_pos) // 2, count(*) FILTER (NOT is_pos)) AS BIGINT) AS n, true AS all_there FROM g", GC40))
def w18(s, d):
    pos, neg = sides(s, d)
    x = balance.sample_like(pos, neg, 40, "seq_id", n=pos.count() // 2).join(neg.select("seq_id", F.lit(True).alias("there")), "seq_id", "left")
    return x.agg(F.count_distinct("seq_id").alias("n"), F.bool_and(F.coalesce("there", F.lit(False))).alias("all_there"))


@query("w19_balance", with_views("seq40", "SELECT least(count(*) FILTER (is_pos), count(*) FILTER (NOT is_pos)) AS n FROM g", GC40))
def w19(s, d):
    return balance.down_sample(*sides(s, d), "seq_id").agg(F.least(F.count(F.lit(1)), F.lit(1 << 40)).alias("n"))


@query("w16_chrom_split", with_views("peaks", "SELECT peak_id, CASE WHEN chrom IN ('chr3', 'chr4') THEN 'test' WHEN chrom IN ('chr2', 'chr3') THEN 'valid' ELSE 'train' END AS split FROM peaks"))
def w16(s, d):
    return split.by_chromosome(fx.peaks(s, d), ["chr2", "chr3"], ["chr3", "chr4"]).select("peak_id", "split")


@query("w14_split_sizes", "SELECT 'train' AS split, CAST(floor(count(*) * CAST(0.7 AS DOUBLE)) AS BIGINT) AS n FROM documents UNION ALL SELECT 'valid', CAST(floor(count(*) * (CAST(0.7 AS DOUBLE) + CAST(0.1 AS DOUBLE))) - floor(count(*) * CAST(0.7 AS DOUBLE)) AS BIGINT) FROM documents UNION ALL SELECT 'test', CAST(count(*) - floor(count(*) * (CAST(0.7 AS DOUBLE) + CAST(0.1 AS DOUBLE))) AS BIGINT) FROM documents")
def w14(s, d):
    x = split.by_fraction(fx.table(s, d, "documents").select("doc_id"), "doc_id", 0.7, 0.1, seed=42)
    return x.groupBy("split").agg(F.count_distinct("doc_id").alias("n"))


@query("w15_count_split_sizes", "WITH c AS (SELECT count(*) AS n, CAST(floor(0.5 + 0.15 * count(*)) AS BIGINT) AS t, CAST(floor(0.5 + 0.1 * count(*)) AS BIGINT) AS v FROM documents) SELECT 'train' AS split, (n - t - v) - (n - t - v) % 16 AS n FROM c UNION ALL SELECT 'valid', v - v % 16 FROM c UNION ALL SELECT 'test', t - t % 16 FROM c")
def w15(s, d):
    return split.by_count(fx.table(s, d, "documents").select("doc_id"), "doc_id", 0.1, 0.15, batch=16, seed=42).groupBy("split").agg(F.count_distinct("doc_id").alias("n"))


@query("w11_union", with_views("peaks", "SELECT chrom, label, count(*) AS n FROM (SELECT chrom, 1 AS label FROM peaks WHERE strand = '-' UNION ALL SELECT chrom, 0 FROM peaks WHERE strand <> '-') GROUP BY chrom, label"))
def w11(s, d):
    p = fx.peaks(s, d)
    return p.where("strand = '-'").withColumn("label", F.lit(1)).unionByName(p.where("strand <> '-'").withColumn("label", F.lit(0))).groupBy("chrom", "label").agg(F.count(F.lit(1)).alias("n"))


@query("w12_symmetric_difference", "SELECT doc_id FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels) UNION (SELECT doc_id FROM labels EXCEPT SELECT doc_id FROM documents)")
def w12(s, d):
    a, b = fx.table(s, d, "documents").select("doc_id"), fx.table(s, d, "labels").select("doc_id")
    return a.exceptAll(b).unionAll(b.exceptAll(a)).distinct()


# metadata


@query("f11_select_experiments", with_views("metadata", "SELECT experiment, file FROM metadata WHERE experiment IN ('Brand#1', 'Brand#2', 'Brand#7', 'Brand#16') AND assembly = 'GRCh38' AND starts_with(file_type, 'bed') AND replicates = '1, 2' QUALIFY row_number() OVER (PARTITION BY experiment ORDER BY row_no) = 1"))
def f11(s, d):
    return metadata.select_experiments(fx.metadata(s, d), ["Brand#1", "Brand#2", "Brand#7", "Brand#16"], "GRCh38", {"replicates": "1, 2"}, "row_no").select("experiment", "file")


@query("f11_selected_files", with_views("metadata", """SELECT experiment, path, label FROM (SELECT experiment, replace(concat_ws('_', file_type, target, biosample, coalesce(lab, 'nan'), experiment), ' ', '-') AS label,
    CASE WHEN row_no % 2 = 0 THEN '/data/' || file || '.bed' WHEN row_no % 5 = 0 THEN '/data/' || file || '.bed.gz' END AS path
    FROM metadata WHERE assembly = 'GRCh38' AND starts_with(file_type, 'bed') AND replicates = '1, 2' QUALIFY row_number() OVER (PARTITION BY experiment ORDER BY row_no) = 1) WHERE path IS NOT NULL"""))
def f11_files(s, d):
    """Of all experiments, those whose chosen file is there."""
    m = fx.metadata(s, d)
    there = m.where("row_no % 2 = 0").selectExpr("concat('/data/', file, '.bed') as path").unionAll(m.where("row_no % 5 = 0").selectExpr("concat('/data/', file, '.bed.gz') as path"))
    names = [r[0] for r in m.select("experiment").distinct().collect()]  # brands: at most a few dozen
    x = metadata.selected_files(m, names, "GRCh38", {"replicates": "1, 2"}, "row_no", there, ["file_type", "target", "biosample", "lab", "experiment"])
    return x.where("path is not null").select("experiment", "path", "label")


@query("f12_label", with_views("metadata", "SELECT file, replace(concat_ws('_', file_type, target, biosample, coalesce(lab, 'nan'), experiment), ' ', '-') AS label FROM metadata"))
def f12(s, d):
    return fx.metadata(s, d).select("file", metadata.label("file_type", "target", "biosample", "lab", "experiment").alias("label"))


@query("f13_idr_peaks", with_views("metadata", "SELECT experiment, file, row_no FROM metadata WHERE output_type = 'IDR thresholded peaks' AND assembly = 'GRCh38' AND replicates = '1, 2'"))
def f13(s, d):
    return metadata.idr_peaks(fx.metadata(s, d), "row_no").select("experiment", "file", "row_no")


@query("f14_project", with_views("metadata", "SELECT file, split_part(target, '-', 1) AS target FROM metadata"))
def f14(s, d):
    return fx.metadata(s, d).select("file", metadata.target_name(F.col("target")).alias("target"))


@query("s13_download_plan", with_views("metadata", "SELECT url, 'data/' || biosample || '/' || split_part(target, '-', 1) || '/' || file || '.bed.gz' AS target_path FROM metadata"))
def s13(s, d):
    return metadata.download_plan(fx.metadata(s, d), "data")


@query("w5_first_row", with_views("metadata", "SELECT experiment, min(row_no) AS row_no FROM metadata GROUP BY experiment"))
def w5(s, d):
    return metadata.first_of_group(fx.metadata(s, d), "experiment", ["row_no"]).select("experiment", "row_no")


@query("w13_distinct", with_views("metadata", "SELECT DISTINCT experiment FROM metadata"))
def w13(s, d):
    return fx.metadata(s, d).select("experiment").distinct()


# metrics

AUC = "SELECT {k}, (sum(CASE WHEN label = 1 THEN r END) - sum(label) * (sum(label) + 1) / 2) / (sum(label) * (count(*) - sum(label))) AS auroc FROM (SELECT {k}, label, rank() OVER (PARTITION BY {k} ORDER BY score) + (count(*) OVER (PARTITION BY {k}, score) - 1) / 2 AS r FROM {t}) GROUP BY {k}"
CURVE = "SELECT {k}, score, sum(label) AS pos, count(*) AS n, sum(sum(label)) OVER (PARTITION BY {k} ORDER BY score DESC) AS tp, sum(count(*)) OVER (PARTITION BY {k} ORDER BY score DESC) AS all_ FROM {t} GROUP BY {k}, score"
AP = "SELECT {k}, sum(pos * tp / all_) / sum(pos) AS average_precision FROM (" + CURVE + ") GROUP BY {k}"
LONG = {"k": "task", "t": "long"}


@query("a1_auroc", with_views("long", f"SELECT task, round(auroc, 6) AS auroc FROM ({AUC.format(**LONG)})"))
def a1(s, d):
    return metrics.auroc(fx.long_preds(s, d), ["task"]).withColumn("auroc", r6("auroc"))


@query("a2_average_precision", with_views("long", f"SELECT task, round(average_precision, 6) AS average_precision FROM ({AP.format(**LONG)})"))
def a2(s, d):
    return metrics.average_precision(fx.long_preds(s, d), ["task"]).withColumn("average_precision", r6("average_precision"))


@query("a3_accuracy", with_views("long", "SELECT task, round(avg(CAST(label = round_even(score, 0) AS INT)), 6) AS accuracy FROM long GROUP BY task"))
def a3(s, d):
    return metrics.accuracy(fx.long_preds(s, d), ["task"]).withColumn("accuracy", r6("accuracy"))


@query("a4_pearson", with_views("long", "SELECT task, round(corr(score, label), 6) AS pearson FROM long GROUP BY task"))
def a4(s, d):
    return metrics.pearson(fx.long_preds(s, d), ["task"]).withColumn("pearson", r6("pearson"))


R2 = "SELECT task, slope, 1 - (syy - 2 * slope * sxy + slope * slope * sxx) / (syy - sy * sy / n) AS rsquare FROM (SELECT task, count(*) AS n, sum(label) AS sy, sum(label * label) AS syy, sum(score * score) AS sxx, sum(score * label) AS sxy, sum(score * label) / sum(score * score) AS slope FROM long GROUP BY task)"


@query("a5_r_squared_origin", with_views("long", f"SELECT task, round(slope, 6) AS slope, round(rsquare, 6) AS rsquare FROM ({R2})"))
def a5(s, d):
    return metrics.r_squared_origin(fx.long_preds(s, d), ["task"]).select("task", r6("slope").alias("slope"), r6("rsquare").alias("rsquare"))


@query("a6_suite", with_views("long", f"SELECT metric, round(avg(v), 5) AS mean, round(stddev_pop(v), 5) AS std FROM (SELECT 'auroc' AS metric, auroc AS v FROM ({AUC.format(**LONG)}) UNION ALL SELECT 'average_precision', average_precision FROM ({AP.format(**LONG)}) UNION ALL SELECT 'rsquare', rsquare FROM ({R2}) UNION ALL SELECT 'accuracy', avg(CAST(label = round_even(score, 0) AS INT)) FROM long GROUP BY task UNION ALL SELECT 'pearson', corr(score, label) FROM long GROUP BY task) GROUP BY metric"))
def a6(s, d):
    return metrics.evaluate(fx.long_preds(s, d), "task", ["auroc", "average_precision", "rsquare", "accuracy", "pearson"]).select("metric", F.round("mean", 5).alias("mean"), F.round("std", 5).alias("std"))


@query("a17_standardize", with_views("preds", "SELECT doc_id, round((score - avg(score) OVER ()) / stddev_pop(score) OVER (), 5) AS score FROM preds"))
def a17(s, d):
    return metrics.standardize(fx.preds(s, d).select("doc_id", "score"), ["score"]).select("doc_id", F.round("score", 5).alias("score"))


@query("a14_size_histogram", with_views("peaks", "SELECT CAST(least(floor((end_pos - start_pos) / 60), 19) AS INT) AS bin, count(*) AS n FROM peaks WHERE end_pos - start_pos BETWEEN 0 AND 1200 GROUP BY 1"))
def a14(s, d):
    return metrics.histogram(fx.peaks(s, d).withColumn("size", F.col("end_pos") - F.col("start_pos")), "size", 20, 0, 1200)


# motifs and attribution

PPM = """w AS (SELECT CAST(seq_id % 8 AS INT) AS filter, seq FROM seq40 WHERE NOT contains(seq, 'N')),
    cnt AS (SELECT filter, count(*) AS n FROM w GROUP BY filter),
    obs AS (SELECT filter, pos, substr(seq, pos + 1, 1) AS nt, count(*) AS c FROM (SELECT filter, seq, CAST(UNNEST(range(0, 40)) AS INT) AS pos FROM w) GROUP BY 1, 2, 3),
    grid AS (SELECT filter, n, CAST(p.pos AS INT) AS pos, nt FROM cnt CROSS JOIN (SELECT UNNEST(range(0, 40)) AS pos) p CROSS JOIN (VALUES ('A'), ('C'), ('G'), ('T')) v(nt)),
    ppm AS (SELECT filter, pos, nt, coalesce(c, 0) / n AS prob FROM grid LEFT JOIN obs USING (filter, pos, nt))"""
IC = "ic AS (SELECT filter, pos, 2 + sum(prob * log2(prob + 1e-7)) AS ic FROM ppm GROUP BY filter, pos)"


def ppm(s, d):
    w = sq.drop_n(fx.seq40(s, d)).select((F.col("seq_id") % 8).cast("int").alias("filter"), F.col("seq").alias("window"))
    return motif.position_probabilities(w, "filter", "window", 40)


@query("a7_ppm", with_views("seq40", "SELECT filter, pos, nt, round(prob, 6) AS prob FROM ppm", PPM))
def a7(s, d):
    return ppm(s, d).withColumn("prob", r6("prob"))


@query("a8_information", with_views("seq40", "SELECT filter, pos, round(ic, 5) AS ic FROM ic", PPM, IC))
def a8(s, d):
    return motif.matrix_rows(ppm(s, d), "filter").select("filter", "pos", F.round(motif.information(F.col("p")), 5).alias("ic"))


@query("a9_logo", with_views("seq40", "SELECT filter, pos, nt, round(prob * ic, 5) AS height FROM ppm JOIN ic USING (filter, pos)", PPM, IC))
def a9(s, d):
    h = motif.logo_heights(motif.matrix_rows(ppm(s, d), "filter"))
    return h.select("filter", "pos", F.posexplode("height").alias("k", "height")).select("filter", "pos", F.substr(F.lit("ACGT"), F.col("k") + 1, F.lit(1)).alias("nt"), F.round("height", 5).alias("height"))


@query("k8_meme", with_views("seq40", "SELECT filter AS motif, 'MOTIF filter' || filter || chr(10) || 'letter-probability matrix: alength= 4 w= 40 nsites= 40' || chr(10) || string_agg(line, chr(10) ORDER BY pos) || chr(10) AS text FROM (SELECT filter, pos, string_agg(printf('%.4f', CAST(prob AS DOUBLE)), ' ' ORDER BY nt) AS line FROM ppm GROUP BY filter, pos) GROUP BY filter", PPM))
def k8(s, d):
    return motif.meme_text(motif.matrix_rows(ppm(s, d), "filter"), "filter")


@query("w10_trim", with_views("seq40", "SELECT filter, pos FROM ppm JOIN e USING (filter) WHERE nt = 'A' AND (a IS NULL OR pos BETWEEN a - 2 AND b + 2)", PPM, IC, "e AS (SELECT filter, min(pos) FILTER (ic > 0.12) AS a, max(pos) FILTER (ic > 0.12) AS b FROM ic GROUP BY filter)"))
def w10(s, d):
    return motif.trim(motif.matrix_rows(ppm(s, d), "filter"), "filter", 0.12, 2).select("filter", "pos")


ACTS = "f AS (SELECT vec_id, label, CAST(i - 1 AS INT) AS pos, embedding[i] AS act FROM (SELECT vec_id, label, embedding, UNNEST(range(1, 65)) AS i FROM embeddings))"


def acts(s, d):
    return fx.table(s, d, "embeddings").select("vec_id", "label", F.posexplode("embedding").alias("pos", "act"))


@query("w6_group_threshold", with_views("", "SELECT vec_id, pos FROM (SELECT *, max(act) OVER (PARTITION BY label) AS top FROM f) WHERE CAST(act AS DOUBLE) > 0.75 * CAST(top AS DOUBLE)", ACTS))
def w6(s, d):
    return motif.above_group_share(acts(s, d).withColumn("act", F.col("act").cast("double")), "label", "act", 0.75).select("vec_id", "pos")


@query("w7_window_slice", with_views("seq40", 'SELECT seq_id, "at", substr(seq, "at" - 5 + 1, 11) AS win FROM (SELECT *, CAST(seq_id * 7 % 40 AS INT) AS "at" FROM seq40) WHERE "at" - 5 > 0 AND "at" - 5 + 11 < 40'.replace('"at"', "hit")))
def w7(s, d):
    x = fx.seq40(s, d).withColumn("hit", (F.col("seq_id") * 7 % 40).cast("int"))
    return motif.windows_at(x, "seq", "hit", 11).select("seq_id", "hit", F.col("window").alias("win"))


@query("w9_top_k", with_views("maps", "SELECT map_id, round(avg(score), 6) AS top_mean FROM (SELECT *, row_number() OVER (PARTITION BY map_id ORDER BY score DESC, pos) AS r FROM maps) WHERE r <= 10 GROUP BY map_id"))
def w9(s, d):
    return motif.top_k_mean(fx.maps(s, d), ["map_id"], "score", 10, "pos").withColumn("top_mean", r6("top_mean"))


@query("m9_feature_map", with_views("seq40", "SELECT seq_id, pos, 'gc' AS filter, CAST(length(regexp_replace(substr(seq, pos + 1, 8), '[^CG]', '', 'g')) AS DOUBLE) AS act FROM (SELECT seq_id, seq, CAST(UNNEST(range(0, 33)) AS INT) AS pos FROM seq40)"))
def m9(s, d):
    k = s.createDataFrame([("gc", o, n, 1.0) for o in range(8) for n in "CG"], "filter string, offset int, nt string, weight double")
    return motif.scan(fx.seq40(s, d), k, "seq_id")


MAPLAB = "low AS (SELECT map_id, min(ic) AS low FROM maps GROUP BY map_id), lab AS (SELECT map_id, CAST(ic > 0.3 AS INT) AS label, score FROM maps JOIN low USING (map_id) WHERE ic > 0.3 OR ic = low)"
MAPS = {"k": "map_id", "t": "lab"}


@query("a10_interpretability", with_views("maps", f"SELECT a.map_id, round(a.auroc, 6) AS auroc, round(p.pr, 6) AS pr_auc FROM ({AUC.format(**MAPS)}) a JOIN (SELECT map_id, sum(pos * (tp / all_ + coalesce(q, 1)) / 2) / sum(pos) AS pr FROM (SELECT *, lag(tp / all_) OVER (PARTITION BY map_id ORDER BY score DESC) AS q FROM ({CURVE.format(**MAPS)})) GROUP BY map_id) p USING (map_id)", MAPLAB))
def a10(s, d):
    return attribution.interpretability(fx.maps(s, d), "map_id", threshold=0.3).select("map_id", r6("auroc").alias("auroc"), r6("pr_auc").alias("pr_auc"))


SN = "sn AS (SELECT map_id, avg(score) FILTER (ic > 0.3) AS signal, list_avg(max(score, 3) FILTER (score > 0 AND ic = low)) AS top3, max(score) FILTER (score > 0 AND ic = low) AS mx, avg(score) FILTER (score > 0 AND ic = low) AS mean, count(*) FILTER (score > 0 AND ic = low) AS n FROM maps JOIN (SELECT map_id, min(ic) AS low FROM maps GROUP BY map_id) USING (map_id) GROUP BY map_id)"


@query("a11_signal_noise", with_views("maps", "SELECT map_id, round(CASE WHEN n >= 3 THEN signal ELSE 0 END, 6) AS signal, round(CASE WHEN n >= 3 THEN mx ELSE 0 END, 6) AS noise_max, round(CASE WHEN n >= 3 THEN mean ELSE 0 END, 6) AS noise_mean, round(CASE WHEN n >= 3 THEN top3 ELSE 0 END, 6) AS noise_top FROM sn", SN))
def a11(s, d):
    x = attribution.signal_noise(fx.maps(s, d), "map_id", threshold=0.3, k=3)
    return x.select("map_id", *(r6(c).alias(c) for c in ("signal", "noise_max", "noise_mean", "noise_top")))


@query("a12_snr", with_views("maps", "SELECT map_id, round(CASE WHEN n >= 3 THEN signal / mean ELSE 0 END + 1e-9, 5) AS snr FROM sn", SN))
def a12(s, d):
    x = attribution.signal_noise(fx.maps(s, d), "map_id", threshold=0.3, k=3)
    return x.select("map_id", F.round(attribution.snr(F.col("signal"), F.col("noise_mean")) + 1e-9, 5).alias("snr"))


TRUTH = "truth AS (SELECT * FROM (VALUES " + ", ".join(f"('{m}', '{t}', {k})" for k, (m, ids) in enumerate(motif.MOTIF_IDS.items()) for t in ids) + ") v(motif, target_id, motif_order))"
BEST = "best AS (SELECT query_id, arg_min(motif, (q, motif_order)) AS best_motif, min(q) AS best_q FROM hits JOIN truth USING (target_id) WHERE q < 1 GROUP BY query_id), matched AS (SELECT query_id, best_motif, coalesce(best_q, 1.0) AS best_q FROM (SELECT DISTINCT query_id FROM hits) LEFT JOIN best USING (query_id))"


def matched(s, d):
    h = fx.hits(s, d)
    return motif.match_hits(h, motif.ground_truth(s), h.select("query_id").distinct())


@query("a13_motif_hits", with_views("hits", "SELECT query_id, best_motif, round(best_q, 6) AS best_q FROM matched", TRUTH, BEST))
def a13(s, d):
    return matched(s, d).select("query_id", "best_motif", r6("best_q").alias("best_q"))


@query("a13_hit_fractions", with_views("hits", "SELECT round(avg(CAST(best_q <> 1 AS INT)), 6) AS match_fraction, round((SELECT count(DISTINCT query_id) FROM hits WHERE target_id <> 'MA0615.1') / count(*), 6) AS match_any FROM matched", TRUTH, BEST))
def a13f(s, d):
    return motif.hit_fractions(fx.hits(s, d), matched(s, d)).select(r6("match_fraction").alias("match_fraction"), r6("match_any").alias("match_any"))


@query("j7_motif_lookup", with_views("hits", "SELECT motif, round(coalesce(min(best_q), 0), 6) AS min_q, count(best_q) AS n FROM (SELECT DISTINCT motif FROM truth) LEFT JOIN matched ON best_motif = motif GROUP BY motif", TRUTH, BEST))
def j7(s, d):
    return motif.motif_summary(matched(s, d), motif.ground_truth(s)).select("motif", r6("min_q").alias("min_q"), "n")


@query("a19_reductions", with_views("", "SELECT vec_id, round(sum(abs(e)), 4) AS l1, round(sqrt(sum(e * e) + 1e-10), 4) AS l2, round(sum(e * e), 4) AS ti FROM (SELECT vec_id, CAST(UNNEST(embedding) AS DOUBLE) AS e FROM embeddings) GROUP BY vec_id", "one AS (SELECT 1)"))
def a19(s, d):
    x = F.array(F.col("embedding").cast("array<double>"))
    return fx.table(s, d, "embeddings").select("vec_id", F.round(attribution.l1(x)[0], 4).alias("l1"), F.round(attribution.l2(x)[0], 4).alias("l2"), F.round(attribution.times_input(x, x)[0], 4).alias("ti"))


WEIGHTS = np.array([[(p % 5) * 0.25 + k * 0.5 for k in range(4)] for p in range(40)])


@query("a20_mutation_effect", with_views("seq40", "SELECT seq_id, pos, nt, round((strpos('ACGT', nt) - strpos('ACGT', substr(seq, pos + 1, 1))) * 0.5, 4) AS effect FROM (SELECT seq_id, seq, CAST(UNNEST(range(0, 40)) AS INT) AS pos FROM seq40 WHERE NOT contains(seq, 'N')) CROSS JOIN (VALUES ('A'), ('C'), ('G'), ('T')) v(nt)"))
def a20(s, d):
    return effects(attribution.mutagenesis(encoded(s, d), Linear(WEIGHTS), class_index=0))


def encoded(s, d):
    return sq.drop_n(fx.seq40(s, d)).withColumn("x", sq.one_hot(F.col("seq")))


def effects(x):
    """seq_id, pos, nt, effect of a map of effects."""
    rows = x.select("seq_id", F.posexplode(F.flatten("effect")).alias("at", "e"))
    return rows.select("seq_id", F.floor(F.col("at") / 4).cast("int").alias("pos"), F.substr(F.lit("ACGT"), F.col("at") % 4 + 1, F.lit(1)).alias("nt"), (F.round("e", 4) + 0.0).alias("effect"))


@query("m6_mutagenesis", with_views("seq40", "SELECT seq_id, pos, nt, round((strpos('ACGT', nt) - strpos('ACGT', substr(seq, pos + 1, 1))) * 0.5 * sqrt(5), 4) AS effect FROM (SELECT seq_id, seq, CAST(UNNEST(range(0, 40)) AS INT) AS pos FROM seq40 WHERE NOT contains(seq, 'N')) CROSS JOIN (VALUES ('A'), ('C'), ('G'), ('T')) v(nt)"))
def m6(s, d):
    """Two outputs, of which the second is twice the first: their norm is the first times the root of five."""
    return effects(attribution.mutagenesis(encoded(s, d), LinearClasses(np.stack([WEIGHTS, 2 * WEIGHTS]))))


@query("m7_explainer", with_views("seq40", "SELECT seq_id, round(2 * sum((pos % 5) * 0.25 + (strpos('ACGT', substr(seq, pos + 1, 1)) - 1) * 0.5), 4) AS total FROM (SELECT seq_id, seq, UNNEST(range(0, 40)) AS pos FROM seq40 WHERE NOT contains(seq, 'N')) GROUP BY seq_id"))
def m7(s, d):
    """The second class from a zero baseline: attributions add up to its prediction."""
    e = attribution.Explainer(LinearClasses(np.stack([WEIGHTS, 2 * WEIGHTS])), class_index=1)
    t = e.integrated_grad(encoded(s, d), baseline="zero", num_steps=4)
    return t.select("seq_id", F.round(F.aggregate(F.flatten("integrated"), F.lit(0.0), lambda a, v: a + v), 4).alias("total"))


DOT = "SELECT vec_id, sum(embedding[i] * ((i - 1) % 5 - 2) * 0.25) AS z FROM (SELECT vec_id, embedding, UNNEST(range(1, len(embedding) + 1)) AS i FROM embeddings) GROUP BY vec_id"


@query("m2_hessian", f"SELECT vec_id, round(p * (1 - p) * (1 - 2 * p) * 0.0625, 4) + 0.0 AS first, round(p * (1 - p) * (1 - 2 * p) * 0.125, 4) + 0.0 AS mixed FROM (SELECT vec_id, 1 / (1 + exp(-z)) AS p FROM ({DOT}))")
def m2(s, d):
    """Of a logistic model the second derivatives are known: two of them, for dimensions 1 and 0."""
    x = fx.table(s, d, "embeddings").select("vec_id", F.array(F.col("embedding").cast("array<double>")).alias("x"))
    h = attribution.hessian(x, Logistic(np.array([[(k % 5 - 2) * 0.25 for k in range(64)]])))
    at = lambda i, j: F.round(F.get(F.get("hessian", i), j), 4) + 0.0
    return h.select("vec_id", at(1, 1).alias("first"), at(1, 0).alias("mixed"))


@query("m12_registry", with_views("seq40", "SELECT seq_id, model, round(CASE model WHEN 'LINEAR' THEN z ELSE 1 / (1 + exp(-z / 100)) END, 5) AS pred FROM (SELECT seq_id, sum((pos % 5) * 0.25 + (strpos('ACGT', substr(seq, pos + 1, 1)) - 1) * 0.5) AS z FROM (SELECT seq_id, seq, UNNEST(range(0, 40)) AS pos FROM seq40 WHERE NOT contains(seq, 'N')) GROUP BY seq_id) CROSS JOIN (VALUES ('LINEAR'), ('Logistic')) v(model)"))
def m12(s, d):
    """Models by name, in any case."""
    x = encoded(s, d)
    one = lambda name, w: attribution.predict(x, get_model(name)(w)).select("seq_id", F.lit(name).alias("model"), F.round("pred", 5).alias("pred"))
    return one("LINEAR", WEIGHTS).unionAll(one("Logistic", WEIGHTS / 100))


@query("m4_integrated_gradients", with_views("seq40", "SELECT seq_id, round(sum((pos % 5) * 0.25 + (strpos('ACGT', substr(seq, pos + 1, 1)) - 1) * 0.5), 4) AS total FROM (SELECT seq_id, seq, UNNEST(range(0, 40)) AS pos FROM seq40 WHERE NOT contains(seq, 'N')) GROUP BY seq_id"))
def m4(s, d):
    """For a linear model the attributions of a zero baseline add up to the prediction."""
    x = sq.drop_n(fx.seq40(s, d)).withColumn("x", sq.one_hot(F.col("seq")))
    t = attribution.integrated_gradients(x, Linear(WEIGHTS), steps=4)
    return t.select("seq_id", F.round(F.aggregate(F.flatten("integrated"), F.lit(0.0), lambda a, v: a + v), 4).alias("total"))


# plans


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Target 0 against target 1 as background: a labelled, GC-matched dataset with its split."""
    of = fx.held_pieces(spark, d)
    p = fx.near_peaks(spark, d, of)
    x = pipelines.single_task(p.where("target_idx = 0"), p.where("target_idx = 1"), fx.tiles(spark, d, 512, 128, of), "peak_id", 100, 1000, width=512, reach=128)
    return pipelines.split_by_chromosome(x, ["chr2"], ["chr3", "chr4"]).select("peak_id", "chrom", "start_pos", "end_pos", "gc", "label", "split")


SINGLE = with_views("near genome", """SELECT peak_id, chrom, start_pos, end_pos, gc, label, CASE WHEN chrom IN ('chr3', 'chr4') THEN 'test' WHEN chrom = 'chr2' THEN 'valid' ELSE 'train' END AS split FROM (
    SELECT pos.*, 1 AS label FROM pos UNION ALL SELECT neg.*, 0 FROM pos p CROSS JOIN LATERAL (SELECT m FROM byg ORDER BY abs(byg.gc - p.gc), byg.gc DESC LIMIT 1) x JOIN neg ON neg.peak_id = x.m)""",
    "r AS (SELECT peak_id, chrom, target_idx, end_pos - start_pos AS n, start_pos AS s0, end_pos AS e0, strand, CAST(round_even((start_pos + end_pos) / 2, 0) AS BIGINT) - 50 AS start_pos, CAST(round_even((start_pos + end_pos) / 2, 0) AS BIGINT) + 50 AS end_pos FROM near)",
    "q AS (SELECT r.*, substr(seq, start_pos + 1, 100) AS w FROM r JOIN genome USING (chrom) WHERE start_pos >= 0 AND end_pos <= length(seq) AND NOT contains(substr(seq, start_pos + 1, 100), 'N'))",
    "g AS (SELECT *, CAST(length(regexp_replace(CASE WHEN strand = '-' THEN reverse(translate(w, 'ACGT', 'TGCA')) ELSE w END, '[^CG]', '', 'g')) AS INT) AS gc FROM q)",
    "pos AS (SELECT peak_id, chrom, start_pos, end_pos, gc FROM g WHERE target_idx = 0 AND n < 1000)",
    "neg AS (SELECT peak_id, chrom, start_pos, end_pos, gc FROM g WHERE target_idx = 1 AND NOT EXISTS (SELECT 1 FROM near b WHERE b.target_idx = 0 AND b.chrom = g.chrom AND b.start_pos < g.e0 AND g.s0 < b.end_pos))",
    "byg AS (SELECT gc, min(peak_id) AS m FROM neg GROUP BY gc)")
query("single_task_dataset", SINGLE)(flagship)
