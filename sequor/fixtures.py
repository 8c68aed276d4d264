"""Interval, sequence and score tables derived from the driver's tables, for the registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sequor.operators.genome import tile_pieces
from sequor.session import shared_folder


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def peaks(spark: SparkSession, d: str) -> DataFrame:
    """peak_id, chrom, start_pos, end_pos, strand, target_idx from lineitem."""
    start = "l_partkey * 97 + (l_orderkey * 131) % 50000"
    return table(spark, d, "lineitem").selectExpr(
        "md5(concat_ws('-', l_orderkey, cast(l_linenumber as bigint), l_partkey, l_suppkey, cast(l_quantity as bigint), cast(round(l_extendedprice * 100) as bigint))) as peak_id",
        "concat('chr', l_suppkey % 22 + 1) as chrom",
        f"{start} as start_pos",
        f"{start} + cast(l_quantity * 23 as bigint) as end_pos",
        "case l_returnflag when 'R' then '-' when 'A' then '.' else '+' end as strand",
        "cast(l_linenumber - 1 as int) as target_idx",
    )


#: Numbers for the windows of a document; its letters are fewer than 40 times as many.
WINDOWS = 1_000_000


def letters(docs: DataFrame, *more: str) -> DataFrame:
    """seq_id, seq: the letters A C G T of the texts, Z as N."""
    return docs.select(F.col("doc_id").alias("seq_id"), F.translate(F.regexp_replace(F.upper("text"), "[^ACGTZ]+", ""), "Z", "N").alias("seq"), *more)


def seqs(spark: SparkSession, d: str) -> DataFrame:
    return letters(table(spark, d, "documents"))


def seq40(spark: SparkSession, d: str, *more: str) -> DataFrame:
    """seq_id, seq: all letters of the sequences as consecutive windows of 40, the last one filled up with A.

    seq_id: the document's times WINDOWS, and the window's number. more: further columns of documents.
    """
    docs = letters(table(spark, d, "documents"), *more)
    # Cut in one pass: a substring would be looked for from the beginning of its text.
    x = docs.select("seq_id", F.posexplode(F.regexp_extract_all("seq", F.lit(".{1,40}"), F.lit(0))).alias("k", "part"), *more)
    return x.select((F.col("seq_id") * WINDOWS + F.col("k")).alias("seq_id"), F.rpad("part", 40, "A").alias("seq"), *more)


def chrom_of(seq_id: F.Column) -> F.Column:
    return F.concat(F.lit("chr"), (seq_id % 22 + 1).cast("string"))


def pieces(spark: SparkSession, d: str) -> DataFrame:
    """chrom, seq_id, seq: the sequences that a derived chromosome is made of, along seq_id."""
    return seqs(spark, d).select(chrom_of(F.col("seq_id")).alias("chrom"), "seq_id", "seq")


def held_pieces(spark: SparkSession, d: str) -> DataFrame:
    """pieces, checkpointed: ranges are found and dealt in two passes, each of which would take the letters out of the texts anew."""
    shared_folder(spark)
    return pieces(spark, d).checkpoint()


def tiles(spark: SparkSession, d: str, width: int, reach: int = 0, of: DataFrame | None = None) -> DataFrame:
    """of: the pieces, if they are held."""
    return tile_pieces(held_pieces(spark, d) if of is None else of, "seq_id", width, reach)


def near_peaks(spark: SparkSession, d: str, of: DataFrame | None = None) -> DataFrame:
    """Peaks folded into the derived genome, each by its chromosome's length; some reach over the end. of: the pieces, if they are held."""
    sizes = (pieces(spark, d) if of is None else of).groupBy("chrom").agg(F.sum(F.length("seq")).alias("_len")).where("_len > 0")  # 22 rows
    p = peaks(spark, d).join(F.broadcast(sizes), "chrom").withColumns({"_n": F.col("end_pos") - F.col("start_pos"), "start_pos": F.col("start_pos") % F.col("_len")})
    return p.withColumn("end_pos", F.col("start_pos") + F.col("_n")).select("peak_id", "chrom", "start_pos", "end_pos", "strand", "target_idx")


def preds(spark: SparkSession, d: str) -> DataFrame:
    """doc_id, quality, toxic, score."""
    return table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "n_chars"), "doc_id").select("doc_id", "quality", "toxic", ((F.col("n_chars") % 1000) / 1000).alias("score"))


def long_preds(spark: SparkSession, d: str) -> DataFrame:
    """task, label, score."""
    return preds(spark, d).select("score", F.explode(F.array(F.struct(F.lit("quality").alias("task"), F.col("quality").alias("label")), F.struct(F.lit("toxic").alias("task"), F.col("toxic").alias("label")))).alias("x")).select("x.task", "x.label", "score")


def maps(spark: SparkSession, d: str) -> DataFrame:
    """map_id, pos, ic, score: an attribution map of each order; pos only tells rows apart."""
    return table(spark, d, "lineitem").selectExpr(
        "l_orderkey % 500 as map_id",
        "l_orderkey * 1000 + l_linenumber * 100 + l_suppkey % 100 as pos",
        "cast(cast(l_quantity as bigint) % 5 as double) / 4 as ic",
        "cast(l_partkey % 97 as double) / 97 as score",
    )


def metadata(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").selectExpr(
        "p_brand as experiment", "case when p_partkey % 3 = 0 then 'GRCh38' else 'hg19' end as assembly", "case when p_partkey % 5 < 4 then 'bed narrowPeak' else 'fastq' end as file_type",
        "concat('FILE', p_partkey) as file", "case when p_size % 2 = 0 then 'IDR thresholded peaks' else 'signal' end as output_type", "case when p_size % 4 < 3 then '1, 2' else '1' end as replicates",
        "concat(p_type, '-human') as target", "p_name as biosample", "case when p_partkey % 7 = 0 then null else p_type end as lab", "concat('https://files.example.org/', p_partkey, '.bed.gz') as url", "p_partkey as row_no",
    )


def hits(spark: SparkSession, d: str) -> DataFrame:
    """query_id, target_id, q: motif hits from orders."""
    return table(spark, d, "orders").selectExpr("concat('filter', o_orderkey % 40) as query_id", "concat('MA00', lpad(cast(50 + o_custkey % 50 as string), 2, '0'), '.', o_orderkey % 3 + 1) as target_id", "cast(o_orderkey % 1009 as double) / 1009 as q")


#: The same tables as SQL.
SQL = {
    "peaks": """peaks AS (SELECT md5(concat_ws('-', l_orderkey, CAST(l_linenumber AS BIGINT), l_partkey, l_suppkey, CAST(l_quantity AS BIGINT), CAST(round(l_extendedprice * 100) AS BIGINT))) AS peak_id,
        'chr' || (l_suppkey % 22 + 1) AS chrom, l_partkey * 97 + (l_orderkey * 131) % 50000 AS start_pos,
        l_partkey * 97 + (l_orderkey * 131) % 50000 + CAST(l_quantity * 23 AS BIGINT) AS end_pos,
        CASE l_returnflag WHEN 'R' THEN '-' WHEN 'A' THEN '.' ELSE '+' END AS strand, CAST(l_linenumber - 1 AS INT) AS target_idx FROM lineitem)""",
    "seqs": "seqs AS (SELECT doc_id AS seq_id, replace(regexp_replace(upper(text), '[^ACGTZ]', '', 'g'), 'Z', 'N') AS seq FROM documents)",
    "seq40": f"seq40 AS (SELECT seq_id * {WINDOWS} + k AS seq_id, rpad(substr(seq, CAST(k * 40 + 1 AS BIGINT), 40), 40, 'A') AS seq FROM (SELECT seq_id, seq, UNNEST(range(0, (length(seq) + 39) // 40)) AS k FROM seqs))",
    "genome": "genome AS (SELECT 'chr' || (seq_id % 22 + 1) AS chrom, string_agg(seq, '' ORDER BY seq_id) AS seq FROM seqs GROUP BY 1)",
    "near": "near AS (SELECT peak_id, chrom, start_pos % length(seq) AS start_pos, start_pos % length(seq) + end_pos - start_pos AS end_pos, strand, target_idx FROM peaks JOIN genome USING (chrom) WHERE length(seq) > 0)",
    "preds": "preds AS (SELECT doc_id, quality, toxic, (n_chars % 1000) / 1000 AS score FROM labels JOIN documents USING (doc_id))",
    "long": "long AS (SELECT 'quality' AS task, quality AS label, score FROM preds UNION ALL SELECT 'toxic', toxic, score FROM preds)",
    "maps": "maps AS (SELECT l_orderkey % 500 AS map_id, l_orderkey * 1000 + l_linenumber * 100 + l_suppkey % 100 AS pos, CAST(CAST(l_quantity AS BIGINT) % 5 AS DOUBLE) / 4 AS ic, CAST(l_partkey % 97 AS DOUBLE) / 97 AS score FROM lineitem)",
    "metadata": """metadata AS (SELECT p_brand AS experiment, CASE WHEN p_partkey % 3 = 0 THEN 'GRCh38' ELSE 'hg19' END AS assembly, CASE WHEN p_partkey % 5 < 4 THEN 'bed narrowPeak' ELSE 'fastq' END AS file_type,
        'FILE' || p_partkey AS file, CASE WHEN p_size % 2 = 0 THEN 'IDR thresholded peaks' ELSE 'signal' END AS output_type, CASE WHEN p_size % 4 < 3 THEN '1, 2' ELSE '1' END AS replicates,
        p_type || '-human' AS target, p_name AS biosample, CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE p_type END AS lab, 'https://files.example.org/' || p_partkey || '.bed.gz' AS url, p_partkey AS row_no FROM part)""",
    "hits": "hits AS (SELECT 'filter' || (o_orderkey % 40) AS query_id, 'MA00' || lpad(CAST(50 + o_custkey % 50 AS VARCHAR), 2, '0') || '.' || (o_orderkey % 3 + 1) AS target_id, CAST(o_orderkey % 1009 AS DOUBLE) / 1009 AS q FROM orders)",
}
NEEDS = {"seq40": ["seqs"], "genome": ["seqs"], "near": ["peaks", "seqs", "genome"], "long": ["preds"]}


def with_views(names: str, body: str, *more: str) -> str:
    """WITH the named views, then further ones, then the body."""
    todo: list[str] = []
    for n in names.split():
        for x in [*NEEDS.get(n, []), n]:
            if x not in todo:
                todo.append(x)
    return "WITH " + ",\n".join([*(SQL[x] for x in todo), *more]) + "\n" + body
