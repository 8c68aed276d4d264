"""Motif matrices: activations to aligned windows, probabilities, information and hits."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Names and public matrix identifiers of the ground-truth motifs.
MOTIF_IDS = {
    "Arid3": ["MA0151.1", "MA0601.1", "PB0001.1"],
    "CEBPB": ["MA0466.1", "MA0466.2"],
    "FOSL1": ["MA0477.1"],
    "GABPA": ["MA0062.1", "MA0062.2"],
    "MAFK": ["MA0496.1", "MA0496.2"],
    "MAX": ["MA0058.1", "MA0058.2", "MA0058.3"],
    "MEF2A": ["MA0052.1", "MA0052.2", "MA0052.3"],
    "NFYB": ["MA0502.1", "MA0060.1", "MA0060.2"],
    "SP1": ["MA0079.1", "MA0079.2", "MA0079.3"],
    "SRF": ["MA0083.1", "MA0083.2", "MA0083.3"],
    "STAT1": ["MA0137.1", "MA0137.2", "MA0137.3", "MA0660.1", "MA0773.1"],
    "YY1": ["MA0095.1", "MA0095.2"],
}


#: Values that a scan holds at once, about.
SCANNED = 1 << 20


def above_group_share(df: DataFrame, by: str, value: str, share: float) -> DataFrame:
    """Rows with value > share * (the group's maximum)."""
    top = df.groupBy(by).agg(F.max(value).alias("_top"))
    return df.join(top, by).where(F.col(value) > share * F.col("_top")).drop("_top")


def windows_at(df: DataFrame, seq: str, pos: str, width: int) -> DataFrame:
    """Add window: `width` letters about pos; windows that touch an end of the sequence are left out."""
    start = F.col(pos) - width // 2
    ok = (start > 0) & (start + width < F.length(seq))
    return df.where(ok).withColumn("window", F.substr(seq, start + 1, F.lit(width)))


def position_probabilities(df: DataFrame, by: str, window: str, width: int, least: int = 2, alphabet: str = "ACGT") -> DataFrame:
    """by, pos, nt, prob: letter shares at each place; uniform if the group has under `least` windows."""
    # The windows are read once: an empty letter in front of each counts them.
    nts = F.coalesce(F.filter(F.split(window, ""), lambda c: c != ""), F.array().cast("array<string>"))
    seen = df.select(by, F.posexplode(F.concat(F.array(F.lit("")), nts)).alias("pos", "nt")).groupBy(by, "pos", "nt").agg(F.count(F.lit(1)).alias("_c"))
    g = seen.where((F.col("pos") <= width) & F.col("nt").isin("", *alphabet)).groupBy(by)
    g = g.agg(F.max(F.when(F.col("pos") == 0, F.col("_c"))).alias("_n"), F.map_from_entries(F.collect_list(F.struct(F.concat(F.col("pos") - 1, "nt"), "_c"))).alias("_seen"))
    d = g.withColumn("pos", F.explode(F.sequence(F.lit(0), F.lit(width - 1)))).withColumn("nt", F.explode(F.array(*map(F.lit, alphabet))))
    share = F.coalesce(F.try_element_at("_seen", F.concat("pos", "nt")), F.lit(0)) / F.col("_n")
    return d.select(by, "pos", "nt", F.when(F.col("_n") < least, F.lit(1 / len(alphabet))).otherwise(share).alias("prob"))


def information(p: Column, eps: float = 1e-7) -> Column:
    """Bits of an array of four probabilities."""
    return F.lit(2.0) + F.aggregate(p, F.lit(0.0), lambda a, x: a + x * F.log2(x + eps))


def matrix_rows(ppm: DataFrame, by: str, alphabet: str = "ACGT") -> DataFrame:
    """by, pos, p: the four probabilities in the alphabet's order."""
    return ppm.groupBy(by, "pos").agg(F.array(*(F.max(F.when(F.col("nt") == c, F.col("prob"))) for c in alphabet)).alias("p"))


def logo_heights(rows: DataFrame, eps: float = 1e-7) -> DataFrame:
    return rows.withColumn("height", F.transform("p", lambda x: x * information(F.col("p"), eps)))


def trim(rows: DataFrame, by: str, threshold: float = 0.5, pad: int = 3, eps: float = 1e-7) -> DataFrame:
    """Rows from `pad` before the first place with more than `threshold` bits to `pad` after the last; all if none."""
    ic = F.when(information(F.col("p"), eps) > threshold, F.col("pos"))
    ends = rows.groupBy(by).agg(F.min(ic).alias("_a"), F.max(ic).alias("_b"))
    return rows.join(ends, by).where(F.col("_a").isNull() | F.col("pos").between(F.col("_a") - pad, F.col("_b") + pad)).drop("_a", "_b")


def meme_text(rows: DataFrame, by: str) -> DataFrame:
    """motif, text: each motif's block of a MEME file, four decimals, nsites as wide as the matrix."""
    line = F.format_string("%.4f %.4f %.4f %.4f", *(F.bround(F.get("p", k), 4) for k in range(4)))
    g = rows.groupBy(F.col(by).alias("motif")).agg(F.array_sort(F.collect_list(F.struct("pos", line.alias("line")))).alias("_l"))
    head = F.format_string("MOTIF filter%s\nletter-probability matrix: alength= 4 w= %d nsites= %d\n", F.col("motif").cast("string"), F.size("_l"), F.size("_l"))
    return g.select("motif", F.concat(head, F.array_join(F.transform("_l", lambda s: s["line"]), "\n"), F.lit("\n")).alias("text"))


MEME_HEADER = "MEME version 4\n\nALPHABET= ACGT\n\nBackground letter frequencies:\nA 0.25 C 0.25 G 0.25 T 0.25\n\n"


def match_hits(hits: DataFrame, truth: DataFrame, filters: DataFrame) -> DataFrame:
    """filter, best_motif, best_q: each filter's smallest q over true motifs; null and 1.0 without one.

    hits(query_id, target_id, q); truth(motif, target_id, motif_order), a short list; filters(query_id).
    """
    found = hits.join(F.broadcast(truth), "target_id").where("q < 1.0")
    best = found.groupBy("query_id").agg(F.min(F.struct("q", "motif_order", "motif")).alias("b"))
    return filters.join(best, "query_id", "left").select("query_id", F.col("b.motif").alias("best_motif"), F.coalesce("b.q", F.lit(1.0)).alias("best_q"))


def hit_fractions(hits: DataFrame, matched: DataFrame, empty: str = "MA0615.1") -> DataFrame:
    """match_fraction: filters with a true motif; match_any: filters with a hit other than only `empty`; of all filters."""
    some = hits.where(F.col("target_id") != empty).select("query_id").distinct().agg(F.count(F.lit(1)).alias("_any"))
    share = matched.agg(F.count(F.lit(1)).alias("_n"), F.sum((F.col("best_q") != 1).cast("long")).alias("_m"))
    return share.crossJoin(some).select((F.col("_m") / F.col("_n")).alias("match_fraction"), (F.col("_any") / F.col("_n")).alias("match_any"))


def motif_summary(matched: DataFrame, truth: DataFrame) -> DataFrame:
    """motif, min_q, n: over the filters whose best motif it is; 0 and 0 without one."""
    g = matched.where("best_motif is not null").groupBy(F.col("best_motif").alias("motif")).agg(F.min("best_q").alias("q"), F.count(F.lit(1)).alias("c"))
    return truth.select("motif").distinct().join(g, "motif", "left").select("motif", F.coalesce("q", F.lit(0.0)).alias("min_q"), F.coalesce("c", F.lit(0)).alias("n"))


def ground_truth(spark) -> DataFrame:
    return spark.createDataFrame([(m, t, k) for k, (m, ids) in enumerate(MOTIF_IDS.items()) for t in ids], "motif string, target_id string, motif_order int")


def scan(df: DataFrame, kernels: DataFrame, id_col: str, seq: str = "seq", width: int = 8) -> DataFrame:
    """id, pos, filter, act: each kernel's sum over every place. kernels(filter, offset, nt, weight) is small.

    The driver holds the kernels. Sequences of one length are a matrix of letters, of which a batch takes SCANNED values at once.
    """
    k = kernels.select("filter", "offset", "nt", F.col("weight").cast("double").alias("weight")).toArrow()
    filters, of = np.unique(k.column("filter").to_pandas(), return_inverse=True) if k.num_rows else ([], [])
    names = pa.array(filters, k.schema.field("filter").type)
    held: dict[int, dict[tuple[int, str], float]] = {f: {} for f in range(len(names))}
    for f, o, nt, w in zip(of, *(k.column(c).to_pylist() for c in ("offset", "nt", "weight")), strict=True):
        if (o, nt) in held[int(f)]:
            raise ValueError(f"two weights of filter {filters[f]} at {o} for {nt}")
        held[int(f)][o, nt] = w or 0.0
    letters = sorted({nt for ws in held.values() for _, nt in ws if nt and len(nt) == 1})
    codes = np.array([ord(c) for c in letters], np.uint32)
    table = np.zeros((len(names), width, len(letters) + 1))  # the last letter is any other
    for f, ws in held.items():
        for (o, nt), w in ws.items():
            if nt in letters and 0 <= o < width:
                table[f, o, letters.index(nt)] = w
    d = df.where(F.length(seq) >= width).select(id_col, F.col(seq).alias("_s"))
    schema = f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, pos int, filter {kernels.schema['filter'].dataType.simpleString()}, act double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lengths = pc.utf8_length(b.column("_s")).to_numpy(zero_copy_only=False)
            for n in np.unique(lengths) if len(names) else ():
                places = int(n) - width + 1
                same, many = np.flatnonzero(lengths == n), max(1, SCANNED // (places * len(names)))
                for lo in range(0, len(same), many):
                    g = b.take(pa.array(same[lo : lo + many]))
                    x = np.frombuffer("".join(g.column("_s").to_pylist()).encode("utf-32-le"), np.uint32).reshape(-1, int(n))
                    at = np.full(x.shape, len(letters), np.intp)
                    for c, code in enumerate(codes):
                        at[x == code] = c
                    act = np.zeros((len(x), places, len(names)))
                    for f in range(len(names)):
                        for o in range(width):
                            act[:, :, f] += table[f, o][at[:, o : o + places]]
                    row, pos, f = (v.ravel() for v in np.indices(act.shape, np.int32))
                    yield pa.RecordBatch.from_arrays([g.column(id_col).take(pa.array(row)), pa.array(pos), names.take(pa.array(f)), pa.array(act.ravel())], [id_col, "pos", "filter", "act"])

    return d.mapInArrow(run, schema)


def top_k_mean(df: DataFrame, by: list[str], value: str, k: int, tie: str) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(F.desc(value), tie)
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).groupBy(*by).agg(F.avg(value).alias("top_mean"))
