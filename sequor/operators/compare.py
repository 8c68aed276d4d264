"""Comparison of motif matrices: the best alignment of each query with each target, and how likely chance does as well.

Two columns are compared by the correlation of their four probabilities; an alignment's score is the sum over its
columns, over all offsets and both strands. The distribution of a query column's scores against the columns of all targets is
counted over the cluster; that of a sum of columns is the convolution of theirs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sequor.session import shared_folder

#: Steps into which a column's correlation, from -1 to 1, is cut for p-values.
STEPS = 100
#: Columns of all queries together, at most: queries are sent with the code, targets are rows.
QUERY_COLUMNS = 100_000


def _standard(p: np.ndarray) -> np.ndarray:
    """Columns (n, 4) with mean 0 and length 1, so that products are correlations; constant columns are 0."""
    c = p - p.mean(1, keepdims=True)
    size = np.sqrt((c * c).sum(1, keepdims=True))
    return np.where(size > 1e-12, c / np.maximum(size, 1e-12), 0.0)


def _step(r: np.ndarray) -> np.ndarray:
    """The step of a correlation; rounded first, so that exact values on a border fall on one side."""
    return np.clip(np.floor(np.round((r + 1) * (STEPS / 2), 6)), 0, STEPS - 1).astype(np.int64)


def matrices(rows: DataFrame, by: str) -> DataFrame:
    """rows(by, pos, p) -> motif, p: each motif's columns along pos. A motif is short; its columns are one row."""
    g = rows.groupBy(F.col(by).alias("motif")).agg(F.array_sort(F.collect_list(F.struct("pos", F.transform("p", lambda x: x.cast("double")).alias("p")))).alias("_c"))
    return g.select("motif", F.transform("_c", lambda c: c["p"]).alias("p"))


def tails(counts: np.ndarray, width: int) -> dict[tuple[int, int], np.ndarray]:
    """P(sum of steps >= s) for each run of columns [a, b) of one query; counts is (width, STEPS), rows that count nothing are uniform."""
    n = counts.sum(1, keepdims=True)
    share = np.where(n > 0, counts / np.maximum(n, 1), 1 / STEPS)
    out = {}
    for a in range(width):
        d = np.ones(1)
        for b in range(a, width):
            d = np.convolve(d, share[b])
            out[a, b + 1] = np.cumsum(d[::-1])[::-1]
    return out


def compare_motifs(queries: DataFrame, targets: DataFrame, by: str = "motif", least: int = 4) -> DataFrame:
    """query, target, offset, strand, overlap, score, p_value, p_best: the best alignment of every query with every target.

    queries and targets(by, pos, p): p holds the probabilities of A, C, G, T. The alignment with the largest score over at least `least` columns
    (or the shorter motif's width) wins; then that with the smallest offset, and strand + before -. offset is where the target
    begins in the query; on strand - the target is reverse-complemented. p_value is the chance that so many random columns of the targets do as
    well, p_best that any of the alignments tried does (they count as independent). Targets are rows in any number; the
    queries have QUERY_COLUMNS columns at most and are sent to every task. Empty tables give an empty result.
    """
    spark = queries.sparkSession
    held = matrices(queries, by).orderBy("motif").limit(QUERY_COLUMNS + 1).collect()
    names = [r["motif"] for r in held]
    query = [_standard(np.array(r["p"], float)) for r in held]
    widths = [len(q) for q in query]
    if sum(widths) > QUERY_COLUMNS:
        raise ValueError(f"the queries have over {QUERY_COLUMNS} columns; compare them in parts")
    kinds = queries.schema[by].dataType.simpleString(), targets.schema[by].dataType.simpleString()
    schema = f"query {kinds[0]}, target {kinds[1]}, offset int, strand string, overlap int, score double, p_value double, p_best double"
    if not held:
        return spark.createDataFrame([], schema)
    every = np.concatenate(query)
    starts = np.concatenate([[0], np.cumsum(widths)])
    shared_folder(spark)
    rows = matrices(targets, by).checkpoint()  # counted and aligned

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(every), STEPS), np.int64)
        for b in batches:
            for p in b.column("p").to_pylist():
                for t in (np.array(p, float), np.array(p, float)[::-1, ::-1]):
                    step = _step(every @ _standard(t).T)
                    np.add.at(total, (np.arange(len(every))[:, None], step), 1)
        at = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at[0]), pa.array(at[1]), pa.array(total[at])], ["column", "step", "n"])

    counts = np.zeros((len(every), STEPS))
    for r in rows.mapInArrow(count, "column long, step long, n long").groupBy("column", "step").agg(F.sum("n").alias("n")).toLocalIterator():
        counts[r["column"], r["step"]] = r["n"]
    name_type = pa.array(names).type

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chance = [tails(counts[a : a + w], w) for a, w in zip(starts[:-1], widths, strict=True)]
        for b in batches:
            out: list[list] = [[] for _ in range(7)]
            n = []
            for p in b.column("p").to_pylist():
                t = np.array(p, float)
                both = [every @ _standard(x).T for x in (t, t[::-1, ::-1])]
                for k, w in enumerate(widths):
                    found = best_alignment([c[starts[k] : starts[k] + w] for c in both], chance[k], least)
                    for column, v in zip(out, (names[k], *found), strict=True):
                        column.append(v)
                n.append(len(widths))
            target = b.column("motif").take(pa.array(np.repeat(np.arange(b.num_rows), n)))
            types = (name_type, pa.int32(), pa.string(), pa.int32(), pa.float64(), pa.float64(), pa.float64())
            q, *rest = (pa.array(c, t) for c, t in zip(out, types, strict=True))
            yield pa.RecordBatch.from_arrays([q, target, *rest], ["query", "target", "offset", "strand", "overlap", "score", "p_value", "p_best"])

    return rows.mapInArrow(align, schema)


def best_alignment(both: list[np.ndarray], chance: dict[tuple[int, int], np.ndarray], least: int) -> tuple[int, str, int, float, float, float]:
    """offset, strand, overlap, score, p_value and p_best from the correlations (query columns, target columns) of the two strands."""
    w, m = both[0].shape
    need = min(least, w, m)
    best, none = None, 1.0
    for o in range(need - m, w - need + 1):
        a, b = max(0, o), min(w, o + m)
        for strand, c in zip("+-", both, strict=True):
            r = np.diagonal(c, -o)
            score = float(r.sum())
            p = float(chance[a, b][_step(r).sum()])
            none *= 1 - min(1.0, p)
            if best is None or score > best[3] + 1e-9:
                best = (o, strand, b - a, score, p)
    return *best, 1 - none
