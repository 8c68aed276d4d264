"""Embedding near-dedup: PCA-ordered tiles with residuals bounded by suffix norms."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sequor.llm.common import blocked, connected_components, cut, prepare, unite, whole_groups

#: Rows of a cell that one task compares; larger cells are split into blocks.
BLOCK = 4096
TILE = 256
#: Leading PCA dimensions that make the cells, and the width of a cell in distances that links can span.
GRID, CELL = 3, 3
#: Slack for rounding in bounds; the decision itself is made on the given components.
SLACK = 1e-9


def classes_of(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """label, embedding, rep (smallest id), copies of each distinct vector that can link."""
    v = F.col(vector_col).cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(math.inf)))
    ok = F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & finite & F.exists(v, lambda x: x != 0)
    return vectors.where(ok).groupBy(F.col(label_col).alias("label"), F.col(vector_col).alias("embedding")).agg(F.min(id_col).alias("rep"), F.count(F.lit(1)).alias("copies"))


def principal_axes(classes: DataFrame, dim: int) -> np.ndarray:
    """Columns: axes of the unit vectors by falling variance about zero. The driver gets dim * dim sums."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dim, dim))
        for b in batches:
            x = unit(matrix(b.column(0), dim))
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim * dim), pa.int32()), pa.array(total.ravel())], names=["k", "v"])

    rows = classes.where(F.size("embedding") == dim).select("embedding").mapInArrow(sums, "k int, v double").groupBy("k").agg(F.sum("v").alias("v")).collect()
    c = np.zeros(dim * dim)
    for r in rows:
        c[r["k"]] = r["v"]
    return np.linalg.eigh(c.reshape(dim, dim))[1][:, ::-1].copy()


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def unit(x: np.ndarray) -> np.ndarray:
    top = np.abs(x).max(1, keepdims=True)
    x = x / top
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def near_pairs(a: np.ndarray, b: np.ndarray, least: float, steps: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Row pairs of two tiles (PCA coordinates of unit vectors) whose cosine may reach `least`.

    Leading dimensions are accumulated first. What the rest can add is at most the product of the
    suffix norms; a row whose pairs all fall short is dropped before the next step.
    """
    i, j = np.arange(len(a)), np.arange(len(b))
    part = np.zeros((len(a), len(b)))
    low = 0
    for high in steps:
        part += a[i, low:high] @ b[j, low:high].T
        rest = np.sqrt((a[i, high:] ** 2).sum(1))[:, None] * np.sqrt((b[j, high:] ** 2).sum(1))[None]
        may = part + rest >= least - SLACK
        rows, cols = may.any(1), may.any(0)
        if not rows.any():
            return np.zeros(0, int), np.zeros(0, int)
        if rows.sum() * cols.sum() < 0.5 * may.size:
            i, j, part, may = i[rows], j[cols], part[np.ix_(rows, cols)], may[np.ix_(rows, cols)]
        low = high
    r, c = np.nonzero(may)
    return i[r], j[c]


def links(classes: DataFrame, dim: int, threshold: float) -> DataFrame:
    """(rep, other, n): n > 0 counts linked vectors of rep; rows with other form a spanning forest.

    Unit vectors with cosine >= t are at most sqrt(2 - 2 t) apart in every orthogonal direction, so linked
    vectors lie in the same or neighbouring cells over the leading PCA dimensions. A vector
    goes to its own cell and as a guest to those neighbours that follow it and are within that distance.
    """
    axes = principal_axes(classes, dim)
    width = math.sqrt(max(0.0, 2 - 2 * threshold)) * (1 + 1e-6) + 1e-9
    grid = min(GRID, dim)
    around = [()]
    for _ in range(grid):
        around = [(*p, s) for p in around for s in (-1, 0, 1)]
    around = [p for p in around if p >= (0,) * grid]
    cell_width = max(CELL * width, 1 / 1024)
    kind = classes.schema["embedding"].dataType.simpleString()
    kind = kind if kind in ("array<float>", "array<double>") else "array<double>"
    fields = f"label string, cell long, home boolean, rep long, copies long, embedding {kind}"

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = unit(matrix(b.column(3), dim)) @ axes[:, :grid]
            at = np.floor(x / cell_width).astype(np.int64)
            low, high = x - at * cell_width, (at + 1) * cell_width - x
            for p in around:
                ok = np.ones(len(x), bool)
                for k, s in enumerate(p):
                    gap = low[:, k] if s < 0 else high[:, k] if s > 0 else np.zeros(len(x))
                    ok &= gap <= width
                cell = np.zeros(len(x), np.int64)
                for k in range(grid):
                    cell = cell * 4096 + at[:, k] + p[k] + 2048
                take = pa.array(np.flatnonzero(ok))
                home = not any(p)
                yield pa.RecordBatch.from_arrays([b.column(0).take(take), pa.array(cell[ok]), pa.array(np.full(ok.sum(), home)), b.column(1).take(take), b.column(2).take(take), b.column(3).take(take)], names=["label", "cell", "home", "rep", "copies", "embedding"])

    d = classes.where(F.size("embedding") == dim).select(F.col("label").cast("string").alias("label"), F.col("rep").cast("long").alias("rep"), "copies", F.col("embedding").cast(kind).alias("embedding")).mapInArrow(spread, fields)
    d = blocked(cut(d), ["label", "cell"], F.col("rep"), BLOCK)
    keys = ["label", "cell", "_i", "_j"]
    d = d.repartition(*keys).sortWithinPartitions(*keys)
    steps = sorted({min(dim, s) for s in (4, 8, 16, 32, dim)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, keys):
            t = t.combine_chunks()
            change = np.zeros(t.num_rows, bool)
            for k in keys:
                v = t.column(k).to_numpy()
                change[1:] |= v[1:] != v[:-1]
            edges = np.flatnonzero(np.r_[True, change[1:], True])
            for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                yield from compare(t.slice(lo, hi - lo))

    def compare(t: pa.Table) -> Iterator[pa.RecordBatch]:
        home, rep, copies, own, ib, jb = (t.column(c).to_numpy() for c in ("home", "rep", "copies", "_own", "_i", "_j"))
        if len(rep) < 2 or not home.any():
            return
        raw = matrix(t.column("embedding").combine_chunks(), dim)
        x = unit(raw) @ axes
        raw = np.ldexp(raw, -np.frexp(np.abs(raw).max(1, keepdims=True))[1])  # by a power of two: squares stay in range, no digit changes
        norm = np.sqrt((raw * raw).sum(1))
        order = np.argsort(x[:, 0], kind="stable")
        count = np.zeros(len(rep), np.int64)
        label = np.arange(len(rep))
        split = ib[0] != jb[0]
        tiles = [order[k : k + TILE] for k in range(0, len(order), TILE)]
        for p, a in enumerate(tiles):
            for b in tiles[p:]:
                if x[b[0], 0] - x[a[-1], 0] > width:
                    break
                i, j = near_pairs(x[a], x[b], threshold, steps)
                i, j = a[i], b[j]
                ok = home[i] | home[j]
                if b is a:
                    ok &= i < j
                if split:
                    ok &= own[i] != own[j]
                i, j = i[ok], j[ok]
                for s in range(0, len(i), 1 << 16):
                    u, v = i[s : s + (1 << 16)], j[s : s + (1 << 16)]
                    near = np.einsum("ij,ij->i", raw[u], raw[v]) / (norm[u] * norm[v]) >= threshold
                    u, v = u[near], v[near]
                    np.add.at(count, u, copies[v])
                    np.add.at(count, v, copies[u])
                    unite(label, u, v)
        hit = np.flatnonzero(count)
        if len(hit):
            root = rep[label[hit]]
            yield pa.RecordBatch.from_arrays([pa.array(rep[hit]), pa.array(root), pa.array(count[hit])], names=["rep", "other", "n"])

    return d.select(*keys, "_own", "home", "rep", "copies", "embedding").mapInArrow(run, "rep long, other long, n long")


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = 0.98) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row.

    Vectors link if their labels are equal and not null and their cosine in double precision reaches the
    threshold. A vector that is null, zero, or holds a null or non-finite component, and one
    with a null id, links with nothing. Vectors of different lengths don't link. Equal vectors of a label
    are one class; their links are counted, never listed. An empty table gives an empty result.
    """
    prepare(vectors.sparkSession)
    classes = cut(classes_of(vectors, id_col, vector_col, label_col))
    dims = [r[0] for r in classes.select(F.size("embedding")).distinct().collect()]
    out = None
    for dim in dims:
        found = links(classes, dim, threshold)
        out = found if out is None else out.unionAll(found)
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("embedding"), F.col(label_col).alias("label"))
    if out is None:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").cast("long").alias("component_id"), F.lit(True).alias("kept"))
    out = cut(out)
    total = out.groupBy("rep").agg(F.sum("n").alias("n"))
    roots = connected_components(out, "rep", "other").withColumnRenamed("node", "rep")
    table = classes.join(total, "rep", "left").join(roots, "rep", "left").select("label", "embedding", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "rep").alias("component_id"))
    d = rows.join(table, ["label", "embedding"], "left")
    d = d.withColumn("component_id", F.when(F.col("vec_id").isNotNull(), F.coalesce("component_id", F.col("vec_id"))).cast("long"))
    n = F.when(F.col("vec_id").isNotNull(), F.coalesce("n_links", F.lit(0))).otherwise(F.lit(0)).cast("long")
    return d.select("vec_id", n.alias("n_links"), "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
