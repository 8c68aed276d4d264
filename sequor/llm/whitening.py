"""Embedding whitening: exact sums and centred scatter over the cluster, eigenvectors by cyclic Jacobi
rotations on the driver, which holds matrices of dimensions x dimensions and nothing per row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sequor.llm.common import prepare

#: Entries become floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 64, 1_000_000
#: Entries of a larger size in SCALE-ths would not be whole numbers as doubles.
WIDEST = float(1 << 53)
#: Components whose variance is below this share of the largest one are rounding and are left out.
RANK = 1e-13


def jacobi(a: np.ndarray, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors as rows of a symmetric matrix, by cyclic Jacobi rotations.

    A sweep takes every pair of dimensions once, in rounds of disjoint pairs (a round-robin tournament)
    whose rotations are applied together. It ends when all entries off the diagonal are below
    machine precision relative to their diagonal entries, which keeps small eigenvalues accurate.
    """
    a = np.array(a, float)
    d = len(a)
    v = np.eye(d)
    players = np.arange(d + d % 2)
    for _ in range(sweeps):
        turned = False
        for _ in range(len(players) - 1):
            half = len(players) // 2
            p, q = np.minimum(players[:half], players[half:][::-1]), np.maximum(players[:half], players[half:][::-1])
            p, q = p[q < d], q[q < d]
            small = np.abs(a[p, q]) > np.finfo(float).eps * np.sqrt(np.abs(a[p, p] * a[q, q]))
            p, q = p[small], q[small]
            if len(p):
                turned = True
                x = a[p, q]
                theta = (a[q, q] - a[p, p]) / (2 * x)
                t = np.where(theta >= 0, 1.0, -1.0) / (np.abs(theta) + np.hypot(theta, 1.0))
                c = 1 / np.hypot(t, 1.0)
                s = t * c
                pp, qq = a[p, p] - t * x, a[q, q] + t * x
                for m in (a.T, a, v):
                    mp, mq = m[p].copy(), m[q].copy()
                    m[p] = c[:, None] * mp - s[:, None] * mq
                    m[q] = s[:, None] * mp + c[:, None] * mq
                a[p, p], a[q, q], a[p, q], a[q, p] = pp, qq, 0.0, 0.0
            players[1:] = np.roll(players[1:], 1)
        if not turned:
            break
    e = np.diag(a)
    order = np.argsort(-e, kind="stable")
    return e[order], v[order]


def _whole(b: pa.RecordBatch, d: int | None) -> tuple[pa.RecordBatch, np.ndarray]:
    """The rows of a batch that take part, and their x-vectors (rows, d)."""
    vec = b.column("vec")
    vec = vec if isinstance(vec, pa.ListArray) else vec.cast(pa.list_(vec.type.value_type))
    flat = vec.flatten().cast(pa.float64())
    lengths = pc.fill_null(pc.list_value_length(vec), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    c = pc.fill_null(flat, np.nan).to_numpy(zero_copy_only=False)
    bad = np.concatenate([[0], np.cumsum(~(np.abs(c) * SCALE < WIDEST))])
    ends = np.cumsum(lengths)
    ok = (lengths > 0) & (bad[ends] == bad[ends - lengths]) & ((lengths == d) if d else True)
    if d is None:
        return b.filter(pa.array(ok)), lengths[ok]
    x = c[np.repeat(ok, lengths)].reshape(-1, d)
    return b.filter(pa.array(ok)), np.floor(SCALE * x).astype(np.int64) + SHIFT


class Whitening:
    """What the driver keeps of a fit: n, sums, mean, eigenvalues, eigenvectors and trace."""

    def __init__(self, n: int, sums: np.ndarray, values: np.ndarray, vectors: np.ndarray, trace: float):
        self.n, self.sums, self.values, self.vectors, self.trace = n, sums, values, vectors, trace

    @property
    def dimensions(self) -> int:
        return len(self.sums)

    @property
    def matrix(self) -> np.ndarray:
        """Components as rows: unit eigenvectors over the root of their variance."""
        return self.vectors / np.sqrt(self.values)[:, None]

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S / n in double precision: the whole part is taken off as integers first."""
        whole, rest = np.divmod(self.sums, self.n)
        return (x - whole).astype(float) - rest / self.n


def _sum_of(df: DataFrame, f: Callable[[pa.RecordBatch], np.ndarray], kind: str = "double") -> np.ndarray:
    """Sum of the matrices f(batch) over all batches, added in each task and then by row of the matrix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            got = f(b)
            total = got if total is None else total + got
        if total is not None:
            r, c = np.indices(total.shape)
            yield pa.RecordBatch.from_arrays([pa.array(r.ravel()), pa.array(c.ravel()), pa.array(total.ravel())], ["r", "c", "v"])

    rows = df.mapInArrow(run, f"r long, c long, v {kind}").groupBy("r", "c").agg(F.sum("v").alias("v")).toPandas()
    out = np.zeros((int(rows["r"].max()) + 1, int(rows["c"].max()) + 1), np.int64 if kind == "long" else float) if len(rows) else np.zeros((0, 0))
    out[rows["r"], rows["c"]] = rows["v"]
    return out


def fit(df: DataFrame, vec_col: str = "embedding", components: int = 32) -> Whitening | None:
    """Whitening of all vectors that hold only finite numbers, of their commonest length (the longest of equally common ones).

    None if there are no such vectors. Covariances are centred before they are multiplied, divisor n.
    """
    prepare(df.sparkSession)
    vecs = df.select(F.col(vec_col).alias("vec"))

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            d, n = np.unique(_whole(b, None)[1], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(d.astype(np.int64)), pa.array(n.astype(np.int64))], ["d", "n"])

    top = vecs.mapInArrow(sizes, "d long, n long").groupBy("d").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    if top is None:
        return None
    d, n = int(top["d"]), int(top["n"])
    sums = _sum_of(vecs, lambda b: _whole(b, d)[1].sum(0, keepdims=True), "long")[0]
    w = Whitening(n, sums, np.zeros(0), np.zeros((0, d)), 0.0)

    def scatter(b: pa.RecordBatch) -> np.ndarray:
        y = w.centred(_whole(b, d)[1])
        return y.T @ y

    v = _sum_of(vecs, scatter) / n
    values, vectors = jacobi((v + v.T) / 2)
    keep = np.flatnonzero(values > RANK * max(values[0], 0.0))[:components]
    return Whitening(n, sums, values[keep], vectors[keep], float(np.trace(v)))


def identity_error(df: DataFrame, w: Whitening, vec_col: str = "embedding") -> float | None:
    """Largest absolute entry of (covariance of the whitened vectors - identity); None without components."""
    m, d = w.matrix, w.dimensions
    if not len(m):
        return None

    def moments(b: pa.RecordBatch) -> np.ndarray:
        y = w.centred(_whole(b, d)[1]) @ m.T
        return np.vstack([y.sum(0), y.T @ y])

    got = _sum_of(df.select(F.col(vec_col).alias("vec")), moments) / w.n
    # The means are zero but for rounding, so that nothing cancels here.
    return float(np.abs(got[1:] - np.outer(got[0], got[0]) - np.eye(len(m))).max())


def whiten(df: DataFrame, w: Whitening, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """id, deviation, whitened: for each vector that has the fit's length and only finite numbers.

    deviation is the sum over dimensions of (n * x - S)^2, exact; null where a long can't hold it. whitened
    has a number for each component. Repeated rows and null ids stay as they are.
    """
    m, d = w.matrix, w.dimensions

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept, x = _whole(b, d)
            if float(w.n) * (np.abs(x).max(initial=0)) < 2**62 and ((y := w.n * x - w.sums).astype(float) ** 2).sum(1).max(initial=0) < 2**62:
                deviation = pa.array((y * y).sum(1))
            else:
                exact = ((w.n * x.astype(object) - w.sums.astype(object)) ** 2).sum(1)
                deviation = pa.array([int(v) if v < 2**63 else None for v in exact], pa.int64())
            z = w.centred(x) @ m.T
            offsets = pa.array(np.arange(len(z) + 1, dtype=np.int32) * z.shape[1], pa.int32())
            yield pa.RecordBatch.from_arrays([kept.column("id"), deviation, pa.ListArray.from_arrays(offsets, pa.array(z.ravel()))], ["id", "deviation", "whitened"])

    d_in = df.select(F.col(id_col).alias("id"), F.col(vec_col).alias("vec"))
    return d_in.mapInArrow(run, f"id {d_in.schema['id'].dataType.simpleString()}, deviation long, whitened array<double>")


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    w = fit(vectors)
    if w is None:
        return vectors.where("false").selectExpr("vec_id", "1 as component", "1L as n", "1L as deviation", "1.0D as whitened", "1.0D as explained", "1.0D as identity_error")
    share = F.array(*(F.lit(float(e / w.trace)) for e in w.values))
    rows = whiten(vectors, w).select(F.col("id").alias("vec_id"), "deviation", F.posexplode("whitened").alias("component", "whitened"))
    return rows.select("vec_id", (F.col("component") + 1).alias("component"), F.lit(w.n).cast("long").alias("n"), "deviation", "whitened", F.get(share, F.col("component")).cast("double").alias("explained"), F.lit(identity_error(vectors, w)).cast("double").alias("identity_error"))
