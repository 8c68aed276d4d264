"""Attribution: reductions and scores of maps, and model-facing operators behind a small protocol."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sequor.functions.models import Model, Output, Reduced
from sequor.operators.metrics import auroc, pr_trapezoid


def interpretability(df: DataFrame, by: str, ic: str = "ic", score: str = "score", threshold: float = 0.01) -> DataFrame:
    """by, auroc, pr_auc of telling places with ic > threshold from those with the smallest ic, by score."""
    low = df.groupBy(by).agg(F.min(ic).alias("_low"))
    d = df.join(low, by).where((F.col(ic) > threshold) | (F.col(ic) == F.col("_low")))
    d = d.select(by, (F.col(ic) > threshold).cast("int").alias("label"), F.col(score).alias("score"))
    return auroc(d, [by]).join(pr_trapezoid(d, [by]), by)


def signal_noise(df: DataFrame, by: str, ic: str = "ic", score: str = "score", threshold: float = 0.01, k: int = 10) -> DataFrame:
    """by, signal, noise_max, noise_mean, noise_top: all 0 with under k places of positive score and smallest ic."""
    low = df.groupBy(by).agg(F.min(ic).alias("_low"))
    s = F.col(score)
    noise = F.when((s > 0) & (F.col(ic) == F.col("_low")), s)
    d = df.join(low, by).select(by, F.when(F.col(ic) > threshold, s).alias("_s"), noise.alias("_n"))
    g = d.groupBy(by).agg(F.avg("_s").alias("signal"), F.max("_n").alias("noise_max"), F.avg("_n").alias("noise_mean"), F.count("_n").alias("_k"))
    best = Window.partitionBy(by).orderBy(F.desc("_n"))  # ranked in part before the shuffle: k rows a group and task
    top = d.where("_n is not null").withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= k).groupBy(by).agg(F.avg("_n").alias("noise_top"))
    zero = lambda c: F.when(F.col("_k") >= k, F.coalesce(c, F.lit(0.0))).otherwise(F.lit(0.0)).alias(c)
    return g.join(top, by, "left").select(by, *map(zero, ("signal", "noise_max", "noise_mean", "noise_top")))


def snr(signal: Column, noise: Column) -> Column:
    """signal / noise; 0 / 0 is 0, x / 0 infinite."""
    return F.when((noise == 0) & (signal == 0), F.lit(0.0)).when(noise == 0, F.lit(float("inf"))).otherwise(signal / F.nullif(noise, F.lit(0.0)))


def l1(scores: Column) -> Column:
    """Per place the sum of absolute letter scores."""
    return F.transform(scores, lambda r: F.aggregate(r, F.lit(0.0), lambda a, v: a + F.abs(v)))


def l2(scores: Column, eps: float = 1e-10) -> Column:
    return F.transform(scores, lambda r: F.sqrt(F.aggregate(r, F.lit(0.0), lambda a, v: a + v * v) + eps))


def times_input(x: Column, scores: Column) -> Column:
    """Per place the score of the letter that is there."""
    return F.zip_with(x, scores, lambda a, b: F.aggregate(F.zip_with(a, b, lambda u, v: u * v), F.lit(0.0), lambda s, v: s + v))


#: Values of results that a batch of maps has at once, about: what a task holds doesn't follow the size of its Arrow batches.
AT_ONCE = 1 << 18


def _apply(df: DataFrame, x: str, out: str, kind: str, f: Callable[[np.ndarray, dict[str, np.ndarray]], np.ndarray], key: str | None = None, values: Callable[[int], int] | None = None) -> DataFrame:
    """Add out = f(batch, keys), where batch stacks maps of x that have one length.

    Maps go from Arrow to NumPy and back without Python objects for single values. values: those of a row's result
    by the values of its map, if there are more.
    """
    schema = df.withColumn(out, F.lit(None).cast(kind)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lengths = pc.list_value_length(b.column(x)).to_numpy(zero_copy_only=False)
            for n in np.unique(lengths):
                same = np.flatnonzero(lengths == n)
                of_row = len(b.column(x).take(pa.array(same[:1])).flatten().flatten())
                many = max(1, AT_ONCE // max(1, values(of_row) if values else of_row))
                for lo in range(0, len(same), many):
                    g = b.take(pa.array(same[lo : lo + many]))
                    rows = g.column(x).flatten()
                    flat = rows.flatten().to_numpy(zero_copy_only=False).astype(float)
                    got = f(flat.reshape(g.num_rows, int(n), -1), {key: g.column(key).to_numpy(zero_copy_only=False)} if key else {})
                    if got.ndim == 1:
                        col = pa.array(got)
                    elif got.ndim == 2:
                        col = pa.ListArray.from_arrays(pa.array(np.arange(len(got) + 1, dtype=np.int32) * got.shape[1], pa.int32()), pa.array(got.ravel()))
                    else:
                        inner = pa.ListArray.from_arrays(pa.array(np.arange(0, got.size + 1, max(1, got.shape[2]), dtype=np.int32)), pa.array(got.ravel()))
                        col = pa.ListArray.from_arrays(pa.array(np.arange(0, len(inner) + 1, max(1, got.shape[1]), dtype=np.int32)), inner)
                    yield pa.RecordBatch.from_arrays([*g.columns, col], names=schema.names)

    return df.mapInArrow(run, schema)


MAP = "array<array<double>>"


def predict(df: DataFrame, model: Model, x: str = "x", out: str = "pred", outputs: bool = False) -> DataFrame:
    """Add out: the model's prediction, or with outputs the array of all its outputs."""
    if not outputs:
        return _apply(df, x, out, "double", lambda b, _: model.predict(b))
    return _apply(df, x, out, "array<double>", lambda b, _: model.predict(b).reshape(len(b), -1))


def saliency(df: DataFrame, model: Model, x: str = "x", out: str = "saliency") -> DataFrame:
    return _apply(df, x, out, MAP, lambda b, _: model.gradient(b))


def _noise(frame: dict[str, np.ndarray], key: str, seed: int, shape: tuple[int, ...], k: int) -> np.ndarray:
    return np.stack([np.random.default_rng([seed, k, int(h) & 0xFFFFFFFF]).standard_normal(shape) for h in frame[key]])


def smoothgrad(df: DataFrame, model: Model, key: str, x: str = "x", n: int = 25, sigma: float = 0.1, seed: int = 0, out: str = "smoothgrad") -> DataFrame:
    """Mean gradient over n noisy copies; noise depends on seed, row key and copy alone."""
    return _apply(df, x, out, MAP, lambda b, g: np.mean([model.gradient(b + sigma * _noise(g, key, seed, b.shape[1:], k)) for k in range(n)], axis=0), key)


def _integrated(model: Model, b: np.ndarray, base: np.ndarray, steps: int) -> np.ndarray:
    move, total = b - base, np.zeros(b.shape)
    for k, a in enumerate(np.linspace(0, 1, steps + 1)):
        total += (1.0 if 0 < k < steps else 0.5) * model.gradient(base + a * move)
    return total / steps * move


def _orders(keys: np.ndarray, seed: int, k: int, length: int) -> np.ndarray:
    """(n, length): each row's places in an order given by hashes of seed, k, row key and place."""

    def mixed(z: np.ndarray) -> np.ndarray:
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))

    step = np.uint64(0x9E3779B97F4A7C15)
    draw = mixed(mixed(np.array([seed], np.int64).view(np.uint64) + step) + np.array([k], np.uint64) * step)
    rows = mixed(np.asarray(keys).astype(np.int64).view(np.uint64) + draw)
    return np.argsort(mixed(rows[:, None] + np.arange(1, length + 1, dtype=np.uint64) * step), axis=1, kind="stable")


def hessian(df: DataFrame, model: Model, x: str = "x", eps: float = 1e-4, out: str = "hessian") -> DataFrame:
    """Second derivatives by central differences of the gradient: a row and a column per place and letter, letters fastest."""

    def f(b: np.ndarray, _: dict[str, np.ndarray]) -> np.ndarray:
        n, length, letters = b.shape
        got = np.empty((n, length * letters, length * letters))
        for k in range(length * letters):
            step = np.zeros((length, letters))
            step.flat[k] = eps
            got[:, k] = ((model.gradient(b + step) - model.gradient(b - step)) / (2 * eps)).reshape(n, -1)
        return got

    return _apply(df, x, out, MAP, f, values=lambda n: n * n)


#: Values of mutants that one call of a model gets, about.
MUTANT_VALUES = 1 << 18


def mutagenesis(df: DataFrame, model: Model, x: str = "x", class_index: int | None = None, out: str = "effect") -> DataFrame:
    """Per place and letter: the score with that letter there less the score as it is.

    The score is the class's output, or without class_index the L2 norm of all outputs.
    """

    def score(b: np.ndarray) -> np.ndarray:
        p = model.predict(b)
        if p.ndim == 1:
            return np.abs(p) if class_index is None else p
        return np.sqrt((p * p).sum(1)) if class_index is None else p[:, class_index]

    def f(b: np.ndarray, _: dict[str, np.ndarray]) -> np.ndarray:
        n, length, letters = b.shape
        got, of_row = np.empty_like(b), max(1, letters * length * letters * length)
        rows, step = max(1, MUTANT_VALUES // of_row), max(1, MUTANT_VALUES // max(1, letters * length * letters))
        for r in range(0, n, rows):  # several short maps at once, or parts of a long one
            some = b[r : r + rows]
            for lo in range(0, length, step):
                at = np.arange(min(step, length - lo))
                v = np.broadcast_to(some[:, None, None], (len(some), len(at), letters, length, letters)).copy()
                v[:, at, :, lo + at] = np.eye(letters)
                got[r : r + rows, lo : lo + len(at)] = score(v.reshape(-1, length, letters)).reshape(len(some), len(at), letters)
            got[r : r + rows] -= score(some)[:, None, None]
        return got

    return _apply(df, x, out, MAP, f)


def integrated_gradients(df: DataFrame, model: Model, x: str = "x", steps: int = 20, out: str = "integrated") -> DataFrame:
    """From a zero baseline, steps + 1 points, by trapezoids."""
    return _apply(df, x, out, MAP, lambda b, _: _integrated(model, b, np.zeros_like(b), steps))


def expected_gradients(df: DataFrame, model: Model, key: str, x: str = "x", baselines: int = 25, steps: int = 20, seed: int = 0, out: str = "expected") -> DataFrame:
    """Mean of integrated gradients over baselines that shuffle each row's places."""

    def f(b: np.ndarray, g: dict[str, np.ndarray]) -> np.ndarray:
        total = np.zeros_like(b)
        for k in range(baselines):
            base = np.take_along_axis(b, _orders(g[key], seed, k, b.shape[1])[:, :, None], 1)
            total += _integrated(model, b, base, steps)
        return total / baselines

    return _apply(df, x, out, MAP, f, key)


def perturb(df: DataFrame, model: Model, x: str = "x", eps: float = 0.1, rate: float = 0.1, steps: int = 10, decay: bool = False, sign: bool = True, out: str = "perturbed") -> DataFrame:
    """Gradient ascent kept within eps of the input at each step; steps = 1, rate = eps is the one-step attack."""

    def f(b: np.ndarray, _: dict[str, np.ndarray]) -> np.ndarray:
        y = b.copy()
        for i in range(steps):
            g = model.gradient(y)
            y = np.clip(y + (rate / (i + 10) if decay else rate) * (np.sign(g) if sign else g), b - eps, b + eps)
        return y

    return _apply(df, x, out, MAP, f)


def add_noise(df: DataFrame, key: str, x: str = "x", sigma: float = 0.1, seed: int = 0, out: str = "noisy") -> DataFrame:
    return _apply(df, x, out, MAP, lambda b, g: b + sigma * _noise(g, key, seed, b.shape[1:], 0), key)


def gumbel_softmax(logits: Column, key: Column, temperature: float = 1.0, seed: int = 0) -> Column:
    """A soft sample of a row of logits, by Gumbel noise from hashes of seed, key and place."""
    from sequor.functions.seq import uniform

    noisy = F.transform(logits, lambda v, i: (v - F.log(-F.log(uniform(seed, key, i) * (1 - 2e-16) + 1e-16))) / temperature)
    shifted = _once(noisy, lambda n: _once(F.array_max(n), lambda top: F.transform(n, lambda v: F.exp(v - top))))
    return _once(shifted, lambda e: _once(F.aggregate(e, F.lit(0.0), lambda a, b: a + b), lambda total: F.transform(e, lambda v: v / total)))


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed a single time a row, however often it is named."""
    return F.get(F.transform(F.array(value), use), 0)


def mutation_scores(variants: DataFrame, by: str, seq: str, score: str) -> DataFrame:
    """variants(by, seq, pos, nt, mutant, score) -> score of each variant less that of the unchanged letter."""
    wild = variants.where(F.col("mutant") == F.col(seq)).groupBy(by).agg(F.min(score).alias("_wild"))
    return variants.join(wild, by).withColumn("effect", F.col(score) - F.col("_wild")).drop("_wild")


class Explainer:
    """The attribution methods of one model and class (or of the mean of its outputs, or of any function of them), by name.

    reduce: (n, outputs) -> (n,), in place of a class.

    Noise and random baselines depend on seed and the row's key alone. baseline: random (the row's places shuffled) or zero.
    """

    def __init__(self, model: Model, class_index: int | None = None, key: str = "seq_id", x: str = "x", seed: int = 0, reduce: Callable[[np.ndarray], np.ndarray] | None = None):
        if reduce is not None and class_index is not None:
            raise ValueError("a class or a function of the outputs, not both")
        self.model, self.class_index, self.key, self.x, self.seed = model, class_index, key, x, seed
        self.one = Output(model, class_index) if reduce is None else Reduced(model, reduce)

    def saliency_maps(self, df: DataFrame, out: str = "saliency") -> DataFrame:
        return saliency(df, self.one, self.x, out)

    def hessian(self, df: DataFrame, out: str = "hessian") -> DataFrame:
        return hessian(df, self.one, self.x, out=out)

    def smoothgrad(self, df: DataFrame, num_samples: int = 50, stddev: float = 0.1, out: str = "smoothgrad") -> DataFrame:
        return smoothgrad(df, self.one, self.key, self.x, num_samples, stddev, self.seed, out)

    def integrated_grad(self, df: DataFrame, baseline: str = "random", num_steps: int = 25, out: str = "integrated") -> DataFrame:
        return self.expected_integrated_grad(df, 1, baseline, num_steps, out)

    def expected_integrated_grad(self, df: DataFrame, num_baseline: int = 25, baseline: str = "random", num_steps: int = 25, out: str = "expected") -> DataFrame:
        if baseline == "random":
            return expected_gradients(df, self.one, self.key, self.x, num_baseline, num_steps, self.seed, out)
        if baseline != "zero":
            raise ValueError(f"baseline is random or zero, not {baseline}")
        return integrated_gradients(df, self.one, self.x, num_steps, out)  # zeros don't differ from one another

    def mutagenesis(self, df: DataFrame, out: str = "effect") -> DataFrame:
        if isinstance(self.one, Reduced):
            return mutagenesis(df, self.one, self.x, 0, out)
        return mutagenesis(df, self.model, self.x, self.class_index, out)
