"""Scorers for the model-facing operators: anything with predict and gradient will do."""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol

import numpy as np


class Model(Protocol):
    """One output, or several: those take `class_index` in gradient, and without it give the gradient of their mean."""

    def predict(self, x: np.ndarray) -> np.ndarray:
        """(n, length, letters) -> (n,), or (n, outputs)"""

    def gradient(self, x: np.ndarray) -> np.ndarray:
        """d predict / d x, shaped as x"""


def pull_back(model: Model, x: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The gradient of each row's outputs, weighted: sum over k of weight[n, k] * d output k / d x.

    By the model's own pull_back if it has one, else from the gradients of its outputs one by one.
    """
    if hasattr(model, "pull_back"):
        return model.pull_back(x, weight)
    if weight.shape[1] == 1:
        return weight[:, 0, None, None] * model.gradient(x)
    return sum(weight[:, k, None, None] * model.gradient(x, k) for k in range(weight.shape[1]))


class Reduced:
    """A model seen through any function of its outputs: (n, outputs) -> (n,), a row at a time.

    The function's own derivatives are central differences over the outputs, which calls no model; the model's part
    is exact. eps is relative to an output's size.
    """

    def __init__(self, model: Model, reduce: Callable[[np.ndarray], np.ndarray], eps: float = 1e-6):
        self.model, self.reduce, self.eps = model, reduce, eps

    def _outputs(self, x: np.ndarray) -> np.ndarray:
        p = self.model.predict(x)
        return p[:, None] if p.ndim == 1 else p

    def predict(self, x: np.ndarray) -> np.ndarray:
        return self.reduce(self._outputs(x))

    def gradient(self, x: np.ndarray) -> np.ndarray:
        p = self._outputs(x)
        weight = np.empty_like(p, dtype=float)
        for k in range(p.shape[1]):
            step = np.zeros_like(p, dtype=float)
            step[:, k] = self.eps * np.maximum(1.0, np.abs(p[:, k]))
            weight[:, k] = (self.reduce(p + step) - self.reduce(p - step)) / (2 * step[:, k])
        return pull_back(self.model, x, weight)


class Output:
    """A model of several outputs seen as one: a class, or the mean of a row's outputs."""

    def __init__(self, model: Model, class_index: int | None = None):
        self.model, self.class_index = model, class_index

    def predict(self, x: np.ndarray) -> np.ndarray:
        p = self.model.predict(x)
        if p.ndim == 1:
            return p
        return p.mean(1) if self.class_index is None else p[:, self.class_index]

    def gradient(self, x: np.ndarray) -> np.ndarray:
        return self.model.gradient(x) if self.class_index is None else self.model.gradient(x, self.class_index)


class Linear:
    """Sum of weights over places and letters; weights of a shorter sequence are cut."""

    def __init__(self, weights: np.ndarray):
        self.weights = np.asarray(weights, float)

    def predict(self, x: np.ndarray) -> np.ndarray:
        return (x * self.weights[: x.shape[1]]).sum((1, 2))

    def gradient(self, x: np.ndarray) -> np.ndarray:
        return np.broadcast_to(self.weights[: x.shape[1]], x.shape).copy()


class Logistic(Linear):
    def predict(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-super().predict(x)))

    def gradient(self, x: np.ndarray) -> np.ndarray:
        p = self.predict(x)[:, None, None]
        return p * (1 - p) * super().gradient(x)


class LinearClasses:
    """Several linear outputs; weights are (outputs, length, letters)."""

    def __init__(self, weights: np.ndarray):
        self.weights = np.asarray(weights, float)

    def predict(self, x: np.ndarray) -> np.ndarray:
        w = self.weights[:, : x.shape[1]]
        return x.reshape(len(x), w[0].size) @ w.reshape(len(w), -1).T

    def gradient(self, x: np.ndarray, class_index: int | None = None) -> np.ndarray:
        w = self.weights.mean(0) if class_index is None else self.weights[class_index]
        return np.broadcast_to(w[: x.shape[1]], x.shape).copy()

    def pull_back(self, x: np.ndarray, weight: np.ndarray) -> np.ndarray:
        return np.einsum("nk,kij->nij", weight, self.weights[:, : x.shape[1]])


class MotifScan:
    """Soft maximum over places of a kernel's sum."""

    def __init__(self, kernel: np.ndarray):
        self.kernel = np.asarray(kernel, float)

    def _sums(self, x: np.ndarray) -> np.ndarray:
        v = np.lib.stride_tricks.sliding_window_view(x, self.kernel.shape, axis=(1, 2))[:, :, 0]
        return np.einsum("npij,ij->np", v, self.kernel)

    def predict(self, x: np.ndarray) -> np.ndarray:
        s = self._sums(x)
        top = s.max(1)
        return top + np.log(np.exp(s - top[:, None]).sum(1))

    def gradient(self, x: np.ndarray) -> np.ndarray:
        s = self._sums(x)
        w = np.exp(s - s.max(1, keepdims=True))
        w /= w.sum(1, keepdims=True)
        out = np.zeros_like(x)
        for p in range(s.shape[1]):
            out[:, p : p + len(self.kernel)] += w[:, p, None, None] * self.kernel
        return out


class ReverseComplementScan:
    """Filters that read both strands at once: kernels (width, letters, filters) and their reverse complements, tied weights.

    The scans get the bias and lose what is negative; the reverse scan is turned round, so that a place means the same letters on both, and
    they are pooled by their mean or maximum. Outputs are the means over places, a number a filter: equal for a
    sequence and its reverse complement. Letters are in an order whose reverse is the complement, as ACGT is.
    """

    def __init__(self, kernels: np.ndarray, bias: np.ndarray | None = None, pool: str = "max"):
        if pool not in ("mean", "max"):
            raise ValueError(f"pool is mean or max, not {pool}")
        self.kernels = np.asarray(kernels, float)
        self.bias = np.zeros(self.kernels.shape[2]) if bias is None else np.asarray(bias, float)
        self.pool = pool

    def strands(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The forward and the reverse-complement scan, (n, places, filters) each; no places if the sequence is shorter than a kernel."""
        w, letters, filters = self.kernels.shape
        if x.shape[1] < w:
            none = np.zeros((len(x), 0, filters))
            return none, none
        windows = np.lib.stride_tricks.sliding_window_view(x, (w, letters), axis=(1, 2))[:, :, 0]
        stacked = np.concatenate([self.kernels, self.kernels[::-1, ::-1]], 2)
        both = np.maximum(0.0, np.einsum("npij,ijk->npk", windows, stacked) + np.tile(self.bias, 2))
        return both[:, :, :filters], both[:, :, filters:]

    def pooled(self, x: np.ndarray) -> np.ndarray:
        forward, back = self.strands(x)
        back = back[:, ::-1]
        return (forward + back) / 2 if self.pool == "mean" else np.maximum(forward, back)

    def predict(self, x: np.ndarray) -> np.ndarray:
        p = self.pooled(x)
        return p.sum(1) / max(1, p.shape[1])

    def pull_back(self, x: np.ndarray, weight: np.ndarray) -> np.ndarray:
        forward, back = self.strands(x)
        places, w = forward.shape[1], len(self.kernels)
        out = np.zeros(x.shape)
        if not places:
            return out
        mine = np.full(forward.shape, 0.5) if self.pool == "mean" else (forward >= back[:, ::-1]).astype(float)
        share = weight[:, None] / places
        to_forward, to_back = share * mine * (forward > 0), (share * (1 - mine))[:, ::-1] * (back > 0)
        turned = self.kernels[::-1, ::-1]
        for j in range(w):
            out[:, j : j + places] += to_forward @ self.kernels[j].T + to_back @ turned[j].T
        return out

    def gradient(self, x: np.ndarray, class_index: int | None = None) -> np.ndarray:
        k = self.kernels.shape[2]
        weight = np.full((len(x), k), 1 / k) if class_index is None else np.tile(np.eye(k)[class_index], (len(x), 1))
        return self.pull_back(x, weight)


MODELS = {"reverse_complement_scan": ReverseComplementScan, "linear": Linear, "logistic": Logistic, "linear_classes": LinearClasses, "motif_scan": MotifScan}


def get_model(name: str) -> type:
    """By name in any case."""
    if name.lower() not in MODELS:
        raise KeyError(f"no model {name}; there are {', '.join(sorted(MODELS))}")
    return MODELS[name.lower()]
