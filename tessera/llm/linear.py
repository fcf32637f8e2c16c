"""Small dense logistic models, fitted by accelerated gradient steps on a bounded sample."""

from __future__ import annotations

import numpy as np


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


class Marked:
    """Rows of a 0/1 matrix, each as the sorted places of its ones: what ``x @ v`` and ``x.T @ v`` need, and no more.

    A row has at most one place for each column, so rows times columns bound the memory (two bytes each).
    """

    def __init__(self, rows: list[np.ndarray], columns: int, turned: bool = False):
        self.shape = (len(rows), columns)
        self.places = np.concatenate([np.zeros(0, np.uint16), *rows]).astype(np.uint16)
        self.counts = np.array([len(r) for r in rows], np.int64)
        self.turned = turned

    @property
    def T(self) -> Marked:
        other = object.__new__(Marked)
        other.shape, other.places, other.counts, other.turned = self.shape[::-1], self.places, self.counts, not self.turned
        return other

    def __matmul__(self, v: np.ndarray) -> np.ndarray:
        if v.ndim == 2:
            return np.stack([self @ column for column in v.T], axis=1)
        if self.turned:
            return np.bincount(self.places, np.repeat(v, self.counts), self.shape[0]).astype(np.float32)
        sums = np.zeros(len(self.places) + 1)
        np.cumsum(v[self.places], out=sums[1:])
        ends = np.cumsum(self.counts)
        return (sums[ends] - sums[ends - self.counts]).astype(np.float32)


def fit_logistic(
    x: np.ndarray | Marked, y: np.ndarray, weight: np.ndarray, l2: float, pairs: np.ndarray | None = None, fairness: float = 0.0, steps: int = 200
) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients and intercepts, a column for each column of the 0/1 targets ``y``.

    ``pairs`` holds the feature differences between rows and their counterfactuals; ``fairness`` weighs
    the mean square of the score change over them.
    """
    weight = (weight / weight.sum(axis=0)).astype(np.float32)
    theta, bias = np.zeros((x.shape[1], y.shape[1]), np.float32), np.zeros(y.shape[1], np.float32)
    v = np.random.default_rng(0).normal(size=x.shape[1]).astype(np.float32)
    heaviest = weight.max(axis=1)
    for _ in range(20):  # the largest curvature, by power iteration
        v /= np.linalg.norm(v) + 1e-12
        u = x.T @ (heaviest * (x @ v)) / 4
        if pairs is not None and len(pairs):
            u += 2 * fairness * (pairs.T @ (pairs @ v)) / len(pairs)
        v = u
    rate = 1 / (1.2 * float(np.linalg.norm(v)) + l2 + 0.3)
    at, at_bias, before, before_bias = theta, bias, theta, bias
    for step in range(steps):
        gap = weight * (sigmoid(x @ at + at_bias) - y)
        slope = x.T @ gap + l2 * at
        if pairs is not None and len(pairs):
            slope += 2 * fairness * (pairs.T @ (pairs @ at)) / len(pairs)
        theta, bias = at - rate * slope, at_bias - rate * gap.sum(axis=0)
        pace = step / (step + 3)
        at, at_bias = theta + pace * (theta - before), bias + pace * (bias - before_bias)
        before, before_bias = theta, bias
    return theta.astype(np.float64), bias.astype(np.float64)
