"""Fit of a skewed logit-normal on tree balances to one sample's likelihood, by stochastic ascent on the evidence bound."""

from __future__ import annotations

import numpy as np

from . import kernels

#: First learning rate, its decay and floor, forgetting rates of the moments, and what keeps a division finite.
RATE, DECAY, LEAST_RATE = 1.0, 2e-2, 1e-3
MEAN_KEPT, SQUARE_KEPT, TINY = 0.7, 0.9, 1e-8


class Ascent:
    """Adaptive moment steps; the first gradient sets the moments, and no step is longer than `longest`."""

    def __init__(self, longest: float, rate: float = RATE):
        self.mean = self.square = None
        self.longest, self.rate, self.count = longest, rate, 0

    def step(self, gradient: np.ndarray) -> np.ndarray:
        first = self.mean is None
        self.mean = gradient if first else MEAN_KEPT * self.mean + (1 - MEAN_KEPT) * gradient
        self.square = gradient**2 if first else SQUARE_KEPT * self.square + (1 - SQUARE_KEPT) * gradient**2
        rate = max(LEAST_RATE, self.rate * np.exp(-DECAY * self.count))
        self.count += 1
        return np.clip(rate * self.mean / (np.sqrt(self.square) + TINY), -self.longest, self.longest)


class Classes:
    """Reads of one sample by equivalence class: entries (class, feature, prob) and a count for each class."""

    def __init__(self, rows: np.ndarray, features: np.ndarray, probs: np.ndarray, counts: np.ndarray, n: int):
        self.rows, self.features, self.probs, self.counts, self.n = rows, features, probs, counts, n

    def gradient(self, x: np.ndarray) -> tuple[float, np.ndarray]:
        """(log likelihood, its gradient) at the mixture x."""
        total = np.maximum(np.bincount(self.rows, self.probs * x[self.features], len(self.counts)), 1e-300)
        slope = np.bincount(self.features, self.probs * (self.counts / total)[self.rows], self.n)
        return float(self.counts @ np.log(total)), slope


def stick_gradient(y: np.ndarray, parents: np.ndarray, leaves: np.ndarray, slope: np.ndarray, jacobian: bool = True) -> np.ndarray:
    """Gradient over y of f(sticks(y)), and of the log Jacobian unless that is left out, from the gradient of f over x."""
    left, right = kernels.tree_children(parents, leaves)
    inner = np.flatnonzero(np.asarray(leaves) <= 0)
    mass = np.ones(len(parents))
    for k, node in enumerate(inner):
        mass[left[node]], mass[right[node]] = mass[node] * y[k], mass[node] * (1 - y[k])
    worth, out = np.zeros(len(parents)), np.zeros(len(y))  # worth: what one more unit of a node's mass adds
    of_leaf = np.asarray(leaves) > 0
    worth[of_leaf] = slope[np.asarray(leaves)[of_leaf] - 1]
    for k in range(len(inner) - 1, -1, -1):
        node = inner[k]
        a, b = worth[left[node]], worth[right[node]]
        out[k] = mass[node] * (a - b)
        worth[node] = y[k] * a + (1 - y[k]) * b + jacobian / max(mass[node], 1e-300)
    return out


def bound(z: np.ndarray, mu: np.ndarray, omega: np.ndarray, alpha: np.ndarray, classes: Classes, parents, leaves) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
    """(log likelihood and log Jacobians of one draw z, gradients over mu, omega and alpha)."""
    sigma = np.exp(omega)
    y, density = kernels.skewed_logit_normal(z, mu, sigma, alpha)
    x, jacobian = kernels.sticks(y, parents, leaves)
    value, slope = classes.gradient(x)
    over_t = stick_gradient(y, parents, leaves, slope) * y * (1 - y) + 1 - 2 * y
    s = np.arcsinh(z) + alpha
    return value + jacobian + float(density.sum()), over_t, over_t * sigma * np.sinh(s) + 1, over_t * sigma * np.cosh(s) + np.tanh(s)


def fit(classes: Classes, parents, leaves, steps: int = 500, draws: int = 6, seed: int = 123_456_789) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(mu, omega, alpha) of the n - 1 balances; starts at even leaves. A sample of one feature has no balance."""
    parents, leaves = np.asarray(parents), np.asarray(leaves)
    y = np.clip(kernels.inverse_sticks(np.full(classes.n, 1 / classes.n), parents, leaves), 1e-6, 1 - 1e-6)
    values = [np.log(y / (1 - y)), np.full(len(y), np.log(0.1)), np.zeros(len(y))]
    if not len(y):
        return tuple(values)
    rng, ascents = np.random.default_rng(seed), [Ascent(2.0), Ascent(0.1), Ascent(0.1)]
    for _ in range(steps):
        found = [bound(z, *values, classes, parents, leaves)[1:] for z in rng.standard_normal((draws, len(y)))]
        values = [v + a.step(np.mean(g, axis=0)) for v, a, g in zip(values, ascents, zip(*found, strict=True), strict=True)]
    return tuple(values)
