"""Variational updates of a sparse linear regression, for one block of features and for one sample.

x of a sample and feature is normal about design times effects, plus distortion, plus bias, less the sample's scale.
Effects have a horseshoe+ prior, deviations an inverse gamma one whose parameters follow the mean through kernels.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np

from . import approximation, density

#: Deviation of the prior of the bias, scale of the Cauchy prior of distortions.
BIAS_DEVIATION, DISTORTION = 12.0, 0.1


def digamma(x: np.ndarray) -> np.ndarray:
    """By its recurrence up to 10, then its asymptotic series."""
    x, out = np.array(x, float), 0.0
    for _ in range(10):
        low = x < 10
        out = out - np.where(low, 1 / x, 0)
        x = np.where(low, x + 1, x)
    i = 1 / (x * x)
    return out + np.log(x) - 0.5 / x - i * (1 / 12 - i * (1 / 120 - i * (1 / 252 - i / 240)))


def trigamma(x: np.ndarray) -> np.ndarray:
    x, out = np.array(x, float), 0.0
    for _ in range(10):
        low = x < 10
        out = out + np.where(low, 1 / (x * x), 0)
        x = np.where(low, x + 1, x)
    i = 1 / (x * x)
    return out + 1 / x + i / 2 + i / x * (1 / 6 - i * (1 / 30 - i * (1 / 42 - i / 30)))


def knots(low: float, high: float, count: int) -> np.ndarray:
    """Evenly spaced, without the ends."""
    return low + (high - low) / (count + 1) * np.arange(1, count + 1)


def kernel_shares(x: np.ndarray, at: np.ndarray, bandwidth: float) -> np.ndarray:
    """(features, knots): Gaussian weights of at least 1e-10 before they are made to sum to one."""
    w = np.clip(np.exp(-(((x[:, None] - at) / bandwidth) ** 2) / 2), 1e-10, 1.0)
    return w / w.sum(axis=1, keepdims=True)


@dataclass
class Shared:
    """What all features share; small, and sent to every task."""

    design: np.ndarray  # samples by factors
    scales: np.ndarray  # by sample
    knots: np.ndarray
    bandwidth: float
    features: int
    shrink: float = 1.0  # expected 1 / tau^2
    shrink_own: float = 1.0  # expected value of its own scale's inverse
    shape: np.ndarray = field(default_factory=lambda: np.zeros(0))  # inverse gamma of deviations, by knot
    rate: np.ndarray = field(default_factory=lambda: np.zeros(0))
    distortion: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))  # factors by knots

    @property
    def sums(self) -> int:
        """Numbers that a block gives back."""
        d, k = len(self.knots), self.design.shape[1]
        return 2 + 2 * d + 4 * d * d + d * d + k * d

    def updated(self, sums: np.ndarray, distort: bool) -> Shared:
        """The next values from sums over all features; a step of scoring for shape and rate, whose priors are half-Cauchy."""
        d, k = len(self.knots), self.design.shape[1]
        at = np.cumsum([0, 2, 2 * d, 4 * d * d, d * d, k * d])
        (squares, _), slope, fisher, gram, right = (sums[a:b] for a, b in zip(at, at[1:], strict=False))
        shrink = (k * self.features + 1) / 2 / (self.shrink_own + squares / 2)
        values = np.concatenate([self.shape, self.rate])
        slope = slope - 2 * values / (1 + values**2)
        fisher = fisher.reshape(2 * d, 2 * d) + np.diag(2 / (1 + values**2))
        step = np.linalg.solve(fisher, slope)
        while (values + step <= values / 4).any() or (np.abs(step) > 1 + values).any():
            step = step / 2
        values = values + step
        out = Shared(self.design, self.scales, self.knots, self.bandwidth, self.features, shrink, 1 / (1 + shrink), values[:d], values[d:], self.distortion)
        if distort:
            inner = np.kron(self.design.T @ self.design, gram.reshape(d, d)) + np.diag(2 / (DISTORTION**2 + self.distortion.ravel() ** 2))
            out.distortion = np.linalg.solve(inner, right).reshape(k, d)
        return out


@dataclass
class Block:
    """Features of one block: arrays are by feature, x and its variance by (sample, feature), effects by (factor, feature)."""

    x: np.ndarray
    v: np.ndarray | None  # None where x is sure
    about: np.ndarray  # the mean that kernels go by
    w: np.ndarray
    w_var: np.ndarray
    bias: np.ndarray
    local1: np.ndarray  # expected 1 / lambda^2 of both local scales
    local2: np.ndarray
    log_dev: np.ndarray
    log_dev_var: np.ndarray
    seen: np.ndarray | None = None  # what is known of x: location, and deviation
    seen_dev: np.ndarray | None = None

    @classmethod
    def start(cls, x: np.ndarray, about: np.ndarray, factors: int, seen_dev: np.ndarray | None) -> Block:
        n = x.shape[1]
        ones = np.ones((factors, n))
        known = seen_dev is not None
        return cls(x, seen_dev**2 if known else None, about, 0 * ones, ones.copy(), x.mean(axis=0), ones.copy(), ones.copy(), np.log(np.maximum(x.std(axis=0), 0.1)), np.full(n, 0.1), x.copy() if known else None, seen_dev)

    def sweep(self, shared: Shared) -> None:
        """Effects and biases together, then local scales, then deviations; x too, where it is known up to a normal error."""
        k = len(self.w)
        z = np.hstack([shared.design, np.ones((len(self.x), 1))])
        weights = kernel_shares(self.about, shared.knots, shared.bandwidth)
        shape, rate = weights @ shared.shape, weights @ shared.rate
        bent = shared.design @ (shared.distortion @ weights.T)
        precise = np.exp(-2 * self.log_dev + 2 * self.log_dev_var)
        y = self.x + shared.scales[:, None] - bent
        prior = np.vstack([self.local1 * self.local2 * shared.shrink, np.full(len(precise), BIAS_DEVIATION**-2)])
        gram = z.T @ z
        inner = precise[:, None, None] * gram + prior.T[:, :, None] * np.eye(k + 1)
        right = precise * (z.T @ y) + np.vstack([np.zeros_like(self.w), np.full(len(precise), -math.log(shared.features) * BIAS_DEVIATION**-2)])
        covariance = np.linalg.inv(inner)
        mean = np.einsum("fij,jf->if", covariance, right)
        self.w, self.bias = mean[:k], mean[k]
        self.w_var = np.einsum("fii->if", covariance)[:k]
        square = (self.w**2 + self.w_var) * shared.shrink / 2
        for _ in range(2):
            self.local1 = 1 / (1 / (1 + self.local1) + square * self.local2)
            self.local2 = 1 / (1 / (1 + self.local2) + square * self.local1)
        fitted = z @ mean
        rest = ((y - fitted) ** 2 + (0 if self.v is None else self.v)).sum(axis=0) + covariance.reshape(len(precise), -1) @ gram.ravel()
        u = self.log_dev
        for _ in range(20):
            inverse = np.exp(-u)
            a, b = rest * inverse**2, rate * inverse
            u = u + np.clip((a + b - len(self.x) - shape) / (2 * a + b), -1, 1)
        self.log_dev, self.log_dev_var = u, 1 / (2 * rest * np.exp(-2 * u) + rate * np.exp(-u))
        if self.seen is not None:
            precise, known = np.exp(-2 * u + 2 * self.log_dev_var), self.seen_dev**-2
            self.v = 1 / (precise + known)
            self.x = self.v * (precise * (fitted + bent - shared.scales[:, None]) + known * self.seen)

    def expected(self, shared: Shared) -> tuple[np.ndarray, np.ndarray]:
        """(location of x by sample and feature, expected precision by feature), as a sample's step takes them."""
        weights = kernel_shares(self.about, shared.knots, shared.bandwidth)
        return shared.design @ (self.w + shared.distortion @ weights.T) + self.bias - shared.scales[:, None], np.exp(-2 * self.log_dev + 2 * self.log_dev_var)

    def sums(self, shared: Shared) -> np.ndarray:
        """What the block adds to the shared values' next step."""
        weights = kernel_shares(self.about, shared.knots, shared.bandwidth)
        shape, rate = weights @ shared.shape, weights @ shared.rate
        inverse = np.exp(-self.log_dev + self.log_dev_var / 2)
        precise = np.exp(-2 * self.log_dev + 2 * self.log_dev_var)
        slope = np.concatenate([weights.T @ (np.log(rate) - digamma(shape) - self.log_dev), weights.T @ (shape / rate - inverse)])
        part = lambda c: (weights * c[:, None]).T @ weights
        fisher = np.block([[part(trigamma(shape)), -part(1 / rate)], [-part(1 / rate), part(shape / rate**2)]])
        left = self.x + shared.scales[:, None] - shared.design @ self.w - self.bias
        return np.concatenate([[((self.w**2 + self.w_var) * self.local1 * self.local2).sum(), 0.0], slope, fisher.ravel(), part(precise).ravel(), ((shared.design.T @ left) * precise @ weights).ravel()])


def sample_step(m: np.ndarray, log_s: np.ndarray, tree: density.Tree, mu, sigma, alpha, efflen, about: np.ndarray, precise: np.ndarray, total_deviation: float, steps: int, draws: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """A sample's normal of x, (m, log s), some ascents on: its density against the regression's normal, its total held near one."""
    rng, ascents = np.random.default_rng(seed), [approximation.Ascent(0.5, 0.1), approximation.Ascent(0.5, 0.1)]
    for _ in range(steps):
        noise = rng.standard_normal((len(m), draws))
        s = np.exp(log_s)
        _, g = density.log_density(m[:, None] + s[:, None] * noise, tree, mu, sigma, alpha, efflen)
        top = m.max()
        e = np.exp(m - top)
        total = top + math.log(e.sum())
        over_m = g.mean(axis=1) - precise * (m - about) - total / total_deviation**2 * e / e.sum()
        over_s = (g * noise).mean(axis=1) * s - precise * s * s + 1
        m, log_s = m + ascents[0].step(over_m), log_s + ascents[1].step(over_s)
    return m, log_s
