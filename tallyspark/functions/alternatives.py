"""Other approximations of a sample's likelihood, chosen by name: coordinates of the simplex, a family of draws on them, and their fits.

Each fit climbs the evidence bound by draws that are maps of fixed noise. Coordinates give x from numbers in R^(n - 1), and the
gradient of a function of x plus the log Jacobian; a family gives coordinates or shares from noise and its parameters.
"""

from __future__ import annotations

import numpy as np

from . import approximation, density, kernels

#: Names of methods; the first is the default one. A stored row names its method, and draws are made by it.
METHODS = ("logit_skew_normal_ptt", "logit_normal_ptt", "kumaraswamy_ptt", "logistic_normal", "normal_ilr", "normal_alr", "optimize")
LEAST = 1e-10


class Sticks:
    """Logits of the shares that go left in a tree."""

    def __init__(self, parents, leaves):
        self.parents, self.leaves = np.asarray(parents), np.asarray(leaves)

    def forward(self, t: np.ndarray) -> np.ndarray:
        return kernels.sticks(np.clip(kernels.logistic(t), LEAST, 1 - LEAST), self.parents, self.leaves)[0]

    def pull(self, t: np.ndarray, slope: np.ndarray, jacobian: bool = True) -> np.ndarray:
        y = np.clip(kernels.logistic(t), LEAST, 1 - LEAST)
        return approximation.stick_gradient(y, self.parents, self.leaves, slope, jacobian) * y * (1 - y) + jacobian * (1 - 2 * y)

    def log_jacobian(self, t: np.ndarray) -> float:
        y = np.clip(kernels.logistic(t), LEAST, 1 - LEAST)
        return kernels.sticks(y, self.parents, self.leaves)[1] + float(np.sum(np.log(y) + np.log1p(-y)))

    def start(self, n: int) -> np.ndarray:
        y = np.clip(kernels.inverse_sticks(np.full(n, 1 / n), self.parents, self.leaves), 1e-6, 1 - 1e-6)
        return np.log(y) - np.log1p(-y)


class Softmax:
    """x is the softmax of s, a linear map of the coordinates; the log Jacobian is the sum of log x and a constant."""

    def of(self, t: np.ndarray) -> np.ndarray:
        raise NotImplementedError

    def back(self, g: np.ndarray) -> np.ndarray:
        raise NotImplementedError

    def forward(self, t: np.ndarray) -> np.ndarray:
        s = self.of(t)
        e = np.exp(s - s.max())
        return np.maximum(e / e.sum(), LEAST)

    def pull(self, t: np.ndarray, slope: np.ndarray) -> np.ndarray:
        x = self.forward(t)
        return self.back(x * (slope - x @ slope) + 1 - len(x) * x)

    def log_jacobian(self, t: np.ndarray) -> float:
        return float(np.log(self.forward(t)).sum())

    def start(self, n: int) -> np.ndarray:
        return np.zeros(n - 1)


class AdditiveLogRatio(Softmax):
    """Logs of parts over a reference part, counted from 0; -1 is the last."""

    def __init__(self, n: int, reference: int = -1):
        self.keep = np.delete(np.arange(n), reference)
        self.n = n

    def of(self, t: np.ndarray) -> np.ndarray:
        s = np.zeros(self.n)
        s[self.keep] = t
        return s

    def back(self, g: np.ndarray) -> np.ndarray:
        return g[self.keep]


class Balances(Softmax):
    """Isometric log ratios along a tree: a node's balance is between the geometric means of its two sides."""

    def __init__(self, parents, leaves):
        self.tree = density.Tree(parents, leaves)
        size = self.tree.masses(np.ones((self.tree.n, 1)))[:, 0]
        left, right = size[self.tree.left[self.tree.inner]], size[self.tree.right[self.tree.inner]]
        self.on_left, self.on_right = np.sqrt(right / (left * (left + right))), -np.sqrt(left / (right * (left + right)))

    def of(self, t: np.ndarray) -> np.ndarray:
        slope = np.zeros((self.tree.nodes, 1))
        slope[self.tree.left[self.tree.inner], 0] = t * self.on_left
        slope[self.tree.right[self.tree.inner], 0] = t * self.on_right
        return self.tree.over_leaves(slope)[:, 0]

    def back(self, g: np.ndarray) -> np.ndarray:
        sums = self.tree.masses(g[:, None])[:, 0]
        return sums[self.tree.left[self.tree.inner]] * self.on_left + sums[self.tree.right[self.tree.inner]] * self.on_right

    def balances(self, x: np.ndarray) -> np.ndarray:
        """The coordinates of x."""
        return self.back(np.log(x))


def coordinates(method: str, n: int, parents, leaves, reference: int = -1):
    if method in ("logistic_normal", "normal_alr"):
        return AdditiveLogRatio(n, -1 if method == "logistic_normal" else reference)
    return Balances(parents, leaves) if method == "normal_ilr" else Sticks(parents, leaves)


def kumaraswamy(u: np.ndarray, log_a: np.ndarray, log_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, tuple[np.ndarray, ...], tuple[np.ndarray, ...]]:
    """(y, log dy/du, slopes of y over log a and log b, slopes of log dy/du over them)."""
    a, b = np.exp(log_a), np.exp(log_b)
    rest, log_rest = (1 - u) ** (1 / b), np.log1p(-u)
    c = np.maximum(1 - rest, 1e-300)
    y = np.clip(c ** (1 / a), LEAST, 1 - LEAST)
    c_b = rest * log_rest / b
    log_c = np.log(c)
    stretch = (1 / b - 1) * log_rest + (1 / a - 1) * log_c - log_a - log_b
    return y, stretch, (-y * log_c / a, y / (a * c) * c_b), (-log_c / a - 1, -log_rest / b + (1 / a - 1) / c * c_b - 1)


def bound(method: str, noise: np.ndarray, values: list[np.ndarray], classes: approximation.Classes, space) -> tuple[float, list[np.ndarray]]:
    """(log likelihood and log Jacobians of one draw, gradients over the parameters)."""
    if method == "kumaraswamy_ptt":
        y, stretch, over_y, over_stretch = kumaraswamy(noise, *values)
        x, jacobian = kernels.sticks(y, space.parents, space.leaves)
        value, slope = classes.gradient(x)
        g = approximation.stick_gradient(y, space.parents, space.leaves, slope)
        return value + jacobian + float(stretch.sum()), [g * p + q for p, q in zip(over_y, over_stretch, strict=True)]
    mu, omega = values
    t = mu + np.exp(omega) * noise
    value, slope = classes.gradient(space.forward(t))
    g = space.pull(t, slope)
    return value + space.log_jacobian(t) + float(omega.sum()), [g, g * np.exp(omega) * noise + 1]


def fit(method: str, classes: approximation.Classes, parents, leaves, steps: int = 500, draws: int = 6, seed: int = 123_456_789, reference: int = -1) -> list[np.ndarray]:
    """Parameters by method: (mu, omega, alpha) of the default, (log a, log b), (mu, omega), or the logits of the best point."""
    if method not in METHODS:
        raise ValueError(f"no approximation {method}; there are {', '.join(METHODS)}")
    if method == METHODS[0]:
        return list(approximation.fit(classes, parents, leaves, steps, draws, seed))
    space, n = coordinates(method, classes.n, parents, leaves, reference), classes.n
    first = space.start(n)
    if method == "optimize":
        ascent = approximation.Ascent(2.0)
        for _ in range(steps if n > 1 else 0):
            first = first + ascent.step(space.pull(first, classes.gradient(space.forward(first))[1], jacobian=False))
        return [first]
    if n < 2:
        return [first, first]
    moved = _around_medians if method == "kumaraswamy_ptt" else lambda v: (v, lambda g: g)
    values = [first, np.zeros(n - 1) if method == "kumaraswamy_ptt" else np.full(n - 1, np.log(0.1))]
    rng, ascents = np.random.default_rng(seed), [approximation.Ascent(0.5), approximation.Ascent(0.1)]
    for _ in range(steps):
        noise = rng.standard_normal((draws, n - 1)) if method != "kumaraswamy_ptt" else np.clip(rng.random((draws, n - 1)), 1e-6, 1 - 1e-6)
        own, back = moved(values)
        found = [bound(method, z, own, classes, space)[1] for z in noise]
        slopes = back([np.mean(g, axis=0) for g in zip(*found, strict=True)])
        values = [v + a.step(g) for v, a, g in zip(values, ascents, slopes, strict=True)]
    return moved(values)[0]


def _around_medians(values: list[np.ndarray]):
    """(log a, log b) of a median's logit and log b, and how slopes over the former become slopes over the latter: place and spread are fitted apart."""
    m, b = np.clip(kernels.logistic(values[0]), LEAST, 1 - LEAST), np.exp(values[1])
    half = np.exp2(-1 / b)
    log_c = np.log1p(-half)
    log_a = np.log(-log_c) - np.log(-np.log(m))
    by_b = -half * np.log(2) / (b * (1 - half) * log_c)
    return [log_a, values[1]], lambda g: [g[0] * -(1 - m) / np.log(m), g[1] + g[0] * by_b]


def draw(method: str, values: list[np.ndarray], parents, leaves, draws: int, seed: int, reference: int = -1) -> np.ndarray:
    """Draws of x from stored parameters, by the method's name; a point gives itself."""
    values = [np.asarray(v, float) for v in values]
    if method == METHODS[0]:
        return kernels.sample_simplex(*values, np.asarray(parents), np.asarray(leaves), draws, seed)
    rng, n = np.random.default_rng(seed), len(values[0]) + 1
    space = coordinates(method, n, parents, leaves, reference)
    if method == "optimize":
        return np.repeat(space.forward(values[0])[None], draws, axis=0)
    if method == "kumaraswamy_ptt":
        return np.array([kernels.sticks(kumaraswamy(np.clip(rng.random(n - 1), 1e-6, 1 - 1e-6), *values)[0], space.parents, space.leaves)[0] for _ in range(draws)])
    return np.array([space.forward(values[0] + np.exp(values[1]) * rng.standard_normal(n - 1)) for _ in range(draws)])
