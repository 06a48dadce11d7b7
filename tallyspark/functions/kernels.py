"""Numerical kernels on one sample's arrays: tree stick breaking, skewed logit-normal balances, other simplex maps, sampling."""

from __future__ import annotations

import math

import numpy as np


def tree_children(parents: np.ndarray, leaves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(left, right) of each node of a serialised tree: nodes in depth-first order, 1-based parents, the first child seen is the right one."""
    left, right = np.full(len(parents), -1), np.full(len(parents), -1)
    for node in range(1, len(parents)):
        p = parents[node] - 1
        if right[p] < 0:
            right[p] = node
        else:
            left[p] = node
    return left, right


def sticks(y: np.ndarray, parents: np.ndarray, leaves: np.ndarray) -> tuple[np.ndarray, float]:
    """(x, log Jacobian): y is the share that goes left at each inner node, in node order; x is by leaf number."""
    left, right = tree_children(parents, leaves)
    mass, x, log_jacobian, k = np.zeros(len(parents)), np.zeros((len(parents) + 1) // 2), 0.0, 0
    mass[0] = 1.0
    for node in range(len(parents)):
        if leaves[node] > 0:
            x[leaves[node] - 1] = mass[node]
            continue
        mass[left[node]], mass[right[node]] = mass[node] * y[k], mass[node] * (1 - y[k])
        log_jacobian += math.log(max(mass[node], 1e-300))
        k += 1
    return x, log_jacobian


def inverse_sticks(x: np.ndarray, parents: np.ndarray, leaves: np.ndarray) -> np.ndarray:
    left, _ = tree_children(parents, leaves)
    mass = np.array([x[j - 1] if j > 0 else 0.0 for j in leaves])
    for node in range(len(parents) - 1, 0, -1):
        mass[parents[node] - 1] += mass[node]
    inner = np.flatnonzero(np.asarray(leaves) <= 0)
    return mass[left[inner]] / np.maximum(mass[inner], 1e-300)


def sequential_tree(n: int) -> tuple[np.ndarray, np.ndarray]:
    """(parents, leaves) of a list: each inner node has a leaf on its right."""
    parents, leaves, spine = [0], [0], 1
    if n == 1:
        return np.array([0]), np.array([1])
    for leaf in range(1, n):
        parents.append(spine)
        leaves.append(leaf)
        parents.append(spine)
        leaves.append(0 if leaf < n - 1 else n)
        spine = len(parents)
    return np.array(parents), np.array(leaves)


def logistic(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-z))


def skewed_logit_normal(z: np.ndarray, mu: np.ndarray, sigma: np.ndarray, alpha: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(y, log dy/dz) of y = logistic(mu + sigma * sinh(alpha + asinh(z)))."""
    s = np.arcsinh(z) + alpha
    y = logistic(mu + sigma * np.sinh(s))
    y = np.clip(y, 1e-10, 1 - 1e-10)
    return y, np.log(y) + np.log1p(-y) + np.log(sigma) + np.log(np.cosh(s)) - 0.5 * np.log1p(z * z)


def kumaraswamy(u: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (1 - (1 - u) ** (1 / b)) ** (1 / a)


def additive_log_ratio(x: np.ndarray) -> np.ndarray:
    return np.log(x[:-1] / x[-1])


def inverse_additive_log_ratio(z: np.ndarray) -> np.ndarray:
    e = np.exp(np.append(z, 0) - max(0, z.max(initial=0)))
    return e / e.sum()


def isometric_log_ratio(x: np.ndarray) -> np.ndarray:
    """Balances of each part against the geometric mean of those before it."""
    logs, k = np.log(x), np.arange(1, len(x))
    return np.sqrt(k / (k + 1)) * (np.cumsum(logs)[:-1] / k - logs[1:])


def inverse_isometric_log_ratio(z: np.ndarray) -> np.ndarray:
    k = np.arange(1, len(z) + 1)
    steps, logs, total = z / np.sqrt(k / (k + 1)), [0.0], 0.0
    for i, s in enumerate(steps, 1):
        logs.append(total / i - s)
        total += logs[-1]
    e = np.exp(np.array(logs) - max(logs))
    return e / e.sum()


def sample_simplex(mu, omega, alpha, parents, leaves, draws: int, seed: int) -> np.ndarray:
    """Draws of x from the stored approximation."""
    rng = np.random.default_rng(seed)
    mu, sigma, alpha = np.asarray(mu), np.exp(np.asarray(omega)), np.asarray(alpha)
    return np.array([sticks(skewed_logit_normal(rng.standard_normal(len(mu)), mu, sigma, alpha)[0], parents, leaves)[0] for _ in range(draws)])


def gibbs(rows: list[tuple[np.ndarray, np.ndarray]], n: int, efflen: np.ndarray, draws: int, stride: int, burn_in: int, seed: int) -> np.ndarray:
    """Draws of x: reads are assigned by x and probability, then x is drawn from a Dirichlet of the counts plus one, over effective length."""
    rng = np.random.default_rng(seed)
    x, out = np.full(n, 1 / n), []
    features = np.concatenate([f for f, _ in rows]) if rows else np.zeros(0, np.int64)
    probs = np.concatenate([p for _, p in rows]) if rows else np.zeros(0)
    ends = np.cumsum([len(f) for f, _ in rows], dtype=np.int64)
    for step in range(burn_in + draws * stride):
        # One cumulative sum over all reads; each read draws a place in its own stretch of it.
        upto = np.cumsum(probs * x[features])
        stop = upto[ends - 1]
        start = np.concatenate(([0.0], stop[:-1]))[: len(ends)]
        drawn = np.searchsorted(upto, start + rng.random(len(ends)) * (stop - start), "right")
        first = np.concatenate(([0], ends[:-1]))[: len(ends)]
        counts = np.bincount(features[np.clip(drawn, first, ends - 1)], minlength=n)
        x = rng.gamma(counts + 1)
        x /= x.sum()
        if step >= burn_in and (step - burn_in) % stride == stride - 1:
            y = x / efflen
            out.append(y / y.sum())
    return np.array(out)


def min_effect_size(mean: float, deviation: float, target: float = 0.1, tolerance: float = 1e-3) -> float:
    """The d in [0, 20] with P(|w| < d) = target for a normal w, by bisection."""
    cdf = lambda v: 0.5 * (1 + math.erf((v - mean) / deviation / math.sqrt(2)))
    low, high = 0.0, 20.0
    while high - low > tolerance * max(high, tolerance):
        mid = (low + high) / 2
        low, high = (mid, high) if cdf(mid) - cdf(-mid) < target else (low, mid)
    return (low + high) / 2
