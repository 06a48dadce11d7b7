"""Log density of log-expression under a sample's stored approximation, with its gradient."""

from __future__ import annotations

import math

import numpy as np

from . import kernels

LEAST = 1e-300


class Tree:
    """A serialised tree as a schedule: inner nodes by depth, so that sums go up and slopes come down a level at a time.

    Rows of many samples that share the tree go through together: arrays are (nodes, rows).
    """

    def __init__(self, parents, leaves):
        parents, leaves = np.asarray(parents), np.asarray(leaves)
        self.left, self.right = kernels.tree_children(parents, leaves)
        self.inner = np.flatnonzero(leaves <= 0)
        self.leaf_nodes = np.flatnonzero(leaves > 0)
        self.leaf = leaves[self.leaf_nodes] - 1
        self.nodes, self.n = len(parents), len(self.leaf)
        depth = np.zeros(len(parents), np.int64)
        for node in range(1, len(parents)):
            depth[node] = depth[parents[node] - 1] + 1
        order = self.inner[np.argsort(depth[self.inner], kind="stable")]
        self.levels = np.split(order, np.flatnonzero(np.diff(depth[order])) + 1) if len(order) else []

    def masses(self, weights: np.ndarray) -> np.ndarray:
        """Sum of the weights (leaf number first) below each node: nothing is subtracted, so that small sums stay exact."""
        mass = np.zeros((self.nodes, *weights.shape[1:]))
        mass[self.leaf_nodes] = weights[self.leaf]
        for level in reversed(self.levels):
            mass[level] = mass[self.left[level]] + mass[self.right[level]]
        return mass

    def shares(self, weights: np.ndarray) -> np.ndarray:
        """The share that goes left at each inner node, in node order; the inverse of stick breaking for any number of rows."""
        mass = self.masses(weights)
        return mass[self.left[self.inner]] / np.maximum(mass[self.inner], LEAST)

    def over_leaves(self, slope: np.ndarray) -> np.ndarray:
        """Sum of the slopes of all nodes above each leaf and of the leaf itself, by leaf number."""
        total = slope.copy()
        for level in self.levels:
            total[self.left[level]] += total[level]
            total[self.right[level]] += total[level]
        out = np.empty((self.n, *slope.shape[1:]))
        out[self.leaf] = total[self.leaf_nodes]
        return out


def log_density(x: np.ndarray, tree: Tree, mu: np.ndarray, sigma: np.ndarray, alpha: np.ndarray, efflen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(log density, its gradient) of log-expression x, (n,) or (n, rows), under y = logistic(mu + sigma * sinh(alpha + asinh(z))).

    Expression is the softmax of x; times effective length it is what the tree breaks into sticks. x has one dimension
    more than the simplex: the total, log sum exp x, which no read tells of, has a flat density, so exp(x) has the
    Jacobian of shares and total. At a total of one and less the sum of x this is the density of the shares.
    """
    flat = x.ndim == 1
    rows = x[:, None] if flat else x
    column = lambda v: np.asarray(v, float).reshape(len(v), -1)
    mu, sigma, alpha, efflen = column(mu), column(sigma), column(alpha), column(efflen)
    top = rows.max(axis=0)
    e = np.exp(rows - top)
    weights = np.maximum(e * efflen, LEAST)
    mass = tree.masses(weights)
    left, right = tree.left[tree.inner], tree.right[tree.inner]
    t = np.log(mass[left]) - np.log(mass[right])
    s = (t - mu) / sigma
    a = np.arcsinh(s)
    z = np.sinh(a - alpha)
    root = np.sqrt(1 + s * s)
    log_y = -np.logaddexp(0, -t)
    value = np.sum(-0.5 * z * z - 0.5 * math.log(2 * math.pi) + np.log(np.cosh(a - alpha)) - np.log(root) - np.log(sigma) - 2 * log_y + t - np.log(mass[tree.inner]), axis=0)
    total, sized = e.sum(axis=0), weights.sum(axis=0)
    value += np.log(efflen).sum() - np.log(sized) + np.log(total) + rows.sum(axis=0) - (tree.n - 1) * top
    g = (-z * np.cosh(a - alpha) / root + np.tanh(a - alpha) / root - s / (root * root)) / sigma + np.tanh(t / 2)
    slope = np.zeros_like(mass)
    slope[tree.inner] = -1 / mass[tree.inner]
    slope[left] += g / mass[left]
    slope[right] -= g / mass[right]
    gradient = weights * (tree.over_leaves(slope) - 1 / sized) + e / total + 1
    return (value[0], gradient[:, 0]) if flat else (value, gradient)
