"""Approximations by name: gradients against differences, fits near posteriors that are known, and their draws."""

import numpy as np
import pandas as pd
import pytest

from tallyspark.functions import alternatives, approximation, kernels
from tallyspark.operators import posterior
from tests.test_regression import random_tree

OTHERS = [m for m in alternatives.METHODS if m not in ("logit_skew_normal_ptt", "optimize")]


def classes_of(pick, n, k):
    rows, features = np.repeat(np.arange(k), 2), np.concatenate([pick.choice(n, 2, replace=False) for _ in range(k)])
    return approximation.Classes(rows, features, pick.uniform(0.1, 1, 2 * k), pick.integers(1, 9, k).astype(float), n)


@pytest.mark.parametrize("method", OTHERS)
def test_gradients_agree_with_differences(method):
    pick = np.random.default_rng(4)
    n = 7
    parents, leaves = random_tree(n, pick)
    classes, space = classes_of(pick, n, 12), alternatives.coordinates(method, n, parents, leaves, 2)
    values = [pick.normal(0, 0.4, n - 1), pick.normal(-1, 0.3, n - 1)] if method != "kumaraswamy_ptt" else [pick.normal(0.3, 0.3, n - 1), pick.normal(0.2, 0.3, n - 1)]
    noise = pick.random(n - 1) if method == "kumaraswamy_ptt" else pick.normal(size=n - 1)
    _, found = alternatives.bound(method, noise, values, classes, space)
    for k in range(2):
        for i in range(n - 1):
            moved = []
            for step in (1e-6, -1e-6):
                v = [x.copy() for x in values]
                v[k][i] += step
                moved.append(alternatives.bound(method, noise, v, classes, space)[0])
            assert np.isclose((moved[0] - moved[1]) / 2e-6, found[k][i], rtol=1e-4, atol=1e-4), (k, i)


@pytest.mark.parametrize("method", ["logit_normal_ptt", "logistic_normal", "normal_ilr", "normal_alr"])
def test_jacobians_agree_with_differences(method):
    pick = np.random.default_rng(6)
    n = 5
    space = alternatives.coordinates(method, n, *random_tree(n, pick), 1)
    t = pick.normal(0, 0.7, n - 1)
    matrix = np.array([(space.forward(t + d) - space.forward(t - d))[:-1] / 2e-6 for d in 1e-6 * np.eye(n - 1)])
    constant = 0.5 * np.log(n) if method == "normal_ilr" else 0.0
    assert np.isclose(np.log(abs(np.linalg.det(matrix))), space.log_jacobian(t) + constant, atol=1e-5)


def test_balances_are_isometric():
    pick = np.random.default_rng(7)
    space = alternatives.Balances(*random_tree(9, pick))
    x, y = (pick.dirichlet(np.ones(9)) for _ in range(2))
    clr = lambda v: np.log(v) - np.log(v).mean()
    assert np.allclose(space.forward(space.balances(x)), x) and np.isclose(np.linalg.norm(space.balances(x) - space.balances(y)), np.linalg.norm(clr(x) - clr(y)))


@pytest.mark.parametrize("method", alternatives.METHODS)
def test_fits_are_near_the_posterior(spark, method):
    """Reads of one feature each, with a flat prior: the posterior is a Dirichlet, whose means and deviations are known.

    Ratios over one reference part hang together, which independent normals cannot follow: there deviations are too small.
    """
    counts = np.array([400.0, 250.0, 40.0, 160.0, 90.0])
    pick = np.random.default_rng(2)
    parents, leaves = random_tree(5, pick)
    rows = pd.DataFrame([{"sample": s, "class_key": i, "count": int(c), "feature": i, "prob": 0.5} for s in ("a", "b") for i, c in enumerate(counts)])
    trees = pd.DataFrame([{"sample": s, "parents": parents.tolist(), "leaves": leaves.tolist()} for s in ("a", "b")])
    made = posterior.approximate_by(method, spark.createDataFrame(rows), spark.createDataFrame(trees), steps=600, reference=3)
    drawn = posterior.sample_by(made, 2000).toPandas()
    p = (counts + 1) / (counts.sum() + 5)
    deviation = np.sqrt(p * (1 - p) / (counts.sum() + 6))
    for _, own in drawn.groupby("sample"):
        x = np.stack(own.x)
        if method == "optimize":
            assert np.allclose(x[0], counts / counts.sum(), atol=2e-3) and np.ptp(x, axis=0).max() == 0
        else:
            assert np.abs(x.mean(axis=0) - p).max() < 0.008, x.mean(axis=0) - p
            assert np.all(x.std(axis=0) < 2.2 * deviation) and np.all(x.std(axis=0) > (0.3 if "log" in method[:8] or method == "normal_alr" else 0.5) * deviation)
    assert not np.array_equal(made.toPandas()["values"].iloc[0][0], made.toPandas()["values"].iloc[1][0]) or method == "optimize"


def test_kumaraswamy_map_and_unknown_names(spark):
    u, a, b = np.linspace(0.05, 0.95, 7), np.full(7, 1.7), np.full(7, 0.6)
    y = alternatives.kumaraswamy(u, np.log(a), np.log(b))[0]
    assert np.allclose(y, kernels.kumaraswamy(u, a, b)) and np.allclose(1 - (1 - y**a) ** b, u)
    with pytest.raises(ValueError, match="no approximation"):
        posterior.approximate_by("other", None, None)
