"""Density of the stored approximation and regression: derivatives, integrals, planted effects, and any split into blocks."""

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from tallyspark.functions import density, kernels
from tallyspark.functions import regression as kernel
from tallyspark.operators import effects, regression
from tallyspark.plans import regressions


def random_tree(n, pick):
    parents, leaves = [], []

    def grow(ids, parent):
        parents.append(parent)
        me = len(parents)
        leaves.append(int(ids[0]) + 1 if len(ids) == 1 else 0)
        if len(ids) > 1:
            cut = pick.integers(1, len(ids))
            grow(ids[:cut], me)
            grow(ids[cut:], me)

    grow(list(pick.permutation(n)), 0)
    return np.array(parents), np.array(leaves)


def approximation_of(n, pick):
    return random_tree(n, pick), pick.normal(size=n - 1), np.exp(0.3 * pick.normal(size=n - 1)), 0.4 * pick.normal(size=n - 1), pick.uniform(0.5, 3, n)


@pytest.mark.parametrize("n", [2, 3, 8, 40])
def test_density_gradient_agrees_with_differences(n):
    pick = np.random.default_rng(n)
    tree, mu, sigma, alpha, efflen = approximation_of(n, pick)
    tree = density.Tree(*tree)
    x = 2 * pick.normal(size=n) - 3
    f = lambda x: density.log_density(x, tree, mu, sigma, alpha, efflen)[0]
    _, g = density.log_density(x, tree, mu, sigma, alpha, efflen)
    assert np.allclose(g, [(f(x + d) - f(x - d)) / 2e-5 for d in 1e-5 * np.eye(n)], atol=1e-6, rtol=1e-6)
    rows = np.stack([x, x + 1, -x], axis=1)
    assert np.allclose(density.log_density(rows, tree, mu, sigma, alpha, efflen)[0], [f(r) for r in rows.T])


def test_density_integrates_to_one():
    pick = np.random.default_rng(5)
    tree, mu, sigma, alpha, efflen = approximation_of(3, pick)
    m = 1200
    a, b = np.meshgrid((np.arange(m) + 0.5) / m, (np.arange(m) + 0.5) / m)
    inside = a + b < 1
    x = np.log(np.stack([a[inside], b[inside], 1 - a[inside] - b[inside]]))
    value, _ = density.log_density(x, density.Tree(*tree), mu, sigma, alpha, efflen)
    assert math.isclose(np.exp(value - x.sum(axis=0)).sum() / m**2, 1, abs_tol=2e-3)


def test_density_is_that_of_draws():
    """A draw's density is that of its normal numbers over the stretch of the map: here for one stick."""
    tree = kernels.sequential_tree(2)
    mu, sigma, alpha, efflen = np.array([0.4]), np.array([0.7]), np.array([-0.5]), np.array([1.0, 3.0])
    draws = kernels.sample_simplex(mu, np.log(sigma), alpha, *tree, 40_000, 3) / efflen
    first = draws[:, 0] / draws.sum(axis=1)
    edges = np.linspace(0.02, 0.98, 25)
    at = np.linspace(0.02, 0.98, 24 * 50 + 1)
    at = (at[1:] + at[:-1]) / 2
    x = np.log(np.stack([at, 1 - at]))
    share = np.exp(density.log_density(x, density.Tree(*tree), mu, sigma, alpha, efflen)[0] - x.sum(axis=0)).reshape(24, 50).mean(axis=1) * (edges[1] - edges[0])
    assert np.abs(np.histogram(first, edges)[0] / len(first) - share).max() < 0.006


def test_shares_undo_sticks():
    pick = np.random.default_rng(2)
    parents, leaves = random_tree(30, pick)
    y = pick.uniform(0.01, 0.99, (29, 4))
    x = np.stack([kernels.sticks(y[:, i], parents, leaves)[0] for i in range(4)], axis=1)
    tree = density.Tree(parents, leaves)
    assert np.allclose(tree.shares(x), y) and np.allclose(tree.shares(1e-9 * x), y)


def test_gamma_derivatives():
    x = np.array([0.05, 0.7, 3.0, 25.0])
    assert np.allclose(kernel.digamma(x), [(math.lgamma(a * (1 + 1e-6)) - math.lgamma(a * (1 - 1e-6))) / (2e-6 * a) for a in x], atol=1e-6)
    assert np.allclose(kernel.trigamma(x), [(kernel.digamma(a * (1 + 1e-5)) - kernel.digamma(a * (1 - 1e-5))) / (2e-5 * a) for a in x], rtol=1e-5)


def planted(n, samples, pick):
    half = samples // 2
    w = np.where(pick.random(n) < 0.1, pick.choice([-2.5, 2.5], n), 0.0)
    bias, scales = pick.normal(-8, 2, n), pick.normal(0, 0.3, samples)
    deviation = np.exp(pick.normal(-1.2, 0.2, n))
    group = (np.arange(samples) >= half).astype(float)
    x = group[:, None] * w + bias - scales[:, None] + deviation * pick.normal(size=(samples, n))
    names = [f"s{i:02d}" for i in range(samples)]
    design = pd.DataFrame({"sample": names, "column": "group:b", "value": group})
    return x, w, scales, names, design


def long_of(spark, x, names, **more):
    s, f = np.indices(x.shape)
    return spark.createDataFrame(pd.DataFrame({"sample": np.array(names)[s.ravel()], "feature": [f"f{j:04d}" for j in f.ravel()], "x": x.ravel(), **{k: v.ravel() for k, v in more.items()}}))


def covered(fit, w):
    got = effects.credible_effects(fit.effects).toPandas().sort_values("feature")
    low, high = got.lower_credible.to_numpy() * math.log(2), got.upper_credible.to_numpy() * math.log(2)
    return (low <= w) & (w <= high), got


def test_regression_covers_planted_effects(spark):
    x, w, scales, names, design = planted(700, 12, np.random.default_rng(1))
    about = spark.createDataFrame(pd.DataFrame({"sample": names, "scale": scales}))
    fit = regression.regress(long_of(spark, x, names), spark.createDataFrame(design), about, block_features=100, rounds=60)
    inside, got = covered(fit, w)
    assert fit.converged and inside.mean() > 0.93 and inside[w != 0].mean() > 0.85
    assert np.abs(got["loc"].to_numpy()[w == 0]).mean() < 0.1 and np.abs(got["loc"].to_numpy() - w)[w != 0].mean() < 0.35
    sure = (got.lower_credible.to_numpy() > 0) | (got.upper_credible.to_numpy() < 0)
    assert sure[w != 0].mean() > 0.95 and sure[w == 0].mean() < 0.06
    back = fit.expression.toPandas().pivot(index="sample", columns="feature", values="x").to_numpy()
    assert np.allclose(back, x)


def test_regression_does_not_hang_on_blocks(spark):
    x, _, _, names, design = planted(60, 6, np.random.default_rng(2))
    rows = long_of(spark, x, names)
    more = spark.createDataFrame(pd.DataFrame({"sample": ["elsewhere"], "feature": ["f0000"], "x": [0.0]}))
    fits = [regression.regress(r, spark.createDataFrame(design), block_features=size, rounds=3).effects.toPandas().sort_values("feature") for r, size in ((rows, 1000), (rows.unionByName(more).repartition(5), 7))]
    for column in ("loc", "scale", "bias", "deviation"):
        assert np.allclose(fits[0][column], fits[1][column], rtol=1e-6)


def test_regression_on_uncertain_values(spark):
    """Values of large errors are drawn to the fit, sure ones stay; a wider error widens the effect."""
    pick = np.random.default_rng(3)
    x, w, scales, names, design = planted(150, 10, pick)
    error = np.where(pick.random(x.shape) < 0.2, 2.0, 0.05)
    seen = x + error * pick.normal(size=x.shape)
    fit = regression.regress(long_of(spark, seen, names, e=error), spark.createDataFrame(design), spark.createDataFrame(pd.DataFrame({"sample": names, "scale": scales})), deviation="e", rounds=60)
    back = fit.expression.toPandas().pivot(index="sample", columns="feature", values="x").to_numpy()
    assert np.abs(back - x)[error == 2].mean() < 0.5 * np.abs(seen - x)[error == 2].mean() and np.abs(back - seen)[error < 1].max() < 0.3
    assert covered(fit, w)[0].mean() > 0.9


def test_regression_refuses_what_is_missing(spark):
    x, _, _, names, design = planted(5, 4, np.random.default_rng(4))
    rows = long_of(spark, x, names)
    with pytest.raises(Exception, match="one value in each sample"):
        regression.regress(rows.where("NOT (sample = 's01' AND feature = 'f0002')"), spark.createDataFrame(design)).effects.count()
    with pytest.raises(ValueError, match="column of the design"):
        regression.regress(rows, spark.createDataFrame(pd.concat([design, pd.DataFrame({"sample": ["s00"], "column": ["other"], "value": [1.0]})])))


def test_regression_from_stored_approximations(spark):
    """Samples of twelve features, approximated on trees: planted effects are covered though expression itself is never given."""
    pick = np.random.default_rng(6)
    n, samples = 12, 10
    w = np.zeros(n)
    w[2], w[7] = 2.5, -2.5
    base, group = pick.normal(0, 1, n), np.arange(samples) % 2
    rows, truth, totals = [], [], []
    for i in range(samples):
        x = base + group[i] * w + 0.15 * pick.normal(size=n)
        parents, leaves = random_tree(n, pick)
        efflen = pick.uniform(0.5, 2, n)
        y = density.Tree(parents, leaves).shares((np.exp(x) * efflen)[:, None])[:, 0]
        rows.append((f"s{i}", (np.log(y) - np.log1p(-y) + 0.05 * pick.normal(size=n - 1)).tolist(), np.log(np.full(n - 1, 0.05)).tolist(), [0.0] * (n - 1), parents.tolist(), leaves.tolist(), efflen.tolist()))
        totals.append(math.log(np.exp(x).sum()))
        truth.append(x - totals[-1])
    prepared = spark.createDataFrame(rows, "sample string, mu array<double>, omega array<double>, alpha array<double>, parents array<int>, leaves array<int>, efflen array<double>")
    features = spark.createDataFrame([(f"f{j:02d}", j + 1) for j in range(n)], "feature string, leaf int")
    design = spark.createDataFrame(pd.DataFrame({"sample": [f"s{i}" for i in range(samples)], "column": "group:b", "value": group.astype(float)}))
    scales = spark.createDataFrame([(f"s{i}", float(s)) for i, s in enumerate(totals)], "sample string, scale double")
    fit = regression.regress_prepared(prepared, features, design, scales, rounds=12, distort=False, block_features=5)
    back = fit.expression.toPandas().pivot(index="sample", columns="feature", values="x").to_numpy()
    assert np.abs(back - np.array(truth)).mean() < 0.1
    inside, got = covered(fit, w)
    assert inside.mean() > 0.9 and np.abs(got["loc"].to_numpy() - w).max() < 0.5
    tpm = regression.expression_tpm(fit.expression).groupBy("sample").sum("tpm").collect()
    assert all(math.isclose(r[1], 1e6, rel_tol=1e-9) for r in tpm)


def test_blocks_pass_through_arrow_as_they_are():
    """A block's row gives the same block back, with and without values that are known up to an error."""
    pick = np.random.default_rng(8)
    x, names = pick.normal(size=(5, 3)), pa.array(["a", "b", "c"])
    for errors in (None, pick.uniform(1, 2, (5, 3))):
        block = kernel.Block.start(x, x.mean(axis=0), 2, errors)
        block.w = pick.normal(size=(2, 3))
        rows = [regression._arrow_row(i, names, block, np.arange(4.0), 0.5) for i in (3, 9)]
        back = list(regression._arrow_blocks([pa.Table.from_batches(rows).combine_chunks().to_batches()[0]], 5))
        assert [(n, f.to_pylist()) for n, f, _ in back] == [(3, names.to_pylist()), (9, names.to_pylist())]
        for _, _, got in back:
            for a in regression._ARRAYS:
                assert (getattr(got, a) is None) == (getattr(block, a) is None) and (getattr(got, a) is None or np.array_equal(getattr(got, a), getattr(block, a)))


def test_sum_of_residuals_is_that_of_its_parts():
    """A feature's residuals take in what the effects' covariance adds in each sample; here by a loop over samples."""
    pick = np.random.default_rng(9)
    design = np.hstack([np.repeat(np.eye(2), 3, axis=0), pick.normal(size=(6, 1))])
    x, ones = pick.normal(size=(6, 4)), 1.3 * np.ones(3)
    shared = kernel.Shared(design, pick.normal(size=6), kernel.knots(-1, 1, 3), 1.0, 4, shape=ones, rate=ones.copy(), distortion=np.zeros((3, 3)))
    block = kernel.Block.start(x, x.mean(axis=0), 3, None)
    z, precise = np.hstack([design, np.ones((6, 1))]), np.exp(-2 * block.log_dev + 2 * block.log_dev_var)
    prior = [np.diag([*(block.local1 * block.local2)[:, f] * shared.shrink, kernel.BIAS_DEVIATION**-2]) for f in range(4)]
    covariance = [np.linalg.inv(precise[f] * z.T @ z + prior[f]) for f in range(4)]
    block.sweep(shared)
    rest = [sum((x[s, f] + shared.scales[s] - z[s] @ [*block.w[:, f], block.bias[f]]) ** 2 + z[s] @ covariance[f] @ z[s] for s in range(6)) for f in range(4)]
    weights = kernel.kernel_shares(block.about, shared.knots, 1.0)
    slope = np.array(rest) * np.exp(-2 * block.log_dev) + weights @ shared.rate * np.exp(-block.log_dev) - 6 - weights @ shared.shape
    assert np.allclose(slope, 0, atol=1e-9)


def test_transcript_regression_makes_expression_once(spark, tmp_path, monkeypatch):
    """Each nation that ships has a value for each part, of lines with known parts and nations alone, and what follows reads it from one table."""
    tables = {
        "supplier": ("s_suppkey long, s_nationkey int", [(1, 0), (2, 1), (3, 1), (4, None), (5, 7)]),
        "part": ("p_partkey long", [(10,), (11,), (12,)]),
        "lineitem": ("l_suppkey long, l_partkey long, l_quantity double", [(1, 10, 4.0), (1, 10, 3.0), (2, 10, 1.0), (3, 10, 1.0), (3, 11, None), (4, 10, 9.0), (9, 10, 9.0), (2, 99, 5.0), (2, None, 5.0)]),
        "nation": ("n_nationkey int, n_regionkey int", [(0, 0), (1, 1), (7, 1)]),
    }
    for name, (schema, rows) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    seen, regress = [], regression.regress
    monkeypatch.setattr(regressions.regression, "regress", lambda x, *a, **k: seen.append(x) or regress(x, *a, **k))
    got = regressions.transcript_regression(spark, str(tmp_path))
    assert got.count() == 3 and not [f for f in seen[0].inputFiles() if "lineitem" in f]
    assert {(r.sample, r.feature): round(r.x, 9) for r in seen[0].collect()} == {(0, 10): round(math.log(8), 9), (1, 10): round(math.log(3), 9), **{(s, f): 0.0 for s in (0, 1) for f in (11, 12)}}


def test_blocks_are_packed_by_many_tasks(spark, monkeypatch):
    """However few partitions shuffles have: a table of few files is read in few tasks in all of the rounds."""
    x, _, _, names, design = planted(300, 4, np.random.default_rng(10))
    made, materialize = [], regression.materialize
    monkeypatch.setattr(regression, "materialize", lambda df, name: made.append((name, df.rdd.getNumPartitions())) or materialize(df, name))
    regression.regress(long_of(spark, x, names), spark.createDataFrame(design), block_features=10, rounds=1)
    assert made[0] == ("regression", 30)
