"""Posterior draws per sample: grouped kernels over prepared samples and likelihood rows."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import alternatives, approximation, kernels


def sample_posterior(prepared: DataFrame, draws: int = 1000, seed: int = 123_456_789) -> DataFrame:
    """(sample, draw, x) from prepared rows (sample, mu, omega, alpha, parents, leaves): each row is its own task's work, seeded by its name."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples():
                own = seed + zlib.crc32(row.sample.encode())
                x = kernels.sample_simplex(row.mu, row.omega, row.alpha, np.asarray(row.parents), np.asarray(row.leaves), draws, own)
                yield pd.DataFrame({"sample": row.sample, "draw": range(draws), "x": list(x)})

    columns = prepared.select("sample", "mu", "omega", "alpha", "parents", "leaves")
    return columns.mapInPandas(run, "sample string, draw int, x array<double>")


def posterior_mean(draws: DataFrame) -> DataFrame:
    """(sample, feature, tpm): the mean over draws, a million times; features are numbered from 0."""
    return draws.select("sample", F.posexplode("x").alias("feature", "x")).groupBy("sample", "feature").agg((1e6 * F.avg("x")).alias("tpm"))


def gibbs(table: DataFrame, efflens: list[float], chains: int = 2, draws: int = 1000, stride: int = 25, burn_in: int = 2000, seed: int = 123_456_789) -> DataFrame:
    """(sample, chain, draw, x): each sample's likelihood rows (sample, read, feature from 0, prob) in `chains` independent chains."""
    n = len(efflens)

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        rows = [(g.feature.to_numpy(), g.prob.to_numpy()) for _, g in frame.sort_values(["read", "feature"]).groupby("read")]
        x = kernels.gibbs(rows, n, np.array(efflens), draws, stride, burn_in, seed + int(key[1]))
        return pd.DataFrame({"sample": key[0], "chain": key[1], "draw": range(draws), "x": list(x)})

    copies = table.withColumn("chain", F.explode(F.array(*(F.lit(c) for c in range(chains)))))
    return copies.groupBy("sample", "chain").applyInPandas(run, "sample string, chain int, draw int, x array<double>")


def _classes_of(rows: pd.DataFrame, n: int) -> approximation.Classes:
    """One sample's classes (class_key, count, feature, prob) as arrays."""
    rows = rows.sort_values(["class_key", "feature"])
    number, _ = pd.factorize(rows.class_key)
    counts = rows["count"].to_numpy(float)[np.unique(number, return_index=True)[1]]
    return approximation.Classes(number, rows.feature.to_numpy(int), rows.prob.to_numpy(float), counts, n)


def approximate(classes: DataFrame, trees: DataFrame, steps: int = 500, draws: int = 6, seed: int = 123_456_789) -> DataFrame:
    """(sample, mu, omega, alpha, parents, leaves), as sample_posterior takes them, from equivalence classes.

    classes has (sample, class_key, count, feature from 0, prob), trees (sample, parents, leaves). One task fits one
    sample, with noise seeded by its name; reads come as classes with counts, so that a task's input grows with the
    features, not with the reads.
    """
    rows = approximate_by(alternatives.METHODS[0], classes, trees, steps, draws, seed)
    value = lambda i: F.get("values", F.lit(i))
    return rows.select("sample", value(0).alias("mu"), value(1).alias("omega"), value(2).alias("alpha"), "parents", "leaves")


def approximate_by(method: str, classes: DataFrame, trees: DataFrame, steps: int = 500, draws: int = 6, seed: int = 123_456_789, reference: int = -1) -> DataFrame:
    """(sample, method, reference, values, parents, leaves): approximate() by the named method; values are its parameters, an array each."""
    if method not in alternatives.METHODS:
        raise ValueError(f"no approximation {method}; there are {', '.join(alternatives.METHODS)}")

    def run(key: tuple, rows: pd.DataFrame, tree: pd.DataFrame) -> pd.DataFrame:
        if rows.empty or tree.empty:
            return pd.DataFrame(columns=["sample", "method", "reference", "values", "parents", "leaves"], dtype=object)
        parents, leaves = np.asarray(tree.parents.iloc[0]), np.asarray(tree.leaves.iloc[0])
        values = alternatives.fit(method, _classes_of(rows, (len(parents) + 1) // 2), parents, leaves, steps, draws, seed + zlib.crc32(str(key[0]).encode()), reference)
        return pd.DataFrame({"sample": [key[0]], "method": [method], "reference": [reference], "values": [values], "parents": [parents], "leaves": [leaves]})

    kind = dict(trees.dtypes)["sample"]
    schema = f"sample {kind}, method string, reference int, values array<array<double>>, parents array<int>, leaves array<int>"
    rows = classes.select("sample", "class_key", "count", "feature", "prob")
    return rows.groupBy("sample").cogroup(trees.select("sample", "parents", "leaves").groupBy("sample")).applyInPandas(run, schema)


def sample_by(rows: DataFrame, draws: int = 1000, seed: int = 123_456_789) -> DataFrame:
    """(sample, draw, x) from rows of approximate_by, each drawn by the method that it names."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples():
                own = seed + zlib.crc32(str(row.sample).encode())
                x = alternatives.draw(row.method, [np.asarray(v) for v in row.values_], np.asarray(row.parents), np.asarray(row.leaves), draws, own, row.reference)
                yield pd.DataFrame({"sample": row.sample, "draw": range(draws), "x": list(x)})

    kind = dict(rows.dtypes)["sample"]
    return rows.withColumnRenamed("values", "values_").mapInPandas(run, f"sample {kind}, draw int, x array<double>")
