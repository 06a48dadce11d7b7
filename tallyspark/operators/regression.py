"""Sparse linear regression of expression on a design, by variational updates that alternate blocks of features and samples.

Features are independent of each other given what all share: the global scale, the curves of deviation over mean, and the
distortions. So a block of features is one row of arrays, updated by itself; what is shared takes its next step from sums
over the blocks that Spark adds up. With stored approximations in place of known expression, a sample's density ties all its
features together: then each round also sends slices from blocks to samples and back.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import density, kernels, regression
from ..plans.scratch import materialize

_ARRAYS = ("x", "v", "about", "w", "w_var", "bias", "local1", "local2", "log_dev", "log_dev_var", "seen", "seen_dev")
_BY_CELL = ("x", "v", "seen", "seen_dev")
_STATE = "block int, features array<string>, " + ", ".join(f"{a} array<double>" for a in _ARRAYS) + ", sums array<double>, change double"
_BY_FACTOR = ("w", "w_var", "local1", "local2")
_LISTS = pa.list_(pa.float64())
_ARROW = pa.schema([("block", pa.int32()), ("features", pa.list_(pa.string())), *((a, _LISTS) for a in _ARRAYS), ("sums", _LISTS), ("change", pa.float64())])
#: Tasks that first pack the blocks: this many, or one for each of so many blocks where that is more.
TASKS, TASK_BLOCKS = 64, 16
EFFECTS = "factor string, feature string, loc double, scale double, bias double, deviation double"


@dataclass
class Fit:
    """effects (factor, feature, loc, scale, bias, deviation) in natural logs, expression (sample, feature, x), and how the rounds ended."""

    effects: DataFrame
    expression: DataFrame
    rounds: int
    converged: bool


def _row(number: int, names: list[str], block: regression.Block, sums: np.ndarray, change: float) -> dict:
    values = {a: None if getattr(block, a) is None else getattr(block, a).ravel() for a in _ARRAYS}
    return {"block": number, "features": names, **values, "sums": sums, "change": change}


def _block(row, samples: int) -> regression.Block:
    n = len(row.features)
    shaped = {}
    for a in _ARRAYS:
        value = getattr(row, a)
        value = None if value is None else np.array(value, float)
        shaped[a] = value if value is None or a not in (*_BY_CELL, *_BY_FACTOR) else value.reshape(samples if a in _BY_CELL else -1, n)
    return regression.Block(**shaped)


def _arrow_blocks(batches: Iterator[pa.RecordBatch], samples: int) -> Iterator[tuple[int, pa.Array, regression.Block]]:
    """(number, names of its features, block) of the rows of a state."""
    for batch in batches:
        for i in range(len(batch)):
            names = batch["features"][i].values
            shaped = {a: batch[a][i].values.to_numpy() if batch[a][i].is_valid else None for a in _ARRAYS}
            for a in (*_BY_CELL, *_BY_FACTOR):
                shaped[a] = None if shaped[a] is None else shaped[a].reshape(samples if a in _BY_CELL else -1, len(names))
            yield batch["block"][i].as_py(), names, regression.Block(**shaped)


def _arrow_row(number: int, names: pa.Array, block: regression.Block, sums: np.ndarray, change: float) -> pa.RecordBatch:
    row = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
    values = [getattr(block, a) for a in _ARRAYS]
    lists = [pa.nulls(1, _LISTS) if v is None else row(pa.array(v.ravel())) for v in (*values, sums)]
    return pa.RecordBatch.from_arrays([pa.array([number], pa.int32()), row(names), *lists, pa.array([change], pa.float64())], schema=_ARROW)


def _advance(block: regression.Block, shared: regression.Shared, sweeps: int) -> tuple[np.ndarray, float]:
    """(sums, largest change of an effect in posterior deviations) of some sweeps."""
    before = block.w.copy()
    for _ in range(sweeps):
        block.sweep(shared)
    return block.sums(shared), float(np.max(np.abs(block.w - before) / np.sqrt(block.w_var), initial=0))


def _swept(state: DataFrame, shared: regression.Shared, sweeps: int) -> DataFrame:
    samples = len(shared.design)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, names, block in _arrow_blocks(batches, samples):
            yield _arrow_row(number, names, block, *_advance(block, shared, sweeps))

    return state.mapInArrow(run, _STATE)


def _summed(state: DataFrame, size: int) -> tuple[np.ndarray, float]:
    """The blocks' sums, place by place, and the largest change: as many rows as there are places, however many blocks."""
    sums = np.zeros(size)
    for r in state.select(F.posexplode("sums").alias("place", "value")).groupBy("place").agg(F.sum("value").alias("value")).collect():
        sums[r.place] = r.value
    return sums, state.agg(F.max("change")).first()[0] or 0.0


def design_of(design: DataFrame, sample: str) -> tuple[list[str], list[str], np.ndarray]:
    """(samples, factors, matrix) of design columns (sample, column, value): as large as the list of samples, which the driver names."""
    cells = design.select(F.col(sample).cast("string").alias("s"), "column", "value").toPandas()
    table = cells.pivot(index="s", columns="column", values="value").sort_index().sort_index(axis=1)
    if table.isna().any(axis=None):
        raise ValueError("a sample lacks a column of the design")
    return list(table.index), list(table.columns), table.to_numpy(float)


def _scales_of(scales: DataFrame | None, sample: str, samples: list[str]) -> np.ndarray:
    known = {} if scales is None else {str(r[0]): float(r[1]) for r in scales.select(sample, "scale").collect()}
    return np.array([known.get(s, 0.0) for s in samples])


def _start(about: DataFrame, matrix: np.ndarray, scales: np.ndarray, count: int, bandwidth: float) -> regression.Shared:
    """Shared values to begin with; about has the features' means."""
    low, high, n = about.agg(F.min("about"), F.max("about"), F.count("*")).first()
    if not n:
        raise ValueError("no features")
    ones = np.ones(count) * 1.3
    return regression.Shared(matrix, scales, regression.knots(low, high, count), bandwidth, n, shape=ones, rate=ones.copy(), distortion=np.zeros((matrix.shape[1], count)))


def _effects(state: DataFrame, factors: list[str], shared: regression.Shared) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, names, block in _arrow_blocks(batches, len(shared.design)):
            for k, factor in enumerate(factors):
                values = {"loc": block.w[k], "scale": np.sqrt(block.w_var[k]), "bias": block.bias, "deviation": np.exp(block.log_dev)}
                yield pa.RecordBatch.from_pydict({"factor": pa.array([factor]).take(pa.array(np.zeros(len(names), np.int32))), "feature": names, **{c: pa.array(v) for c, v in values.items()}})

    return state.mapInArrow(run, EFFECTS)


def _cells(state: DataFrame, samples: list[str]) -> DataFrame:
    """(sample, feature, x) of the blocks."""
    n = F.size("features")
    rows = state.select("features", F.explode(F.transform(F.sequence(F.lit(0), F.lit(len(samples) - 1)), lambda i: F.struct(F.get(F.array(*map(F.lit, samples)), i).alias("sample"), F.slice("x", i * n + 1, n).alias("x")))).alias("r"))
    return rows.select("r.sample", F.explode(F.arrays_zip("features", F.col("r.x").alias("x"))).alias("c")).select("sample", "c.features", "c.x").toDF("sample", "feature", "x")


def _rounds(state: DataFrame, shared: regression.Shared, advance, rounds: int, tolerance: float, distort: bool) -> tuple[DataFrame, regression.Shared, int, bool]:
    """Rounds of advance(state, shared, number) until no effect moves by `tolerance` posterior deviations."""
    for number in range(1, rounds + 1):
        state = materialize(advance(state, shared, number), "regression")
        sums, change = _summed(state, shared.sums)
        if change < tolerance:
            return state, shared, number, True
        shared = shared.updated(sums, distort)
    return state, shared, rounds, False


def regress(expression: DataFrame, design: DataFrame, scales: DataFrame | None = None, sample: str = "sample", feature: str = "feature", x: str = "x", deviation: str | None = None, rounds: int = 40, tolerance: float = 0.01, sweeps: int = 4, distort: bool = True, degree: int = 15, bandwidth: float = 1.0, block_features: int = 512) -> Fit:
    """Effects of the design's columns on log-expression (sample, feature, x), each feature known for every sample of the design.

    With `deviation`, x is known up to a normal error of that deviation, as bootstraps give it. scales (sample, scale) are
    taken from the fit, as sample_scales gives them. Rows with a null are refused by the check that all cells are there;
    samples that the design doesn't name are left out. A task holds block_features features of all samples.
    """
    samples, factors, matrix = design_of(design, sample)
    number = {s: i for i, s in enumerate(samples)}
    listed = F.broadcast(expression.sparkSession.createDataFrame(list(number.items()), "sample string, at int"))  # as long as the design
    cells = expression.select(F.col(sample).cast("string").alias("sample"), F.col(feature).cast("string").alias("feature"), F.col(x).cast("double").alias("x"), *([F.col(deviation).cast("double").alias("dev")] if deviation else []))
    cells = cells.where("x IS NOT NULL").join(listed, "sample").drop("sample")
    about = cells.groupBy("feature").agg(F.avg("x").alias("about"))
    shared = _start(about, matrix, _scales_of(scales, sample, samples), degree, bandwidth)
    blocks = -(-shared.features // block_features)

    def pack(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        own, names = pd.factorize(frame.feature, sort=True)
        at = frame["at"].to_numpy(), own
        table = np.full((len(samples), len(names)), np.nan)
        table[at] = frame.x
        if len(frame) != table.size or np.isnan(table).any():
            raise ValueError("each feature needs one value in each sample")
        errors = None
        if deviation:
            errors = np.full_like(table, np.nan)
            errors[at] = frame.dev
            if not (errors > 0).all():
                raise ValueError("each deviation must be positive")
        block = regression.Block.start(table, table.mean(axis=0), len(factors), errors)
        return pd.DataFrame([_row(int(key[0]), list(names), block, np.zeros(0), 0.0)])

    tasks = min(blocks, max(TASKS, -(-blocks // TASK_BLOCKS)))
    packed = cells.withColumn("block", F.pmod(F.xxhash64("feature"), F.lit(blocks)).cast("int")).repartition(tasks, "block").groupBy("block").applyInPandas(pack, _STATE)
    state, shared, n, converged = _rounds(materialize(packed, "regression"), shared, lambda s, g, _: _swept(s, g, sweeps), rounds, tolerance, distort)
    return Fit(_effects(state, factors, shared), _cells(state, samples), n, converged)


PREPARED = ("mu", "omega", "alpha", "parents", "leaves", "efflen")


def initial_expression(prepared: DataFrame, draws: int = 30, seed: int = 123_456_789) -> DataFrame:
    """prepared rows (sample, mu, omega, alpha, parents, leaves, efflen) with m, the log of the mean of draws over effective length, and log_s."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples():
                own = seed + zlib.crc32(row.sample.encode())
                x = kernels.sample_simplex(row.mu, row.omega, row.alpha, np.asarray(row.parents), np.asarray(row.leaves), draws, own) / np.asarray(row.efflen)
                m = np.log(np.maximum((x / x.sum(axis=1, keepdims=True)).mean(axis=0), 1e-16))
                yield pd.DataFrame([{"sample": row.sample, **{c: getattr(row, c) for c in PREPARED}, "m": m, "log_s": np.full(len(m), np.log(0.3))}])

    rows = prepared.select(F.col("sample").cast("string").alias("sample"), *PREPARED)
    kinds = dict(rows.dtypes)
    return rows.mapInPandas(run, ", ".join(f"{c} {kinds[c]}" for c in ("sample", *PREPARED)) + ", m array<double>, log_s array<double>")


def regress_prepared(prepared: DataFrame, features: DataFrame, design: DataFrame, scales: DataFrame | None = None, rounds: int = 30, tolerance: float = 0.02, sweeps: int = 3, ascents: int = 40, draws: int = 4, distort: bool = True, degree: int = 15, bandwidth: float = 1.0, total_deviation: float = 1e-3, block_features: int = 512, seed: int = 123_456_789) -> Fit:
    """Effects from prepared samples (sample, mu, omega, alpha, parents, leaves, efflen): expression is inferred along with them.

    features has (feature, leaf), the names of leaves 1 and on. A sample's x is a normal by feature; a round moves it some
    ascents up its stored density and the regression's normal, with noise seeded by sample and round, then updates the
    blocks. The total, which reads don't tell, is held near one with total_deviation. A task holds one sample's vectors, or
    block_features features of all samples.
    """
    samples, factors, matrix = design_of(design, "sample")
    listed = materialize(features.select(F.col("feature").cast("string").alias("feature"), F.col("leaf").cast("int").alias("leaf"), ((F.col("leaf") - 1) / block_features).cast("int").alias("block")), "leaves")
    names = listed.groupBy("block").agg(F.transform(F.array_sort(F.collect_list(F.struct("leaf", "feature"))), lambda c: c["feature"]).alias("features"))
    states = materialize(initial_expression(prepared.where(F.col("sample").cast("string").isin(samples)), seed=seed), "samples")
    if states.count() != len(samples):
        raise ValueError("each sample of the design needs one prepared row")
    number = {s: i for i, s in enumerate(samples)}

    def slices(rows: DataFrame) -> DataFrame:
        """(block, sample, x, v): each sample's vectors in pieces, one for each block."""
        piece = lambda a, b: F.slice(a, b * block_features + 1, F.lit(block_features))
        parts = F.sequence(F.lit(0), F.floor((F.size("m") - 1) / block_features).cast("int"))
        cut = rows.select("sample", F.explode(F.transform(parts, lambda b: F.struct(b.alias("block"), piece("m", b).alias("x"), piece("log_s", b).alias("log_s")))).alias("p"))
        return cut.select("p.block", "sample", "p.x", F.transform("p.log_s", lambda s: F.exp(2 * s)).alias("v"))

    def table(frame: pd.DataFrame, column: str) -> np.ndarray:
        out = frame.assign(at=frame["sample"].map(number)).sort_values("at")
        return np.stack([np.asarray(a, float) for a in out[column]])

    def begin(key: tuple, rows: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        x = table(rows, "x")
        block = regression.Block.start(x, x.mean(axis=0), len(factors), None)
        block.v = table(rows, "v")
        return pd.DataFrame([_row(int(key[0]), list(own.features.iloc[0]), block, np.zeros(0), 0.0)])

    by_block = lambda left, right, run: left.groupBy("block").cogroup(right.groupBy("block")).applyInPandas(run, _STATE)
    state = materialize(by_block(slices(states), names, begin), "regression")
    about = state.select(F.explode("about").alias("about"))
    shared = _start(about, matrix, _scales_of(scales, "sample", samples), degree, bandwidth)

    def advance(state: DataFrame, shared: regression.Shared, number_of_round: int) -> DataFrame:
        nonlocal states

        def locate(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                for row in frame.itertuples():
                    mean, precise = _block(row, len(samples)).expected(shared)
                    yield pd.DataFrame({"sample": samples, "block": row.block, "about": list(mean), "precise": [precise] * len(samples)})

        def ascend(key: tuple, rows: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
            rows, own = rows.sort_values("block"), own.iloc[0]
            tree = density.Tree(own.parents, own.leaves)
            joined = lambda c: np.concatenate([np.asarray(a, float) for a in rows[c]])
            noise = zlib.crc32(f"{seed}:{key[0]}:{number_of_round}".encode())
            m, log_s = regression.sample_step(np.array(own.m), np.array(own.log_s), tree, np.array(own.mu), np.exp(own.omega), np.array(own.alpha), np.array(own.efflen), joined("about"), joined("precise"), total_deviation, ascents, draws, noise)
            return pd.DataFrame([{**{c: own[c] for c in ("sample", *PREPARED)}, "m": m, "log_s": log_s}])

        def update(key: tuple, rows: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
            row = next(own.itertuples())
            block = _block(row, len(samples))
            block.x, block.v = table(rows, "x"), table(rows, "v")
            return pd.DataFrame([_row(row.block, list(row.features), block, *_advance(block, shared, sweeps))])

        if number_of_round > 1:
            sent = state.mapInPandas(locate, "sample string, block int, about array<double>, precise array<double>")
            states = materialize(sent.groupBy("sample").cogroup(states.groupBy("sample")).applyInPandas(ascend, states.schema), "samples")
        return by_block(slices(states), state, update)

    state, shared, n, converged = _rounds(state, shared, advance, rounds, tolerance, distort)
    return Fit(_effects(state, factors, shared), _cells(state, samples), n, converged)


def expression_tpm(expression: DataFrame) -> DataFrame:
    """(sample, feature, tpm): each sample's softmax of x, times a million."""
    top = expression.groupBy("sample").agg(F.max("x").alias("_top"))
    sized = expression.join(top, "sample").withColumn("e", F.exp(F.col("x") - F.col("_top")))
    total = sized.groupBy("sample").agg(F.sum("e").alias("_total"))
    share: Column = 1e6 * F.col("e") / F.col("_total")
    return sized.join(total, "sample").select("sample", "feature", share.alias("tpm"))
