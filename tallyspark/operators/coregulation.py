"""Co-regulation: which features' expression is correlated, uncertainty included."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import graph

#: Features of a block with scales, and rows of a block that are multiplied at once: a task holds their correlations with another block.
BLOCK = 1000
#: Numbers of a block without scales, and most features of it.
NUMBERS, MOST = 512_000, 8000
#: Rows of a block of a group, and pairs of a task, about.
MEMBERS, PAIRS = 3000, 5_000_000


def _standardised(keys, loc: np.ndarray, scale: np.ndarray, rep: int, seed: int) -> np.ndarray:
    """One draw of each feature, centred and of length one; a feature's noise depends on its key, never on its block."""
    drawn = loc
    if scale.any():
        noise = [np.random.default_rng(int.from_bytes(hashlib.md5(f"{seed}:{rep}:{k}".encode()).digest()[:8], "little")).standard_normal(loc.shape[1]) for k in keys]
        drawn = loc + scale * np.stack(noise)
    centred = drawn - drawn.mean(axis=1, keepdims=True)
    length = np.linalg.norm(centred, axis=1, keepdims=True)
    return np.divide(centred, length, out=np.zeros_like(centred), where=length > 0)


def correlated_pairs(features: DataFrame, key: str, loc: str, scale: str | None = None, least: float = 0.75, share: float = 0.9, reps: int = 20, seed: int = 0) -> DataFrame:
    """(u, v, hits) with u < v: pairs whose correlation over samples is `least` or more in size in at least `share` of `reps` draws.

    features has one row per key: arrays over the same samples of a normal's location and, if given, scale. Without scales
    one draw is enough, and only locations are sent, as they are. Each pair of blocks is one task; a feature goes to as many
    tasks as there are blocks. Blocks without scales are larger: their correlations are made BLOCK rows at a time.
    """
    n, wide = features.agg(F.count("*"), F.max(F.size(loc))).first()
    most = BLOCK if scale else max(BLOCK, min(MOST, NUMBERS // max(1, wide or 1)))
    blocks = max(1, math.ceil(n / most), min(8, math.ceil(n / BLOCK)))  # eight: 36 tasks of few features
    reps = reps if scale else 1
    needed = math.ceil(share * reps)
    own = F.pmod(F.xxhash64(F.lit("block"), key), F.lit(blocks)).cast("int")
    widths = [F.col(scale).cast("array<double>").alias("scale")] if scale else []
    rows = features.select(F.col(key).alias("k"), F.col(loc).cast("array<double>" if scale else features.schema[loc].dataType).alias("loc"), *widths, own.alias("own"))
    other = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    placed = rows.withColumn("other", other).withColumns({"a": F.least("own", "other"), "b": F.greatest("own", "other")})
    kind = dict(features.dtypes)[key]

    def screen(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = int(pdf["a"].iloc[0]), int(pdf["b"].iloc[0])
        sides = [pdf[pdf["own"] == i] for i in (a, b)]
        if sides[0].empty or sides[1].empty:
            return pd.DataFrame({"u": [], "v": [], "hits": []})
        locs = [np.stack(s["loc"].to_list()).astype(np.float64) for s in sides]
        arrays = [(s["k"].to_numpy(), x, np.stack(s["scale"].to_list()) if scale else np.zeros(1)) for s, x in zip(sides, locs, strict=True)]
        if scale:
            hits = np.zeros((len(sides[0]), len(sides[1])), np.int32)
            for rep in range(reps):
                left, right = (_standardised(*x, rep, seed) for x in arrays)
                hits += np.abs(left @ right.T) >= least
            i, j = np.nonzero(hits >= needed)
            n = hits[i, j]
        else:
            left, right = (_standardised(*x, 0, seed) for x in arrays)
            found = [np.nonzero(np.abs(left[at : at + BLOCK] @ right.T) >= least) for at in range(0, len(left), BLOCK)]
            i = np.concatenate([x + BLOCK * at for at, (x, _) in enumerate(found)])
            j = np.concatenate([y for _, y in found])
            n = np.ones(len(i), np.int32)
        u, v = arrays[0][0][i], arrays[1][0][j]
        if a == b:
            keep = u < v
            u, v, n = u[keep], v[keep], n[keep]
        swap = u > v
        return pd.DataFrame({"u": np.where(swap, v, u), "v": np.where(swap, u, v), "hits": n})

    return placed.groupBy("a", "b").applyInPandas(screen, f"u {kind}, v {kind}, hits int")


def modules(pairs: DataFrame) -> DataFrame:
    """(node, component) of correlated features."""
    return graph.connected_components(pairs)


def exclusions(features: DataFrame, feature: str, gene: str) -> DataFrame:
    """(u, v) with u < v: features of one gene, whose correlation says nothing about regulation."""
    f = features.select(feature, gene).distinct()
    pairs = f.withColumnRenamed(feature, "u").join(f.withColumnRenamed(feature, "v"), gene).where("u < v")
    return pairs.select("u", "v").distinct()


def exclusion_classes(features: DataFrame, feature: str, gene: list[str]) -> DataFrame:
    """(gene, feature, class_id, n_links): what exclusions says in one row a feature of a gene: it is paired with all others of its class, which is called by its smallest feature."""
    f = features.select(*gene, feature).dropna().distinct()
    classes = f.groupBy(*gene).agg(F.min(feature).alias("class_id"), (F.count("*") - 1).alias("n_links"))
    return f.join(classes, gene)


def pairs_within(features: DataFrame, feature: str, keys: list[str]) -> DataFrame:
    """(keys, u, v) with u < v: every pair of rows that agree in all keys. Null keys agree with none.

    A group is dealt into blocks of some MEMBERS rows, and a pair of blocks is what a task joins, some of them at once: tasks are
    told by the number of pairs, as the bytes of a few features say nothing of it, and a large group is spread over many.
    """
    rows = features.select(*keys, F.col(feature).alias("u")).dropna()
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("n"))
    pairs = sizes.agg(F.sum(F.col("n").cast("double") * F.col("n") / 2)).first()[0] or 0
    tasks = max(1, math.ceil(pairs / PAIRS))
    sized = rows.join(sizes.withColumn("blocks", F.ceil(F.col("n") / MEMBERS)), keys).withColumn("block", F.pmod(F.xxhash64("u"), "blocks"))
    cells = [*keys, "low", "high"]
    first = sized.select(*keys, "u", F.col("block").alias("low"), F.explode(F.sequence("block", F.col("blocks") - 1)).alias("high"))
    second = sized.select(*keys, F.col("u").alias("v"), F.explode(F.sequence(F.lit(0), F.col("block"))).alias("low"), F.col("block").alias("high"))
    met = first.repartition(tasks, *cells).join(second.repartition(tasks, *cells).hint("merge"), cells)
    # Within a block each pair is met from both ends; across two, once, and from either side.
    met = met.where((F.col("low") < F.col("high")) | (F.col("u") < F.col("v")))
    return met.select(*keys, F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
