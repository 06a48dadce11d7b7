"""Effect sizes of fitted regressions: credible bounds, probabilities of a change, and the least effect that is covered."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bounds come from Student's t with this many degrees of freedom. It is even, so that the distribution has a closed form.
FREEDOM = 10
_TERMS = [math.comb(2 * k, k) / 4.0**k for k in range(FREEDOM // 2)]


def t_cdf(t: Column) -> Column:
    """Student's distribution function with FREEDOM degrees."""
    shrink = 1 / (1 + t * t / FREEDOM)
    series = F.lit(_TERMS[-1])
    for c in reversed(_TERMS[:-1]):
        series = series * shrink + c
    return 0.5 + 0.5 * t / F.sqrt(FREEDOM + t * t) * series


def t_quantile(p: float) -> float:
    """Its inverse, by bisection."""
    cdf = lambda t: 0.5 + 0.5 * t / math.sqrt(FREEDOM + t * t) * sum(c * (1 + t * t / FREEDOM) ** -k for k, c in enumerate(_TERMS))
    low, high = -1e3, 1e3
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if cdf(middle) < p else (low, middle)
    return (low + high) / 2


_erf = np.vectorize(math.erf, otypes=[float])


def least_effects(loc: np.ndarray, scale: np.ndarray, coverage: float = 0.1, tolerance: float = 1e-3, most: float = 20.0) -> np.ndarray:
    """d such that a normal effect lies within d of zero with the probability `coverage`; at most `most`.

    Bisection ends once the probability at a midpoint is within the relative tolerance; the middle of the half that is left is returned.
    """
    low, high, open_ = np.zeros(len(loc)), np.full(len(loc), most), np.ones(len(loc), bool)
    for _ in range(60):
        if not open_.any():
            break
        at = np.flatnonzero(open_)
        d = (low[at] + high[at]) / 2
        width = scale[at] * math.sqrt(2)
        covered = (_erf((d - loc[at]) / width) - _erf((-d - loc[at]) / width)) / 2
        over = covered > coverage
        high[at], low[at] = np.where(over, d, high[at]), np.where(over, low[at], d)
        open_[at] = np.abs(covered - coverage) > tolerance * coverage
    return (low + high) / 2


def effect_sizes(fitted: DataFrame, lower: float = 0.025, upper: float = 0.975, effect: float | None = None, coverage: float = 0.1) -> DataFrame:
    """fitted's columns, which include loc and scale in natural logs, with min_, mean_effect_size and bounds in log2.

    With an effect (a fold change), also the probabilities of a fall and of a rise beyond it, and prob_de, the larger one.
    """

    @F.pandas_udf("double")
    def least(loc: pd.Series, scale: pd.Series) -> pd.Series:
        return pd.Series(least_effects(loc.to_numpy(float), scale.to_numpy(float), coverage))

    return credible_effects(fitted.withColumn("min_effect_size", least("loc", "scale") / math.log(2)), lower, upper, effect)


def credible_effects(fitted: DataFrame, lower: float = 0.025, upper: float = 0.975, effect: float | None = None) -> DataFrame:
    """effect_sizes() without the least effect: all of it is column arithmetic."""
    bound = lambda q: (F.col("loc") + F.lit(t_quantile(q)) * F.col("scale")) / math.log(2)
    out = fitted.withColumns({"mean_effect_size": F.col("loc") / math.log(2), "lower_credible": bound(lower), "upper_credible": bound(upper)})
    if effect is None:
        return out
    size = math.log(abs(effect))
    fall, rise = t_cdf((-size - F.col("loc")) / F.col("scale")), t_cdf((F.col("loc") - size) / F.col("scale"))
    return out.withColumns({"prob_de": F.greatest(fall, rise), "prob_down_de": fall, "prob_up_de": rise})


def class_probabilities(scores: DataFrame, keys: list[str], label: str, distance: str) -> DataFrame:
    """(keys, label, p): density of Student's t at the distances of each class, normalised over classes; equal shares where all are zero."""
    from pyspark.sql import Window as W

    w = W.partitionBy(*keys)
    density = scores.withColumn("_d", F.pow(1 + F.pow(F.col(distance), 2) / FREEDOM, -(FREEDOM + 1) / 2))
    total = F.sum("_d").over(w)
    return density.select(*keys, label, F.when(total > 0, F.col("_d") / total).otherwise(1 / F.count("*").over(w)).alias("p"))


def kernel_weights(values: DataFrame, key: str, x: str, knots: list[float], bandwidth: float) -> DataFrame:
    """(key, knot, weight): Gaussian kernel weights of a value at each knot, which sum to one however far off it is; knots are a short list."""
    exponents = F.array(*(-F.pow((F.col(x) - k) / bandwidth, 2) / 2 for k in knots))
    densities = F.transform(exponents, lambda e: F.exp(e - F.array_max(exponents)))
    total = F.aggregate("_d", F.lit(0.0), lambda s, d: s + d)
    return values.withColumn("_d", densities).select(key, F.posexplode(F.transform("_d", lambda d: d / total)).alias("knot", "weight"))
