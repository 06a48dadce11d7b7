"""Deterministic sampling, splitting and summaries of draws."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def seeded_hash(key: str, seed: str) -> Column:
    """A hash that every engine computes alike."""
    return F.md5(F.concat_ws(":", F.lit(seed), F.col(key).cast("string")).cast("binary"))


def keep_random_keys(df: DataFrame, key: str, n: int, seed: str = "0") -> DataFrame:
    """All rows of the n distinct keys with the smallest seeded hashes: a reservoir that doesn't depend on order."""
    chosen = df.select(key).distinct().withColumn("_h", seeded_hash(key, seed)).orderBy("_h").limit(n).select(key)
    return df.join(chosen, key, "left_semi")


def stratified_split(df: DataFrame, key: str, stratum: str, numerator: int, denominator: int, seed: str = "0") -> DataFrame:
    """df with `training`: in each stratum the rounded-down share of rows, plus one more for the strata with the largest remainders (ties by name) until the total share is met."""
    sizes = df.groupBy(stratum).agg(F.count("*").alias("n"))
    parts = sizes.withColumns({"base": F.floor(F.col("n") * numerator / denominator), "rest": F.col("n") * numerator % denominator})
    total = parts.agg((F.floor(F.sum("n") * numerator / denominator) - F.sum("base")).alias("more"))
    order = W.orderBy(F.desc("rest"), stratum)  # one row a stratum
    quota = parts.withColumn("at", F.row_number().over(order)).crossJoin(F.broadcast(total)).select(stratum, (F.col("base") + (F.col("at") <= F.col("more")).cast("long")).alias("quota"))
    ranked = df.withColumn("_at", F.row_number().over(W.partitionBy(stratum).orderBy(seeded_hash(key, seed), key)))
    return ranked.join(quota, stratum).withColumn("training", F.col("_at") <= F.col("quota")).drop("_at", "quota")


def split_rhat(draws: DataFrame, keys: list[str], order: str, value: str, chain: str | None = None) -> DataFrame:
    """(keys, rhat): between and within variance of the two halves of each chain; with `chain`, of the halves of all chains."""
    own = [*keys, *([chain] if chain else [])]
    halves = draws.withColumn("_half", F.when(F.row_number().over(W.partitionBy(*own).orderBy(order)) * 2 <= F.count("*").over(W.partitionBy(*own)), 0).otherwise(1))
    per = halves.groupBy(*own, "_half").agg(F.count("*").alias("m"), F.avg(value).alias("mean"), F.var_samp(value).alias("var"))
    both = per.groupBy(*keys).agg(F.min("m").alias("m"), F.avg("var").alias("within"), F.var_samp("mean").alias("between"))
    pooled = (F.col("m") - 1) / F.col("m") * F.col("within") + F.col("between")
    return both.where("m > 1 and within > 0").select(*keys, F.sqrt(pooled / F.col("within")).alias("rhat"))


def draw_quantiles(draws: DataFrame, keys: list[str], value: str, at: tuple[float, ...]) -> DataFrame:
    """(keys, q<percent>): exact quantiles with linear interpolation."""
    return draws.groupBy(*keys).agg(*(F.percentile(value, F.lit(q)).alias(f"q{round(100 * q):02d}") for q in at))


def bootstrap_summary(draws: DataFrame, keys: list[str], value: str, floor: float = 0.5) -> DataFrame:
    """(keys, mean, std): exp of the mean log, and the deviation of the log, at least floor."""
    return draws.where(F.col(value) > 0).groupBy(*keys).agg(F.exp(F.avg(F.log(value))).alias("mean"), F.greatest(F.lit(floor), F.coalesce(F.stddev_samp(F.log(value)), F.lit(0.0))).alias("std"))


def quantile_histogram_ratio(df: DataFrame, value: str, label: str, bins: int = 15) -> DataFrame:
    """(bin, foreground, background, ratio): rows put in bins of equal weight; the ratio of the labels' shares, with a pseudocount of one."""
    edges = df.agg(F.percentile(value, F.array(*(F.lit(i / bins) for i in range(1, bins)))).alias("edges"))
    binned = df.crossJoin(F.broadcast(edges)).withColumn("bin", F.size(F.filter("edges", lambda e: e < F.col(value))))
    counts = binned.groupBy("bin").agg(F.count_if(F.col(label) == 1).alias("foreground"), F.count_if(F.col(label) == 0).alias("background"))
    total = counts.agg(F.sum("foreground").alias("f"), F.sum("background").alias("b"))
    ratio = ((F.col("foreground") + 1) / (F.col("f") + bins)) / ((F.col("background") + 1) / (F.col("b") + bins))
    return counts.crossJoin(F.broadcast(total)).select("bin", "foreground", "background", ratio.alias("ratio"))
