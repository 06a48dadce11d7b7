"""Writers of result tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_tpm(estimates: DataFrame, path: str) -> None:
    """CSV transcript_id, tpm."""
    estimates.select("transcript_id", "tpm").write.mode("overwrite").csv(path, header=True)


def write_prepared(prepared: DataFrame, path: str) -> None:
    """Prepared samples, one row each with array columns, by sample; version 2 is the only one that is read."""
    prepared.withColumn("version", F.lit(2)).write.mode("overwrite").partitionBy("sample").parquet(path)


def read_prepared(spark, path: str) -> DataFrame:
    rows = spark.read.parquet(path)
    return rows.where(F.assert_true(F.col("version") == 2, F.lit("prepared sample of another version")).isNull())


def write_likelihood(likelihood: DataFrame, efflens: DataFrame, path: str) -> None:
    """A sample's likelihood (read, feature, prob) and effective lengths (feature, efflen), two tables of a folder."""
    likelihood.select("read", "feature", "prob").write.parquet(f"{path}/likelihood")
    efflens.select("feature", "efflen").write.parquet(f"{path}/efflens")


def read_likelihood(spark, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/likelihood"), spark.read.parquet(f"{path}/efflens")


def write_effects(effects: DataFrame, path: str) -> None:
    """CSV of effects in log2: natural-log columns are divided by ln 2."""
    log2 = [c for c in ("min_effect_size", "mean_effect_size", "lower_credible", "upper_credible") if c in effects.columns]
    effects.withColumns({c: F.col(c) / F.log(F.lit(2.0)) for c in log2}).write.csv(path, header=True)
