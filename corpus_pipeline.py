"""A training-data pipeline: five stages, each over all that the stage before it kept."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm import common, decontaminate, line_dedup, near_dedup, packing, quality


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects; null and empty texts go, repeated rows stay or go together, an empty table stays empty."""
    return quality.keep_good(docs)


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents without lines of an earlier one; n_chars, if there, is that of the new text. Null texts become empty; an empty table stays empty."""
    out = line_dedup.without_repeated_lines(docs)
    return out.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else out


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group; all rows of a kept id and of a null id stay, an empty table stays empty."""
    return near_dedup.keep_one_each(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any benchmark window; null texts have no words and stay, an empty table or benchmark removes nothing."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of full sequences; a null or empty text is its end id alone, repeated rows are packed each, an empty table gives no rows."""
    return packing.pack(docs)


STAGES = [
    ("quality_rules", good_documents),
    ("line_dedup", without_repeated_lines),
    ("minhash_near_dedup", one_of_each_group),
    ("benchmark_decontamination", without_benchmark),
    ("packing", packed),
]

#: MinHash components and token packing have no SQL form; the test holds run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return functools.reduce(lambda d, stage: common.materialize(stage[1](spark, d, sf_dir), stage[0]), STAGES, docs)
