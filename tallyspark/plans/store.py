"""The side store of genes, splicing features and effects: Parquet tables in a folder, read as temporary views."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

TABLES = {
    "genes": "gene_num, gene_id, gene_name",
    "transcripts": "transcript_num, transcript_id, gene_num, seqname, strand",
    "exons": "transcript_num, first, last",
    "splicing_features": "feature_num, type, seqname, first, last",
    "splicing_features_including": "feature_num, transcript_num",
    "splicing_features_excluding": "feature_num, transcript_num",
    "effects": "factor, feature_num, w",
    "splicing_prop_span": "feature_num, span",
    "splicing_prop_credible_interval": "feature_num, lower, upper",
}


def write(tables: dict[str, DataFrame], folder: str) -> None:
    """Each table with the columns that TABLES gives it. A table is written whole beside the old one and then takes its name.

    A reader that has listed the old files meets an error, never half of a table. Tables change one after the other.
    """
    for name, df in tables.items():
        spark, new = df.sparkSession, f"{folder}/.{name}-{uuid.uuid4().hex}"
        df.select(*TABLES[name].split(", ")).write.parquet(new)
        path = spark._jvm.org.apache.hadoop.fs.Path
        old, new = path(f"{folder}/{name}"), path(new)
        files = old.getFileSystem(spark._jsc.hadoopConfiguration())
        files.delete(old, True)
        if not files.rename(new, old):
            raise OSError(f"{folder}/{name} could not be replaced; it is in {new}")


def attach(spark: SparkSession, folder: str, prefix: str = "") -> None:
    """The folder's tables as views `prefix` + name: several stores can be open at once. A store need not have every table."""
    for name in TABLES:
        try:
            spark.read.parquet(f"{folder}/{name}").createOrReplaceTempView(prefix + name)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
