"""Interval joins, islands, gaps and deduplication of positioned rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def _bins(df: DataFrame, first: str, last: str, width: int) -> DataFrame:
    return df.withColumn("_bin", F.explode(F.sequence(F.floor(F.col(first) / width), F.floor(F.col(last) / width))))


def containment_join(outer: DataFrame, inner: DataFrame, key: str, width: int) -> DataFrame:
    """Pairs where outer [o_first, o_last] contains inner [i_first, i_last] on the same key.

    The outer side is put in every bin it covers, the inner one only in the bin of its first position: a pair meets
    exactly once, by an equi-join on (key, bin), so that a long key is spread over its bins.
    """
    left = _bins(outer, "o_first", "o_last", width)
    right = inner.withColumn("_bin", F.floor(F.col("i_first") / width))
    return left.join(right, [key, "_bin"]).where("o_first <= i_first and i_last <= o_last").drop("_bin")


def overlap_join(outer: DataFrame, inner: DataFrame, key: str, width: int) -> DataFrame:
    """Pairs that share a position; each is kept in the bin of its first shared position alone."""
    joined = _bins(outer, "o_first", "o_last", width).join(_bins(inner, "i_first", "i_last", width), [key, "_bin"])
    return joined.where("o_first <= i_last and i_first <= o_last").where(F.col("_bin") == F.floor(F.greatest("o_first", "i_first") / width)).drop("_bin")


def islands(df: DataFrame, keys: list[str], first: str, last: str, gap: int = 0) -> DataFrame:
    """(keys, first, last, members) of unions of intervals that overlap, or lie at most gap apart."""
    before = W.partitionBy(*keys).orderBy(first, last)
    reach = F.max(last).over(before.rowsBetween(W.unboundedPreceding, -1))
    flagged = df.withColumn("_new", F.coalesce((F.col(first) > reach + gap).cast("int"), F.lit(1)))
    numbered = flagged.withColumn("_island", F.sum("_new").over(before.rowsBetween(W.unboundedPreceding, 0)))
    return numbered.groupBy(*keys, "_island").agg(F.min(first).alias("first"), F.max(last).alias("last"), F.count("*").alias("members")).drop("_island")


def gap_clusters(df: DataFrame, keys: list[str], at: str, gap: float) -> DataFrame:
    """(keys, first, last, members): points in order belong together while each is at most gap after the one before."""
    order = W.partitionBy(*keys).orderBy(at)
    flagged = df.withColumn("_new", F.coalesce((F.col(at) - F.lag(at).over(order) > gap).cast("int"), F.lit(1)))
    numbered = flagged.withColumn("_cluster", F.sum("_new").over(order.rangeBetween(W.unboundedPreceding, 0)))
    return numbered.groupBy(*keys, "_cluster").agg(F.min(at).alias("first"), F.max(at).alias("last"), F.count("*").alias("members")).drop("_cluster")


def pair_mates(mates: DataFrame, keys: list[str], most: int = 500_000) -> DataFrame:
    """(keys, first, last, single): first and second mates of a read whose span is at most `most`; a mate is single only if there is no other kind."""
    one, two = mates.where("mate = 1").drop("mate"), mates.where("mate = 2").drop("mate")
    both = one.withColumnsRenamed({"left": "l1", "right": "r1"}).join(two.withColumnsRenamed({"left": "l2", "right": "r2"}), keys)
    span = both.select(*keys, F.least("l1", "l2").alias("first"), F.greatest("r1", "r2").alias("last"), F.lit(False).alias("single")).where(F.col("last") - F.col("first") <= most)
    alone = one.join(two, keys, "left_anti").unionByName(two.join(one, keys, "left_anti"))
    return span.distinct().unionByName(alone.select(*keys, F.col("left").alias("first"), F.col("right").alias("last"), F.lit(True).alias("single")).distinct())


def drop_adjacent_equal(df: DataFrame, keys: list[str], order: list[str], same: list[str]) -> DataFrame:
    """Rows whose `same` columns differ from the row before them within keys."""
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_equal", F.coalesce(F.lag(F.struct(*same)).over(w) == F.struct(*same), F.lit(False))).where("not _equal").drop("_equal")


def exon_extension(exons: DataFrame) -> DataFrame:
    """Exons (gene, first, last, rank of initial/terminal): initial ones that share a last begin at the smallest first, terminal ones that share a first end at the largest last."""
    initial = F.when(F.col("initial"), F.min(F.when(F.col("initial"), F.col("first"))).over(W.partitionBy("gene", "last"))).otherwise(F.col("first"))
    terminal = F.when(F.col("terminal"), F.max(F.when(F.col("terminal"), F.col("last"))).over(W.partitionBy("gene", "first"))).otherwise(F.col("last"))
    return exons.withColumns({"new_first": initial, "new_last": terminal})
