"""Identifiers, orders, joins and set operations over annotation and alignment tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..plans.scratch import materialize
from .intervals import overlap_join


#: Keys of a range that is numbered by itself.
KEYS = 250_000


def dense_ids(rows: DataFrame, keys: list[str], name: str = "id") -> DataFrame:
    """(keys, name): distinct keys numbered from 1 in their order, without a gap.

    Keys are dealt out by ranges of some KEYS; a task numbers its own, and the counts of the ranges before it, one row a range, are added.
    """
    own = materialize(rows.select(*keys).distinct(), "keys")
    ranges = max(1, -(-own.count() // KEYS))
    ranged = materialize(own.repartitionByRange(ranges, *keys).withColumn("_range", F.spark_partition_id()), "ranges")
    sizes = ranged.groupBy("_range").agg(F.count("*").alias("_n"))
    offsets = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    numbered = ranged.repartition(ranges, "_range").withColumn(name, F.row_number().over(W.partitionBy("_range").orderBy(*keys)))
    return numbered.join(F.broadcast(offsets), "_range").select(*keys, (F.col(name) + F.col("_before")).alias(name))


def in_alignment_order(alignments: DataFrame, place: str, order: list[str]) -> DataFrame:
    """Alignments in blocks by place, one after the other in each: a block is one partition's run of rows."""
    return alignments.repartition(place).sortWithinPartitions(place, *order)


def duplicate_transcripts(exons: DataFrame) -> DataFrame:
    """(transcript, kept): transcripts with the exons of another on the same sequence and strand, and the smallest of these, which stays."""
    whole = exons.groupBy("transcript", "seqname", "strand").agg(F.array_sort(F.collect_list(F.struct("first", "last"))).alias("exons"))
    least = whole.groupBy("seqname", "strand", "exons").agg(F.min("transcript").alias("kept"), F.count("*").alias("n")).where("n > 1")
    return whole.join(least, ["seqname", "strand", "exons"]).where("transcript <> kept").select("transcript", "kept")


def overlapping_exons(exons: DataFrame, width: int = 1000) -> DataFrame:
    """Ordered pairs, each with itself too, of distinct exons of one sequence and strand that share a position."""
    keyed = exons.select(F.concat_ws("|", "seqname", "strand").alias("place"), "first", "last").distinct()
    return overlap_join(keyed.withColumnsRenamed({"first": "o_first", "last": "o_last"}), keyed.withColumnsRenamed({"first": "i_first", "last": "i_last"}), "place", width)


def on_both_sides(one: DataFrame, two: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Both tables without the sequences that the other one lacks."""
    return one.join(two.select(key).distinct(), key, "left_semi"), two.join(one.select(key).distinct(), key, "left_semi")


def middle_member(rows: DataFrame, group: str, member: str) -> DataFrame:
    """(group, middle): the element at n div 2 + 1 of a group's members in order."""
    w = W.partitionBy(group)
    ranked = rows.withColumns({"at": F.row_number().over(w.orderBy(member)), "n": F.count("*").over(w)})
    return ranked.where(F.col("at") == F.floor(F.col("n") / 2) + 1).select(group, F.col(member).alias("middle"))


def incidence(pairs: DataFrame, row: str, column: str) -> DataFrame:
    """(i, j): the distinct pairs as positions of a 0/1 matrix, rows and columns numbered in their order."""
    p = pairs.select(row, column).distinct()
    return p.join(dense_ids(p, [row], "i"), row).join(dense_ids(p, [column], "j"), column).select("i", "j")


def pad_features(features: DataFrame, all_members: DataFrame, feature: str, member: str) -> DataFrame:
    """(feature, member): the pairs, and for each member without one a feature of its own, numbered on from the largest."""
    missing = dense_ids(all_members.join(features, member, "left_anti"), [member], "_at")
    most = features.agg(F.coalesce(F.max(feature), F.lit(0)).alias("_most"))
    return features.select(feature, member).unionByName(missing.crossJoin(F.broadcast(most)).select((F.col("_most") + F.col("_at")).alias(feature), member))


def locus(seqname: Column, first: Column, last: Column) -> Column:
    """seqname:least-greatest."""
    return F.concat(seqname, F.lit(":"), F.least(first, last).cast("string"), F.lit("-"), F.greatest(first, last).cast("string"))


def hash_unit(*parts: Column | str) -> Column:
    """A number in [0, 1) from the parts, the same in every run."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts)).cast("binary")), 1, 8), 16, 10).cast("double") / 2.0**32


SPLICE_TYPES = ("cassette_exon", "mutex_exon", "alt_donor_acceptor_site", "retained_intron", "alt_5p_end", "alt_3p_end")


def site_type(side: Column, strand: Column, forward: Column | int = 0) -> Column:
    """The name of an alternative site: an exon's start is an acceptor on the forward strand and a donor on the other."""
    return F.when((side == "start") == (strand == F.lit(forward)), "alt_acceptor_site").otherwise("alt_donor_site")


def number_events(events: DataFrame, keys: list[str]) -> DataFrame:
    """Events (type, keys) with feature_num: numbered by type in SPLICE_TYPES' order, then by keys."""
    rank = F.array_position(F.array(*map(F.lit, SPLICE_TYPES)), F.col("type"))
    return events.join(dense_ids(events.withColumn("_rank", rank), ["_rank", "type", *keys], "feature_num").drop("_rank"), ["type", *keys])
