"""Exact dedup in DataFrame operations only, by progressive refinement.

Rows are grouped by length, rows of a shared length by a hash of their beginning, and only rows that share both
have their whole text hashed. Texts never move: what is shuffled is numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: White space that one space doesn't stand for already: a run of two or more, or one other than a space.
ODD_SPACE = r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+"
RESULTS = ("keep_id", "group_size", "kept")


def normalised(text: Column) -> Column:
    """The text with each run of white space as one space; a null is empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), ODD_SPACE, " ")


def _signed(docs: DataFrame, text: Column, prefix: int) -> DataFrame:
    """docs with _normal, its length and a hash of its first characters."""
    out = docs.withColumn("_normal", normalised(text))
    return out.withColumns({"_length": F.char_length("_normal"), "_start": F.xxhash64(F.substring("_normal", 1, prefix))})


def _place(words: int) -> Column:
    """A bit's number among 64 * words, from length and beginning."""
    return F.pmod(F.xxhash64("_length", "_start"), F.lit(64 * words))


def shared_starts(signatures: DataFrame) -> DataFrame:
    """(_length, _start) that several rows share, found among the lengths that several rows share."""
    lengths = materialize(signatures.groupBy("_length").count().where("count > 1").select("_length"), "lengths")
    return signatures.join(lengths, "_length").groupBy("_length", "_start").count().where("count > 1")


def mark_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix: int = 64, filter_words: int = 1 << 18) -> DataFrame:
    """The input with keep_id, group_size and kept.

    Texts are equal when they are the same after each run of white space became one space. keep_id is the smallest id
    of a group, group_size its number of rows, kept whether a row has that id. Null and empty texts are equal to each
    other; a text of white space alone is one space, and so another text. Null ids are larger than all others: such a
    row is kept if its group has no id at all, or if it is alone. Rows that share an id and a text share the verdict,
    and each counts. An empty table gives none. Other columns pass, those named as a result are replaced; an id or
    text column of such a name is refused.

    What lengths and beginnings survive goes to the scans as a bit table of at most filter_words rows, the only thing
    that is broadcast: a bit that others share costs the hash of a text and changes no result. Hashes of the survivors'
    whole texts are counted with sums on the map side, and groups are written, so that a hot group's join can be split.
    """
    if {id_col, text_col} & set(RESULTS):
        raise ValueError(f"id and text columns can't be called {', '.join(RESULTS)}")
    names = {c: f"_c{i}" for i, c in enumerate(docs.columns)}
    plain = docs.toDF(*names.values())
    ident, text = F.col(names[id_col]), F.col(names[text_col])
    signatures = materialize(_signed(plain, text, prefix).select("_length", "_start"), "signatures")
    bit = shared_starts(signatures).select(_place(filter_words).alias("_bit"))
    one = lambda b: F.expr(f"shiftleft(1L, CAST({b} % 64 AS INT))")
    table = materialize(bit.groupBy((F.col("_bit") / 64).cast("long").alias("_word")).agg(F.bit_or(one("_bit")).alias("_mask")), "filter")
    placed = _signed(plain, text, prefix).withColumn("_bit", _place(filter_words)).withColumn("_word", (F.col("_bit") / 64).cast("long"))
    marked = placed.join(F.broadcast(table), "_word", "left").withColumn("_shared", F.coalesce(F.col("_mask").bitwiseAND(one("_bit")) != 0, F.lit(False)))
    hashed = marked.where("_shared").withColumn("_full", F.sha2("_normal", 256))
    groups = hashed.groupBy("_full").agg(F.min(ident).alias("_keep"), F.count("*").alias("_size")).where("_size > 1")
    groups = materialize(groups.withColumn("_found", F.lit(True)), "copies")
    found = hashed.select(*names.values(), "_full").join(groups, "_full", "left")
    own = [F.col(names[c]).alias(c) for c in docs.columns if c not in RESULTS]
    keep = F.when(F.col("_found"), F.col("_keep")).otherwise(ident)
    several = found.select(*own, keep.alias("keep_id"), F.coalesce("_size", F.lit(1)).cast("long").alias("group_size"), keep.eqNullSafe(ident).alias("kept"))
    alone = marked.where("NOT _shared").select(*own, ident.alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"))
    return several.unionByName(alone)


def keep_one_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows that mark_copies keeps, with their own columns: one of each group of ids; rows that share an id and a text are told apart by nothing, and stay together."""
    names = {c: f"_c{i}" for i, c in enumerate(docs.columns)}
    kept = mark_copies(docs.toDF(*names.values()), names[id_col], names[text_col], **options).where("kept")
    return kept.select(*names.values()).toDF(*names)
