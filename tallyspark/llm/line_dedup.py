"""Line dedup in DataFrame operations only.

Lines are exploded and hashed, distinct documents are counted per hash, lines whose key is too common are
dropped from all but the smallest document, and texts are put together again by position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, az_lower, materialize, on_plain_names, text_key


def split_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _hashed_lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """(_id, _key, pos, h1, h2) of each line whose key is long enough: 128 bits of hash, so that keys don't collide."""
    lines = docs.select("_id", "_key", F.posexplode(split_lines(F.col("_text"))).alias("pos", "line")).where(F.char_length("line") >= min_chars)
    keyed = lines.select("_id", "_key", "pos", F.btrim("line", F.lit(SPACES)).alias("line")).where(F.char_length("line") >= min_chars)
    keyed = keyed.withColumn("line", az_lower(F.col("line")))
    return keyed.select("_id", "_key", "pos", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(0x5BD1E995), "line").alias("h2"))


def drop_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10, min_docs: int = 2) -> DataFrame:
    """The input with the text replaced by its kept lines, plus n_lines and n_dropped.

    A line's key is the line without spaces at its ends, A-Z in lower case. Keys of min_chars code points that
    min_docs distinct ids hold stay only in the smallest of these ids (there every time). Null and empty texts are
    one empty line and become "". Rows with a null id are no holders and keep all lines; rows that share an id are
    one holder, and each gives a row; an empty table gives none. Other columns pass; one called n_lines or n_dropped is replaced.

    Hashes of lines are written once to the shared folder. Distinct holders are counted in two steps, so that a common
    line is spread by document before its count; common lines are written, so that their join is a plain one that is
    split at run time where a line is hot.
    """
    names = {c: f"_c{i}" for i, c in enumerate(docs.columns)}
    plain = docs.toDF(*names.values())
    ident, body = F.col(names[id_col]), F.col(names[text_col])
    base = plain.select(ident.alias("_id"), text_key(body).alias("_key"), body.alias("_text"))
    lines = materialize(_hashed_lines(base.where(F.col("_id").isNotNull()), min_chars), "lines")
    holders = lines.groupBy("h1", "h2").agg(F.countDistinct("_id").alias("n"), F.min("_id").alias("first"))
    common = materialize(holders.where(F.col("n") >= min_docs).select("h1", "h2", "first"), "common-lines")
    doomed = lines.join(common, ["h1", "h2"]).where(F.col("_id") > F.col("first"))
    places = doomed.groupBy("_id", "_key").agg(F.collect_set("pos").alias("_gone"))
    joined = plain.withColumns({"_id": ident, "_key": text_key(body)}).join(places, ["_id", "_key"], "left")
    parts = split_lines(body)
    n = F.size(parts)
    kept = F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), n - 1), F.col("_gone")), lambda i: F.get(F.col("_parts"), i)), "\n")
    joined = joined.withColumn("_parts", F.when(F.col("_gone").isNotNull(), parts))
    text = F.when(F.col("_gone").isNull(), F.coalesce(body, F.lit(""))).otherwise(kept)
    return joined.select(
        *((text if c == text_col else F.col(names[c])).alias(c) for c in docs.columns if c not in ("n_lines", "n_dropped") or c in (id_col, text_col)),
        n.cast("long").alias("n_lines"),
        F.coalesce(F.size("_gone"), F.lit(0)).cast("long").alias("n_dropped"),
    )


def without_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The input with the text replaced by its kept lines, and nothing else changed; nulls, repeats and empty tables as above, columns of any name."""
    return on_plain_names(docs, lambda d, name: drop_repeated_lines(d, name(id_col), name(text_col), **options))
