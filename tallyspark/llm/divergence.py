"""Audit of how sources of a language differ in their words.

Divergences are summed in a cube: a task owns one cell of (block of groups, block of groups, block of terms). The slices
(block of groups, block of terms) are sent to every cell that they bound, each cell adds up its own terms for all pairs of
its groups, and sums over the cells along the axis of terms give the divergence of each pair.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, materialize, word_bytes

TERM_BYTES = word_bytes(LOWER)
#: Terms that a worker counts before it sends them on, and bytes of long ones among them.
COUNTED, LONG_BYTES = 400_000, 16 << 20
WHOLE = 1_000_000_000


def terms_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(TERM_BYTES).split()


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, n, docs) of what came so far; the empty term stands for the group itself."""
    groups: dict[tuple[str, str], tuple[Counter, Counter]] = {}
    held = long_bytes = 0

    def flush() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in groups.items():
            terms = [b"", *n]
            for at in range(0, len(terms), 50_000):
                part = terms[at : at + 50_000]
                columns = [pa.array([lang] * len(part)), pa.array([source] * len(part)), pa.array(part, pa.binary()).cast(pa.string()), *(pa.array([c[t] for t in part], pa.int64()) for c in (n, docs))]
                yield pa.RecordBatch.from_arrays(columns, names=["lang", "source", "term", "n", "docs"])
        groups.clear()

    for batch in batches:
        for lang, source, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            n, docs = groups.setdefault((lang, source), (Counter(), Counter()))
            terms, before = terms_of(value.as_py()), len(n)
            n.update(terms)
            docs.update(set(terms))
            held += len(n) - before
            if terms and len(longest := max(terms, key=len)) > 64:
                long_bytes += len(longest) if len(terms) == 1 else sum(len(t) for t in terms if len(t) > 64)
            if held > COUNTED or long_bytes > LONG_BYTES:
                yield from flush()
                held = long_bytes = 0
    yield from flush()


def term_counts(docs: DataFrame, lang: str, source: str, text: str, min_docs: int) -> DataFrame:
    """(lang, source, term, n, total, first) of kept terms, and a row with an empty term for each group.

    total is the term's count in the language, first marks one row of each term of a language.
    """
    plain = docs.select(*(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(a) for c, a in ((lang, "lang"), (source, "source"), (text, "text"))))
    partial = plain.mapInArrow(_counted, "lang string, source string, term string, n bigint, docs bigint")
    sums = partial.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    whole = Window.partitionBy("lang", "term")
    marked = sums.withColumns({"df": F.sum("docs").over(whole), "total": F.sum("n").over(whole), "first": F.row_number().over(whole.orderBy("source")) == 1})
    return marked.where((F.col("df") >= min_docs) | (F.col("term") == "")).select("lang", "source", "term", "n", "total", "first")


def _share(n: str, size: str, terms: str, smooth: int) -> Column:
    """1 + floor(WHOLE * (n + smooth) / (size + smooth * terms)), exactly: the product has up to 38 digits."""
    return F.expr(f"1 + (CAST({WHOLE} AS DECIMAL(18, 0)) * CAST({n} + {smooth} AS DECIMAL(19, 0))) DIV CAST({size} + {smooth} * {terms} AS DECIMAL(19, 0))")


def groups_of(counts: DataFrame, smooth: int, block: int) -> DataFrame:
    """(lang, source, size, terms, lang_size, base, row, rows): each group's kept terms, its p of a term that it lacks, its block of groups."""
    of_term = F.col("term") != ""
    own = counts.groupBy("lang", "source").agg(F.sum("n").alias("size"))
    langs = counts.groupBy("lang").agg(F.count_if(F.col("first") & of_term).alias("terms"), F.coalesce(F.sum(F.when(F.col("first") & of_term, F.col("total"))), F.lit(0)).alias("lang_size"), F.count_if(~of_term).alias("groups"))
    langs = langs.withColumn("rows", F.ceil(F.col("groups") / block).cast("int"))
    joined = own.join(materialize(langs, "langs"), "lang").withColumn("row", F.pmod(F.xxhash64("source"), "rows").cast("int"))
    return joined.withColumn("base", F.when(F.col("terms") > 0, _share("0", "size", "terms", smooth)).otherwise(0)).drop("groups")


def _cells(slices: DataFrame) -> DataFrame:
    """Each row once for every cell that its slice bounds: cells are (lang, low, high, part), low <= high."""
    other = slices.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("rows") - 1)))
    return other.withColumns({"low": F.least("row", "other"), "high": F.greatest("row", "other")}).drop("other", "rows")


def _cell(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """Partial divergence of each pair of a cell: what its terms add beyond the bases' distance, and in the first part that distance times all terms."""
    lang, low, high, part = key
    heads = rows[rows.term == ""].drop_duplicates("source").sort_values("source", ignore_index=True)
    seen = rows[rows.term != ""]
    at = pd.Series(heads.index, heads.source)
    base = heads.base.to_numpy(np.int64)
    term, names = pd.factorize(seen.term)
    p = np.repeat(base[:, None], len(names), axis=1)
    p[at[seen.source].to_numpy(), term] = seen.base.to_numpy(np.int64)
    whole = int(heads.terms.iloc[0]) if part == 0 else 0
    row = heads.row.to_numpy()
    left = np.flatnonzero(row == low)
    out = []
    for i in left:
        others = np.flatnonzero(row == high) if low != high else left[left > i]
        apart = np.abs(base[others] - base[i])
        value = np.abs(p[others] - p[i]).sum(axis=1) + (whole - len(names)) * apart
        out += [(lang, heads.source[i], heads.source[o], v) for o, v in zip(others, value.tolist(), strict=True)]
    return pd.DataFrame(out, columns=["lang", "a", "b", "value"])


def pair_divergences(counts: DataFrame, groups: DataFrame, smooth: int, term_block: int) -> DataFrame:
    """(lang, source, item, value) for each two sources of a language, in both directions."""
    most = groups.agg(F.max("terms")).first()[0] or 0
    parts = max(1, -(-most // term_block))
    part = F.pmod(F.xxhash64("term"), F.lit(parts)).cast("int")
    joined = counts.where("term <> ''").join(groups, ["lang", "source"])
    slices = joined.select("lang", "source", "row", "rows", part.alias("part"), "term", _share("n", "size", "terms", smooth).alias("base"), "terms")
    heads = groups.select("lang", "source", "row", "rows", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), F.lit("").alias("term"), "base", "terms")
    cells = _cells(slices.unionByName(heads)).groupBy("lang", "low", "high", "part")
    partial = cells.applyInPandas(_cell, "lang string, a string, b string, value bigint")
    sums = partial.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    both = F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))
    return sums.select("lang", F.explode(both).alias("pair"), "value").select("lang", "pair.source", "pair.item", "value")


def marked_terms(counts: DataFrame, groups: DataFrame, smooth: int) -> DataFrame:
    """(lang, source, item, value) of terms that a group has more often than its language, by share."""
    joined = counts.where("term <> '' AND n > 0").join(groups, ["lang", "source"])
    more = _share("n", "size", "terms", smooth) - _share("total", "lang_size", "terms", smooth)
    return joined.select("lang", "source", F.col("term").alias("item"), more.alias("value")).where("value > 0")


def source_divergence(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text", min_docs: int = 30, smooth: int = 5, top: int = 50, group_block: int = 32, term_block: int = 2048) -> DataFrame:
    """lang, source, part, item, value, rank: part `pair` has the divergence from each other source of the language, part `term` the group's top marked terms.

    Shares are whole billionths of the terms that min_docs documents of the language hold, each count raised by `smooth`.
    Null texts, languages and sources are empty ones; every row is a document, repeated ones too. A group without terms has
    pairs all the same; a language without kept terms has pairs of value 0, and one with a single source has none. Ties of
    value go by the item's UTF-8 bytes. An empty table gives no rows; other columns are ignored. A text may be of any length.

    Counts are added up in the workers before they are shuffled by (lang, source, term). A cell holds some group_block groups
    twice and some term_block terms, however large the input; a term's rows in a language are as many as its sources.
    """
    counts = materialize(term_counts(docs, lang, source, text, min_docs), "term-counts")
    groups = materialize(groups_of(counts, smooth, group_block), "groups")
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    pairs = pair_divergences(counts, groups, smooth, term_block).withColumn("rank", F.row_number().over(order))
    terms = marked_terms(counts, groups, smooth).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    shown = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")
    return shown(pairs, "pair").unionByName(shown(terms, "term"))
