"""Benchmark decontamination as a prefix-filtered set join, in DataFrame operations only.

A window of item words occurs in a text only if its rarest shingle does. One pass over the documents counts the
shingles of the benchmark; each window then joins by its rarest shingle alone (the prefix that exact containment
needs), with its place in the window. The words around a place travel with it, so that length, position and words
are tested where the place was found, and only ranges are joined back to the documents.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, on_plain_names, text_key

#: Fixed word rule: words are runs of a-z, 0-9 and all beyond ASCII; A-Z count as a-z, every other ASCII character parts words.
ASCII = "".join(map(chr, range(128)))
FOLDED = "".join(c.lower() if c.isalnum() else " " for c in ASCII)
SHINGLE = 5
#: Shingles of a block of the benchmark; a block is broadcast, at some 300 bytes a shingle, and each block reads the documents again.
BLOCK = 200_000
#: Ids of contaminated documents up to which they are broadcast, some 40 bytes each; more are joined by a shuffle.
BROADCAST_IDS = 500_000


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), ASCII, FOLDED), " ", -1), "")


def shingle_places(texts: DataFrame, sizes: list[int], keep: list[str]) -> DataFrame:
    """(keep, pos, shingle): hashes of `size` words in a row from pos on, for each of the sizes. `words` may be kept: a place refers to its text's array."""
    most = max(sizes)
    hashed = texts.withColumn("_h", F.transform("words", lambda w: F.xxhash64(w)))
    zipped = F.arrays_zip(*(F.slice("_h", i + 1, F.greatest(F.size("_h"), F.lit(1))).alias(f"w{i}") for i in range(most)))
    places = hashed.select(*keep, F.posexplode(zipped).alias("pos", "w"))
    ids = [F.when(F.col(f"w.w{size - 1}").isNotNull(), F.xxhash64(F.lit(size), *(F.col(f"w.w{i}") for i in range(size)))) for size in sizes]
    if len(ids) == 1:
        return places.select(*keep, "pos", ids[0].alias("shingle")).where(F.col("shingle").isNotNull())
    return places.select(*keep, "pos", F.explode(F.array(*ids)).alias("shingle")).where(F.col("shingle").isNotNull())


def anchors(items: DataFrame, frequency: DataFrame, width: int, shingles: DataFrame) -> DataFrame:
    """(shingle, before, size, ctx, item_ids): runs of windows with one rarest shingle; ctx holds their words, `before` of them before the shingle.

    A window with a shingle that no document has can't occur and is left out. Runs that items share are one row.
    """
    counted = shingles.join(frequency, "shingle", "left").groupBy("item").agg(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("n", F.lit(0)).alias("n"), "shingle"))).alias("rank"))
    sized = items.join(counted, "item").withColumn("size", F.least(F.lit(width), F.size("words")))
    windows = sized.select("item", "rank", "size", F.explode(F.sequence(F.lit(0), F.size("words") - F.col("size"))).alias("start"))
    inside = F.slice("rank", F.col("start") + 1, F.col("size") - F.least(F.lit(SHINGLE), F.col("size")) + 1)
    rarest = F.array_min(F.transform(inside, lambda r: F.struct(r["n"], r["pos"], r["shingle"])))
    best = windows.select("item", "size", "start", rarest.alias("best")).where("best.n > 0")
    grouped = best.groupBy("item", "size", F.col("best.pos").alias("place"), F.col("best.shingle").alias("shingle")).agg(F.min("start").alias("low"), F.max("start").alias("high"))
    ctx = F.slice("words", F.col("low") + 1, F.col("high") - F.col("low") + F.col("size"))
    named = grouped.join(items, "item").select("shingle", (F.col("place") - F.col("low")).alias("before"), "size", ctx.alias("ctx"), "item_id")
    return named.groupBy("shingle", "before", "size", "ctx").agg(F.collect_set("item_id").alias("item_ids"))


def _verified() -> Column:
    """Ranges (begin, end, item_ids) of a place's windows that occur word for word: `own` are the text's words from max(begin, 0) on."""
    begin, size, ctx, own = F.col("begin"), F.col("size"), F.col("ctx"), F.col("own")
    cut = F.greatest(-begin, F.lit(0))  # so many words of ctx would stand before the text
    found = F.filter(
        F.sequence(F.lit(0), F.size(ctx) - size),
        lambda i: (i >= cut) & (i - cut + size <= F.size(own)) & (F.slice(own, F.greatest(i - cut, F.lit(0)) + 1, size) == F.slice(ctx, i + 1, size)),
    )
    return F.transform(found, lambda i: F.struct((begin + i).alias("begin"), (begin + i + size).alias("end"), F.col("item_ids").alias("item_ids")))


def hit_ranges(texts: DataFrame, items: DataFrame, width: int) -> DataFrame | None:
    """(_id, _key, ranges) of the texts (_id, _key, words) with occurrences, from two passes for each block of the benchmark."""
    own = F.least(F.size("words"), F.lit(SHINGLE))
    sizes = sorted(r[0] for r in items.select(own).distinct().collect())
    if not sizes:
        return None
    shingles = functools.reduce(DataFrame.unionByName, (shingle_places(items.where(own == k), [k], ["item"]) for k in sizes))
    shingles = materialize(shingles, "shingles")
    known = shingles.select("shingle").distinct()
    blocks = max(1, -(-known.count() // BLOCK))
    block = lambda df, b: F.broadcast(df.where(F.pmod("shingle", F.lit(blocks)) == b) if blocks > 1 else df)
    counts = [shingle_places(texts, sizes, []).join(block(known, b), "shingle").groupBy("shingle").agg(F.count("*").alias("n")) for b in range(blocks)]
    frequency = materialize(functools.reduce(DataFrame.unionByName, counts), "frequency")
    prefix = materialize(anchors(items, frequency, width, shingles), "anchors")
    found = []
    for b in range(blocks):
        # words stays a reference from the text's row until the join has matched: explode, join and slice run in one generated loop.
        near = shingle_places(texts, sizes, ["_id", "_key", "words"]).join(block(prefix, b), "shingle")
        begin = F.col("pos") - F.col("before")
        slice_ = F.slice("words", F.greatest(begin, F.lit(0)) + 1, F.size("ctx"))
        near = near.select("_id", "_key", begin.alias("begin"), "size", "ctx", "item_ids", slice_.alias("own"))
        found.append(near.select("_id", "_key", F.inline(_verified())))
    ranges = functools.reduce(DataFrame.unionByName, found)
    return ranges.groupBy("_id", "_key").agg(F.array_sort(F.collect_set(F.struct("begin", "end", "item_ids"))).alias("_ranges"))


def _covered(ranges: Column) -> Column:
    """Length of the union of ranges sorted by begin."""
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).alias("total"))
    step = lambda acc, r: F.struct(
        F.greatest(acc["end"], r["end"]).alias("end"), (acc["total"] + F.greatest(r["end"] - F.greatest(acc["end"], r["begin"]), F.lit(0))).alias("total")
    )
    return F.aggregate(ranges, zero, step, lambda acc: acc["total"])


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(f"`{id_col}`").alias("_id"), text_key(F.col(f"`{text_col}`")).alias("_key"), words_of(F.col(f"`{text_col}`")).alias("words"))


def _items(benchmark: DataFrame, item_col: str, item_text_col: str) -> DataFrame:
    raw = benchmark.select(F.coalesce(F.col(f"`{item_col}`").cast("string"), F.lit("null")).alias("item_id"), words_of(F.col(f"`{item_text_col}`")).alias("words"))
    return materialize(raw.where(F.size("words") > 0).distinct().select(F.xxhash64("item_id", "words").alias("item"), "item_id", "words"), "items")


def find_contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", width: int = 10) -> DataFrame:
    """The input with n_words, n_hit (words inside an occurrence of a window) and items (ids, as sorted strings, of items with occurrences).

    A window is `width` words in a row of an item, or all words of a shorter item that has any. Null and empty
    texts have no words. An item's null id is "null"; items that share an id are one in `items`; repeated rows of
    documents each give a row, null ids too; an empty table gives none; an empty benchmark hits nothing. Other columns
    pass; one called n_words, n_hit or items is replaced by the result of that name.

    Texts are split twice to be searched, and once more for n_words. They move only if the caller reads the text
    column of the result: then each row meets its ranges by its id and a hash of its text.
    """
    keep = [c for c in docs.columns if c not in ("n_words", "n_hit", "items") or c in (id_col, text_col)]
    names = {c: f"_c{i}" for i, c in enumerate(docs.columns)}
    plain = docs.toDF(*names.values())
    ranges = hit_ranges(_texts(docs, id_col, text_col), _items(benchmark, item_col, item_text_col), width)
    n_words = F.size(words_of(F.col(names[text_col]))).cast("long")
    own = [F.col(names[c]).alias(c) for c in keep if c not in ("n_words", "n_hit", "items")]
    if ranges is None:
        return plain.select(*own, n_words.alias("n_words"), F.lit(0).cast("long").alias("n_hit"), F.array().cast("array<string>").alias("items"))
    ids = F.array_sort(F.array_distinct(F.flatten(F.transform("_ranges", lambda r: r["item_ids"]))))
    ranges = materialize(ranges.select("_id", "_key", _covered(F.col("_ranges")).cast("long").alias("_hit"), ids.alias("_items")), "ranges")
    d = plain.withColumns({"_words": n_words, "_key": text_key(F.col(names[text_col]))}).alias("d")
    marked = d.join(ranges.alias("n"), F.col(f"d.{names[id_col]}").eqNullSafe(F.col("n._id")) & (F.col("d._key") == F.col("n._key")), "left")
    return marked.select(*own, F.col("_words").alias("n_words"), F.coalesce("_hit", F.lit(0)).alias("n_hit"), F.coalesce("_items", F.array().cast("array<string>")).alias("items"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", width: int = 10, in_memory: int = BROADCAST_IDS) -> DataFrame:
    """The documents without any hit, with the columns they had, whatever their names; nulls, repeats and empty tables as in find_contamination.

    The ids of contaminated documents go to every task up to `in_memory` of them, and no text moves; more are joined by a shuffle.
    """
    ranges = hit_ranges(_texts(docs, id_col, text_col), _items(benchmark, item_col, item_text_col), width)
    if ranges is None:
        return docs
    bad = materialize(ranges.select("_id", "_key"), "contaminated")
    bad = F.broadcast(bad) if bad.count() <= in_memory else bad

    def change(d: DataFrame, name) -> DataFrame:
        return d.join(bad, F.col(name(id_col)).eqNullSafe(F.col("_id")) & (text_key(F.col(name(text_col))) == F.col("_key")), "left_anti")

    return on_plain_names(docs, change)
