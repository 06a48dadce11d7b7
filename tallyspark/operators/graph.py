"""Sketches, candidate pairs, components and neighbour graphs."""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, IntegralType, LongType, StructField, StructType

from ..functions import hashes
from ..plans.scratch import materialize

#: Pairs of keys that a task counts.
PAIRS = 1_000_000
#: Edges of a task, each in both directions.
EDGES = 1_000_000
#: Entries of a block of sketches, at least and at most, and meetings of two classes that are put in order at once.
BLOCK_LEAST, BLOCK_MOST, AT_ONCE = 200_000, 8_000_000, 4_000_000
#: Keys of equal sketches that are one row, and pairs of a batch, about.
MEMBERS, OUT_ROWS = 1_000, 1_000_000
#: Cuts of a block of vectors, whose nearest ones tell how far a neighbour can be.
CUTS = 128


def kmer_sketch(texts: DataFrame, key: str, text: str, k: int, bins: int) -> DataFrame:
    """(key, bin, value): the smallest hash in each bin over the k-mers of a sequence; hashes are 60 bits of md5, the same in every engine.

    A sequence is hashed whole in its own task, in time linear in its length; the k-mers of a batch's texts are hashed at once.
    """
    schema = StructType([texts.schema[key], StructField("bin", LongType()), StructField("value", LongType())])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            least = hashes.least_of_bins([s or "" for s in batch.column(1).to_pylist()], k, bins)
            row, at = np.nonzero(least >= 0)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(at), pa.array(least[row, at])], schema=arrow)

    sketch = texts.select(key, text).mapInArrow(run, schema)
    return sketch.groupBy(key, "bin").agg(F.min("value").alias("value"))


def least_hashes(s: str, k: int, bins: int) -> tuple[np.ndarray, np.ndarray]:
    """(bins that a text's k-mers fill, the smallest hash of each): the first 60 bits of the k-mers' md5, taken at once."""
    least = hashes.least_of_bins([s], k, bins)[0]
    return (at := np.flatnonzero(least >= 0)), least[at]


def bin_collisions(sketch: DataFrame, key: str) -> DataFrame:
    """(u, v, matches): pairs that share the value of a bin, and in how many bins."""
    pairs = sketch.select("bin", "value", F.col(key).alias("u")).join(sketch.select("bin", "value", F.col(key).alias("v")), ["bin", "value"]).where("u < v")
    return pairs.groupBy("u", "v").agg(F.count("*").alias("matches"))


def sketch_jaccard(sketch: DataFrame, key: str) -> DataFrame:
    """(u, v, jaccard) of colliding pairs: equal bins over bins that either fills. Each pair looks up which bins its two keys fill."""
    filled = sketch.groupBy(key).agg(F.collect_list("bin").alias("bins"))
    pairs = bin_collisions(sketch, key)
    both = pairs.join(filled.select(F.col(key).alias("u"), F.col("bins").alias("bu")), "u").join(filled.select(F.col(key).alias("v"), F.col("bins").alias("bv")), "v")
    return both.select("u", "v", (F.col("matches") / F.size(F.array_union("bu", "bv"))).alias("jaccard"))


def sketch_links(sketch: DataFrame, key: str) -> DataFrame:
    """(key, class_id, n_links, matches, jaccard): one row per key, and none per pair.

    Keys of equal sketches are a class, called by its smallest key; classes are told apart by 256 bits of hash. n_links counts
    the other keys, copies too, that share the value of a bin, matches the bins in which they do, and jaccard is the largest
    of equal bins over bins that either fills with a key of another class, null if there is none.

    All pairs are counted, of classes in place of their members. Classes are dealt into blocks; a task takes two blocks, puts
    the pairs that meet in a value in order, some millions at a time, and gives sums of classes: memory is that of two
    blocks, however many keys share a value. The work grows with the pairs.
    """
    rows, own, words = _digests(sketch, key)
    classes = materialize(own.groupBy("digest").agg(F.min("k").alias("class_id"), F.count("*").alias("n"), *(F.first(w).alias(w) for w in words)), "classes")
    held = materialize(_buckets(rows.join(classes.select(F.col("class_id").alias("k")), "k")).join(classes.drop("digest"), "class_id"), "buckets")
    dealt, g = _block_pairs(held)
    schema = StructType([StructField("class_id", sketch.schema[key].dataType), StructField("links", LongType()), StructField("matches", LongType()), StructField("jaccard", DoubleType())])
    arrow = to_arrow_schema(schema)

    def count(pair: tuple, table: pa.Table) -> pa.Table:
        sides = _sides(pair, table, g)
        sums = _block_links(sides[0], sides[-1], words)
        return pa.concat_tables(pa.Table.from_arrays([side.column("class_id").cast(arrow.types[0]), *map(pa.array, own)], schema=arrow) for side, own in zip(sides, sums, strict=False))

    counted = dealt.groupBy("pair").applyInArrow(count, schema)
    linked = counted.groupBy("class_id").agg(F.sum("links").alias("links"), F.sum("matches").alias("matches"), F.max("jaccard").alias("jaccard"))
    copies, bins = F.col("n") - 1, functools.reduce(lambda a, b: a + b, (F.bit_count(w) for w in words))
    found = classes.join(linked, "class_id", "left").select(
        "digest", "class_id", (F.coalesce("links", F.lit(0)) + copies).alias("n_links"), (F.coalesce("matches", F.lit(0)) + copies * bins).alias("matches"), F.nullif("jaccard", F.lit(0.0)).alias("jaccard")
    )
    return own.select(F.col("k").alias(key), "digest").join(found, "digest").drop("digest")


def sketch_pairs(sketch: DataFrame, key: str) -> DataFrame:
    """(u, v, matches, jaccard) with u < v: every pair that shares the value of a bin, in how many bins, and equal bins over bins that either fills.

    Keys of equal sketches are held as one row, in parts of some MEMBERS, and rows are dealt into blocks. A task takes two
    blocks, puts the rows that meet in order, some millions at a time, and gives the pairs of their members as it goes:
    memory is that of two blocks, and no pair is shuffled. The work and the result grow with the pairs.
    """
    rows, own, words = _digests(sketch.where(F.col(key).isNotNull()), key)
    salted = own.join(own.groupBy("digest").agg(F.count("*").alias("copies")), "digest").withColumn("salt", F.pmod(F.xxhash64("k"), F.ceil(F.col("copies") / MEMBERS)))
    parts = materialize(salted.groupBy("digest", "salt").agg(F.min("k").alias("class_id"), F.collect_list("k").alias("members"), *(F.first(w).alias(w) for w in words)), "parts")
    met = _buckets(rows.join(parts.select(F.col("class_id").alias("k")), "k"))
    held = parts.join(met, "class_id", "left").where((F.size("members") > 1) | F.col("buckets").isNotNull())
    none = F.array().cast("array<bigint>")
    held = materialize(held.select("class_id", F.coalesce("buckets", none).alias("buckets"), "members", *words), "buckets")
    dealt, g = _block_pairs(held)
    kind = sketch.schema[key].dataType
    schema = StructType([StructField("u", kind), StructField("v", kind), StructField("matches", LongType()), StructField("jaccard", DoubleType())])
    arrow = to_arrow_schema(schema)

    def pairs(pair: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides = _sides(pair, pa.Table.from_batches(list(batches)), g)
        one, two = sides[0], sides[-1]
        (u_names, u_size, u_from), (v_names, v_size, v_from) = _members(one, arrow.types[0]), _members(two, arrow.types[0])
        for u, v, times, jaccard in _meetings(one, two, words):
            upto = np.cumsum(u_size[u] * v_size[v])
            at = 0
            while at < len(u):
                to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + OUT_ROWS, "right")))
                a, b = u[at:to], v[at:to]
                n = u_size[a] * v_size[b]
                row = np.repeat(np.arange(len(a)), n)
                place, width = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n), v_size[b][row]
                left, right = u_names.take(pa.array(u_from[a][row] + place // width)), v_names.take(pa.array(v_from[b][row] + place % width))
                m, j = times[at:to][row], jaccard[at:to][row]
                at = to
                if one is two:  # met from both ends, and each row meets itself
                    kept = pc.less(left, right)
                    left, right, kept = left.filter(kept), right.filter(kept), kept.to_numpy(zero_copy_only=False)
                    m, j = m[kept], j[kept]
                else:
                    left, right = pc.min_element_wise(left, right), pc.max_element_wise(left, right)
                yield pa.RecordBatch.from_arrays([left, right, pa.array(m), pa.array(j)], schema=arrow)

    return dealt.groupBy("pair").applyInArrow(pairs, schema)


def _digests(sketch: DataFrame, key: str) -> tuple[DataFrame, DataFrame, list[str]]:
    """(k, bin, value); (k, digest, words of the bins that are filled); the words' names."""
    rows = materialize(sketch.select(F.col(key).alias("k"), "bin", "value"), "sketch")
    words = [f"f{w}" for w in range((rows.agg(F.max("bin")).first()[0] or 0) // 64 + 1)]
    bit = F.expr("shiftleft(1L, CAST(bin % 64 AS INT))")
    filled = [F.bit_or(F.when(F.floor(F.col("bin") / 64) == w, bit).otherwise(0)).alias(name) for w, name in enumerate(words)]
    digest = F.sha2(F.array_sort(F.collect_list(F.struct("bin", "value"))).cast("string"), 256)
    return rows, materialize(rows.groupBy("k").agg(digest.alias("digest"), *filled), "digests"), words


def _buckets(rows: DataFrame) -> DataFrame:
    """(class_id, buckets): the numbers of the values that a class, of rows (k, bin, value), shares with another."""
    shared = rows.groupBy("bin", "value").agg(F.collect_list("k").alias("ks")).where(F.size("ks") > 1)
    met = shared.select("ks", F.monotonically_increasing_id().alias("bucket")).select("bucket", F.explode("ks").alias("class_id"))
    return met.groupBy("class_id").agg(F.collect_list("bucket").alias("buckets"))


def _block_pairs(held: DataFrame) -> tuple[DataFrame, int]:
    """(held's rows, each with its block and every pair of blocks that it is in; the number of blocks)."""
    entries = held.agg(F.sum(F.size("buckets"))).first()[0] or 0
    g = max(1, min(-(-entries // BLOCK_LEAST), max(12, -(-entries // BLOCK_MOST))))
    block = F.pmod(F.xxhash64("class_id"), F.lit(g)).cast("int")
    sent = held.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(g - 1))))
    dealt = sent.withColumn("pair", F.least("block", "other") * g + F.greatest("block", "other")).drop("other")
    return dealt.repartition(g * (g + 1) // 2, "pair"), g


def _sides(pair: tuple, table: pa.Table, g: int) -> list[pa.Table]:
    """The rows of a pair's blocks; a block with itself is one side."""
    at = table.column("block").to_numpy()
    return [table.filter(pa.array(at == b)) for b in dict.fromkeys(divmod(pair[0].as_py(), g))]


def _members(table: pa.Table, kind: pa.DataType) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(members of all rows, how many a row has, where its first stands)."""
    lists = table.column("members").combine_chunks()
    n = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    return lists.flatten().cast(kind), n, np.cumsum(n) - n


def _block_links(one: pa.Table, two: pa.Table, words: list[str]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(links, matches, largest Jaccard) of each side's classes with those of the other; a block with itself has one side, and meets each pair from both ends."""
    n, m, same = len(one), len(two), one is two
    size = [t.column("n").to_numpy() for t in (one, two)]
    sums = [(np.zeros(k, np.int64), np.zeros(k, np.int64), np.zeros(k)) for k in (n, m)]
    for u, v, times, jaccard in _meetings(one, two, words):
        if same:
            u, v, times, jaccard = (x[u != v] for x in (u, v, times, jaccard))
        for (links, matches, best), own, other, k, sizes in ((*sums[:1], u, v, n, size[1]), (*sums[1:], v, u, m, size[0]))[: 1 if same else 2]:
            links += np.bincount(own, sizes[other], k).astype(np.int64)
            matches += np.bincount(own, times * sizes[other], k).astype(np.int64)
            np.maximum.at(best, own, jaccard)
    return sums


def _meetings(one: pa.Table, two: pa.Table, words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(rows of one, rows of two, buckets that both have, Jaccard), each pair once, some millions of meetings at a time.

    A row meets itself in a block with itself, by all of its bins.
    """
    (u_at, u_bucket), (v_at, v_bucket) = _entries(one), _entries(two)
    m, same = len(two), one is two
    bits = [np.stack([t.column(w).to_numpy() for w in words], axis=1).view(np.uint64) for t in (one, two)]
    fill = [np.bitwise_count(b).sum(axis=1, dtype=np.int64) for b in bits]
    order = np.argsort(v_bucket, kind="stable")
    v_at, v_bucket = v_at[order], v_bucket[order]
    begin = np.searchsorted(v_bucket, u_bucket)
    width = np.searchsorted(v_bucket, u_bucket, "right") - begin
    u_at, begin, width = u_at[width > 0], begin[width > 0], width[width > 0]
    upto = np.cumsum(width)
    at = 0
    while at < len(u_at):
        # Whole classes, of some AT_ONCE meetings.
        to = np.searchsorted(upto, (upto[at - 1] if at else 0) + AT_ONCE, "right")
        to = np.searchsorted(u_at, u_at[min(max(to, at + 1), len(u_at)) - 1], "right")
        w = width[at:to]
        u = np.repeat(u_at[at:to], w)
        v = v_at[np.arange(len(u)) + np.repeat(begin[at:to] - (np.cumsum(w) - w), w)]
        code = u * m + v
        at = to
        code.sort()
        first = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
        times = np.diff(np.r_[first, len(code)])
        u, v = np.divmod(code[first], m)
        if same:
            u, v, times = u[u != v], v[u != v], times[u != v]
        both = np.zeros(len(u), np.int64)
        for a, b in zip(bits[0].T, bits[1].T, strict=True):
            both += np.bitwise_count(a[u] & b[v])
        yield u, v, times, times / (fill[0][u] + fill[1][v] - both)
    if same and len(one):
        u = np.arange(len(one))
        yield u, u, fill[0], np.ones(len(one))


def _entries(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of all buckets of a block's classes, by row."""
    lists = table.column("buckets").combine_chunks()
    return np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy(zero_copy_only=False)), lists.flatten().to_numpy()


def connected_components(edges: DataFrame, most: int | None = None) -> DataFrame:
    """(node, component): the smallest node reachable over edges (u, v), by min-label propagation with pointer jumping.

    Rounds go on until no label changes; with `most`, a graph that needs more rounds is an error, never split components.
    Labels are written to the shared folder each round, so that plans stay short and lost executors can be replaced.
    """
    ways = F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v"))))
    both = materialize(edges.select(ways.alias("way")).select("way.u", "way.v"), "edges")
    # Dealt out by number, and merged: tasks do not grow with the session's partitions, and no labels go through the driver.
    parts = max(1, -(-both.count() // EDGES))
    dealt = lambda df, c: df.repartition(parts, c)
    labels = dealt(both, "u").groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.first("u")).alias("component"))
    for done in count(1):
        heard = dealt(dealt(both, "v").join(dealt(labels.withColumnRenamed("node", "v"), "v").hint("merge"), "v").select("u", "component"), "u").groupBy(F.col("u").alias("node")).agg(F.min("component").alias("heard"))
        best = dealt(labels, "node").join(heard.hint("merge"), "node").withColumn("to", F.least("component", "heard"))
        further = labels.select(F.col("node").alias("to"), F.col("component").alias("further"))
        jumped = dealt(best, "to").join(dealt(further, "to").hint("merge"), "to", "left")
        following = materialize(jumped.select("node", F.least("to", F.coalesce("further", "to")).alias("component"), F.col("component").alias("was")), "labels")
        labels = following.select("node", "component")
        if following.where("component <> was").limit(1).count() == 0:
            return labels
        if done == most:
            raise RuntimeError(f"components have not converged after {most} rounds")


def nearest_neighbours(vectors: DataFrame, key: str, vector: str, k: int, queries: DataFrame | None = None, blocks: int | None = None) -> DataFrame:
    """(u, v, distance): the k nearest others of each query by squared distance, exact.

    Queries (all vectors, if none are given) meet the vectors block by block; each block keeps its k best of a query, so
    that a query's final choice is among k times `blocks` rows. Without `blocks`, a block holds some 5,000 vectors. A task
    takes one block of each side: a product of matrices screens its pairs, with room for rounding, and the distances of
    those that are left are summed up one dimension after the other. Vectors of one table have one length; null ones take no part.
    """
    blocks = blocks or max(16, -(-vectors.count() // 5_000))
    asked = queries if queries is not None else vectors
    groups = max(1, -(-asked.count() // 5_000))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = lambda n, salt: F.pmod(F.xxhash64(F.lit(salt), key), F.lit(n)).cast("int")
    known = F.col(vector).isNotNull() & F.col(key).isNotNull()
    q = asked.where(known).select(F.col(key).alias("u"), F.col(vector).alias("x"), dealt(groups, "query").alias("group"), every(blocks).alias("block"))
    rows = vectors.where(known).select(F.col(key).alias("v"), F.col(vector).alias("x"), dealt(blocks, "block").alias("block"), every(groups).alias("group"))
    schema = StructType([StructField("u", asked.schema[key].dataType), StructField("v", vectors.schema[key].dataType), StructField("distance", DoubleType())])

    arrow = to_arrow_schema(schema)

    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return arrow.empty_table()
        order = pc.sort_indices(right.column("v"))
        names = right.column("v").take(order).combine_chunks()
        b = _matrix(right.column("x"))[order.to_numpy()]
        squares = np.einsum("ij,ij->i", b, b)
        a, asked_for = _matrix(left.column("x")), left.column("u").combine_chunks()
        # Where a query itself stands, if it is there: names are in order, and equal ones side by side.
        at_names = pc.index_in(names, value_set=(distinct := names.unique())).to_numpy()
        own_name = pc.fill_null(pc.index_in(asked_for, value_set=distinct), -1).to_numpy()
        begin, end = np.searchsorted(at_names, own_name), np.searchsorted(at_names, own_name, "right")
        n = len(b)
        cuts = np.arange(0, n, max(1, n // CUTS)) if n > 2 * k else np.arange(n)
        found: tuple[list, list, list] = ([], [], [])
        for at in range(0, len(a), 256):
            part = a[at : at + 256]
            rough = part @ b.T
            rough *= -2
            rough += squares
            for i in range(len(part)):
                rough[i, begin[at + i] : end[at + i]] = np.inf
            # The k-th of the least of each cut is no less than the k-th of all.
            least = np.minimum.reduceat(rough, cuts, axis=1)
            most = np.partition(least, k - 1, axis=1)[:, k - 1] if least.shape[1] > k else np.full(len(part), np.inf)
            most += 1e-9 * (np.einsum("ij,ij->i", part, part) + squares.max())
            i, j = np.nonzero((rough <= most[:, None]) & (rough < np.inf))
            exact = np.concatenate([np.zeros(0), *(np.cumsum((part[i[f : f + 20_000]] - b[j[f : f + 20_000]]) ** 2, axis=1)[:, -1] for f in range(0, len(i), 20_000))])  # one dimension after the other, as a loop would
            by = np.lexsort((j, exact, i))  # equals go to the smaller name
            i, j, exact = i[by], j[by], exact[by]
            kept = np.arange(len(i)) - np.searchsorted(i, i) < k
            for all_, new in zip(found, (at + i[kept], j[kept], exact[kept]), strict=True):
                all_.append(new)
        i, j, exact = map(np.concatenate, found)
        return pa.Table.from_arrays([asked_for.take(pa.array(i)).cast(arrow.types[0]), names.take(pa.array(j)).cast(arrow.types[1]), pa.array(exact)], schema=arrow)

    # Dealt out by number: by their bytes, few tasks would have all of the work.
    met = lambda df: df.repartition(groups * blocks, "group", "block").groupBy("group", "block")
    near = met(q).cogroup(met(rows)).applyInArrow(best, schema)
    return near.withColumn("at", F.row_number().over(W.partitionBy("u").orderBy("distance", "v"))).where(F.col("at") <= k).select("u", "v", "distance")


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks()
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), -1)


def agreement(one: DataFrame, two: DataFrame) -> DataFrame:
    """One row: how many undirected edges (u, v) both graphs have, and their share of all."""
    plain = lambda e: e.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    a, b = plain(one), plain(two)
    shared = a.intersect(b).agg(F.count("*").alias("shared"))
    return shared.crossJoin(a.union(b).distinct().agg(F.count("*").alias("total"))).select("shared", "total", (F.col("shared") / F.col("total")).alias("share"))


def set_jaccard(sets: DataFrame, key: str, member: str) -> DataFrame:
    """(u, v, jaccard) of keys that share a member: intersection over union of their members.

    Pairs are not shuffled one by one: a member's keys go to the smallest of each pair as one list, with their sizes, and
    pairs are counted where the lists of one key meet.
    """
    kind = sets.schema[key].dataType
    sized = sets.join(sets.groupBy(key).agg(F.count("*").alias("n")), key).where(F.col(member).isNotNull())
    held = sized.groupBy(member).agg(F.array_sort(F.collect_list(F.struct(F.col(key).alias("k"), "n"))).alias("own")).where(F.size("own") > 1)
    held = materialize(held, "members")
    pairs, low, high, most = held.agg(F.sum(F.size("own") * (F.size("own") - 1) / 2), F.min(F.array_min("own")["k"]), F.max(F.array_max("own")["k"]), F.max(F.array_max(F.transform("own", lambda c: c["n"])))).first()
    bits = (most or 0).bit_length()
    after = lambda c: F.slice(c, F.col("at") + 2, F.size(c))
    if isinstance(kind, IntegralType) and pairs and low >= 0 and high.bit_length() + bits < 64:
        # Key and size in one number, as large as both: half of the bytes of two lists, and in the same order.
        both = held.select(F.transform("own", lambda c: F.shiftleft(c["k"].cast("long"), bits).bitwiseOR(c["n"])).alias("keys"))
        lists = both.select("keys", F.posexplode("keys").alias("at", "first")).where(F.col("at") + 1 < F.size("keys"))
        sent = lists.select(F.shiftright("first", bits).cast(kind).alias("u"), F.col("first").bitwiseAND(F.lit((1 << bits) - 1)).alias("nu"), after("keys").alias("others"))
        dealt = sent.repartition(max(1, math.ceil(pairs / PAIRS)), "u").select("u", "nu", F.explode("others").alias("other"))
        met = dealt.select("u", "nu", F.shiftright("other", bits).cast(kind).alias("v"), F.col("other").bitwiseAND(F.lit((1 << bits) - 1)).alias("nv"))
    else:
        # Keys and sizes as two lists: half of the bytes of a list of structs.
        lists = held.select(F.col("own.k").alias("keys"), F.col("own.n").alias("sizes"), F.posexplode("own").alias("at", "first")).where(F.col("at") + 1 < F.size("keys"))
        sent = lists.select(F.col("first.k").alias("u"), F.col("first.n").alias("nu"), after("keys").alias("keys"), after("sizes").alias("sizes"))
        dealt = sent.repartition(max(1, math.ceil((pairs or 0) / PAIRS)), "u").select("u", "nu", F.explode(F.arrays_zip("keys", "sizes")).alias("other"))
        met = dealt.select("u", "nu", F.col("other.keys").alias("v"), F.col("other.sizes").alias("nv"))
    shared = met.where("u < v").groupBy("u", "v").agg(F.count("*").alias("shared"), F.first("nu").alias("nu"), F.first("nv").alias("nv"))
    return shared.select("u", "v", (F.col("shared") / (F.col("nu") + F.col("nv") - F.col("shared"))).alias("jaccard"))


def degrees(edges: DataFrame) -> DataFrame:
    """(node, degree) of undirected edges."""
    return edges.select(F.explode(F.array("u", "v")).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))
