"""Near-duplicate detection with b-bit MinHash.

Texts with equal word sequences are one class. A class's minima make bands; their low bits are packed into a
signature. Buckets of equal bands give candidate pairs of a pivot and a member; the signatures' agreeing bits,
corrected for chance collisions, estimate the similarity, and pairs near the threshold or above are confirmed on
their full shingle sets, unless the places that their shingles fill prove that they are not linked. Links become components by star contraction. Pivots are chosen again among the members
that are still in different components until no bucket has an open pair, so that no link is lost to the choice.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import LOWER_BYTES, materialize, on_plain_names

ROWS, BANDS, BITS = 4, 24, 2
HASHES = 512  # of which ROWS * BANDS make the bands; all make the signature
#: Five of the estimate's standard deviations at 0.8.
MARGIN = 0.11
#: Places of a set's shingles, by their low bits, in 64-bit words.
PLACES = 1024
#: Pivots of a bucket in the first rounds.
POPULAR = (1, 16)
_seeds = np.random.Generator(np.random.PCG64(20240607))
XOR = _seeds.integers(0, 2**32, HASHES, np.uint32)
TIMES = _seeds.integers(0, 2**31, HASHES, np.uint32) * np.uint32(2) + np.uint32(1)
#: Room for a block's hashes, half a megabyte, used again and again.
SCRATCH = np.empty((256, HASHES), np.uint32)
PLACE = _seeds.integers(0, 2**63, 64, np.uint64) * np.uint64(2) + np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A one-to-one scramble of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 300_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


class Shingles:
    """Sorted distinct 64-bit hashes of a text's shingles: `size` words in a row, or all words of a shorter text."""

    def __init__(self, size: int):
        self.size, self.of = size, WordHashes()

    def words(self, text: str | None) -> list[bytes]:
        return (text or "").encode("utf-8", "surrogatepass").translate(LOWER_BYTES).split()

    def __call__(self, words: list[bytes]) -> np.ndarray:
        n = len(words)
        h = np.fromiter(map(self.of.__getitem__, words), np.uint64, n)
        k = min(self.size, n)
        if not k:
            return h
        total = h[: n - k + 1] * PLACE[0]
        for i in range(1, k):
            total = total + h[i : n - k + 1 + i] * PLACE[i]
        if k < self.size:  # a short text's only shingle differs from any full one
            total = total + np.uint64(k)
        return np.unique(mix(total))


def minima(shingles: np.ndarray) -> np.ndarray:
    low = (shingles >> np.uint64(32)).astype(np.uint32)
    best = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(low), len(SCRATCH)):
        part = low[at : at + len(SCRATCH), None]
        hashed = SCRATCH[: len(part)]
        np.bitwise_xor(part, XOR, out=hashed)
        np.multiply(hashed, TIMES, out=hashed)
        np.minimum(best, np.minimum.reduce(hashed, axis=0), out=best)
    return best


def bands_of(best: np.ndarray) -> np.ndarray:
    """64-bit hash of each band, told apart by its number."""
    rows = best[: ROWS * BANDS].reshape(BANDS, ROWS).astype(np.uint64)
    return mix((rows * PLACE[:ROWS]).sum(axis=1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64) * PLACE[ROWS]).view(np.int64)


def packed(best: np.ndarray) -> np.ndarray:
    """The low BITS of the scrambled minima, as 64-bit numbers: scrambled, because a product's low bits hang on its factors' low bits alone."""
    best = (best ^ (best >> np.uint32(16))) * np.uint32(0x85EBCA6B)
    best = (best ^ (best >> np.uint32(13))) * np.uint32(0xC2B2AE35)
    best = best ^ (best >> np.uint32(16))
    low = (best & np.uint32((1 << BITS) - 1)).astype(np.uint64).reshape(-1, 64 // BITS)
    return (low << (np.arange(64 // BITS, dtype=np.uint64) * np.uint64(BITS))).sum(axis=1, dtype=np.uint64).view(np.int64)


def estimate(a: str, b: str) -> Column:
    """Similarity from two signatures: the share of equal BITS-bit groups, less what chance makes equal."""
    groups = 64 // BITS
    ones = sum(1 << (BITS * i) for i in range(groups))
    ones -= 1 << 64 if ones >= 1 << 63 else 0
    differ = F.lit(0)
    for i in range(HASHES // groups):
        x = F.col(f"{a}.s{i}").bitwiseXOR(F.col(f"{b}.s{i}"))
        folded = x
        for shift in range(1, BITS):
            folded = folded.bitwiseOR(F.shiftrightunsigned(x, shift))
        differ = differ + F.bit_count(folded.bitwiseAND(F.lit(ones)))
    chance = 1 / (1 << BITS)
    return ((1 - differ / HASHES) - chance) / (1 - chance)


def places_of(shingles: np.ndarray) -> np.ndarray:
    """A bit for each place that a shingle of the set falls on, as 64-bit numbers."""
    filled = np.zeros(PLACES, bool)
    filled[(shingles % np.uint64(PLACES)).astype(np.intp)] = True
    return np.packbits(filled, bitorder="little").view("<i8")


def may_link(a: str, b: str, percent: int) -> Column:
    """False only if 100 * intersection < percent * union for certain: a place that one set alone fills holds at least one shingle that the other lacks."""
    both = sum((F.bit_count(F.col(f"{a}.{w}").bitwiseAND(F.col(f"{b}.{w}"))) for w in FILLED), F.lit(0))
    most = both + F.least(F.col(f"{a}.n") - F.col(f"{a}.filled"), F.col(f"{b}.n") - F.col(f"{b}.filled"))
    return (100 + percent) * most >= percent * (F.col(f"{a}.n") + F.col(f"{b}.n"))


SIGNATURE = [f"s{i}" for i in range(HASHES * BITS // 64)]
FILLED = [f"f{i}" for i in range(PLACES // 64)]


def sketch(docs: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """(_id, c1, c2, n, s0.., f0.., bands): class of equal word sequences, set size, signature, places, bands. One pass, no shuffle."""
    names = ["_id", "c1", "c2", "n", *SIGNATURE, *FILLED, "bands"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles(size)
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                c, n, s, f, b = [], [], [], [], []
                for text in part.column(1).to_pylist():
                    words = shingles.words(text)
                    c.append(np.frombuffer(digest(words), "<i8"))
                    own = shingles(words)
                    n.append(len(own))
                    best = minima(own)
                    s.append(packed(best))
                    f.append(places_of(own))
                    b.append(bands_of(best))
                c, s, f = np.array(c).reshape(-1, 2), np.array(s).reshape(-1, len(SIGNATURE)), np.array(f).reshape(-1, len(FILLED))
                lists = pa.ListArray.from_arrays(np.arange(0, BANDS * len(n) + 1, BANDS, dtype=np.int32), np.array(b, np.int64).reshape(-1))
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(x) for x in c.T), pa.array(n, pa.int64()), *(pa.array(x) for x in s.T), *(pa.array(x) for x in f.T), lists], names=names)

    kind = dict(docs.dtypes)[id_col]
    schema = f"_id {kind}, c1 bigint, c2 bigint, n bigint, {', '.join(f'{x} bigint' for x in SIGNATURE + FILLED)}, bands array<bigint>"
    return docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").alias("_text")).mapInArrow(run, schema)


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node that each node of edges (u, v) reaches, by alternating large and small stars.

    Every step is a join and a minimum that combines in the map tasks; each round is written to the shared folder.
    """
    edges = materialize(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "edges")
    while True:
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        following = materialize(small.where("u <> v").distinct(), "edges")
        # Stars are done when nothing moves: every node has one edge, to a node that has none of its own.
        ends = following.selectExpr("u AS node", "1 AS up", "0 AS down").union(following.selectExpr("v", "0", "1"))
        moving = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 OR up > 0 AND down > 0")
        edges = following
        if not moving.limit(1).count():
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def digest(words: list[bytes]) -> bytes:
    return xxhash.xxh3_128_digest(b" ".join(words))


def confirm(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """(u, v) of the pairs whose full shingle sets have 100 * intersection >= percent * union."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, last = Shingles(size), (None, None)
        for batch in batches:
            u, v, keep = batch.column(0).to_pylist(), batch.column(1).to_pylist(), []
            for i, (a, b) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
                if last[0] != u[i]:
                    last = u[i], shingles(shingles.words(a))
                x, y = last[1], shingles(shingles.words(b))
                if 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)):
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    if 100 * both >= percent * (len(x) + len(y) - both):
                        keep.append(i)
            yield pa.RecordBatch.from_arrays([pa.array([u[i] for i in keep], batch.schema.types[0]), pa.array([v[i] for i in keep], batch.schema.types[1])], names=["u", "v"])

    joined = pairs.join(texts.select(F.col("c").alias("v"), F.col("text").alias("tv")), "v").join(texts.select(F.col("c").alias("u"), F.col("text").alias("tu")), "u")
    return joined.select("u", "v", "tu", "tv").mapInArrow(run, "u bigint, v bigint")


def member_texts(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(c, text) of the classes in wanted (c, c1, c2, _id): ids find the rows, the class's 128-bit hash picks among rows that share an id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words_of = Shingles(1).words
        for batch in batches:
            c1, c2, texts = (batch.column(batch.schema.get_field_index(name)).to_pylist() for name in ("c1", "c2", "text"))
            keep = [np.frombuffer(digest(words_of(t)), "<i8").tolist() == [x, y] for x, y, t in zip(c1, c2, texts, strict=True)]
            yield batch.filter(pa.array(keep, pa.bool_())).select(["c", "text"])

    rows = docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").alias("text")).join(wanted, "_id").select("c", "c1", "c2", "text")
    return rows.mapInArrow(run, "c bigint, text string").dropDuplicates(["c"])


def pivots_of(active: DataFrame, k: int) -> DataFrame:
    """Of each band the k most popular of the given members; ties go to the smaller class."""
    order = F.struct((-F.col("popular")).alias("a"), F.col("c").alias("b"))
    if k == 1:
        best = active.groupBy("band").agg(F.min(order).alias("best")).select("band", F.col("best.b").alias("c"))
        return active.join(best, ["band", "c"], "left_semi")
    return active.withColumn("rank", F.row_number().over(W.partitionBy("band").orderBy(order))).where(F.col("rank") <= k).drop("rank")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80, pivots: int = 128) -> DataFrame:
    """One row per input row: id, n_shingles, component_id (smallest id reachable over links), kept (id = component_id).

    Two texts are linked when 100 * intersection >= percent * union of their shingle sets. Null and empty texts and
    texts without words have an empty set and no link. A row with a null id takes no part: its component is null
    and it is kept. Rows that share an id each give a row by their own text; an empty table gives none; other
    columns are ignored.

    A link at the threshold is missed with a chance of (1 - 0.8^4)^24 = 3e-6 by the bands and less by the estimate.
    Classes are told apart by 128 bits of hash and then have numbers of their own.
    Copies are collapsed before anything is paired. The first rounds pair a bucket's members with its most popular
    ones; later rounds take pivots outside the bucket's largest component, `pivots` at first and eight times as many
    each round, and pair them with members of other components. Pivots then leave the bucket, and a bucket of one
    component is done. A pair counts in the first band that it shares, and in no other.
    """
    rows = materialize(sketch(docs, id_col, text_col, size), "sketch")
    full = rows.where(F.col("_id").isNotNull() & (F.col("n") > 0))
    classes = materialize(full.groupBy("c1", "c2").agg(F.min("_id").alias("_id")).withColumn("c", F.monotonically_increasing_id()), "classes")
    reps = full.join(classes, ["c1", "c2", "_id"]).dropDuplicates(["c1", "c2"])
    banded = reps.select("c", F.posexplode("bands").alias("at", "band"))
    shared = banded.groupBy("band").agg(F.count("*").alias("k")).where("k > 1")
    members = materialize(banded.join(shared, "band"), "members")
    signed = materialize(reps.select("c", "c1", "c2", "_id", "n", "bands", *SIGNATURE, *FILLED).join(members.groupBy("c").agg(F.sum("k").alias("popular")), "c"), "signatures")
    texts = materialize(member_texts(docs, signed.select("c", "c1", "c2", "_id"), id_col, text_col), "texts")
    signatures = signed.select("c", "n", "bands", *SIGNATURE, *FILLED, sum((F.bit_count(w) for w in FILLED), F.lit(0)).alias("filled"))
    active = members.select("band", "at", "c").join(signed.select("c", "popular"), "c")
    roots = done = None
    number = 0
    while True:
        if roots is None:
            active = materialize(active.withColumns({"root": F.col("c"), "major": F.lit(None).cast("long")}), "active")
        else:
            named = active.join(roots.withColumnRenamed("node", "c"), "c", "left").withColumn("root", F.coalesce("root", "c"))
            sizes = named.groupBy("band", "root").agg(F.count("*").alias("k"))
            mixed = sizes.groupBy("band").agg(F.max(F.struct("k", "root")).alias("most"), F.count("*").alias("roots")).where("roots > 1").select("band", F.col("most.root").alias("major"))
            active = materialize(named.join(mixed, "band").select("band", "at", "c", "popular", "root", "major"), "active")
        if active.limit(1).count() == 0:
            break
        if number < len(POPULAR):
            pivot = pivots_of(active, POPULAR[number])
        else:
            pivot = pivots_of(active.where("root <> major"), pivots)
            pivots *= 8
        number += 1
        p, m = pivot.join(signatures, "c").alias("p"), active.join(signatures, "c").alias("m")
        near = p.join(
            m,
            (F.col("p.band") == F.col("m.band"))
            & (F.col("p.root") != F.col("m.root"))
            & (100 * F.least("p.n", "m.n") >= percent * F.greatest("p.n", "m.n"))
            & (estimate("p", "m") >= percent / 100 - MARGIN)
            & may_link("p", "m", percent)
            & ~F.arrays_overlap(F.slice("p.bands", F.lit(1), F.col("p.at")), F.slice("m.bands", F.lit(1), F.col("p.at"))),
        )
        pairs = near.select(F.col("p.c").alias("u"), F.col("m.c").alias("v")).distinct()
        pairs = materialize(pairs if done is None else pairs.join(done, ["u", "v"], "left_anti"), "pairs")
        done = pairs if done is None else done.union(pairs)
        links = confirm(pairs, texts, size, percent)
        roots = components(links if roots is None else links.union(roots.select(F.col("node").alias("u"), F.col("root").alias("v"))))
        active = active.join(pivot.select("band", "c"), ["band", "c"], "left_anti").select("band", "at", "c", "popular")
    by_class = classes
    if roots is not None:
        by_class = classes.join(roots.withColumnRenamed("node", "c"), "c", "left").withColumn("root", F.coalesce("root", "c"))
        by_root = by_class.groupBy("root").agg(F.min("_id").alias("component"))
        by_class = by_class.join(by_root, "root").select("c1", "c2", "component")
    else:
        by_class = by_class.select("c1", "c2", F.col("_id").alias("component"))
    out = rows.select("_id", "n", "c1", "c2").join(by_class, ["c1", "c2"], "left")
    component = F.when(F.col("_id").isNull(), None).when(F.col("n") > 0, F.col("component")).otherwise(F.col("_id"))
    return out.select(F.col("_id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("_id") == component, F.lit(True)).alias("kept"))


def keep_one_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents that stand for their groups, with the columns they had, whatever their names.

    All rows of a kept id stay, and so do rows with a null id; an empty table gives none. Ids travel as verdicts, texts
    once, in a join by id.
    """
    verdicts = near_duplicates(docs, id_col, text_col, **options).where("kept").select(F.col(f"`{id_col}`").alias("_id")).where(F.col("_id").isNotNull()).distinct()

    def change(d: DataFrame, name) -> DataFrame:
        own = F.col(name(id_col))
        # A merge join at every size: most ids are kept, so that no side is small.
        return d.join(verdicts.hint("merge"), own == F.col("_id"), "left_semi").unionByName(d.where(own.isNull()))

    return on_plain_names(docs, change)
