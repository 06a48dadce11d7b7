"""Resampling towards a target distribution, with bit-sliced sums.

A document's features fall into buckets. Its counts are held as bit planes over the buckets; gains of the buckets are
held as bit planes too, of each sign. The ones that two planes share, times a power of two, add up to the exact weight.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, materialize, word_bytes

WORD_BYTES = word_bytes(LOWER + "0123456789")
RESULTS = ("n_features", "n_words", "weight", "score", "rank")
#: Documents whose planes are made at once, and bytes of words that a worker remembers the buckets of.
AT_ONCE, REMEMBERED = 64, 16 << 20


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(WORD_BYTES).split()


class Buckets(dict):
    """Bucket of a feature; what is remembered is bounded in bytes."""

    def __init__(self, buckets: int):
        super().__init__()
        self.buckets, self.bytes = buckets, 0

    def __missing__(self, feature: bytes) -> int:
        bucket = zlib.crc32(feature) % self.buckets
        if len(feature) <= 64:
            if self.bytes > REMEMBERED:
                self.clear()
                self.bytes = 0
            self[feature] = bucket
            self.bytes += len(feature) + 100
        return bucket

    def of_words(self, words: list[bytes], longest: int) -> list[int]:
        """Buckets of all runs of 1 to `longest` words."""
        out = list(map(self.__getitem__, words))
        for n in range(2, longest + 1):
            out += [self[b" ".join(words[i : i + n])] for i in range(len(words) - n + 1)]
        return out


def bucket_counts(docs: DataFrame, text_col: str, buckets: int, longest: int) -> np.ndarray:
    """Features of a table by bucket: each partition sends at most one number a bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket_of, counts = Buckets(buckets), np.zeros(buckets, np.int64)
        for batch in batches:
            for value in batch.column(0):
                counts += np.bincount(np.array(bucket_of.of_words(words_of(value.as_py()), longest), np.int64), minlength=buckets)
        seen = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int32()), pa.array(counts[seen], pa.int64())], ["bucket", "n"])

    sums = docs.select(F.col(f"`{text_col}`").alias("_text")).mapInArrow(run, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))
    counts = np.zeros(buckets, np.int64)
    for row in sums.collect():  # one row a bucket
        counts[row.bucket] = row.n
    return counts


def gains_of(raw: np.ndarray, target: np.ndarray) -> list[int]:
    """floor(1000 ln(share in the target / share in the documents)) of each bucket, both with one more feature in each."""
    size, s_all, t_all = len(raw), int(raw.sum()), int(target.sum())
    return [math.floor(1000 * math.log(float(t + 1) * float(s_all + size) / (float(s + 1) * float(t_all + size)))) for s, t in zip(raw.tolist(), target.tolist(), strict=True)]


def planes(values: np.ndarray) -> np.ndarray:
    """Rows of unsigned numbers as bit planes: [plane, row, word], bit b of the words is of the number in column b."""
    rows, width = values.shape
    padded = -(-width // 64) * 64
    at_row, at_column = np.nonzero(values)
    at, found = at_row * padded + at_column, values[at_row, at_column]
    out = np.empty((int(found.max(initial=0)).bit_length(), rows, padded // 64), np.uint64)
    for j in range(len(out)):
        bits = np.zeros(rows * padded, np.uint8)
        bits[at[(found >> j) & 1 == 1]] = 1
        out[j] = np.packbits(bits, bitorder="little").view(np.uint64).reshape(rows, -1)
    return out


class Gains:
    """Gains as bit planes of each sign."""

    def __init__(self, gains: list[int]):
        signed = np.array([gains], np.int64)
        self.signs = [(1, planes(np.maximum(signed, 0))), (-1, planes(np.maximum(-signed, 0)))]

    def sums(self, counts: np.ndarray) -> np.ndarray:
        """Sum of count times gain over the buckets, for each row of counts."""
        total = np.zeros(len(counts), np.int64)
        for j, plane in enumerate(planes(counts)):
            for sign, own in self.signs:
                for k in range(len(own)):
                    ones = np.bitwise_count(plane & own[k]).sum(axis=1, dtype=np.int64)
                    total += sign * (ones << (j + k))
        return total


def noise(key: str, seed: int) -> int:
    """floor(1000 times a Gumbel draw) that hangs on the id alone."""
    h = int(hashlib.sha256(f"{seed}:{key}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def weigh(docs: DataFrame, gains: list[int], id_col: str, text_col: str, longest: int, seed: int) -> DataFrame:
    """(id, n_features, n_words, weight, score) of each row."""
    buckets = len(gains)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket_of, sliced = Buckets(buckets), Gains(gains)
        for batch in batches:
            for at in range(0, batch.num_rows, AT_ONCE):
                part = batch.slice(at, AT_ONCE)
                counts, sizes, words = np.zeros((part.num_rows, buckets), np.int64), [], []
                for i, value in enumerate(part.column(2)):
                    own = words_of(value.as_py())
                    found = bucket_of.of_words(own, longest)
                    counts[i] = np.bincount(np.array(found, np.int64), minlength=buckets)
                    sizes.append(len(found))
                    words.append(len(own))
                n = np.array(sizes, np.int64)
                weight = np.where(n > 0, sliced.sums(counts) // np.maximum(n, 1), 0)
                score = weight + np.array([noise(key or "", seed) for key in part.column(1).to_pylist()], np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(x, pa.int64()) for x in (n, words, weight, score))], names=["_id", *RESULTS[:4]])

    ident = F.col(f"`{id_col}`")
    kind = dict(docs.dtypes)[id_col]
    out = docs.select(ident.alias("_id"), ident.cast("string").alias("_key"), F.col(f"`{text_col}`").alias("_text"))
    return out.mapInArrow(run, f"_id {kind}, " + ", ".join(f"{c} bigint" for c in RESULTS[:4])).withColumnRenamed("_id", id_col)


def draw(scored: DataFrame, id_col: str, share: tuple[int, int], min_words: int) -> DataFrame:
    """scored with rank: 1, 2, 3 and so on for the highest scores among rows of min_words words, null for the others.

    Scores are whole thousandths of logarithms of 64-bit counts and 32-bit noise: under 100,000 differ, however many rows
    there are. Their counts go to the driver and come back as places; rows of one score are then numbered by themselves.
    """
    fit = F.col("n_words") >= min_words
    by_score = sorted(((r.score, r.n) for r in scored.where(fit).groupBy("score").agg(F.count("*").alias("n")).collect()), reverse=True)
    left, before, places = sum(n for _, n in by_score) * share[0] // share[1], 0, []
    wanted = left
    for score, n in by_score:
        if before >= wanted:
            break
        places.append((score, before))
        before += n
    if not places:
        return scored.withColumn("rank", F.lit(None).cast("long"))
    least = places[-1][0]
    chosen = fit & (F.col("score") >= least)
    offsets = F.broadcast(scored.sparkSession.createDataFrame(places, "score bigint, _before bigint"))
    order = Window.partitionBy("score").orderBy(F.col(id_col).asc_nulls_last(), "n_features", "weight")
    ranked = scored.where(chosen).withColumn("_n", F.row_number().over(order)).join(offsets, "score")
    rank = F.col("_before") + F.col("_n")
    ranked = ranked.select(*scored.columns, F.when(rank <= wanted, rank).alias("rank"))
    return ranked.unionByName(scored.where(~chosen).withColumn("rank", F.lit(None).cast("long")))


def resampling_ranks(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text: str = "text", buckets: int = 10_000, longest: int = 1, share: tuple[int, int] = (10, 100), min_words: int = 20, seed: int = 2024) -> DataFrame:
    """One row per input row: id, n_features, n_words, weight, score, rank.

    Features are runs of 1 to `longest` words. weight is the floored mean of their buckets' gains, score is weight and noise of the id;
    share of the rows with min_words words are drawn, those of the highest scores, and ranked. Null and empty texts have no
    features, weight 0 and are never drawn where min_words is positive. A null id has the noise of an empty one and comes
    last among ties. Repeated rows have the same score and one rank each. An empty table gives no rows, an empty target is
    one without features. Other columns are ignored; an id column called as a result is refused.

    Two passes over the texts; counts by bucket and by score are all that meets in the driver.
    """
    if id_col in RESULTS:
        raise ValueError(f"the id column can't be called {', '.join(RESULTS)}")
    gains = gains_of(bucket_counts(docs, text_col, buckets, longest), bucket_counts(target, target_text, buckets, longest))
    scored = materialize(weigh(docs, gains, id_col, text_col, longest, seed), "scores")
    return draw(scored, id_col, share, min_words)


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The drawn rows of docs with all their columns; rows that share an id come together, rows with a null id stay behind."""
    names = {c: f"_c{i}" for i, c in enumerate(docs.columns)}
    plain = docs.toDF(*names.values())
    drawn = resampling_ranks(plain, target, names[id_col], names[text_col], **options).where("rank IS NOT NULL").select(names[id_col])
    return plain.join(drawn, names[id_col], "left_semi").select(*names.values()).toDF(*names)
