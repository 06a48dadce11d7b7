"""Language-model scoring with Katz backoff over all words.

Bigram counts are Good-Turing discounted; backoff weights make each context's probabilities sum to one. Counts live in one
partitioned table. A word is coded by its number, if it is among the `vocabulary` most frequent ones, else by 63 bits of its
hash; every pair of codes has its own count. There are three kinds of part:

* PAIRS: both words are numbered; keyed by a hash of the pair;
* FOLLOWERS: the second word is not; keyed by it, so that its own count is there too;
* CONTEXTS: the first word is not; keyed by it, so that all that its weight needs is there too.

A pair of two words without numbers is in the last two. No key is hot: what has no number is rarer than all that has one.
Texts are cut into blocks of rows. Token pairs travel to the parts as sorted, coded entries, once to be counted and once to be
scored. Scores come back as one packed array of sums for each block and part, and are added up by block.

What is broadcast is bounded by `vocabulary` (words, at most 65,533) and HOT: pairs of the HOT most frequent words are scored
where the text is, so that no pair which travels has more than one token in HOT. The vocabulary changes the work, never the model.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import LOWER_BYTES, materialize

END, FIRST_WORD = 0, 1
PAIRS, FOLLOWERS, CONTEXTS = 0, 1, 2
#: Codes from here on are hashes of words without a number.
UNNUMBERED = 1 << 63
HOT = 512
#: Sums of logarithms travel as whole numbers of 2 ** -33, some 1e-10.
STEP = 2.0**-33
#: Rows in a block at most.
BLOCK_ROWS = 8192
#: Counts up to here are discounted.
CUTOFF = 5
#: Buckets of a count, a power of e each sixteenth: a threshold on them bounds the vocabulary without a sort.
BUCKETS = 16


def held_out(doc_id) -> bool:
    return zlib.crc32(str("" if doc_id is None else doc_id).encode()) % 7 == 2


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(LOWER_BYTES).split()


class Codes(dict):
    """Code of a word: its number in the vocabulary, else its hash above all numbers."""

    def __missing__(self, word: bytes) -> int:
        return xxhash.xxh3_64_intdigest(word) | UNNUMBERED


def pack(first: np.ndarray, *others: np.ndarray) -> bytes:
    """Columns of 64-bit numbers, the first ascending, as compressed planes of bytes; of the first its differences."""
    columns = (np.diff(first, prepend=np.uint64(0)), *others)
    planes = b"".join(np.ascontiguousarray(c).astype("<u8", copy=False).view(np.uint8).reshape(-1, 8).T.tobytes() for c in columns)
    return zstandard.ZstdCompressor(level=1).compress(planes)


def unpack(data: bytes, columns: int) -> list[np.ndarray]:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    out = [np.ascontiguousarray(c.T).view("<u8").reshape(-1) for c in raw.reshape(columns, 8, len(raw) // (8 * columns))]
    return [np.cumsum(out[0], dtype=np.uint64), *out[1:]]


def unpack_all(blobs: list[bytes], columns: int) -> list[np.ndarray]:
    parts = [unpack(b, columns) for b in blobs]
    return [np.concatenate([np.zeros(0, np.uint64), *(p[i] for p in parts)]) for i in range(columns)]


def runs(*columns: np.ndarray) -> np.ndarray:
    """Where a run of equal rows begins."""
    if not len(columns[0]):
        return np.zeros(0, np.int64)
    return np.flatnonzero(np.logical_or.reduce([np.append(True, c[1:] != c[:-1]) for c in columns]))


def tally(key: np.ndarray, other: np.ndarray, row: np.ndarray, n: np.ndarray) -> list[np.ndarray]:
    """The distinct (key, other, row), ascending, with the sums of n."""
    order = np.lexsort((row, other, key)) if row.any() else np.lexsort((other, key)) if other.any() else np.argsort(key, kind="stable")
    key, other, row, n = key[order], other[order], row[order], n[order]
    at = runs(key, other, row)
    return [key[at], other[at], row[at], np.add.reduceat(n, at) if len(at) else n]


def find(keys: np.ndarray, others: np.ndarray, key: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Place of each (key, other) among the ascending pairs (keys, others), or -1."""
    if not len(keys):
        return np.full(len(key), -1)
    one, place = np.unique(keys, return_inverse=True)
    two, within = np.unique(others, return_inverse=True)
    i, j = np.minimum(np.searchsorted(one, key), len(one) - 1), np.minimum(np.searchsorted(two, other), len(two) - 1)
    have, want = place * len(two) + within, i * len(two) + j
    at = np.minimum(np.searchsorted(have, want), len(have) - 1)
    return np.where((one[i] == key) & (two[j] == other) & (have[at] == want), at, -1)


def bucket_of(x: np.ndarray, buckets: int) -> np.ndarray:
    x = (x ^ (x >> np.uint64(15))) * np.uint64(0x9E3779B97F4A7C15)
    return ((x ^ (x >> np.uint64(32))) % np.uint64(buckets)).astype(np.int64)


@dataclass(frozen=True)
class Layout:
    """Numbers of parts: of PAIRS first, then as many of FOLLOWERS as of CONTEXTS."""

    pairs: int
    unnumbered: int

    @property
    def all(self) -> int:
        return self.pairs + 2 * self.unnumbered

    def kind(self, part: int) -> int:
        return PAIRS if part < self.pairs else FOLLOWERS if part < self.pairs + self.unnumbered else CONTEXTS

    def part(self, kind: int, key: np.ndarray) -> np.ndarray:
        if kind == PAIRS:
            return bucket_of(key, self.pairs)
        return self.pairs + (kind - FOLLOWERS) * self.unnumbered + bucket_of(key, self.unnumbered)


def word_counts(docs: DataFrame, id_col: str, text_col: str, limit: int = 300_000) -> DataFrame:
    """(word, c) over training texts; the end is "". Counted in bounded tables in the map tasks, then summed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()

        def flush():
            out = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()).cast(pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])
            counts.clear()
            return out

        for batch in batches:
            for i in range(batch.num_rows):
                if not held_out(batch.column(0)[i].as_py()):
                    counts.update(words_of(batch.column(1)[i].as_py()))
                    counts[b""] += 1
                if len(counts) > limit:
                    yield flush()
        yield flush()

    pairs = docs.select(F.col(f"`{id_col}`").alias("_0"), F.col(f"`{text_col}`").alias("_1")).mapInArrow(run, "word string, n bigint")
    return pairs.groupBy("word").agg(F.sum("n").alias("c"))


@dataclass
class Classes:
    """Numbered words, the end first, and probabilities of single words.

    Good-Turing gives the unseen word, which is one type for all words that training lacks, p0 = n1 / N; the others share the rest
    by their counts. So the probabilities of the end, of every word of the training texts and of the unseen word sum to one.
    """

    ids: dict[bytes, int]
    counts: np.ndarray  # by number, in training tokens
    tokens: int
    types: int
    unseen: float

    @property
    def p(self) -> np.ndarray:
        return self.p_of(self.counts) if self.tokens else np.full(len(self.counts), 1 - self.unseen)

    def p_of(self, counts: np.ndarray) -> np.ndarray:
        return np.where(counts > 0, (1 - self.unseen) * counts / max(self.tokens, 1), self.unseen)

    def log_base(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + 1) / (self.tokens + self.types + 1))


def learn_classes(unigram: DataFrame, vocabulary: int) -> Classes:
    bucket = F.floor(F.log("c") * BUCKETS).cast("int")
    stats = unigram.agg(F.sum("c"), F.count("*"), F.sum((F.col("c") == 1).cast("long")), F.sum(F.when(F.col("word") == "", F.col("c")))).first()
    tokens, types, once, ends = (int(x or 0) for x in stats)
    most, total = None, 0
    for b, n in sorted(unigram.where("word <> ''").groupBy(bucket.alias("b")).count().collect(), reverse=True):
        if total + n > vocabulary:
            break
        most, total = b, total + n
    rows = [] if most is None else unigram.where((F.col("word") != "") & (bucket >= most)).collect()
    rows = sorted((-r.c, r.word.encode()) for r in rows)
    counts = np.array([ends, *(-c for c, _ in rows)], np.float64)
    return Classes({w: i + FIRST_WORD for i, (_, w) in enumerate(rows)}, counts, tokens, types, once / tokens if 0 < once < tokens else 1 / (tokens + 2))


def entries_of(a: np.ndarray, b: np.ndarray, row: np.ndarray, training: bool) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(kind, [key, other, row, times]) of the token pairs (a, b). In training, pairs of two unnumbered words go to FOLLOWERS alone."""
    far_a, far_b = a >= UNNUMBERED, b >= UNNUMBERED
    near = ~(far_a | far_b)
    both = (a[near] << np.uint64(16) | b[near]) << np.uint64(13) | row[near]
    both, n = np.unique(both, return_counts=True)
    yield PAIRS, [both >> np.uint64(13), np.zeros(len(both), np.uint64), both & np.uint64(BLOCK_ROWS - 1), n.astype(np.uint64)]
    yield FOLLOWERS, tally(b[far_b], a[far_b], row[far_b], np.ones(far_b.sum(), np.uint64))
    first = far_a & ~far_b if training else far_a
    yield CONTEXTS, tally(a[first], b[first], row[first], np.ones(first.sum(), np.uint64))


def by_part(layout: Layout, kind: int, columns: list[np.ndarray]) -> Iterator[tuple[int, list[np.ndarray]]]:
    part = layout.part(kind, columns[0])
    order = np.argsort(part, kind="stable")
    part = part[order]
    at = runs(part)
    for i, j in zip(at, np.append(at, len(part))[1:], strict=True):
        yield int(part[i]), [c[order[i:j]] for c in columns]


def _blocks(docs: DataFrame, classes, layout: Layout, id_col: str, text_col: str, hot=None, limit: int = 2_000_000) -> DataFrame:
    """(part, block, entries, head): blocks of token pairs. In training (no `hot`) they are sums by pair, and head is null. Else they
    are sums by pair and row, without pairs of hot words; head is in one part's row of each block and has what needs no table: id,
    held_out, and the tokens, base sum and hot pairs' sum of numbered words. A block is named by a hash of its rows."""
    training = hot is None
    head = f"array<struct<id:{dict(docs.dtypes)[id_col]},held_out:boolean,n_tokens:bigint,n_known:bigint,base:double,near:double>>"
    schema = f"part int, block binary, entries binary, head {head}"
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = classes.value
        codes = Codes(words.ids)
        base, grid = words.log_base(words.counts), None if training else hot.value
        known_end = int(words.counts[END] > 0)
        held: list[tuple] = []
        heads: list[dict] = []
        name = xxhash.xxh3_128()
        rows = size = 0

        def flush():
            nonlocal rows, size
            a, b, row = (np.concatenate(c) for c in zip(*held, strict=True))
            out = []
            for kind, columns in entries_of(a, b, row, training):
                out += [(part, name.digest(), pack(*own), None) for part, own in by_part(layout, kind, columns)]
            if not training:
                first = out.pop() if out else (0, name.digest(), pack(*[np.zeros(0, np.uint64)] * 4), None)
                out.append((*first[:3], list(heads)))
            held.clear()
            heads.clear()
            name.reset()
            rows = size = 0
            for row in out:
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, arrow.types, strict=True)], schema=arrow)

        for batch in batches:
            for i in range(batch.num_rows):
                doc_id, text = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                out = held_out(doc_id)
                if training and out:
                    continue
                own = words_of(text)
                own = np.fromiter(map(codes.__getitem__, own), np.uint64, len(own))
                a, b = np.concatenate(([np.uint64(END)], own)), np.concatenate((own, [np.uint64(END)]))
                if not training:
                    near = (a < HOT) & (b < HOT)
                    numbered = own[own < UNNUMBERED].astype(np.int64)
                    pairs_near = float(grid[a[near].astype(np.int64), b[near].astype(np.int64)].sum())
                    heads.append({"id": doc_id, "held_out": out, "n_tokens": len(b), "n_known": len(numbered) + known_end, "base": float(base[numbered].sum() + base[END]), "near": pairs_near})
                    name.update(f"{doc_id}\0{text or ''}\0".encode("utf-8", "surrogatepass"))
                    a, b = a[~near], b[~near]
                held.append((a, b, np.full(len(a), 0 if training else rows, np.uint64)))
                rows += 1
                size += len(a)
                if size > limit or rows == BLOCK_ROWS:
                    yield from flush()
        if rows:
            yield from flush()

    rows = docs.select(F.col(f"`{id_col}`").alias("_0"), F.col(f"`{text_col}`").alias("_1"))
    return rows.mapInArrow(run, schema)


BIGRAMS = "part int, pairs binary, of_counts array<bigint>, context array<int>, low array<array<bigint>>, high array<bigint>, p array<double>, hot array<bigint>, hot_counts array<bigint>"


def count_bigrams(docs: DataFrame, classes, layout: Layout, id_col: str, text_col: str) -> DataFrame:
    """One row per part: its pairs and counts (key, other, n, 0); how many pairs have the counts 1 to CUTOFF + 1; and per numbered context
    the numbers of successors with each low count, the sum of the high counts, the probability of all successors, and its hot pairs."""
    arrow = to_arrow_schema(StructType.fromDDL(BIGRAMS))

    def merge(name, table):
        kind = layout.kind(name[0].as_py())
        key, other, zero, times = tally(*unpack_all(table.column("entries").to_pylist(), 4))
        n, words = times.astype(np.int64), classes.value
        context, p, near = other, np.zeros(len(key)), other < UNNUMBERED
        if kind == PAIRS:
            context, p = key >> np.uint64(16), words.p[(key & np.uint64(65535)).astype(np.int64)]
        elif kind == FOLLOWERS:
            p = words.p_of(of_key(key, n))
        else:
            near = np.zeros(len(key), bool)
        contexts, local = np.unique(context[near], return_inverse=True)
        k, m = len(contexts), n[near]
        low = [np.bincount(local[m == r], minlength=k).tolist() for r in range(1, CUTOFF + 1)]
        high = np.bincount(local[m > CUTOFF], m[m > CUTOFF], minlength=k).astype(np.int64)
        seen = np.bincount(local, p[near], minlength=k)
        hot = (key >> np.uint64(16) < HOT) & (key & np.uint64(65535) < HOT) & (kind == PAIRS)
        row = (name[0].as_py(), pack(key, other, times, zero), [int((n == r).sum()) for r in range(1, CUTOFF + 2)], contexts.astype(np.int64).tolist(), low, high.tolist(), seen.tolist(), key[hot].astype(np.int64).tolist(), n[hot].tolist())
        return pa.Table.from_arrays([pa.array([v], t) for v, t in zip(row, arrow.types, strict=True)], schema=arrow)

    return _blocks(docs, classes, layout, id_col, text_col).select("part", "entries").repartition(layout.all, "part").groupBy("part").applyInArrow(merge, BIGRAMS)


def of_key(key: np.ndarray, n: np.ndarray) -> np.ndarray:
    """For each row the sum of n over the rows with its key; equal keys are neighbours."""
    at = runs(key)
    return np.repeat(np.add.reduceat(n, at), np.diff(np.append(at, len(key)))) if len(at) else n


def discounts(of_counts: list[int]) -> np.ndarray:
    """Katz's factors for counts 1 to CUTOFF; where Good-Turing gives none between 0 and 1, absolute discounting's."""
    n = np.array([*of_counts, 0][: CUTOFF + 1], np.float64)
    r = np.arange(1, CUTOFF + 1)
    fixed = (r - (n[0] / (n[0] + 2 * n[1]) if n[0] else 0.5) * 0.999) / r
    if (n <= 0).any():
        return fixed
    common = (CUTOFF + 1) * n[CUTOFF] / n[0]
    d = ((r + 1) * n[1:] / n[:-1] / r - common) / (1 - common) if common < 1 else np.full(CUTOFF, -1.0)
    return np.where((d > 0) & (d < 1), d, fixed)


def context_weights(mass: np.ndarray, total: np.ndarray, seen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(log10 of what counts are divided by, log10 of the backoff weight) of contexts, from the discounted and the whole sum of their
    counts and from the probability of their successors as single words."""
    with np.errstate(divide="ignore", invalid="ignore"):
        # A context that every word has followed needs no rest: its discounted counts are scaled up to one.
        every = seen >= 1 - 1e-9
        seen = np.where(every, 0.0, seen)
        alpha = np.where(total > 0, (1 - mass / np.maximum(total, 1)) / (1 - seen), 1.0)
        # A context whose counts are all high keeps no mass by its discounts; what it has never seen gets one count's share.
        full = (mass >= total) & (total > 0)
        alpha = np.where(full, 1 / (total + 1) / (1 - seen), alpha)
        norm = np.where(every, np.maximum(mass, 1e-300), np.where(full, total + 1, np.maximum(total, 1)))
        return np.log10(norm), np.log10(alpha)


@dataclass
class Weights:
    """What scoring needs besides the tables of counts, by number: all bounded by the vocabulary."""

    classes: Classes
    discount: np.ndarray  # of the counts 0 to CUTOFF
    log_norm: np.ndarray = field(default=None)
    log_alpha: np.ndarray = field(default=None)
    hot: np.ndarray = field(default=None)  # log10 probability of token b after a, HOT x HOT

    def discounted(self, n: np.ndarray) -> np.ndarray:
        return np.where(n <= CUTOFF, self.discount[np.minimum(n, CUTOFF)], 1.0) * n


@dataclass
class KatzModel:
    """unigram (word, c) and bigrams (BIGRAMS) are tables in the shared folder; classes and weights fit in memory."""

    unigram: DataFrame
    bigrams: DataFrame
    layout: Layout
    classes: Classes
    weights: Weights


def weights_of(bigrams: DataFrame, classes: Classes) -> Weights:
    sums = bigrams.select(F.posexplode("of_counts")).groupBy("pos").agg(F.sum("col")).collect()
    weights = Weights(classes, np.concatenate(([1.0], discounts([n for _, n in sorted(sums)]))))
    size = len(classes.counts)
    zipped = F.arrays_zip("context", "high", "p", *(F.get("low", i).alias(f"n{i}") for i in range(CUTOFF)))
    flat = bigrams.select(F.inline(zipped)).groupBy("context").agg(F.sum("high"), F.sum("p"), *(F.sum(f"n{i}") for i in range(CUTOFF))).collect()
    mass, seen, total = np.zeros(size), np.zeros(size), np.zeros(size)
    for context, high, below, *low in flat:
        mass[context] = high + sum(x * (r + 1) * weights.discount[r + 1] for r, x in enumerate(low))
        total[context] = high + sum(x * (r + 1) for r, x in enumerate(low))
        seen[context] = below
    weights.log_norm, weights.log_alpha = context_weights(mass, total, seen)
    hot = min(HOT, size)
    weights.hot = weights.log_alpha[:hot, None] + np.log10(classes.p)[None, :hot]
    for pair, n in bigrams.select(F.inline(F.arrays_zip("hot", "hot_counts"))).collect():
        weights.hot[pair >> 16, pair & 65535] = np.log10(weights.discounted(np.array([n]))[0]) - weights.log_norm[pair >> 16]
    return weights


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: int = 65_533, tokens_per_part: int = 4_000_000) -> KatzModel:
    """Learn from the rows whose id isn't held out. No rows make a model that knows only unseen words."""
    spark = docs.sparkSession
    unigram = materialize(word_counts(docs, id_col, text_col), "unigram")
    classes = learn_classes(unigram, min(vocabulary, 65_533))
    unnumbered = classes.tokens - int(classes.counts.sum())
    layout = Layout(max(1, -(-classes.tokens // tokens_per_part)), max(1, -(-3 * unnumbered // tokens_per_part)))
    bigrams = materialize(count_bigrams(docs, spark.sparkContext.broadcast(classes), layout, id_col, text_col), "bigrams")
    return KatzModel(unigram, bigrams, layout, classes, weights_of(bigrams, classes))


def tables_of(model: KatzModel) -> DataFrame:
    """(part, pairs): the tables of counts, and for CONTEXTS also the pairs of two unnumbered words, with the follower's own count."""
    layout = model.layout
    arrow = to_arrow_schema(StructType.fromDDL("part int, pairs binary"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob in batch.column(1).to_pylist():
                follower, context, n, _ = unpack(blob, 4)
                far = context >= UNNUMBERED
                own = [context[far], follower[far], n[far], of_key(follower, n)[far]]
                order = np.lexsort((own[1], own[0]))
                for part, columns in by_part(layout, CONTEXTS, [c[order] for c in own]):
                    yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([pack(*columns)], pa.binary())], schema=arrow)

    stored = model.bigrams.select("part", "pairs")
    followers = stored.where((F.col("part") >= layout.pairs) & (F.col("part") < layout.pairs + layout.unnumbered))
    return stored.unionByName(followers.mapInArrow(run, "part int, pairs binary"))


def scorer(kind: int, blobs: list[bytes], weights: Weights):
    """A function from (key, other) of token pairs to their log10 probability, or this part's share of it, and to the count of the
    token where it is kept here (FOLLOWERS), else None.

    Where neither word has a number, FOLLOWERS gives what depends on the token and CONTEXTS what depends on the context.
    """
    keys, others, n, c = unpack_all(blobs, 4)
    order = np.lexsort((others, keys))
    keys, others, n, c = keys[order], others[order], n[order].astype(np.int64), c[order].astype(np.int64)
    classes = weights.classes
    p = classes.p
    log_p = np.log10(p)
    numbered = others < UNNUMBERED
    starts = runs(keys)
    if kind == CONTEXTS and len(starts):
        single = classes.p_of(c)
        single[numbered] = p[others[numbered].astype(np.int64)]
        norm, alpha = context_weights(np.add.reduceat(weights.discounted(n), starts), np.add.reduceat(n, starts), np.add.reduceat(single, starts))
    of_follower = of_key(keys, n)

    def score(key: np.ndarray, other: np.ndarray):
        at = find(keys, others, key, other)
        seen = at >= 0
        times = np.where(seen, n[at], 0) if len(n) else np.zeros(len(key), np.int64)
        gain = np.zeros(len(key))
        gain[seen] = np.log10(weights.discounted(times[seen]))
        if kind == PAIRS:
            a, b = (key >> np.uint64(16)).astype(np.int64), (key & np.uint64(65535)).astype(np.int64)
            return np.where(seen, gain - weights.log_norm[a], weights.log_alpha[a] + log_p[b]), None
        near = other < UNNUMBERED
        word = np.where(near, other, 0).astype(np.int64)
        first = np.minimum(np.searchsorted(keys, key), max(len(keys) - 1, 0))
        known = keys[first] == key if len(keys) else np.zeros(len(key), bool)
        if kind == FOLLOWERS:
            count = np.where(known, of_follower[first], 0) if len(keys) else np.zeros(len(key), np.int64)
            value = np.where(seen, gain, np.log10(classes.p_of(count)))
            return value + np.where(near, np.where(seen, -weights.log_norm[word], weights.log_alpha[word]), 0.0), count
        value = np.where(near, np.where(seen, gain, log_p[word]), 0.0)
        if len(keys):
            place = np.searchsorted(starts, first, side="right") - 1
            value += np.where(seen, -norm[place], np.where(known, alpha[place], 0.0))
        return value, None

    return score


def score(docs: DataFrame, model: KatzModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, held_out, n_tokens, n_known, train_tokens, base_score, score (both log10).

    Null and empty texts are their end alone. A null id counts as the empty text when rows are held out, and stays
    null; repeated rows are learned from each and score alike; an empty table gives no rows; other columns are ignored.
    """
    context = docs.sparkSession.sparkContext
    classes, layout = context.broadcast(model.classes), model.layout
    weights, hot = context.broadcast(model.weights), context.broadcast(model.weights.hot)
    blocks = _blocks(docs, classes, layout, id_col, text_col, hot)
    returned = StructType([blocks.schema["block"], *StructType.fromDDL("sums binary").fields, blocks.schema["head"]])
    sums_arrow = to_arrow_schema(returned)

    def score_part(name, entries, table):
        values = scorer(layout.kind(name[0].as_py()), table.column("pairs").to_pylist(), weights.value)
        out = []
        for blob in entries.column("entries").to_pylist():
            key, other, row, times = unpack(blob, 4)
            value, count = values(key, other)
            there, local = np.unique(row, return_inverse=True)
            base, known = (np.zeros(len(key)), np.zeros(len(key))) if count is None else (classes.value.log_base(count), (count > 0) * STEP)
            sums = [np.bincount(local, times * x, minlength=len(there)) for x in (value, base, known)]
            out.append(pack(there, *(np.rint(x / STEP).astype(np.int64).view(np.uint64) for x in sums)))
        return pa.Table.from_arrays([entries.column("block"), pa.array(out, pa.binary()), entries.column("head")], schema=sums_arrow)

    kind = dict(docs.dtypes)[id_col]
    result = f"_id {kind}, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double"
    result_arrow = to_arrow_schema(StructType.fromDDL(result))

    def add_up(name, table):
        """Blocks of the same rows have one name, and the sums of all; each gets an equal share."""
        heads = [h for h in table.column("head").to_pylist() if h is not None]
        total = np.zeros((3, BLOCK_ROWS), np.int64)
        for blob in table.column("sums").to_pylist():
            row, *values = unpack(blob, 4)
            for t, v in zip(total, values, strict=True):
                t[row.astype(np.int64)] += v.view(np.int64)
        value, base, known = total / max(len(heads), 1) * [[STEP], [STEP], [1]]
        rows = [(x["id"], x["held_out"], x["n_tokens"], x["n_known"] + round(known[i]), x["base"] + base[i], x["near"] + value[i]) for h in heads for i, x in enumerate(h)]
        return pa.Table.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(result_arrow.types)], schema=result_arrow)

    # As many tasks as parts, so that none grows with the corpus.
    left, right = (side.repartition(layout.all, "part").groupBy("part") for side in (blocks, tables_of(model)))
    parts = left.cogroup(right).applyInArrow(score_part, returned)
    return parts.groupBy("block").applyInArrow(add_up, result).select(
        F.col("_id").alias(id_col), "held_out", "n_tokens", "n_known", F.lit(model.classes.tokens).cast("long").alias("train_tokens"), "base_score", "score"
    )
