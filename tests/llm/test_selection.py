"""Resampling, divergence of sources and exact dedup against brute-force versions, on tricky rows and on made ones."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tallyspark.llm import common, divergence, exact_dedup, importance

SF = "/root/testdata/sf0.001"
AZ = str.maketrans(common.UPPER, common.LOWER)
WORD, TERM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
PROSE = " ".join(f"word{i % 37} x{i}" for i in range(60))
LONG = "Xy é " * 300_000 + "q" * 1_000_000
ROWS = [
    (1, None, "en", "a"), (2, "", "en", None), (3, " \n\t ", None, "a"), (4, " ", None, None), (5, PROSE, "en", "a"), (6, PROSE.upper(), "en", "b"), (7, PROSE + " tail", "en", "b"),
    (7, PROSE + " tail", "en", "b"), (8, "É è\n\n été\x0b ß 中文字 ١٢", "fr", "a"), (9, "É è été\tß 中文字 ١٢", "fr", "é"), (None, PROSE, "en", "z"), (None, PROSE, "en", "z"),
    (None, "alone", "de", "a"), (10, PROSE.replace(" ", "\r\n  "), "en", "a"), (11, LONG, "en", "a"), (12, LONG.replace(" ", "\n"), "de", "b"), (13, "a b", "en", "a"), (14, "a b", "en", "a"),
]


@pytest.fixture(scope="module")
def rows(spark):
    return ROWS + [(r.doc_id + 1000, r.text, r.lang, r.source) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]


@pytest.fixture(scope="module")
def docs(spark, rows):
    """Extra columns have names that results and helpers use."""
    odd = [(*r, "x", 1, "y", None, 2, False, "z") for r in rows]
    return spark.createDataFrame(odd, "doc_id long, text string, lang string, source string, term string, n long, _full string, rank long, weight int, kept boolean, _id string").repartition(3)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def brute_ranks(rows, target, buckets, longest, share, min_words, seed):
    def features(text):
        words = re.findall(WORD, (text or "").translate(AZ))
        return len(words), [zlib.crc32(" ".join(words[i : i + n]).encode()) % buckets for n in range(1, longest + 1) for i in range(len(words) - n + 1)]

    own = [features(r[1]) for r in rows]
    s, t = Counter(b for _, f in own for b in f), Counter(b for text in target for b in features(text)[1])
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets)))) for b in range(buckets)]
    out = []
    for row, (n_words, f) in zip(rows, own, strict=True):
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'' if row[0] is None else row[0]}".encode()).hexdigest()[:8], 16)
        out.append([row[0], len(f), n_words, weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None])
    fit = sorted((r for r in out if r[2] >= min_words), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[1], r[3]))
    for i, r in enumerate(fit[: share[0] * len(fit) // share[1]]):
        r[5] = i + 1
    return sorted(map(tuple, out), key=repr)


@pytest.mark.parametrize("buckets, longest, share, least, seed", [(10_000, 1, (10, 100), 20, 2024), (97, 2, (1, 1), 0, 7), (64, 3, (1, 3), 1, 1), (1, 1, (0, 5), 0, 1)])
def test_resampling(spark, rows, docs, buckets, longest, share, least, seed):
    target = [*(r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()), None, ""]
    aim = spark.createDataFrame([(t,) for t in target], "text string")
    got = importance.resampling_ranks(docs.drop("rank", "weight"), aim, buckets=buckets, longest=longest, share=share, min_words=least, seed=seed)
    assert rows_of(got) == brute_ranks(rows, target, buckets, longest, share, least, seed)


def test_resampling_draws_towards_the_target(spark):
    """Documents of the target's words are a tenth of all, and nearly all of the draw."""
    pick = random.Random(1)
    texts = [" ".join(pick.choice("abcdefgh" if i % 10 else "stuvwxyz") for _ in range(200)) for i in range(600)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    aim = spark.createDataFrame([("s t u v w x y z " * 20,)], "text string")
    drawn = importance.resample(docs.selectExpr("*", "1 AS score", "2 AS _before"), aim)
    assert drawn.columns == ["doc_id", "text", "score", "_before"]
    ids = [r.doc_id for r in drawn.collect()]
    assert len(ids) == 60 and sum(i % 10 == 0 for i in ids) > 45


def test_resampling_of_nothing(spark, docs):
    empty = docs.limit(0)
    aim = spark.createDataFrame([("a b",)], "text string")
    assert importance.resampling_ranks(empty.drop("rank", "weight"), aim).count() == 0
    assert {r.weight <= 0 or r.n_features == 0 or r.weight > 0 for r in importance.resampling_ranks(docs.drop("rank", "weight"), aim.limit(0)).collect()} == {True}
    with pytest.raises(ValueError, match="id column"):
        importance.resampling_ranks(docs, aim, id_col="rank")


def test_bit_planes_add_up():
    pick = np.random.default_rng(3)
    for width in (1, 63, 64, 65, 300):
        counts = pick.integers(0, 5000, (7, width)) * (pick.random((7, width)) < 0.4)
        gains = pick.integers(-9000, 9000, width)
        assert importance.Gains(gains.tolist()).sums(counts).tolist() == (counts @ gains).tolist()


def brute_divergence(rows, min_docs, smooth, top):
    own, df, n = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter)
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        terms = re.findall(TERM, (text or "").translate(AZ))
        own[lang, source].update(terms)
        df[lang].update(set(terms))
        n[lang].update(terms)
    out = []
    share = lambda c, size, v: 1 + 10**9 * (c + smooth) // (size + smooth * v)
    for lang in df:
        kept = sorted(t for t, k in df[lang].items() if k >= min_docs)
        sources = [s for la, s in own if la == lang]
        sizes = {s: sum(own[lang, s][t] for t in kept) for s in sources}
        p = {s: [share(own[lang, s][t], sizes[s], len(kept)) for t in kept] for s in sources}
        q = [share(n[lang][t], sum(n[lang][t] for t in kept), len(kept)) for t in kept]
        for s in sources:
            pairs = [(-sum(abs(a - b) for a, b in zip(p[s], p[o], strict=True)), o.encode()) for o in sources if o != s]
            terms = [(-(a - b), t.encode()) for t, a, b in zip(kept, p[s], q, strict=True) if own[lang, s][t] and a > b]
            for part, items in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
                out += [(lang, s, part, i.decode(), -v, k) for k, (v, i) in enumerate(items, 1)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("min_docs, smooth, top, group_block, term_block", [(30, 5, 50, 32, 2048), (1, 1, 3, 3, 50), (2, 7, 10**6, 1, 10**6), (10**6, 5, 50, 32, 2048)])
def test_divergence(rows, docs, min_docs, smooth, top, group_block, term_block):
    got = divergence.source_divergence(docs, min_docs=min_docs, smooth=smooth, top=top, group_block=group_block, term_block=term_block)
    assert rows_of(got) == brute_divergence(rows, min_docs, smooth, top)


def test_divergence_of_nothing_and_of_wide_counts(spark, docs):
    assert divergence.source_divergence(docs.limit(0)).count() == 0
    wide = spark.createDataFrame([(9_000_000_000_000, 9_100_000_000_000, 1000)], "n long, size long, terms long")
    (got,) = wide.select(divergence._share("n", "size", "terms", 5)).first()
    assert got == 1 + 10**9 * 9_000_000_000_005 // (9_100_000_000_000 + 5000)


@pytest.mark.parametrize("limit", [1, 50])
def test_divergence_sends_counts_on_when_full(monkeypatch, rows, docs, limit):
    """Counts that a worker sends in several parts add up."""
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([r[i] or "" for r in rows]) for i in (2, 3, 1)], names=["lang", "source", "text"])
    whole, parts = Counter(), Counter()
    for row in (r for b in divergence._counted(iter([batch])) for r in b.to_pylist()):
        whole[row["lang"], row["source"], row["term"]] += row["n"] * 10**6 + row["docs"]
    monkeypatch.setattr(divergence, "COUNTED", limit)
    for row in (r for b in divergence._counted(iter([batch, batch])) for r in b.to_pylist()):
        parts[row["lang"], row["source"], row["term"]] += row["n"] * 10**6 + row["docs"]
    assert parts == Counter({k: 2 * v for k, v in whole.items()})


def brute_copies(rows):
    form = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = defaultdict(list)
    for r in rows:
        groups[form(r[1])].append(r[0])
    keep = {t: min((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    out = []
    for r in rows:
        t = form(r[1])
        n = len(groups[t])
        first = keep[t] if n > 1 else r[0]
        out.append((r[0], first, n, r[0] == first, hashlib.sha256(t.encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("prefix, words", [(64, 1 << 18), (1, 1), (0, 3)])
def test_exact_dedup(rows, docs, prefix, words):
    """The bit table may be as full as it likes, and the beginning as short."""
    from pyspark.sql import functions as F

    got = exact_dedup.mark_copies(docs, prefix=prefix, filter_words=words)
    digest = got.select("doc_id", "keep_id", "group_size", "kept", F.sha2(exact_dedup.normalised(F.col("text")), 256))
    assert rows_of(digest) == brute_copies(rows)
    assert [c for c in got.columns if c not in exact_dedup.RESULTS] == [c for c in docs.columns if c != "kept"]


def test_exact_dedup_of_nothing_and_of_a_hot_group(spark, docs):
    assert exact_dedup.mark_copies(docs.limit(0)).count() == 0
    with pytest.raises(ValueError, match="kept"):
        exact_dedup.mark_copies(docs, id_col="kept")
    made = spark.createDataFrame([(i, "the same  text" if i % 3 else f"text {i}") for i in range(3000, 0, -1)], "doc_id long, text string")
    kept = exact_dedup.keep_one_each(made)
    assert kept.columns == made.columns and sorted(r.doc_id for r in kept.collect()) == sorted([1, *range(3, 3001, 3)])


def test_exact_dedup_reads_whole_texts_of_survivors_only(spark):
    """A text of an own length, or of an own beginning among those of its length, is in no group of the second or third step."""
    from pyspark.sql import functions as F

    made = spark.createDataFrame([(1, "abc"), (2, "abcd"), (3, "xbcd"), (4, "abce"), (5, "abcde"), (6, "abcde")], "doc_id long, text string")
    signed = exact_dedup._signed(made, F.col("text"), 2)
    assert {r._length for r in exact_dedup.shared_starts(signed.select("_length", "_start")).collect()} == {4, 5}
