"""The bias model against plain loops, on planted and on flat bias."""

import math
import random

import numpy as np
import pytest

from tallyspark.functions import bias as kernel
from tallyspark.operators import bias, features, prepare
from tallyspark.sources import readers
from tests.test_bam import SEQUENCES, record, whole_file
from tests.test_prepare import GENES, annotation, fragments


def greedy(rows, highest):
    """(orders, loss): the search with every product over every example at each try."""
    width, n = len(rows[0][1]), len(rows)
    code = [["ACGT".index(c) for c in s] for _, s in rows]

    def tables(j, order):
        out = [{}, {}]
        for (y, _), c in zip(rows, code, strict=True):
            key = tuple(c[j + 1 : j + 1 + order])
            out[y].setdefault(key, [1.0] * 4)[c[j]] += 1
        return [[out[y].get(tuple(c[j + 1 : j + 1 + order]), [1.0] * 4)[c[j]] / sum(out[y].get(tuple(c[j + 1 : j + 1 + order]), [1.0] * 4)) for c in code] for y in (0, 1)]

    orders, p, parameters = [-1] * width, [[[1.0] * n] * width, [[1.0] * n] * width], 0

    def loss(p, parameters):
        total = 0.0
        for i, (y, _) in enumerate(rows):
            b, f = (math.prod(p[k][j][i] for j in range(width)) for k in (0, 1))
            total += math.log((f if y else b) / (f + b))
        return -(2 * total - parameters * math.log(n))

    best = loss(p, 0)
    while True:
        found = None
        for j in range(width):
            if orders[j] < highest and j + orders[j] + 1 < width:
                o = orders[j] + 1
                added = 4 ** (1 + o) - (4**o if o else 0)
                t = tables(j, o)
                tried = [[t[k] if i == j else p[k][i] for i in range(width)] for k in (0, 1)]
                value = loss(tried, parameters + added)
                if value < (found[0] if found else best):
                    found = value, j, tried, added
        if not found:
            return orders, best
        best, j, p, added = found
        orders[j] += 1
        parameters += added


def made_examples(pick, n, width):
    """Place 2 is mostly its follower, or the letter after that, as the second follower says, so that T is frequent; place 5 is mostly G: in fragments only."""
    out = []
    for i in range(n):
        s = [pick.randrange(4) for _ in range(width)]
        if i % 2:
            if pick.random() < 0.8:
                s[5] = 2
            if pick.random() < 0.9:
                s[2] = min(3, s[3] + (s[4] > 1))
        out.append((i % 2, "".join("ACGT"[c] for c in s)))
    return out


def test_sequence_bias_finds_planted_orders(spark):
    rows = made_examples(random.Random(1), 3000, 7)
    model = bias.fit_sequence_bias(spark.createDataFrame(rows, "y int, seq string").repartition(3), highest=3)
    assert model.orders == greedy(rows, 3)[0] and model.orders[2] == 2 and model.orders[5] == 0
    score = model.score(np.stack([kernel.codes(s) for _, s in rows]))
    assert ((score > 0) == [y == 1 for y, _ in rows]).mean() > 0.85


def test_sequence_bias_of_uniform_letters_is_none(spark):
    pick = random.Random(2)
    rows = [(i % 2, "".join(pick.choice("ACGT") for _ in range(9))) for i in range(3000)]
    assert bias.fit_sequence_bias(spark.createDataFrame(rows, "y int, seq string")).orders == [-1] * 9
    assert bias.fit_sequence_bias(spark.createDataFrame([], "y int, seq string")).orders == []
    with pytest.raises(ValueError, match="one width"):
        bias.fit_sequence_bias(spark.createDataFrame([(1, "AC"), (0, "A")], "y int, seq string"))


def some_model(seed):
    pick = np.random.default_rng(seed)
    side = lambda: kernel.SequenceBias([pick.integers(-1, 3) if j < 17 else -1 for j in range(kernel.WIDTH)], [pick.normal(0, 0.3, 4**3) for _ in range(kernel.WIDTH)])
    return kernel.FragmentBias(side(), side(), pick.uniform(0.5, 2, 101))


def slow_length(model, name, text, lengths, pmf):
    pad = "".join("ACGT"[c] for c in kernel.padding(name, 2 * kernel.WIDTH))
    padded = pad[: kernel.WIDTH] + text + pad[kernel.WIDTH :]

    def end(side, start):
        total = 1.0
        for j, order in enumerate(side.orders):
            if order >= 0:
                at = 0
                for c in padded[start + j : start + j + order + 1]:
                    at = at * 4 + "ACGT".index(c)
                total *= math.exp(side.tables[j][at])
        return total

    out = 0.0
    for k, p in zip(lengths, pmf, strict=True):
        for a in range(len(text) - k + 1):
            b = a + k - 1
            share = sum(c in "GC" for c in text[a : b + 1]) / k
            out += p * end(model.left, a + kernel.WIDTH - kernel.OUTER) * end(model.right, b + kernel.WIDTH - kernel.INNER + 1) * model.gc[min(100, math.floor(share * 100 + 0.5))]
    return max(out, 1.0)


def test_biased_lengths_equal_the_loops(spark):
    pick, model = random.Random(5), some_model(1)
    texts = {f"t{i:02d}": "".join(pick.choice("ACGT") for _ in range(pick.choice([1, 30, 80, 120]))) for i in range(50)} | {"none": ""}
    lengths = [(k, math.exp(-(((k - 40) / 15) ** 2))) for k in range(1, 101)]
    top = sorted(lengths, key=lambda r: (-r[1], r[0]))[:25]
    got = bias.biased_lengths(spark.createDataFrame(list(texts.items()), "feature string, seq string"), model, spark.createDataFrame(lengths, "length int, pmf double"), most=25)
    for r in got.collect():
        assert math.isclose(r.efflen, slow_length(model, r.feature, texts[r.feature], *zip(*top, strict=True)), rel_tol=1e-9), r.feature


def test_flat_bias_is_the_simple_length(spark):
    pick = random.Random(6)
    texts = [(f"t{i}", "".join(pick.choice("ACGT") for _ in range(pick.randint(1, 900)))) for i in range(30)]
    lengths = spark.createDataFrame([(k, 1 / 150) for k in range(1, 151)], "length long, pmf double")
    simple = features.effective_lengths(spark.createDataFrame([(n, len(t)) for n, t in texts], "feature string, t long"), lengths)
    want = {r.feature: r.efflen for r in simple.collect()}
    got = bias.biased_lengths(spark.createDataFrame(texts, "feature string, seq string"), kernel.flat(), lengths)
    assert all(math.isclose(r.efflen, want[r.feature], rel_tol=1e-9) for r in got.collect())


def test_gc_bias_is_the_ratio_of_shares(spark):
    pick = random.Random(7)
    rows = [(1, min(0.99, max(0.0, pick.gauss(0.6, 0.1)))) for _ in range(3000)] + [(0, min(0.99, max(0.0, pick.gauss(0.5, 0.1)))) for _ in range(3000)]
    gc = bias.fit_gc_bias(spark.createDataFrame(rows, "y int, gc double"))
    assert len(gc) == 101 and gc[35] < 0.3 and gc[75] > 3 and abs(gc[55] - 1) < 0.35 and np.all(np.diff(gc[[20, 40, 50, 60, 70, 90]]) >= 0)


def test_prepared_likelihood_under_bias(spark, tmp_path):
    """Fragments that begin with an A are kept, others at times: the model sees it, and probabilities are those of its parts."""
    pick = random.Random(9)
    number = {n: i for i, (n, _) in enumerate(SEQUENCES)}
    bases = {t: "".join(pick.choice("ACGT") for _ in range(sum(b - a + 1 for a, b in e))) for t, (_, _, e) in GENES.items()}
    rows = fragments(pick, 9000)
    kept = set()
    for n, _, s, p, _ in rows[::2]:
        t = next((t for t in ("a1", "b1") if GENES[t][0] == s), None)
        first = sum(max(0, min(b, p) - a + (a <= p)) for a, b in GENES[t][2])
        letter = bases[t][first - 1] if t == "a1" and 1 <= first <= len(bases[t]) else "A"
        if letter == "A" or pick.random() < 0.2:
            kept.add(n)
    (tmp_path / "r.bam").write_bytes(whole_file([record(n, f, number[s], p - 1, c) for n, f, s, p, c in rows if n in kept], 20_000))
    (tmp_path / "g.gff3").write_text(annotation())
    ts = readers.transcripts(readers.gff3_rows(spark, str(tmp_path / "g.gff3")))
    ts = ts.join(spark.createDataFrame(list(bases.items()), "transcript_id string, seq string"), "transcript_id")
    made, model = bias.biased_likelihood(ts, readers.bam(spark, str(tmp_path / "r.bam")), highest=1)
    assert model.left.orders[kernel.OUTER] >= 0 and model.left.tables[kernel.OUTER].reshape(4, -1)[0].mean() > model.left.tables[kernel.OUTER].reshape(4, -1)[1:].mean() + 0.3
    efflen, pmf = {r.feature: r.efflen for r in made.efflens.collect()}, {r.length: r.pmf for r in made.lengths.collect()}
    by_position = {t: model.by_position(t, s) for t, s in bases.items()}
    names = {r.read: r.read_name for r in made.names.collect()}
    assert set(names.values()) == kept
    possible = lambda f, p: any(
        math.isclose(p, pmf[k] * by_position[f][0][a] * by_position[f][1][a + k - 1] * model.gc[kernel.hundredths(np.array([(by_position[f][2][a + k - 1] - (by_position[f][2][a - 1] if a else 0)) / k]))[0]] / efflen[f], rel_tol=1e-9)
        for k in range(60, 300)
        for a in range(len(bases[f]) - k + 1)
    )
    assert all(possible(r.feature, r.prob) for r in made.likelihood.orderBy("read", "feature").limit(6).collect())
    shares = {r.feature: r.tpm for r in prepare.posterior_tpm(prepare.prepare_sample("s", made, "list", steps=200), 100).collect()}
    assert math.isclose(sum(shares.values()), 1e6, rel_tol=1e-6)


def test_bias_query_equals_the_loops(spark):
    from tallyspark.plans.sequencing import line_examples, sequence_bias

    sf = "/root/testdata/sf0.001"
    rows = [(int(r.y), r.seq) for r in line_examples(spark, sf).collect()]
    orders, _ = greedy(rows, kernel.HIGHEST_ORDER)
    got = {r.place: r.order for r in sequence_bias(spark, sf).collect()}
    assert got == {j: o for j, o in enumerate(orders) if o >= 0} and len(got) > 1
