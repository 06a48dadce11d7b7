"""Operators on hand-made rows, kernels by identities, and every catalog query against its SQL on the smallest tables."""

import hashlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyspark.functions import approximation, hashes, kernels, scalar
from tallyspark.operators import compatibility, coregulation, effects, features, fragments, graph, intervals, likelihood, models, posterior, relations
from tallyspark.plans import catalog, more, store
from tallyspark.sources import readers, sinks
from tallyspark.streaming import counts

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(tuple(str(round(x, 9)) if isinstance(x, float) else str(x) for x in row) for row in frame.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_equals_sql(spark, duck, name):
    got, want = catalog.QUERIES[name](spark, SF).toPandas(), duck.sql(catalog.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and plain(got) == plain(want)


def test_further_queries_are_registered():
    assert {"fragment_probability", "store_transcript_sides"} <= {n for n in dir(more)} & set(catalog.QUERIES)


def test_side_stores_are_attached_side_by_side(spark, tmp_path):
    for k in ("a", "b"):
        store.write({"effects": spark.createDataFrame([(k, 1, 0.5)], "factor string, feature_num long, w double")}, str(tmp_path / k))
        store.attach(spark, str(tmp_path / k), f"{k}_")
    assert [tuple(r) for r in spark.sql("SELECT x.factor, y.factor FROM a_effects x JOIN b_effects y USING (feature_num)").collect()] == [("a", "b")]


def test_dense_ids_over_ranges(spark):
    rows = spark.createDataFrame([(i * 7 % 50, None if i % 3 else "x") for i in range(200)], "k int, other string")
    assert [(r.k, r.id) for r in relations.dense_ids(rows, ["k"]).orderBy("k").collect()] == [(i, i + 1) for i in range(50)]
    assert relations.dense_ids(rows.limit(0), ["k"]).count() == 0


def test_em_step_by_hand(spark):
    x = spark.createDataFrame([(1, 1, 1.0), (1, 2, 1.0), (2, 1, 1.0)], "read int, feature int, prob double")
    f = spark.createDataFrame([(1, 1.0), (2, 1.0), (3, 1.0)], "feature int, efflen double")
    assert {r.feature: r.y for r in likelihood.em(x, f, rounds=1).collect()} == {1: 0.75, 2: 0.25, 3: 0.0}
    assert {r.feature: round(r.y, 2) for r in likelihood.em(x, f).collect()} == {1: 1.0, 2: 0.0, 3: 0.0}


def test_positions_and_introns(spark):
    df = spark.sql("SELECT array(named_struct('first', 101L, 'last', 200L), named_struct('first', 301L, 'last', 400L)) AS e")
    at = lambda p, s: scalar.transcript_position(F.lit(p), F.col("e"), F.lit(s))
    row = df.select(at(201, 1), at(301, 1), at(301, -1), scalar.exonic_length(F.col("e")), scalar.introns(F.col("e"))).first()
    assert tuple(row)[:4] == (0, 101, 100, 200) and [tuple(i) for i in row[4]] == [(201, 300)]


def test_gap_clusters(spark):
    df = spark.createDataFrame([(1, 100), (1, 300), (1, 700)], "k int, at int")
    assert sorted((r["first"], r["last"], r.members) for r in intervals.gap_clusters(df, ["k"], "at", 250).collect()) == [(100, 300, 2), (700, 700, 1)]


def test_pairs_too_far_apart_are_dropped(spark):
    df = spark.createDataFrame([(1, 1, 0, 10), (1, 2, 500_000, 500_002), (2, 1, 5, 9), (3, 1, 0, 5), (3, 2, 20, 30)], "read int, mate int, left long, right long")
    assert sorted(tuple(r) for r in intervals.pair_mates(df, ["read"]).collect()) == [(2, 5, 9, True), (3, 0, 30, False)]


def test_cassette_and_mutex(spark):
    rows = [("A", f, l) for f, l in ((1, 10), (21, 30), (41, 50))] + [("B", f, l) for f, l in ((1, 10), (41, 50))] + [("C", f, l) for f, l in ((1, 10), (32, 38), (41, 50))]
    df = spark.createDataFrame([(t, "s", 1, f, l) for t, f, l in rows], "transcript string, seqname string, strand int, first long, last long")
    found = {r["first"]: (r.include, r.exclude) for r in features.cassette_exons(df).collect()}
    assert found == {21: (["A"], ["B"]), 32: (["C"], ["B"])}
    (m,) = features.mutually_exclusive_exons(df).collect()
    assert (m.first_a, m.last_a, m.first_b, m.last_b) == (21, 30, 32, 38) and not set(m.include) & set(m.exclude) and m.include and m.exclude


def test_length_distribution_falls_back(spark):
    d = features.length_distribution(spark.createDataFrame([(5,)], "length long")).toPandas().set_index("length")
    assert d.pmf.idxmax() == 150 and d.pmf.sum() == pytest.approx(1)
    e = features.effective_lengths(spark.createDataFrame([(1,), (500,)], "t long"), features.length_distribution(spark.createDataFrame([(5,)], "length long")))
    assert {r.t: round(r.efflen, 3) for r in e.collect()}[1] == 1.0


def test_tree_by_hand():
    x, _ = kernels.sticks(np.array([0.25]), np.array([0, 1, 1]), np.array([0, 2, 1]))
    assert x.tolist() == [0.25, 0.75]


@pytest.mark.parametrize("n", [2, 3, 9])
def test_simplex_maps_round_trip(n):
    rng = np.random.default_rng(n)
    parents, leaves = kernels.sequential_tree(n)
    y = rng.uniform(0.1, 0.9, n - 1)
    x, log_jacobian = kernels.sticks(y, parents, leaves)
    assert x.sum() == pytest.approx(1) and kernels.inverse_sticks(x, parents, leaves) == pytest.approx(y)
    grid = np.array([(kernels.sticks(y + 1e-6 * (np.arange(n - 1) == i), parents, leaves)[0] - x)[: n - 1] / 1e-6 for i in range(n - 1)])
    assert np.log(abs(np.linalg.det(grid))) == pytest.approx(log_jacobian, abs=1e-3)
    assert kernels.inverse_additive_log_ratio(kernels.additive_log_ratio(x)) == pytest.approx(x)
    assert kernels.inverse_isometric_log_ratio(kernels.isometric_log_ratio(x)) == pytest.approx(x)
    z, one = rng.standard_normal(3), np.ones(3)
    f = lambda v: kernels.skewed_logit_normal(v, 0.2 * one, 0.7 * one, 0.3 * one)
    assert np.exp(f(z)[1]) == pytest.approx((f(z + 1e-6)[0] - f(z - 1e-6)[0]) / 2e-6, rel=1e-4)
    assert kernels.min_effect_size(0.0, 1.0) == pytest.approx(0.1257, abs=2e-3)


def test_posterior_and_gibbs(spark):
    parents, leaves = (a.tolist() for a in kernels.sequential_tree(3))
    df = spark.createDataFrame([("s", [0.0, 1.0], [-8.0, -8.0], [0.0, 0.0], parents, leaves)], "sample string, mu array<double>, omega array<double>, alpha array<double>, parents array<int>, leaves array<int>")
    mean = {r.feature: r.tpm for r in posterior.posterior_mean(posterior.sample_posterior(df, 20)).collect()}
    want = 1e6 * kernels.sticks(kernels.logistic(np.array([0.0, 1.0])), np.array(parents), np.array(leaves))[0]
    assert [mean[i] for i in range(3)] == pytest.approx(want.tolist(), rel=1e-2)
    x = spark.createDataFrame([("s", r, r % 2, 1.0) for r in range(40)], "sample string, read int, feature int, prob double")
    out = posterior.gibbs(x, [1.0, 1.0], 2, 30, 2, 10).toPandas()
    assert len(out) == 60 and np.mean([v[0] for v in out.x]) == pytest.approx(0.5, abs=0.1)


def test_readers(spark, tmp_path):
    (tmp_path / "a.gff3").write_text("##gff-version 3\ns\tx\tgene\t1\t50\t.\t+\t.\tID=g1;Name=G,H\ns\tx\tmRNA\t1\t50\t.\t-\t.\tID=t1;Parent=g1;biotype=coding\ns\tx\texon\t7\t9\t.\t-\t.\tParent=t1\ns\tx\texon\t1\t3\t.\t-\t.\tParent=t1\n")
    (tmp_path / "g.fa").write_text(">s first\nACGT\nGGTTA\n>other\nAC\n")
    (tmp_path / "r.sam").write_text("@HD\tVN:1\nr1/1\t0\ts\t5\t60\t2S3M4N2M\t*\t0\t0\t*\t*\nr1/1\t0\ts\t5\t60\t2S3M4N2M\t*\t0\t0\t*\t*\nr2\t4\t*\t0\t0\t*\t*\t0\t0\t*\t*\n")
    (tmp_path / "eq.txt").write_text("2\n2\na\nb\n1\t0\t1.0\t7\n2\t0\t1\t0.25\t0.75\t3\n")
    (tmp_path / "e.yml").write_text("samples:\n- name: one\n  factors: {k: v, m: null}\n- name: two\n  file: f\n")
    rows = readers.gff3_rows(spark, str(tmp_path / "a.gff3"))
    t = readers.spliced(readers.transcripts(rows), readers.fasta(spark, str(tmp_path / "g.fa"))).first()
    assert (t.transcript_id, t.gene_id, t["first"], t["last"], t.exonic_length, t.seq) == ("t1", "g1", 1, 9, 6, "TAACGT")
    assert tuple(readers.genes(rows).first()) == ("g1", "G", "", "")
    (s,) = readers.sam(spark, str(tmp_path / "r.sam"), strip_mate=True).collect()
    assert (s.read_name, s.left, s.right) == ("r1", 3, 13)
    c = {r.class_id: (r.features, r.probs, r["count"]) for r in readers.equivalence_classes(spark, str(tmp_path / "eq.txt")).collect()}
    assert c == {0: (["a"], [1.0], 7), 1: (["a", "b"], [0.25, 0.75], 3)}
    e = {r["sample"]: (r.file, r.factors) for r in readers.experiment(spark, str(tmp_path / "e.yml")).collect()}
    assert e == {"one": ("one.prep.parquet", {"k": "v", "m": None}), "two": ("f", {})}
    sinks.write_tpm(spark.createDataFrame([("a", 1e6)], "transcript_id string, tpm double"), str(tmp_path / "tpm"))
    both = spark.createDataFrame([("a",), ("b",)], "transcript_id string")
    assert sorted(tuple(r) for r in readers.point_estimates(spark, str(tmp_path / "tpm"), both).collect()) == [("a", 1.0), ("b", 0.0)]


def test_stream_equals_batch(spark, tmp_path):
    schema = spark.read.parquet(f"{SF}/events.parquet").schema
    spark.read.parquet(f"{SF}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")).repartition(3).write.parquet(str(tmp_path / "in"))
    batch = spark.read.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in")).select("ts", F.col("event_type").alias("sample"), F.col("event_id").alias("read"), (F.col("user_id") % 5).alias("class_key"))
    q = counts.class_counts(stream, "60 days").writeStream.outputMode("complete").format("memory").queryName("classes").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    want = batch.groupBy(F.col("event_type").alias("sample"), (F.col("user_id") % 5).alias("class_key")).count()
    assert sorted(map(tuple, spark.sql("SELECT * FROM classes").collect())) == sorted(map(tuple, want.collect())) and schema


def test_approximation_gradients():
    rng = np.random.default_rng(4)
    parents, leaves = kernels.sequential_tree(4)
    classes = approximation.Classes(np.array([0, 0, 1, 1, 2]), np.array([0, 1, 1, 2, 3]), np.array([0.5, 0.2, 0.3, 0.9, 1.0]), np.array([30.0, 20.0, 5.0]), 4)
    z, values = rng.standard_normal(3), [rng.standard_normal(3), rng.standard_normal(3) - 1, rng.standard_normal(3) / 3]
    found = approximation.bound(z, *values, classes, parents, leaves)[1:]
    for which in range(3):
        for i in range(3):
            up, down = [v.copy() for v in values], [v.copy() for v in values]
            up[which][i] += 1e-5
            down[which][i] -= 1e-5
            slope = (approximation.bound(z, *up, classes, parents, leaves)[0] - approximation.bound(z, *down, classes, parents, leaves)[0]) / 2e-5
            assert found[which][i] == pytest.approx(slope, rel=1e-4, abs=1e-4)


def test_approximation_finds_the_posterior(spark):
    """With reads of one feature each the posterior is a Dirichlet of the counts plus one."""
    parents, leaves = (a.tolist() for a in kernels.sequential_tree(3))
    counts = [600, 300, 100]
    rows = spark.createDataFrame([("s", k, n, k, 1.0) for k, n in enumerate(counts)], "sample string, class_key int, count long, feature int, prob double")
    trees = spark.createDataFrame([("s", parents, leaves), ("none", parents, leaves)], "sample string, parents array<int>, leaves array<int>")
    fitted = posterior.approximate(rows, trees)
    x = np.array([r.x for r in posterior.sample_posterior(fitted, 2000).collect()])
    want = (np.array(counts) + 1) / (sum(counts) + 3)
    assert x.mean(axis=0) == pytest.approx(want, rel=0.03)
    assert x.std(axis=0) == pytest.approx(np.sqrt(want * (1 - want) / (sum(counts) + 4)), rel=0.25)


def test_alternative_ends(spark):
    exons = spark.createDataFrame([(1, "+", 1, 50), (1, "+", 100, 900), (2, "+", 251, 900), (3, "+", 502, 2000), (4, "-", 5, 9), (5, "-", 5, 9)], "transcript int, strand string, first int, last int")
    genes = spark.createDataFrame([(1, "g"), (2, "g"), (3, "g"), (4, "h"), (5, "h")], "transcript int, gene string")
    got = {(r.gene, r.type, r["first"], r["last"], tuple(sorted(r.include)), tuple(r.exclude)) for r in features.alternative_ends(exons, genes).collect()}
    assert got == {("g", "alt_5p_end", 1, 251, (1, 2), (3,)), ("g", "alt_3p_end", 900, 900, (1, 2), (3,))}


def mates(spark, *rows):
    """Fragments against T+ or T-, each (strand, left and CIGAR of a mate, those of another or None, reverse)."""
    ops = "array<struct<op:string,len:int>>"
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"id int, strand string, l1 long, c1 {ops}, l2 long, c2 {ops}, reverse boolean")
    e = F.array(*(F.struct(F.lit(a).cast("long").alias("first"), F.lit(a + 99).cast("long").alias("last")) for a in (101, 301, 501)))
    one, two = compatibility.blocks(F.col("l1"), F.col("c1")), compatibility.blocks(F.col("l2"), F.col("c2"))
    out = df.select("id", compatibility.fragment_length(e, one, two).alias("length"), compatibility.transcript_range(e, F.col("strand"), one, two, F.col("reverse"), 80).alias("at")).orderBy("id").collect()
    return [(r.length, None if r["at"] is None else tuple(r["at"])) for r in out]


def test_fragment_compatibility_by_hand(spark):
    m50, spliced = [("M", 50)], [("M", 51), ("N", 100), ("M", 49)]
    got = mates(
        spark,
        ("+", 150, m50, 350, m50, False),
        ("-", 150, m50, 350, m50, False),
        ("+", 150, spliced, 520, m50, False),
        ("+", 153, m50, 350, m50, False),
        ("+", 154, m50, 350, m50, False),
        ("+", 150, m50, 299, m50, False),
        ("+", 150, m50, 298, m50, False),
        ("+", 146, [("S", 5), ("M", 45)], 350, m50, False),
        ("+", 120, m50, None, None, False),
        ("-", 120, m50, None, None, False),
        ("+", 90, m50, 350, m50, False),
        ("+", 150, [("M", 20), ("N", 100), ("M", 30)], 350, m50, False),
        ("+", 150, [("M", 20), ("D", 5), ("M", 20), ("I", 3), ("M", 5)], 350, m50, False),
        ("+", 350, m50, 150, m50, False),
    )
    assert got[:5] == [(150, (50, 199)), (150, (102, 251)), (220, (50, 269)), (147, (53, 199)), (None, None)]
    assert [g[0] for g in got[5:8]] == [99, None, 154]
    assert got[8] == (0, (20, 99)) and got[9] == (0, (201, 280))
    assert [g[0] for g in got[10:]] == [None, None, 150, 150]


def test_effects_by_identities(spark):
    assert abs(effects.t_quantile(0.975) - 2.2281388520) < 1e-9 and abs(effects.t_quantile(0.5)) < 1e-9
    loc, scale = np.array([0.0, 1.0, -1.0, 5.0]), np.array([1.0, 0.5, 0.5, 0.1])
    d = effects.least_effects(loc, scale)
    inside = (effects._erf((d - loc) / scale / 2**0.5) - effects._erf((-d - loc) / scale / 2**0.5)) / 2
    assert np.allclose(inside, 0.1, rtol=2e-2) and d[1] == d[2]
    assert np.allclose(effects.least_effects(loc, scale, tolerance=1e-9), [0.1256613, 0.3679855, 0.3679855, 4.8718448], atol=1e-6)
    row = effects.effect_sizes(spark.createDataFrame([("a", 0.7, 0.2)], "id string, loc double, scale double"), effect=1.0).first()
    assert row.min_effect_size > 0 and row.lower_credible < row.mean_effect_size < row.upper_credible and abs(row.prob_up_de + row.prob_down_de - 1) < 1e-12


def test_coregulation_draws_do_not_depend_on_blocks(spark, monkeypatch):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(3, 30))
    rows = [(i, (base[i % 3] + 0.1 * rng.normal(size=30)).tolist(), [0.05 if i < 20 else 5.0] * 30) for i in range(24)]
    df = spark.createDataFrame(rows, "id int, loc array<double>, scale array<double>")
    whole = sorted(tuple(r) for r in coregulation.correlated_pairs(df, "id", "loc", "scale").collect())
    monkeypatch.setattr(coregulation, "BLOCK", 5)
    assert whole == sorted(tuple(r) for r in coregulation.correlated_pairs(df, "id", "loc", "scale").collect())
    assert {(u, v) for u, v, _ in whole} == {(u, v) for u in range(20) for v in range(u + 1, 20) if u % 3 == v % 3}
    parts = coregulation.modules(spark.createDataFrame(whole, "u int, v int, hits int").select("u", "v"))
    assert {r.node: r.component for r in parts.collect()} == {i: i % 3 for i in range(20)}


def test_models_tell_classes_apart(spark):
    rng = np.random.default_rng(0)
    long = [(s, d, f, float(rng.normal(loc=4.0 * (s % 2) * (f == "a")))) for s in range(24) for d in range(2) for f in "abc"]
    x = models.vectors(spark.createDataFrame(long, "sample int, draw int, feature string, x double"), ["sample", "draw"], "feature", "x").withColumn("label", (F.col("sample") % 2).cast("string")).cache()
    train, test = x.where("sample < 16"), x.where("sample >= 16")
    for f in (models.classify_logistic, lambda *a: models.classify_forest(*a, trees=20)):
        p = f(train, test, ["sample"], "label").collect()
        assert len(p) == 16 and np.mean([r.p > 0.5 for r in p if int(r["class"]) == r.sample % 2]) >= 0.75
    z, fitted = models.principal_components(x, ["sample", "draw"], 2)
    assert z.count() == 48 and all(len(r.z) == 2 for r in z.collect()) and abs(fitted.pc.toArray()[0, 0]) > 0.9
    members = models.mixture(x, ["sample", "draw"], 2)
    assert abs(members.agg(F.sum("p")).first()[0] - 48) < 0.01


@pytest.fixture
def long_texts(spark, tmp_path):
    """Two texts that share their second half, past every length that the older queries read, and a short one."""
    rng = np.random.default_rng(11)
    a, b, c = ("".join(rng.choice(list("acgen"), 1500)) for _ in range(3))
    rows = [(1, a + c), (2, b + c), (3, "short"), (4, ""), (5, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    return str(tmp_path), rows


def test_long_texts_are_sketched(spark, long_texts):
    least = {}
    for i, t in long_texts[1]:
        for j in range(len(t or "") - 31):
            h = int(hashlib.md5(t[j : j + 32].encode()).hexdigest()[:15], 16)
            least[i, h % 200] = min(h, least.get((i, h % 200), h))
    got = {(r.doc_id, r.bin): r.value for r in catalog.QUERIES["minhash_sketch_whole"](spark, long_texts[0]).collect()}
    assert got == least and {i for i, _ in got} == {1, 2}
    shared = sum(least.get((1, b)) == least.get((2, b)) is not None for b in range(200))
    union = len({b for _, b in least})
    assert [tuple(r) for r in catalog.QUERIES["lsh_candidates_whole"](spark, long_texts[0]).collect()] == [(1, 2, shared)]
    assert [tuple(r) for r in catalog.QUERIES["minhash_jaccard_whole"](spark, long_texts[0]).collect()] == [(1, 2, pytest.approx(shared / union, abs=1e-6))]


def test_long_texts_are_counted(spark, long_texts):
    want = {(i, q): sum(c in "en" for j, c in enumerate(t) if j * 4 // len(t) == q) for i, t in long_texts[1] if t for q in range(4)}
    assert {(r.doc_id, r.q): r.hits for r in catalog.QUERIES["nt_frequency_bins_whole"](spark, long_texts[0]).collect()} == want


def test_whole_tables_are_read(spark, tmp_path):
    """Rows that the older queries leave out: cheap orders that aren't urgent, small lines and parts, far values."""
    tables = {
        "orders": ([(1, 10, 5.0, "5-LOW"), (2, 11, 300000.0, "5-LOW"), (3, 12, 5.0, "1-URGENT")], "o_orderkey long, o_custkey long, o_totalprice double, o_orderpriority string"),
        "lineitem": ([(1, 7, 1, 1, 3.0), (2, 7, 1, 1, 3.0), (2, 8, 2, 1, 50.0), (3, 9, 3, 2, 1.0)], "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber long, l_quantity double"),
        "part": ([(7, "A", 1), (8, "B", 50), (9, "B", 2)], "p_partkey long, p_brand string, p_size long"),
        "events": ([(1, -1e6), (2, 1e6), (3, 50.0)], "event_id long, value double"),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    run = lambda name: sorted(tuple(r) for r in catalog.QUERIES[f"{name}_whole"](spark, str(tmp_path)).collect())
    assert run("connected_components") == [(10, 10), (11, 10), (12, 12), (1000011, 10), (1000021, 10), (1000032, 12)]
    assert run("degree_counts") == [(10, 1), (11, 2), (12, 1), (1000011, 2), (1000021, 1), (1000032, 1)]
    assert run("read_set_jaccard") == [(10, 11, 0.5)]
    assert run("distinct_feature_gene") == [(1, "A"), (2, "B"), (3, "B")]
    weights = run("kernel_weights")
    assert [w for i, _, w in weights if i == 1] == [1, 0, 0, 0, 0] and [w for i, _, w in weights if i == 2] == [0, 0, 0, 0, 1]
    assert sum(w for i, _, w in weights if i == 3) == pytest.approx(1)


def test_components_converge_or_fail(spark):
    path = spark.createDataFrame([(i, i + 1) for i in range(40)], "u long, v long")
    assert {tuple(r) for r in graph.connected_components(path).collect()} == {(i, 0) for i in range(41)}
    with pytest.raises(RuntimeError, match="not converged"):
        graph.connected_components(path, most=2)


def test_em_by_packed_reads_equals_em_by_joins(spark):
    import random

    pick = random.Random(7)
    rows = [(r, f"f{f}", pick.random(), 1 + r % 3) for r in range(300) for f in pick.sample(range(12), pick.choice([1, 2, 4]))]
    table = spark.createDataFrame(rows, "read long, feature string, prob double, count long")
    names = spark.createDataFrame([(f"f{i}",) for i in range(14)], "feature string")
    for t in (table, table.drop("count")):
        packed, joined = ({r.feature: r.y for r in likelihood.em(t, names, rounds=4, broadcast_rows=most).collect()} for most in (100, 0))
        assert packed.keys() == joined.keys() and all(abs(packed[f] - joined[f]) < 1e-12 for f in packed) and packed["f13"] == 0
    end = likelihood.em(table, names, tolerance=1e-2)
    more = likelihood.em(table, names, rounds=60)
    assert abs(likelihood.log_likelihood(table, end).first()[0] - likelihood.log_likelihood(table, more).first()[0]) < 0.5
    with pytest.raises(RuntimeError, match="convergence"):
        likelihood.em(table, names, most=3)


def test_store_queries_leave_the_session_alone(spark):
    from tallyspark.plans.more import store_effects_less_bias

    spark.range(3).createOrReplaceTempView("effects")
    assert store_effects_less_bias(spark, SF).count() > 0 and spark.table("effects").count() == 3
    spark.catalog.dropTempView("effects")


def test_store_tables_are_replaced_whole(spark, tmp_path):
    row = lambda w: spark.createDataFrame([("a", 1, w)], "factor string, feature_num long, w double")
    for w in (0.5, 0.75):
        store.write({"effects": row(w)}, str(tmp_path))
    store.attach(spark, str(tmp_path), "kept_")
    assert [r.w for r in spark.table("kept_effects").collect()] == [0.75] and sorted(p.name for p in tmp_path.iterdir()) == ["effects"]
    (tmp_path / "genes").write_text("not a table")
    with pytest.raises(Exception, match="genes|Parquet|parquet"):
        store.attach(spark, str(tmp_path), "bad_")


def test_split_rhat_pools_chains(spark):
    import random
    from statistics import mean, variance

    from tallyspark.operators import sampling

    pick = random.Random(5)
    rows = [("k", c, i, pick.gauss(c, 1)) for c in range(3) for i in range(20)]
    halves = [[v for _, c, i, v in rows if c == chain and (i < 10) == first] for chain in range(3) for first in (True, False)]
    within, between = mean(map(variance, halves)), variance(map(mean, halves))
    want = ((9 / 10 * within + between) / within) ** 0.5
    (got,) = sampling.split_rhat(spark.createDataFrame(rows, "k string, chain int, i int, v double"), ["k"], "i", "v", "chain").collect()
    assert abs(got.rhat - want) < 1e-9


def test_alignments_are_dealt_by_place_and_sorted(spark):
    from tallyspark.operators import relations

    rows = spark.read.parquet(f"{SF}/lineitem.parquet").select("l_suppkey", "l_orderkey", "l_linenumber")
    parts = relations.in_alignment_order(rows, "l_suppkey", ["l_orderkey", "l_linenumber"]).withColumn("part", F.spark_partition_id()).collect()
    by_part = {}
    for r in parts:
        by_part.setdefault(r.part, []).append((r.l_suppkey, r.l_orderkey, r.l_linenumber))
    assert all(own == sorted(own) for own in by_part.values()) and len(parts) == rows.count()
    homes = {}
    for part, own in by_part.items():
        for s, *_ in own:
            homes.setdefault(s, set()).add(part)
    assert all(len(h) == 1 for h in homes.values())


def test_exons_of_the_sql_do_not_hang_on_the_order_of_equal_lines():
    """Lines of one order at one place are equal in the windows' order; exons of a transcript lie apart all the same."""
    con = duckdb.connect()
    con.sql("""CREATE TABLE lineitem AS SELECT o AS l_orderkey, 40 * (k * 3 % 11 // 2) + k // 2 % 3 AS l_partkey, 3 AS l_linenumber, 1.0 AS l_quantity, 2 AS l_suppkey
    FROM range(60000) t(o), range(12) s(k) ORDER BY hash(o * 31 + k)""")
    split = con.sql(f"WITH {catalog._EXONS} SELECT count(*), count(*) FILTER (before + 1 >= first) FROM near").fetchall()
    want = con.sql("SELECT count(DISTINCT (l_orderkey, l_partkey % 40)) FROM lineitem").fetchall()
    assert split == [(want[0][0], 0)]


def test_nearest_neighbours_screen_pairs_in_blocks(spark):
    """Equal distances go to the smaller key, copies are neighbours, and no row of a pair leaves a block."""
    rng = np.random.default_rng(5)
    x = rng.integers(0, 3, (400, 4)).astype(float)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(400, None)], "k int, x array<float>")
    got = graph.nearest_neighbours(df, "k", "x", 5, df.where("k % 10 = 0"), blocks=3)
    assert "zip_with" not in got._jdf.queryExecution().toString()
    d = ((x[:, None] - x[None]) ** 2).sum(axis=2)
    want = {(u, v, d[u, v]) for u in range(0, 400, 10) for v in sorted((v for v in range(400) if v != u), key=lambda v: (d[u, v], v))[:5]}
    assert {tuple(r) for r in got.collect()} == want
    assert {tuple(r) for r in graph.nearest_neighbours(df.where("k < 3"), "k", "x", 5).select("u", "v").collect()} == {(u, v) for u in range(3) for v in range(3) if u != v}


def test_neighbours_of_all_vectors_are_asked_for(spark):
    """As the reference's knn has them: five edges of every vector, and the share of all."""
    e = catalog.table(spark, SF, "embeddings").toPandas()
    x = np.stack(e.embedding).astype(float)
    order = [sorted((v for v in range(len(x)) if v != u), key=lambda v, u=u: (((x[u] - x[v]) ** 2).sum(), e.vec_id[v]))[:8] for u in range(len(x))]
    got = catalog.QUERIES["knn_edges"](spark, SF).collect()
    assert len(got) == 5 * len(e) and {(r.u, r.v) for r in got} == {(e.vec_id[u], e.vec_id[v]) for u, near in enumerate(order) for v in near[:5]}
    a, b = ({tuple(sorted((u, v))) for u, near in enumerate(order) for v in near[part]} for part in (slice(5), slice(2, 8)))
    assert tuple(catalog.QUERIES["knn_agreement"](spark, SF).first())[:2] == (len(a & b), len(a | b))


def test_pairs_of_sets_are_shuffled_as_lists(spark):
    """Pairs are shuffled once, in tasks told by their number, whatever the session's partitions; members without a name count in a set's size."""
    rng = np.random.default_rng(6)
    rows = sorted({(int(a), int(b)) for a, b in rng.integers(0, 60, (900, 2))})
    df = spark.createDataFrame([*rows, (7, None)], "k int, m int")
    got = graph.set_jaccard(df, "k", "m")
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()
    own = {k: {m for a, m in rows if a == k} | ({None} if k == 7 else set()) for k, _ in rows}
    shared = lambda u, v: (own[u] & own[v]) - {None}
    want = {(u, v): len(shared(u, v)) / (len(own[u]) + len(own[v]) - len(shared(u, v))) for u in own for v in own if u < v and shared(u, v)}
    assert {(r.u, r.v): r.jaccard for r in got.collect()} == pytest.approx(want)


@pytest.mark.parametrize("shift, kind, packed", [(0, "int", True), (2**55, "long", True), (2**62, "long", False), (-30, "int", False), (0, "string", False)])
def test_keys_and_sizes_of_sets_are_one_number_where_they_fit(spark, shift, kind, packed):
    """Half of what is shuffled; keys that leave no room, and those that are no numbers, are sent as before."""
    rng = np.random.default_rng(6)
    rows = sorted({(int(a) + shift, int(b)) for a, b in rng.integers(0, 60, (900, 2))})
    own = {k: {m for a, m in rows if a == k} for k, _ in rows}
    name = str if kind == "string" else int
    got = graph.set_jaccard(spark.createDataFrame([(name(k), m) for k, m in rows], f"k {kind}, m int"), "k", "m")
    assert ("shiftright" in got._jdf.queryExecution().optimizedPlan().toString()) == packed and got.schema["u"].dataType.simpleString() == spark.createDataFrame([], f"k {kind}").schema["k"].dataType.simpleString()
    want = {(name(u), name(v)): len(own[u] & own[v]) / len(own[u] | own[v]) for u in own for v in own if name(u) < name(v) and own[u] & own[v]}
    assert {(r.u, r.v): r.jaccard for r in got.collect()} == pytest.approx(want)


def test_exclusions_are_told_by_classes(spark, duck):
    """Every pair of exclusions() is a pair of one class, and no other is; one row a feature."""
    rows = [(g, s, 10 * g + k) for g in (1, 2) for k, s in enumerate([1, 1, 1, 2, 2, 3, None])]
    df = spark.createDataFrame([*rows, (1, 1, 10)], "gene int, size int, u int")
    got = coregulation.exclusion_classes(df, "u", ["gene", "size"]).collect()
    assert {(r.gene, r.u, r.class_id, r.n_links) for r in got if r.gene == 1} == {(1, 10, 10, 2), (1, 11, 10, 2), (1, 12, 10, 2), (1, 13, 13, 1), (1, 14, 13, 1), (1, 15, 15, 0)}
    pairs = {tuple(r) for r in coregulation.exclusions(df.dropna().selectExpr("u", "concat(gene, '|', size) AS locus"), "u", "locus").collect()}
    assert pairs == {(a.u, b.u) for a in got for b in got if a.class_id == b.class_id and a.gene == b.gene and a.u < b.u}
    assert catalog.QUERIES["exclusion_pairs"](spark, SF).count() == duck.sql(f"SELECT count(*) FROM ({catalog.ORACLE_SQL['exclusion_pairs']})").fetchall()[0][0]


@pytest.mark.parametrize("members", [3, 1000])
def test_exclusions_are_all_pairs(spark, duck, monkeypatch, members):
    """Every pair of a group is a row, whatever the blocks; null keys are no group, and tasks follow the pairs."""
    monkeypatch.setattr(coregulation, "MEMBERS", members)
    monkeypatch.setattr(coregulation, "PAIRS", 50)
    rows = [(g, s, 100 * g + k) for g in (1, 2, 3) for k, s in enumerate([1] * 17 + [2, 2, 3, None])]
    rows += [(None, 1, 7), (None, 1, 8)]
    got = coregulation.pairs_within(spark.createDataFrame(rows, "gene int, size int, x int"), "x", ["gene", "size"])
    assert got.rdd.getNumPartitions() == 9
    assert sorted((r.gene, r["size"], r.u, r.v) for r in got.collect()) == sorted((*a[:2], a[2], b[2]) for a in rows for b in rows if a[:2] == b[:2] and None not in a and a[2] < b[2])
    assert list(catalog.QUERIES["exclusion_pairs"](spark, SF).columns) == ["gene", "u", "v"]


def test_kmers_are_counted_in_tasks_of_few_sequences(spark, monkeypatch):
    """A file of one split is dealt out before its sequences become places."""
    monkeypatch.setattr(fragments, "SPREAD", 10)
    df = spark.createDataFrame([(i, "abcabcab"[: i % 9]) for i in range(95)], "k int, s string").coalesce(1)
    got = fragments.kmer_usage(df, "k", "s", 3, 2, lambda pos: pos)
    assert got.rdd.getNumPartitions() == 7  # 63 sequences of three letters or more
    assert {tuple(r) for r in got.where("k = 8").collect()} == {(8, 0, "abc", 1), (8, 0, "bca", 2), (8, 0, "cab", 3), (8, 1, "abc", 4), (8, 1, "bca", 5), (8, 1, "cab", 6)}


def test_correlations_without_scales_are_sent_as_they_are(spark):
    """Blocks follow the numbers in them; pairs are those of one square, and no scales are sent."""
    x = np.random.default_rng(9).standard_normal((2500, 5)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "k int, x array<float>")
    got = coregulation.correlated_pairs(df, "k", "x", least=0.97)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "cast(x" not in plan and "scale" not in plan
    c = np.corrcoef(x.astype(np.float64))
    assert {(r.u, r.v) for r in got.collect()} == {(i, j) for i, j in zip(*np.nonzero(np.abs(c) >= 0.97)) if i < j}


def test_least_hashes_are_those_of_a_plain_loop():
    for s, k in (("abcdefgabcdefg", 3), ("Ärger über ärger, ünd", 4), ("ab", 3), ("", 3), ("x" * 50, 8)):
        want = {}
        for x in {s[i : i + k] for i in range(len(s) - k + 1)}:
            h = int(hashlib.md5(x.encode()).hexdigest()[:15], 16)
            want[h % 7] = min(h, want.get(h % 7, h))
        at, least = graph.least_hashes(s, k, 7)
        assert dict(zip(at.tolist(), least.tolist(), strict=True)) == want


@pytest.mark.parametrize("at_once, characters", [(5, 20), (32_768, 500_000)])
def test_kmers_of_many_texts_are_hashed_at_once(monkeypatch, at_once, characters):
    """Digests are those of the library: of letters of one to four bytes, one block or more, either direction, and no k-mer crosses texts."""
    monkeypatch.setattr(hashes, "AT_ONCE", at_once)
    monkeypatch.setattr(hashes, "CHARACTERS", characters)
    texts = ["abcé" * 9, "", "日本語テキスト😀" * 5, "ab", "x" * 150, "GATTACAN" * 4, "TGé"]
    back = [t.translate(str.maketrans("ACGT", "TGCA"))[::-1] for t in texts]
    for k in (1, 3, 8, 32, 60, 130):
        for other in (None, back):
            want = np.full((len(texts), 7), -1)
            for i, t in enumerate(texts):
                for j in range(len(t) - k + 1):
                    x = t[j : j + k] if other is None else min(t[j : j + k], other[i][len(t) - k - j : len(t) - j])
                    h = int(hashlib.md5(x.encode()).hexdigest()[:15], 16)
                    want[i, h % 7] = h if want[i, h % 7] < 0 else min(h, want[i, h % 7])
            assert (hashes.least_of_bins(texts, k, 7, other) == want).all()


def test_exons_and_numbers_are_made_in_tasks_told_by_rows(spark, monkeypatch):
    """A task's share of lines and keys does not follow the session's partitions."""
    monkeypatch.setattr(catalog, "LINES", 500)
    monkeypatch.setattr(relations, "KEYS", 10)
    n = catalog.table(spark, SF, "lineitem").count()
    assert catalog.exons(spark, SF).rdd.getNumPartitions() == -(-n // 500)
    rows = relations.dense_ids(spark.range(95).selectExpr("95 - id AS k"), ["k"])
    assert [(r.k, r.id) for r in rows.orderBy("k").collect()] == [(i, i) for i in range(1, 96)]
    assert rows.rdd.getNumPartitions() == 10


@pytest.mark.parametrize("least, at_once", [(40, 10), (10**6, 10**6)])
def test_links_are_those_of_all_pairs(spark, monkeypatch, least, at_once):
    """One row a key: the sums of its pairs, whatever the blocks, with copies as one class and a value that all keys share."""
    monkeypatch.setattr(graph, "BLOCK_LEAST", least)
    monkeypatch.setattr(graph, "AT_ONCE", at_once)
    rng = np.random.default_rng(3)
    sets = [{b: int(rng.integers(3)) for b in range(70) if rng.random() < 0.2} | {64: 9} for _ in range(40)]
    sets += sets[:10] + sets[:5]
    rows = [(f"k{i:02d}", b, v) for i, s in enumerate(sets) for b, v in s.items()]
    sketch = spark.createDataFrame(rows, "key string, bin long, value long")
    names = [f"k{i:02d}" for i in range(len(sets))]
    class_of = {n: names[sets.index(s)] for n, s in zip(names, sets, strict=True)}
    matches = {(u, v): m for r in graph.bin_collisions(sketch, "key").collect() for (u, v), m in (((r.u, r.v), r.matches), ((r.v, r.u), r.matches))}
    jaccard = {(u, v): j for r in graph.sketch_jaccard(sketch, "key").collect() for (u, v), j in (((r.u, r.v), r.jaccard), ((r.v, r.u), r.jaccard))}
    for r in graph.sketch_links(sketch, "key").collect():
        own = [v for u, v in matches if u == r.key]
        far = [jaccard[r.key, v] for v in own if class_of[v] != class_of[r.key]]
        assert (r.class_id, r.n_links, r.matches) == (class_of[r.key], len(own), sum(matches[r.key, v] for v in own)) and r.jaccard == pytest.approx(max(far))
        names.remove(r.key)
    assert not names
    assert graph.sketch_links(sketch.where("false"), "key").count() == 0


@pytest.mark.parametrize("kind", ["string", "int"])
@pytest.mark.parametrize("least, at_once, members, out", [(40, 10, 3, 7), (10**6, 10**6, 10**6, 10**6)])
def test_pairs_of_sketches_are_all_given(spark, monkeypatch, least, at_once, members, out, kind):
    """Every pair that shares a value, whatever the blocks and batches: of copies too, and of copies alone."""
    for name, value in (("BLOCK_LEAST", least), ("AT_ONCE", at_once), ("MEMBERS", members), ("OUT_ROWS", out)):
        monkeypatch.setattr(graph, name, value)
    rng = np.random.default_rng(4)
    sets = [{b: int(rng.integers(3)) for b in range(70) if rng.random() < 0.2} | {64: 9} for _ in range(40)]
    sets += sets[:10] + sets[:5] + [{3: 77}] * 8 + [{5: 88}]
    names = [f"k{i:02d}" if kind == "string" else i for i in range(len(sets))]
    rows = [(n, b, v) for n, s in zip(names, sets, strict=True) for b, v in s.items()]
    sketch = spark.createDataFrame([*rows, (None, 64, 9)], f"key {kind}, bin long, value long")
    got = graph.sketch_pairs(sketch, "key").collect()
    want = {}
    for i, s in enumerate(sets):
        for j in range(i + 1, len(sets)):
            if m := sum(s[b] == sets[j].get(b) for b in s):
                want[names[i], names[j]] = (m, pytest.approx(m / len(s.keys() | sets[j].keys())))
    assert len(got) == len(want) and {(r.u, r.v): (r.matches, r.jaccard) for r in got} == want
    assert graph.sketch_pairs(sketch.where("false"), "key").count() == 0


@pytest.mark.parametrize("name", ["lsh_candidates", "lsh_candidates_whole", "minhash_jaccard", "minhash_jaccard_whole"])
def test_queries_of_sketches_give_pairs(spark, duck, name):
    """A row for every pair of documents, copies too, as the reference's candidates are."""
    got = catalog.QUERIES[name](spark, SF)
    assert {"u", "v"} < set(got.columns) and got.count() == duck.sql(f"SELECT count(*) FROM ({catalog.ORACLE_SQL[name]})").fetchall()[0][0]


def test_components_are_dealt_out_by_number(spark, monkeypatch):
    """Rounds have as many tasks as the edges ask for, whatever the session's partitions, and broadcast no labels."""
    monkeypatch.setattr(graph, "EDGES", 10)
    made, write = [], graph.materialize

    def watched(df, name):
        made.append((name, df.rdd.getNumPartitions(), df._jdf.queryExecution().executedPlan().toString()))
        return write(df, name)

    monkeypatch.setattr(graph, "materialize", watched)
    path = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "u long, v long")
    assert {tuple(r) for r in graph.connected_components(path).collect()} == {(i, 0) for i in range(41)} | {(100, 100), (101, 100)}
    assert {n for name, n, _ in made if name == "labels"} == {9} and not any("Broadcast" in plan for *_, plan in made)
