"""Splicing events of compressed graphs, by hand and against paths found by walking every transcript."""

import random
from collections import defaultdict

import pytest

from tallyspark.functions import splice_graph
from tallyspark.operators import features

A, B, C, D = (1, 10), (21, 30), (41, 50), (61, 70)


@pytest.mark.parametrize(
    "transcripts, want",
    [
        ({"x": [A, B, C], "y": [A, C]}, [(10, 41, "included_cassette_exon", "IEI", ("x",)), (10, 41, "skipped_cassette_exon", "I", ("y",))]),
        ({"x": [A, B, D], "y": [A, C, D]}, [(10, 61, "miscellaneous", "IEI", ("x",)), (10, 61, "miscellaneous", "IEI", ("y",))]),
        ({"x": [A, (21, 30), D], "y": [A, (23, 30), D], "z": [A, (25, 30), D]}, [(10, 30, "alt_acceptor", "IE", (t,)) for t in "xyz"]),
        ({"x": [A, (21, 30), D], "y": [A, (21, 33), D], "z": [A, (21, 36), D]}, [(21, 61, "alt_donor", "EI", (t,)) for t in "xyz"]),
        ({"x": [A, B], "y": [A, C]}, [(10, -1, "alt_tts", "IET", ("x",)), (10, -1, "alt_tts", "IET", ("y",))]),
        ({"x": [A, B], "y": [A, B]}, []),
        ({"x": [A]}, []),
    ],
)
def test_events_by_hand(spark, transcripts, want):
    assert splice_graph.events(transcripts, True) == want
    turned = {t: [(101 - b, 101 - a) for a, b in reversed(e)] for t, e in transcripts.items()}
    back = lambda p: p if p < 0 else 101 - p
    assert sorted((back(a), back(b), *rest) for a, b, *rest in splice_graph.events(turned, False)) == want
    rows = spark.createDataFrame([(t, "s", "+", e) for t, e in transcripts.items()], "transcript_id string, seqname string, strand string, exons array<struct<first:bigint,last:bigint>>")
    assert sorted((r["first"], r["last"], r.type, r.kinds, tuple(r.ids)) for r in features.splice_graph_events(rows).collect()) == want


def walked(transcripts, forward):
    """Each transcript's steps, cut wherever any two transcripts part or meet."""
    steps = {t: splice_graph.edges_of(e, forward) for t, e in transcripts.items()}
    every = {s for own in steps.values() for s in own}
    out_, in_ = defaultdict(set), defaultdict(set)
    for s in every:
        out_[s[0]].add(s)
        in_[s[1]].add(s)
    found = defaultdict(set)
    for t, own in steps.items():
        piece = []
        for s in own:
            piece.append(s)
            if s[1] == -1 or len(out_[s[1]]) > 1 or len(in_[s[1]]) > 1:
                found[piece[0][0], s[1], "".join(k for _, _, k in piece), tuple(piece)].add(t)
                piece = []
    by_place = defaultdict(list)
    for (a, b, k, _), ids in found.items():
        by_place[a].append((a, b, k, tuple(sorted(ids))))
    return sorted(p for own in by_place.values() if len(own) > 1 for p in own)


def test_query_has_the_walked_paths(spark):
    from tallyspark.plans.sequencing import small_genes, splice_graph_events

    sf = "/root/testdata/sf0.001"
    groups = defaultdict(dict)
    for r in small_genes(spark, sf).collect():
        e = [(x["first"], x["last"]) for x in r.exons]
        groups[str(r.transcript_id // 2000), r.strand, e[0][0] if r.strand == "+" else e[0][1]][str(r.transcript_id)] = e
    want = sorted((*key, *p) for key, own in groups.items() for p in walked(own, key[1] == "+"))
    got = [(r.seqname, r.strand, r.tss, r["first"], r["last"], r.kinds, tuple(r.ids.split(","))) for r in splice_graph_events(spark, sf).collect()]
    assert sorted(got) == want and len(want) > 50


def test_starts_are_taken_in_order_across_batches(spark):
    """A task goes through its starts; one whose transcripts come in several batches is still one, and no start is a call of its own."""
    rng = random.Random(5)
    groups, rows = defaultdict(dict), []
    for t in range(200):
        e = [(10 * x, 10 * x + rng.choice((1, 4))) for x in sorted({1, *rng.sample(range(2, 9), 3)})]
        key = (rng.choice("ab"), rng.choice("+-"))
        groups[(*key, e[0][0] if key[1] == "+" else e[0][1])][f"t{t}"] = e
        rows.append((f"t{t}", *key, e))
    frame = spark.createDataFrame(rows, "transcript_id string, seqname string, strand string, exons array<struct<first:bigint,last:bigint>>")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        found = features.splice_graph_events(frame)
        got = sorted((*tuple(r)[:-1], tuple(r.ids)) for r in found.collect())
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert got == sorted((*key, *event) for key, own in groups.items() for event in splice_graph.events(own, key[1] == "+")) and len(got) > 50
    assert "Pandas" not in found._jdf.queryExecution().executedPlan().toString()
