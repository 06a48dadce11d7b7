"""From a hand-made annotation and alignments to a prepared sample."""

import random

import numpy as np
import pytest

from tallyspark.operators import prepare, trees
from tallyspark.sources import readers
from tests.test_bam import SEQUENCES, record, whole_file

GENES = {
    "a1": ("chr1", "+", [(1001, 1400), (2001, 2300), (3001, 3600)]),
    "a2": ("chr1", "+", [(1001, 1400), (3001, 3600)]),
    "b1": ("chr2", "-", [(501, 1500)]),
    "b2": ("chr2", "-", [(501, 900), (1101, 1500)]),
    "c1": ("chr1", "-", [(9001, 9500)]),
}
SHARES = {"a1": 0.35, "a2": 0.15, "b1": 0.1, "b2": 0.4, "c1": 0.0}


def annotation():
    lines = []
    for t, (seq, strand, exons) in GENES.items():
        lines.append(f"{seq}\tx\tmRNA\t{exons[0][0]}\t{exons[-1][1]}\t.\t{strand}\t.\tID={t};Parent=gene:{t[0]};biotype=coding")
        lines += [f"{seq}\tx\texon\t{a}\t{b}\t.\t{strand}\t.\tParent={t}" for a, b in exons]
    return "\n".join(lines) + "\n"


def aligned(exons, first, length):
    """(left, cigar) of `length` bases of a transcript from base `first` on, both counted from 0 in genome order."""
    out, left, at, last = [], None, 0, None
    for a, b in exons:
        size = b - a + 1
        lo, hi = max(first, at), min(first + length, at + size)
        if lo < hi:
            start = a + lo - at
            if last is not None:
                out.append((start - last - 1, "N"))
            left = left if left is not None else start
            out.append((hi - lo, "M"))
            last = start + hi - lo - 1
        at += size
    return left, out


def fragments(pick, n):
    """(name, flag, sequence, left from 1, cigar), two mates a fragment: reads come from the first mate's strand being the transcript's."""
    length = {t: sum(b - a + 1 for a, b in e) for t, (_, _, e) in GENES.items()}
    out = []
    for i in range(n):
        t = pick.choices(list(SHARES), [SHARES[t] * (length[t] - 180) for t in SHARES])[0]
        seq, strand, exons = GENES[t]
        size = max(60, min(length[t], round(pick.gauss(180, 20))))
        first = pick.randrange(length[t] - size + 1)
        low, high = aligned(exons, first, 50), aligned(exons, first + size - 50, 50)
        forward = strand == "+"
        out.append((f"r{i}", 99 if forward else 163, seq, *low))
        out.append((f"r{i}", 147 if forward else 83, seq, *high))
    return out


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    folder = tmp_path_factory.mktemp("prepare")
    rows = fragments(random.Random(3), 4000)
    number = {n: i for i, (n, _) in enumerate(SEQUENCES)}
    (folder / "r.bam").write_bytes(whole_file([record(n, f, number[s], p - 1, c) for n, f, s, p, c in rows], 20_000))
    (folder / "r.sam").write_text("".join(f"{n}\t{f}\t{s}\t{p}\t30\t{''.join(f'{k}{o}' for k, o in c)}\t*\t0\t0\t*\t*\n" for n, f, s, p, c in rows))
    (folder / "g.gff3").write_text(annotation())
    return folder


def test_mates_are_paired(spark):
    m = [(50, "M")]
    rows = [
        ("p", "s", 100, 149, 99, m), ("p", "s", 300, 349, 147, m), ("p", "s", 300, 349, 147 | 256, m), ("p", "s", 700_000, 700_049, 147, m), ("p", "t", 5, 54, 99, m),
        ("far", "s", 1, 50, 99, m), ("far", "s", 500_002, 500_051, 147, m), ("one", "s", 7, 56, 16, m), ("two", "s", 8, 57, 147, m), ("two", "s", 9, 58, 147, m),
    ]
    alignments = spark.createDataFrame([(*r[:5], [(o, k) for k, o in r[5]]) for r in rows], "read_name string, seqname string, left long, right long, flag int, cigar array<struct<op:string,len:int>>")
    got = sorted((r.read_name, r.seqname, r["first"], r["last"], r.reverse, r.own_reverse, r.two is None) for r in prepare.paired(alignments).collect())
    assert got == [("one", "s", 7, 56, True, True, True), ("p", "s", 100, 349, False, False, False), ("p", "t", 5, 54, False, False, True), ("two", "s", 8, 57, True, False, True), ("two", "s", 9, 58, True, False, True)]


def test_likelihood_is_that_of_the_fragments(spark, files):
    """A read's transcripts are those that its bases fit; probabilities are strand share times pmf by effective length."""
    ts = readers.transcripts(readers.gff3_rows(spark, str(files / "g.gff3")))
    made = prepare.sample_likelihood(ts, readers.bam(spark, str(files / "r.bam")), width=700)
    pmf = {r.length: r.pmf for r in made.lengths.collect()}
    efflen = {r.feature: r.efflen for r in made.efflens.collect()}
    assert made.specificity == 1.0 and abs(sum(k * p for k, p in pmf.items()) - 180) > 0 and set(efflen) == set(GENES)
    for t, (_, _, exons) in GENES.items():
        size = sum(b - a + 1 for a, b in exons)
        assert abs(efflen[t] - sum(pmf[k] * (size - k + 1) for k in range(1, size + 1))) < 1e-6
    rows = [tuple(r) for r in made.likelihood.collect()]
    reads = {r for r, _, _ in rows}
    assert sorted(reads) == list(range(1, 4001)) and {f for _, f, _ in rows} == set(GENES) - {"c1"}
    assert all(any(abs(p - pmf[k] / efflen[f]) < 1e-12 for k in range(1, 2001)) for _, f, p in rows[:200])
    longer = prepare.sample_likelihood(ts, readers.bam(spark, str(files / "r.bam")), by_length=True)
    assert all(r.efflen >= efflen[r.feature] - 1e-9 for r in longer.efflens.collect())
    with pytest.raises(ValueError, match="overlaps"):
        prepare.sample_likelihood(ts.where("transcript_id = 'c1'"), readers.bam(spark, str(files / "r.bam")))


@pytest.mark.parametrize("tree", ["cluster", "random", "list"])
def test_prepared_sample_finds_the_shares(spark, files, tree):
    prepared = prepare.prepare_files(spark, "s", str(files / "r.bam"), str(files / "g.gff3"), tree=tree, steps=400)
    tpm = {r.feature: r.tpm / 1e6 for r in prepare.posterior_tpm(prepared, 300).collect()}
    assert set(tpm) == set(GENES) and abs(sum(tpm.values()) - 1) < 1e-9
    assert all(abs(tpm[t] - SHARES[t]) < 0.04 for t in GENES), tpm


def test_sam_and_bam_prepare_the_same(spark, files):
    ts = readers.transcripts(readers.gff3_rows(spark, str(files / "g.gff3")))
    made = [prepare.sample_likelihood(ts, read(spark, str(files / name))) for read, name in ((readers.bam, "r.bam"), (readers.sam, "r.sam"))]
    one, two = (sorted(map(tuple, m.likelihood.collect())) for m in made)
    assert one == two


def test_a_given_tree_serves_all_samples(spark, files):
    ts = readers.transcripts(readers.gff3_rows(spark, str(files / "g.gff3")))
    made = prepare.sample_likelihood(ts, readers.bam(spark, str(files / "r.bam")))
    pick = random.Random(1)
    bases = {t: "".join(pick.choice("ACGT") for _ in range(300)) for t in GENES}
    tree = trees.sketch_tree(trees.sequence_sketches(spark.createDataFrame([(t, bases[t[0] + "1"] + bases[t]) for t in GENES], "feature string, seq string")))
    (row,) = prepare.prepare_sample("s", made, tree, steps=50).collect()
    assert row.features == sorted(GENES) and len(row.mu) == len(GENES) - 1 and np.isfinite(row.mu).all() and len(row.efflen) == len(GENES)
    with pytest.raises(ValueError, match="lacks a feature"):
        prepare.prepare_sample("s", made, trees.sketch_tree(trees.sequence_sketches(spark.createDataFrame([("a1", bases["a1"]), ("a2", bases["a1"])], "feature string, seq string"))))
    with pytest.raises(ValueError, match="tree method"):
        prepare.tree_of("s", made, "other")
