"""Readers that cut files into ranges, against those that read records whole; writers and small readers."""

import gzip
import random

import pytest
from pyspark.sql import functions as F

from tallyspark.operators import effects
from tallyspark.sources import readers, sinks


@pytest.fixture(scope="module")
def genome(tmp_path_factory):
    pick = random.Random(11)
    sequences = {f"chr{i}": "".join(pick.choice("ACGTacgtN") for _ in range(n)) for i, n in enumerate((5000, 1, 0, 333, 1200))}
    folder = tmp_path_factory.mktemp("genome")
    lines = []
    for i, (name, s) in enumerate(sequences.items()):
        width = (60, 7, 61, 100, 1200)[i]
        lines += [f">{name} described > here", *(s[k : k + width] for k in range(0, len(s), width))]
    (folder / "g.fa").write_text("\n".join(lines) + "\n")
    return folder / "g.fa", {n: s.upper() for n, s in sequences.items()}


@pytest.mark.parametrize("size, split", [(64, 100), (100, 1 << 20), (1000, 37), (1 << 16, 501)])
def test_genome_blocks_in_any_ranges(spark, genome, size, split):
    path, sequences = genome
    got = {}
    for r in readers.genome_blocks(spark, str(path), size, split).collect():
        got.setdefault(r.name, {})[r.block] = r.bases
    assert got.keys() == {n for n, s in sequences.items() if s}
    for name, blocks in got.items():
        assert sorted(blocks) == list(range(len(blocks))) and all(len(b) == size for i, b in blocks.items() if i < len(blocks) - 1)
        assert "".join(blocks[i] for i in range(len(blocks))) == sequences[name]


def test_spliced_from_blocks_equals_whole_sequences(spark, genome):
    path, _ = genome
    pick = random.Random(5)
    rows = []
    for t in range(40):
        name = pick.choice(["chr0", "chr3", "chr4", "chr1", "lost"])
        ends = sorted(pick.sample(range(1, 1500 if name != "chr0" else 5200), 2 * pick.randint(1, 4)))
        rows.append((f"t{t}", name, pick.choice("+-"), list(zip(ends[::2], ends[1::2], strict=True))))
    ts = spark.createDataFrame(rows, "transcript_id string, seqname string, strand string, exons array<struct<first:bigint,last:bigint>>")
    whole = {r.transcript_id: r.seq for r in readers.spliced(ts, readers.fasta(spark, str(path))).collect()}
    for size in (50, 4096):
        got = readers.spliced_from_blocks(ts, readers.genome_blocks(spark, str(path), size, 900), size)
        assert {r.transcript_id: r.seq for r in got.collect()} == whole


def made_classes(folder, compress):
    names = [f"t{i}" for i in range(300)]
    pick = random.Random(2)
    rows = [sorted(pick.sample(range(300), pick.randint(1, 5))) for _ in range(500)]
    lines = ["300", "500", *names, *("\t".join(map(str, [len(r), *r, *(0.25 + i / 8 for i in range(len(r))), k + 1])) for k, r in enumerate(rows))]
    path = folder / ("eq.txt.gz" if compress else "eq.txt")
    path.write_bytes(gzip.compress("\n".join(lines).encode()) if compress else ("\n".join(lines) + "\n").encode())
    return str(path), [(k, [names[i] for i in r], [0.25 + i / 8 for i in range(len(r))], k + 1) for k, r in enumerate(rows)]


@pytest.mark.parametrize("compress", [False, True])
def test_equivalence_classes_in_any_splits(spark, tmp_path, compress):
    path, want = made_classes(tmp_path, compress)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "999")
    try:
        got = readers.equivalence_classes(spark, path)
        assert sorted((r.class_id, r.features, r.probs, r["count"]) for r in got.collect()) == want
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_quantified_sample_checks_its_names(spark, tmp_path):
    path, want = made_classes(tmp_path, True)
    (tmp_path / "quant.sf").write_text("Name\tLength\tEffectiveLength\tTPM\tNumReads\n" + "".join(f"t{i}\t{i + 200}\t{i + 50.5}\t0\t0\n" for i in range(300)))
    names = spark.createDataFrame([(f"t{i}",) for i in range(300)], "feature string")
    classes, efflens = readers.quantified_sample(spark, path, str(tmp_path / "quant.sf"), names)
    assert classes.count() == 500 and {r.feature: r.efflen for r in efflens.collect()} == {f"t{i}": i + 50.5 for i in range(300)}
    for other in (names.where("feature <> 't7'"), names.unionByName(spark.createDataFrame([("x",)], "feature string"))):
        with pytest.raises(ValueError, match="different sets"):
            readers.quantified_sample(spark, path, str(tmp_path / "quant.sf"), other)


def test_line_sets_and_prepared_and_effects_files(spark, tmp_path):
    (tmp_path / "lines").write_text("a\n\nb\na\n")
    assert sorted(r.t for r in readers.line_set(spark, str(tmp_path / "lines"), "t").collect()) == ["a", "b"]
    rows = spark.createDataFrame([("s1", [0.5, -1.0]), ("s2", [2.0, 3.0])], "sample string, mu array<double>")
    sinks.write_prepared(rows, str(tmp_path / "p"))
    assert sorted((r["sample"], r.mu) for r in sinks.read_prepared(spark, str(tmp_path / "p")).collect()) == [("s1", [0.5, -1.0]), ("s2", [2.0, 3.0])]
    rows.withColumn("version", F.lit(1)).write.parquet(str(tmp_path / "old"))
    with pytest.raises(Exception, match="another version"):
        sinks.read_prepared(spark, str(tmp_path / "old")).collect()
    sinks.write_effects(spark.createDataFrame([("f", 0.6931471805599453)], "id string, mean_effect_size double"), str(tmp_path / "e"))
    assert [(r.id, round(float(r.mean_effect_size), 9)) for r in spark.read.csv(str(tmp_path / "e"), header=True).collect()] == [("f", 1.0)]


def test_class_probabilities(spark):
    rows = [("s", "a", 0.0), ("s", "b", 1.0), ("t", "a", 1e40), ("t", "b", 1e40)]
    got = {(r.k, r.label): r.p for r in effects.class_probabilities(spark.createDataFrame(rows, "k string, label string, d double"), ["k"], "label", "d").collect()}
    one, other = 1.0, (1 + 1 / 10) ** -5.5
    assert abs(got["s", "a"] - one / (one + other)) < 1e-12 and abs(got["s", "a"] + got["s", "b"] - 1) < 1e-12 and got["t", "a"] == got["t", "b"] == 0.5
