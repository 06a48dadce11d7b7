"""The command line from alignments to a regression, over one small experiment."""

import gzip
import random
import sys

import pytest
import yaml

from tallyspark import __main__ as cli
from tests import test_prepare
from tests.test_bam import SEQUENCES, record, whole_file


@pytest.fixture(scope="module")
def experiment(tmp_path_factory):
    """Four samples of two groups; in the second, b2's share goes to a1."""
    folder = tmp_path_factory.mktemp("experiment")
    pick = random.Random(4)
    number = {n: i for i, (n, _) in enumerate(SEQUENCES)}
    bases = {n: "".join(pick.choice("ACGT") for _ in range(12_000)) for n, _ in SEQUENCES[:2]}
    (folder / "g.fa").write_text("".join(f">{n}\n{s}\n" for n, s in bases.items()))
    (folder / "g.gff3").write_text(test_prepare.annotation())
    samples, shares = [], dict(test_prepare.SHARES)
    for i in range(4):
        changed = shares | ({"a1": 0.7, "b2": 0.05} if i % 2 else {})
        test_prepare.SHARES.update(changed)
        rows = test_prepare.fragments(pick, 1500)
        test_prepare.SHARES.update(shares)
        (folder / f"s{i}.bam").write_bytes(whole_file([record(n, f, number[s], p - 1, c) for n, f, s, p, c in rows], 20_000))
        samples.append({"name": f"s{i}", "factors": {"tissue": "brain" if i % 2 else "liver", "batch": "x"}})
    (folder / "e.yml").write_text(yaml.safe_dump({"genome": "g.fa", "annotations": "g.gff3", "samples": samples}))
    return folder


def rows_of(spark, path):
    return spark.read.csv(str(path), header=True).collect()


def test_experiment_from_reads_to_effects(spark, experiment, capsys):
    run = lambda *args: cli.main([str(a) for a in args], spark)
    run("prep", experiment / "e.yml", "--no-bias", "--tree-method", "random")
    made = sorted(p.name for p in experiment.glob("*.prep.parquet"))
    assert made == [f"s{i}.prep.parquet" for i in range(4)]
    before = (experiment / "s0.prep.parquet").stat().st_mtime_ns
    run("prep", experiment / "e.yml", "--no-bias")
    assert (experiment / "s0.prep.parquet").stat().st_mtime_ns == before
    run("sample", experiment / "s1.prep.parquet", "--num-samples", 100, "-o", experiment / "mean.csv")
    tpm = {r.transcript_id: float(r.tpm) for r in rows_of(spark, experiment / "mean.csv")}
    assert abs(sum(tpm.values()) - 1e6) < 1 and tpm["a1"] > 5e5
    run("model", "regression", experiment / "e.yml", "--factors", "tissue", "--nonredundant", "--redundant-factor", "liver", "--no-distortion", "--rounds", 6, "--effect-size", 1.5, "-o", experiment / "out.csv", "--output-expression", experiment / "x.csv")
    effects = {r.transcript_id: r for r in rows_of(spark, experiment / "out.csv")}
    assert set(effects) == set(test_prepare.GENES) and {r.factor for r in effects.values()} == {"tissue:brain"}
    assert float(effects["a1"].mean_effect_size) > float(effects["b2"].mean_effect_size) + 1
    assert list(effects["a1"].asDict()) == ["factor", "transcript_id", "min_effect_size", "mean_effect_size", "lower_credible", "upper_credible", "prob_de", "prob_down_de", "prob_up_de"]
    assert len(rows_of(spark, experiment / "x.csv")) == 20


def test_one_sample_with_bias_its_likelihood_em_and_gibbs(spark, experiment):
    run = lambda *args: cli.main([str(a) for a in args], spark)
    run("prep-sample", experiment / "g.fa", experiment / "s0.bam", experiment / "g.gff3", "-o", experiment / "one.parquet", "--likelihood-matrix", experiment / "lm", "--skip-likelihood-approximation")
    assert not (experiment / "one.parquet").exists()
    run("debug-optimize", experiment / "lm", "-o", experiment / "em.csv")
    em = {r.transcript_id: float(r.tpm) for r in rows_of(spark, experiment / "em.csv")}
    run("debug-sample", experiment / "lm", "--num-samples", 40, "--burn-in", 50, "--stride", 2, "-o", experiment / "gibbs.csv")
    drawn = rows_of(spark, experiment / "gibbs.csv")
    assert len(drawn) == 80 and abs(sum(float(r.b2) for r in drawn) / 80 - em["b2"] / 1e6) < 0.05
    assert {r.transcript_id for r in rows_of(spark, f"{experiment / 'gibbs.csv'}.convergence.csv")} <= set(em)
    run("fit-tree", experiment / "g.fa", experiment / "g.gff3", "-o", experiment / "tree.parquet")
    run("prep-sample", experiment / "g.fa", experiment / "s0.bam", experiment / "g.gff3", "-o", experiment / "two.parquet", "--no-bias", "--ptt-tree", experiment / "tree.parquet", "--approx-method", "normal_ilr")
    run("sample", experiment / "two.parquet", "--num-samples", 50, "-o", experiment / "two.csv")
    assert abs(sum(float(r.tpm) for r in rows_of(spark, experiment / "two.csv")) - 1e6) < 1


def test_quantified_sample(spark, tmp_path):
    """Classes of a quantifier count as many times as they say."""
    names = list("abcd")
    tree = spark.createDataFrame([("", names, [0, 1, 2, 2, 1, 5, 5], [0, 0, 1, 2, 0, 3, 4])], "sample string, features array<string>, parents array<int>, leaves array<int>")
    tree.write.parquet(str(tmp_path / "tree"))
    (tmp_path / "q" / "aux_info").mkdir(parents=True)
    counts = {"a": 500, "b": 300, "c": 150, "d": 50}
    lines = ["4", "5", *"dcba", *(f"1\t{'dcba'.index(n)}\t0.5\t{k}" for n, k in counts.items()), "2\t0\t1\t0.3\t0.3\t40"]
    (tmp_path / "q" / "aux_info" / "eq_classes.txt.gz").write_bytes(gzip.compress("\n".join(lines).encode()))
    (tmp_path / "q" / "quant.sf").write_text("Name\tLength\tEffectiveLength\n" + "".join(f"{n}\t100\t50\n" for n in names))
    cli.main(["prep-salmon", str(tmp_path / "tree"), str(tmp_path / "q"), "-o", str(tmp_path / "s.prep.parquet")], spark)
    cli.main(["sample", str(tmp_path / "s.prep.parquet"), "--num-samples", "200", "-o", str(tmp_path / "s.csv")], spark)
    tpm = {r.transcript_id: float(r.tpm) / 1e6 for r in rows_of(spark, tmp_path / "s.csv")}
    assert all(abs(tpm[n] - (counts[n] + (10 if n == "d" else 30 if n == "c" else 0)) / 1040) < 0.02 for n in names), tpm


def test_paths_and_unknown_commands(capsys):
    cli.main(["path"])
    assert capsys.readouterr().out.strip().endswith("tallyspark")
    for args in (["other"], ["prep-sample", "g", "r", "--approx-method", "other"], []):
        with pytest.raises(SystemExit):
            cli.main(args)
    assert sys.modules["tallyspark.__main__"] is cli
