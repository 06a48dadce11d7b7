"""Command line: python -m tallyspark COMMAND; files that it writes are folders of Parquet or CSV."""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import alternatives
from .operators import bias, effects, features, likelihood, posterior, prepare, regression, sampling, trees
from .plans.scratch import materialize
from .sources import readers, sinks

SEED = 123_456_789


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="tallyspark", description=__doc__)
    commands = top.add_subparsers(dest="command", required=True)

    def command(name: str, *positionals: str, output: str | None = None) -> argparse.ArgumentParser:
        out = commands.add_parser(name)
        for p in positionals:
            out.add_argument(p.rstrip("?"), nargs="?" if p.endswith("?") else None)
        if output:
            out.add_argument("-o", "--output", default=output)
        return out

    def preparing(p: argparse.ArgumentParser) -> None:
        p.add_argument("--exclude-seqs")
        p.add_argument("--exclude-transcripts")
        p.add_argument("--approx-method", default=alternatives.METHODS[0], choices=alternatives.METHODS)
        p.add_argument("--tree-method", default="cluster", choices=["cluster", "random", "random-list", "list"])
        p.add_argument("--ptt-tree", help="a tree of fit-tree, in place of --tree-method")
        p.add_argument("--seed", type=int, default=SEED)
        for flag in ("--no-bias", "--clip-read-name-mate", "--alt-frag-model"):
            p.add_argument(flag, action="store_true")

    p = command("prep-sample", "genome_filename", "reads_filename", "annotations_filename?", output="prepared-sample.parquet")
    preparing(p)
    p.add_argument("--likelihood-matrix", help="where to write the likelihood and effective lengths")
    p.add_argument("--skip-likelihood-approximation", action="store_true")
    p = command("prep", "experiment")
    preparing(p)
    p.add_argument("--force", action="store_true")
    command("fit-tree", "genome_filename", "annotations_filename?", output="tree.parquet")
    p = command("prep-salmon", "ptt_filename", "salmon_dir", output="prepared-sample.parquet")
    p.add_argument("--approx-method", default=alternatives.METHODS[0], choices=alternatives.METHODS)
    p.add_argument("--seed", type=int, default=SEED)
    p = command("sample", "prepared_filename", output="post-mean.csv")
    p.add_argument("--num-samples", type=int, default=1000)
    p.add_argument("--seed", type=int, default=SEED)
    p = command("debug-sample", "likelihood_filename", output="gibbs.csv")
    for flag, value in (("--num-samples", 1000), ("--num-chains", 2), ("--stride", 25), ("--burn-in", 2000), ("--seed", SEED)):
        p.add_argument(flag, type=int, default=value)
    command("debug-optimize", "likelihood_filename", output="em.csv")
    command("path")
    models = commands.add_parser("model").add_subparsers(dest="model", required=True)
    p = models.add_parser("regression")
    p.add_argument("experiment")
    p.add_argument("-o", "--output", default="regression.csv")
    p.add_argument("--feature", default="transcript", choices=["transcript"])
    p.add_argument("--factors", help="comma-separated; all, if not given")
    p.add_argument("--point-estimates", help="key of the samples' point estimates, in place of prepared samples")
    p.add_argument("--pseudocount", type=float, default=0.0)
    p.add_argument("--output-expression")
    p.add_argument("--redundant-factor", help="the level of each factor that --nonredundant leaves out; the first, if not given")
    for flag, value in (("--lower-credible", 0.025), ("--upper-credible", 0.975), ("--effect-size", None), ("--min-effect-size-coverage", 0.1), ("--scale-penalty", 1e-3), ("--rounds", 30)):
        p.add_argument(flag, type=int if flag == "--rounds" else float, default=value)
    for flag in ("--no-distortion", "--nonredundant", "--balanced", "--write-variational-posterior-params"):
        p.add_argument(flag, action="store_true")
    return top


def transcripts_of(spark: SparkSession, genome: str, annotation: str | None, excluded: str | None, sequences: bool) -> DataFrame:
    """Transcripts of an annotation over a genome, or of a FASTA file with a transcript a record; with seq, if wanted."""
    out = readers.line_set(spark, excluded, "transcript_id") if excluded else None
    if annotation is None:
        rows = readers.fasta(spark, genome).select(F.col("name").alias("transcript_id"), F.col("sequence").alias("seq"))
        rows = rows if out is None else rows.join(out, "transcript_id", "left_anti")
        size = F.char_length("seq").cast("long")
        one = F.array(F.struct(F.lit(1).cast("long").alias("first"), size.alias("last")))
        return materialize(rows.select("transcript_id", F.col("transcript_id").alias("seqname"), F.lit("+").alias("strand"), F.lit(1).cast("long").alias("first"), size.alias("last"), one.alias("exons"), size.alias("exonic_length"), "seq"), "transcripts")
    rows = materialize(readers.transcripts(readers.gff3_rows(spark, annotation), out), "transcripts")
    return materialize(readers.spliced_from_blocks(rows, readers.genome_blocks(spark, genome)), "transcripts") if sequences else rows


def prepared_row(spark: SparkSession, sample: str, genome: str, reads: str, annotation: str | None, args: argparse.Namespace, output: str) -> None:
    ts = transcripts_of(spark, genome, annotation, args.exclude_transcripts, not args.no_bias)
    read = readers.sam if reads.endswith(".sam") else readers.bam
    excluded = readers.line_set(spark, args.exclude_seqs, "seqname") if args.exclude_seqs else None
    aligned = materialize(read(spark, reads, excluded, args.clip_read_name_mate), "alignments")
    made = prepare.sample_likelihood(ts, aligned, by_length=args.alt_frag_model) if args.no_bias else bias.biased_likelihood(ts, aligned)[0]
    if getattr(args, "likelihood_matrix", None):
        sinks.write_likelihood(made.likelihood, made.efflens, args.likelihood_matrix)
    if not getattr(args, "skip_likelihood_approximation", False):
        tree = spark.read.parquet(args.ptt_tree) if args.ptt_tree else args.tree_method
        sinks.write_prepared(prepare.prepare_sample(sample, made, tree, seed=args.seed, method=args.approx_method), output)


def name_of(path: str) -> str:
    return os.path.basename(path.rstrip("/")).removesuffix(".parquet").removesuffix(".prep")


def prep_sample(spark: SparkSession, args: argparse.Namespace) -> None:
    prepared_row(spark, name_of(args.output), args.genome_filename, args.reads_filename, args.annotations_filename, args, args.output)


def prep(spark: SparkSession, args: argparse.Namespace) -> None:
    """Every sample of an experiment whose prepared file is not there yet."""
    spec = readers.experiment_spec(spark, args.experiment)
    base = os.path.dirname(args.experiment)
    at = lambda p: p if p is None or "://" in p or os.path.isabs(p) else os.path.join(base, p)
    for sample in spec["samples"]:
        target = at(sample.get("file", sample["name"] + ".prep.parquet"))
        if args.force or not readers.exists(spark, target):
            prepared_row(spark, sample["name"], at(spec.get("genome") or spec["transcripts"]), at(sample.get("reads", sample["name"] + ".bam")), at(spec.get("annotations")), args, target)


def fit_tree(spark: SparkSession, args: argparse.Namespace) -> None:
    ts = transcripts_of(spark, args.genome_filename, args.annotations_filename, None, True)
    trees.sketch_tree(trees.sequence_sketches(ts.select(F.col("transcript_id").alias("feature"), "seq"))).write.mode("overwrite").parquet(args.output)


def prep_salmon(spark: SparkSession, args: argparse.Namespace) -> None:
    tree = spark.read.parquet(args.ptt_filename)
    leaf = tree.select(F.posexplode("features").alias("at", "feature"))
    classes, efflens = readers.quantified_sample(spark, f"{args.salmon_dir}/aux_info/eq_classes.txt.gz", f"{args.salmon_dir}/quant.sf", leaf.select("feature"))
    rows = classes.withColumn("read", F.monotonically_increasing_id()).select("read", "count", F.explode(F.arrays_zip("features", "probs")).alias("c"))
    table = materialize(rows.select("read", "count", F.col("c.features").alias("feature"), F.col("c.probs").alias("prob")), "classes")
    made = prepare.Sample(table, efflens)
    sinks.write_prepared(prepare.prepare_sample(name_of(args.output), made, tree, seed=args.seed, method=args.approx_method), args.output)


def sample(spark: SparkSession, args: argparse.Namespace) -> None:
    tpm = prepare.posterior_tpm(sinks.read_prepared(spark, args.prepared_filename), args.num_samples, args.seed)
    sinks.write_tpm(tpm.withColumnRenamed("feature", "transcript_id"), args.output)


def debug_sample(spark: SparkSession, args: argparse.Namespace) -> None:
    table, efflens = sinks.read_likelihood(spark, args.likelihood_filename)
    names = [(r.feature, r.efflen) for r in efflens.orderBy("feature").collect()]  # a sample's vector
    number = spark.createDataFrame([(n, i) for i, (n, _) in enumerate(names)], "feature string, i int")
    rows = table.join(number, "feature").select(F.lit("sample").alias("sample"), "read", F.col("i").alias("feature"), "prob")
    drawn = materialize(posterior.gibbs(rows, [e for _, e in names], args.num_chains, args.num_samples, args.stride, args.burn_in, args.seed), "gibbs")
    wide = drawn.select("chain", "draw", *(F.get("x", F.lit(i)).alias(n) for i, (n, _) in enumerate(names)))
    wide.orderBy("chain", "draw").coalesce(1).write.mode("overwrite").csv(args.output, header=True)
    flat = drawn.select("chain", "draw", F.posexplode("x").alias("i", "x"))
    rhat = sampling.split_rhat(flat, ["i"], "draw", "x", "chain").join(number, "i").select(F.col("feature").alias("transcript_id"), "rhat")
    rhat.write.mode("overwrite").csv(args.output + ".convergence.csv", header=True)


def debug_optimize(spark: SparkSession, args: argparse.Namespace) -> None:
    table, efflens = sinks.read_likelihood(spark, args.likelihood_filename)
    tpm = likelihood.to_tpm(likelihood.em(table, efflens), efflens)
    sinks.write_tpm(tpm.withColumnRenamed("feature", "transcript_id"), args.output)


def model_regression(spark: SparkSession, args: argparse.Namespace) -> None:
    base = os.path.dirname(args.experiment)
    listed = readers.experiment(spark, args.experiment)
    at = lambda p: p if "://" in p or os.path.isabs(p) else os.path.join(base, p)
    samples = [(r["sample"], at(r.file)) for r in listed.collect()]
    factors = listed.select("sample", F.explode("factors").alias("factor", "level"))
    if args.factors:
        factors = factors.where(F.col("factor").isin(args.factors.split(",")))
    if args.redundant_factor:
        # The level that is left out is the smallest one: it gets a name that comes before all.
        factors = factors.withColumn("level", F.when(F.col("level") == args.redundant_factor, F.concat(F.lit("\x01"), "level")).otherwise(F.col("level")))
    design = features.design_columns(factors, "sample", redundant=not (args.nonredundant or args.redundant_factor), balanced=args.balanced)
    if args.point_estimates:
        spec = readers.experiment_spec(spark, args.experiment)
        parts = [spark.read.csv(at(s["point-estimates"][args.point_estimates]), header=True).select(F.lit(s["name"]).alias("sample"), F.col("transcript_id").alias("feature"), F.log((F.col("tpm").cast("double") + args.pseudocount) / 1e6).alias("x")) for s in spec["samples"]]
        x = parts[0]
        for p in parts[1:]:
            x = x.unionByName(p)
        x = materialize(x, "points")
        fit = regression.regress(x, design, features.sample_scales(x, "sample", "feature"), rounds=args.rounds, distort=not args.no_distortion)
    else:
        rows = sinks.read_prepared(spark, samples[0][1]).withColumn("sample", F.lit(samples[0][0]))
        for name, path in samples[1:]:
            rows = rows.unionByName(sinks.read_prepared(spark, path).withColumn("sample", F.lit(name)))
        prepared, leaves = prepare.in_one_order(materialize(rows, "prepared"))
        prepared = materialize(prepared, "prepared")
        first = regression.initial_expression(prepared)
        x = first.select("sample", F.posexplode("m").alias("at", "x")).select("sample", (F.col("at") + 1).alias("feature"), "x")
        fit = regression.regress_prepared(prepared, leaves, design, features.sample_scales(materialize(x, "initial"), "sample", "feature"), rounds=args.rounds, distort=not args.no_distortion, total_deviation=args.scale_penalty)
    if not fit.converged:
        print(f"the fit had not converged after {fit.rounds} rounds", file=sys.stderr)
    shown = effects.effect_sizes(fit.effects.withColumn("factor", F.translate("factor", "\x01", "")), args.lower_credible, args.upper_credible, args.effect_size, args.min_effect_size_coverage)
    extra = ["bias", "deviation", "loc", "scale"] if args.write_variational_posterior_params else []
    columns = ["factor", F.col("feature").alias("transcript_id"), "min_effect_size", "mean_effect_size", "lower_credible", "upper_credible"]
    shown.select(*columns, *(["prob_de", "prob_down_de", "prob_up_de"] if args.effect_size is not None else []), *extra).write.mode("overwrite").csv(args.output, header=True)
    if args.output_expression:
        tpm = regression.expression_tpm(fit.expression)
        tpm.select(F.col("feature").alias("transcript_id"), "sample", "tpm").write.mode("overwrite").csv(args.output_expression, header=True)


COMMANDS = {"prep-sample": prep_sample, "prep": prep, "fit-tree": fit_tree, "prep-salmon": prep_salmon, "sample": sample, "debug-sample": debug_sample, "debug-optimize": debug_optimize}


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    args = parser().parse_args(argv)
    if args.command == "path":
        print(os.path.dirname(os.path.abspath(__file__)))
        return
    run = model_regression if args.command == "model" else COMMANDS[args.command]
    run(spark or SparkSession.builder.appName("tallyspark").getOrCreate(), args)


if __name__ == "__main__":
    main()
