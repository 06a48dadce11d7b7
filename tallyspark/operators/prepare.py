"""From alignments and transcripts to a prepared sample: fragments, their likelihood, a tree, and the approximation on it."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import alternatives
from ..functions import trees as tree_kernels
from ..plans.scratch import materialize
from ..sources import readers
from . import compatibility, features, fragments, intervals, likelihood, posterior, relations, trees

#: Flags that tell alignments apart (paired, all aligned, reverse, first, second), the widest pair, and the least probability.
USED_FLAGS, REVERSE, SECOND = 0x1 | 0x2 | 0x10 | 0x40 | 0x80, 0x10, 0x80
WIDEST_PAIR, LEAST_PROBABILITY = 500_000, 1e-12


def paired(alignments: DataFrame, widest: int = WIDEST_PAIR) -> DataFrame:
    """(read_name, seqname, first, last, reverse, own_reverse, one, two) of alignments (read_name, seqname, left, right, flag, cigar).

    Each first mate with each second one of its read on a sequence, no further apart than `widest`; a mate is alone, and
    two is null, only where the other kind is missing. Alignments that differ in no used flag count once. One shuffle
    gathers a read's alignments.
    """
    mate = F.struct("left", "right", F.col("flag").bitwiseAND(USED_FLAGS).alias("flag"), "cigar")
    reads = alignments.groupBy("read_name", "seqname").agg(F.collect_set(mate).alias("mates"))
    second = lambda m: m["flag"].bitwiseAND(SECOND) != 0
    sides = reads.select("read_name", "seqname", F.filter("mates", lambda m: ~second(m)).alias("ones"), F.filter("mates", second).alias("twos"))
    none = F.lit(None).cast(dict(sides.dtypes)["ones"])
    pairs = F.flatten(F.transform("ones", lambda a: F.transform("twos", lambda b: F.struct(a.alias("one"), b.alias("two")))))
    single = F.transform(F.concat("ones", "twos"), lambda a: F.struct(a.alias("one"), F.get(none, F.lit(0)).alias("two")))
    rows = sides.select("read_name", "seqname", F.explode(F.when((F.size("ones") > 0) & (F.size("twos") > 0), pairs).otherwise(single)).alias("p")).select("read_name", "seqname", "p.one", "p.two")
    placed = rows.select(
        "*",
        F.least("one.left", "two.left").alias("first"),
        F.greatest("one.right", "two.right").alias("last"),
        (F.col("one.flag").bitwiseAND(REVERSE) != 0).alias("reverse"),
        (F.col("one.flag") == REVERSE).alias("own_reverse"),
    )
    return placed.where(F.col("two").isNull() | (F.col("last") - F.col("first") <= widest))


def compatible(transcripts: DataFrame, pairs: DataFrame, width: int = 100_000) -> DataFrame:
    """(pair, read_name, seqname, first, transcript_id, t_length, length, match, room): the transcripts that each fragment may be of.

    length is the fragment's, 0 for a single mate, whose room is what the transcript's span leaves it.
    """
    outer = transcripts.select("transcript_id", "seqname", "strand", "exons", F.col("exonic_length").alias("t_length"), F.col("first").alias("o_first"), F.col("last").alias("o_last"))
    blocks = lambda m: compatibility.blocks(F.col(f"{m}.left"), F.col(f"{m}.cigar"))
    inner = pairs.select("pair", "read_name", "seqname", F.col("first").alias("i_first"), F.col("last").alias("i_last"), "reverse", "own_reverse", blocks("one").alias("one"), F.when(F.col("two").isNotNull(), blocks("two")).alias("two"))
    inner = inner.withColumn("bounds", compatibility.bounds(F.col("one"), F.col("two")))
    met = intervals.containment_join(outer, inner, "seqname", width).where(compatibility.may_fit(F.col("bounds"), F.col("exons")))
    length = F.explode(F.array(compatibility.fragment_length(F.col("exons"), F.col("one"), F.col("two"))))  # exploded, so that it is worked out once
    room = F.when(F.col("own_reverse"), F.col("i_last") - F.col("o_first") + 1).otherwise(F.col("o_last") - F.col("i_first") + 1)
    match = F.col("reverse") == (F.col("strand") == "-")
    return met.select("pair", "read_name", "seqname", F.col("i_first").alias("first"), "transcript_id", "t_length", length.alias("length"), match.alias("match"), room.alias("room")).where("length IS NOT NULL")


@dataclass
class Sample:
    """likelihood (read, feature, prob), efflens (feature, efflen), lengths (length, pmf, cdf), the share of fragments on their transcript's strand, reads' numbers (read_name, read).

    Rows of a quantifier's classes have a count besides, and neither lengths nor names.
    """

    likelihood: DataFrame
    efflens: DataFrame
    lengths: DataFrame | None = None
    specificity: float | None = None
    names: DataFrame | None = None


def sample_likelihood(transcripts: DataFrame, alignments: DataFrame, width: int = 100_000, by_length: bool = False) -> Sample:
    """The likelihood of alignments under transcripts, as readers.transcripts and readers.bam give them, without bias.

    Strand share and fragment lengths are counted over all compatible fragments, a pair by its shortest length. A fragment's
    probability in a transcript is strand share times pmf by effective length; by_length divides it by the share of lengths
    that the transcript can have. Reads are numbered by place; alignments that no transcript takes are left out.
    """
    pairs = materialize(paired(alignments).withColumn("pair", F.monotonically_increasing_id()), "pairs")
    met = materialize(compatible(transcripts, pairs, width), "compatible")
    matches, n = met.agg(F.count_if("match"), F.count("*")).first()
    if not n:
        raise ValueError("no alignment overlaps a transcript: are these the transcripts of the genome that reads were aligned to?")
    shortest = met.where("length > 0").groupBy("pair").agg(F.min("length").alias("length"))
    lengths = materialize(features.length_distribution(shortest), "lengths")
    median = lengths.where("cdf >= 0.5").agg(F.min("length")).first()[0]
    sized = transcripts.select(F.col("transcript_id").alias("feature"), F.col("exonic_length").alias("t"))
    efflens = features.effective_lengths(sized, lengths)
    reach = lengths.select(F.col("length").alias("_at"), F.col("cdf").alias("_reach"))
    if by_length:
        most = lengths.agg(F.max("length")).first()[0]
        reached = lambda df, t: df.withColumn("_at", F.least(F.col(t), F.lit(most))).join(F.broadcast(reach), "_at").drop("_at")
        efflens = reached(efflens, "t").withColumn("efflen", F.greatest(F.lit(1.0), F.col("efflen") / F.col("_reach"))).drop("_reach")
    efflens = materialize(efflens.select("feature", "efflen"), "efflens")
    rows = met.withColumn("length", F.when(F.col("length") > 0, F.col("length")).otherwise(F.least("room", F.lit(median)))).withColumnRenamed("transcript_id", "feature")
    rows = fragments.conditional_probability(rows, lengths, efflens, F.col("match"), matches / n)
    if by_length:
        rows = reached(rows, "t_length").withColumn("prob", F.col("prob") / F.col("_reach"))
    kept = materialize(rows.where(F.col("prob") > LEAST_PROBABILITY).select("read_name", "seqname", "first", "feature", "prob"), "fragments")
    numbers = read_numbers(kept)
    table = likelihood.likelihood_table(kept.join(numbers, "read_name"), "read", "feature", "prob")
    return Sample(materialize(table, "likelihood"), efflens, lengths, matches / n, numbers)


def read_numbers(rows: DataFrame) -> DataFrame:
    """(read_name, read): reads numbered from 1 by their first place (seqname, first)."""
    place = rows.groupBy("read_name").agg(F.min(F.struct("seqname", "first")).alias("p")).select("p.seqname", "p.first", "read_name")
    return materialize(relations.dense_ids(place, ["seqname", "first", "read_name"], "read").select("read_name", "read"), "numbers")


def tree_of(sample: str, made: Sample, method: str = "cluster", seed: int = 123_456_789) -> DataFrame:
    """(sample, features, parents, leaves): clustered by shared reads, or random, random-list or list over the features in their order."""
    if method == "cluster":
        return trees.read_set_trees(made.likelihood.withColumn("sample", F.lit(sample)), made.efflens.select("feature"))
    names = sorted(r.feature for r in made.efflens.select("feature").collect())  # one tree is a vector over the features
    n = len(names)
    merges = {"random": lambda: tree_kernels.random_tree(n, seed), "random-list": lambda: tree_kernels.random_list(n, seed), "list": lambda: tree_kernels.list_tree(list(range(n)))}
    if method not in merges:
        raise ValueError(f"no tree method {method}; there are cluster, {', '.join(merges)}")
    parents, leaves = tree_kernels.serialised(n, merges[method]())
    return made.likelihood.sparkSession.createDataFrame([(sample, names, parents.tolist(), leaves.tolist())], trees.TREE)


def prepare_sample(sample: str, made: Sample, tree: DataFrame | str = "cluster", steps: int = 500, draws: int = 6, seed: int = 123_456_789, method: str = alternatives.METHODS[0]) -> DataFrame:
    """One prepared row (sample, features, method, reference, values, mu, omega, alpha, parents, leaves, efflen), leaf i being features[i - 1].

    tree is a method, or a row (features, parents, leaves) that fits all samples, as a tree of sketches. Reads go to the fit
    as classes with counts. mu, omega and alpha are the values of the default approximation, and null for others.
    """
    shape = materialize(tree_of(sample, made, tree, seed) if isinstance(tree, str) else tree.select(F.lit(sample).alias("sample"), "features", "parents", "leaves"), "tree")
    leaf = materialize(shape.select(F.posexplode("features").alias("at", "feature")), "leaves")
    if made.efflens.join(leaf, "feature", "left_anti").limit(1).count():
        raise ValueError("the tree lacks a feature")
    rows = made.likelihood.join(leaf, "feature").select("read", F.col("at").alias("feature"), "prob", *(c for c in made.likelihood.columns if c == "count"))
    classes = likelihood.exact_classes(rows).withColumn("class_key", F.monotonically_increasing_id())
    flat = materialize(classes.select("class_key", "count", F.explode(F.arrays_zip("features", "probs")).alias("c")), "classes")
    flat = flat.select(F.lit(sample).alias("sample"), "class_key", "count", F.col("c.features").alias("feature"), F.col("c.probs").alias("prob"))
    fitted = posterior.approximate_by(method, flat, shape, steps, draws, seed)
    fitted = fitted.select("*", *(F.when(F.col("method") == alternatives.METHODS[0], F.get("values", F.lit(i))).alias(c) for i, c in enumerate(("mu", "omega", "alpha"))))
    sizes = leaf.join(made.efflens, "feature", "left").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", F.coalesce("efflen", F.lit(1.0)).alias("efflen")))), lambda c: c["efflen"]).alias("efflen"))
    return fitted.join(shape.select("sample", "features"), "sample").join(F.broadcast(sizes.withColumn("sample", F.lit(sample))), "sample")


def in_one_order(prepared: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(prepared rows, (feature, leaf)): leaves and effective lengths of all samples by the order of the features' names, which must be the same set."""
    names = prepared.select("sample", F.array_sort("features").alias("names"))
    if names.select(F.sha2(F.array_join("names", "\n"), 256)).distinct().count() > 1:
        raise ValueError("samples were prepared with different sets of transcripts")
    listed = names.limit(1).select(F.posexplode("names").alias("at", "feature")).select("feature", (F.col("at") + 1).alias("leaf"))

    @F.pandas_udf("array<int>")
    def renamed(leaves: pd.Series, own: pd.Series) -> pd.Series:
        out = []
        for leaf, features in zip(leaves, own, strict=True):
            place = np.empty(len(features) + 1, np.int64)
            place[0] = 0
            place[1 + np.argsort(np.asarray(features, object), kind="stable")] = np.arange(1, len(features) + 1)
            out.append(place[np.asarray(leaf)])
        return pd.Series(out)

    sizes = F.transform(F.array_sort(F.arrays_zip(F.col("features").alias("f"), F.col("efflen").alias("e"))), lambda p: p["e"])
    return prepared.withColumns({"leaves": renamed("leaves", "features"), "efflen": sizes, "features": F.array_sort("features")}), listed


def prepare_files(spark: SparkSession, sample: str, alignments: str, annotation: str, excluded_sequences: DataFrame | None = None, excluded_transcripts: DataFrame | None = None, strip_mate: bool = False, **options) -> DataFrame:
    """prepare_sample from a BAM or SAM file and a GFF3 annotation."""
    read = readers.sam if alignments.endswith(".sam") else readers.bam
    made = sample_likelihood(readers.transcripts(readers.gff3_rows(spark, annotation), excluded_transcripts), read(spark, alignments, excluded_sequences, strip_mate))
    return prepare_sample(sample, made, **options)


def posterior_tpm(prepared: DataFrame, draws: int = 1000, seed: int = 123_456_789) -> DataFrame:
    """(sample, feature, tpm): the mean of draws of each prepared row over effective length."""
    drawn = posterior.sample_by(prepared.select("sample", "method", "reference", "values", "parents", "leaves"), draws, seed).join(prepared.select("sample", "features", "efflen"), "sample")

    @F.pandas_udf("array<double>")
    def rates(x: pd.Series, efflen: pd.Series) -> pd.Series:
        out = [np.asarray(a) / np.asarray(e) for a, e in zip(x, efflen, strict=True)]
        return pd.Series([a / a.sum() for a in out])

    flat = drawn.select("sample", F.explode(F.arrays_zip(F.col("features").alias("feature"), rates("x", "efflen").alias("x"))).alias("c"))
    return flat.groupBy("sample", F.col("c.feature").alias("feature")).agg((1e6 * F.avg("c.x")).alias("tpm"))
