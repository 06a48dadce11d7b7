"""Probabilities of fragments, counts and proportions, draws, and errors between estimates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .relations import hash_unit

#: Sequences whose k-mers a task counts.
SPREAD = 20_000


def strand_specificity(pairs: DataFrame, match: Column) -> DataFrame:
    """One row: matches, mismatches, their specificity, and one less the entropy in bits."""
    n = pairs.agg(F.count(F.when(match, 1)).alias("matches"), F.count(F.when(~match, 1)).alias("mismatches"))
    s = F.col("matches") / (F.col("matches") + F.col("mismatches"))
    part = lambda p: F.when(p > 0, p * F.log2(p)).otherwise(0.0)
    return n.select("matches", "mismatches", s.alias("specificity"), (1 + part(s) + part(1 - s)).alias("negentropy"))


def conditional_probability(fragments: DataFrame, lengths: DataFrame, efflens: DataFrame, match: Column, specificity: float) -> DataFrame:
    """Fragments (feature, length, ...) with prob: strand share times pmf(length) by effective length; a length without a pmf has 0.

    lengths has at most as many rows as a fragment is long, so it is broadcast.
    """
    joined = fragments.join(F.broadcast(lengths.select("length", "pmf")), "length", "left").join(efflens, "feature")
    strand = F.when(match, specificity).otherwise(1 - specificity)
    return joined.withColumn("prob", strand * F.coalesce("pmf", F.lit(0.0)) / F.col("efflen"))


def expected_counts(proportions: DataFrame, efflens: DataFrame, sample: str, reads: float) -> DataFrame:
    """(sample, feature, count): reads shared out by proportion times effective length."""
    weighted = proportions.join(efflens, "feature").withColumn("w", F.col("p") * F.col("efflen"))
    total = weighted.groupBy(sample).agg(F.sum("w").alias("total"))
    return weighted.join(total, sample).select(sample, "feature", (reads * F.col("w") / F.col("total")).alias("count"))


def counts_to_proportions(counts: DataFrame, efflens: DataFrame, sample: str, pseudocount: float) -> DataFrame:
    """(sample, feature, p): count by effective length, normalised in a sample; a millionth of pseudocount is added after that."""
    rate = counts.join(efflens, "feature").withColumn("r", F.col("count") / F.col("efflen"))
    total = rate.groupBy(sample).agg(F.sum("r").alias("total"))
    return rate.join(total, sample).select(sample, "feature", (F.col("r") / F.col("total") + pseudocount / 1e6).alias("p"))


def sample_counts(proportions: DataFrame, sample: str, draws: int, seed: str) -> DataFrame:
    """(sample, feature, n): draws of features by their cumulative share, counted. A draw is a hash, and meets its feature by order, not by a join."""
    w = W.partitionBy(sample)
    ends = proportions.where("p > 0").select(sample, "feature", (F.sum("p").over(w.orderBy("feature")) / F.sum("p").over(w)).alias("at"), F.lit(1).alias("kind"))
    thrown = proportions.select(sample).distinct().withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(draws))))
    thrown = thrown.select(sample, F.lit(None).cast(dict(proportions.dtypes)["feature"]).alias("feature"), hash_unit(seed, F.col(sample), F.col("k")).alias("at"), F.lit(0).alias("kind"))
    following = W.partitionBy(sample).orderBy("at", F.desc("kind")).rowsBetween(0, W.unboundedFollowing)
    # A draw at the very end of a share belongs to the next one, so ends come before draws of the same place.
    met = ends.unionByName(thrown).withColumn("drawn", F.first("feature", ignorenulls=True).over(following))
    return met.where("kind = 0 and drawn is not null").groupBy(sample, F.col("drawn").alias("feature")).agg(F.count("*").alias("n"))


def log_fold_errors(one: DataFrame, two: DataFrame, feature: str) -> DataFrame:
    """One row: mean and median of the absolute difference of two estimates' log2 fold changes (a, b)."""
    both = one.select(feature, F.log2(F.col("a") / F.col("b")).alias("x")).join(two.select(feature, F.log2(F.col("a") / F.col("b")).alias("y")), feature)
    return both.agg(F.avg(F.abs(F.col("x") - F.col("y"))).alias("mean_error"), F.median(F.abs(F.col("x") - F.col("y"))).alias("median_error"))


def isoform_effects(draws: DataFrame, gene: str, transcript: str, delta: float, coverage: float) -> DataFrame:
    """(gene, transcript, mean, prob, least) over draws (draw, gene, transcript, a, b) of two log expressions.

    In each draw the shares of a gene's transcripts are softmaxes; the effect is the log2 ratio of the two shares. prob is how
    often it reaches delta in size, least the size that the share `coverage` of draws reaches.
    """
    w = W.partitionBy("draw", gene)
    top = draws.withColumns({"ma": F.max("a").over(w), "mb": F.max("b").over(w)})
    sums = top.withColumns({"sa": F.sum(F.exp(F.col("a") - F.col("ma"))).over(w), "sb": F.sum(F.exp(F.col("b") - F.col("mb"))).over(w)})
    effect = (F.col("a") - F.col("ma") - F.log("sa") - F.col("b") + F.col("mb") + F.log("sb")) / F.log(F.lit(2.0))
    rows = sums.select(gene, transcript, effect.alias("x"))
    sizes = F.sort_array(F.collect_list(F.abs("x")))
    at = F.greatest(F.lit(1), F.floor((1 - coverage) * F.count("*")).cast("int") + 1)
    return rows.groupBy(gene, transcript).agg(F.avg("x").alias("mean"), F.avg((F.abs("x") >= delta).cast("double")).alias("prob"), F.element_at(sizes, F.least(at, F.count("*").cast("int"))).alias("least"))


def true_label_probability(predicted: DataFrame, truth: DataFrame, sample: str) -> DataFrame:
    """(label, probability, samples): the probability (sample, draw, label, p) given to the true label, averaged over draws, then over a label's samples."""
    own = truth.join(predicted, [sample, "label"], "left").groupBy(sample, "label").agg(F.avg(F.coalesce("p", F.lit(0.0))).alias("p"))
    return own.groupBy("label").agg(F.avg("p").alias("probability"), F.count("*").alias("samples"))


def normal_by_draws(draws: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, mean, sd): a normal approximation, the mean of the draws and their root mean square about it."""
    return draws.groupBy(*keys).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("sd"))


def context_code(sequence: Column) -> Column:
    """The letters A, C, G, T as two bits each, the first the highest; others count as A."""
    codes = F.transform(F.split(sequence, ""), lambda c: F.greatest(F.instr(F.lit("ACGT"), c) - 1, F.lit(0)))
    return F.aggregate(codes, F.lit(0).cast("long"), lambda acc, c: F.shiftleft(acc, 2) + c)


def padded(sequence: Column, first: Column, last: Column, pad: str = "N") -> Column:
    """Letters first to last, counted from 1; places outside the sequence are pad."""
    before, after = F.greatest(F.lit(0), F.least(last, F.lit(0)) - first + 1), F.greatest(F.lit(0), last - F.greatest(F.char_length(sequence), first - 1))
    inside = F.substring(sequence, F.greatest(first, F.lit(1)), F.greatest(F.lit(0), F.least(last, F.char_length(sequence)) - F.greatest(first, F.lit(1)) + 1))
    return F.concat(F.repeat(F.lit(pad), before.cast("int")), inside, F.repeat(F.lit(pad), after.cast("int")))


def histogram_lookup(bins: DataFrame, rows: DataFrame, x: str) -> DataFrame:
    """rows with `ratio` of the bin (bin, ratio) at round(100 x), clamped to 0..100; the 101 bins are broadcast."""
    at = F.greatest(F.lit(0), F.least(F.lit(100), F.floor(F.col(x) * 100 + 0.5).cast("int")))
    return rows.withColumn("bin", at).join(F.broadcast(bins), "bin", "left")


def kmer_usage(sequences: DataFrame, key: str, text: str, k: int, segments: int, weight) -> DataFrame:
    """(key, segment, kmer, best): the largest weight of each k-mer in each of a sequence's equal segments; weight(pos) gives a place's weight.

    Rows are dealt out by key before they become places, SPREAD to a task: a file that fits one split holds many times its size in places.
    """
    long_enough = sequences.where(F.char_length(text) >= k).select(key, text)
    dealt = long_enough.repartition(max(1, -(-long_enough.count() // SPREAD)), key)
    places = dealt.select(key, text, F.explode(F.sequence(F.lit(1), F.char_length(text) - k + 1)).alias("pos"))
    segment = F.floor((F.col("pos") - 1) * segments / (F.char_length(text) - k + 1)).cast("int")
    return places.groupBy(key, segment.alias("segment"), F.substring(F.col(text), F.col("pos"), F.lit(k)).alias("kmer")).agg(F.max(weight(F.col("pos"))).alias("best"))
