"""Bias of fragments by the letters at their ends and by their share of G and C, and the likelihood under it."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import bias as kernel
from ..plans.scratch import materialize
from . import compatibility, fragments, intervals, likelihood, prepare
from .relations import hash_unit
from .sampling import quantile_histogram_ratio


def _summed(rows: DataFrame, size: int, of: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum over all rows (y, seq) of of(codes, y), an array of `size` numbers: each partition sends one at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            text = batch.column(1).to_pylist()
            if text:
                total += of(kernel.codes("".join(text)).reshape(len(text), -1), batch.column(0).to_numpy(zero_copy_only=False).astype(bool))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], names=["at", "value"])

    out = np.zeros(size)
    for r in rows.select("y", "seq").mapInArrow(run, "at int, value double").groupBy("at").agg(F.sum("value").alias("value")).collect():
        out[r.at] = r.value
    return out


def fit_sequence_bias(examples: DataFrame, highest: int = kernel.HIGHEST_ORDER) -> kernel.SequenceBias:
    """Markov order of each place of examples (y, seq of one width), y true for fragments and false for background.

    Greedy: each step tries one order more at every place, and takes the one that lowers the Bayesian information criterion
    of telling y most, until none does. A step is one pass for the likelihood of all places at once, and one for the counts
    of the place that was taken.
    """
    rows = materialize(examples.select(F.col("y").cast("boolean").alias("y"), "seq"), "examples")
    first = rows.agg(F.count("*"), F.min(F.length("seq")), F.max(F.length("seq"))).first()
    n, width = first[0], first[1] or 0
    if first[1] != first[2]:
        raise ValueError("examples must be of one width")

    def counted(tries: list[tuple[int, int]]) -> list[np.ndarray]:
        """Log ratios of places at given orders."""
        at = np.cumsum([0] + [2 * 4 ** (o + 1) for _, o in tries])

        def of(codes: np.ndarray, y: np.ndarray) -> np.ndarray:
            return np.concatenate([np.bincount(kernel.cells(codes, j, o) + y * 4 ** (o + 1), minlength=2 * 4 ** (o + 1)) for j, o in tries])

        sums = _summed(rows, int(at[-1]), of)
        return [kernel.log_ratios(sums[a:b].reshape(2, -1)) for a, b in zip(at, at[1:], strict=False)]

    orders, tables = [-1] * width, [np.zeros(0)] * width
    following = dict(enumerate(counted([(j, 0) for j in range(width)]))) if width else {}
    parameters, best = 0, 2 * n * math.log(2)
    while following:
        model, tries = kernel.SequenceBias(list(orders), list(tables)), sorted(following)
        ahead = dict(following)

        def gains(codes: np.ndarray, y: np.ndarray) -> np.ndarray:
            score, out = model.score(codes), np.zeros(width)
            for j in tries:
                own = model.tables[j][kernel.cells(codes, j, model.orders[j])] if model.orders[j] >= 0 else 0
                changed = score - own + ahead[j][kernel.cells(codes, j, model.orders[j] + 1)]
                out[j] = -np.logaddexp(0, np.where(y, -changed, changed)).sum()
            return out

        likelihoods = _summed(rows, width, gains)
        added = {j: 4 ** (2 + orders[j]) - (4 ** (1 + orders[j]) if orders[j] >= 0 else 0) for j in tries}
        loss = {j: -2 * likelihoods[j] + (parameters + added[j]) * math.log(n) for j in tries}
        taken = min(tries, key=lambda j: (loss[j], j))
        if loss[taken] >= best:
            break
        best, parameters = loss[taken], parameters + added[taken]
        orders[taken] += 1
        tables[taken] = following.pop(taken)
        if orders[taken] < highest and taken + orders[taken] + 1 < width:
            (following[taken],) = counted([(taken, orders[taken] + 1)])
    return kernel.SequenceBias(orders, tables)


def fit_gc_bias(examples: DataFrame, bins: int = 15) -> np.ndarray:
    """Ratio of fragments to background at each hundredth of GC share, by bins of equal weight of examples (y, gc)."""
    rows = examples.select(F.col("y").cast("int").alias("y"), "gc")
    edges = rows.agg(F.percentile("gc", F.array(*(F.lit(i / bins) for i in range(1, bins)))).alias("edges")).first()[0]
    ratio = {r.bin: r.ratio for r in quantile_histogram_ratio(rows, "gc", "y", bins).collect()}  # a row for each bin
    at = np.searchsorted(np.asarray(edges or [0.5]), np.arange(101) / 100, "left")
    return np.array([ratio.get(int(b), 1.0) for b in at])


def examples(placed: DataFrame, seed: int = 0) -> DataFrame:
    """(y, left, right, gc) of fragments (feature, first, last, seq), places from 1, and of background ones: as long, anywhere in the transcript, by a hash of the fragment's key."""
    size = F.col("last") - F.col("first") + 1
    room = F.char_length("seq") - size + 1
    elsewhere = 1 + F.floor(hash_unit(str(seed), F.col("feature"), F.col("key")) * room).cast("long")
    both = placed.where((F.col("first") >= 1) & (F.col("last") <= F.char_length("seq")) & (size >= kernel.WIDTH)).withColumn("s", F.explode(F.array(F.struct(F.lit(True).alias("y"), F.col("first").alias("first")), F.struct(F.lit(False).alias("y"), elsewhere.alias("first")))))
    fragment = F.substring(F.col("seq"), F.col("s.first").cast("int"), size.cast("int"))
    gc = (F.char_length(fragment) - F.char_length(F.translate(fragment, "GCgc", ""))) / size
    rows = both.select("s.y", "feature", "seq", F.col("s.first").alias("first"), (F.col("s.first") + size - 1).alias("last"), gc.alias("gc"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        letters = np.array(list("ACGT"))
        for frame in frames:
            sides: tuple[list[str], list[str]] = ([], [])
            for row in frame.itertuples():
                pad = kernel.padding(row.feature, 2 * kernel.WIDTH)
                text = "".join(letters[pad[: kernel.WIDTH]]) + row.seq.upper() + "".join(letters[pad[kernel.WIDTH :]])
                a, b = kernel.WIDTH + row.first - 1, kernel.WIDTH + row.last - 1
                sides[0].append(text[a - kernel.OUTER : a + kernel.INNER])
                sides[1].append(text[b - kernel.INNER + 1 : b + kernel.OUTER + 1])
            yield pd.DataFrame({"y": frame.y, "left": sides[0], "right": sides[1], "gc": frame.gc})

    return rows.mapInPandas(run, "y boolean, left string, right string, gc double")


def fit_bias(rows: DataFrame, highest: int = kernel.HIGHEST_ORDER) -> kernel.FragmentBias:
    """The bias model of examples (y, left, right, gc)."""
    rows = materialize(rows, "bias-examples")
    side = lambda c: fit_sequence_bias(rows.select("y", F.col(c).alias("seq")), highest)
    return kernel.FragmentBias(side("left"), side("right"), fit_gc_bias(rows.select("y", "gc")))


def biased_lengths(sequences: DataFrame, model: kernel.FragmentBias, lengths: DataFrame, most: int = kernel.LENGTHS) -> DataFrame:
    """(feature, efflen, left, right, gc): effective length of each (feature, seq) over the `most` likeliest lengths, and its biases by position."""
    likely = lengths.orderBy(F.desc("pmf"), "length").limit(most).select("length", "pmf").toPandas()
    size, pmf = likely.length.to_numpy(np.int64), likely.pmf.to_numpy(float)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples():
                left, right, gc = model.by_position(row.feature, row.seq or "")
                yield pd.DataFrame([{"feature": row.feature, "efflen": model.effective_length(left, right, gc, size, pmf), "left": left, "right": right, "gc": gc}])

    return sequences.select("feature", "seq").mapInPandas(run, "feature string, efflen double, left array<double>, right array<double>, gc array<bigint>")


def biased_probability(placed: DataFrame, biased: DataFrame, model: kernel.FragmentBias, lengths: DataFrame, specificity: float) -> DataFrame:
    """Fragments (feature, first, last, match, ...) with prob: strand share times pmf times the biases of both ends and of GC share, by effective length.

    Biases are looked up by (feature, position), so that a transcript with many fragments is no row that all of them carry.
    """
    spots = biased.select("feature", "efflen", F.posexplode(F.arrays_zip("left", "right", "gc")).alias("at", "b"))
    spots = materialize(spots.select("feature", (F.col("at") + 1).cast("long").alias("at"), "efflen", "b.left", "b.right", "b.gc"), "bias-positions")
    begin = spots.select("feature", F.col("at").alias("first"), "efflen", "left", (F.col("gc")).alias("_gc1"))
    end = spots.select("feature", F.col("at").alias("last"), "right", F.col("gc").alias("_gc2"))
    before = spots.select("feature", (F.col("at") + 1).alias("first"), F.col("gc").alias("_gc0"))
    size = F.col("last") - F.col("first") + 1
    joined = placed.join(begin, ["feature", "first"]).join(end, ["feature", "last"]).join(before, ["feature", "first"], "left")
    share = (F.col("_gc2") - F.coalesce("_gc0", F.lit(0))) / size
    bins = placed.sparkSession.createDataFrame([(i, float(r)) for i, r in enumerate(model.gc)], "bin int, ratio double")
    rows = fragments.histogram_lookup(bins, joined.withColumn("_share", share), "_share").withColumn("length", size)
    rows = rows.join(F.broadcast(lengths.select("length", "pmf")), "length", "left")
    prob = F.when(F.col("match"), specificity).otherwise(1 - specificity) * F.coalesce("pmf", F.lit(0.0)) * F.col("left") * F.col("right") * F.col("ratio") / F.col("efflen")
    return rows.withColumn("prob", prob).drop("_share", "_gc0", "_gc1", "_gc2", "bin", "ratio", "pmf", "left", "right", "efflen")


def biased_likelihood(transcripts: DataFrame, alignments: DataFrame, width: int = 100_000, seed: int = 0, highest: int = kernel.HIGHEST_ORDER) -> tuple[prepare.Sample, kernel.FragmentBias]:
    """prepare.sample_likelihood with bias; transcripts have their sequence in seq, in their own direction.

    Reads are first shared out without bias, and one transcript of each is drawn; their fragments against background ones
    of the same lengths and transcripts fit the model, which then gives effective lengths and probabilities.
    """
    plain = prepare.sample_likelihood(transcripts, alignments, width)
    y = likelihood.em(plain.likelihood, plain.efflens)
    owners = likelihood.assign_reads(plain.likelihood.join(y, "feature").select("read", "feature", (F.col("prob") * F.col("y")).alias("prob")), seed)
    median = plain.lengths.where("cdf >= 0.5").agg(F.min("length")).first()[0]
    pairs = materialize(prepare.paired(alignments).withColumn("pair", F.monotonically_increasing_id()), "pairs")
    outer = transcripts.select(F.col("transcript_id").alias("feature"), "seqname", "strand", "exons", F.col("first").alias("o_first"), F.col("last").alias("o_last"))
    blocks = lambda m: compatibility.blocks(F.col(f"{m}.left"), F.col(f"{m}.cigar"))
    inner = pairs.select("pair", "read_name", "seqname", F.col("first").alias("i_first"), F.col("last").alias("i_last"), "reverse", F.col("two").isNotNull().alias("whole"), blocks("one").alias("one"), F.when(F.col("two").isNotNull(), blocks("two")).alias("two"))
    inner = inner.withColumn("bounds", compatibility.bounds(F.col("one"), F.col("two")))
    met = intervals.containment_join(outer, inner, "seqname", width).where(compatibility.may_fit(F.col("bounds"), F.col("exons")))
    range_ = F.explode(F.array(compatibility.transcript_range(F.col("exons"), F.col("strand"), F.col("one"), F.col("two"), F.col("reverse"), median)))
    placed = met.select("pair", "read_name", "seqname", "i_first", "feature", range_.alias("p"), (F.col("reverse") == (F.col("strand") == "-")).alias("match")).where("p IS NOT NULL")
    placed = materialize(placed.select("pair", "read_name", "seqname", "i_first", "feature", "p.first", "p.last", "match"), "placed")
    numbers = prepare.read_numbers(placed.select("read_name", "seqname", F.col("i_first").alias("first")))
    sequences = materialize(transcripts.select(F.col("transcript_id").alias("feature"), "seq"), "sequences")
    owned = placed.join(plain.names, "read_name").join(owners, ["read", "feature"]).groupBy("read", "feature").agg(F.min(F.struct("first", "last")).alias("p"))
    seen = owned.join(sequences, "feature").select("feature", "p.first", "p.last", "seq", F.col("read").alias("key"))
    model = fit_bias(examples(seen, seed), highest)
    biased = materialize(biased_lengths(sequences, model, plain.lengths), "biased")
    rows = biased_probability(placed, biased, model, plain.lengths, plain.specificity).where(F.col("prob") > prepare.LEAST_PROBABILITY)
    table = likelihood.likelihood_table(rows.join(numbers, "read_name"), "read", "feature", "prob")
    return prepare.Sample(materialize(table, "likelihood"), biased.select("feature", "efflen"), plain.lengths, plain.specificity, numbers), model
