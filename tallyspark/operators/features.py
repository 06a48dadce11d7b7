"""Feature roll-ups, splicing events, scales, design matrices and fragment-length statistics."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def roll_up(expression: DataFrame, mapping: DataFrame, sample: str, feature: str, group: str) -> DataFrame:
    """(sample, group, x): sums of features' expression by their group."""
    return expression.join(mapping, feature).groupBy(sample, group).agg(F.sum("x").alias("x"))


def log_ratios(expression: DataFrame, sides: DataFrame, sample: str, feature: str, event: str) -> DataFrame:
    """(sample, event, log_ratio): log of the included less log of the excluded expression; sides has (event, feature, side)."""
    sums = expression.join(sides, feature).groupBy(sample, event).agg(F.sum(F.when(F.col("side") == "include", F.col("x"))).alias("a"), F.sum(F.when(F.col("side") == "exclude", F.col("x"))).alias("b"))
    return sums.where("a > 0 and b > 0").select(sample, event, (F.log("a") - F.log("b")).alias("log_ratio"))


def sample_scales(expression: DataFrame, sample: str, feature: str, quantile: float = 0.95) -> DataFrame:
    """(sample, scale): the median, over features above the quantile of the medians, of a feature's median over samples less its value."""
    medians = expression.groupBy(feature).agg(F.median("x").alias("m"))
    top = medians.crossJoin(F.broadcast(medians.agg(F.percentile("m", F.lit(quantile)).alias("q")))).where("m > q").select(feature, "m")
    return expression.join(top, feature).groupBy(sample).agg(F.median(F.col("m") - F.col("x")).alias("scale"))


def design_columns(factors: DataFrame, sample: str, redundant: bool = False, balanced: bool = False) -> DataFrame:
    """(sample, column, value) for samples' (factor, level): a column for each level but, unless redundant, the smallest; 0/1, or -1/1 when balanced.

    A null level is the level "missing".
    """
    named = factors.select(sample, "factor", F.coalesce("level", F.lit("missing")).alias("level")).distinct()
    levels = named.select("factor", "level").distinct()
    if not redundant:
        levels = levels.withColumn("at", F.row_number().over(W.partitionBy("factor").orderBy("level"))).where("at > 1").drop("at")
    grid = named.select(sample, F.col("factor"), F.col("level").alias("own")).join(levels, "factor")
    value = F.when(F.col("own") == F.col("level"), 1).otherwise(-1 if balanced else 0)
    return grid.groupBy(sample, F.concat_ws(":", "factor", "level").alias("column")).agg(F.max(value).alias("value"))


def cassette_exons(exons: DataFrame) -> DataFrame:
    """(seqname, strand, first, last, intron_first, intron_last, include, exclude) from exons (transcript, seqname, strand, first, last).

    An internal exon with its flanking introns, where another transcript has one intron over the same span.
    """
    w = W.partitionBy("transcript").orderBy("first")
    near = exons.withColumns({"before": F.lag("last").over(w), "after": F.lead("first").over(w)})
    introns = near.where("after is not null").groupBy("seqname", "strand", (F.col("last") + 1).alias("intron_first"), (F.col("after") - 1).alias("intron_last")).agg(F.array_sort(F.collect_set("transcript")).alias("exclude"))
    inner = near.where("before is not null and after is not null").groupBy("seqname", "strand", "first", "last", (F.col("before") + 1).alias("intron_first"), (F.col("after") - 1).alias("intron_last"))
    return inner.agg(F.array_sort(F.collect_set("transcript")).alias("include")).join(introns, ["seqname", "strand", "intron_first", "intron_last"])


def mutually_exclusive_exons(exons: DataFrame) -> DataFrame:
    """(seqname, strand, intron_first, intron_last, first_a, last_a, first_b, last_b, include, exclude): internal exons between the same flanks that form exactly two islands.

    include lists the transcripts with an exon in the first island, exclude those with one in the second.
    """
    from .intervals import islands

    w = W.partitionBy("transcript").orderBy("first")
    near = exons.withColumns({"before": F.lag("last").over(w), "after": F.lead("first").over(w)}).where("before is not null and after is not null")
    flanks = near.select("seqname", "strand", (F.col("before") + 1).alias("intron_first"), (F.col("after") - 1).alias("intron_last"), "first", "last", "transcript")
    keys = ["seqname", "strand", "intron_first", "intron_last"]
    whole = flanks.groupBy(*keys, "first", "last").agg(F.collect_set("transcript").alias("ids"))
    merged = islands(whole.select(*keys, F.col("first").alias("f"), F.col("last").alias("l")), keys, "f", "l")
    pair = merged.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("first", "last"))).alias("i")).where(F.size("i") == 2)
    two = pair.select(*keys, F.col("i")[0]["first"].alias("first_a"), F.col("i")[0]["last"].alias("last_a"), F.col("i")[1]["first"].alias("first_b"), F.col("i")[1]["last"].alias("last_b"))
    side = lambda first: F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.when((F.col("last") <= F.col("last_a")) == first, F.col("ids"))))))
    return whole.join(two, keys).groupBy(*keys, "first_a", "last_a", "first_b", "last_b").agg(side(True).alias("include"), side(False).alias("exclude"))


def alternative_sites(exons: DataFrame) -> DataFrame:
    """(seqname, strand, fixed, short, long, side, include, exclude): internal exons that overlap with one flank in common and another splice site.

    side is "start" where the exons begin apart after the same exon, "end" where they end apart before the same one;
    the included transcripts are those with the shorter intron.
    """
    w = W.partitionBy("transcript").orderBy("first")
    near = exons.withColumns({"before": F.lag("last").over(w), "after": F.lead("first").over(w)})
    found = None
    for side, fixed, site, far in (("start", "before", "first", "last"), ("end", "after", "last", "first")):
        ends = near.where(f"{fixed} is not null").groupBy("seqname", "strand", F.col(fixed).alias("fixed"), F.col(site).alias("site")).agg(F.array_sort(F.collect_set("transcript")).alias("ids"), F.min("first").alias("lo"), F.max("last").alias("hi"))
        a, b = ends.alias("a"), ends.alias("b")
        same = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in ("seqname", "strand", "fixed")]
        pairs = a.join(b, [*same, F.abs(F.col("a.site") - F.col("a.fixed")) < F.abs(F.col("b.site") - F.col("b.fixed")), F.col("a.lo") <= F.col("b.hi"), F.col("b.lo") <= F.col("a.hi")])
        rows = pairs.select("a.seqname", "a.strand", "a.fixed", F.col("a.site").alias("short"), F.col("b.site").alias("long"), F.lit(side).alias("side"), F.col("a.ids").alias("include"), F.col("b.ids").alias("exclude"))
        found = rows if found is None else found.unionByName(rows)
    return found


def retained_introns(exons: DataFrame, width: int = 1000) -> DataFrame:
    """(seqname, strand, intron_first, intron_last, include, exclude): introns of some transcripts that lie inside an exon of others, which include them."""
    from .intervals import containment_join

    w = W.partitionBy("transcript").orderBy("first")
    introns = exons.withColumn("after", F.lead("first").over(w)).where("after is not null")
    introns = introns.groupBy("seqname", "strand", (F.col("last") + 1).alias("i_first"), (F.col("after") - 1).alias("i_last")).agg(F.array_sort(F.collect_set("transcript")).alias("exclude"))
    keyed = lambda df: df.withColumn("place", F.concat_ws("|", "seqname", "strand"))
    # Transcripts share exons: each distinct exon meets the introns once, with the set of its transcripts.
    outer = keyed(exons).groupBy("place", F.col("first").alias("o_first"), F.col("last").alias("o_last")).agg(F.collect_set("transcript").alias("ids"))
    joined = containment_join(outer, keyed(introns), "place", width)
    return joined.groupBy("seqname", "strand", F.col("i_first").alias("intron_first"), F.col("i_last").alias("intron_last")).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))).alias("include"), F.first("exclude").alias("exclude"))


def length_distribution(lengths: DataFrame, most: int = 2000, least_observed: int = 1000) -> DataFrame:
    """(length, pmf, cdf) for 1 to most: counts with a pseudocount of one, or normal(150, 50) when fewer than least_observed were seen."""
    spark = lengths.sparkSession
    support = spark.range(1, most + 1).select(F.col("id").alias("length"))
    counts = lengths.where(F.col("length").between(1, most)).groupBy("length").agg(F.count("*").alias("n"))
    seen = support.join(counts, "length", "left").select("length", F.coalesce("n", F.lit(0)).alias("n"), F.exp(-0.5 * F.pow((F.col("length") - 150) / 50.0, 2)).alias("normal"))
    sums = seen.agg(F.sum("n").alias("total"), F.sum("normal").alias("mass"))
    pmf = F.when(F.col("total") >= least_observed, (F.col("n") + 1) / (F.col("total") + most)).otherwise(F.col("normal") / F.col("mass"))
    rows = seen.crossJoin(F.broadcast(sums)).select("length", pmf.alias("pmf"))
    return rows.withColumn("cdf", F.sum("pmf").over(W.orderBy("length").rowsBetween(W.unboundedPreceding, 0)))


def effective_lengths(features: DataFrame, distribution: DataFrame) -> DataFrame:
    """(features' columns, efflen): sum over l up to the length t of pmf(l) * (t - l + 1), at least 1; two prefix sums make it one lookup."""
    w = W.orderBy("length").rowsBetween(W.unboundedPreceding, 0)
    sums = distribution.withColumns({"s0": F.sum("pmf").over(w), "s1": F.sum(F.col("pmf") * F.col("length")).over(w)}).select("length", "s0", "s1")
    most = sums.agg(F.max("length").alias("most"))
    keyed = features.crossJoin(F.broadcast(most)).withColumn("_at", F.least(F.col("t"), F.col("most")))
    joined = keyed.join(F.broadcast(sums.withColumnRenamed("length", "_at")), "_at", "left")  # at most 2000 rows
    return joined.withColumn("efflen", F.greatest(F.lit(1.0), F.coalesce((F.col("t") + 1) * F.col("s0") - F.col("s1"), F.lit(0.0)))).drop("_at", "most", "s0", "s1")


def alternative_ends(exons: DataFrame, genes: DataFrame, within: int = 250, forward: object = "+") -> DataFrame:
    """(gene, type, first, last, include, exclude): places where a gene's transcripts begin or end, merged within a distance.

    Only genes whose transcripts have several such clusters count. Of two clusters the first is given, of more each;
    the transcripts of the gene's other clusters are excluded. Lowest positions are 5' ends on the forward strand.
    """
    spans = exons.groupBy("transcript", "strand").agg(F.min("first").alias("first"), F.max("last").alias("last")).join(genes, "transcript")
    sides = F.explode(F.array(F.struct(F.lit(True).alias("low"), F.col("first").alias("at")), F.struct(F.lit(False).alias("low"), F.col("last").alias("at"))))
    ends = spans.select("gene", "transcript", "strand", sides.alias("e")).select("gene", "transcript", (F.col("e.low") == (F.col("strand") == forward)).alias("five"), F.col("e.at").alias("at"))
    w = W.partitionBy("gene", "five").orderBy("at", "transcript")
    numbered = ends.withColumn("new", (F.col("at") - F.lag("at", 1).over(w) > within).cast("int")).withColumn("k", F.sum(F.coalesce("new", F.lit(0))).over(w))
    clusters = numbered.groupBy("gene", "five", "k").agg(F.min("at").alias("first"), F.max("at").alias("last"), F.collect_set("transcript").alias("include"))
    whole = W.partitionBy("gene", "five")
    several = clusters.withColumns({"c": F.count("*").over(whole), "every": F.flatten(F.collect_list("include").over(whole))}).where("c > 2 or c = 2 and k = 0")
    kind = F.when(F.col("five"), "alt_5p_end").otherwise("alt_3p_end")
    return several.select("gene", kind.alias("type"), "first", "last", "include", F.array_except("every", "include").alias("exclude"))


def splice_graph_events(transcripts: DataFrame, forward: str = "+") -> DataFrame:
    """(seqname, strand, tss, first, last, type, kinds, ids): splicing events of transcripts (transcript_id, seqname, strand, exons) that start at one place.

    Transcripts are grouped by sequence, strand and start; edges that they share make a graph whose unbranched paths are
    compressed, and paths that leave a place together are events, from `first` to `last` in the transcripts' direction, -1
    being their end. On the other strand the last base of the first exon by place counts as the start. Starts are many and
    small: a task takes its starts one after the other, in order, and holds the transcripts of one.
    """
    from ..functions import splice_graph

    schema = StructType.fromDDL("seqname string, strand string, tss bigint, first bigint, last bigint, type string, kinds string, ids array<string>")
    arrow = to_arrow_schema(schema)

    def starts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, dict]]:
        key, own = None, {}
        for batch in batches:
            places, exons = batch.column(4), batch.column(5)
            offsets, first, last = places.offsets.to_pylist(), places.values.to_pylist(), exons.values.to_pylist()
            begin = exons.offsets.to_pylist()
            names = batch.column(0).to_pylist()
            for i, place in enumerate(zip(*(batch.column(c).to_pylist() for c in (1, 2, 3)), strict=True)):
                if place != key:
                    if own:
                        yield key, own
                    key, own = place, {}
                a, b = offsets[i], begin[i]
                n = offsets[i + 1] - a
                own[names[i]] = list(zip(first[a : a + n], last[b : b + n], strict=True))
        if own:
            yield key, own

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for key, own in starts(batches):
            out += [(*key, *event) for event in splice_graph.events(own, key[1] == forward)]
            if len(out) >= 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), arrow.types, strict=True)], schema=arrow)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), arrow.types, strict=True)], schema=arrow)

    tss = F.when(F.col("strand") == forward, F.col("exons")[0]["first"]).otherwise(F.col("exons")[0]["last"])
    rows = transcripts.select(F.col("transcript_id").cast("string").alias("transcript_id"), F.col("seqname").cast("string").alias("seqname"), F.col("strand").cast("string").alias("strand"), tss.cast("long").alias("tss"), F.col("exons.first").alias("firsts"), F.col("exons.last").alias("lasts"))
    return rows.repartition("seqname", "strand", "tss").sortWithinPartitions("seqname", "strand", "tss").mapInArrow(run, schema)
