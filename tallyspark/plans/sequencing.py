"""Queries over alignment files that Spark derives from the tables, with their DuckDB SQL."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import bias as kernel
from ..functions import scalar
from ..operators import bias, features, prepare
from ..sources import readers
from ..sources.bam import BamSource
from .catalog import _EXONS, exons, query, table
from .scratch import scratch_root


def lineitem_alignments(spark, sf_dir):
    """Lines as alignments: orders are reads, suppliers sequences, days places; a line is cut by a gap of 100 days after its quantity."""
    op = lambda o, n: F.struct(F.lit(o).alias("op"), n.cast("int").alias("len"))
    cigar = F.array(op("S", F.col("l_linenumber")), op("M", F.col("l_quantity")), op("N", F.lit(100)), op("M", F.col("l_partkey") % 90 + 1))
    flag = F.when(F.col("l_returnflag") == "R", 83).when(F.col("l_linestatus") == "O", 4).otherwise(163)
    return table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("order"), "l_orderkey", F.lit("/"), F.col("l_linenumber") % 10).alias("read_name"), flag.cast("int").alias("flag"), F.concat(F.lit("s"), "l_suppkey").alias("seqname"),
        (F.datediff("l_shipdate", F.lit("1992-01-01")) + 1).cast("long").alias("pos"), F.lit(60).alias("mapq"), cigar.alias("cigar"),
        F.concat(F.lit("s"), "l_suppkey").alias("mate_seqname"), F.lit(1).cast("long").alias("mate_pos"), F.lit(0).cast("long").alias("template"),
    )


@query("""WITH a AS (SELECT DISTINCT 'order' || l_orderkey AS read_name, 's' || l_suppkey AS seqname, date_diff('day', DATE '1992-01-01', CAST(l_shipdate AS DATE)) + 1 - l_linenumber AS "left",
  date_diff('day', DATE '1992-01-01', CAST(l_shipdate AS DATE)) + CAST(l_quantity AS INT) + 100 + l_partkey % 90 + 1 AS "right", CASE WHEN l_returnflag = 'R' THEN 83 ELSE 163 END AS flag,
  [l_linenumber, CAST(l_quantity AS INT), 100, l_partkey % 90 + 1] AS cigar FROM lineitem WHERE (l_returnflag = 'R' OR l_linestatus <> 'O') AND l_suppkey % 10 <> 0)
SELECT seqname, flag, count(*) AS n, CAST(sum("left") AS BIGINT) AS sum_left, CAST(sum("right") AS BIGINT) AS sum_right, count(DISTINCT read_name) AS reads FROM a GROUP BY ALL""")
def bam_alignments(spark, sf_dir):
    """Lines are written as BAM files, one a task, and read back in small splits, without the sequences that are left out."""
    spark.dataSource.register(BamSource)
    suppliers = table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("seqname"))
    sequences = ",".join(f"{r.seqname}:1000000" for r in suppliers.collect())  # a header lists all sequences
    folder = f"{scratch_root(spark)}/tables/bam-{uuid.uuid4().hex}"
    lineitem_alignments(spark, sf_dir).write.format("bam").option("sequences", sequences).mode("append").save(folder)
    read = readers.bam(spark, folder, suppliers.where("seqname LIKE '%0'"), strip_mate=True, split_bytes=1 << 20)
    return read.groupBy("seqname", "flag").agg(F.count("*").alias("n"), F.sum("left").alias("sum_left"), F.sum("right").alias("sum_right"), F.countDistinct("read_name").alias("reads"))


def small_genes(spark, sf_dir):
    """(transcript_id, seqname, strand, first, last, exons, exonic_length): 20 neighbouring orders share a sequence, whose exons are those of the splicing queries."""
    x = exons(spark, sf_dir).withColumns({"seqname": F.floor(F.col("transcript") / 20).cast("string"), "strand": F.when(F.col("strand") == 1, "-").otherwise("+")})
    whole = x.groupBy(F.col("transcript").alias("transcript_id"), "seqname", "strand").agg(F.array_sort(F.collect_list(F.struct("first", "last"))).alias("exons"))
    return whole.select("*", F.col("exons")[0]["first"].alias("first"), F.element_at("exons", -1)["last"].alias("last"), scalar.exonic_length(F.col("exons")).alias("exonic_length"))


def neighbour_pairs(spark, sf_dir):
    """Alignments of 20 bases at the ends of neighbouring exons, as mates; they may overhang."""
    x = exons(spark, sf_dir).withColumn("seqname", F.floor(F.col("transcript") / 20).cast("string"))
    ends = x.withColumn("l2", F.lead("last").over(W.partitionBy("transcript").orderBy("first"))).where("l2 IS NOT NULL")
    cigar = F.array(F.struct(F.lit("M").alias("op"), F.lit(20).alias("len")))
    name = F.concat_ws(":", "transcript", "first")
    reverse = (F.col("transcript") + F.col("first")) % 3 == 0
    mate = lambda left, flag: F.struct(left.cast("long").alias("left"), (left + 19).cast("long").alias("right"), flag.cast("int").alias("flag"))
    mates = F.array(mate(F.col("first") + F.col("first") % 45 - 3, F.when(reverse, 83).otherwise(99)), mate(F.col("l2") + F.col("first") % 7 - 22, F.when(reverse, 163).otherwise(147)))
    return ends.select(name.alias("read_name"), "seqname", F.explode(mates).alias("m"), cigar.alias("cigar")).select("read_name", "seqname", "m.*", "cigar")


@query(f"""WITH {_EXONS}, g AS (SELECT transcript, CAST(transcript // 20 AS VARCHAR) AS seq, CASE WHEN strand = 1 THEN '-' ELSE '+' END AS strand, first, last, before, after, lead(last) OVER (PARTITION BY transcript ORDER BY first) AS l2 FROM near),
t AS (SELECT transcript, seq, any_value(strand) AS strand, min(first) AS t_first, max(last) AS t_last, sum(last - first + 1) AS t_length FROM g GROUP BY ALL),
m AS (SELECT transcript || ':' || first AS read, seq, (transcript + first) % 3 = 0 AS reverse, first + first % 45 - 3 AS af, first + first % 45 + 16 AS al, l2 + first % 7 - 22 AS bf, l2 + first % 7 - 3 AS bl FROM g WHERE l2 IS NOT NULL),
c AS (SELECT read, t.transcript, t_length, reverse = (t.strand = '-') AS match, least(af, bf) AS lo, greatest(al, bl) AS hi,
  bool_or(af >= first - 2 AND (af >= first OR af > before) AND af <= last AND al <= last + 2) AND bool_or(bf >= first - 2 AND (bf >= first OR bf > before) AND bf <= last AND bl <= last + 2) AS ok,
  coalesce(sum(after - 1 - last) FILTER (last + 1 > least(af, bf) AND after - 1 < greatest(al, bl)), 0) AS gaps
  FROM m JOIN t ON m.seq = t.seq AND t_first <= least(af, bf) AND greatest(al, bl) <= t_last JOIN g ON g.transcript = t.transcript GROUP BY ALL),
f AS (SELECT read, transcript, t_length, match, CAST(hi - lo + 1 - gaps AS BIGINT) AS length FROM c WHERE ok AND hi - lo + 1 - gaps > 0),
s AS (SELECT count(*) FILTER (match) / count(*) AS p FROM f),
h AS (SELECT length, count(*) AS n FROM (SELECT read, min(length) AS length FROM f GROUP BY 1) WHERE length <= 2000 GROUP BY 1),
z AS (SELECT l.length, coalesce(n, 0) AS n, exp(-0.5 * ((l.length - 150) / 50.0) ** 2) AS normal FROM (SELECT unnest(range(1, 2001)) AS length) l LEFT JOIN h USING (length)),
d AS (SELECT length, CASE WHEN (SELECT sum(n) FROM z) >= 1000 THEN (n + 1) / ((SELECT sum(n) FROM z) + 2000) ELSE normal / (SELECT sum(normal) FROM z) END AS pmf FROM z),
e AS (SELECT t_length, greatest(1, sum(pmf * (t_length - length + 1))) AS efflen FROM (SELECT DISTINCT t_length FROM t) JOIN d ON length <= t_length GROUP BY 1),
probs AS (SELECT read, transcript, CASE WHEN match THEN p ELSE 1 - p END * coalesce(pmf, 0) / efflen AS prob FROM f JOIN e USING (t_length) LEFT JOIN d USING (length), s)
SELECT transcript AS feature, count(*) AS reads, round(sum(prob), 10) AS prob FROM probs WHERE prob > 1e-12 GROUP BY 1""")
def sample_likelihood(spark, sf_dir):
    """Likelihood of a sample from alignments and transcripts, summed by transcript."""
    made = prepare.sample_likelihood(small_genes(spark, sf_dir), neighbour_pairs(spark, sf_dir), width=1000)
    return made.likelihood.groupBy("feature").agg(F.count("*").alias("reads"), F.round(F.sum("prob"), 10).alias("prob"))


def line_examples(spark, sf_dir):
    """(y, seq): seven letters of a line's numbers; y tells returned lines, and large ones of odd parts."""
    letter = lambda c: F.substring(F.lit("ACGT"), (c % 4 + 1).cast("int"), F.lit(1))
    parts = [F.floor(F.col("l_quantity") / 13), F.col("l_partkey"), F.col("l_linenumber"), F.col("l_suppkey"), F.floor(F.col("l_discount") * 100), F.floor(F.col("l_tax") * 100), F.col("l_orderkey")]
    y = (F.col("l_returnflag") == "R") | ((F.col("l_quantity") > 30) & (F.col("l_partkey") % 2 == 1))
    return table(spark, sf_dir, "lineitem").select(y.alias("y"), F.concat(*map(letter, parts)).alias("seq"))


@query()
def sequence_bias(spark, sf_dir):
    """(place, order, cell, log_ratio) of the sequence model that tells lines' examples."""
    model = bias.fit_sequence_bias(line_examples(spark, sf_dir))
    rows = [(j, o, c, float(v)) for j, (o, t) in enumerate(zip(model.orders, model.tables, strict=True)) for c, v in enumerate(t)]  # the model, whose size does not follow the rows
    return spark.createDataFrame(rows, "place int, order int, cell int, log_ratio double").withColumn("log_ratio", F.round("log_ratio", 9))


@query("""WITH t AS (SELECT DISTINCT p_name || ' ' || p_brand AS seq FROM part), k AS (SELECT unnest(range(1, 21)) AS k),
a AS (SELECT seq, k, unnest(range(1, length(seq) - k + 2)) AS a FROM t, k WHERE k <= length(seq)),
s AS (SELECT seq, k, CASE lower(substr(seq, a, 1)) WHEN 'c' THEN 2.0 WHEN 'g' THEN 0.5 WHEN 't' THEN 3.0 ELSE 1.0 END AS w,
  (length(substr(seq, a, k)) - length(translate(upper(substr(seq, a, k)), 'GC', ''))) / k AS gc FROM a)
SELECT seq AS feature, round(greatest(1, sum(k / 210.0 * w * (0.5 + least(100, floor(gc * 100 + 0.5)) / 100))), 6) AS efflen FROM s GROUP BY 1""")
def biased_effective_length(spark, sf_dir):
    """Effective lengths of parts' names under a bias of the first letter and of the share of G and C; the lengths 1 to 20 have shares in proportion to them."""
    none = [-1] * kernel.WIDTH
    first = kernel.SequenceBias([0 if j == kernel.OUTER else -1 for j in range(kernel.WIDTH)], [np.log([1.0, 2.0, 0.5, 3.0]) if j == kernel.OUTER else np.zeros(0) for j in range(kernel.WIDTH)])
    model = kernel.FragmentBias(first, kernel.SequenceBias(none, [np.zeros(0)] * kernel.WIDTH), 0.5 + np.arange(101) / 100)
    names = table(spark, sf_dir, "part").select(F.concat_ws(" ", "p_name", "p_brand").alias("seq")).distinct()
    lengths = spark.range(1, 21).select(F.col("id").alias("length"), (F.col("id") / 210).alias("pmf"))
    out = bias.biased_lengths(names.select(F.col("seq").alias("feature"), "seq"), model, lengths)
    return out.select("feature", F.round("efflen", 6).alias("efflen"))


@query()
def splice_graph_events(spark, sf_dir):
    """Events of the splice graph among neighbouring orders that start at one place."""
    found = features.splice_graph_events(small_genes(spark, sf_dir).withColumn("seqname", F.floor(F.col("transcript_id") / 2000).cast("string")))
    return found.withColumn("ids", F.array_join("ids", ","))
