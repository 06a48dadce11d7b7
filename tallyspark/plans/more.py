"""Further queries of the engine with their DuckDB SQL, registered beside those of catalog; the stand-ins are the same."""

from __future__ import annotations

import functools
import re

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..operators import features, fragments, relations
from . import store
from .catalog import _E, _EXONS, _PMF, brands, exons, expression, gene_rollup, lengths, query, table

_U = "CAST('0x' || substr(md5({key}), 1, 8) AS BIGINT) / 4294967296.0"
_P = f"{_E}, m AS (SELECT sample, p_brand AS feature, sum(x) AS x FROM e JOIN part ON p_partkey = feature GROUP BY ALL), p AS (SELECT sample, feature, x / sum(x) OVER (PARTITION BY sample) AS p FROM m), l AS (SELECT p_brand AS feature, avg(p_size) AS efflen FROM part GROUP BY 1)"


def gene_shares(spark, sf_dir):
    m = gene_rollup(spark, sf_dir).withColumnRenamed("gene", "feature")
    return m.join(m.groupBy("sample").agg(F.sum("x").alias("t")), "sample").select("sample", "feature", (F.col("x") / F.col("t")).alias("p"))


def gene_lengths(spark, sf_dir):
    return table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("feature")).agg(F.avg("p_size").alias("efflen"))


@query(f"""WITH {_PMF} SELECT l_orderkey, l_linenumber, round(CASE WHEN l_returnflag = 'R' THEN 0.8 ELSE 1 - 0.8 END * coalesce(pmf, 0) / p_size, 13) AS prob
FROM lineitem JOIN part ON l_partkey = p_partkey LEFT JOIN d ON l = CAST(l_quantity * 8 AS BIGINT)""")
def fragment_probability(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("feature"), (F.col("l_quantity") * 8).cast("long").alias("length"), "l_returnflag")
    efflens = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("feature"), F.col("p_size").alias("efflen"))
    return fragments.conditional_probability(li, lengths(spark, sf_dir), efflens, F.col("l_returnflag") == "R", 0.8).select("l_orderkey", "l_linenumber", F.round("prob", 13).alias("prob"))


@query("""WITH n AS (SELECT count(*) FILTER (l_returnflag = 'R') AS matches, count(*) FILTER (l_returnflag <> 'R') AS mismatches FROM lineitem), s AS (SELECT *, matches / (matches + mismatches) AS p FROM n)
SELECT matches, mismatches, round(p, 6) AS specificity, round(1 + p * log2(p) + (1 - p) * log2(1 - p), 6) AS negentropy FROM s""")
def strand_specificity(spark, sf_dir):
    s = fragments.strand_specificity(table(spark, sf_dir, "lineitem"), F.col("l_returnflag") == "R")
    return s.select("matches", "mismatches", F.round("specificity", 6).alias("specificity"), F.round("negentropy", 6).alias("negentropy"))


@query(f"WITH {_P} SELECT sample, feature, round(1000000 * p * efflen / sum(p * efflen) OVER (PARTITION BY sample), 4) AS count FROM p JOIN l USING (feature)")
def expected_counts(spark, sf_dir):
    return fragments.expected_counts(gene_shares(spark, sf_dir), gene_lengths(spark, sf_dir), "sample", 1e6).withColumn("count", F.round("count", 4))


@query(f"WITH {_P} SELECT sample, feature, round((x / efflen) / sum(x / efflen) OVER (PARTITION BY sample) + 0.5 / 1e6, 9) AS p FROM m JOIN l USING (feature)")
def counts_to_proportions(spark, sf_dir):
    counts = gene_rollup(spark, sf_dir).select("sample", F.col("gene").alias("feature"), F.col("x").alias("count"))
    return fragments.counts_to_proportions(counts, gene_lengths(spark, sf_dir), "sample", 0.5).withColumn("p", F.round("p", 9))


@query(f"""WITH {_P}, c AS (SELECT sample, feature, sum(p) OVER (PARTITION BY sample ORDER BY feature) / sum(p) OVER (PARTITION BY sample) AS upto FROM p),
d AS (SELECT sample, k, {_U.format(key="'5:' || sample || ':' || k")} AS u FROM (SELECT DISTINCT sample FROM p), range(1, 501) t(k)),
h AS (SELECT d.sample, k, min(feature) AS feature FROM d JOIN c ON d.sample = c.sample AND upto > u GROUP BY ALL) SELECT sample, feature, count(*) AS n FROM h GROUP BY ALL""")
def categorical_counts(spark, sf_dir):
    return fragments.sample_counts(gene_shares(spark, sf_dir), "sample", 500, "5")


@query("""WITH f AS (SELECT l_suppkey AS f, sum(l_quantity) + 1 AS a1, sum(l_discount) + 1 AS b1, sum(l_tax) + 1 AS b2 FROM lineitem GROUP BY 1)
SELECT round(avg(abs(log2(a1 / b1) - log2(a1 / b2))), 6) AS mean_error, round(median(abs(log2(a1 / b1) - log2(a1 / b2))), 6) AS median_error FROM f""")
def log_fold_errors(spark, sf_dir):
    f = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg((F.sum("l_quantity") + 1).alias("a"), (F.sum("l_discount") + 1).alias("b"), (F.sum("l_tax") + 1).alias("c"))
    e = fragments.log_fold_errors(f.select("l_suppkey", "a", "b"), f.select("l_suppkey", "a", F.col("c").alias("b")), "l_suppkey")
    return e.select(F.round("mean_error", 6).alias("mean_error"), F.round("median_error", 6).alias("median_error"))


@query("""WITH d AS (SELECT l_linenumber AS draw, p_brand AS gene, p_size % 3 AS transcript, ln(sum(l_quantity)) AS a, ln(sum(l_extendedprice)) AS b FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL),
x AS (SELECT gene, transcript, log2((exp(a) / sum(exp(a)) OVER w) / (exp(b) / sum(exp(b)) OVER w)) AS x FROM d WINDOW w AS (PARTITION BY draw, gene))
SELECT gene, transcript, round(avg(x), 6) AS mean, round(avg(CASE WHEN abs(x) >= 0.05 THEN 1.0 ELSE 0.0 END), 6) AS prob, round(list_sort(list(abs(x)))[greatest(1, least(CAST(floor((1 - 0.9) * count(*)) AS BIGINT) + 1, count(*)))], 6) AS least FROM x GROUP BY ALL""")
def isoform_effects(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    d = li.groupBy(F.col("l_linenumber").alias("draw"), F.col("p_brand").alias("gene"), (F.col("p_size") % 3).alias("transcript")).agg(F.log(F.sum("l_quantity")).alias("a"), F.log(F.sum("l_extendedprice")).alias("b"))
    return fragments.isoform_effects(d, "gene", "transcript", 0.05, 0.9).select("gene", "transcript", *(F.round(c, 6).alias(c) for c in ("mean", "prob", "least")))


@query("""WITH t AS (SELECT o_custkey AS s, min(o_orderpriority) AS label FROM orders GROUP BY 1), q AS (SELECT o_custkey AS s, o_orderstatus AS draw, o_orderpriority AS label, count(*) / sum(count(*)) OVER (PARTITION BY o_custkey, o_orderstatus) AS p FROM orders GROUP BY 1, 2, 3),
o AS (SELECT t.s, t.label, avg(coalesce(p, 0)) AS p FROM t LEFT JOIN q USING (s, label) GROUP BY ALL) SELECT label, round(avg(p), 6) AS probability, count(*) AS samples FROM o GROUP BY 1""")
def true_label_probability(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    n = o.groupBy("o_custkey", "o_orderstatus", "o_orderpriority").count()
    p = n.select(F.col("o_custkey").alias("s"), F.col("o_orderstatus").alias("draw"), F.col("o_orderpriority").alias("label"), (F.col("count") / F.sum("count").over(W.partitionBy("o_custkey", "o_orderstatus"))).alias("p"))
    truth = o.groupBy(F.col("o_custkey").alias("s")).agg(F.min("o_orderpriority").alias("label"))
    return fragments.true_label_probability(p, truth, "s").withColumn("probability", F.round("probability", 6))


@query(f"WITH {_E}, r AS (SELECT sample, p_brand AS gene, ln(sum(x) FILTER (p_size <= 25)) - ln(sum(x) FILTER (p_size > 25)) AS x FROM e JOIN part ON p_partkey = feature GROUP BY ALL HAVING sum(x) FILTER (p_size <= 25) > 0 AND sum(x) FILTER (p_size > 25) > 0) SELECT gene, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS sd FROM r GROUP BY 1")
def splice_normal(spark, sf_dir):
    sides = brands(spark, sf_dir).withColumn("side", F.when(F.col("small"), "include").otherwise("exclude"))
    n = fragments.normal_by_draws(features.log_ratios(expression(spark, sf_dir), sides, "sample", "feature", "gene"), ["gene"], "log_ratio")
    return n.select("gene", F.round("mean", 6).alias("mean"), F.round("sd", 6).alias("sd"))


@query("SELECT page_id, list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(range(1, 7), lambda i: greatest(instr('ACGT', substr(upper(substr(url, 9, 6)), i, 1)) - 1, 0))), lambda a, c: a * 4 + c) AS code FROM pages WHERE length(url) >= 14")
def context_codes(spark, sf_dir):
    p = table(spark, sf_dir, "pages").where(F.char_length("url") >= 14)
    return p.select("page_id", fragments.context_code(F.upper(F.substring("url", 9, 6))).alias("code"))


@query("""SELECT p_partkey, repeat('N', greatest(0, least(b, 0) - a + 1)) || CASE WHEN b >= 1 THEN substr(p_name, greatest(a, 1), greatest(0, b - greatest(a, 1) + 1)) ELSE '' END || repeat('N', greatest(0, b - greatest(length(p_name), a - 1))) AS padded
FROM (SELECT p_partkey, p_name, CAST(p_size - 25 AS BIGINT) AS a, CAST(p_size - 10 AS BIGINT) AS b FROM part)""")
def padded_substring(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    size = F.col("p_size").cast("int")
    return p.select("p_partkey", fragments.padded(F.col("p_name"), size - 25, size - 10).alias("padded"))


@query("""WITH b AS (SELECT t AS bin, (SELECT count(*) FROM part WHERE p_size = t) AS ratio FROM range(0, 101) r(t)) SELECT event_id, CAST(ratio AS BIGINT) AS ratio FROM (SELECT event_id, greatest(0, least(100, floor(value / 50 * 100 + 0.5))) AS bin FROM events) JOIN b USING (bin)""")
def histogram_lookup(spark, sf_dir):
    sizes = table(spark, sf_dir, "part").groupBy(F.col("p_size").cast("int").alias("bin")).agg(F.count("*").alias("n"))
    bins = spark.range(0, 101).select(F.col("id").cast("int").alias("bin")).join(sizes, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("ratio"))
    e = table(spark, sf_dir, "events").select("event_id", (F.col("value") / 50).alias("x"))
    return fragments.histogram_lookup(bins, e, "x").select("event_id", "ratio")


@query("""WITH k AS (SELECT p_partkey, p_name, unnest(range(1, length(p_name) - 1)) AS pos FROM part WHERE length(p_name) >= 3) SELECT p_partkey, CAST((pos - 1) * 7 // (length(p_name) - 2) AS INTEGER) AS segment, substr(p_name, pos, 3) AS kmer, CAST(max(pos * 7 % 11) AS BIGINT) AS best FROM k GROUP BY ALL""")
def kmer_usage(spark, sf_dir):
    return fragments.kmer_usage(table(spark, sf_dir, "part"), "p_partkey", "p_name", 3, 7, lambda pos: (pos * 7 % 11).cast("long"))


@query("SELECT s_suppkey, regexp_extract(s_name, '^([A-Za-z]+)#', 1) AS factor, CAST(regexp_extract(s_name, '#0*([0-9]+)$', 1) AS BIGINT) AS level, replace(s_name, 'Supplier#', '') AS trimmed, 'seq' || s_nationkey || ':' || least(s_suppkey, 500) || '-' || greatest(s_suppkey, 500) AS locus FROM supplier")
def name_parsing(spark, sf_dir):
    """Factors parsed from sample names, identifiers without their prefix, and loci."""
    s = table(spark, sf_dir, "supplier")
    place = relations.locus(F.concat(F.lit("seq"), F.col("s_nationkey").cast("string")), F.col("s_suppkey"), F.lit(500).cast("long"))
    level = F.nullif(F.regexp_extract("s_name", "#0*([0-9]+)$", 1), F.lit("")).cast("long")
    return s.select("s_suppkey", F.regexp_extract("s_name", "^([A-Za-z]+)#", 1).alias("factor"), level.alias("level"), F.replace("s_name", F.lit("Supplier#"), F.lit("")).alias("trimmed"), place.alias("locus"))


@query(f"WITH {_EXONS}, d AS (SELECT DISTINCT seqname || '|' || strand AS place, first, last FROM x) SELECT a.place, count(*) AS pairs, CAST(sum(least(a.last, b.last) - greatest(a.first, b.first) + 1) AS BIGINT) AS shared FROM d a JOIN d b ON a.place = b.place AND a.first <= b.last AND b.first <= a.last GROUP BY 1")
def exon_self_overlap(spark, sf_dir):
    shared = F.least("o_last", "i_last") - F.greatest("o_first", "i_first") + 1
    return relations.overlapping_exons(exons(spark, sf_dir), 100).groupBy("place").agg(F.count("*").alias("pairs"), F.sum(shared).alias("shared"))


@query(f"WITH {_EXONS}, w AS (SELECT transcript, seqname, strand, list((first, last) ORDER BY first) AS e FROM x GROUP BY ALL), k AS (SELECT *, min(transcript) OVER (PARTITION BY seqname, strand, e) AS kept FROM w) SELECT transcript, kept FROM k WHERE transcript <> kept")
def duplicate_transcripts(spark, sf_dir):
    return relations.duplicate_transcripts(exons(spark, sf_dir))


@query(f"WITH {_EXONS}, s AS (SELECT transcript, seqname, min(first) AS f, max(last) AS l FROM x GROUP BY ALL) SELECT transcript, row_number() OVER (ORDER BY seqname, f, l, transcript) AS id FROM s")
def transcripts_by_position(spark, sf_dir):
    spans = exons(spark, sf_dir).groupBy("transcript", "seqname").agg(F.min("first").alias("f"), F.max("last").alias("l"))
    return relations.dense_ids(spans, ["seqname", "f", "l", "transcript"], "id").select("transcript", F.col("id").cast("long").alias("id"))


@query("SELECT l_orderkey AS read, dense_rank() OVER (ORDER BY l_orderkey) AS id FROM lineitem WHERE l_discount > 0.05 GROUP BY 1")
def compact_read_ids(spark, sf_dir):
    """Reads with entries, here lines of a discount over 0.05, numbered without a gap."""
    return relations.dense_ids(table(spark, sf_dir, "lineitem").where("l_discount > 0.05").select(F.col("l_orderkey").alias("read")), ["read"], "id").select("read", F.col("id").cast("long").alias("id"))


@query("SELECT l_suppkey, l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey) AS at FROM lineitem")
def alignment_blocks(spark, sf_dir):
    """Alignments in order within blocks of one reference, here a supplier: the window finds the rows dealt and sorted."""
    li = relations.in_alignment_order(table(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey"), "l_suppkey", ["l_orderkey", "l_linenumber", "l_partkey"])
    at = F.row_number().over(W.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey"))
    return li.select("l_suppkey", "l_orderkey", "l_linenumber", at.cast("long").alias("at"))


@query(f"WITH {_PMF} SELECT l AS length, round(pmf, 8) AS pmf FROM d ORDER BY d.pmf DESC, l LIMIT 200")
def top_fragment_lengths(spark, sf_dir):
    return lengths(spark, sf_dir).orderBy(F.desc("pmf"), "length").limit(200).select("length", F.round("pmf", 8).alias("pmf"))


@query("WITH r AS (SELECT l_partkey AS feature, l_orderkey AS read, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey) AS k, count(*) OVER (PARTITION BY l_partkey) AS n FROM (SELECT DISTINCT l_partkey, l_orderkey FROM lineitem)) SELECT feature, read AS middle FROM r WHERE k = n // 2 + 1")
def middle_reads(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("feature"), F.col("l_orderkey").alias("read")).distinct()
    return relations.middle_member(rows, "feature", "read")


@query("SELECT p_brand AS gene, count(*) AS transcripts, array_to_string(list_sort(list(DISTINCT p_type)), ';') AS ids FROM part GROUP BY 1")
def gene_sizes(spark, sf_dir):
    """Transcripts by gene, and the joined list of its distinct ids."""
    return table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("gene")).agg(F.count("*").alias("transcripts"), F.array_join(F.array_sort(F.collect_set("p_type")), ";").alias("ids"))


@query("SELECT l_linenumber AS draw, p_brand AS feature, sum(l_quantity) AS x FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2")
def feature_marginals(spark, sf_dir):
    d = table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").alias("draw"), F.col("l_partkey").alias("transcript"), F.col("l_quantity").alias("x"))
    map_ = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("transcript"), F.col("p_brand").alias("feature"))
    return features.roll_up(d, map_, "draw", "transcript", "feature")


@query("SELECT user_id, round(sum(-ln(CASE WHEN event_type = 'click' THEN 1 / (1 + exp(-value / 100)) ELSE 1 - 1 / (1 + exp(-value / 100)) END)) * 2 + 3 * ln(count(*)), 5) AS bic FROM events GROUP BY 1")
def bic_loss(spark, sf_dir):
    p = 1 / (1 + F.exp(-F.col("value") / 100))
    loss = -F.log(F.when(F.col("event_type") == "click", p).otherwise(1 - p))
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.round(F.sum(loss) * 2 + 3 * F.log(F.count("*")), 5).alias("bic"))


@query("SELECT DISTINCT l_partkey AS feature, l_orderkey % 40 AS transcript FROM lineitem WHERE l_returnflag = 'A' UNION SELECT l_partkey, l_orderkey % 40 FROM lineitem WHERE l_returnflag = 'N'")
def including_or_excluding(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("feature"), (F.col("l_orderkey") % 40).alias("transcript"), "l_returnflag")
    return li.where("l_returnflag = 'A'").drop("l_returnflag").union(li.where("l_returnflag = 'N'").drop("l_returnflag")).distinct()


@query("SELECT c_custkey AS sample, c_mktsegment AS factor, 'training' AS part FROM customer WHERE c_custkey % 4 <> 0 AND c_mktsegment IN ('BUILDING', 'MACHINERY') UNION ALL BY NAME SELECT c_custkey AS sample, 'testing' AS part FROM customer WHERE c_custkey % 4 = 0 AND c_mktsegment IN ('BUILDING', 'MACHINERY')")
def append_specs(spark, sf_dir):
    """Samples of wanted factor levels; testing samples, whose factor isn't known, are appended to the training ones."""
    c = table(spark, sf_dir, "customer").where(F.col("c_mktsegment").isin("BUILDING", "MACHINERY")).select(F.col("c_custkey").alias("sample"), F.col("c_mktsegment").alias("factor"))
    training, testing = c.where("sample % 4 <> 0").withColumn("part", F.lit("training")), c.where("sample % 4 = 0").drop("factor").withColumn("part", F.lit("testing"))
    return training.unionByName(testing, allowMissingColumns=True)


@query("WITH f AS (SELECT DISTINCT ps AS feature, p AS member FROM (SELECT l_suppkey AS ps, l_partkey AS p FROM lineitem WHERE l_quantity > 45)), m AS (SELECT p_partkey AS member FROM part WHERE p_partkey NOT IN (SELECT member FROM f)) SELECT feature, member FROM f UNION ALL SELECT (SELECT max(feature) FROM f) + row_number() OVER (ORDER BY member), member FROM m")
def pad_features(spark, sf_dir):
    f = table(spark, sf_dir, "lineitem").where("l_quantity > 45").select(F.col("l_suppkey").alias("feature"), F.col("l_partkey").alias("member")).distinct()
    return relations.pad_features(f, table(spark, sf_dir, "part").select(F.col("p_partkey").alias("member")), "feature", "member")


@query(f"SELECT p_partkey, 1 + CAST(floor({_U.format(key="'11:' || p_partkey")} * greatest(1, p_size * 12 - 99)) AS BIGINT) AS first FROM part")
def background_positions(spark, sf_dir):
    """A random place of a fragment of 100 in each transcript; the same in each run."""
    room = F.greatest(F.lit(1), F.col("p_size") * 12 - 99)
    return table(spark, sf_dir, "part").select("p_partkey", (1 + F.floor(relations.hash_unit("11", F.col("p_partkey")) * room).cast("long")).alias("first"))


@query("WITH s AS (SELECT n_nationkey AS sampler, row_number() OVER (ORDER BY n_nationkey) - 1 AS k, count(*) OVER () AS n FROM nation) SELECT draw, sampler FROM range(0, 1000) t(draw) JOIN s ON draw % n = k")
def round_robin_draws(spark, sf_dir):
    """1,000 draws dealt to samplers in turn, here nations."""
    s = relations.dense_ids(table(spark, sf_dir, "nation"), ["n_nationkey"], "k")
    n = s.count()
    return spark.range(0, 1000).withColumn("k", F.col("id") % n + 1).join(F.broadcast(s), "k").select(F.col("id").alias("draw"), F.col("n_nationkey").alias("sampler"))


@query("WITH p AS (SELECT DISTINCT p_brand, p_partkey FROM part) SELECT dense_rank() OVER (ORDER BY p_brand) AS i, dense_rank() OVER (ORDER BY p_partkey) AS j FROM p")
def gene_transcript_incidence(spark, sf_dir):
    return relations.incidence(table(spark, sf_dir, "part"), "p_brand", "p_partkey").select(F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"))


@query(f"WITH {_EXONS}, t AS (SELECT transcript, seqname || ':' || strand || ':' || CASE WHEN strand = 0 THEN min(first) ELSE max(last) END AS tss FROM x GROUP BY transcript, seqname, strand) SELECT dense_rank() OVER (ORDER BY tss) AS i, dense_rank() OVER (ORDER BY transcript) AS j FROM t")
def tss_incidence(spark, sf_dir):
    """Transcription start sites by transcript, as places of a 0/1 matrix."""
    ends = exons(spark, sf_dir).groupBy("transcript", "seqname", "strand").agg(F.min("first").alias("f"), F.max("last").alias("l"))
    tss = ends.select("transcript", F.concat_ws(":", "seqname", F.col("strand").cast("string"), F.when(F.col("strand") == 0, F.col("f")).otherwise(F.col("l")).cast("string")).alias("tss"))
    return relations.incidence(tss, "tss", "transcript").select(F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"))


@query("SELECT count(*) AS pairs, CAST(sum(o_custkey) AS BIGINT) AS assigned FROM lineitem JOIN orders ON l_orderkey = o_orderkey AND o_orderstatus = 'F'")
def assigned_pairs(spark, sf_dir):
    """Pairs whose read has an assignment; the others are dropped."""
    assigned = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    return table(spark, sf_dir, "lineitem").join(assigned, "l_orderkey").agg(F.count("*").alias("pairs"), F.sum("o_custkey").alias("assigned"))


@query("SELECT (SELECT count(*) FROM lineitem WHERE l_suppkey IN (SELECT c_custkey FROM customer)) AS left_rows, (SELECT count(*) FROM customer WHERE c_custkey IN (SELECT l_suppkey FROM lineitem)) AS right_rows")
def matched_sequences(spark, sf_dir):
    a, b = relations.on_both_sides(table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("k")), table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")), "k")
    return a.agg(F.count("*").alias("left_rows")).crossJoin(b.agg(F.count("*").alias("right_rows")))


_EVENTS = f"""{_EXONS}, s AS (SELECT seqname, strand, before AS fixed, first AS site, min(first) AS lo, max(last) AS hi FROM near WHERE before IS NOT NULL GROUP BY ALL),
ev AS (SELECT 'cassette_exon' AS type, t.seqname, t.strand, t.first, t.last FROM (SELECT DISTINCT seqname, strand, first, last, before + 1 AS intron_first, after - 1 AS intron_last FROM near WHERE before IS NOT NULL AND after IS NOT NULL) t JOIN introns USING (seqname, strand, intron_first, intron_last)
UNION SELECT 'retained_intron', i.seqname, i.strand, intron_first, intron_last FROM introns i JOIN x ON i.seqname = x.seqname AND i.strand = x.strand AND x.first <= intron_first AND intron_last <= x.last)"""


@query(f"WITH {_EVENTS} SELECT type, seqname, strand, first, last, row_number() OVER (ORDER BY CASE type WHEN 'cassette_exon' THEN 1 ELSE 4 END, seqname, strand, first, last) AS feature_num FROM ev")
def splice_numbering(spark, sf_dir):
    return splicing_events(spark, sf_dir).withColumn("feature_num", F.col("feature_num").cast("long"))


def splicing_events(spark, sf_dir):
    x = exons(spark, sf_dir)
    cassette = features.cassette_exons(x).select(F.lit("cassette_exon").alias("type"), "seqname", "strand", "first", "last")
    retained = features.retained_introns(x).select(F.lit("retained_intron").alias("type"), "seqname", "strand", F.col("intron_first").alias("first"), F.col("intron_last").alias("last"))
    return relations.number_events(cassette.union(retained).distinct(), ["seqname", "strand", "first", "last"])


@query(f"""WITH {_EXONS}, s AS (SELECT seqname, strand, before AS fixed, first AS site, min(first) AS lo, max(last) AS hi FROM near WHERE before IS NOT NULL GROUP BY ALL), e AS (SELECT seqname, strand, after AS fixed, last AS site, min(first) AS lo, max(last) AS hi FROM near WHERE after IS NOT NULL GROUP BY ALL),
a AS (SELECT CASE WHEN a.strand = 0 THEN 'alt_acceptor_site' ELSE 'alt_donor_site' END AS type FROM s a JOIN s b ON a.seqname = b.seqname AND a.strand = b.strand AND a.fixed = b.fixed AND abs(a.site - a.fixed) < abs(b.site - b.fixed) AND a.lo <= b.hi AND b.lo <= a.hi
UNION ALL SELECT CASE WHEN a.strand = 0 THEN 'alt_donor_site' ELSE 'alt_acceptor_site' END FROM e a JOIN e b ON a.seqname = b.seqname AND a.strand = b.strand AND a.fixed = b.fixed AND abs(a.site - a.fixed) < abs(b.site - b.fixed) AND a.lo <= b.hi AND b.lo <= a.hi) SELECT type, count(*) AS n FROM a GROUP BY 1""")
def splice_site_types(spark, sf_dir):
    sites = features.alternative_sites(exons(spark, sf_dir))
    return sites.groupBy(relations.site_type(F.col("side"), F.col("strand")).alias("type")).agg(F.count("*").alias("n"))


# The side store's statements, over views that stand for its tables: parts are features, suppliers genes, customers' segments factors.
def side_views(spark, sf_dir):
    """A function that runs a statement with the side store's names standing for the driver's tables; the session keeps its own views."""
    p, li, s = (table(spark, sf_dir, t) for t in ("part", "lineitem", "supplier"))
    kind = F.when(F.col("p_size") % 2 == 0, "cassette_exon").otherwise("retained_intron")
    views = {
        "splicing_features": p.select(F.col("p_partkey").alias("feature_num"), kind.alias("type"), F.col("p_brand").alias("seqname"), F.col("p_size").cast("long").alias("first"), (F.col("p_size") + 100).cast("long").alias("last")),
        "splicing_features_including": li.where("l_returnflag = 'A'").select(F.col("l_partkey").alias("feature_num"), F.col("l_suppkey").alias("transcript_num")).distinct(),
        "splicing_features_excluding": li.where("l_returnflag = 'N'").select(F.col("l_partkey").alias("feature_num"), F.col("l_suppkey").alias("transcript_num")).distinct(),
        "transcripts": s.select(F.col("s_suppkey").alias("transcript_num"), F.col("s_name").alias("transcript_id"), F.col("s_nationkey").alias("gene_num")),
        "splicing_prop_span": li.groupBy(F.col("l_partkey").alias("feature_num")).agg((F.max("l_quantity") - F.min("l_quantity")).alias("span")),
        "effects": li.groupBy(F.col("l_returnflag").alias("factor"), F.col("l_partkey").alias("feature_num")).agg(F.sum("l_quantity").alias("w")),
    }
    for name, df in views.items():
        if unknown := set(df.columns) - set(store.TABLES[name].split(", ")):
            raise ValueError(f"{name} has no column {', '.join(sorted(unknown))}")

    def run(statement: str, **more):
        known = views | more
        used = {n for n in re.findall(r"\b(?:FROM|JOIN) (\w+)", statement) if n in known}
        return spark.sql(re.sub(r"\b(FROM|JOIN) (\w+)", lambda m: f"{m[1]} {{{m[2]}}}" if m[2] in used else m[0], statement), **{n: known[n] for n in used})

    return run


_SIDE = """splicing_features AS (SELECT p_partkey AS feature_num, CASE WHEN p_size % 2 = 0 THEN 'cassette_exon' ELSE 'retained_intron' END AS type, p_brand AS seqname, CAST(p_size AS BIGINT) AS first, CAST(p_size + 100 AS BIGINT) AS last FROM part),
splicing_features_including AS (SELECT DISTINCT l_partkey AS feature_num, l_suppkey AS transcript_num FROM lineitem WHERE l_returnflag = 'A'), splicing_features_excluding AS (SELECT DISTINCT l_partkey AS feature_num, l_suppkey AS transcript_num FROM lineitem WHERE l_returnflag = 'N'),
transcripts AS (SELECT s_suppkey AS transcript_num, s_name AS transcript_id, s_nationkey AS gene_num FROM supplier), splicing_prop_span AS (SELECT l_partkey AS feature_num, max(l_quantity) - min(l_quantity) AS span FROM lineitem GROUP BY 1),
effects AS (SELECT l_returnflag AS factor, l_partkey AS feature_num, sum(l_quantity) AS w FROM lineitem GROUP BY 1, 2)"""
_TOP = "SELECT DISTINCT f.feature_num, span FROM splicing_features f JOIN splicing_prop_span s ON f.feature_num = s.feature_num WHERE type = 'cassette_exon' ORDER BY span DESC, f.feature_num LIMIT 50"
_SCAN = "SELECT feature_num, type, seqname || ':' || first || '-' || last AS locus FROM splicing_features"
_GENES = "SELECT transcript_num, gene_num FROM transcripts"
_MEMBERS = "SELECT f.feature_num, count(DISTINCT i.transcript_num) AS included, count(DISTINCT t.gene_num) AS genes FROM splicing_features f JOIN splicing_features_including i ON f.feature_num = i.feature_num JOIN transcripts t ON i.transcript_num = t.transcript_num GROUP BY f.feature_num"
_SPAN = "SELECT min(span) AS least, max(span) AS most FROM splicing_prop_span"
_BIAS = "SELECT e.factor, e.feature_num, e.w + b.w AS w FROM effects e JOIN top_features t ON e.feature_num = t.feature_num JOIN bias b ON e.feature_num = b.feature_num WHERE e.factor <> 'N'"
_SIDES = "SELECT t.feature_num, e.factor, x.gene_num, sum(e.w) AS w FROM top_features t JOIN splicing_features_excluding i ON t.feature_num = i.feature_num JOIN transcripts x ON i.transcript_num = x.transcript_num JOIN effects e ON e.feature_num = t.feature_num GROUP BY t.feature_num, e.factor, x.gene_num"
_WITH_TOP = f"{_SIDE}, top_features AS ({_TOP}), bias AS (SELECT feature_num, w FROM effects WHERE factor = 'N')"


@query(f"WITH {_SIDE} {_SCAN}")
def store_features(spark, sf_dir):
    return side_views(spark, sf_dir)(_SCAN)


@query(f"WITH {_SIDE} {_GENES}")
def store_transcript_genes(spark, sf_dir):
    return side_views(spark, sf_dir)(_GENES)


@query(f"WITH {_SIDE} {_MEMBERS}")
def store_including(spark, sf_dir):
    return side_views(spark, sf_dir)(_MEMBERS)


@query(f"WITH {_SIDE} {_SPAN}")
def store_span_range(spark, sf_dir):
    return side_views(spark, sf_dir)(_SPAN)


def top_views(spark, sf_dir):
    sql = side_views(spark, sf_dir)
    return functools.partial(sql, top_features=sql(_TOP), bias=sql("SELECT feature_num, w FROM effects WHERE factor = 'N'"))


@query(f"WITH {_WITH_TOP} SELECT feature_num, span FROM top_features")
def store_top_features(spark, sf_dir):
    return top_views(spark, sf_dir)("SELECT feature_num, span FROM top_features")


@query(f"WITH {_WITH_TOP} {_BIAS}")
def store_effects_less_bias(spark, sf_dir):
    return top_views(spark, sf_dir)(_BIAS)


@query(f"WITH {_WITH_TOP} SELECT f.feature_num, f.type, f.seqname, f.first, f.last, t.span FROM splicing_features f JOIN top_features t ON f.feature_num = t.feature_num")
def store_top_rows(spark, sf_dir):
    return top_views(spark, sf_dir)("SELECT f.*, t.span FROM splicing_features f JOIN top_features t ON f.feature_num = t.feature_num")


@query(f"WITH {_WITH_TOP} {_SIDES}")
def store_transcript_sides(spark, sf_dir):
    return top_views(spark, sf_dir)(_SIDES)
