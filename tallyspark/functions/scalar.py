"""Column functions: exons, sequences, attributes, and transforms of compositions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def exonic_length(exons: Column) -> Column:
    """Summed length of an array of (first, last)."""
    return F.aggregate(exons, F.lit(0).cast("long"), lambda n, e: n + e["last"] - e["first"] + 1)


def introns(exons: Column) -> Column:
    """The gaps between sorted exons, as an array of (first, last)."""
    places = F.filter(F.sequence(F.lit(1), F.size(exons)), lambda i: i < F.size(exons))
    return F.transform(places, lambda i: F.struct((F.get(exons, i - 1)["last"] + 1).alias("first"), (F.get(exons, i)["first"] - 1).alias("last")))


def transcript_position(position: Column, exons: Column, strand: Column) -> Column:
    """1-based place of a genomic position in a transcript, counted from its end on the minus strand; 0 outside its exons."""
    inside = F.exists(exons, lambda e: (e["first"] <= position) & (position <= e["last"]))
    before = F.aggregate(exons, F.lit(0).cast("long"), lambda n, e: n + F.greatest(F.lit(0), F.least(e["last"], position) - e["first"] + 1))
    return F.when(~inside, 0).when(strand < 0, exonic_length(exons) - before + 1).otherwise(before)


def reverse_complement(sequence: Column) -> Column:
    return F.reverse(F.translate(sequence, "ACGT", "TGCA"))


def gc_count(sequence: Column) -> Column:
    return (F.char_length(sequence) - F.char_length(F.translate(sequence, "GC", ""))).cast("long")


def quarter_counts(df: DataFrame, key: str, text: str, letters: str) -> DataFrame:
    """(key, q, hits): how many characters of a sequence are among letters (in lower case), in each of its four quarters."""
    chars = df.select(key, F.char_length(text).alias("t"), F.posexplode(F.split(F.col(text), "(?s)(?<=.)(?=.)")).alias("i", "c"))
    hits = F.sum(F.lower("c").isin(*letters).cast("long"))
    return chars.groupBy(key, F.floor(F.col("i") * 4 / F.col("t")).cast("int").alias("q")).agg(hits.alias("hits"))


def markov_counts(pairs: DataFrame, context: str, following: str) -> DataFrame:
    """(context, following, n, p): counts of all combinations with a pseudocount of one, and their share in the context."""
    counts = pairs.groupBy(context, following).agg(F.count("*").alias("n"))
    contexts, symbols = pairs.select(context).distinct(), pairs.select(following).distinct()
    grid = contexts.crossJoin(F.broadcast(symbols))  # an alphabet on each side
    rows = grid.join(counts, [context, following], "left").select(context, following, (F.coalesce("n", F.lit(0)) + 1).alias("n"))
    return rows.withColumn("p", F.col("n") / F.sum("n").over(W.partitionBy(context)))


def attributes(column: Column) -> Column:
    """key=value;key=value as a map; the last of a repeated key counts."""
    pairs = F.filter(F.split(column, ";"), lambda x: F.contains(x, F.lit("=")))
    keys = F.transform(pairs, lambda x: F.trim(F.substring_index(x, "=", 1)))
    last = F.filter(F.sequence(F.lit(0), F.size(pairs)), lambda i: (i < F.size(pairs)) & ~F.array_contains(F.slice(keys, i + 2, F.size(pairs)), F.get(keys, i)))
    return F.map_from_entries(F.transform(last, lambda i: F.struct(F.get(keys, i), F.regexp_replace(F.get(pairs, i), "^[^=]*=", ""))))


def first_value(attrs: Column, key: str) -> Column:
    """The first of a key's comma-separated values, or ""."""
    return F.coalesce(F.get(F.split(attrs[key], ","), F.lit(0)), F.lit(""))


def genes_by_pattern(df: DataFrame, key: str, name: str, pattern: str) -> DataFrame:
    """(key, gene): what the pattern's first group, or all of it, finds in a name; others get unknown-gene-<n>, numbered by key."""
    from ..operators.relations import dense_ids

    group = 1 if "(" in pattern else 0
    found = df.select(key, F.regexp_extract(name, pattern, group).alias("gene"))
    numbers = dense_ids(found.where("gene = ''"), [key], "n")
    return found.where("gene <> ''").unionByName(numbers.select(key, F.concat(F.lit("unknown-gene-"), "n").alias("gene")))


def logistic(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def sinh_asinh(z: Column, skew: Column) -> Column:
    return F.sinh(skew + F.asinh(z))


def additive_log_ratios(parts: DataFrame, sample: str, part: str, value: str) -> DataFrame:
    """(sample, part, alr): log of each part over the last one by name."""
    last = parts.agg(F.max(part).alias(part))
    reference = parts.join(F.broadcast(last), part, "left_semi").select(sample, F.col(part).alias("_last"), F.col(value).alias("_ref"))
    return parts.join(reference, sample).where(F.col(part) != F.col("_last")).select(sample, part, F.log(F.col(value) / F.col("_ref")).alias("alr"))


def aitchison_distances(parts: DataFrame, sample: str, part: str, value: str) -> DataFrame:
    """(u, v, distance) of all pairs of samples, which are few: root mean square difference of centred log ratios."""
    centred = parts.select(sample, part, (F.log(value) - F.avg(F.log(value)).over(W.partitionBy(sample))).alias("c"))
    a, b = centred.select(F.col(sample).alias("u"), part, F.col("c").alias("x")), centred.select(F.col(sample).alias("v"), part, F.col("c").alias("y"))
    return a.join(b, part).where("u < v").groupBy("u", "v").agg(F.sqrt(F.avg(F.pow(F.col("x") - F.col("y"), 2))).alias("distance"))
