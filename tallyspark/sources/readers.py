"""Readers of annotation, sequence, alignment and equivalence-class files into DataFrames with fixed schemas."""

from __future__ import annotations

import io
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalar import attributes, first_value, reverse_complement
from ..plans.scratch import materialize
from .bam import BamSource, files_of, store_of

GFF3 = "seqid string, source string, type string, start bigint, end bigint, score string, strand string, phase string, attributes string"
SAM = "read_name string, flag int, seqname string, pos bigint, mapq int, cigar string, mate_seqname string, mate_pos bigint, template bigint, seq string, qual string"


def gff3_rows(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.csv(path, sep="\t", comment="#", schema=GFF3, quote="")
    return rows.withColumn("attrs", attributes(F.col("attributes"))).drop("attributes")


def transcripts(rows: DataFrame, excluded: DataFrame | None = None) -> DataFrame:
    """(transcript_id, seqname, strand, first, last, exons, exonic_length, kind, biotype, gene_id) from gff3_rows: exons are grouped by their parent."""
    exons = rows.where("type = 'exon'").select(F.explode(F.split(F.col("attrs")["Parent"], ",")).alias("transcript_id"), "seqid", "strand", F.struct(F.col("start").alias("first"), F.col("end").alias("last")).alias("exon"))
    if excluded is not None:
        exons = exons.join(excluded, "transcript_id", "left_anti")
    grouped = exons.groupBy("transcript_id", F.col("seqid").alias("seqname"), "strand").agg(F.array_sort(F.collect_list("exon")).alias("exons"))
    meta = rows.where("type NOT IN ('exon', 'gene', 'CDS')").select(
        first_value(F.col("attrs"), "ID").alias("transcript_id"), F.col("type").alias("kind"), first_value(F.col("attrs"), "biotype").alias("biotype"), F.coalesce(F.nullif(first_value(F.col("attrs"), "Parent"), F.lit("")), first_value(F.col("attrs"), "geneID")).alias("gene_id")
    )
    length = F.aggregate("exons", F.lit(0).cast("long"), lambda n, e: n + e["last"] - e["first"] + 1)
    spans = grouped.select("*", F.element_at("exons", 1)["first"].alias("first"), F.array_max(F.transform("exons", lambda e: e["last"])).alias("last"), length.alias("exonic_length"))
    return spans.join(meta.where("transcript_id <> ''"), "transcript_id", "left").fillna("", ["kind", "biotype", "gene_id"])


def genes(rows: DataFrame) -> DataFrame:
    a = F.col("attrs")
    return rows.where("type = 'gene'").select(*(first_value(a, k).alias(n) for k, n in (("ID", "gene_id"), ("Name", "gene_name"), ("biotype", "gene_biotype"), ("description", "gene_description"))))


def fasta(spark: SparkSession, path: str) -> DataFrame:
    """(name, sequence) of each record: files are split at a ">" that begins a line, so a record is one row and no task holds a file."""
    rows = spark.read.option("lineSep", "\n>").text(path).where("trim(value) <> ''").withColumn("value", F.regexp_replace("value", "^>", ""))
    head = F.substring_index("value", "\n", 1)
    body = F.regexp_replace(F.substring(F.col("value"), F.char_length(head) + 2, F.char_length("value")), r"\s", "")
    return rows.select(F.regexp_extract(head, r"^(\S*)", 1).alias("name"), F.upper(body).alias("sequence"))


def spliced(transcript_rows: DataFrame, genome: DataFrame) -> DataFrame:
    """transcripts with seq: exons' bases joined, reverse-complemented on the minus strand; exons past the sequence's end are left out."""
    joined = transcript_rows.join(genome.withColumnRenamed("name", "seqname"), "seqname", "left")
    inside = F.filter("exons", lambda e: e["last"] <= F.char_length("sequence"))
    bases = F.array_join(F.transform(inside, lambda e: F.substring(F.col("sequence"), e["first"].cast("int"), (e["last"] - e["first"] + 1).cast("int"))), "")
    return joined.withColumn("seq", F.when(F.col("strand") == "-", F.reverse(F.translate(bases, "ACGT", "TGCA"))).otherwise(bases)).drop("sequence")


def _ranges(spark: SparkSession, path: str, split_bytes: int) -> DataFrame:
    """(number, path, start, end): a file, or a folder's, in ranges of bytes, a task each."""
    rows = [(p, a, min(n, a + split_bytes)) for p, n in files_of(path, "") for a in range(0, n, split_bytes)]
    numbered = [(i, *r) for i, r in enumerate(rows)]
    return spark.createDataFrame(numbered, "number int, path string, start bigint, end bigint").repartition(max(1, len(rows)), "number")


def _lines(file, start: int, end: int) -> Iterator[bytes]:
    """Lines that begin in a range of bytes."""
    at = start
    if start:
        file.seek(start - 1)
        at = start - 1 + len(file.readline())
    file.seek(at)
    while at < end and (line := file.readline()):
        yield line
        at += len(line)


def genome_blocks(spark: SparkSession, path: str, size: int = 1 << 16, split_bytes: int = 32 << 20) -> DataFrame:
    """(name, block, bases) of FASTA records: base i of a sequence, from 0, is in block i div size; no row holds more than a block.

    Ranges of bytes are read by themselves. A first pass finds how many bases each range has after its last header, and
    before its first, from which a range knows where in which sequence it begins.
    """
    ranges, store_path = _ranges(spark, path, split_bytes), path

    def opened(inner: str):
        return io.BufferedReader(store_of(store_path)[0].open_input_file(inner))

    def measure(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples():
                name, before, after = None, 0, 0
                with opened(row.path) as file:
                    for line in _lines(file, row.start, row.end):
                        if line.startswith(b">"):
                            name, after = (line[1:].split() or [b""])[0].decode(), 0
                        elif name is None:
                            before += len(line.strip())
                        else:
                            after += len(line.strip())
                yield pd.DataFrame([{"number": row.number, "path": row.path, "name": name, "before": before, "after": after}])

    found = sorted(ranges.mapInPandas(measure, "number int, path string, name string, before bigint, after bigint").collect())  # a row for each range
    began: dict[int, tuple[str, int]] = {}
    name, offset, last = "", 0, None
    for r in found:
        if r.path != last:
            name, offset, last = "", 0, r.path
        began[r.number] = (name, offset)
        name, offset = (name, offset + r.before) if r.name is None else (r.name, r.after)

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples():
                name, at = began[row.number]
                held: list[bytes] = []
                first = at
                with opened(row.path) as file:
                    for line in _lines(file, row.start, row.end):
                        header = line.startswith(b">")
                        bases = b"" if header else line.strip()
                        while bases:
                            piece, bases = bases[: size - at % size], bases[size - at % size :]
                            held.append(piece)
                            at += len(piece)
                            if at % size == 0:
                                yield pd.DataFrame([{"name": name, "block": (at - 1) // size, "at": first, "bases": b"".join(held).decode("ascii").upper()}])
                                held, first = [], at
                        if header:
                            if held:
                                yield pd.DataFrame([{"name": name, "block": (at - 1) // size, "at": first, "bases": b"".join(held).decode("ascii").upper()}])
                            name, at, first, held = (line[1:].split() or [b""])[0].decode(), 0, 0, []
                if held:
                    yield pd.DataFrame([{"name": name, "block": (at - 1) // size, "at": first, "bases": b"".join(held).decode("ascii").upper()}])

    pieces = ranges.mapInPandas(cut, "name string, block bigint, at bigint, bases string")
    return pieces.groupBy("name", "block").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "bases"))), lambda p: p["bases"]), "").alias("bases"))


def spliced_from_blocks(transcript_rows: DataFrame, blocks: DataFrame, size: int = 1 << 16) -> DataFrame:
    """spliced() from genome_blocks: exons meet the blocks that they touch, and their pieces are put together in order."""
    blocks = materialize(blocks, "genome")
    ends = blocks.groupBy("name").agg(F.max(F.col("block") * size + F.char_length("bases")).alias("_end"))
    exons = transcript_rows.select("transcript_id", "seqname", F.explode("exons").alias("e")).join(ends.withColumnRenamed("name", "seqname"), "seqname").where("e.last <= _end")
    touched = exons.select("transcript_id", "seqname", "e.first", "e.last", F.explode(F.sequence(F.floor((F.col("e.first") - 1) / size), F.floor((F.col("e.last") - 1) / size))).alias("block"))
    met = touched.join(blocks.withColumnRenamed("name", "seqname"), ["seqname", "block"])
    start = F.col("block") * size
    begin = F.greatest(F.col("first") - 1 - start, F.lit(0))
    piece = F.substring(F.col("bases"), (begin + 1).cast("int"), (F.least(F.col("last") - start, F.lit(size)) - begin).cast("int"))
    pieces = met.groupBy("transcript_id").agg(F.array_sort(F.collect_list(F.struct("first", "block", piece.alias("piece")))).alias("pieces"))
    bases = F.coalesce(F.array_join(F.transform("pieces", lambda p: p["piece"]), ""), F.lit(""))
    joined = transcript_rows.join(pieces, "transcript_id", "left").withColumn("_bases", bases)
    return joined.withColumn("seq", F.when(F.col("strand") == "-", reverse_complement(F.col("_bases"))).otherwise(F.col("_bases"))).drop("pieces", "_bases")


def cigar_ops(cigar: Column) -> Column:
    """A text CIGAR as an array of (op, len)."""
    return F.transform(F.regexp_extract_all(cigar, F.lit(r"\d+[MIDNSHP=X]"), F.lit(0)), lambda x: F.struct(F.right(x, F.lit(1)).alias("op"), F.substring(x, F.lit(1), F.char_length(x) - 1).cast("int").alias("len")))


def alignments(rows: DataFrame, excluded: DataFrame | None = None, strip_mate: bool = False) -> DataFrame:
    """(read_name, seqname, left, right, flag, cigar) of mapped alignments, each once; left counts all operations before the first match, as right does the last base.

    rows are (read_name, flag, seqname, pos, cigar as (op, len) pairs); excluded lists sequences to leave out.
    """
    rows = rows.where("(flag & 4) = 0 AND seqname <> '*'")
    if excluded is not None:
        rows = rows.join(F.broadcast(excluded) if excluded.limit(100_001).count() <= 100_000 else excluded, "seqname", "left_anti")
    ops = F.col("cigar")
    matched = F.array_position(F.transform(ops, lambda o: o["op"].isin("M", "=", "X")), True)
    before = F.when(matched > 0, matched - 1).otherwise(0).cast("int")
    lead = F.aggregate(F.slice(ops, F.lit(1), before), F.lit(0).cast("long"), lambda n, o: n + o["len"])
    span = F.aggregate(F.slice(ops, before + 1, F.size(ops)), F.lit(0).cast("long"), lambda n, o: n + F.when(o["op"].isin("M", "D", "N", "S", "=", "X"), o["len"]).otherwise(0))
    name = F.regexp_replace("read_name", r"/\d$", "") if strip_mate else F.col("read_name")
    return rows.select(name.alias("read_name"), "seqname", (F.col("pos") - lead).alias("left"), (F.col("pos") + span - 1).alias("right"), "flag", "cigar").distinct()


def sam(spark: SparkSession, path: str, excluded: DataFrame | None = None, strip_mate: bool = False) -> DataFrame:
    """alignments() of SAM text."""
    rows = spark.read.csv(path, sep="\t", comment="@", schema=SAM, quote="")
    return alignments(rows.withColumn("cigar", cigar_ops(F.col("cigar"))), excluded, strip_mate)


def bam(spark: SparkSession, path: str, excluded: DataFrame | None = None, strip_mate: bool = False, split_bytes: int = 64 << 20) -> DataFrame:
    """alignments() of a BAM file, or of those of a folder, read in splits; a file that is cut off ends with its last whole record."""
    spark.dataSource.register(BamSource)
    rows = spark.read.format("bam").option("splitBytes", split_bytes).load(path)
    return alignments(rows, excluded, strip_mate)


def equivalence_classes(spark: SparkSession, path: str) -> DataFrame:
    """(class_id, features, probs, count) of an eq_classes text file: numbers of names and classes, the names, then k, ids, probabilities, count.

    Lines are told apart by their shape, as a class has tabs, so a file is read in any splits (in one, if it is compressed);
    names and classes are numbered by their place in it.
    """
    from ..operators.relations import dense_ids

    lines = materialize(spark.read.text(path).select("value", F.input_file_block_start().alias("at"), F.monotonically_increasing_id().alias("row")).where("value <> ''"), "eq-lines")
    numbered = lambda df: df.join(dense_ids(df, ["at", "row"], "i"), ["at", "row"])
    names = numbered(lines.where("NOT contains(value, '\t')")).select((F.col("i") - 3).alias("id"), F.col("value").alias("feature")).where("id >= 0")
    cells = numbered(lines.where("contains(value, '\t')")).select((F.col("i") - 1).alias("class_id"), F.split(F.trim("value"), r"\s+").alias("c")).withColumn("k", F.get("c", F.lit(0)).cast("int"))
    checked = cells.withColumn("ok", F.assert_true(F.size("c") == 2 * F.col("k") + 2, F.lit("class without probabilities")))
    pairs = F.arrays_zip(F.slice("c", F.lit(2), F.col("k")).alias("id"), F.slice("c", F.col("k") + 2, F.col("k")).alias("prob"))
    flat = checked.where("ok IS NULL").select("class_id", F.element_at("c", -1).cast("long").alias("count"), F.posexplode(pairs).alias("place", "p"))
    named = flat.select("class_id", "count", "place", F.col("p.id").cast("long").alias("id"), F.col("p.prob").cast("double").alias("prob")).join(names, "id", "left")
    rows = named.groupBy("class_id").agg(F.array_sort(F.collect_list(F.struct("place", "feature", "prob"))).alias("row"), F.first("count").alias("count"))
    return rows.select("class_id", F.transform("row", lambda r: r["feature"]).alias("features"), F.transform("row", lambda r: r["prob"]).alias("probs"), "count")


def quantified_sample(spark: SparkSession, classes_path: str, lengths_path: str, features: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((features, probs, count), (feature, efflen)) of a quantifier's classes and its table of names and effective lengths.

    The table's first column is the name, the third the effective length. Its names must be those of features (feature),
    no more and no fewer.
    """
    rows = spark.read.csv(lengths_path, sep="\t", header=True)
    name, _, length, *_ = rows.columns
    efflens = materialize(rows.select(F.col(f"`{name}`").alias("feature"), F.col(f"`{length}`").cast("double").alias("efflen")), "efflens")
    own = features.select(F.col("feature").cast("string").alias("feature")).distinct()
    if efflens.join(own, "feature", "left_anti").limit(1).count() or own.join(efflens, "feature", "left_anti").limit(1).count():
        raise ValueError("the quantifier's index and the tree are of different sets of transcripts")
    return equivalence_classes(spark, classes_path).drop("class_id"), efflens


def point_estimates(spark: SparkSession, path: str, features: DataFrame) -> DataFrame:
    """(transcript_id, proportion) for all features; unknown ids are dropped, absent ones are 0."""
    rows = spark.read.csv(path, header=True, schema="transcript_id string, tpm double", enforceSchema=False)
    return features.select("transcript_id").join(rows, "transcript_id", "left").select("transcript_id", (F.coalesce("tpm", F.lit(0.0)) / 1e6).alias("proportion"))


def line_set(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.text(path).where("value <> ''").select(F.col("value").alias(name)).distinct()


def experiment_spec(spark: SparkSession, path: str) -> dict:
    """A YAML experiment as it stands; every sample has a name."""
    import yaml

    spec = yaml.safe_load("\n".join(r.value for r in spark.read.text(path, wholetext=True).collect()))
    if any("name" not in s for s in spec["samples"]):
        raise ValueError("a sample has no name")
    return spec


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a file or folder of that name in the path's store."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def experiment(spark: SparkSession, path: str, suffix: str = ".prep.parquet") -> DataFrame:
    """(sample, file, factors) of a YAML experiment; a sample without a file has its name and the suffix."""
    rows = [(s["name"], s.get("file", s["name"] + suffix), {k: None if v is None else str(v) for k, v in (s.get("factors") or {}).items()}) for s in experiment_spec(spark, path)["samples"]]
    return spark.createDataFrame(rows, T.StructType.fromDDL("sample string, file string, factors map<string,string>"))
