"""The sparse fragment-by-feature likelihood table and what is estimated from it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..plans.scratch import materialize
from .relations import dense_ids


def likelihood_table(rows: DataFrame, read: str, feature: str, weight: str) -> DataFrame:
    """(read, feature, prob): duplicate entries are summed, combined in the map tasks."""
    return rows.groupBy(F.col(read).alias("read"), F.col(feature).alias("feature")).agg(F.sum(weight).alias("prob"))


def em_round(table: DataFrame, y: DataFrame, small: bool) -> DataFrame:
    """(feature, y) after one round: each read is shared out by prob * y, and a feature's share of all reads is its new y."""
    weighted = table.join(F.broadcast(y) if small else y, "feature").withColumn("w", F.col("prob") * F.col("y"))
    count = F.col("count") if "count" in table.columns else F.lit(1)
    shares = weighted.withColumn("share", count * F.col("w") / F.sum("w").over(W.partitionBy("read")))
    counts = materialize(shares.groupBy("feature").agg(F.sum("share").alias("c")), "em-counts")
    total = counts.agg(F.sum("c").alias("total"))
    return y.select("feature").join(counts, "feature", "left").crossJoin(F.broadcast(total)).select("feature", (F.coalesce("c", F.lit(0.0)) / F.col("total")).alias("y"))


def log_likelihood(table: DataFrame, y: DataFrame) -> DataFrame:
    """One row: the sum over reads (or classes, by count) of the log of their summed prob * y."""
    count = F.first("count") if "count" in table.columns else F.lit(1)
    reads = table.join(y, "feature").groupBy("read").agg(F.sum(F.col("prob") * F.col("y")).alias("p"), count.alias("k"))
    return reads.agg(F.sum(F.col("k") * F.log("p")).alias("log_likelihood"))


def packed_reads(table: DataFrame, ids: DataFrame) -> DataFrame:
    """(features, probs, count): a read's row of the likelihood as arrays, features by the number that ids (feature, i) give them."""
    count = F.first("count") if "count" in table.columns else F.lit(1)
    row = F.collect_list(F.struct("i", F.col("prob").cast("double").alias("prob"))).alias("row")
    return table.join(ids, "feature").groupBy("read").agg(row, count.cast("double").alias("count")).select(F.col("row.i").alias("features"), F.col("row.prob").alias("probs"), "count")


def packed_round(rows: DataFrame, y: np.ndarray) -> tuple[np.ndarray, float]:
    """(counts by feature number, log-likelihood at y): reads are shared out inside their rows, and only a partition's sums are shuffled."""
    n, shared = len(y), rows.sparkSession.sparkContext.broadcast(y)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, likelihood = np.zeros(n), 0.0
        for batch in batches:
            lists, count = batch.column(0), batch.column(2).to_numpy()
            size = lists.value_lengths().to_numpy()
            read, features = np.repeat(np.arange(len(size)), size), lists.flatten().to_numpy()
            w = batch.column(1).flatten().to_numpy() * shared.value[features]
            total = np.bincount(read, w, len(size))
            known = total > 0
            likelihood += float(count[known] @ np.log(total[known]))
            share = np.divide(count, total, out=np.zeros(len(total)), where=known)
            counts += np.bincount(features, w * share[read], n)
        seen = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(seen, -1), pa.int32()), pa.array(np.append(counts[seen], likelihood))], names=["i", "c"])

    sums = rows.mapInArrow(run, "i int, c double").groupBy("i").agg(F.sum("c").alias("c")).toArrow()  # a row for each feature, which were counted
    counts = np.zeros(n + 1)
    counts[sums["i"].to_numpy()] = sums["c"].to_numpy()
    shared.unpersist()
    return counts[:n], float(counts[n])


def em(table: DataFrame, features: DataFrame, rounds: int | None = None, tolerance: float = 1e-6, most: int = 10_000, broadcast_rows: int = 500_000) -> DataFrame:
    """(feature, y) from a uniform start over features (feature, efflen): `rounds` rounds, or until a round gains less log-likelihood than tolerance.

    Features without a read keep y = 0. Up to broadcast_rows features, as counted, reads are packed once by a shuffle, and a
    round sends y out and brings one sum for each feature back; beyond, a round joins y to the rows. Rounds without an end
    (`most`) are an error.
    """
    n = features.count()
    if n <= broadcast_rows:
        return _packed_em(table, features, rounds, tolerance, most)
    table = materialize(table, "likelihood")
    y = features.select("feature", F.lit(1.0 / n).alias("y"))
    before = None
    for number in range(rounds if rounds is not None else most):
        y = materialize(em_round(table, y, False), "em")
        if rounds is None and number % 5 == 4:
            now = log_likelihood(table, y).first()[0]
            if before is not None and now - before < tolerance:
                return y
            before = now
    if rounds is None:
        raise RuntimeError(f"no convergence after {most} rounds")
    return y


def _packed_em(table: DataFrame, features: DataFrame, rounds: int | None, tolerance: float, most: int) -> DataFrame:
    ids = materialize(dense_ids(features, ["feature"], "i").withColumn("i", (F.col("i") - 1).cast("int")), "em-features")
    rows = materialize(packed_reads(table, F.broadcast(ids)), "em-reads")
    n = ids.count()
    y, before = np.full(n, 1 / max(n, 1)), None
    for _ in range(rounds if rounds is not None else most):
        counts, now = packed_round(rows, y)
        if rounds is None and before is not None and now - before < tolerance:
            break
        y, before = counts / max(counts.sum(), 1e-300), now
    else:
        if rounds is None:
            raise RuntimeError(f"no convergence after {most} rounds")
    found = table.sparkSession.createDataFrame(pa.table({"i": pa.array(np.arange(n), pa.int32()), "y": y}))
    return ids.join(F.broadcast(found), "i").select("feature", "y")


def to_tpm(y: DataFrame, features: DataFrame) -> DataFrame:
    """(feature, tpm): y over effective length, scaled to a million."""
    rate = y.join(features, "feature").withColumn("rate", F.col("y") / F.col("efflen"))
    return rate.crossJoin(F.broadcast(rate.agg(F.sum("rate").alias("total")))).select("feature", (1e6 * F.col("rate") / F.col("total")).alias("tpm"))


def exact_classes(table: DataFrame) -> DataFrame:
    """(features, probs, count): reads with the same features and probabilities are one class; rows that are classes already bring their count."""
    count = F.first("count") if "count" in table.columns else F.lit(1)
    rows = table.groupBy("read").agg(F.array_sort(F.collect_list(F.struct("feature", "prob"))).alias("row"), count.cast("long").alias("n"))
    return rows.groupBy(F.col("row.feature").alias("features"), F.col("row.prob").alias("probs")).agg(F.sum("n").alias("count"))


def range_classes(table: DataFrame) -> DataFrame:
    """(features, bins, count): probabilities of one feature set are put in 4 + ceil(sqrt k) bins of equal width, k its reads."""
    rows = table.groupBy("read").agg(F.array_sort(F.collect_list(F.struct("feature", "prob"))).alias("row"))
    sets = rows.select("read", F.col("row.feature").alias("features"), F.inline("row"))
    span = sets.groupBy("features", "feature").agg(F.min("prob").alias("low"), F.max("prob").alias("high"), F.count("*").alias("k"))
    bins = 4 + F.ceil(F.sqrt("k"))
    width = (F.col("high") - F.col("low")) / bins
    binned = sets.join(span, ["features", "feature"]).withColumn("bin", F.when(F.col("high") == F.col("low"), 0).otherwise(F.least(F.floor((F.col("prob") - F.col("low")) / width), bins - 1)))
    per_read = binned.groupBy("read", "features").agg(F.array_sort(F.collect_list(F.struct("feature", "bin"))).alias("row"))
    return per_read.groupBy("features", F.col("row.bin").alias("bins")).agg(F.count("*").alias("count"))


def assign_reads(table: DataFrame, seed: int = 0) -> DataFrame:
    """(read, feature): one feature of each read, drawn by prob; the draw is a hash of seed and read, so a lost task redraws the same."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("read").cast("string")).cast("binary"))
    draw = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / 2.0**32
    w = W.partitionBy("read")
    summed = table.where("prob > 0").withColumns({"upto": F.sum("prob").over(w.orderBy("feature")), "total": F.sum("prob").over(w)})
    return summed.where(F.col("upto") > draw * F.col("total")).groupBy("read").agg(F.min("feature").alias("feature"))
