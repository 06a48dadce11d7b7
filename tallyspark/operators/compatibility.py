"""Fragments against transcripts: compatibility, fragment length and place in the transcript, as column expressions.

An alignment is its left position, which counts a leading clip, and its CIGAR as an array of (op, len); a transcript is
its sorted exons as an array of (first, last). Nothing leaves the JVM, so these run inside the interval join's stage.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.scalar import exonic_length, introns, transcript_position

#: Bases by which a match may reach into an intron at either end.
OVERHANG = 2
_TAKES_REFERENCE = ("M", "=", "X", "D", "N", "S")


def blocks(left: Column, cigar: Column) -> Column:
    """The CIGAR as an array of (op, first, last) on the genome; an insertion is empty, its last before its first."""
    size = lambda o: F.when(o["op"].isin(*_TAKES_REFERENCE), o["len"]).otherwise(0)
    start = lambda i: left + F.aggregate(F.slice(cigar, 1, i), F.lit(0).cast("long"), lambda n, o: n + size(o))
    return F.transform(cigar, lambda o, i: F.struct(o["op"].alias("op"), start(i).alias("first"), (start(i) + size(o) - 1).alias("last")))


def _fits(b: Column, exons: Column) -> Column:
    """A match lies in an exon but for OVERHANG bases of the introns beside it, a deletion in an exon, a skip in an intron; clips and insertions fit anywhere."""
    places = F.sequence(F.lit(0), F.size(exons) - 1)

    def near(i):
        e, before = F.get(exons, i), F.get(exons, i - 1)["last"]
        begins = (b["first"] >= e["first"]) | ((b["first"] >= e["first"] - OVERHANG) & (b["first"] > before))
        return F.coalesce(begins, F.lit(False)) & (b["first"] <= e["last"]) & (b["last"] <= e["last"] + OVERHANG)

    inside = lambda e: (e["first"] <= b["first"]) & (b["last"] <= e["last"])
    fits = F.when(b["op"].isin("M", "=", "X"), F.exists(places, near)).when(b["op"] == "D", F.exists(exons, inside)).when(b["op"] == "N", F.exists(introns(exons), inside))
    return fits.otherwise(b["op"].isin("S", "I", "H", "P"))


def bounds(one: Column, two: Column) -> Column:
    """(low, high) of the bases of both mates that must be exonic; null if there are none."""
    exonic = F.filter(F.concat(one, F.coalesce(two, F.slice(one, 1, 0))), lambda b: b["op"].isin("M", "=", "X", "D"))
    return F.struct(F.array_min(F.transform(exonic, lambda b: b["first"])).alias("low"), F.array_max(F.transform(exonic, lambda b: b["last"])).alias("high"))


def may_fit(bounds: Column, exons: Column) -> Column:
    """A quick test that every compatible fragment passes: its first and last exonic bases lie in exons, but for the overhang."""
    near = lambda at: F.exists(exons, lambda e: (at >= e["first"] - OVERHANG) & (at <= e["last"] + OVERHANG))
    return F.coalesce(near(bounds["low"]) & near(bounds["high"]), F.lit(True))


def _aligned(b: Column) -> Column:
    return F.filter(b, lambda x: ~x["op"].isin("S", "I", "H", "P"))


def fragment_length(exons: Column, one: Column, two: Column) -> Column:
    """Length of a fragment, introns left out, if it came from the transcript; 0 if a single mate is compatible; null if none is.

    one and two are the mates' blocks(); two is null for a single mate. Introns count as left out where they lie whole
    between the first and the last aligned base.
    """
    both = F.concat(one, F.coalesce(two, F.slice(one, 1, 0)))
    first, last = F.array_min(F.transform(both, lambda b: b["first"])), F.array_max(F.transform(both, lambda b: b["last"]))
    span = (first >= F.element_at(exons, 1)["first"]) & (last <= F.element_at(exons, -1)["last"])
    aligned = _aligned(both)
    low, high = F.array_min(F.transform(aligned, lambda b: b["first"])), F.array_max(F.transform(aligned, lambda b: b["last"]))
    within = F.filter(introns(exons), lambda i: (i["first"] > low) & (i["last"] < high))
    length = last - first + 1 - exonic_length(within)
    return F.when(span & F.forall(both, lambda b: _fits(b, exons)), F.when(two.isNull(), F.lit(0).cast("long")).when(length > 0, length))


def transcript_range(exons: Column, strand: Column, one: Column, two: Column, reverse: Column, median: int) -> Column:
    """(first, last) of a fragment in its transcript's own direction; null if it is not compatible or lies outside.

    A single mate, on the reverse strand or not, is taken for one end of a fragment of the median length. What reaches
    over either end of the transcript, as clips do, is cut off.
    """
    length = fragment_length(exons, one, two)
    size = F.when(length > 0, length).otherwise(F.lit(median).cast("long"))
    left = lambda b: F.array_min(F.transform(b, lambda x: x["first"]))
    right = lambda b: F.array_max(F.transform(b, lambda x: x["last"]))
    sign = F.when(strand == "-", -1).otherwise(1)
    at = lambda p: transcript_position(p, exons, sign)
    pair = F.when(sign > 0, at(F.least(left(one), left(two)))).otherwise(at(F.greatest(right(one), right(two))))
    anchor = F.when(reverse, at(right(one))).otherwise(at(left(one)))
    single = anchor - F.when(reverse == (sign > 0), size).otherwise(0)
    start = F.when(two.isNull(), single).otherwise(pair)
    first, last = F.greatest(start, F.lit(1)), F.least(start + size - 1, exonic_length(exons))
    return F.when(length.isNotNull() & (size > 0) & (last >= first), F.struct(first.alias("first"), last.alias("last")))
