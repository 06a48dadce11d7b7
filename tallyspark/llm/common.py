"""Shared helpers of the training-data operators: Arrow row maps, spans, word rules."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..plans.scratch import materialize, scratch_root  # noqa: F401

#: ASCII letters, for lower-casing A-Z and nothing else.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LOWER_BYTES = bytes.maketrans(UPPER.encode(), LOWER.encode())


def word_bytes(kept: str) -> bytes:
    """A table for bytes.translate of UTF-8: A-Z in lower case, `kept` and all bytes beyond ASCII as they are, spaces for the rest."""
    return bytes(b if b >= 128 or chr(b) in kept else 32 for b in LOWER_BYTES)


#: The white space that separates words, as a bracket body and as a string.
SPACE_SET = r"\x20\x09-\x0D"
SPACES = " \t\n\x0b\x0c\r"


def az_lower(text: Column) -> Column:
    """Lower-case A-Z only; text that is all ASCII takes the faster built-in."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def text_key(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def map_rows(df: DataFrame, columns: list[str], schema: str, start: Callable[[], Callable]) -> DataFrame:
    """Each row's columns go to the function that start() makes once a partition; it returns the output tuple.

    Other columns are not read; the columns may have any names, as they pass as _0, _1 and so on.
    """
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = start()
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                out = [row(*values) for values in zip(*(part.column(i).to_pylist() for i in range(part.num_columns)), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), arrow.types, strict=True)], schema=arrow)

    return df.select(*(F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(columns))).mapInArrow(run, schema)


def filter_rows(df: DataFrame, columns: list[str], start: Callable[[], Callable]) -> DataFrame:
    """Rows whose columns the function of start() accepts, with every column as it was."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = start()
        for batch in batches:
            values = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in columns]
            yield batch.filter(pa.array([keep(*row) for row in zip(*values, strict=True)], pa.bool_()))

    return df.mapInArrow(run, df.schema)


SPANS = "array<struct<kind:string,start:bigint,end:bigint>>"


def span_list(spans: list[tuple[int, int, int]], kinds: tuple[str, ...]) -> list[dict]:
    """Spans given as (start, kind, end), by start, then kind as listed."""
    return [{"kind": kinds[k], "start": a, "end": b} for a, k, b in sorted(spans)]


def span_text(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def spans_of(spans: Column, *kinds: str) -> Column:
    return F.filter(spans, lambda s: s["kind"].isin(*kinds))


def span_digest(df: DataFrame, id_col: str, base: list[str]) -> DataFrame:
    """n_<kind> of the base kinds, base_sha256 and spans, from the column `found`."""
    return df.select(
        id_col,
        *(F.size(spans_of(F.col("found"), k)).cast("long").alias(f"n_{k}") for k in base),
        F.sha2(span_text(spans_of(F.col("found"), *base)), 256).alias("base_sha256"),
        span_text(F.col("found")).alias("spans"),
    )


def on_plain_names(docs: DataFrame, change: Callable[[DataFrame, Callable[[str], str]], DataFrame]) -> DataFrame:
    """change(docs, name_of) over columns called _c0, _c1 and so on, then the own names again: results can't clash with them."""
    names = {c: f"_c{i}" for i, c in enumerate(docs.columns)}
    return change(docs.toDF(*names.values()), names.__getitem__).select(*names.values()).toDF(*names)
