"""Bounded-space online packing of token sequences.

A task keeps a fixed number of open windows. A piece goes to the window that it fills best; when it fits none,
the fullest window is topped up with the piece's head and emitted. Windows still open at the end of a task are
merged in rounds, a group of tasks at a time, by the same rule.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

END_ID = 0
DOUBLE_SPACE = re.compile(r"\s\s|\s\Z")
#: Above this, letters and classes may differ between two libraries' Unicode tables; such words go to the slower one.
PLAIN = re.compile(r"[\x00-ɏ]*\Z")
SPECIAL = "<|endoftext|>"


@lru_cache(maxsize=2)
def load(path: str, ranks_path: str | None):
    """The tokenizer and, if it is named, the faster library over the same vocabulary.

    Both join the pair of lowest rank first. They give the same ids if the vocabularies are equal, every token's own bytes
    come out as that token, and words are split alike; a test shows all three, for every token and every plain character.
    """
    import base64

    import tiktoken
    from tokenizers import Tokenizer

    full = Tokenizer.from_file(path)
    if ranks_path is None:
        return full, None
    with open(ranks_path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return full, tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


class Ids(dict):
    """Ids of a word as bytes, in a bounded table. prefix: what stands before the word."""

    def __init__(self, path: str, ranks_path: str | None, prefix: str, size: int):
        super().__init__()
        (self.full, self.plain), self.prefix, self.size = load(path, ranks_path), prefix, size

    def __missing__(self, word: str) -> bytes:
        ids = self.encode(self.prefix + word)
        if len(word) <= 64:
            if len(self) >= self.size:
                self.clear()
            self[word] = ids
        return ids

    def encode(self, text: str) -> bytes:
        if self.plain and SPECIAL not in text and PLAIN.match(text):
            return self.plain.encode_to_numpy(text).astype("<u4").tobytes()
        return np.array(self.full.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


class Encoder:
    """Token ids of a text as little-endian unsigned 32-bit bytes, the end id last.

    A text of plain letters is encoded whole by the faster library. In another, where white space stands alone, words
    are encoded one by one through tables: a space goes with the word after it, a line break is an id of its own.
    """

    def __init__(self, path: str, ranks_path: str | None = None, size: int = 250_000):
        self.spaced, self.opening = Ids(path, ranks_path, " ", size), Ids(path, ranks_path, "", size // 4)
        self.newline = self.opening.encode("\n")
        self.end = END_ID.to_bytes(4, "little")

    def __call__(self, text: str | None) -> bytes:
        if not text:
            return self.end
        if SPECIAL in text or DOUBLE_SPACE.search(text) or PLAIN.match(text):
            return self.opening.encode(text) + self.end
        lines = []
        for line in text.split("\n"):
            first, *rest = line.split(" ")
            lines.append((self.opening[first] if first else b"") + b"".join(map(self.spaced.__getitem__, rest)))
        return self.newline.join(lines) + self.end


class Packer:
    """Windows of `size` ids, at most `space` of them open. A piece is (document fields, start, ids as bytes)."""

    def __init__(self, size: int, space: int, first: int):
        self.size, self.space, self.next = size, space, first
        self.open: list[list] = []  # [used, pieces]

    def add(self, doc: tuple, start: int, ids: bytes) -> Iterator[tuple]:
        """Rows of the windows that are full by now."""
        n = len(ids) // 4
        while n >= self.size:
            yield from self.emit([(doc, start, ids[: 4 * self.size])])
            start, ids, n = start + self.size, ids[4 * self.size :], n - self.size
        while n:
            best = max((w for w in self.open if w[0] + n <= self.size), key=lambda w: w[0], default=None)
            if best is None and len(self.open) < self.space:
                self.open.append(best := [0, []])
            if best is not None:
                best[1].append((doc, start, ids))
                best[0] += n
                if best[0] == self.size:
                    self.open.remove(best)
                    yield from self.emit(best[1])
                return
            fullest = max(self.open, key=lambda w: w[0])
            room = self.size - fullest[0]
            self.open.remove(fullest)
            yield from self.emit([*fullest[1], (doc, start, ids[: 4 * room])])
            start, ids, n = start + room, ids[4 * room :], n - room

    def emit(self, pieces: list) -> Iterator[tuple]:
        offset = 0
        for doc, start, ids in pieces:
            yield (*doc, start, len(ids) // 4, ids, self.next, offset)
            offset += len(ids) // 4
        self.next += 1

    def rest(self) -> Iterator[tuple]:
        for _, pieces in self.open:
            yield from self.emit(pieces)
        self.open = []


def _batch(rows: list[tuple], schema: pa.Schema, **more) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in range(7)]
    columns += [[v] * len(rows) for v in more.values()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)


def pack(docs: DataFrame, path: str | None = None, ranks_path: str | None = None, id_col: str = "doc_id", text_col: str = "text", size: int = 1024, space: int = 32, fan_in: int = 32) -> DataFrame:
    """One row per piece: doc_id, doc_tokens, start, length, ids (little-endian unsigned 32-bit), sequence_id, offset.

    ids are those of the tokenizer at `path`; ranks_path names the same vocabulary's rank file, with which plain texts are
    encoded several times as fast. Without `path` both are those of byte_bpe_50k.

    Null and empty texts are their end id alone. A null id stays null; repeated rows are packed each, an empty table
    gives no rows, other columns are ignored. sequence_id is unique: round, task or group, and number there are parts of
    it. Pieces are written once to the shared folder; only windows that stay open, `space` a task at
    most, meet again: fan_in tasks' windows in one task of the next round, until one is left.
    """
    if path is None:
        path, ranks_path = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    kind = dict(docs.dtypes)[id_col]
    schema = f"doc_id {kind}, doc_tokens bigint, start bigint, length bigint, ids binary, sequence_id bigint, offset bigint, task bigint, open boolean"
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def first_round(batches):
        encode, task = Encoder(path, ranks_path), TaskContext.get().partitionId()
        packer = Packer(size, space, task << 32)
        rows, held = [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = encode(text)
                rows += packer.add((doc_id, len(ids) // 4), 0, ids)
                held += len(ids)
                if held > 4 << 20:
                    yield _batch(rows, arrow, task=task, open=False)
                    rows, held = [], 0
        yield _batch(rows, arrow, task=task, open=False)
        yield _batch(list(packer.rest()), arrow, task=task, open=True)

    def later_round(number: int):
        def run(key, table):
            """One group of tasks, space * fan_in windows at most: its pieces in a fixed order, the longer first."""
            group = key[0].as_py()
            pieces = list(zip(*(table.column(i).to_pylist() for i in range(5)), strict=True))
            pieces.sort(key=lambda p: (-p[3], p[0] is None, p[0], p[2]))
            packer, rows = Packer(size, space, number << 56 | group << 32), []
            for doc_id, doc_tokens, start, _, ids in pieces:
                rows += packer.add((doc_id, doc_tokens), start, ids)
            return pa.Table.from_batches([_batch(rows, arrow, task=group, open=False), _batch(list(packer.rest()), arrow, task=group, open=True)])

        return run

    texts = docs.select(F.col(f"`{id_col}`").alias("_0"), F.col(f"`{text_col}`").alias("_1"))
    done = materialize(texts.mapInArrow(first_round, schema), "packed")
    out, number = done.where("not open"), 0
    tasks = (done.where("open").agg(F.max("task")).first()[0] or 0) + 1
    while tasks > 1:
        number += 1
        groups = done.where("open").withColumn("group", F.floor(F.col("task") / fan_in))
        done = materialize(groups.groupBy("group").applyInArrow(later_round(number), schema), "packed")
        out, tasks = out.unionByName(done.where("not open")), -(-tasks // fan_in)
    return out.unionByName(done.where("open")).drop("task", "open")
