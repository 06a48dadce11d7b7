"""Token counts by a map-side two-tier lookup.

Tier one is a compact table of the lengths of frequent pre-tokens, broadcast; tier two is a bounded cache
in each worker that encodes misses. Pre-tokens are never shuffled.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import lru_cache

import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows

RUN = re.compile(" *[^ ]+| +")


@lru_cache(maxsize=4)
def load(path: str):
    from sentencepiece import SentencePieceProcessor

    return SentencePieceProcessor(model_file=path)


class Lengths(dict):
    """Number of tokens of a pre-token. The table is bounded: when full, it starts anew from what was known."""

    def __init__(self, known: dict[str, int], path: str, size: int, opens_line: bool):
        super().__init__(known)
        self.known, self.encode, self.size, self.opens_line = known, load(path).encode, size, opens_line

    def __missing__(self, word: str) -> int:
        if len(self) >= self.size:
            self.clear()
            self.update(self.known)
        # The encoder puts a space before its text. A word that opens a line has none: it is encoded after a line break.
        n = len(self.encode("\n" + word)) - 2 if self.opens_line else len(self.encode(word)) if word else 1
        self[word] = n
        return n


def pre_tokens(text: str) -> tuple[int, list[str], list[str]]:
    """(line breaks, words after a space, words that open a line); a word may start with further spaces.

    No piece holds a line break, or a space after another character, so tokens never cross these borders.
    """
    lines = text.replace("▁", " ").split("\n")
    spaced: list[str] = []
    opening: list[str] = []
    for i, line in enumerate(lines):
        if not line:
            if not i and len(lines) > 1:
                spaced.append("")
        elif "  " not in line and line[-1] != " " and line[0] != " ":
            words = line.split(" ")
            if i:
                opening.append(words[0])
                del words[0]
            spaced += words
        else:
            runs = RUN.findall(line if i else " " + line)
            if i and runs[0][0] != " ":
                opening.append(runs.pop(0))
            spaced += [run[1:] for run in runs]
    return len(lines) - 1, spaced, opening


def frequent(docs: DataFrame, text_col: str, path: str, sample_rows: int, table_size: int) -> dict[str, int]:
    """Tier one: pre-tokens of at most sample_rows texts, the table_size most frequent. It only saves time: misses are exact."""
    counts: Counter[str] = Counter()
    for (text,) in docs.select(F.substring(F.col(f"`{text_col}`"), 1, 20_000)).limit(sample_rows).toLocalIterator():
        counts.update(pre_tokens(text or "")[1])
    encode = load(path).encode
    return {w: len(encode(w)) if w else 1 for w, _ in counts.most_common(table_size) if len(w) <= 64}


def count_tokens(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096, sample_rows: int = 500, table_size: int = 32_768, cache_size: int = 400_000) -> DataFrame:
    """One row per input row: id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    Null and empty texts have 0 bytes and tokens. A null id stays null, repeated rows each give a row, an empty
    table gives none, other columns are ignored. One pass; broadcast: table_size words of at most 64 characters.
    """
    path = path or public_tokenizers.path("piece_bpe_32k.model")
    shared = docs.sparkSession.sparkContext.broadcast(frequent(docs, text_col, path, sample_rows, table_size))

    def start():
        spaced, opening = Lengths(shared.value, path, cache_size, False), Lengths({}, path, cache_size // 2, True)

        def row(key, text):
            if not text:
                return key, 0, 0, False
            breaks, words, first = pre_tokens(text)
            n = breaks + sum(map(spaced.__getitem__, words)) + sum(map(opening.__getitem__, first))
            return key, len(text.encode()), n, n > limit

        return row

    kind = dict(docs.dtypes)[id_col]
    return map_rows(docs, [id_col, text_col], f"`{id_col}` {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean", start)
