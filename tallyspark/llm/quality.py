"""Quality rules as a short-circuit cascade.

Each rule's cost and selectivity are measured on a bounded sample of whole texts from all partitions; rules then run by
rejections per cost, and a text stops at the first rule that rejects it. The order changes the work, never the
verdict. Features are made when a rule first asks for them; where the caller wants the base features of every text,
the rules that rest on them cost nothing more, and the sample measures the others on top of them.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import filter_rows, map_rows

ASCII_LETTERS = bytes(range(65, 91)) + bytes(range(97, 123))
HIGH = bytes(range(128, 256))
#: Odd multipliers, one for each place in a window.
MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)
#: The usual thresholds for filtering web text; the looser side where languages differ.
MIN_WORDS, MAX_REPEAT_PERCENT = 10, 20


class Text:
    """Features of one text, each made when a rule first asks for it."""

    def __init__(self, text: str | None):
        self.text = text or ""

    @cached_property
    def words(self) -> list[bytes]:
        return self.text.encode("utf-8", "surrogatepass").split()

    @cached_property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        return len(self.text) - sum(map(self.text.count, " \t\n\x0b\x0c\r"))

    @cached_property
    def n_symbols(self) -> int:
        return sum(map(self.text.count, "#*$%&|<>"))

    @cached_property
    def n_lines(self) -> int:
        return self.text.count("\n") + 1

    @cached_property
    def n_dup_lines(self) -> int:
        if "\n" not in self.text:
            return 0
        lines = self.text.split("\n")
        if len(set(lines)) == len(lines):
            return 0
        lines = [x for x in lines if x.strip(" \t\x0b\x0c\r")]
        return len(lines) - len(set(lines))

    @cached_property
    def n_repeat_words(self) -> int:
        """Words that lie in a window of five words which occurs twice or more. Windows of equal hash are compared word by word."""
        n = self.n_words
        if n < 6:
            return 0
        window = sum(self.hashes[i : n - 4 + i] * MIX[i] for i in range(5))
        order = np.argsort(window, kind="stable")
        same = window[order[1:]] == window[order[:-1]]
        if not same.any():
            return 0
        a, b = order[:-1][same], order[1:][same]
        # Numbers that are the same for the same word, so that a clash of two windows' hashes can't count.
        number: dict[bytes, int] = {}
        exact = np.fromiter((number.setdefault(w, len(number)) for w in self.words), np.int64, n)
        equal = np.logical_and.reduce([exact[a + i] == exact[b + i] for i in range(5)])
        starts = np.unique(np.concatenate((a[equal], b[equal])))
        edge = np.zeros(n + 1, np.int64)
        edge[starts] += 1
        edge[starts + 5] -= 1
        return int((np.cumsum(edge) > 0).sum())

    @cached_property
    def hashes(self) -> np.ndarray:
        return np.fromiter(map(hash, self.words), np.int64, self.n_words).view(np.uint64)

    @cached_property
    def n_stutters(self) -> int:
        """Words equal to the word before."""
        return int((self.hashes[1:] == self.hashes[:-1]).sum())

    @cached_property
    def letter_bytes(self) -> tuple[int, int]:
        """(bytes of letters and of all that isn't ASCII, bytes in words)."""
        solid = b"".join(self.words)
        return len(solid) - len(solid.translate(None, ASCII_LETTERS)) + len(solid) - len(solid.translate(None, HIGH)), len(solid)

    @property
    def base_failed(self) -> bool:
        return self.n_words < MIN_WORDS or 100 * self.n_repeat_words > MAX_REPEAT_PERCENT * self.n_words


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[Text], bool]


RULES = (
    Rule("few_words", lambda t: t.n_words < MIN_WORDS),
    Rule("repeated_windows", lambda t: 100 * t.n_repeat_words > MAX_REPEAT_PERCENT * t.n_words),
    Rule("symbols", lambda t: 10 * t.n_symbols > 3 * t.n_words),
    Rule("word_length", lambda t: not 2 * t.n_words <= t.word_chars <= 15 * t.n_words),
    Rule("duplicate_lines", lambda t: 10 * t.n_dup_lines > 7 * t.n_lines),
    Rule("few_letters", lambda t: 2 * t.letter_bytes[0] < t.letter_bytes[1]),
    Rule("stutter", lambda t: 10 * t.n_stutters > 3 * t.n_words),
)


#: The rules that the base columns decide, and what makes these columns.
BASE_RULES = ("few_words", "repeated_windows")
BASE_FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def order_rules(texts: list[str | None], rules: tuple[Rule, ...] = RULES, made: tuple[str, ...] = ()) -> list[Rule]:
    """Greedy: the rule that rejects most per second of those still kept goes next, measured with fresh features but those already made."""
    left, alive, order = list(rules), [t or "" for t in texts], []
    while left:
        best = None
        for rule in left:
            fresh = [Text(t) for t in alive]
            for text in fresh:
                for name in made:
                    getattr(text, name)
            began = time.perf_counter()
            verdicts = [rule.rejects(t) for t in fresh]
            rate = sum(verdicts) / (time.perf_counter() - began + 1e-9)
            if best is None or rate > best[0]:
                best = rate, rule, verdicts
        order.append(best[1])
        left.remove(best[1])
        alive = [t for t, bad in zip(alive, best[2], strict=True) if not bad]
    return order


def spread_sample(docs: DataFrame, text_col: str, rows: int, of_each: int = 4) -> list[str | None]:
    """At most `rows` whole texts: the first few of each partition, then by hash. A task stops after its first batch."""

    def run(batches):
        for batch in batches:
            yield batch.slice(0, of_each)
            return

    first = docs.select(F.col(f"`{text_col}`").alias("_0")).mapInArrow(run, "_0 string")
    return [r[0] for r in first.orderBy(F.xxhash64("_0")).limit(rows).collect()]


def plan_cascade(docs: DataFrame, text_col: str = "text", sample_rows: int = 300, with_base: bool = False) -> tuple[str, ...]:
    """Rule names in the order to run, from at most sample_rows texts. with_base: for texts whose base features are there already and passed."""
    texts = spread_sample(docs, text_col, sample_rows)
    if with_base:
        texts = [t for t in texts if not Text(t).base_failed]
        return tuple(r.name for r in order_rules(texts, tuple(r for r in RULES if r.name not in BASE_RULES), BASE_FEATURES))
    return tuple(r.name for r in order_rules(texts))


def cascade(names: tuple[str, ...]) -> Callable[[Text], str | None]:
    by = {r.name: r for r in RULES}
    rules = [by[n] for n in names]
    return lambda t: next((r.name for r in rules if r.rejects(t)), None)


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = 300) -> DataFrame:
    """One row per input row: id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept.

    A null or empty text has no words and is rejected. A null id stays null, repeated rows each give a row, an
    empty table gives none, other columns are ignored. One pass, no shuffle. The base columns decide first; a text
    that they pass goes through the cascade of the other rules.
    """
    names = plan_cascade(docs, text_col, sample_rows, with_base=True)

    def start():
        first = cascade(names)

        def row(key, text):
            t = Text(text)
            bad = t.base_failed
            return key, t.n_words, t.word_chars, t.n_symbols, t.n_dup_lines, t.n_repeat_words, bad, not bad and first(t) is None

        return row

    kind = dict(docs.dtypes)[id_col]
    return map_rows(docs, [id_col, text_col], f"`{id_col}` {kind}, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean", start)


def keep_good(docs: DataFrame, text_col: str = "text", sample_rows: int = 300) -> DataFrame:
    """The rows that no rule rejects, with all columns; the cascade saves the features that it doesn't reach.

    Rows with a null or empty text go, repeated rows stay or go together, an empty table stays empty.
    """
    names = plan_cascade(docs, text_col, sample_rows)

    def start():
        first = cascade(names)
        return lambda text: first(Text(text)) is None

    return filter_rows(docs, [text_col], start)
