"""Personal data by bootstrapped contextual extraction.

Base patterns give seed entities. An identifier-shaped token, or a number in groups, has two lexical patterns of its
kind: the two words before it, and the words on its two sides. Seeds score patterns and patterns score instances in
turns, until no further pattern is accepted; the accepted ones mark identifiers that no base pattern knows.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPANS, map_rows, materialize, span_list

#: Fixed patterns of the base kinds.
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
USER_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: A run of digits that fails at its start fails inside as well, so a match begins where a run does; ++ never steps back.
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
KINDS = ("email", "ip", "card", "phone", "ctx_email", "ctx_ip", "ctx_card", "ctx_phone")

#: Bytes of a graph up to which its patterns and instances are broadcast.
BROADCAST_BYTES = 16_000_000
#: A token that can be an identifier; the shapes tell of which kind it can be.
TOKEN = re.compile(r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+")
SHAPES = (
    ("email", re.compile(r"[\w.%+-]+(?:@|\[at\]|\(at\))[\w.-]+")),
    ("ip", re.compile(r"[0-9A-Fa-f]{1,4}(?:[.:][0-9A-Fa-f]{1,4}){3,7}")),
    ("card", re.compile(r"[0-9](?:-?[0-9]){13,18}")),
    ("phone", re.compile(r"\+?\(?[0-9](?:[().-]*[0-9]){6,14}")),
)
#: What stands between two digits of one number, and where a number in groups ends.
GAP = r"(?:[().-]*|\)?\x20\(?|\x20-\x20)"
GROUP_END = r"(?=[.,;:!?\"'()\[\]{}<>]*(?:\s|\Z))"
SPACED = (
    ("card", re.compile(rf"[0-9](?:(?:-|\x20|\x20-\x20)?[0-9]){{13,18}}{GROUP_END}")),
    ("phone", re.compile(rf"\+?\(?[0-9](?:{GAP}[0-9]){{6,14}}{GROUP_END}")),
)
TRIM = ".,;:!?\"'()[]{}<>"


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches, one @ at a time: what can precede an @ holds none, so each @ decides for itself."""
    end, at = 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > end and text[begin - 1] in USER_CHARS:
            begin -= 1
        if begin < at and (m := DOMAIN.match(text, at + 1)):
            yield begin, m.end()
            end = m.end()
        at = text.find("@", max(at + 1, end))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    spans = []
    if "@" in text:
        spans += [(a, 0, b) for a, b in emails(text)]
    if DIGIT.search(text):
        spans += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(len(p := part.lstrip("0")) < 4 and int(p or "0") <= 255 for part in m[0].split("."))]
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 14 and 14 <= len(d := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(d):
                spans.append((m.start(), 2, m.end()))
        if "+" in text:
            spans += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 10 <= sum("0" <= c <= "9" for c in m[0]) <= 15]
    return spans


class Taken:
    """Answers whether a span touches one of the given spans, by binary search."""

    def __init__(self, spans: list[tuple[int, int, int]]):
        self.starts: list[int] = []
        self.ends: list[int] = []
        for a, _, b in sorted(spans):
            if self.ends and a < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], b)
            else:
                self.starts.append(a)
                self.ends.append(b)

    def touches(self, a: int, b: int) -> bool:
        at = bisect.bisect_left(self.starts, b) - 1
        return at >= 0 and self.ends[at] > a


def shape(token: str) -> str | None:
    return next((kind for kind, form in SHAPES if form.fullmatch(token)), None)


def words_before(text: str, at: int) -> str:
    """The two words before a place, in lower case, of any length; at the start of a text an empty word stands for the start."""
    width = 80
    while True:
        begin = max(0, at - width)
        words = text[begin:at].split()
        if begin == 0 or len(words) > 2:  # the first of three may be cut, the last two are whole
            return " ".join(["", *words][-2:]).lower()
        width *= 4


AFTER = re.compile(r"[.,;:!?\"'()\[\]{}<>]*+\s*+(\S*+)")


def contexts(text: str, begin: int, end: int) -> tuple[str, str]:
    """The patterns of a place: the two words before it, and the last of them with the word after it."""
    before = words_before(text, begin)
    return before, f"{before.rpartition(' ')[2]} _ {AFTER.match(text, end)[1].lower()}"


def spaced(text: str, at: int) -> tuple[str, int, int] | None:
    """(kind, start, end) of a card or phone number written in groups that single spaces or spaced dashes part, from a token's start on."""
    for begin in (at - 1, at) if at and text[at - 1] == "(" else (at,):
        for kind, form in SPACED:
            if (m := form.match(text, begin)) and any(c.isspace() for c in m[0]) and (begin == at or ")" in m[0]):
                return kind, begin, m.end()
    return None


def candidates(text: str) -> Iterator[tuple[str, tuple[str, str], int, int]]:
    """(kind, patterns in lower case, start, end) of identifier-shaped tokens, and of numbers in groups."""
    grouped = 0
    for m in TOKEN.finditer(text):
        raw = m[0]
        a = m.start() + len(raw) - len(raw.lstrip(TRIM))
        token = raw.strip(TRIM)
        if a >= grouped and (whole := spaced(text, a)):
            kind, begin, grouped = whole
            yield kind, contexts(text, m.start(), grouped), begin, grouped
        if kind := shape(token):
            yield kind, contexts(text, m.start(), a + len(token)), a, a + len(token)


def pattern_edges(docs: DataFrame, text_col: str) -> DataFrame:
    """(pattern, instance, seed): each pair once, after summing in the map tasks and then by pair."""

    def run(batches):
        for batch in batches:
            seen: dict[tuple[str, str], int] = {}
            for text in batch.column(0).to_pylist():
                if not text or not ("@" in text or DIGIT.search(text)):
                    continue
                base = None
                for kind, around, a, b in candidates(text):
                    base = base or Taken(base_spans(text))
                    seed = int(base.touches(a, b))
                    for words in around:
                        pair = (f"{kind}|{words}", text[a:b])
                        seen[pair] = max(seen.get(pair, 0), seed)
            yield pa.RecordBatch.from_arrays(
                [pa.array([p for p, _ in seen], pa.string()), pa.array([i for _, i in seen], pa.string()), pa.array(list(seen.values()), pa.int32())], names=["pattern", "instance", "seed"]
            )

    return docs.select(F.col(f"`{text_col}`").alias("_0")).mapInArrow(run, "pattern string, instance string, seed int").groupBy("pattern", "instance").agg(F.max("seed").alias("seed"))


def rate(scored: DataFrame, damping: float) -> DataFrame:
    """(pattern, support, confidence): a pattern's confidence is the sum of its instances' beliefs by their number plus damping."""
    return scored.groupBy("pattern").agg(F.count("*").alias("support"), (F.sum("belief") / (F.count("*") + F.lit(damping))).alias("confidence"))


def learn_patterns(docs: DataFrame, text_col: str = "text", min_support: int = 8, min_confidence: float = 0.7, rounds: int = 12, damping: float = 3.0) -> DataFrame:
    """(pattern, support, confidence) of every high-confidence pattern, as a table in the shared folder.

    The whole graph is scored, so that a pattern without a seed of its own learns from instances that others vouch for. A
    seed's belief is 1; another instance's is the noisy-or of its patterns, each counted at half its confidence, and an
    instance of an accepted pattern is believed at that pattern's confidence at least. Rounds go on while patterns are
    accepted or confidence, which only grows, has gained over 0.2 %; `rounds` bounds them. A graph of few
    bytes has its sides broadcast, so that no join sorts.
    """
    edges = materialize(pattern_edges(docs, text_col), "pii-edges")
    width = edges.agg(F.sum(F.octet_length("pattern") + F.octet_length("instance") + 40)).first()[0] or 0
    side = F.broadcast if width <= BROADCAST_BYTES else (lambda df: df)
    good = (F.col("support") >= min_support) & (F.col("confidence") >= min_confidence)
    patterns = materialize(rate(edges.withColumn("belief", F.col("seed").cast("double")), damping), "pii-scores")
    accepted, mass = -1, 0.0
    for _ in range(rounds):
        now, total = patterns.agg(F.count(F.when(good, 1)), F.coalesce(F.sum("confidence"), F.lit(0.0))).first()
        if now == accepted and total <= 1.002 * mass:
            break
        accepted, mass = now, total
        vouched = patterns.withColumn("sure", F.when(good, F.col("confidence")).otherwise(0.0))
        joined = edges.join(side(vouched), "pattern")
        spread = 1 - F.exp(F.sum(F.log(1 - F.least(F.col("confidence"), F.lit(0.999)) / 2)))
        belief = F.when(F.max("seed") == 1, 1.0).otherwise(F.greatest(spread, F.max("sure")))
        instances = joined.groupBy("instance").agg(belief.alias("belief"))
        patterns = materialize(rate(edges.join(side(instances), "instance"), damping), "pii-scores")
    return materialize(patterns.where(good), "pii-patterns")


def outermost(spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Spans (start, kind, end) without those that lie inside another: a group of a number's digits is no number beside it."""
    out: list[tuple[int, int, int]] = []
    for span in sorted(set(spans), key=lambda s: (s[0], -s[2], s[1])):
        if not out or span[2] > out[-1][2]:
            out.append(span)
    return out


def contextual(text: str, base: list[tuple[int, int, int]]) -> Iterator[tuple[str, int, int, int]]:
    """(pattern, start, kind, end) of the candidates that no base span touches."""
    if "@" in text or DIGIT.search(text):
        taken = Taken(base)
        for kind, around, a, b in candidates(text):
            if not taken.touches(a, b):
                for words in around:
                    yield f"{kind}|{words}", a, KINDS.index(f"ctx_{kind}"), b


def scan(text: str, patterns: frozenset[str]) -> list[tuple[int, int, int]]:
    spans = base_spans(text)
    return spans + outermost([(a, k, b) for pattern, a, k, b in (contextual(text, spans) if patterns else ()) if pattern in patterns])


MET = "array<struct<start:bigint,kind:int,end:bigint>>"


def _by_join(docs: DataFrame, patterns: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """What scan finds, for patterns too many to broadcast: candidates travel to them. Equal rows share a key and are joined once."""
    kind = dict(docs.dtypes)[id_col]

    def start():
        def row(key, text):
            spans = base_spans(text or "")
            met = [{"pattern": p, "span": {"start": a, "kind": k, "end": b}} for p, a, k, b in contextual(text or "", spans)]
            own = blake2b(f"{key!r}\0{text or ''}".encode("utf-8", "surrogatepass"), digest_size=16).digest()
            return key, own, [{"start": a, "kind": k, "end": b} for a, k, b in spans], met

        return row

    schema = f"_id {kind}, key binary, base {MET}, met array<struct<pattern:string,span:struct<start:bigint,kind:int,end:bigint>>>"
    rows = materialize(map_rows(docs, [id_col, text_col], schema, start), "pii-rows")
    candidate = rows.where(F.size("met") > 0).select("key", F.inline("met")).distinct()
    marked = candidate.join(patterns.select("pattern"), "pattern").groupBy("key").agg(F.collect_set("span").alias("more"))
    # As outermost: a span that another holds is left out.
    held = lambda s, o: (o["start"] <= s["start"]) & (o["end"] >= s["end"]) & (o["end"] - o["start"] > s["end"] - s["start"])
    marked = marked.withColumn("more", F.filter("more", lambda s: ~F.exists("more", lambda o: held(s, o))))
    # Structs sort by start, then kind, then end.
    found = F.array_sort(F.concat("base", F.coalesce("more", F.array().cast(MET))))
    named = F.transform(found, lambda s: F.struct(F.get(F.array(*map(F.lit, KINDS)), s["kind"]).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return rows.join(marked, "key", "left").select(F.col("_id").alias(id_col), named.cast(SPANS).alias("found"))


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", in_memory: int = 20_000, **learning) -> DataFrame:
    """One row per input row: its id and `found`, the spans by start and kind (base kinds, then ctx_ kinds).

    Null and empty texts have no spans; an empty table learns no pattern and returns no row. A null id stays
    null, repeated rows each give a row and count once as evidence, other columns are ignored. All patterns
    that qualify apply: up to `in_memory` of them are broadcast, more are joined. Two reads of the texts;
    pattern-instance pairs are shuffled and, if patterns are joined, candidates and rows without their texts.
    """
    patterns = learn_patterns(docs, text_col, **learning)
    if patterns.count() > in_memory:
        return _by_join(docs, patterns, id_col, text_col)
    shared = docs.sparkSession.sparkContext.broadcast(frozenset(r.pattern for r in patterns.select("pattern").collect()))
    kind = dict(docs.dtypes)[id_col]
    return map_rows(docs, [id_col, text_col], f"`{id_col}` {kind}, found {SPANS}", lambda: lambda key, text: (key, span_list(scan(text or "", shared.value), KINDS)))
