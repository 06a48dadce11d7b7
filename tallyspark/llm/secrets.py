"""Secret scans by assignment-aware lexing.

A text is cut into tokens (strings of all quotings, names, operators), and these are parsed into name-literal pairs: assignments with
or without a type, keys of maps, subscripts, call arguments, macros, elements and attributes of markup, and options of a command
line. Constants propagate along names, whether they stand before or after their use, and a literal is scored by
the most sensitive name that it reaches. Every step takes time in proportion to the text.
"""

from __future__ import annotations

import bisect
import math
import re
from collections import Counter, defaultdict

from pyspark.sql import DataFrame

from .common import SPANS, map_rows, span_list

#: Fixed patterns of the base kinds.
ASSIGN = re.compile(
    r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
    r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex", "literal")

#: What a name must hold to be sensitive, with its weight.
SENSITIVE = {
    "password": 3, "passwd": 3, "pwd": 3, "passphrase": 3, "secret": 3, "secrets": 3, "apikey": 3, "token": 3,
    "credential": 3, "credentials": 3, "privatekey": 3, "auth": 2, "bearer": 2, "signature": 1, "salt": 1, "pass": 2,
}
QUALIFIED_KEY = {"api", "access", "private", "secret", "auth", "encryption", "signing", "master", "ssh"}
PLACEHOLDER = re.compile(r"(?i)^(?:x+|\*+|changeme|change_me|example|your[_-].*|placeholder|none|null|true|false|undefined|todo|redacted|<.*>|\$\{.*|%\(.*|\{\{.*)$")

#: Cheap test of a whole text: without one of these there is no sensitive name.
HINTS = ("pass", "pwd", "secret", "token", "key", "credential", "auth", "bearer", "signature", "salt")
TOKEN = re.compile(r"""[A-Za-z_$][\w.$-]*+|["'`]|=>|:=|[=!<>]=|[0-9][\w.]*+|[=:+\[\](){}<>,#?|&\n]""")
STRINGS = {q: re.compile(rf"{q}(?:[^{q}\\\n]|\\.)*+{q}") for q in "\"'"} | {"`": re.compile(r"`[^`]*+`")}
ROOM = re.compile(r"[ \t]*+")
BARE = re.compile(r"""[^\s"'`,;()\[\]{}<>#]++""")
IDENTIFIER = re.compile(r"\$?\{?([A-Za-z_][\w.$]*)\}?$")
INSERTED = re.compile(r"\$\{([A-Za-z_][\w.]*)\}|\$([A-Za-z_]\w*)|#\{([A-Za-z_]\w*)\}|\{([A-Za-z_][\w.]*)\}|%\(([A-Za-z_]\w*)\)s")
STRING_PREFIX = {"r", "b", "f", "u", "R", "B", "F", "U", "rb", "br", "fr", "rf", "L", "N", "E", "@"}
#: Calls whose argument is their value.
WRAPPERS = {"str", "String", "bytes", "Some", "SecretStr", "string", "new", "quote", "String.from", "std.string"}
TYPE_OPS = set("[]<>|&?,")
SEGMENT = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")


def name_weight(name: str) -> int:
    parts = [p.lower() for p in SEGMENT.findall(name)]
    weight = max((SENSITIVE.get(p, 0) for p in parts + ["".join(parts[i : i + 2]) for i in range(len(parts) - 1)]), default=0)
    if parts and parts[-1] in ("key", "keys") and QUALIFIED_KEY & set(parts[:-1]):
        weight = max(weight, 3)
    return weight


def tokens_of(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end): "str" (the content, without quotes), "name", "num", or the operator itself."""
    out, at, dead, closed = [], 0, dict.fromkeys("\"'`", 0), {'"': True, "'": True}
    while m := TOKEN.search(text, at):
        a, at = m.span()
        c = text[a]
        if c in dead:
            if c != "`" and text.startswith(c * 3, a) and closed[c]:
                end = text.find(c * 3, a + 3)
                closed[c] = end >= 0
                if end >= 0:
                    out.append(("str", a + 3, end))
                    at = end + 3
                    continue
            if a >= dead[c]:
                if q := STRINGS[c].match(text, a):
                    out.append(("str", a + 1, q.end() - 1))
                    at = q.end()
                    continue
                end = text.find("\n", a) if c != "`" else -1
                dead[c] = end if end >= 0 else len(text)  # no such string is closed before there
        elif c.isalpha() or c in "_$":
            out.append(("name", a, at))
        elif c.isdigit():
            out.append(("num", a, at))
        else:
            out.append((m[0], a, at))
    return out


class Pairs:
    """The pairs of one text: a name, the literals of its value and the names that the value refers to."""

    def __init__(self, text: str):
        self.text, self.tokens = text, tokens_of(text)
        self.found: list[tuple[str, list[tuple[int, int]], list[str]]] = []
        self.read = 0  # the end of the last bare value, inside which no pair begins
        self.next_tag = -1  # the place of the last < that was searched for
        for i in range(len(self.tokens)):
            self.visit(i)

    def kind(self, i: int) -> str:
        return self.tokens[i][0] if i < len(self.tokens) else ""

    def word(self, i: int) -> str:
        return self.text[self.tokens[i][1] : self.tokens[i][2]] if i < len(self.tokens) else ""

    def subscripts(self, i: int) -> tuple[str, int]:
        """The text of the subscripts from token i on, and the token after them."""
        out = ""
        while self.kind(i) == "[" and self.kind(i + 1) in ("str", "name", "num") and self.kind(i + 2) == "]":
            out += f"[{self.word(i + 1)}]"
            i += 3
        return out, i

    def visit(self, i: int) -> None:
        kind, a, b = self.tokens[i]
        if a < self.read:
            return
        if kind == "(" and self.kind(i + 1) == "str" and self.kind(i + 2) == ",":
            self.value(self.word(i + 1), i + 3)
        elif kind == "<" and self.kind(i + 1) == "name" and self.kind(i + 2) == ">":
            start = self.tokens[i + 2][2]
            if self.next_tag < start:  # each stretch of the text is searched once
                end = self.text.find("<", start)
                self.next_tag = end if end >= 0 else len(self.text) + 1
            end = self.next_tag
            if start < end < len(self.text) and name_weight(self.word(i + 1)):
                body = self.text[start:end]
                self.add(self.word(i + 1), [(start + len(body) - len(body.lstrip()), end - len(body) + len(body.rstrip()))], [])
        elif kind == "#" and self.word(i + 1) == "define" and self.kind(i + 2) == "name":
            self.value(self.word(i + 2), i + 3)
        elif kind in ("name", "str"):
            name, at = self.word(i), i + 1
            if kind == "name":
                more, at = self.subscripts(at)
                name += more
            if self.kind(at) == "?":
                at += 1
            op = self.kind(at)
            if op in ("=", ":=", "=>"):
                if name in ("key", "name") and self.kind(at + 1) == "str" and self.word(at + 2) in ("value", "content") and self.kind(at + 3) == "=":
                    name, at = self.word(at + 1), at + 3
                self.value(name, at + 1)
            elif op == ":":
                self.value(name, self.after_type(at + 1) or at + 1)
            elif kind == "name" and self.text.startswith("--", a - 2) and self.text[b : b + 1] == " ":
                self.value(name, at)

    def after_type(self, i: int) -> int | None:
        """The token after the = that follows a type, if a type and = follow on the line. No colon is of a type, so that no token is looked at for two pairs."""
        for at in range(i, len(self.tokens)):
            kind = self.kind(at)
            if kind == "=":  # in a bare value there is no room around it
                return at + 1 if at > i and (self.text[self.tokens[at][1] - 1].isspace() or self.kind(at + 1) == "str") else None
            if kind != "name" and kind not in TYPE_OPS and not (kind == "num" and at > i):
                return None
            if kind == "," and at == i:
                return None
        return None

    def value(self, name: str, i: int) -> None:
        """Reads the value from token i on: strings, names and bare words, joined by + or one after the other."""
        literals: list[tuple[int, int]] = []
        refs: list[str] = []
        start = self.tokens[i - 1][2]
        bare = BARE.match(self.text, ROOM.match(self.text, start).end())
        if bare and not (self.kind(i) == "name" and self.kind(i + 1) in ("str", "[", "(")) and not (self.kind(i) == "name" and IDENTIFIER.match(bare[0])):
            self.add(name, [bare.span()], [])
            self.read = bare.end()
            return
        while self.kind(i) in ("\n", "(", "{", "[") and self.kind(i + 1) in ("str", "\n", "(", "name"):
            if self.kind(i) == "\n" and self.kind(i + 1) not in ("str", "\n", "("):
                break
            i += 1
        while True:
            kind = self.kind(i)
            if kind == "str":
                self.string(i, literals, refs)
                i += 1
            elif kind == "name" and self.kind(i + 1) == "str" and self.word(i) in STRING_PREFIX:
                i += 1
                continue
            elif kind == "name" and self.kind(i + 1) == "(":
                if self.word(i) not in WRAPPERS:
                    break
                i += 2
                continue
            elif kind == "name":
                a, b = self.tokens[i][1:]
                more, i = self.subscripts(i + 1)
                refs.append(self.text[a:b] + more)
                if not more:
                    literals.append((a, b))
            else:
                break
            while self.kind(i) in ("\n", ")") and self.kind(i + 1) in ("+", "str") and kind == "str":
                i += 1
            if self.kind(i) == "+":
                i += 1
                while self.kind(i) == "\n":
                    i += 1
            elif self.kind(i) != "str" or kind != "str":
                break
        if literals or refs:
            self.add(name, literals, refs)

    def string(self, i: int, literals: list, refs: list) -> None:
        a, b = self.tokens[i][1:]
        rest = b - a
        for m in INSERTED.finditer(self.text, a, b):
            refs.append(next(filter(None, m.groups())))
            rest -= len(m[0])
        if rest > 0:
            literals.append((a, b))

    def add(self, name: str, literals: list[tuple[int, int]], refs: list[str]) -> None:
        self.found.append((plain_name(name), literals, [plain_name(r) for r in refs]))


def plain_name(name: str) -> str:
    """A name as constants are looked up by."""
    return name.lstrip("$")


class Look:
    """What literal_score needs of a value, so that joined values add up."""

    def __init__(self, counts: Counter, starts_plain: bool = True):
        self.counts, self.plain = counts, starts_plain

    def score(self) -> float:
        n = self.counts.total()
        if n < 8 or not self.plain or any(c.isspace() for c in self.counts):
            return 0.0
        entropy = -sum(k / n * math.log2(k / n) for k in self.counts.values())
        classes = any(c.isdigit() for c in self.counts) + any(c.islower() for c in self.counts) + any(c.isupper() for c in self.counts) + any(not c.isalnum() for c in self.counts)
        return min(1.0, n / 16) + min(1.0, entropy / 3.5) + (classes - 1) / 3


def literal_score(value: str) -> float:
    """0 for what can't be a secret, else up to 3: length, entropy and mix of character classes."""
    return Look(Counter(value), not PLACEHOLDER.match(value)).score()


def literal_spans(text: str, threshold: float = 4.5) -> set[tuple[int, int]]:
    """Literals whose sensitive target name and own look, alone or joined with the others of the value, score at least threshold."""
    lower = text.lower()
    if not any(hint in lower for hint in HINTS):
        return set()
    pairs = Pairs(text).found
    where: dict[str, list[int]] = defaultdict(list)
    for k, (name, _, _) in enumerate(pairs):
        where[name].append(k)

    def definition(name: str, k: int) -> int | None:
        """The last pair of that name before pair k, or else the first after it."""
        at = bisect.bisect_left(own, k) if (own := where.get(name)) else 0
        return own[at - 1] if own and at else next((x for x in own[at:] if x != k), None) if own else None

    sources: list[list[int]] = []
    literals: list[list[tuple[int, int]]] = []
    joined: list[Counter] = []
    for k, (_, spans, refs) in enumerate(pairs):
        # An element of a map that has no pair of its own stands for the map.
        met = {r: d for r in refs if (d := definition(r, k)) is not None or (d := definition(r.partition("[")[0], k)) is not None}
        sources.append(sorted(set(met.values())))
        literals.append([(a, b) for a, b in spans if text[a:b].lstrip("$") not in met])
        total = Counter()
        for a, b in literals[-1]:
            total.update(text[a:b])
        for d in sources[-1]:
            total.update(joined[d] if d < k else Counter(text[a:b] for a, b in pairs[d][1]))
        joined.append(total)

    found: set[tuple[int, int]] = set()
    alone, together = [0] * len(pairs), [False] * len(pairs)
    for k, (name, _, _) in enumerate(pairs):
        weight = name_weight(name)
        if not weight:
            continue
        several = len(literals[k]) + len(sources[k]) > 1 and weight + Look(joined[k]).score() >= threshold
        stack = [k]
        while stack:
            d = stack.pop()
            if alone[d] >= weight and (together[d] or not several):
                continue
            alone[d], together[d] = max(alone[d], weight), together[d] or several
            found.update((a, b) for a, b in literals[d] if several and b - a >= 4 or (score := literal_score(text[a:b])) and weight + score >= threshold)
            stack += sources[d]
    return found


def scan(text: str) -> list[tuple[int, int, int]]:
    """All spans of one text as (start, kind, end), code points."""
    spans = []
    if "=" in text or ":" in text:
        spans += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    spans += [(a, 3, b) for a, b in literal_spans(text)]
    if "AKIA" in text:
        spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    return spans + [(m.start(), 2, m.end()) for m in HEX.finditer(text)]


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: its id, spans by kind (array of kind, start, end) in `found`, sorted by start and kind.

    Null and empty texts have no spans. A null id stays null; repeated rows each give a row; other columns are
    ignored, whatever their names. No shuffle and no state: each text is read once, in its own task.
    """

    kind = dict(docs.dtypes)[id_col]
    return map_rows(docs, [id_col, text_col], f"`{id_col}` {kind}, found {SPANS}", lambda: lambda key, text: (key, span_list(scan(text or ""), KINDS)))
