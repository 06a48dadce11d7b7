"""Every operator against a brute-force version, on tricky rows and on the smallest shared tables."""

import hashlib
import itertools
import math
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest

from tallyspark.llm import chat, common, decontaminate, katz, line_dedup, near_dedup, packing, pii, quality, secrets, tokens
from tallyspark.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
WS = r"[\x20\x09-\x0D]"
AZ = str.maketrans(common.UPPER, common.LOWER)
PROSE = " ".join(f"word{i % 37}x{i}" for i in range(60))
TRICKY = [
    (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, PROSE), (6, PROSE.upper()), (7, PROSE + " tail"), (7, PROSE + " tail"),
    (8, "É è\n  A long enough line  \nß\x0b\n\na LONG enough line"), (9, "A long enough line\nÉ è\nother  text  "),
    (10, "password = hunter2hunter2, secret: token: abcdefghij AKIA" + "A1" * 9 + " " + "0f" * 20),
    (11, "mail a@b.com_x@c.de or 999.1.1.1 and 10.20.30.40, 4111 1111 1111 1111 1, 4111-1111-1111-1111 +49 (30) 123-456-78"),
    (12, "<|endoftext|> <|im_end|> \\ <| x\r\n"), (13, "long " * 6000), (None, PROSE), (14, "a b c d"), (15, "A B c d"), (16, "💡 ﬁ ▁x　y"),
]


@pytest.fixture(scope="module")
def docs(spark):
    """Extra columns have names that results and helpers use."""
    rows = [(i, t, "x", "n_words", 1) for i, t in TRICKY]
    return spark.createDataFrame(rows, "doc_id long, text string, found string, n_words string, key int")


@pytest.fixture(scope="module")
def texts(docs, spark):
    real = [(r.doc_id + 1000, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    return spark.createDataFrame(TRICKY + real, "doc_id long, text string").repartition(3), TRICKY + real


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string")


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def spans(text, forms):
    found = [(m.start(), k, m.end()) for k, (form, good) in enumerate(forms) for m in re.finditer(form, text or "") if good(m)]
    return sorted(found)


def base_digest(found, names):
    return hashlib.sha256(",".join(f"{names[k]}:{a}:{b}" for a, k, b in found).encode()).hexdigest()


def test_secrets(texts, docs, empty):
    either = "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token")) + "|[Aa][Pp][Ii]_?[Kk][Ee][Yy]"
    forms = [
        (rf"""({either})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= 8),
        (r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 16),
        (r"[0-9a-f]+", lambda m: len(m[0]) >= 32),
    ]
    df, rows = texts
    got = common.span_digest(secrets.find_secrets(df), "doc_id", ["assign", "access", "hex"]).collect()
    assert sorted((r.doc_id or 0, r.base_sha256) for r in got) == sorted((i or 0, base_digest(spans(t, forms), secrets.KINDS)) for i, t in rows)
    assert {r.doc_id: (r.n_assign, r.n_access, r.n_hex) for r in got}[10] == (1, 1, 1)
    assert secrets.find_secrets(docs).count() == len(TRICKY) and secrets.find_secrets(empty).count() == 0


def test_secrets_follow_assignments():
    text = 'raw = "Zx8!kQ2#vL9pTw"\nother = "hello world"\ndb_password = raw\nname: "Zx8!kQ2#vL9pTw1"\nclientSecret = "Ab3dE" + "f6hI9kLmNo"\napi_token = "changeme"'
    found = {text[a:b] for a, b in secrets.literal_spans(text)}
    assert found == {"Zx8!kQ2#vL9pTw", "Ab3dE", "f6hI9kLmNo"}


@pytest.mark.parametrize(
    "text",
    [
        '$db_pwd = "{}";',
        "$raw = '{}';\n$db_password = $raw;",
        'raw="{}"\nDB_PASSWORD=$raw',
        'cfg["db_pwd"] = "{}"',
        "cfg['db']['pwd'] = '{}'",
        'cfg["k"] = "{}"\npassword = cfg[\'k\']',
        'db_pwd: str = "{}"',
        'db_pwd: Optional[str] = "{}"',
        'let pwd: Option<Vec<u8>> = "{}"',
        "dbPwd?: string | null = '{}'",
        'let pwd: &str = "{}";',
        "let pwd: &'static str = \"{}\";",
        "x" * 80 + '_password = "{}"',
        'password: "{}"',
        "password: {}",
        'password = """{}"""',
        "password = '''{}'''",
        'password = ("{}")',
        'password = (\n    "{}"\n)',
        'password =\n    "{}"',
        'os.environ.setdefault("DB_PASSWORD", "{}")',
        '#define DB_PASSWORD "{}"',
        "<config><password>{}</password></config>",
        '<add key="dbPassword" value="{}"/>',
        '<db user="a" password="{}"/>',
        'base = "{}"\npassword = "${{base}}"',
        'base = "{}"\npassword = f"{{base}}"',
        'raw = "{}"\nconnect({{password: raw}})',
        'password = later\nlater = "{}"',
        "mysql --password {} --user x",
        "export DB_PASSWORD={}",
        'password = b"{}"',
        'it\'s so: password = "{}"',
        '{{"db": {{"password": "{}"}}}}',
        "[db]\npassword = {} ; note",
        "<config><password>" + " " * 5000 + "{}" + "\n" * 5000 + "</password></config>",
        "let pwd: " + "Option<Vec<" * 60 + "u8" + ">" * 120 + ' = "{}"',
        "password = " + " \t" * 300 + "{}",
        "password" + " " * 300 + ":" + " " * 300 + "'{}'",
    ],
)
def test_secret_names(text):
    value = "Zx8kQ2vL9pTw=4"
    text = text.format(value) if "{{" in text or "${" not in text else text.replace("{}", value)
    assert {text[a:b] for a, b in secrets.literal_spans(text)} == {value}


def test_secret_names_take_linear_time():
    started = time.process_time()
    for text in ("x" * 300_000, "x-" * 150_000, "a[b]" * 60_000, "a[" * 100_000, "a: b[" * 60_000, "$" * 200_000, "p: " + "T<" * 100_000, "a|b" * 60_000, "a: " * 90_000, "p: " + "a|" * 90_000, "p: " + "T<>" * 60_000, 'password = password + "k3jf8sXz"\n' * 20_000, 'password = password + "aaaaaaaa"\n' * 20_000, "\\\"" * 200_000, "\"'`" * 100_000, '"""' * 100_001, "<a>" * 100_000, "password:" * 60_000, "password = (" * 60_000, "password = a + " * 50_000, "<password>" * 60_000, "<password> " * 60_000 + "x", "password=" + " " * 200_000, "pwd = \t" * 80_000, "p:" + "a," * 100_000, "p:a," * 80_000):
        began = time.process_time()
        secrets.literal_spans("key " + text)
        assert time.process_time() - began < 6, text[:30]
    assert time.process_time() - started < 60


def test_secrets_that_are_none():
    for text in ('password = os.environ["DB_PASSWORD"]', 'password = getpass("Enter a password: ")', "the secret of success: working hard", 'token = get_token("production-8")', "author: Someone42Else8", 'password == "Zx8kQ2vL9pTw=4x"'):
        assert not secrets.literal_spans(text), text


def test_quality(texts, docs, empty):
    def brute(t):
        t = t or ""
        words = [w for w in re.split(WS, t) if w]
        windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
        hit = {j for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
        seen, dups = set(), 0
        for line in t.split("\n"):
            if re.sub(WS, "", line):
                dups += line in seen
                seen.add(line)
        failed = len(words) < 10 or 100 * len(hit) > 20 * len(words)
        return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), dups, len(hit), failed

    df, rows = texts
    got = quality.judge(df).collect()
    assert sorted(map(repr, (tuple(r)[:-1] for r in got))) == sorted(repr((i, *brute(t))) for i, t in rows)
    verdict = lambda t: not any(r.rejects(quality.Text(t)) for r in quality.RULES)
    assert sorted((r.doc_id or 0, r.kept) for r in got) == sorted((i or 0, verdict(t)) for i, t in rows)
    assert all(not (r.kept and r.base_failed) for r in got)
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns and kept.count() == sum(verdict(t) for _, t in TRICKY) and quality.keep_good(empty).count() == 0
    assert {r.name for r in quality.order_rules([PROSE, "x"])} == {r.name for r in quality.RULES}


@pytest.mark.parametrize("least", [2, 3])
def test_line_dedup(texts, docs, empty, least):
    df, rows = texts
    key = lambda line: re.sub(rf"^{WS}+|{WS}+$", "", line).translate(AZ)
    holders = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            if i is not None and len(key(line)) >= 10:
                holders[key(line)].add(i)
    want = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if i is None or len(holders.get(key(x), ())) < least or i == min(holders[key(x)])]
        want.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    assert rows_of(line_dedup.drop_repeated_lines(df, min_docs=least)) == sorted(want, key=repr)
    assert line_dedup.drop_repeated_lines(docs).columns == [*docs.columns, "n_lines", "n_dropped"]
    assert line_dedup.drop_repeated_lines(empty).count() == 0
    assert line_dedup.without_repeated_lines(docs).schema == docs.schema


def test_chat(spark):
    rows = [
        (1, 0, "system", "be <|im_end|> \\ <\\| good"), (1, 1, "user", None), (1, 2, "assistant", "ok <|im_start|>x"), (1, 3, "user", "more"), (1, 4, "assistant", "\n\\"),
        (2, 0, "user", "only"), (3, 0, "assistant", ""), (3, 0, "assistant", "tie"), (3, None, None, "first"), (None, 1, "assistant", "x"), (4, 1, "a\nb<|", "r"), (4, 1, "a\nb<|", "r"),
    ]
    df = spark.createDataFrame([(*r, "extra") for r in rows], "conv_id long, turn long, role string, text string, target string")
    examples = chat.expand(df)
    back = {r.conv_id: r for r in chat.read_back(examples).collect()}
    groups = defaultdict(list)
    for c, n, role, text in rows:
        groups[c].append((n is not None, n or 0, role or "", text or ""))
    assert back.keys() == groups.keys()
    for c, turns in groups.items():
        turns = [(r, t) for _, _, r, t in sorted(turns)]
        assert [tuple(t) for t in back[c].turns] == turns
        assert list(back[c].replies) == [t for r, t in turns if r == "assistant"]
    first = examples.where("conv_id = 1").orderBy("example").collect()
    assert len(first) == 2 and first[1].context.startswith(first[0].context + first[0].target)
    assert first[1].target == "\n\\\\" + chat.END
    assert chat.expand(df.limit(0)).count() == 0


def test_tokens(texts, docs, empty):
    from sentencepiece import SentencePieceProcessor

    sp = SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    df, rows = texts
    want = [(i, len((t or "").encode()), n := len(sp.encode(t or "")), n > 4096) for i, t in rows]
    assert rows_of(tokens.count_tokens(df)) == sorted(want, key=repr)
    assert tokens.count_tokens(docs).count() == len(TRICKY) and tokens.count_tokens(empty).count() == 0
    small = tokens.Lengths({}, public_tokenizers.path("piece_bpe_32k.model"), 3, False)
    assert [small[w] for w in ["aa", "bb", "cc", "dd", "aa", ""]] == [len(sp.encode(w)) for w in ["aa", "bb", "cc", "dd", "aa"]] + [1] and len(small) <= 3


def luhn(m):
    d = [int(c) for c in m[0] if c.isdigit()]
    return 14 <= len(d) <= 19 and sum(sum(divmod(2 * x, 10)) if i % 2 else x for i, x in enumerate(reversed(d))) % 10 == 0


def test_pii(texts, docs, empty):
    forms = [
        (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m[0].split("."))),
        (r"[0-9]([\x20-]?[0-9])+", luhn),
        (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= sum(c.isdigit() for c in m[0]) <= 15),
    ]
    df, rows = texts
    got = common.span_digest(pii.find_personal_data(df), "doc_id", ["email", "ip", "card", "phone"]).collect()
    assert sorted((r.doc_id or 0, r.base_sha256) for r in got) == sorted((i or 0, base_digest(spans(t, forms), pii.KINDS)) for i, t in rows)
    assert pii.find_personal_data(docs).count() == len(TRICKY) and pii.find_personal_data(empty).count() == 0


def test_pii_learns_contexts(spark):
    known = [(i, f"please call me {'+49301234' if i % 4 else '+1 (555) 010-'}{1000 + i} now") for i in range(40)]
    other = [(100 + i, f"we sold about {20000000 + i} units") for i in range(40)]
    new = [(200, "please call me 0301234567 now"), (201, "sold about 0301234567 units")]
    df = spark.createDataFrame(known + other + new, "doc_id long, text string")
    found = {r.doc_id: [(s.kind, s.start, s.end) for s in r.found] for r in pii.find_personal_data(df).collect()}
    assert found[200] == [("ctx_phone", 15, 25)] and found[201] == [] and all(not found[100 + i] for i in range(40))


def test_pii_applies_every_pattern(spark):
    """More patterns qualify than may be broadcast: all of them still mark."""
    known = [(10 * p + i, f"ring{p} desk +49301234{p}{100 + i} ok") for p in range(5) for i in range(10)]
    new = [(1000 + p, f"ring{p} desk 0307654{p}21 ok") for p in range(5)]
    rows = [*known, *new, *new, (None, "ring1 desk 0309999999 a@b.de ok"), (1, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    few, many = (rows_of(pii.find_personal_data(df, in_memory=n)) for n in (2, 100))
    assert few == many and len(few) == len(rows)
    assert [[s.kind for s in found] for i, found in few if i and i >= 1000] == [["ctx_phone"]] * 10
    assert next([s.kind for s in found] for i, found in few if i is None) == ["ctx_phone", "email"]


def test_pii_learns_from_other_patterns(spark):
    """No instance of "desk line" is a seed; each also stands in three seeded contexts."""
    rows = [f"{word} phone +493012345{100 + i} ok" for word in ("home", "work", "cell") for i in range(600)]
    rows += [f"{word} 0307654{100 + i} ok" for word in ("home phone", "work phone", "cell phone", "desk line") for i in range(30)] + ["desk line 0209999999 ok"]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    learned = {r.pattern: r for r in pii.learn_patterns(df).collect()}
    assert learned["phone|desk line"].support == 31 and learned["phone|desk line"].confidence > 0.7
    assert [[s.kind for s in r.found] for r in pii.find_personal_data(df).where(f"doc_id = {len(rows) - 1}").collect()] == [["ctx_phone"]]


@pytest.mark.parametrize(
    ("text", "kind", "before", "value"),
    [
        ("please call me 030 123 4567 now", "phone", "call me", "030 123 4567"),
        ("please call me (030) 123-4567, now", "phone", "call me", "(030) 123-4567"),
        ("pay by card 4111 1111 1111 1111 1.", "card", "by card", "4111 1111 1111 1111 1"),
        ("pay by card 4111 - 1111 - 1111 - 1112", "card", "by card", "4111 - 1111 - 1111 - 1112"),
        ("Phone: 0301234567", "phone", " phone:", "0301234567"),
        ("0301234567 is mine", "phone", "", "0301234567"),
        ("my " + "L" * 500 + " call 0301234567", "phone", "l" * 500 + " call", "0301234567"),
        ("call me" + " " * 300 + "0301234567", "phone", "call me", "0301234567"),
        ("call me 0301234567. 12 people", "phone", "call me", "0301234567"),
    ],
)
def test_pii_candidates(text, kind, before, value):
    assert (kind, before, value) in [(k, p[0], text[a:b]) for k, p, a, b in pii.candidates(text)]


@pytest.mark.parametrize(
    "text",
    ["1" * 5000 + ".1.1.1", "x" * 1_000_000, "x" * 500_000 + "7" + "y" * 500_000, "7" * 1_000_000, "1.2." * 250_000, "a@b.de " * 150_000, "a@" * 300_000, "+1 " * 300_000, "12 " * 300_000, "(" * 500_000 + "1", "[at]" * 200_000 + "@"],
    ids=lambda t: f"{t[:6]}-{len(t)}",
)
def test_pii_takes_linear_time(text):
    started = time.process_time()
    pii.scan(text, frozenset({"phone|x"}))
    assert time.process_time() - started < 6
    assert pii.base_spans("1" * 5000 + ".1.1.1 0000001.2.3.255") == [(5007, 1, 5022)]


def test_pii_iterates_until_no_pattern_is_new(spark):
    """A chain: each context shares its instances with the one before it and with the one after it alone; only the first has seeds."""
    rows, number = [f"link0 dial +4930{1000000 + i} ok{i}" for i in range(180)], 0
    for k, shared in enumerate((60, 12, 2)):
        for _ in range(shared):
            number += 1
            rows += [f"link{k} dial 0170{2000000 + number} go{number}", f"link{k + 1} dial 0170{2000000 + number} on{number}"]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    learned, once = ({r.pattern for r in pii.learn_patterns(df, min_confidence=0.55, damping=0.5, rounds=n).collect()} for n in (12, 1))
    assert {f"phone|link{k} dial" for k in range(3)} <= learned and "phone|link2 dial" not in once


def test_pii_learns_words_on_both_sides(spark):
    rows = [f"{'abcdefgh'[i % 8]}{i} ring +4930{1000000 + i} after six" for i in range(40)] + ["zz ring 0301234567 after six", "zz ring 0301234568 before six"]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    found = {r.doc_id: [s.kind for s in r.found] for r in pii.find_personal_data(df).collect()}
    assert found[40] == ["ctx_phone"] and found[41] == []


def test_pii_marks_grouped_numbers_once(spark):
    rows = [f"please call me +4930123{1000 + i} now" for i in range(40)] + ["please call me 030123 4567890 now", "Phone: 0301234567"]
    rows += [f"Phone: +4930123{2000 + i}" for i in range(40)]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    one, two = (rows_of(pii.find_personal_data(df, in_memory=n).where("doc_id in (40, 41)")) for n in (0, 100))
    assert one == two and [[(s.kind, s.start, s.end) for s in found] for _, found in one] == [[("ctx_phone", 15, 29)], [("ctx_phone", 7, 17)]]


def shingle_sets(rows, size):
    for i, t in rows:
        w = [x for x in re.split(WS, (t or "").translate(AZ)) if x]
        yield i, {tuple(w[j : j + size]) for j in range(max(1, len(w) - size + 1))} if w else set()


def brute_components(rows, size=4):
    sets = [(i, s) for i, s in shingle_sets(rows, size)]
    parent = {i: i for i, _ in sets if i is not None}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (i, a), (j, b) in itertools.combinations(sets, 2):
        if a and b and i is not None and j is not None and 100 * len(a & b) >= 80 * len(a | b):
            x, y = sorted((top(i), top(j)))
            parent[y] = x
    return sorted(((i, len(s), top(i) if i is not None else None, i is None or top(i) == i) for i, s in sets), key=repr)


def test_near_dedup(texts, docs, empty):
    df, rows = texts
    assert rows_of(near_dedup.near_duplicates(df, size=4)) == brute_components(rows)
    assert near_dedup.near_duplicates(empty).count() == 0
    kept = near_dedup.keep_one_each(docs)
    assert kept.schema == docs.schema and near_dedup.keep_one_each(empty).count() == 0
    assert near_dedup.keep_one_each(docs.withColumnRenamed("key", "_id")).columns == [*docs.columns[:-1], "_id"]
    assert {r.doc_id for r in kept.collect()} == {1, 2, 3, 4, 5, 8, 9, 10, 11, 12, 13, None, 14, 16}


def test_near_dedup_star_and_chain(spark):
    """Copies of one text that differ from each other by more than the threshold allows, and a chain of small steps."""
    rng = np.random.default_rng(3)
    base = [f"w{i}" for i in range(200)]
    rows = [(500, " ".join(base))]
    for k in range(60):
        words = list(base)
        for at in rng.choice(200, 4, replace=False):
            words[at] = f"m{k}x{at}"
        rows.append((k, " ".join(words)))
    for k in range(40):
        rows.append((1000 - k, " ".join(f"c{i}" for i in range(4 * k, 4 * k + 100))))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert rows_of(near_dedup.near_duplicates(df, size=4)) == brute_components(rows)


@pytest.mark.parametrize("n", [5, 10, 20, 40, 100, 200])
def test_minhash_links_sets_of_any_size(n):
    """At the threshold itself: sets of n and 4n/5 shingles share a band and pass the estimate."""
    rng = np.random.default_rng(n)
    limit = (0.8 - near_dedup.MARGIN) * 0.75 + 0.25
    lost = 0
    for _ in range(400):
        x = rng.integers(0, 2**63, n).astype(np.uint64)
        a, b = near_dedup.minima(x), near_dedup.minima(x[: 4 * n // 5])
        differ = near_dedup.packed(a).view(np.uint64) ^ near_dedup.packed(b).view(np.uint64)
        equal = 1 - np.bitwise_count((differ | differ >> np.uint64(1)) & np.uint64(0x5555555555555555)).sum() / near_dedup.HASHES
        lost += equal < limit or not (near_dedup.bands_of(a) == near_dedup.bands_of(b)).any()
    assert lost == 0


def test_near_dedup_of_short_texts(spark):
    """Texts of 8 to 23 words, each with a copy at exactly 0.8: a word less, or one more, at its end."""
    rng = np.random.default_rng(5)
    rows = []
    for k in range(150):
        words = [f"v{x}" for x in rng.integers(0, 10**9, 5 * (k % 4 + 1) + 3)]
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(words[: len(words) - (len(words) - 3) // 5]))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert rows_of(near_dedup.near_duplicates(df, size=4)) == brute_components(rows)


def test_minhash_places_rule_out_no_link(spark):
    """True links pass the bound at every size; sets of 60 and 150 at 0.7 of each other do not."""
    rng, made = np.random.default_rng(4), []
    for n in (1, 5, 60, 400, 1200, 5000):
        x = np.unique(rng.integers(0, 2**63, n + n // 4, np.uint64))
        for a, b in ((x, x[: -(-4 * len(x) // 5)]), (x[len(x) // 9 :], x[: len(x) - len(x) // 9])):
            both = len(np.intersect1d(a, b))
            assert n < 5 or 100 * both >= 77 * (len(a) + len(b) - both)
            made.append((100 * both >= 80 * (len(a) + len(b) - both), *((len(y), int(np.bitwise_count(near_dedup.places_of(y).view(np.uint64)).sum()), *near_dedup.places_of(y).tolist()) for y in (a, b))))
    side = "struct<n: long, filled: long, " + ", ".join(f"{w}: long" for w in near_dedup.FILLED) + ">"
    got = spark.createDataFrame(made, f"linked boolean, a {side}, b {side}").select("linked", near_dedup.may_link("a", "b", 80).alias("may")).collect()
    assert all(r.may for r in got if r.linked) and sum(r.linked for r in got) >= 6
    x = [np.unique(rng.integers(0, 2**63, n, np.uint64)) for n in (60, 150)]
    made = [(False, *((len(y), int(np.bitwise_count(near_dedup.places_of(y).view(np.uint64)).sum()), *near_dedup.places_of(y).tolist()) for y in (own, own[: 7 * len(own) // 10]))) for own in x]
    got = spark.createDataFrame(made, f"linked boolean, a {side}, b {side}").select(near_dedup.may_link("a", "b", 80).alias("may")).collect()
    assert not any(r.may for r in got)


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 60, 2)] + [(i, i + 2) for i in range(100, 140)] + [(7, 200)]
    roots = {r.node: r.root for r in near_dedup.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert roots[139] == 101 and roots[140] == 100 and roots[200] == 6 and roots[13] == 12


def az_words(text):
    return [w for w in re.split(WS, (text or "").translate(AZ)) if w]


def is_held_out(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2


class RawKatz:
    """Katz backoff again, from the texts: nothing of the operator's is used."""

    def __init__(self, rows):
        self.c1, self.after, pairs = Counter(), defaultdict(dict), Counter()
        for i, t in rows:
            if not is_held_out(i):
                own = ["", *az_words(t), ""]
                self.c1.update(own[1:])
                pairs.update(zip(own, own[1:], strict=False))
        self.total = sum(self.c1.values())
        self.p0 = sum(n == 1 for n in self.c1.values()) / self.total
        n = [sum(x == r for x in pairs.values()) for r in range(1, 7)]
        common = 6 * n[5] / n[0]
        absolute = [(r - 0.999 * n[0] / (n[0] + 2 * n[1])) / r for r in range(1, 6)]
        turing = [((r + 1) * n[r] / n[r - 1] / r - common) / (1 - common) if min(n) and common < 1 else -1 for r in range(1, 6)]
        good = all(n)
        self.d = [g if good and 0 < g < 1 else a for g, a in zip(turing, absolute, strict=True)]
        for (a, b), k in pairs.items():
            self.after[a][b] = k
        self.weight = {}
        for a, seen in self.after.items():
            whole = sum(seen.values())
            mass = sum(k * self.factor(k) for k in seen.values())
            whole += mass >= whole
            self.weight[a] = whole, (1 - mass / whole) / (1 - sum(map(self.one, seen)))

    def factor(self, k):
        return self.d[k - 1] if k <= 5 else 1

    def one(self, w):
        return (1 - self.p0) * self.c1[w] / self.total if self.c1[w] else self.p0

    def two(self, a, b):
        if a not in self.weight:
            return self.one(b)
        whole, alpha = self.weight[a]
        k = self.after[a].get(b)
        return k * self.factor(k) / whole if k else alpha * self.one(b)

    def score(self, text):
        own = ["", *az_words(text), ""]
        return sum(math.log10(self.two(a, b)) for a, b in zip(own, own[1:], strict=False))


@pytest.mark.parametrize("vocabulary", [65_533, 40, 0])
def test_katz(spark, texts, docs, empty, vocabulary):
    """What is numbered and how many parts there are changes no result."""
    df, rows = texts
    model = katz.train(df, vocabulary=vocabulary, tokens_per_part=20_000)
    assert len(model.classes.counts) <= vocabulary + 1 and model.layout.pairs > 1
    raw = RawKatz(rows)
    got = {(r.doc_id, r.n_tokens): r for r in katz.score(df, model).collect()}
    assert len(got) == len(rows) - 1  # one row is there twice
    for i, t in rows:
        own = [*az_words(t), ""]
        r = got[i, len(own)]
        assert (r.train_tokens, r.n_known, r.held_out) == (raw.total, sum(raw.c1[w] > 0 for w in own), is_held_out(i))
        assert r.base_score == pytest.approx(sum(math.log10((raw.c1[w] + 1) / (raw.total + len(raw.c1) + 1)) for w in own))
        assert r.score == pytest.approx(raw.score(t), rel=1e-9), i
    if vocabulary == 40:
        assert katz.score(docs, katz.train(docs)).count() == len(TRICKY)
        assert katz.score(empty, katz.train(empty)).count() == 0
        assert katz.score(docs, katz.train(empty)).count() == len(TRICKY)


@pytest.mark.parametrize("vocabulary", [65_533, 12, 0])
def test_katz_equals_a_model_from_raw_counts(spark, vocabulary):
    rng = np.random.default_rng(4)
    rows = [(i, " ".join(f"w{min(int(x), 60)}" for x in rng.zipf(1.4, rng.integers(0, 40)))) for i in range(200)]
    rows[7] = (7, "never seen before w1 w2")
    raw = RawKatz(rows)
    words = [*raw.c1, "unseen"]
    assert all(sum(raw.two(a, b) for b in words) == pytest.approx(1) for a in raw.after)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.score for r in katz.score(df, katz.train(df, vocabulary=vocabulary)).collect()}
    for i, t in rows:
        assert got[i] == pytest.approx(raw.score(t), rel=1e-9), i


def test_katz_blocks_of_equal_rows(spark):
    """Two blocks that hold the same rows have one name; each row still gets its own score, once."""
    rows = [(i, f"w{i} w{i + 1} w1") for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    model = katz.train(df, vocabulary=3)
    once = rows_of(katz.score(df, model))
    twice = rows_of(katz.score(df.unionByName(df), model))
    assert [r[:2] for r in twice] == [r[:2] for r in once for _ in range(2)]
    assert [r[-1] for r in twice] == pytest.approx([r[-1] for r in once for _ in range(2)])


def test_katz_beats_the_base_on_held_out_text(spark):
    rng = np.random.default_rng(1)
    follow = {w: [f"w{x}" for x in rng.integers(0, 300, 4)] for w in [f"w{i}" for i in range(300)]}
    rows = []
    for i in range(400):
        w, out = "w1", []
        for _ in range(80):
            w = follow[w][rng.integers(0, 4)]
            out.append(w)
        rows.append((i, " ".join(out)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    held = katz.score(df, katz.train(df)).where("held_out").selectExpr("sum(score) s", "sum(base_score) b").first()
    assert held.s > 0.4 * held.b


def test_decontamination(spark, docs, empty):
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    items = [(1, "The quick, brown fox jumps over the lazy dog and runs far away today"), (2, "short item É"), (3, None), (4, "!!"), (None, "x1 x2 x3 x4 x5 x6"), (5, "a a a a a a a a a a a"), (1, "second text of one id")]
    texts = [
        (1, "so THE quick brown-fox jumps over the lazy dog, and runs far"), (2, "quick brown fox jumps over the lazy dog and run"), (3, "short item É short item é"), (4, None), (5, ""),
        (6, "x1 x2 x3 x4 x5 x6 x1 x2 x3 x4 x5"), (7, "a " * 25), (7, "a " * 25), (7, "a b"), (None, "second text of one id and short item É"), (8, "brown fox jumps over the lazy dog and runs far"), (9, "word " * 20000 + "runs far away today"),
    ]
    real = [(r.doc_id + 1000, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    bench = [(r.item_id + 100, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    find = lambda t: re.findall(word, (t or "").translate(AZ))
    windows = defaultdict(set)
    for i, t in items + bench:
        w = find(t)
        for s in range(len(w) - min(10, len(w)) + 1 if w else 0):
            windows[tuple(w[s : s + min(10, len(w))])].add("null" if i is None else str(i))
    want = []
    sizes = {len(k) for k in windows}
    for i, t in texts + real:
        w, hit, ids = find(t), set(), set()
        for n in sizes:
            for s in range(len(w) - n + 1):
                if (k := tuple(w[s : s + n])) in windows:
                    hit |= set(range(s, s + n))
                    ids |= windows[k]
        want.append((i, len(w), len(hit), tuple(sorted(ids))))
    df = spark.createDataFrame(texts + real, "doc_id long, text string")
    benchmark = spark.createDataFrame(items + bench, "item_id long, text string")
    got = decontaminate.find_contamination(df, benchmark)
    assert sorted(((r.doc_id, r.n_words, r.n_hit, tuple(r["items"])) for r in got.collect()), key=repr) == sorted(want, key=repr)
    assert decontaminate.drop_contaminated(docs, benchmark).columns == docs.columns
    assert decontaminate.find_contamination(empty, benchmark).count() == 0
    assert {r.n_hit for r in decontaminate.find_contamination(df, benchmark.limit(0)).collect()} == {0}


def check_packing(pieces, rows, size=1024):
    from tokenizers import Tokenizer

    full = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter((i, tuple([*full.encode(t or "", add_special_tokens=False).ids, 0])) for i, t in rows)
    parts = defaultdict(list)
    windows = defaultdict(list)
    for r in pieces:
        assert len(r.ids) == 4 * r.length
        parts[r.doc_id].append(r)
        windows[r.sequence_id].append(r)
    for own in windows.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= size
    flat = Counter()
    for doc, own in parts.items():
        for key, copies in want.items():
            if key[0] == doc:
                pool = [r for r in own if r.doc_tokens == len(key[1])]
                got = sorted((r.start, bytes(r.ids)) for r in pool)
                ids = np.array(key[1], "<u4").tobytes()
                assert sum(r.length for r in pool) == sum(len(k[1]) * n for k, n in want.items() if k[0] == doc and len(k[1]) == len(key[1]))
                assert all(ids[4 * s : 4 * s + len(b)] == b for s, b in got) or copies == 0 or sum(k[0] == doc for k in want) > 1
                flat[key] += copies
    assert flat == want
    return windows


def test_packing(texts, docs, empty):
    df, rows = texts
    pieces = packing.pack(df, space=4, fan_in=2).collect()
    windows = check_packing(pieces, rows)
    used = sum(r.length for r in pieces)
    assert len(windows) <= used / 1024 + 5
    assert {tuple(r)[0] for r in packing.pack(docs).collect()} == {i for i, _ in TRICKY} and packing.pack(empty).count() == 0


PATHS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.mark.parametrize("paths", [PATHS, PATHS[:1]])
def test_packing_words_equal_whole_texts(paths):
    encode = packing.Encoder(*paths, size=50)
    rng = np.random.default_rng(7)
    alphabet = [" ", " ", "\n", "a", "the", "'s", "'", "1", "é", ".", "\t", "\r", "中", " ", "\x1c", "💡", "ǆ", "٣", "ж", "　", "\0", "w" * 70]
    for _ in range(4000):
        text = "".join(rng.choice(alphabet, rng.integers(0, 10)))
        assert encode(text)[:-4] == np.array(encode.opening.full.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), repr(text)


def test_packing_libraries_are_equal():
    """Both join the pair of lowest rank first, the one by a list of pairs, the other whatever gives a token.

    Suppose they agree up to a rank, and two neighbours give the token of that rank. No join has crossed the ends of
    these two, so their bytes alone would have come to the same two neighbours. If the token's bytes alone come out as
    the token, these are its listed pair. So it is enough that every token comes out as itself, that the
    vocabularies are equal and that words are split alike, which depends on each character's class alone.
    """
    import json

    full, plain = packing.load(*PATHS)
    with open(PATHS[0], encoding="utf-8") as f:
        model = json.load(f)["model"]
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
    raw = {t: bytes(byte[c] for c in t) for t in model["vocab"] if t != packing.SPECIAL}
    assert {raw[t]: i for t, i in model["vocab"].items() if t in raw} == plain._mergeable_ranks
    order = {tuple(m if isinstance(m, list) else m.split(" ")): i for i, m in enumerate(model["merges"])}
    assert all(model["vocab"][a + b] == 256 + i for (a, b), i in order.items())
    for token in raw:
        own = list(token)
        while len(own) > 1:
            at = min(range(len(own) - 1), key=lambda i: order.get((own[i], own[i + 1]), 10**9))
            assert (own[at], own[at + 1]) in order, token
            own[at : at + 2] = [own[at] + own[at + 1]]
    plain_chars = [c for c in map(chr, range(0x300)) if packing.PLAIN.match(c)]
    assert len(plain_chars) > 500
    for text in (f"a{c}a {c}a1{c}1 {c}1.{c}. {c}. {c} \n{c}\n'{c}s" for c in plain_chars):
        assert plain.encode_ordinary(text) == full.encode(text, add_special_tokens=False).ids, repr(text)


def test_pipeline_stage_by_stage(spark):
    import corpus_pipeline

    read = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r.doc_id: r.text for r in read.collect()}
    good = {i: t for i, t in rows.items() if not any(r.rejects(quality.Text(t)) for r in quality.RULES)}
    key = lambda line: re.sub(rf"^{WS}+|{WS}+$", "", line).translate(AZ)
    first = {}
    for i in sorted(good):
        for line in (good[i] or "").split("\n"):
            first.setdefault(key(line), i)
    lines = {i: "\n".join(x for x in (t or "").split("\n") if len(key(x)) < 10 or first[key(x)] == i) for i, t in good.items()}
    kept = {i: lines[i] for i, _, _, ok in brute_components(list(lines.items()), 5) if ok}
    find = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(AZ))
    windows = {tuple(w[s : s + 10]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect() for w in [find(r.text)] for s in range(max(1, len(w) - 9))}
    clean = {i: t for i, t in kept.items() if not any(tuple(w[s : s + 10]) in windows for w in [find(t)] for s in range(len(w) - 9))}
    pieces = corpus_pipeline.run(spark, SF).collect()
    check_packing(pieces, list(clean.items()))
    assert {r.doc_id for r in pieces} == set(clean) and 0 < len(clean) <= len(kept) <= len(good) < len(rows)


def test_pipeline_stages_on_odd_tables(spark):
    """Nulls in any column, empty and long texts, repeated rows, clashing extra columns and an empty table, stage by stage."""
    import corpus_pipeline

    schema = "doc_id long, text string, lang string, source string, n_chars long, _id string, n_words string, `key` int, found string"
    rows = [(i, t, None, None, None, "x", None, 1, "y") for i, t in TRICKY] + [(None, None, None, None, None, None, None, None, None)]
    odd = spark.createDataFrame(rows, schema)
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, odd, SF).collect()
        none = stage(spark, odd.limit(0), SF)
        assert none.count() == 0, name
        if name == "packing":
            assert sum(r.length for r in got if r.start == 0) > 0 and {r.doc_id for r in got} == {r[0] for r in rows}
            continue
        assert none.columns == odd.columns and {r.doc_id for r in got} <= {r[0] for r in rows}, name
        assert all(r["_id"] in ("x", None) and r["key"] in (1, None) for r in got), name
        if name == "quality_rules":
            assert all(r.text for r in got)
        elif name == "line_dedup":
            assert len(got) == len(rows)
        elif name == "minhash_near_dedup":
            assert sum(r.doc_id is None for r in got) == 2 and {1, 2, 3, 4} <= {r.doc_id for r in got}
        else:
            assert len(got) == len(rows)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for table in ("documents", "benchmark", "conversations"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    want = con.sql(ORACLE_SQL[name])
    columns = sorted(want.columns)
    got = QUERIES[name](spark, SF)
    assert sorted(got.columns) == columns
    assert rows_of(got.select(*columns)) == sorted(want.project(", ".join(columns)).fetchall(), key=repr)


def test_each_operator_has_its_query():
    assert [int(re.match(r"op(\d+)_", name)[1]) for name in QUERIES] == list(range(1, 14))
