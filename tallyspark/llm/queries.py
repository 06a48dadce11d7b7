"""Queries of the training-data operators, with DuckDB SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, common, decontaminate, divergence, exact_dedup, importance, katz, line_dedup, near_dedup, packing, pii, quality, secrets, tokens


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def secrets_query(spark, sf_dir):
    return common.span_digest(secrets.find_secrets(_read(spark, sf_dir, "documents")), "doc_id", ["assign", "access", "hex"])


def quality_query(spark, sf_dir):
    return quality.judge(_read(spark, sf_dir, "documents"))


def lines_query(spark, sf_dir):
    out = line_dedup.drop_repeated_lines(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def chat_query(spark, sf_dir):
    turns = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    planted = spark.createDataFrame([(-1, i, role, f"{chat.END}{chat.START}assistant ok") for i, role in enumerate(("user", "assistant"))], turns.schema)
    back = chat.read_back(chat.expand(turns.unionByName(planted)))
    joined = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("replies", "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(joined, 256).alias("turns_sha256"),
        F.char_length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        "formatted_chars",
    )


def tokens_query(spark, sf_dir):
    return tokens.count_tokens(_read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def pii_query(spark, sf_dir):
    return common.span_digest(pii.find_personal_data(_read(spark, sf_dir, "documents")), "doc_id", ["email", "ip", "card", "phone"])


def minhash_query(spark, sf_dir):
    return near_dedup.near_duplicates(_read(spark, sf_dir, "documents"), size=4)


def katz_query(spark, sf_dir):
    docs = _read(spark, sf_dir, "documents")
    return katz.score(docs, katz.train(docs))


def decontamination_query(spark, sf_dir):
    found = decontaminate.find_contamination(_read(spark, sf_dir, "documents").select("doc_id", "text"), _read(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def packing_query(spark, sf_dir):
    packed = packing.pack(_read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def importance_query(spark, sf_dir):
    ranks = importance.resampling_ranks(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))
    return ranks.select("doc_id", "n_features", "weight", "score", "rank")


def divergence_query(spark, sf_dir):
    return divergence.source_divergence(_read(spark, sf_dir, "documents"))


def copies_query(spark, sf_dir):
    digest = F.sha2(exact_dedup.normalised(F.col("text")), 256)  # before the join, so that no text is shuffled
    marked = exact_dedup.mark_copies(_read(spark, sf_dir, "documents").select("doc_id", "text", digest.alias("text_sha256")))
    return marked.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


QUERIES = {
    "op1_secrets": secrets_query,
    "op2_quality_rules": quality_query,
    "op3_line_dedup": lines_query,
    "op4_chat_format": chat_query,
    "op5_token_counts": tokens_query,
    "op6_personal_data": pii_query,
    "op7_minhash": minhash_query,
    "op8_katz": katz_query,
    "op9_decontamination": decontamination_query,
    "op10_packing": packing_query,
    "op11_importance": importance_query,
    "op12_divergence": divergence_query,
    "op13_exact_dedup": copies_query,
}

_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_TRIM = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

_WORDS = r"[^\x20\x09-\x0D]+"

ORACLE_SQL = {
    "op2_quality_rules": rf"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_WORDS}') AS w FROM documents),
        f AS (SELECT doc_id, len(w) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars, length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
                     strlen(regexp_replace(t, '[\x00-\x40\x5B-\x60\x7B-\x7F]', '', 'g')) AS letters, strlen(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS bytes, len(string_split(t, chr(10))) AS n_lines FROM d),
        l AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, '{_WORDS}') GROUP BY 1),
        v AS (SELECT doc_id, s, list_aggregate(w[s:s + 4], 'string_agg', ' ') AS win FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS s FROM d)),
        m AS (SELECT doc_id, s, count(*) OVER (PARTITION BY doc_id, win) AS k FROM v),
        h AS (SELECT doc_id, count(DISTINCT place) AS n_repeat_words FROM (SELECT doc_id, unnest(range(s, s + 5)) AS place FROM m WHERE k > 1) GROUP BY 1),
        u AS (SELECT doc_id, count(*) AS n_stutters FROM (SELECT doc_id, w, unnest(range(2, len(w) + 1)) AS i FROM d) WHERE w[i] = w[i - 1] GROUP BY 1),
        a AS (SELECT f.*, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_stutters, 0) AS n_stutters FROM f LEFT JOIN l USING (doc_id) LEFT JOIN h USING (doc_id) LEFT JOIN u USING (doc_id)),
        b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM a)
        SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
               NOT base_failed AND 10 * n_symbols <= 3 * n_words AND word_chars BETWEEN 2 * n_words AND 15 * n_words AND 10 * n_dup_lines <= 7 * n_lines AND 2 * letters >= bytes AND 10 * n_stutters <= 3 * n_words AS kept FROM b""",
    "op7_minhash": rf"""
        WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_AZ}), '{_WORDS}') AS w FROM documents),
        g AS (SELECT DISTINCT doc_id, list_aggregate(w[s:s + 3], 'string_agg', ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 2))) AS s FROM d WHERE len(w) > 0)),
        n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY 1),
        p AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS m FROM g a JOIN g b ON a.k = b.k AND a.doc_id < b.doc_id GROUP BY ALL),
        l AS (SELECT u, v FROM p JOIN n a ON u = a.doc_id JOIN n b ON v = b.doc_id WHERE 100 * m >= 80 * (a.n + b.n - m)),
        e AS (SELECT u, v FROM l UNION ALL SELECT v, u FROM l),
        r AS (SELECT doc_id AS node, doc_id AS reached FROM n UNION SELECT r.node, e.v FROM r JOIN e ON r.reached = e.u),
        c AS (SELECT node, min(reached) AS component FROM r GROUP BY 1)
        SELECT d.doc_id, coalesce(n, 0) AS n_shingles, coalesce(component, d.doc_id) AS component_id, coalesce(component, d.doc_id) = d.doc_id AS kept FROM d LEFT JOIN n ON d.doc_id = n.doc_id LEFT JOIN c ON c.node = d.doc_id""",
    "op3_line_dedup": f"""
        WITH lines AS (
            SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                   unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos FROM documents),
        keyed AS (SELECT *, translate(trim(line, {_TRIM}), {_AZ}) AS key FROM lines),
        common AS (SELECT key, min(doc_id) AS first FROM keyed WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) > 1),
        marked AS (SELECT k.*, c.first IS NOT NULL AND k.doc_id <> c.first AS gone FROM keyed k LEFT JOIN common c USING (key))
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
        FROM marked GROUP BY doc_id""",
    "op4_chat_format": """
        WITH rows AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
            UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
        sized AS (SELECT *, length(replace(replace(role, chr(92), chr(92) || chr(92)), '<|', '<' || chr(92) || '|'))
                          + length(replace(replace(text, chr(92), chr(92) || chr(92)), '<|', '<' || chr(92) || '|')) + 32 AS chars,
                         row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC, text DESC) = 1 AS last FROM rows),
        summed AS (SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING) AS upto FROM sized)
        SELECT conv_id, count(*) AS n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
               CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
               CAST(sum(upto) FILTER (role = 'assistant' OR last) AS BIGINT) AS formatted_chars
        FROM summed GROUP BY conv_id""",
    "op9_decontamination": rf"""
        WITH docs AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_AZ}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
        items AS (SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(coalesce(text, ''), {_AZ}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark),
        sized AS (SELECT *, least(10, len(words)) AS size FROM items WHERE len(words) > 0),
        windows AS (SELECT DISTINCT item_id, size, list_aggregate(words[s:s + size - 1], 'string_agg', ' ') AS window
                    FROM (SELECT *, unnest(range(1, len(words) - size + 2)) AS s FROM sized)),
        sizes AS (SELECT DISTINCT size FROM windows),
        places AS (SELECT doc_id, s, size, list_aggregate(words[s:s + size - 1], 'string_agg', ' ') AS window
                   FROM (SELECT doc_id, words, size, unnest(range(1, len(words) - size + 2)) AS s FROM docs, sizes WHERE len(words) >= size)),
        hits AS (SELECT doc_id, s, p.size, item_id FROM places p JOIN windows w ON p.window = w.window AND p.size = w.size),
        covered AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + size)) AS pos FROM hits) GROUP BY doc_id),
        named AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id)
        SELECT doc_id, len(words) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
               sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM docs LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)""",
    "op11_importance": rf"""
        WITH tab AS (SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
        docs AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_AZ}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
        aim AS (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), {_AZ}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM benchmark),
        counted AS (SELECT doc_id, w, count(*) AS n FROM (SELECT doc_id, unnest(words) AS w FROM docs) GROUP BY ALL),
        vocabulary AS (SELECT w FROM counted UNION SELECT w FROM aim),
        bytes AS (SELECT w, list_transform(range(strlen(w)), lambda i: CAST('0x' || substr(hex(encode(w)), 2 * i + 1, 2) AS BIGINT)) AS b FROM vocabulary),
        hashed AS (SELECT w, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), b), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) % 10000 AS bucket FROM bytes, tab),
        s AS (SELECT bucket, sum(n) AS n FROM counted JOIN hashed USING (w) GROUP BY 1),
        t AS (SELECT bucket, count(*) AS n FROM aim JOIN hashed USING (w) GROUP BY 1),
        sizes AS (SELECT (SELECT coalesce(sum(n), 0) FROM s) AS s_all, (SELECT count(*) FROM aim) AS t_all),
        gains AS (SELECT s.bucket, CAST(floor(1000 * ln(CAST(coalesce(t.n, 0) + 1 AS DOUBLE) * CAST(s_all + 10000 AS DOUBLE) / (CAST(s.n + 1 AS DOUBLE) * CAST(t_all + 10000 AS DOUBLE)))) AS BIGINT) AS gain FROM s LEFT JOIN t ON s.bucket = t.bucket, sizes),
        sums AS (SELECT doc_id, CAST(sum(n * gain) AS BIGINT) AS total FROM counted JOIN hashed USING (w) JOIN gains USING (bucket) GROUP BY 1),
        scored AS (SELECT doc_id, len(words) AS n_features, CASE WHEN len(words) = 0 THEN 0 ELSE (total - ((total % len(words)) + len(words)) % len(words)) // len(words) END AS weight,
                          CAST('0x' || substr(sha256('2024:' || doc_id), 1, 8) AS BIGINT) AS h FROM docs LEFT JOIN sums USING (doc_id)),
        noisy AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + 0.5) / CAST(4294967296 AS DOUBLE)))) AS BIGINT) AS score FROM scored),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS place, 10 * count(*) OVER (PARTITION BY n_features >= 20) // 100 AS wanted FROM noisy)
        SELECT doc_id, CAST(n_features AS BIGINT) AS n_features, CAST(weight AS BIGINT) AS weight, CAST(score AS BIGINT) AS score, CASE WHEN n_features >= 20 AND place <= wanted THEN place END AS rank FROM ranked""",
    "op12_divergence": rf"""
        WITH d AS (SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(translate(coalesce(text, ''), {_AZ}), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS words FROM documents),
        c AS (SELECT row, lang, source, term, count(*) AS n FROM (SELECT row, lang, source, unnest(words) AS term FROM d) GROUP BY ALL),
        kept AS (SELECT lang, term, sum(n) AS total FROM c GROUP BY ALL HAVING count(*) >= 30),
        k AS (SELECT lang, source, term, sum(n) AS n FROM c SEMI JOIN kept USING (lang, term) GROUP BY ALL),
        l AS (SELECT lang, count(*) AS terms, sum(total) AS size FROM kept GROUP BY 1),
        g AS (SELECT lang, source, coalesce(sum(n), 0) AS size FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN k USING (lang, source) GROUP BY ALL),
        p AS (SELECT g.lang, g.source, kept.term, coalesce(k.n, 0) AS n, 1 + CAST(1000000000 AS HUGEINT) * CAST(coalesce(k.n, 0) + 5 AS HUGEINT) // CAST(g.size + 5 * l.terms AS HUGEINT) AS p,
                     1 + CAST(1000000000 AS HUGEINT) * CAST(kept.total + 5 AS HUGEINT) // CAST(l.size + 5 * l.terms AS HUGEINT) AS q
              FROM g JOIN l USING (lang) JOIN kept USING (lang) LEFT JOIN k ON k.lang = g.lang AND k.source = g.source AND k.term = kept.term),
        apart AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
        pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN apart ON apart.lang = a.lang AND apart.source = a.source AND apart.item = b.source),
        both_parts AS (SELECT * FROM pairs UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q),
        r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS rank FROM both_parts)
        SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM r WHERE part = 'pair' OR rank <= 50""",
    "op13_exact_dedup": rf"""
        WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
        g AS (SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM d JOIN g USING (t)""",
}
