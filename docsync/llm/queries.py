"""The registered queries of the corpus operators, each over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from docsync.llm import (
    balance,
    divergence,
    exact,
    jaccard,
    licenses,
    mixing,
    packing,
    pii,
    quality,
    substrings,
    tokens,
    trie,
    warc,
)

Query = Callable[[SparkSession, str], DataFrame]
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
# A real key comes from a secret store; this one only makes runs agree.
PSEUDONYM_KEY = "not-a-secret"

# The columns of the given tables; stating them saves a job per read.
SCHEMAS = {
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "labels": "doc_id bigint, quality int, toxic int",
    "pages": "page_id bigint, url string, html string",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def op1_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = mixing.mix(table(spark, sf_dir, "documents"))
    return mix.select("doc_id", "size", "source_size", "target", "taken")


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_groups(table(spark, sf_dir, "documents"))


def op3_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.pseudonymise(table(spark, sf_dir, "documents"), PSEUDONYM_KEY)
    return found.select("doc_id", "n_private", "kinds", "text")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts that an earlier run stored are joined; only texts that none has met are encoded."""
    return tokens.token_counts(table(spark, sf_dir, "documents"), TOKENIZER, tokens.kept_cache(spark))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_groups(table(spark, sf_dir, "documents"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_documents(table(spark, sf_dir, "documents"), TOKENIZER)


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.repeated_passages(table(spark, sf_dir, "documents")).drop("rk")


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_verdicts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(table(spark, sf_dir, "conversations"))


def op12_cost_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return balance.balanced_packing(table(spark, sf_dir, "documents"), TOKENIZER)


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.source_divergence(table(spark, sf_dir, "documents"))


REGISTRY: dict[str, Query] = {
    "op1_mix": op1_mix,
    "op2_ngram_jaccard": op2_ngram_jaccard,
    "op3_pseudonyms": op3_pseudonyms,
    "op4_token_counts": op4_token_counts,
    "op5_license_scan": op5_license_scan,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_packing": op7_packing,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_warc": op9_warc,
    "op10_quality_rules": op10_quality_rules,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_cost_packing": op12_cost_packing,
    "op13_source_divergence": op13_source_divergence,
}
# The others keep hash-random orders, tokenizer ids, models or keyed permutations, which SQL
# cannot express; tests compare them with brute force.
ORACLE: dict[str, str] = {
    "op2_ngram_jaccard": r"""
        WITH RECURSIVE words AS (
            SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''),
                'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
            FROM documents),
        shingles AS MATERIALIZED (
            SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 4), ' ') AS s
            FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM words WHERE len(w) > 0)),
        sizes AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM shingles GROUP BY ALL),
        links AS MATERIALIZED (
            SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared
                FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY ALL)
            JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b
            WHERE 100 * shared >= 75 * (p.n + q.n - shared)),
        reach AS (SELECT doc_id, doc_id AS other FROM documents
            UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.other)
        SELECT d.doc_id, coalesce(any_value(s.n), 0) AS n_shingles, min(r.other) AS component_id
        FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id JOIN reach r ON r.doc_id = d.doc_id
        GROUP BY d.doc_id""",
    "op6_exact_dedup": r"""
        SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
            doc_id = first_value(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
        FROM (SELECT doc_id, coalesce(text, '') AS text,
            regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents)
        WINDOW w AS (PARTITION BY norm ORDER BY length(text) DESC, doc_id)""",
    "op9_warc": """
        SELECT page_id, strlen(html) AS payload_bytes, sha256(html) AS payload_digest,
            CASE WHEN page_id = first OR strlen(html) < 100 THEN 'response' ELSE 'revisit' END AS record_type,
            CASE WHEN page_id <> first AND strlen(html) >= 100 THEN first END AS refers_to
        FROM (SELECT page_id, html, min(page_id) OVER (PARTITION BY html) AS first
            FROM (SELECT page_id, coalesce(html, '') AS html FROM pages))""",
    "op11_prefix_trie": r"""
        WITH ids AS (
            -- crc32 of the decimal id, bit by bit.
            SELECT conv_id, conv_id - conv_id % 100 AS head, xor(list_reduce(
                list_prepend(4294967295, list_transform(string_split(conv_id::VARCHAR, ''), lambda s: ascii(s)::BIGINT)),
                lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y:
                    CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)), 4294967295) % 6 AS h
            FROM (SELECT DISTINCT conv_id FROM conversations WHERE conv_id IS NOT NULL)),
        turns AS MATERIALIZED (
            SELECT conv_id, digest, length(text) AS points,
                row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, digest) AS i
            FROM (SELECT conv_id, turn, text, sha256(strlen(role)::VARCHAR || ':' || role || text) AS digest
                FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations))),
        rebuilt AS (
            SELECT d.conv_id, t.i, t.digest, t.points FROM ids d JOIN turns t ON t.conv_id = d.head AND t.i <= d.h
            UNION ALL
            SELECT d.conv_id, t.i, t.digest, t.points FROM ids d JOIN turns t ON t.conv_id = d.conv_id AND t.i > d.h),
        paths AS MATERIALIZED (
            SELECT conv_id, row_number() OVER w AS depth, sha256(string_agg(digest, '') OVER w) AS node, points
            FROM rebuilt WINDOW w AS (PARTITION BY conv_id ORDER BY i)
            UNION ALL SELECT conv_id, 0, '', 0 FROM ids),
        members AS MATERIALIZED (
            SELECT *, lag(node) OVER w AS parent, lead(node) OVER w IS NULL AS is_end
            FROM paths WINDOW w AS (PARTITION BY conv_id ORDER BY depth)),
        nodes AS (
            SELECT depth, node, any_value(parent) AS parent, min(conv_id) AS conv_id, count(*) AS n_convs,
                (count(*) - 1) * any_value(points) AS saved,
                sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (is_end), '')) AS ends_sha256
            FROM members GROUP BY depth, node),
        children AS (SELECT depth - 1 AS depth, parent AS node, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY ALL),
        known AS MATERIALIZED (
            SELECT n.*, coalesce(c.n, 0) AS n_children FROM nodes n LEFT JOIN children c USING (depth, node)),
        below AS (
            SELECT m.depth, m.node, count(*) FILTER (k.n_children = 0) AS n_leaves, sum(k.saved) AS saved_tokens
            FROM known k JOIN paths m ON m.conv_id = k.conv_id AND m.depth <= k.depth GROUP BY ALL)
        SELECT k.conv_id, k.depth, p.conv_id AS parent_conv_id, k.n_convs, k.n_children, b.n_leaves::BIGINT AS n_leaves,
            b.saved_tokens::BIGINT AS saved_tokens, k.ends_sha256
        FROM known k JOIN below b USING (depth, node) LEFT JOIN known p ON p.depth = k.depth - 1 AND p.node = k.parent""",
    "op13_source_divergence": r"""
        WITH docs AS MATERIALIZED (
            SELECT row_number() OVER () AS row, coalesce(text, '') AS text, coalesce(lang, '') AS lang,
                coalesce(source, '') AS source FROM documents),
        words AS MATERIALIZED (
            SELECT row, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs),
        kept AS MATERIALIZED (SELECT lang, term FROM words GROUP BY ALL HAVING count(DISTINCT row) >= 10),
        groups AS (SELECT DISTINCT lang, source FROM docs),
        counts AS (SELECT lang, source, term, count(*) AS n FROM words SEMI JOIN kept USING (lang, term) GROUP BY ALL),
        grid AS MATERIALIZED (
            SELECT g.lang, g.source, k.term, coalesce(c.n, 0)::HUGEINT AS n
            FROM groups g JOIN kept k ON k.lang = g.lang
            LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
        shares AS MATERIALIZED (
            SELECT *, 1 + (1000000000 * (n + 2)) // (sum(n) OVER w + 2 * count(*) OVER w) AS p
            FROM grid WINDOW w AS (PARTITION BY lang, source)),
        langs AS (
            SELECT lang, term, 1 + (1000000000 * (n + 2)) // (sum(n) OVER w + 2 * count(*) OVER w) AS q
            FROM (SELECT lang, term, sum(n) AS n FROM grid GROUP BY ALL) WINDOW w AS (PARTITION BY lang)),
        pairs AS (
            SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
            FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
        parts AS (
            SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(p.value, 0)::BIGINT AS value
            FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
            LEFT JOIN pairs p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source
            UNION ALL
            SELECT s.lang, s.source, 'term', s.term, ((p - q) * (p - q) // (p + q))::BIGINT
            FROM shares s JOIN langs l ON l.lang = s.lang AND l.term = s.term WHERE n > 0 AND p > q)
        SELECT lang, source, part, item, value, rank::INT AS rank
        FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM parts)
        WHERE part = 'pair' OR rank <= 10""",
}
