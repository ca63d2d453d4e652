"""The registered queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataseek.llm import bpe, decontaminate, filter_audit, html_text, ngram_join, pii, quality_classifier, quality_rules, sharding, throttle, token_count, toxicity, url_rules
from strataseek.llm.common import read_table

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.tiktoken")
PIECE_BPE = public_tokenizers.path("piece_bpe_32k.model")
CONTEXT_TOKENS = 4096
SHARDS = 8
URL_RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(read_table(spark, sf_dir, "documents"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.annotate(read_table(spark, sf_dir, "documents"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.classify(read_table(spark, sf_dir, "documents"))


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_rules.judge(read_table(spark, sf_dir, "pages"), rules)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.token_counts(read_table(spark, sf_dir, "documents"), PIECE_BPE, CONTEXT_TOKENS)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read_table(spark, sf_dir, "documents")
    return toxicity.score(documents, toxicity.train(documents, read_table(spark, sf_dir, "labels")))


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(read_table(spark, sf_dir, "documents"), BYTE_BPE, public_tokenizers.PATTERN)


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(read_table(spark, sf_dir, "documents"), SHARDS)


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(read_table(spark, sf_dir, "documents"), gram=3, percent=90).select("doc_id", "n_shingles", "component_id")


def op11_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(read_table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op13_click_throttling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return throttle.throttle(read_table(spark, sf_dir, "clicks"))


def quality_base_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op1 that SQL can say."""
    return op1_quality_rules(spark, sf_dir).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def pii_base_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts of op3."""
    return op3_pii(spark, sf_dir).select("doc_id", "n_email", "n_ip", "n_card", "n_phone")


def token_limits_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bytes of op6."""
    return op6_token_counts(spark, sf_dir).select("doc_id", "n_bytes")


def shard_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The law of op9 as facts: all rows and bytes in SHARDS shards, slots without gaps, bytes within 2 % of the mean."""
    of_shard = op9_sharding(spark, sf_dir).groupBy("shard").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"), F.min("slot").alias("a"), F.max("slot").alias("b"), F.countDistinct("slot").alias("slots"))
    return of_shard.agg(
        F.count("*").alias("shards"),
        F.sum("n").alias("n_rows"),
        F.sum("bytes").alias("bytes"),
        F.every((F.col("a") == 0) & (F.col("b") == F.col("n") - 1) & (F.col("slots") == F.col("n"))).alias("gapless"),
        (F.max("bytes") - F.min("bytes") <= 0.02 * F.avg("bytes")).alias("even"),
    )


def shard_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op9 that don't depend on the tree."""
    return op9_sharding(spark, sf_dir).select("doc_id", "size", "law")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_quality_rules,
        op2_decontamination,
        op3_pii,
        op4_quality_classifier,
        op5_url_filters,
        op6_token_counts,
        op7_toxicity,
        op8_byte_bpe,
        op9_sharding,
        op10_ngram_jaccard_join,
        op11_html_extraction,
        op12_filter_audit,
        op13_click_throttling,
        quality_base_numbers,
        pii_base_counts,
        token_limits_bytes,
        shard_balance,
        shard_sizes,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    rules = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES)
    url = r"'(?s)^.*?://([^/?#]*)([^?#]*)'"
    upper = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
    space = r"[\x20\x09-\x0D]+"
    found = lambda pattern: f"regexp_extract_all(t, '{pattern}')"
    figures = "regexp_replace(x, '[^0-9]', '', 'g')"
    return {
        "quality_base_numbers": rf"""
WITH texts AS (SELECT row_number() OVER () AS n, doc_id, coalesce(text, '') AS t FROM documents),
words AS (SELECT n, doc_id, t, list_filter(regexp_split_to_array(t, '{space}'), lambda w: w <> '') AS w FROM texts),
windows AS (SELECT n, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS win, i FROM (SELECT n, w, unnest(range(1, len(w) - 1)) AS i FROM words)),
twice AS (SELECT n, i FROM (SELECT *, count(*) OVER (PARTITION BY n, win) AS c FROM windows) WHERE c > 1),
inside AS (SELECT n, count(DISTINCT i + k) AS r FROM twice, (VALUES (0), (1), (2)) o(k) GROUP BY n),
lines AS (SELECT n, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^ 	-
]')) AS x FROM texts),
numbers AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda s: length(s))), 0) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(x) - len(list_distinct(x)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(r, 0) AS BIGINT) AS n_repeat_words
  FROM words JOIN lines USING (n) LEFT JOIN inside USING (n))
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM numbers""",
        "pii_base_counts": rf"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
found AS (
  SELECT doc_id, {found(r'[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+')} AS e,
    list_filter({found(r'[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)')}, lambda x: list_bool_and(list_transform(string_split(x, '.'), lambda p: length(ltrim(p, '0')) <= 3 AND coalesce(TRY_CAST(p AS HUGEINT), 0) <= 255))) AS i,
    list_transform(list_filter({found(r'[0-9](?:[ -]?[0-9])+')}, lambda x: length({figures}) BETWEEN 12 AND 19), lambda x: reverse({figures})) AS c,
    list_filter({found(r'\+[0-9][ ().0-9-]+[0-9]')}, lambda x: length({figures}) BETWEEN 9 AND 15) AS p
  FROM texts)
SELECT doc_id, CAST(len(e) AS BIGINT) AS n_email, CAST(len(i) AS BIGINT) AS n_ip,
  CAST(len(list_filter(c, lambda x: list_sum(list_transform(range(1, length(x) + 1), lambda k: CASE WHEN k % 2 = 1 THEN CAST(x[k] AS INT)
    ELSE 2 * CAST(x[k] AS INT) - CASE WHEN CAST(x[k] AS INT) > 4 THEN 9 ELSE 0 END END)) % 10 = 0)) AS BIGINT) AS n_card,
  CAST(len(p) AS BIGINT) AS n_phone FROM found""",
        "token_limits_bytes": "SELECT doc_id, CAST(strlen(coalesce(text, '')) AS BIGINT) AS n_bytes FROM documents",
        "shard_balance": f"SELECT CAST({SHARDS} AS BIGINT) AS shards, count(*) AS n_rows, CAST(sum(strlen(coalesce(text, '')) + 1) AS BIGINT) AS bytes, true AS gapless, true AS even FROM documents",
        "shard_sizes": "SELECT doc_id, CAST(strlen(coalesce(text, '')) + 1 AS BIGINT) AS size, 'bytes' AS law FROM documents",
        "op10_ngram_jaccard_join": rf"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), {upper}), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) < 3 THEN list_filter([array_to_string(w, ' ')], lambda g: g <> '')
    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s FROM words),
grams AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
links AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id <> b.doc_id AND 10 * a.n >= 9 * b.n AND 10 * b.n >= 9 * a.n
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
reach AS (SELECT doc_id, doc_id AS root FROM sets UNION SELECT r.doc_id, l.y FROM reach r JOIN links l ON r.root = l.x)
SELECT doc_id, CAST(any_value(len(s)) AS BIGINT) AS n_shingles, min(root) AS component_id FROM reach JOIN sets USING (doc_id) GROUP BY doc_id""",
        "op12_filter_audit": rf"""
WITH texts AS (
  SELECT doc_id, coalesce(text, '') AS t, coalesce(source, '') AS part, list_filter(regexp_split_to_array(coalesce(text, ''), '{space}'), lambda w: w <> '') AS w,
    min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS least FROM documents),
marks AS (SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic FROM labels GROUP BY doc_id),
masks AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
    CASE WHEN len(w) < 200 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 2 ELSE 0 END
    + CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t) THEN 4 ELSE 0 END
    + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END + CASE WHEN texts.doc_id > least THEN 16 ELSE 0 END AS mask
  FROM texts LEFT JOIN marks ON texts.doc_id = marks.doc_id),
cells AS (SELECT part, mask, count(*) AS n, count_if(good) AS g, count_if(toxic) AS x FROM masks GROUP BY part, mask),
letters(f, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
orders AS (
  SELECT a.f || b.f || c.f || d.f || e.f AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits FROM letters a, letters b, letters c, letters d, letters e
  WHERE a.bit | b.bit | c.bit | d.bit | e.bit = 31),
steps AS (SELECT filter_order, step, bits[step] AS own, CAST(coalesce(list_sum(bits[:step - 1]), 0) AS INT) AS before FROM orders, (VALUES (1), (2), (3), (4), (5)) s(step)),
counts AS (
  SELECT part, filter_order, step, own,
    CAST(coalesce(sum(n) FILTER (mask & (before | own) = 0), 0) AS BIGINT) AS kept,
    CAST(coalesce(sum(n) FILTER (mask & own <> 0 AND mask & before = 0), 0) AS BIGINT) AS removed,
    CAST(coalesce(sum(n) FILTER (mask & own <> 0 AND mask & before <> 0), 0) AS BIGINT) AS redundant,
    CAST(coalesce(sum(n) FILTER (mask = own), 0) AS BIGINT) AS unique_fails,
    CAST(coalesce(sum(g) FILTER (mask & own <> 0 AND mask & before = 0), 0) AS BIGINT) AS good_lost,
    CAST(coalesce(sum(x) FILTER (mask & own <> 0 AND mask & before = 0), 0) AS BIGINT) AS toxic_lost
  FROM cells, steps GROUP BY part, filter_order, step, own)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM counts""",
        "op5_url_filters": f"""
WITH rules(rule_host, rule_path, rule_verdict) AS (VALUES {rules}),
parsed AS (
  SELECT row_number() OVER () AS n, page_id,
         translate(coalesce(regexp_extract(url, {url}, 1), ''), {upper}) AS host,
         coalesce(regexp_extract(url, {url}, 2), '') AS path
  FROM pages),
fits AS (
  SELECT n, rule_host || rule_path AS rule, rule_verdict,
         row_number() OVER (PARTITION BY n ORDER BY length(rule_host) + length(rule_path) DESC, length(rule_host) DESC) AS place
  FROM parsed JOIN rules ON (host = rule_host OR host LIKE '%.' || rule_host) AND starts_with(path, rule_path))
SELECT page_id, host, path, rule, coalesce(rule_verdict, 'allow') AS verdict
FROM parsed LEFT JOIN fits ON parsed.n = fits.n AND place = 1""",
    }
