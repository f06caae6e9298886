"""Registered queries of the operators, over whole tables, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (bpe, conversations, langid, lines, packing, pii, quality, secrets, simhash, suffixes, superkmers, variants,
               vectors)
from .common import documents

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@register
def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode and decode every text; digests of ids and decoded bytes."""
    coded = bpe.encode(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"), decoded=True)
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
                        F.sha2("decoded", 256).alias("decoded_sha256"))


@register
def op8_embedding_pq(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all embeddings at cosine 0.9."""
    return vectors.near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), 0.9)


@register
def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash fingerprints of 4-word shingles and their components at 4 bits."""
    found = simhash.near_duplicates(documents(spark, sf_dir), shingle=4, max_bits=4)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


@register
def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text rules and cross-document line frequency per source."""
    return quality.quality(documents(spark, sf_dir)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "n_removed_words")


@register
def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base secret spans and linked multipart credentials."""
    return secrets.find(documents(spark, sf_dir)).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")


@register
def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of every text covered by a 50-byte string of an earlier document."""
    return suffixes.remove_repeats(documents(spark, sf_dir), 50, keep_bytes=False)


@register
def op5_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text with its personal data replaced by keyed surrogates."""
    return pii.pseudonymise(documents(spark, sf_dir)).select("doc_id", "text", "n_entities")


@register
def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pack all documents into sequences of at most 1024 tokens."""
    return packing.pack(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"))


@register
def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """String-kernel language of every text, learned from the rows that aren't held out."""
    return langid.identify(documents(spark, sf_dir))


@register
def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text without the lines that occur on many sources."""
    return lines.remove_boilerplate(documents(spark, sf_dir)).select("doc_id", "text", "n_lines", "n_removed")


@register
def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults, cheapest edits and repaired text of every damaged conversation."""
    rows = conversations.damage(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return conversations.repair(rows, gone="gone")


@register
def op12_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every text covered by a 35-word window that occurs again."""
    return superkmers.remove_repeats(documents(spark, sf_dir), 35, keep_text=False)


@register
def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every frequent word with its near words' number, its form and root."""
    return variants.variants(documents(spark, sf_dir), damage=199)


ORACLES["op12_substring_dedup"] = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^ \t-\r]+') AS w FROM documents
), win AS (
  SELECT doc_id, i, array_to_string(w[i:i + 34], ' ') AS words FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM d)
), again AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY words) AS n FROM win) WHERE n > 1
), gone AS (
  SELECT DISTINCT doc_id, i + k AS pos FROM again, range(0, 35) r(k)
), word AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM d),
kept AS (
  SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY pos) AS words FROM word ANTI JOIN gone USING (doc_id, pos) GROUP BY doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(words, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""

ORACLES["op7_line_dedup"] = """
WITH l AS (
  SELECT doc_id, source, text, unnest(string_split(text, chr(10))) AS line,
         generate_subscripts(string_split(text, chr(10)), 1) AS k
  FROM documents
), n AS (
  SELECT *, trim(lower(regexp_replace(line, '[ \t\r\f\v]+', ' ', 'g'))) AS plain FROM l
), bad AS (
  SELECT plain FROM n WHERE plain <> '' GROUP BY plain HAVING count(DISTINCT source) >= 10
), d AS (
  SELECT doc_id, text, count(*) AS n_lines, count(*) FILTER (WHERE bad.plain IS NOT NULL) AS gone,
         count(*) FILTER (WHERE n.plain <> '' AND bad.plain IS NULL) AS own,
         coalesce(string_agg(line, chr(10) ORDER BY k) FILTER (WHERE bad.plain IS NULL), '') AS rest
  FROM n LEFT JOIN bad ON n.plain = bad.plain GROUP BY doc_id, text
)
SELECT doc_id, CASE WHEN own = 0 THEN text ELSE rest END AS text, n_lines::INT AS n_lines,
       CASE WHEN own = 0 THEN 0 ELSE gone END::INT AS n_removed
FROM d
"""

ORACLES["op8_embedding_pq"] = """
WITH RECURSIVE v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), link AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.9
), reach(a, b) AS (
  SELECT a, b FROM link UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a
), low AS (SELECT a AS vec_id, min(b) AS least FROM reach GROUP BY a), n AS (SELECT a AS vec_id, count(*) AS n FROM link GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(low.least, vec_id)) AS component_id,
  vec_id = least(vec_id, coalesce(low.least, vec_id)) AS kept
FROM embeddings LEFT JOIN low USING (vec_id) LEFT JOIN n USING (vec_id)
"""

ORACLES["op10_quality_rules"] = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^ \t-\r]+') AS w FROM documents
), tri AS (
  SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS words
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)
), again AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, words) AS n FROM tri) WHERE n > 1
), inside AS (
  SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM again, range(0, 3) r(k) GROUP BY doc_id
), line AS (
  SELECT doc_id, source, raw, array_to_string(words, ' ') AS line, len(words) AS n FROM (
    SELECT doc_id, source, raw, regexp_extract_all(
      translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ \t-\r]+') AS words
    FROM (SELECT doc_id, source, unnest(string_split(t, chr(10))) AS raw FROM d))
  WHERE len(words) > 0
), dup AS (SELECT doc_id, count(*) - count(DISTINCT raw) AS n_dup_lines FROM line GROUP BY doc_id),
often AS (
  SELECT source, line, min(doc_id) AS first FROM line GROUP BY source, line HAVING count(DISTINCT doc_id) > 20
), gone AS (
  SELECT line.doc_id, sum(line.n) AS n_removed_words
  FROM line JOIN often ON line.line = often.line AND line.source IS NOT DISTINCT FROM often.source
  WHERE line.doc_id <> often.first GROUP BY line.doc_id
), counted AS (
  SELECT doc_id, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
    coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_removed_words, 0) AS n_removed_words
  FROM d LEFT JOIN dup USING (doc_id) LEFT JOIN inside USING (doc_id) LEFT JOIN gone USING (doc_id)
), judged AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counted)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
  n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
  NOT base_failed AND n_words - n_removed_words >= 25 AND n_words - n_removed_words >= 0.3 * n_words AS kept,
  n_removed_words::BIGINT AS n_removed_words
FROM judged
"""
