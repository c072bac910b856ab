"""One query for each operator of this package, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship
from . import bpe, chat, langid, packing, quality, simhash, substring, token_counts, topk, warc
from .common import Scratch, swept, table

#: Conversation -7, whose turns look like a template's own signs.
PLANTED = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(ship(spark), sf_dir, "documents").select("doc_id", "text", "source"))


def op2_top_k_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(ship(spark), sf_dir, "embeddings").select("vec_id", "embedding")
    return topk.search(vectors, vectors.where("vec_id % 100 = 0"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.predicted(table(ship(spark), sf_dir, "documents").select("doc_id", "text", "lang"))


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(ship(spark), sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    rows = rows.unionByName(spark.createDataFrame(PLANTED, "conv_id long, turn long, role string, text string"))
    return chat.digests(chat.formatted(chat.events_of(rows)))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encoded(table(ship(spark), sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op6_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.groups_of(table(ship(spark), sf_dir, "documents"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.dedup(table(ship(spark), sf_dir, "documents").select("doc_id", "text"), digest=True)


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(table(ship(spark), sf_dir, "documents"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole table, over a cache that an earlier run over a fifth of it has filled."""
    docs, path = table(ship(spark), sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model")
    cache = Scratch(spark).path("token_cache")
    token_counts.counted(docs.where("doc_id % 5 = 0"), path, cache)
    swept(spark)
    return token_counts.counted(docs, path, cache)


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(ship(spark), sf_dir, "pages"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_best_fit_packing, op2_top_k_search, op3_language_id, op4_chat_formatting, op5_bpe, op6_simhash_groups, op7_substring_dedup, op8_quality_rules, op9_token_counts, op10_warc)
    return {f.__name__: f for f in found}


OP2 = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS w FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CASE WHEN len(q.w) = 0 OR len(c.w) = 0 THEN 0 ELSE list_inner_product(q.w, c.w) END::BIGINT AS score
  FROM (SELECT * FROM v WHERE vec_id % 100 = 0) q JOIN v c ON q.vec_id <> c.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""

OP4 = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (
  SELECT *,
    regexp_replace(regexp_replace(replace(text, '\', '\\'),
      '<(\|im_start\|>|\|im_end\|>|\|endoftext\|>|s>|/s>|<SYS>>|</SYS>>)', '<\\\1', 'g'),
      '\[(INST\]|/INST\])', '[\\\1', 'g') AS shown
  FROM rows)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length('<|im_start|>' || role || chr(10) || shown || '<|im_end|>' || chr(10)))::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""

OP7 = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (
  SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d)),
first AS (SELECT g, min(doc_id) AS least FROM g GROUP BY g),
gone AS (
  SELECT DISTINCT doc_id, i + k AS i FROM g JOIN first USING (g), range(13) t(k) WHERE least < doc_id),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d),
kept AS (
  SELECT words.doc_id, string_agg(word, ' ' ORDER BY words.i) AS text, count(*) AS n
  FROM words LEFT JOIN gone ON words.doc_id = gone.doc_id AND words.i = gone.i WHERE gone.i IS NULL GROUP BY ALL)
SELECT d.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""

OP8 = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
g AS (
  SELECT doc_id, i, array_to_string(w[i:i + 2], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
twice AS (SELECT doc_id, g FROM g GROUP BY ALL HAVING count(*) > 1),
repeated AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM g JOIN twice USING (doc_id, g), range(3) t(k) GROUP BY doc_id),
c AS (
  SELECT d.doc_id, source, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN repeated USING (doc_id)),
f AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    2 * n_symbols > n_words OR (n_dup_lines >= 3 AND 20 * n_dup_lines > n_words) AS soft_failed FROM c),
hosts AS (
  SELECT source, count(*)::DOUBLE AS n, count(*) FILTER (base_failed OR soft_failed)::DOUBLE AS f FROM f GROUP BY source),
m AS (
  SELECT least(greatest(sum(f) / sum(n), 1e-4), 1 - 1e-4) AS m, sum(n * (f / n) * (f / n)) / sum(n) AS s, count(*) AS hosts FROM hosts),
p AS (
  SELECT m, least(greatest(CASE WHEN s - m * m > 1e-9 AND hosts > 1 THEN m * (1 - m) / (s - m * m) - 1 ELSE 1000 END, 1), 1000) AS weight FROM m),
rates AS (SELECT source AS host, (f + m * weight) / (n + weight) AS rate FROM hosts, p)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT (soft_failed AND rate >= 0.05) AND rate < 0.95 AS kept
FROM f JOIN rates ON source IS NOT DISTINCT FROM host
"""

OP10 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, ''))::BIGINT AS n, sha1(coalesce(html, '')) AS digest FROM pages),
l AS (SELECT *, CASE WHEN n >= 1000 THEN max(page_id) OVER (PARTITION BY digest) END AS lead FROM p)
SELECT page_id, n AS payload_bytes, digest AS payload_digest,
  CASE WHEN lead IS NULL OR lead = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN lead <> page_id THEN lead END AS refers_to
FROM l
"""


def oracle_sql() -> dict[str, str]:
    """For the queries that SQL can express."""
    return {"op2_top_k_search": OP2, "op4_chat_formatting": OP4, "op7_substring_dedup": OP7, "op8_quality_rules": OP8, "op10_warc": OP10}
