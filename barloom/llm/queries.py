"""The registered queries of this subpackage, each over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from barloom.llm import chat_format, conversation_repair, conversation_sql, conversation_trie, decontaminate, embedding_dedup, fingerprints, html_extract, line_dedup, mixing, quality, secret_scan, sharding, simhash
from barloom.llm.shared import table


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.report(table(spark, sf_dir, "documents"))


def op4_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.report(table(spark, sf_dir, "conversations"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.report(table(spark, sf_dir, "documents"))


def op6_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.report(table(spark, sf_dir, "documents"))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.report(table(spark, sf_dir, "documents"))


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.report(table(spark, sf_dir, "documents"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie.report(table(spark, sf_dir, "conversations"))


def op12_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.report(table(spark, sf_dir, "embeddings"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.report(table(spark, sf_dir, "conversations"))


_OP2 = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), windows AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[s : s + least(len(w), 10) - 1], ' ') AS words
  FROM b, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS t(s) WHERE len(w) > 0
), lengths AS (SELECT DISTINCT n FROM windows),
placed AS (
  SELECT doc_id, s, n, array_to_string(w[s : s + n - 1], ' ') AS words
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, lengths WHERE len(w) >= n)
), hits AS (SELECT doc_id, s, n, item_id FROM placed JOIN windows USING (n, words)),
hit_words AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS pos FROM hits) GROUP BY doc_id),
hit_items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit_words USING (doc_id) LEFT JOIN hit_items USING (doc_id)
"""

_OP3 = r"""
WITH lines AS (
  SELECT doc_id, i, line, trim(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS k
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents)
), frequent AS (SELECT k FROM lines WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(f.k) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (f.k IS NULL), '')) AS kept_sha256
FROM lines LEFT JOIN frequent f USING (k) GROUP BY doc_id
"""

_OP4 = r"""
WITH t AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS i,
         replace(coalesce(role, 'unknown'), '<|', '< |') AS role, replace(coalesce(text, ''), '<|', '< |') AS text
  FROM conversations WHERE conv_id IS NOT NULL
), last AS (SELECT conv_id, max(i) AS i FROM t WHERE role = 'assistant' GROUP BY conv_id),
answers AS (SELECT conv_id, i, text FROM t JOIN last USING (conv_id, i)),
sides AS (
  SELECT t.conv_id, t.i, role, t.text AS chosen, CASE WHEN a.i IS NULL THEN t.text ELSE coalesce(b.text, '') END AS rejected
  FROM t LEFT JOIN answers a ON a.conv_id = t.conv_id AND a.i = t.i LEFT JOIN answers b ON b.conv_id = xor(t.conv_id, 1)
), common AS (SELECT conv_id, coalesce(min(i) FILTER (chosen <> rejected) - 1, count(*)) AS n FROM sides GROUP BY conv_id),
placed AS (
  SELECT conv_id, i, n, role, '<|' || role || '|>' || chr(10) AS head, chosen, rejected,
    coalesce(sum(length(role) + 13 + length(chosen)) FILTER (i > n) OVER before, 0) AS at_chosen, coalesce(sum(length(role) + 13 + length(rejected)) FILTER (i > n) OVER before, 0) AS at_rejected
  FROM sides JOIN common USING (conv_id) WINDOW before AS (PARTITION BY conv_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
)
SELECT conv_id AS pair_id, CAST(n AS INTEGER) AS n_common,
  coalesce(string_agg(head || chosen || '<|end|>' || chr(10), '' ORDER BY i) FILTER (i <= n), '') AS prompt,
  coalesce(string_agg(head || chosen || '<|end|>' || chr(10), '' ORDER BY i) FILTER (i > n), '') AS chosen,
  coalesce(string_agg(CAST(at_chosen + length(head) AS BIGINT) || ':' || CAST(at_chosen + length(head) + length(chosen) + 7 AS BIGINT), ',' ORDER BY i) FILTER (i > n AND role = 'assistant'), '') AS chosen_mask,
  coalesce(string_agg(head || rejected || '<|end|>' || chr(10), '' ORDER BY i) FILTER (i > n), '') AS rejected,
  coalesce(string_agg(CAST(at_rejected + length(head) AS BIGINT) || ':' || CAST(at_rejected + length(head) + length(rejected) + 7 AS BIGINT), ',' ORDER BY i) FILTER (i > n AND role = 'assistant'), '') AS rejected_mask
FROM placed GROUP BY conv_id, n
"""

_OP5 = """
WITH RECURSIVE d AS (
  SELECT doc_id, source, coalesce('s' || source, 'n') AS key, greatest(CAST(ceil(coalesce(strlen(text), 0) / 4.0) AS BIGINT), 1) AS n, md5('mix:doc:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS doc_key FROM documents
), stats AS (SELECT key, count(*) AS docs, CAST(sum(n) AS BIGINT) AS tokens FROM d GROUP BY key),
shares AS (SELECT key, docs, tokens, CAST(tokens AS DOUBLE) / (SELECT sum(tokens) FROM stats) AS s FROM stats),
ends AS (SELECT min(s) AS a, max(s) AS z FROM shares),
halves(i, lo, hi) AS (
  SELECT 0, CAST(0 AS DOUBLE), CAST(1 AS DOUBLE)
  UNION ALL SELECT i + 1, CASE WHEN fits THEN lo ELSE mid END, CASE WHEN fits THEN mid ELSE hi END
  FROM (SELECT i, lo, hi, (lo + hi) / 2 AS mid, pow(a, (lo + hi) / 2 - 1) / pow(z, (lo + hi) / 2 - 1) <= 2 + 1e-12 AS fits FROM halves, ends WHERE i < 50)
), exponent AS (SELECT CASE WHEN z / a <= 2 + 1e-12 THEN 0 ELSE hi END AS x FROM halves, ends WHERE i = 50),
weights AS (SELECT key, docs, tokens, pow(s, x) / sum(pow(s, x)) OVER () AS w FROM shares, exponent),
asked AS (SELECT key, docs, tokens, round(w, 9) AS weight, CAST(round(w * whole) AS BIGINT) AS share FROM weights, (SELECT max(tokens / w) AS whole FROM weights)),
budgets AS (SELECT *, greatest(CASE WHEN abs(share - CAST(round(share / tokens) AS BIGINT) * tokens) <= tokens * 1e-12 THEN CAST(round(share / tokens) AS BIGINT) * tokens ELSE share END, tokens) AS budget FROM asked),
goal AS (SELECT *, budget // tokens AS epochs, budget % tokens AS rest FROM budgets),
placed AS (
  SELECT *, md5('mix:block:' || key || ':' || block) AS block_order
  FROM (SELECT d.*, docs, weight, budget, epochs, rest, CAST('0x' || substr(doc_key, 1, 8) AS BIGINT) % CAST(ceil(sqrt(docs)) AS BIGINT) AS block FROM d JOIN goal USING (key))
), blocks AS (SELECT key, block_order, rest, sum(n) AS n, sum(sum(n)) OVER (PARTITION BY key ORDER BY block_order) AS upto FROM placed WHERE rest > 0 GROUP BY key, block_order, rest),
cut AS (SELECT key, block_order AS cut_order, rest - upto + n AS room FROM blocks WHERE upto > rest AND upto - n <= rest),
inside AS (SELECT key, doc_key, room, sum(sum(n)) OVER (PARTITION BY key ORDER BY doc_key) AS upto FROM placed JOIN cut USING (key) WHERE block_order = cut_order GROUP BY key, doc_key, room),
last AS (SELECT key, max(doc_key) AS cut_key FROM inside WHERE upto <= room GROUP BY key)
SELECT doc_id, source, n AS n_tokens, CAST(epochs + CAST(coalesce(block_order < cut_order OR (block_order = cut_order AND doc_key <= cut_key), false) AS INTEGER) AS INTEGER) AS copies, weight, CAST(budget AS BIGINT) AS budget
FROM placed LEFT JOIN cut USING (key) LEFT JOIN last USING (key)
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_sharding, op2_decontamination, op3_line_dedup, op4_preferences, op5_mixing, op6_main_text, op7_simhash, op8_secrets, op9_fingerprints, op10_quality, op11_prefix_trie, op12_embedding_dedup, op13_conversation_repair)}


def oracle_sql() -> dict[str, str]:
    return {"op2_decontamination": _OP2, "op3_line_dedup": _OP3, "op4_preferences": _OP4, "op5_mixing": _OP5, "op11_prefix_trie": conversation_sql.OP11, "op12_embedding_dedup": conversation_sql.OP12, "op13_conversation_repair": conversation_sql.OP13}
