"""The queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, line_dedup, media, near_dedup, packing, pii, quality, sentencepiece_codec, substring_dedup, token_counts
from .common import documents


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(documents(spark, sf_dir))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup(documents(spark, sf_dir)).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_conversations(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op5_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.read(media.store(documents(spark, sf_dir)))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.encode(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"), keep_ids=False)


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    rules = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.judge(docs, rules).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule", *[f for f in quality.FEATURES if f != "n_words"])


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.dedup(documents(spark, sf_dir)).drop("mark", "first")


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.dedup(documents(spark, sf_dir).select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("text", "UTF-8"), 256).alias("kept_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_packing, op2_pii, op3_substring_dedup, op4_chat, op5_media, op6_token_counts, op7_sentencepiece, op8_quality_rules, op9_near_dedup, op10_line_dedup)}

_OP10 = """
WITH lines AS (
  SELECT doc_id, i, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, unnest(s) AS line, unnest(range(len(s))) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS s FROM documents))
), owners AS (
  SELECT key, min(doc_id) AS owner FROM lines WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2
), judged AS (
  SELECT l.doc_id, l.i, l.line, o.owner IS NOT NULL AND o.owner < l.doc_id AS gone FROM lines l LEFT JOIN owners o ON o.key = l.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""

_OP4 = """
WITH calls AS (
  SELECT conv_id, turn, coalesce(text, '') AS message, count(*) AS n_copies FROM conversations WHERE role = 'user' GROUP BY ALL
), results AS (
  SELECT conv_id, turn - 1 AS turn, coalesce(text, '') AS content, count(*) AS n_copies FROM conversations WHERE role = 'assistant' GROUP BY ALL
), marked AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY CASE WHEN turn >= 2 THEN '{"after":{"$ref":"turn-' || (turn - 2) || '"},' ELSE '{' END || '"message":' || to_json(message)) AS place FROM calls WHERE conv_id IS NOT NULL AND turn IS NOT NULL
), firsts AS (SELECT * FROM marked WHERE place = 1), kept AS (
  SELECT conv_id, turn, min(content) AS content, CAST(sum(n_copies) AS BIGINT) AS n_results FROM results WHERE conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY ALL
), chained AS (
  SELECT conv_id, turn, CAST(row_number() OVER (PARTITION BY conv_id, turn % 2, island ORDER BY turn) - 1 AS INTEGER) AS level
  FROM (SELECT conv_id, turn, turn - 2 * row_number() OVER (PARTITION BY conv_id, turn % 2 ORDER BY turn) AS island FROM firsts)
), every AS (
  SELECT conv_id, turn AS id, turn, message, n_copies, CASE WHEN place > 1 THEN 'repeat' WHEN k.content IS NULL THEN 'unanswered' ELSE 'answered' END AS status, CASE WHEN place = 1 THEN level END AS level, CASE WHEN place = 1 THEN k.content END AS content, CASE WHEN place = 1 THEN coalesce(n_results, 0) ELSE 0 END AS n_results
  FROM marked LEFT JOIN kept k USING (conv_id, turn) LEFT JOIN chained USING (conv_id, turn)
  UNION ALL SELECT conv_id, turn, turn, message, n_copies, 'no id', NULL, NULL, 0 FROM calls WHERE conv_id IS NULL OR turn IS NULL
  UNION ALL SELECT r.conv_id, r.turn, NULL, NULL, r.n_copies, 'further result', NULL, r.content, r.n_copies FROM results r SEMI JOIN firsts f ON f.conv_id = r.conv_id AND f.turn = r.turn JOIN kept k ON k.conv_id = r.conv_id AND k.turn = r.turn WHERE r.content <> k.content
  UNION ALL SELECT r.conv_id, r.turn, NULL, NULL, r.n_copies, 'result without call', NULL, r.content, r.n_copies FROM results r ANTI JOIN firsts f ON f.conv_id = r.conv_id AND f.turn = r.turn WHERE r.conv_id IS NOT NULL AND r.turn IS NOT NULL
  UNION ALL SELECT conv_id, turn, NULL, NULL, n_copies, 'no id', NULL, content, n_copies FROM results WHERE conv_id IS NULL OR turn IS NULL
)
SELECT conv_id, 'turn-' || id AS call_id, turn, CASE WHEN message IS NOT NULL THEN 'respond' END AS name, n_copies, status, level, status = 'answered' AS answered, n_results,
       coalesce(length(message) BETWEEN 1 AND 100000 AND turn >= 0, false) AS valid,
       CASE WHEN message IS NULL THEN 'no call' ELSE concat_ws('; ', CASE WHEN length(message) < 1 THEN 'message: too short' END, CASE WHEN length(message) > 100000 THEN 'message: too long' END, CASE WHEN turn IS NULL THEN 'turn: missing' WHEN turn < 0 THEN 'turn: too small' END) END AS errors,
       '{"arguments":' || CASE WHEN message IS NULL THEN 'null' ELSE '{' || CASE WHEN turn >= 2 THEN '"after":{"$ref":"turn-' || (turn - 2) || '"},' ELSE '' END || '"message":' || to_json(message) || coalesce(',"turn":' || turn, '') || '}' END
       || ',"content":' || coalesce(to_json(content), 'null') || ',"id":' || coalesce('"turn-' || id || '"', 'null') || ',"name":' || CASE WHEN message IS NULL THEN 'null' ELSE '"respond"' END || '}' AS line
FROM every
"""

_OP3 = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
windows AS (SELECT doc_id, i, row_number() OVER (PARTITION BY array_to_string(w[i:i + 19], ' ') ORDER BY doc_id, i) AS n FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20)),
lost AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM windows WHERE n > 1),
words AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (SELECT w.doc_id, count(l.p) AS n_removed, string_agg(w.x, ' ' ORDER BY w.p) FILTER (l.p IS NULL) AS kept FROM words w LEFT JOIN lost l ON l.doc_id = w.doc_id AND l.p = w.p GROUP BY w.doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)
"""

_OP9 = r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, list_sort(CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE CAST([] AS VARCHAR[]) END) AS s FROM d),
c AS (SELECT min(doc_id) AS id, s, len(s) AS n, count(*) AS class_size FROM s WHERE len(s) > 0 GROUP BY s),
g AS (SELECT id, n, unnest(s) AS g FROM c),
e AS (SELECT a.id AS a, b.id AS b FROM g a JOIN g b ON a.g = b.g AND a.id <> b.id GROUP BY a.id, b.id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
r AS (SELECT id AS a, id AS b FROM c UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b),
m AS (SELECT a AS id, min(b) AS component_id FROM r GROUP BY a)
SELECT s.doc_id, len(s.s) AS n_shingles, coalesce(component_id, s.doc_id) AS component_id, s.doc_id = coalesce(component_id, s.doc_id) AS kept, coalesce(class_size, 1) AS class_size
FROM s LEFT JOIN c ON c.s = s.s LEFT JOIN m USING (id)
"""

ORACLES: dict[str, str] = {"op3_substring_dedup": _OP3, "op4_chat": _OP4, "op9_near_dedup": _OP9, "op10_line_dedup": _OP10}
