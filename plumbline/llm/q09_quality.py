"""Query op9: quality counts and verdicts of every document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import quality

NAME = "op9_quality_rules"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = quality.judge(docs, ["doc_id"])
    return out.select(
        "row.doc_id", "q.n_words", "q.word_chars", "q.n_symbols", "q.n_dup_lines", "q.n_repeat_words",
        "base_failed", "host_rejected", "kept",
    )


SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT doc_id, source, t,
         regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
         list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS ls
  FROM d
), g AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS k
  FROM (SELECT doc_id, i, ws[i] AS a, ws[i + 1] AS b, ws[i + 2] AS c
        FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w))
), p AS (
  SELECT doc_id, count(DISTINCT j) AS n_repeat_words
  FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM g WHERE k > 1)
  GROUP BY doc_id
), c AS (
  SELECT w.doc_id, w.source, CAST(len(ws) AS BIGINT) AS n_words,
         CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
         CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(ls) AS BIGINT) AS n_lines,
         CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words
  FROM w LEFT JOIN p ON w.doc_id = p.doc_id
), f AS (
  SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
         (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR 100 * n_symbols > 10 * word_chars
          OR 100 * n_dup_lines > 30 * n_lines) AS rule_failed
  FROM c
), h AS (
  SELECT source, CAST(count(*) AS DOUBLE) AS n, CAST(count(*) FILTER (WHERE rule_failed) AS DOUBLE) AS x
  FROM f WHERE source IS NOT NULL GROUP BY source
), s AS (
  SELECT sum(n) AS n, CAST(count(*) AS DOUBLE) AS h, least(greatest(sum(x) / sum(n), 1e-6), 1 - 1e-6) AS m,
         sum(x * x / n) AS ff
  FROM h
), v AS (
  SELECT *, (ff - n * m * m - (h - 1) * m * (1 - m)) / n AS var FROM s
), k AS (
  SELECT m, CASE WHEN var > 0 THEN least(greatest(m * (1 - m) / var - 1, 1.0), 1e4)
                 WHEN h > 1 THEN 1e4 ELSE 1.0 END AS k
  FROM v
), r AS (
  SELECT source FROM h, k WHERE (x + m * k) / (n + k) > 0.6
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       r.source IS NOT NULL AS host_rejected,
       NOT base_failed AND NOT (r.source IS NOT NULL AND rule_failed) AS kept
FROM f LEFT JOIN r ON f.source = r.source
"""
