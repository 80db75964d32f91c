"""Query op4: components of documents under exact shingle Jaccard."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import jaccard_join

NAME = "op4_ngram_jaccard_join"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.components(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = r"""
WITH RECURSIVE w AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS MATERIALIZED (
  SELECT DISTINCT doc_id, array_to_string(ws[i:i + least(len(ws), 5) - 1], ' ') AS g
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - least(len(ws), 5) + 2)) AS i FROM w WHERE len(ws) > 0)
), n AS MATERIALIZED (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), o AS MATERIALIZED (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL
), e AS MATERIALIZED (
  SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)
), both_ways AS MATERIALIZED (
  SELECT a, b FROM e UNION ALL SELECT b, a FROM e
), r AS (
  SELECT doc_id AS x, doc_id AS y FROM documents
  UNION
  SELECT r.x, both_ways.b FROM r JOIN both_ways ON r.y = both_ways.a
), m AS (
  SELECT x, min(y) AS component_id FROM r GROUP BY x
)
SELECT w.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id
FROM w LEFT JOIN n ON w.doc_id = n.doc_id JOIN m ON m.x = w.doc_id
"""
