"""Query op11: documents drawn towards the distribution of the benchmark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import importance

NAME = "op11_importance_resampling"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, target = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return importance.draw(docs, target).select("doc_id", "n_features", "weight", "score", "rank")


SQL = r"""
WITH tab AS (
  SELECT list(x ORDER BY i) AS tab FROM (
    SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS x
    FROM (SELECT unnest(range(0, 256)) AS i))
), d AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM documents
), b AS (
  SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                   '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w
  FROM benchmark
), f AS (
  SELECT r, w, count(*) AS n FROM (SELECT r, unnest(ws) AS w FROM d) GROUP BY r, w
), v AS (
  SELECT w, any_value(x) AS x FROM (SELECT w, hex(encode(w)) AS x FROM (SELECT DISTINCT w FROM f UNION SELECT DISTINCT w FROM b)) GROUP BY w
), k AS (
  SELECT w, xor(list_reduce(
      list_prepend(4294967295::BIGINT, list_transform(range(0, length(x) // 2), lambda i: CAST('0x' || substr(x, CAST(2 * i + 1 AS BIGINT), 2) AS BIGINT))),
      lambda c, y: xor(c >> 8, tab[CAST(xor(c, y) % 256 + 1 AS BIGINT)])), 4294967295::BIGINT) % 10000 AS bucket
  FROM v, tab
), s AS (
  SELECT bucket, sum(n) AS s FROM f JOIN k USING (w) GROUP BY bucket
), t AS (
  SELECT bucket, count(*) AS t FROM b JOIN k USING (w) GROUP BY bucket
), g AS (
  SELECT s.bucket, floor(1000 * ln((coalesce(t, 0)::DOUBLE + 1) * ((SELECT sum(s) FROM s)::DOUBLE + 10000)
                             / ((s::DOUBLE + 1) * (coalesce((SELECT sum(t) FROM t), 0)::DOUBLE + 10000)))) AS gain
  FROM s LEFT JOIN t ON s.bucket = t.bucket
), e AS (
  SELECT r, CAST(sum(n * gain) AS BIGINT) AS total FROM f JOIN k USING (w) JOIN g USING (bucket) GROUP BY r
), h AS (
  SELECT d.r, doc_id, CAST(len(ws) AS BIGINT) AS n_features,
         CASE WHEN len(ws) = 0 THEN 0 ELSE (total - ((total % len(ws)) + len(ws)) % len(ws)) // len(ws) END AS weight,
         CAST('0x' || substr(sha256('2024:' || doc_id), 1, 8) AS BIGINT) AS h
  FROM d LEFT JOIN e ON d.r = e.r
), o AS (
  SELECT r, doc_id, n_features, CAST(weight AS BIGINT) AS weight,
         CAST(weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score
  FROM h
), p AS (
  SELECT r, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM o WHERE n_features >= 20
)
SELECT doc_id, n_features, weight, score,
       CASE WHEN rank <= (SELECT count(*) FROM p) * 10 // 100 THEN CAST(rank AS BIGINT) END AS rank
FROM o LEFT JOIN p ON o.r = p.r
"""
