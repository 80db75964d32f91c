"""Queries over patch scans: which boxes an image gets in each mode, and what they tell."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import patches
from ..sources import adapters
from .evaluation import DIGITS, rounded

QUERIES: dict = {}
SQL: dict[str, str] = {}
T = 0.5
SETTINGS = patches.Settings()


def _add(query, sql: str | None = None):
    QUERIES[query.__name__] = query
    if sql:
        SQL[query.__name__] = sql


def _images(spark, sf_dir) -> DataFrame:
    """Parts as images with a whole score that some lack; every fifth is a square that one box covers."""
    key, size = F.col("p_partkey"), F.col("p_size")
    width = F.when(key % 5 == 0, 70 + size * 2).otherwise(100 + key % 900)
    height = F.when(key % 5 == 0, 70 + size * 2).otherwise(50 + size * 17)
    return adapters.table(spark, sf_dir, "part").select(
        key.alias("id"), width.cast("int").alias("width"), height.cast("int").alias("height"), F.when(key % 7 != 0, (key * 31 % 97) / 97.0).alias("whole")
    )


def _scorer(boxes: DataFrame) -> DataFrame:
    """A stand-in for a model: a score that follows from the place."""
    return boxes.withColumn("score", ((F.col("x") * 7 + F.col("y") * 13 + F.col("w") * 3 + F.col("id")) % 101) / 101.0)


IMAGES = """im AS (SELECT p_partkey AS id, (CASE WHEN p_partkey % 5 = 0 THEN 70 + p_size * 2 ELSE 100 + p_partkey % 900 END)::INT AS width,
  (CASE WHEN p_partkey % 5 = 0 THEN 70 + p_size * 2 ELSE 50 + p_size * 17 END)::INT AS height, CASE WHEN p_partkey % 7 <> 0 THEN (p_partkey * 31 % 97) / 97.0::DOUBLE END AS whole FROM part)"""
MODEL = "((x * 7 + y * 13 + w * 3 + id) % 101) / 101.0::DOUBLE"


def _grid(name: str, stride: int, most: int) -> str:
    """Boxes of one grid: id, place, x, y, w, h, width, height, whole, n."""
    return f"""{name}s AS (SELECT *, least(width, height, 256) AS s, least({stride}, least(width, height, 256)) AS d FROM im WHERE least(width, height) >= 64),
  {name}x AS (SELECT DISTINCT id, x FROM (SELECT id, unnest(list_append(range(0, width - s + 1, d), width - s)) AS x FROM {name}s)),
  {name}y AS (SELECT DISTINCT id, y FROM (SELECT id, unnest(list_append(range(0, height - s + 1, d), height - s)) AS y FROM {name}s)),
  {name}b AS (SELECT id, x, y, row_number() OVER (PARTITION BY id ORDER BY y, x) - 1 AS i, count(*) OVER (PARTITION BY id) AS m FROM {name}x JOIN {name}y USING (id)),
  {name} AS (SELECT id, (row_number() OVER (PARTITION BY id ORDER BY i) - 1)::INT AS place, x::INT AS x, y::INT AS y, s::INT AS w, s::INT AS h, width, height, whole, count(*) OVER (PARTITION BY id) AS n
    FROM {name}b JOIN {name}s USING (id) WHERE m <= {most} OR i IN (SELECT round_even(k * (m - 1) / {most - 1}.0::DOUBLE, 0)::BIGINT FROM range({most}) t(k)))"""


COVERS = "(x = 0 AND y = 0 AND w = width AND h = height AND whole IS NOT NULL)"
SCORED = f"CASE WHEN {COVERS} THEN whole ELSE {MODEL} END AS score, CASE WHEN {COVERS} THEN 'whole' ELSE 'model' END AS origin"
BOXES = f"""{IMAGES}, {_grid('cg', 256, 12)}, {_grid('fg', 192, 24)},
  c1 AS (SELECT *, {SCORED} FROM cg), f1 AS (SELECT *, {SCORED} FROM fg),
  rk AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, place) AS r FROM c1),
  pt AS (SELECT id, width, height, whole, n, least(x + i * (w // 2), width - w // 2)::INT AS x, least(y + j * (h // 2), height - h // 2)::INT AS y, (w // 2)::INT AS w, (h // 2)::INT AS h, r * 4 + j * 2 + i AS o
    FROM rk CROSS JOIN range(2) a(i) CROSS JOIN range(2) b(j) WHERE r <= 3 AND w // 2 >= 64),
  un AS (SELECT id, width, height, whole, n, x, y, w, h, min(o) AS o FROM pt GROUP BY ALL),
  lm AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY o) AS k FROM un),
  tk AS (SELECT id, place, x, y, w, h, score, 1 AS pass, origin FROM c1
    UNION ALL SELECT l.id, (l.n + l.k - 1)::INT, l.x, l.y, l.w, l.h, CASE WHEN l.x = 0 AND l.y = 0 AND l.w = l.width AND l.h = l.height AND l.whole IS NOT NULL THEN l.whole
        ELSE coalesce(c1.score, ((l.x * 7 + l.y * 13 + l.w * 3 + l.id) % 101) / 101.0::DOUBLE) END, 2,
      CASE WHEN l.x = 0 AND l.y = 0 AND l.w = l.width AND l.h = l.height AND l.whole IS NOT NULL THEN 'whole' WHEN c1.score IS NOT NULL THEN 'known' ELSE 'model' END
    FROM lm l LEFT JOIN c1 ON l.id = c1.id AND l.x = c1.x AND l.y = c1.y AND l.w = c1.w AND l.h = c1.h WHERE l.k <= 24 - l.n),
  md AS (SELECT 'top_k' AS mode, * FROM tk UNION ALL SELECT 'coarse', id, place, x, y, w, h, score, 1, origin FROM c1 WHERE n > 1
    UNION ALL SELECT 'full', id, place, x, y, w, h, score, 1, origin FROM f1 WHERE n > 1
    UNION ALL SELECT 'uncertain_only', id, place, x, y, w, h, score, 1, origin FROM f1 WHERE n > 1 AND (whole IS NULL OR whole BETWEEN 0.2::DOUBLE AND 0.8::DOUBLE))"""


def patch_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E-09, E-07, T-04: two passes over every image, the second over parts of the three highest boxes."""
    found = patches.scan(_images(spark, sf_dir), _scorer, patches.Settings(mode="top_k"))
    return rounded(found, "score")


_add(patch_scan, f"WITH {BOXES} SELECT id, place, x, y, w, h, round(score, {DIGITS}) AS score, pass, origin FROM tk")


def patch_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E-09, A-26, R-16: passes, reuse, evidence, agreement and covered share per image and mode."""
    found = patches.every_mode(_images(spark, sf_dir), _scorer, SETTINGS, T)
    return rounded(found, "evidence", "agreement", "coverage")


_add(patch_modes, f"""WITH {BOXES},
  ex AS (SELECT DISTINCT mode, id, x AS v FROM md UNION SELECT DISTINCT mode, id, x + w FROM md), ey AS (SELECT DISTINCT mode, id, y AS v FROM md UNION SELECT DISTINCT mode, id, y + h FROM md),
  sx AS (SELECT mode, id, v, lead(v) OVER (PARTITION BY mode, id ORDER BY v) - v AS l FROM ex), sy AS (SELECT mode, id, v, lead(v) OVER (PARTITION BY mode, id ORDER BY v) - v AS l FROM ey),
  cl AS (SELECT DISTINCT b.mode, b.id, sx.v AS cx, sy.v AS cy, sx.l * sy.l AS area FROM md b JOIN sx ON sx.mode = b.mode AND sx.id = b.id AND sx.v >= b.x AND sx.v < b.x + b.w
    JOIN sy ON sy.mode = b.mode AND sy.id = b.id AND sy.v >= b.y AND sy.v < b.y + b.h),
  ar AS (SELECT mode, id, sum(area) AS area FROM cl GROUP BY 1, 2),
  ag AS (SELECT mode, id, count(*) AS boxes, count(*) FILTER (origin = 'model') AS passes, count(*) FILTER (origin <> 'model') AS reused, avg(score) AS mean, count(*) FILTER (score >= {T}) AS yes,
    list_reverse_sort(list(score))[:3] AS top FROM md GROUP BY 1, 2)
  SELECT m.mode, im.id, ag.id IS NOT NULL AS available, coalesce(boxes, 0)::INT AS boxes, coalesce(passes, 0) AS passes, coalesce(reused, 0) AS reused, round(list_sum(top) / len(top), {DIGITS}) AS evidence,
    round(CASE WHEN coalesce(whole, mean) >= {T} THEN yes ELSE boxes - yes END::DOUBLE / boxes, {DIGITS}) AS agreement, round(area::DOUBLE / (width::DOUBLE * height), {DIGITS}) AS coverage
  FROM im CROSS JOIN (VALUES ('off'), ('coarse'), ('full'), ('top_k'), ('uncertain_only')) m(mode) LEFT JOIN ag ON ag.mode = m.mode AND ag.id = im.id LEFT JOIN ar ON ar.mode = m.mode AND ar.id = im.id""")
