"""Queries over boxes, pixels and event windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import pixels, rules, scorers
from ..operators import geometry
from ..sources import adapters
from ..streaming import windows
from .evaluation import DIGITS, rounded

QUERIES: dict = {}
SQL: dict[str, str] = {}


def _add(query, sql: str | None = None):
    QUERIES[query.__name__] = query
    if sql:
        SQL[query.__name__] = sql


def _images(spark, sf_dir) -> DataFrame:
    """Parts as images; the sides follow from the key and the size."""
    parts = adapters.table(spark, sf_dir, "part")
    return parts.select(F.col("p_partkey").alias("id"), (200 + F.col("p_partkey") % 900).cast("int").alias("width"), (50 + F.col("p_size") * 17).cast("int").alias("height"))


IMG = "img AS (SELECT p_partkey AS id, (200 + p_partkey % 900)::INT AS width, (50 + p_size * 17)::INT AS height FROM part)"
GRID = IMG + """, sz AS (SELECT *, least(width, height, 256) AS s, least(192, least(width, height, 256)) AS d FROM img WHERE least(width, height) >= 64),
  xs AS (SELECT DISTINCT id, s, x FROM (SELECT id, s, unnest(list_append(range(0, width - s + 1, d), width - s)) AS x FROM sz)),
  ys AS (SELECT DISTINCT id, y FROM (SELECT id, unnest(list_append(range(0, height - s + 1, d), height - s)) AS y FROM sz)),
  bx AS (SELECT id, s, x, y, row_number() OVER (PARTITION BY id ORDER BY y, x) - 1 AS i, count(*) OVER (PARTITION BY id) AS n FROM xs JOIN ys USING (id)),
  pk AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY i) - 1 AS place FROM bx WHERE n <= 12 OR i IN (SELECT round_even(k * (n - 1) / 11.0::DOUBLE, 0)::BIGINT FROM range(12) t(k)))"""


def patch_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E-05, T-09."""
    return geometry.patch_grid(_images(spark, sf_dir))


_add(patch_grid, f"WITH {GRID} SELECT id, place::INT AS place, x::INT AS x, y::INT AS y, s AS w, s AS h FROM pk")


def exact_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E-06."""
    return geometry.exact_grid(_images(spark, sf_dir))


_add(exact_grid, f"""WITH {IMG}, t AS (SELECT *, width // 4 AS tw, height // 4 AS th FROM img WHERE width // 4 >= 64 AND height // 4 >= 64)
  SELECT id, (j * 4 + i)::INT AS place, (i * tw)::INT AS x, (j * th)::INT AS y, (CASE WHEN i = 3 THEN width - tw * 3 ELSE tw END)::INT AS w, (CASE WHEN j = 3 THEN height - th * 3 ELSE th END)::INT AS h
  FROM t CROSS JOIN range(4) a(i) CROSS JOIN range(4) b(j)""")


def refine_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E-07, W-09."""
    return geometry.refine(geometry.grids(_images(spark, sf_dir)))


_add(refine_boxes, f"""WITH {GRID} SELECT DISTINCT id, (x + i * (s // 2))::INT AS x, (y + j * (s // 2))::INT AS y, (s // 2)::INT AS w, (s // 2)::INT AS h
  FROM (SELECT id, x, y, s FROM pk) CROSS JOIN range(2) a(i) CROSS JOIN range(2) b(j) WHERE s // 2 >= 64""")


def topk_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R-16, T-04: the five scores of an item as patch scores."""
    items = adapters.scored_items(spark, sf_dir)
    scores = F.array(*adapters.CONDITIONS)
    return rounded(items.select("item_id", *[rules.evidence(scores, k).alias(k) for k in ("topk", "max", "mean")]), "topk", "max", "mean")


_add(topk_evidence, f"""WITH {adapters.ITEMS_SQL}, s AS (SELECT item_id, list_reverse_sort([clean, blur, noise, jpeg, crop]) AS a, clean, blur, noise, jpeg, crop FROM items)
  SELECT item_id, round((0.0::DOUBLE + a[1] + a[2] + a[3]) / 3, {DIGITS}) AS topk, round(a[1], {DIGITS}) AS max, round((0.0::DOUBLE + clean + blur + noise + jpeg + crop) / 5, {DIGITS}) AS mean FROM s""")


def heatmap_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E-08: cells of 128 pixels; a box's score follows from its place."""
    boxes = geometry.with_scores(geometry.grids(_images(spark, sf_dir)), lambda b: b["place"] / 16.0)
    return rounded(geometry.heatmap(boxes, 128), "score")


_add(heatmap_coverage, f"""WITH {GRID}, c AS (SELECT id, place / 16.0::DOUBLE AS score, unnest(range(((x + 127) // 128)::BIGINT, ((x + s + 127) // 128)::BIGINT)) AS cx, (y + 127) // 128 AS y0, (y + s + 127) // 128 AS y1 FROM pk),
  d AS (SELECT id, score, cx, unnest(range(y0::BIGINT, y1::BIGINT)) AS cy FROM c)
  SELECT id, cx::INT AS cx, cy::INT AS cy, round(avg(score), {DIGITS}) AS score, count(*) AS boxes FROM d GROUP BY 1, 2, 3""")


def chosen_patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E-09: the three highest boxes of each image."""
    boxes = geometry.with_scores(geometry.grids(_images(spark, sf_dir)), lambda b: (b["place"] * 7 % 5) / 5.0)
    return geometry.chosen_patches(boxes, 3)


_add(chosen_patches, f"""WITH {GRID}, b AS (SELECT id, place::INT AS place, x::INT AS x, y::INT AS y, s AS w, s AS h, (place * 7 % 5) / 5.0::DOUBLE AS score FROM pk),
  r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, place) AS k FROM b) SELECT * EXCLUDE (k) FROM r WHERE k <= 3""")


CHAINS = pixels.chains(1234)


def chain_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E-02, E-04: every part's image gets one of the chains, as rows of operations with their seeds."""
    parts = adapters.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), (F.col("p_partkey") % len(CHAINS)).cast("int").alias("ordinal"))
    return parts.join(F.broadcast(pixels.chain_table(spark, seed=1234)), "ordinal")  # some dozen rows, whatever the input


_chains = ", ".join(f"({k}, '{n}', {list(ops)!r})" for k, (n, ops) in enumerate(CHAINS))
_add(chain_steps, f"""WITH c(ordinal, chain, ops) AS (VALUES {_chains}), s AS (SELECT ordinal, chain, unnest(ops) AS op, generate_subscripts(ops, 1) - 1 AS position FROM c)
  SELECT p_partkey AS id, s.ordinal::INT AS ordinal, chain, position::INT AS position, op, {1234}::BIGINT + {pixels.PLACE_STEP} * position AS seed FROM part JOIN s ON p_partkey % {len(CHAINS)} = s.ordinal""")


def _tiles(spark, sf_dir) -> DataFrame:
    """Embeddings as 8x8 grey tiles: a carrier, as the tables hold no images."""
    rows = adapters.table(spark, sf_dir, "embeddings")
    return rows.select(F.col("vec_id").alias("id"), F.transform("embedding", lambda v: 0.5 + 0.2 * v.cast("double")).alias("pixels"))


def _summed(rows: DataFrame) -> DataFrame:
    mean = F.aggregate("pixels", F.lit(0.0), lambda s, x: s + x) / F.size("pixels")
    return rows.select("id", "condition", "ordinal", "height", "width", "error", F.round(mean, 6).alias("mean"))


def pixel_transforms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E-01, E-03, X-02: the fourteen transforms of every tile; tests compare with plain loops."""
    return _summed(pixels.transform(_tiles(spark, sf_dir), 8, 8, seed=1234))


_add(pixel_transforms)


def pixel_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E-04: the named and drawn chains of every tile; tests compare with plain loops."""
    return _summed(pixels.transform_chains(_tiles(spark, sf_dir), 8, 8, seed=1234))


_add(pixel_chains)


def pixel_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C-02: classes of tiles with equal pixels."""
    rows = _tiles(spark, sf_dir).select("id", pixels.pixel_hash(F.col("pixels"), 8, 8).alias("hash"))
    return rows.groupBy("hash").agg(F.count(F.lit(1)).alias("copies"), F.min("id").alias("first_id"))


_add(pixel_hashes, """WITH t AS (SELECT vec_id AS id, array_to_string(list_transform(embedding, lambda v: floor(least(greatest(0.5::DOUBLE + 0.2::DOUBLE * v::DOUBLE, 0), 1) * 255.0::DOUBLE + 0.5::DOUBLE)::INT), ',') AS p FROM embeddings)
  SELECT sha256('8x8:' || p) AS hash, count(*) AS copies, min(id) AS first_id FROM t GROUP BY 1""")


def frequency_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E-10; tests compare with plain loops."""
    return pixels.frequency(_tiles(spark, sf_dir), 8, 8)


_add(frequency_features)


def model_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X-01: a linear model over embeddings, loaded once per worker."""
    rows = adapters.table(spark, sf_dir, "embeddings")
    score = scorers.scorer(scorers.linear([(k % 7 - 3) / 10.0 for k in range(64)], 0.1))
    return rows.select("vec_id", F.round(score(F.col("embedding")), 5).alias("score"))


_add(model_scores, """SELECT vec_id, round(1.0::DOUBLE / (1.0::DOUBLE + exp(-(0.1::DOUBLE + z))), 5) AS score
  FROM (SELECT vec_id, sum(v::DOUBLE * (((i - 1) % 7 - 3) / 10.0::DOUBLE)) AS z FROM (SELECT vec_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY 1)""")


def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EXT Z-05 in batch form: hourly metrics of event scores."""
    return rounded(windows.hourly(windows.event_scores(adapters.table(spark, sf_dir, "events"))), "mean_score")


_add(event_windows, f"""WITH e AS (SELECT date_trunc('hour', ts) AS hour, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS y, least(greatest(value / 100, 0), 1) AS s FROM events)
  SELECT strftime(hour, '%Y-%m-%d %H:00:00') AS hour, count(*) AS count, count(*) FILTER (y = 1 AND s >= 0.5) AS tp, count(*) FILTER (y = 0 AND s >= 0.5) AS fp, round(avg(s), {DIGITS}) AS mean_score FROM e GROUP BY hour""")
