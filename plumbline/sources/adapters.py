"""Score relations over the driver's tables, which hold no images.

``scored_items`` is wide (one row per item, one column per condition): rules over the
versions of an item need no shuffle there. ``version_scores`` is long (P-02): one row
per item and condition, with the ordinal that keeps the order of conditions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.rules import clip

CONDITIONS = ("clean", "blur", "noise", "jpeg", "crop")
TRANSFORMED = CONDITIONS[1:]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def binary_label(source_label: Column) -> Column:
    """P-01: 0 is negative, 1 and 2 are positive, anything else is an error."""
    return (
        F.when(source_label == 0, F.lit(0))
        .when(source_label.isin(1, 2), F.lit(1))
        .otherwise(F.raise_error(F.lit("unknown class label")).cast("int"))
    )


def scored_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """item_id, source_label, binary_label, a score per condition, and a patch term that some rows lack."""
    rows = table(spark, sf_dir, "lineitem")
    source = F.when(F.col("l_returnflag") == "A", F.lit(0)).when(F.col("l_returnflag") == "N", F.lit(1)).otherwise(F.lit(2))
    clean, blur, noise = clip(F.col("l_discount") * 10), clip(F.col("l_quantity") / 50), clip(F.col("l_tax") * 12)
    return rows.select(
        F.concat_ws("-", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber").alias("item_id"),
        source.alias("source_label"),
        F.round(clean, 6).alias("clean"),
        F.round(blur, 6).alias("blur"),
        F.round(noise, 6).alias("noise"),
        F.round(0.5 * clean + 0.5 * blur, 6).alias("jpeg"),
        F.round(0.8 * clean + 0.2 * noise, 6).alias("crop"),
        F.when(F.col("l_linenumber") % 3 != 0, F.round(0.25 * clean + 0.75 * blur, 6)).alias("patch"),
        F.col("l_linestatus").alias("status"),
    ).withColumn("binary_label", binary_label(F.col("source_label")))


ITEMS_SQL = """items AS (
  SELECT concat_ws('-', l_orderkey, l_partkey, l_suppkey, l_linenumber) AS item_id,
    CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS source_label,
    CASE l_returnflag WHEN 'A' THEN 0 ELSE 1 END AS binary_label,
    round(c, 6) AS clean, round(b, 6) AS blur, round(n, 6) AS noise,
    round(0.5::DOUBLE * c + 0.5::DOUBLE * b, 6) AS jpeg, round(0.8::DOUBLE * c + 0.2::DOUBLE * n, 6) AS crop,
    CASE WHEN l_linenumber % 3 <> 0 THEN round(0.25::DOUBLE * c + 0.75::DOUBLE * b, 6) END AS patch,
    l_linestatus AS status
  FROM (SELECT *, least(greatest(l_discount * 10, 0), 1) AS c, least(greatest(l_quantity / 50, 0), 1) AS b,
               least(greatest(l_tax * 12, 0), 1) AS n FROM lineitem))"""


def to_long(items: DataFrame, conditions: tuple[str, ...] = CONDITIONS, keep: tuple[str, ...] = ("item_id", "source_label", "binary_label")) -> DataFrame:
    """keep, condition, ordinal, score."""
    names = F.array(*[F.lit(c) for c in conditions])
    long = items.unpivot([F.col(c) for c in keep], [F.col(c) for c in conditions], "condition", "score")
    return long.withColumn("ordinal", (F.array_position(names, F.col("condition")) - 1).cast("int"))


def version_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As to_long, with the clean score of the item's row as ``own``."""
    items = scored_items(spark, sf_dir).withColumn("own", F.col("clean"))
    return to_long(items, keep=("item_id", "source_label", "binary_label", "own"))


VERSIONS_SQL = ITEMS_SQL + ", vs AS (" + " UNION ALL ".join(
    f"SELECT item_id, source_label, binary_label, '{c}' AS condition, {k} AS ordinal, {c} AS score, clean AS own FROM items" for k, c in enumerate(CONDITIONS)
) + ")"


def transformed(*names: str) -> list[Column]:
    """The transformed scores of a wide row."""
    return [F.col(c) for c in (names or TRANSFORMED)]


def scored_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents: quality is the label, a deterministic share of vowels the score."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    size = F.length(F.coalesce("text", F.lit("")))
    vowels = size - F.length(F.translate(F.coalesce("text", F.lit("")), "aeiou", ""))
    score = F.coalesce(F.try_divide(vowels, size), F.lit(0.0))
    short = F.least(F.lit(1.0), size / F.lit(4000.0))
    return docs.join(labels, "doc_id").select(
        "doc_id", "lang", "source", F.col("quality").alias("binary_label"), "toxic",
        F.round(score, 6).alias("clean"), F.round(0.5 * score + 0.5 * short, 6).alias("length"),
    )


DOCS_SQL = """sd AS (
  SELECT doc_id, lang, source, quality AS binary_label, toxic, round(s, 6) AS clean, round(0.5::DOUBLE * s + 0.5::DOUBLE * k, 6) AS length
  FROM (SELECT *, CASE WHEN z = 0 THEN 0.0::DOUBLE ELSE v::DOUBLE / z END AS s, least(1.0::DOUBLE, z / 4000.0::DOUBLE) AS k
        FROM (SELECT d.*, l.quality, l.toxic, length(coalesce(text, '')) AS z,
                     length(coalesce(text, '')) - length(translate(coalesce(text, ''), 'aeiou', '')) AS v
              FROM documents d JOIN labels l USING (doc_id))))"""
