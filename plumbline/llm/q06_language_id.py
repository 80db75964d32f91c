"""Query op6: the language of every document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import language_id

NAME = "op6_language_id"
SQL = None  # a trained model is beyond SQL; tests measure accuracy on held-out documents


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    path = public_tokenizers.path("piece_bpe_32k.model")
    return language_id.predict(docs, *language_id.learn(docs, path), path)
