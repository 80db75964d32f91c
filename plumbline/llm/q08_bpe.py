"""Query op8: every document encoded and decoded again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import bpe

NAME = "op8_byte_bpe"
SQL = None  # merges are beyond SQL; tests compare with the library on whole texts


def vocabulary() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return bpe.digests(bpe.encode(docs, *vocabulary(), decode=True))
