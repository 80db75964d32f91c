"""Query op1: bytes covered by repeated 400-byte strings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import suffix_dedup

NAME = "op1_suffix_array_dedup"
SQL = None  # too slow in SQL on whole tables; tests compare with brute force


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.deduplicate(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
