"""Query op5: words of every document that repeat earlier passages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import passage_dedup

NAME = "op5_substring_dedup"
SQL = None  # MinHash candidates are beyond SQL; tests compare with brute force


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = passage_dedup.cut_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.select("row.doc_id", "n_words", "n_removed", "n_spans", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))
