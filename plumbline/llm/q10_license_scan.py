"""Query op10: licence notices in every document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import license_scan

NAME = "op10_license_scans"
SQL = None  # a trained model is beyond SQL; tests measure held-out accuracy


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    scanner, _ = license_scan.train(docs)
    return license_scan.scan(docs, scanner)
