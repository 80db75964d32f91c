"""Query op7: documents as token ids, written to a Huffman-coded file and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import token_file

NAME = "op7_token_file"
SQL = None  # the tokenizer is beyond SQL; tests compare with the library on whole texts


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return token_file.read(*token_file.write(docs, public_tokenizers.path("byte_bpe_50k.json")))
