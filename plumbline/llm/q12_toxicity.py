"""Query op12: the toxicity of every document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import toxicity

NAME = "op12_toxicity"
SQL = None  # a trained model is beyond SQL; tests compare scores with plain loops and measure held-out accuracy


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    out = toxicity.score(docs, toxicity.learn(docs, labels), ["doc_id"])
    worst = F.array_max(F.transform("located", lambda s: F.struct(s["score"], -s["start"], s["end"])))
    return out.select(
        "row.doc_id", toxicity.held_out(F.col("row.doc_id")).alias("held_out"), "score", (F.col("score") >= toxicity.LIKELY).cast("int").alias("predicted"),
        "n_sentences", F.size("located").cast("long").alias("n_located"), (-worst["col2"]).alias("worst_start"), worst["end"].alias("worst_end"),
    )
