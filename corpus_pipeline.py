"""Documents from raw text to token ids, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next stage's docs. All but the last return the columns
of documents; the last returns doc_id, the token ids (little-endian unsigned 32-bit)
and their number, for every document that is left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import bpe, decontaminate, jaccard_join, passage_dedup, quality
from plumbline.llm.q08_bpe import vocabulary
from plumbline.llm.shared import discard, materialize, scope


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the quality rules go."""
    return quality.filter_quality(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return jaccard_join.keep_one(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that repeat earlier ones are cut out of the texts."""
    return passage_dedup.drop_repeats(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a window of the benchmark go."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document; a document whose ids don't decode to its text is an error."""
    coded = bpe.encode(docs, *vocabulary(), carry=("doc_id", "text"), decode=True)
    same = F.col("decoded") == F.coalesce("text", F.lit("")).cast("binary")
    checked = F.when(same, F.col("ids")).otherwise(F.raise_error(F.lit("ids do not decode to the text")).cast("binary"))
    return coded.select("doc_id", "n_tokens", checked.alias("ids"))


#: tables that the last stage called for a folder has left for its lazy result
_left: dict[str, list[DataFrame]] = {}


def _stage(work):
    """work, whose intermediate tables go when the next stage for the same folder begins:
    by then its result has been written."""

    def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        discard(*_left.pop(sf_dir, []))
        with scope(keep=True) as tables:
            out = work(spark, docs, sf_dir)
        _left[sf_dir] = [*tables]
        return out

    return stage


STAGES = [
    ("quality rules", _stage(quality_rules)),
    ("n-gram Jaccard join", _stage(near_duplicates)),
    ("substring dedup", _stage(substring_dedup)),
    ("benchmark decontamination", _stage(decontamination)),
    ("byte-level BPE", _stage(encoding)),
]

#: near copies of passages and token merges are beyond SQL; tests/llm/test_pipeline.py compares with plain Python
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        before, docs = docs, materialize(stage(spark, docs, sf_dir), f"stage-{k}")
        discard(before, *_left.pop(sf_dir, []))
    return docs
