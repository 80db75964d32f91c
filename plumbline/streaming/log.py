"""A score log that a stream adds to and a replay does not change (Z-03, Z-04, S-12).

A micro-batch is one folder, ``batch=<id>``, which its commit replaces as a whole: a batch
that is run again after a failure leaves the same rows. Readers take the last record of each
key over all batches. The log remembers what its scores were made with, and a writer or
reader that expects something else is refused before it touches a row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _provenance(spark: SparkSession, path: str) -> dict[str, str] | None:
    target = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_provenance/_SUCCESS")
    if not target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target):
        return None
    return spark.read.json(f"{path}/_provenance").first().asDict()


def claim(spark: SparkSession, path: str, provenance: dict[str, str]) -> None:
    """Makes a log for scores of this provenance, or checks that it is one. An error if it isn't."""
    found = _provenance(spark, path)
    if found is None:
        one = spark.createDataFrame([tuple(provenance.values())], ", ".join(f"`{k}` string" for k in provenance))
        one.coalesce(1).write.mode("overwrite").json(f"{path}/_provenance")
    elif found != provenance:
        raise ValueError(f"the log was made with {found}, not {provenance}")


def committer(path: str, provenance: dict[str, str], key: str, at: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: one row per key of the batch, its last by ``at``, as the folder of the batch."""

    def commit(batch: DataFrame, number: int) -> None:
        claim(batch.sparkSession, path, provenance)
        last = batch.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_key")).agg(F.max_by(F.struct(*batch.columns), F.struct(at, F.xxhash64(*batch.columns))).alias("r"))
        last.select("r.*").write.mode("overwrite").parquet(f"{path}/batch={number}")

    return commit


def latest(spark: SparkSession, path: str, provenance: dict[str, str], key: str, at: str) -> DataFrame:
    """The last record of each key: by ``at``, then by batch."""
    claim(spark, path, provenance)
    rows = spark.read.option("basePath", path).parquet(f"{path}/batch=*")
    columns = [c for c in rows.columns if c != "batch"]
    return rows.groupBy(F.col(key).alias("_key")).agg(F.max_by(F.struct(*columns), F.struct(at, "batch")).alias("r")).select("r.*")


def append(rows: DataFrame, path: str, checkpoint: str, provenance: dict[str, str], key: str, at: str):
    """Runs a stream over what is there now into the log; the checkpoint remembers what was read."""
    claim(rows.sparkSession, path, provenance)
    query = rows.writeStream.foreachBatch(committer(path, provenance, key, at)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
