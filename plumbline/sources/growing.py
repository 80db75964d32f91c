"""A class-capped scan of shards that stops early (Z-01, with S-01, S-02, T-05, W-06).

``capped`` in ``readers`` reads every row. Where the first shards hold enough, this scan
opens shards in order, in jobs of one, two, four .. of them, carries a counter per class
from job to job, and opens no further shard once every class is full."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .readers import labelled


def shard_paths(spark: SparkSession, folder: str, split: str | None = None) -> list[str]:
    """Paths of the shards below a folder by file name, hidden ones left out; nothing is opened. An error if there are none."""
    jvm = spark._jvm
    top = jvm.org.apache.hadoop.fs.Path(folder)
    files = top.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(top, True)
    found = []
    while files.hasNext():
        path = files.next().getPath()
        name = path.getName()
        if name.endswith(".parquet") and name.startswith(f"{split}-" if split else "") and not name.startswith((".", "_")):
            found.append((name, path.toString()))
    if not found:
        raise FileNotFoundError(f"no shards below {folder}")
    return [p for _, p in sorted(found)]


def first_of_each(
    spark: SparkSession, folder: str, per_class: int, split: str | None = None, known: tuple[int, ...] = (0, 1, 2), schema: str | None = None
) -> DataFrame:
    """The first ``per_class`` usable rows of each class in shard order, as ``capped(labelled(shards(..)), per_class)``.

    What is counted on the way is one number per class and shard. The result reads the opened
    shards only; with a schema, even their footers are first read in that order."""
    left = dict.fromkeys(known, per_class)
    paths, at, size, parts = shard_paths(spark, folder, split), 0, 1, []
    while at < len(paths) and any(n > 0 for n in left.values()):
        some = paths[at : at + size]
        reader = spark.read.schema(schema) if schema else spark.read
        rows = reader.parquet(*some).select("*", F.col("_metadata.file_name").alias("shard"), F.col("_metadata.row_index").alias("row"))
        usable = labelled(rows, known)
        counts = {r["label"]: r["n"] for r in usable.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
        wanted = {k: min(n, counts.get(k, 0)) for k, n in left.items() if n > 0 and counts.get(k, 0)}
        if wanted:
            most = F.lit(0)
            for k, n in wanted.items():
                most = F.when(F.col("label") == k, F.lit(n)).otherwise(most)
            place = F.row_number().over(W.partitionBy("label").orderBy("shard", "row"))
            parts.append(usable.withColumn("_r", place).where(F.col("_r") <= most).drop("_r"))
        for k, n in counts.items():
            left[k] -= n
        at, size = at + size, size * 2
    if not parts:
        return usable.limit(0)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
