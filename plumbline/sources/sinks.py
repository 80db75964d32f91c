"""Writers of tables, reports, manifests and caches (S-13 to S-22)."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def csv_table(df: DataFrame, path: str, columns: list[str] | None = None, order: list[str] | None = None) -> None:
    """S-14 to S-17: exact column order, with a header; T-08: rows sorted over all files, if asked."""
    df = df.orderBy(*order) if order else df
    (df.select(*columns) if columns else df).write.mode("overwrite").option("header", "true").csv(path)


def json_records(df: DataFrame, path: str) -> None:
    """S-13, S-18, S-21, S-22: one JSON object per row, nulls kept."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def cache(df: DataFrame, path: str, provenance: dict[str, str]) -> None:
    """S-20, Z-04: a Parquet table and what it was made with."""
    df.write.mode("overwrite").parquet(path)
    one = df.sparkSession.createDataFrame([tuple(provenance.values())], ", ".join(f"`{k}` string" for k in provenance))
    one.coalesce(1).write.mode("overwrite").json(f"{path}-provenance")


def manifest(rows: DataFrame, id_: str = "img_id") -> DataFrame:
    """S-18: file names under which ``export`` stores the bytes."""
    safe = F.regexp_replace(F.col(id_).cast("string"), "[^0-9A-Za-z_.-]", "_")
    return rows.withColumn("file", F.concat(safe, F.lit("."), F.lower("format")))


def relation_folders(rows: DataFrame, source: str = "source", edited: str = "edited", order: str = "row") -> DataFrame:
    """S-19: folder (20 hex digits of the source), name and content; each source once, edits by their row."""
    folder = F.substring(F.sha2(F.col(source), 256), 1, 20)
    edits = rows.select(folder.alias("folder"), F.concat(F.lit("edit_"), F.col(order)).alias("name"), F.col(edited).alias("content"))
    sources = rows.groupBy(folder.alias("folder")).agg(F.first(source).alias("content")).select("folder", F.lit("source").alias("name"), "content")
    return sources.unionByName(edits)


def export(rows: DataFrame, folder: str) -> None:
    """S-18: writes (file, content) byte for byte; files with that content stay.

    A sink: tasks write their own rows, files are named by the rows, so a task may run twice.
    ``folder`` has to be a mounted path that all executors see."""

    def write(rows):
        import os
        import uuid

        os.makedirs(folder, exist_ok=True)
        for row in rows:
            path = os.path.join(folder, row["file"])
            digest = lambda b: hashlib.sha256(b).digest()
            if os.path.exists(path):
                with open(path, "rb") as old:
                    if digest(old.read()) == digest(bytes(row["content"])):
                        continue
            part = f"{path}.{uuid.uuid4().hex}.tmp"  # its own name for every attempt, as two may run at once
            with open(part, "wb") as out:
                out.write(bytes(row["content"]))
            os.replace(part, path)

    rows.select("file", "content").foreachPartition(write)
