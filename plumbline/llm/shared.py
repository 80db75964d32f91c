"""Helpers that the operators of this subpackage share: tables in the folder
that every executor sees, connected components, and a session default."""

from __future__ import annotations

import gc
import os
import re
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_root(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Where it is unset, one of this machine's
    temporary folders in local mode (tests), and an error on a cluster, whose machines
    would not see each other's files."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return "file://" + os.path.join(tempfile.gettempdir(), "plumbline-shared")


class _Scopes(threading.local):
    def __init__(self):
        self.open: list[list[DataFrame]] = []


#: tables written and not yet discarded, by open scope, innermost last; of each thread
_scopes = _Scopes()


@contextmanager
def scope(keep: bool = False) -> Iterator[list[DataFrame]]:
    """Collects the tables that materialize() writes inside, and discards them at the end.

    With keep they stay, and an outer scope gets them; a single one is kept by
    hand_over(): what a result reads lazily has to stay until it has been written."""
    tables: list[DataFrame] = []
    _scopes.open.append(tables)
    try:
        yield tables
    finally:
        _scopes.open.pop()
        if keep:
            for outer in _scopes.open[-1:]:
                outer.extend(tables)
        else:
            discard(*tables)


def materialize(df: DataFrame, name: str, **options) -> DataFrame:
    """Writes df as Parquet into the shared folder and reads it back.

    This cuts lineage: later stages depend on files that survive a lost
    executor, and the planner knows the real size of the table.
    """
    spark = df.sparkSession
    path = f"{shared_root(spark)}/plumbline/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, **options)
    out = spark.read.schema(df.schema).parquet(path)
    out._shared_path = path
    for tables in _scopes.open[-1:]:
        tables.append(out)
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables made by materialize() that nothing reads any more."""
    for df in tables:
        path, df._shared_path = getattr(df, "_shared_path", None), None
        if path:
            jvm = df.sparkSession._jvm
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(target, True)


def packed(names: list[str]) -> Column:
    """Columns of any name as one struct ``row``."""
    quoted = ["`" + c.replace("`", "``") + "`" for c in names]
    return F.struct(*[F.col(q).alias(c) for q, c in zip(quoted, names, strict=True)]).alias("row")


def hand_over(df: DataFrame) -> DataFrame:
    """df, which the open scope no longer discards; an outer one may."""
    if _scopes.open:
        _scopes.open[-1][:] = [t for t in _scopes.open[-1] if t is not df]
        for outer in _scopes.open[-2:-1]:
            outer.append(df)
    return df


def sweep(spark: SparkSession) -> None:
    """Collects garbage on the driver: Spark deletes the shuffle files of finished
    jobs only then, and its driver may not collect any for half an hour."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


#: a side is broadcast only if it has been counted and has no more rows than this
BROADCAST_ROWS = 1 << 20


def sized(side: DataFrame, limit: int = BROADCAST_ROWS, weight=None) -> DataFrame:
    """side, marked for broadcast if its rows (or the sum of weight) are few enough.

    side is a written table, so the count reads no more than a footer or one column.
    Above the limit the planner joins it by shuffling."""
    n = side.count() if weight is None else side.agg(F.sum(weight)).first()[0] or 0
    return F.broadcast(side) if n <= limit else side


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of edges(a, b); component is the smallest node.

    Alternating large-star and small-star steps: each round moves neighbours of a
    node to its smallest neighbour, so a star with millions of leaves takes one
    round and no round holds a component in one task: minima are aggregated on the
    map side and joined back. Nulls and self-loops are ignored; an empty input
    gives an empty result.
    """
    pairs = edges.where("a is not null and b is not null and a <> b").select(
        F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")
    ).distinct()
    pairs = materialize(pairs, "edges")
    state = _state(pairs)
    for _ in range(max_rounds):
        if not state[0]:
            break
        new = materialize(_round(pairs, 1 + state[0] // EDGES), "edges")
        now = _state(new)
        discard(pairs)
        pairs, done = new, now == state
        state = now
        if done:
            break
    else:
        raise RuntimeError("connected components did not settle")
    roots = pairs.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)


#: edges of one partition, about: a round over fewer needs no shuffle
EDGES = 1 << 16


def _round(pairs: DataFrame, parts: int) -> DataFrame:
    pairs = pairs.coalesce(parts)
    way = lambda a, b: F.struct(F.col(a).alias("u"), F.col(b).alias("v"))
    both = pairs.select(F.inline(F.array(way("u", "v"), way("v", "u"))))
    low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    large = both.join(low, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    # every smaller neighbour of u, and u itself, is tied to the smallest of them
    large = large.distinct()
    low = large.groupBy("u").agg(F.min("v").alias("m"))
    small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
    return small.where("u <> v").coalesce(parts).distinct() if parts == 1 else small.where("u <> v").distinct()


def _state(pairs: DataFrame) -> tuple:
    row = pairs.agg(
        F.count(F.lit(1)).alias("n"),
        F.bit_xor(F.xxhash64("u", "v")).alias("x"),
        F.sum(F.pmod(F.xxhash64("v", "u"), F.lit(1 << 31))).alias("s"),
    ).first()
    return (row["n"], row["x"], row["s"])
