"""Deterministic splits, samples and group isolation (W-03 to W-10, P-06, P-09, C-07, C-08, C-14).

Splits rank rows by a hash of ``seed:id``. A rank over a whole class in one task does not
scale, so ranks are two-level: rows fall into 4096 hash-prefix buckets (one row count
each, summed in a tiny table), and only a bucket is sorted.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Fixed value: the ending that marks a version of an original
SUFFIX = r"(?i)(?:[_-](?:ai[_-]?)?edited|[_-](?:authentic|real)|[_-]v\d+)$"


def seeded_hash(seed: str | int, *parts: Column) -> Column:
    return F.sha2(F.concat_ws(":", F.lit(str(seed)), *[p.cast("string") for p in parts]), 256)


def hash_rank(df: DataFrame, keys: Sequence[str], h: Column, tie: str) -> DataFrame:
    """df with _h, _rank (1-based by hash within keys) and _size of the keys' group."""
    rows = df.withColumn("_h", h).withColumn("_b", F.substring("_h", 1, 3))
    counts = rows.groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_n"))  # at most 4096 rows per key
    whole = W.partitionBy(*keys)
    counts = counts.select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_b").alias("_b2"), F.sum("_n").over(whole).alias("_size"),
        F.coalesce(F.sum("_n").over(whole.orderBy("_b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"),
    )
    on = F.col("_b") == F.col("_b2")
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    ranked = rows.withColumn("_own", F.row_number().over(W.partitionBy(*keys, "_b").orderBy("_h", tie)))
    out = ranked.join(counts, on).withColumn("_rank", F.col("_own") + F.col("_before"))
    return out.drop("_b", "_b2", "_before", "_own", *[f"_k{i}" for i in range(len(keys))])


def _cut(df: DataFrame, keys, ident, seed, cut: Column) -> DataFrame:
    ranked = hash_rank(df, keys, seeded_hash(seed, F.col(ident)), ident)
    first = F.when(F.col("_size") < 2, F.lit(True)).otherwise(F.col("_rank") <= F.greatest(F.least(cut, F.col("_size") - 1), F.lit(1)))
    return ranked.withColumn("split", F.when(first, "validation").otherwise("test")).drop("_h", "_rank", "_size")


def stratified(df: DataFrame, label: str, ident: str, fraction: float = 0.4, seed: int = 1234) -> DataFrame:
    """W-03: per class, the first round_half_even(n * fraction) by hash are for validation."""
    return _cut(df, [label], ident, seed, F.bround(F.col("_size") * fraction, 0).cast("long"))


def halves(df: DataFrame, label: str, ident: str, seed: int = 1234) -> DataFrame:
    """W-04."""
    return _cut(df, [label], ident, seed, F.floor(F.col("_size") / 2))


def hash_sample(df: DataFrame, k: int, ident: str, seed: int, namespace: str) -> DataFrame:
    """W-05: the first k rows by hash; TakeOrdered keeps k per task."""
    return df.withColumn("_h", seeded_hash(seed, F.lit(namespace), F.col(ident))).orderBy("_h", ident).limit(k).drop("_h")


def per_class(df: DataFrame, label: str, order: Sequence[str], limit: int, n_classes: int) -> DataFrame:
    """W-06: the first max(1, limit // n_classes) of each class by order; tasks prune before the shuffle."""
    cap = max(1, limit // n_classes)
    rank = F.row_number().over(W.partitionBy(label).orderBy(*order))
    return df.withColumn("_r", rank).where(F.col("_r") <= cap).drop("_r").orderBy(*order).limit(limit)


def bucket(h: Column, test: float, validation: float) -> Column:
    """W-07: the first 8 hex digits as a share of 2^32."""
    share = F.conv(F.substring(h, 1, 8), 16, 10).cast("double") / 4294967296.0
    return F.when(share < test, "test").when(share < test + validation, "validation").otherwise("train")


def group_id(path: Column) -> Column:
    """P-06: the parent folder of a nested path, else the stem without edit suffixes."""
    stem = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")
    nested = F.size(F.split(path, "/")) > 1
    return F.when(nested, F.regexp_replace(path, r"/[^/]*$", "")).otherwise(F.regexp_replace(stem, SUFFIX, ""))


def group_limit(df: DataFrame, group: str, k: int, seed: int) -> DataFrame:
    """P-09: whole groups, the first k by hash."""
    chosen = df.select(group).distinct().withColumn("_h", seeded_hash(seed, F.col(group))).orderBy("_h", group).limit(k)
    return df.join(chosen.select(group), group, "left_semi")


def collisions(df: DataFrame, group: str, split: str, order: Sequence[str]) -> DataFrame:
    """W-08, C-07: rows whose group a split before theirs has claimed, per group.

    One aggregate per group: the owner is the group's first split in the given order, and
    rows are counted per (group, split) before the groups meet."""
    names = F.array(*[F.lit(s) for s in order])
    counts = df.groupBy(group, split).agg(F.count(F.lit(1)).alias("_n"))
    place = F.array_position(names, F.col(split))
    out = counts.groupBy(group).agg(
        F.min_by(split, place).alias("owner"),
        F.max_by("_n", -place).alias("_own"), F.sum("_n").alias("_all"), F.count(F.lit(1)).alias("splits"),
    )
    return out.where(F.col("splits") > 1).select(group, "owner", "splits", (F.col("_all") - F.col("_own")).alias("rows_elsewhere"))


def leakage(df: DataFrame, group: str, split: str, order: Sequence[str], examples: int = 5) -> DataFrame:
    """C-08: totals and the first groups by name (a report, so the list is short by design)."""
    found = collisions(df, group, split, order)
    totals = found.agg(F.count(F.lit(1)).alias("groups"), F.coalesce(F.sum("rows_elsewhere"), F.lit(0)).alias("rows_elsewhere"))
    first = found.select(group).orderBy(group).limit(examples).agg(F.array_sort(F.collect_list(group)).alias("examples"))
    return totals.join(F.broadcast(first))


def assert_isolated(df: DataFrame, group: str, split: str, order: Sequence[str]) -> None:
    """C-07: raises on the first leaked group."""
    bad = collisions(df, group, split, order).limit(1).collect()
    if bad:
        raise ValueError(f"group {bad[0][0]!r} is in more than one split")


def mixture_size(base: Column, fraction: float, available: Column) -> Column:
    """C-14: round_half_even(base * f / (1 - f)), at most what is there."""
    return F.least(F.bround(base * fraction / (1.0 - fraction), 0).cast("long"), available)


def balance(df: DataFrame, keys: Sequence[str], label: str, group: str) -> DataFrame:
    """A-30, C-16: class counts, groups and imbalance (null without one of the classes)."""
    out = df.groupBy(*keys).agg(
        F.count_if(F.col(label) == 1).alias("positives"), F.count_if(F.col(label) == 0).alias("negatives"), F.countDistinct(group).alias("groups")
    )
    low = F.least("positives", "negatives")
    return out.withColumn("imbalance", F.try_divide(F.greatest("positives", "negatives").cast("double"), low.cast("double")))
