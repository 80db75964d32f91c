"""What happens to metrics and scores under each condition (A-07 to A-17, A-25, A-26).

All functions take long relations (one row per item and condition) and group by the
condition; comparisons with the clean baseline use metric tables of one row per
condition, never the items.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import metrics, radix

SUMMARY_METRICS = ("accuracy", "precision_", "recall", "f1", "auc")


def per_condition(versions: DataFrame, threshold: float) -> DataFrame:
    """A-07, A-08, P-12: metrics, mean and population std; a condition that an item lacks is left out."""
    hist = versions.groupBy("condition", "ordinal", "score").agg(
        F.count_if(F.col("binary_label") == 1).alias("p"), F.count_if(F.col("binary_label") != 1).alias("n")
    )
    whole = hist.groupBy("condition").agg(F.count_if(F.col("score").isNull()).alias("_lacking")).where("_lacking = 0").select("condition")
    found = metrics.from_histogram(hist.where(F.col("score").isNotNull()), ["condition", "ordinal"], threshold, moments=True)
    return found.join(F.broadcast(whole), "condition", "left_semi")


def drops(table: DataFrame, names: Sequence[str] = SUMMARY_METRICS, baseline: str = "clean") -> DataFrame:
    """J-08: metric, condition, ordinal, value, clean, drop, ratio (null where clean is 0)."""
    long = table.unpivot(["condition", "ordinal"], list(names), "metric", "value")
    base = F.max(F.when(F.col("condition") == baseline, F.col("value"))).over(W.partitionBy("metric"))
    long = long.withColumn("clean", base)
    return long.where(F.col("condition") != baseline).withColumns(
        {"drop": F.col("clean") - F.col("value"), "ratio": F.try_divide(F.col("value"), F.col("clean"))}
    )


def summary(table: DataFrame, names: Sequence[str] = SUMMARY_METRICS) -> DataFrame:
    """A-09: clean, mean, worst (largest drop, the first condition on ties), mean ratio."""
    known = F.col("value").isNotNull()
    return drops(table, names).groupBy("metric").agg(
        F.max("clean").alias("clean"), F.avg("value").alias("mean_value"), F.min("value").alias("worst_value"),
        F.max_by("condition", F.when(known, F.struct("drop", -F.col("ordinal")))).alias("worst_condition"),
        F.max("drop").alias("largest_drop"), F.avg(F.when(F.col("ratio") != 0, F.col("ratio"))).alias("mean_ratio"),
    )


def ranking(table: DataFrame, metric: str = "accuracy") -> DataFrame:
    """A-10, T-02: conditions by drop, nulls last, in their order on ties."""
    out = drops(table, [metric])
    place = F.row_number().over(W.orderBy(F.desc_nulls_last("drop"), "ordinal"))  # one row per condition
    return out.select("condition", "value", "drop", "ratio", place.alias("place"))


def variant_metrics(items: DataFrame, names: Sequence[str], threshold: float, label: str = "binary_label") -> DataFrame:
    """A-11, P-07: each variant on the rows that have it, and the number skipped."""
    long = items.unpivot([label], list(names), "variant", "score")
    skipped = long.groupBy("variant").agg(F.count("score").alias("count"), F.count_if(F.col("score").isNull()).alias("skipped"))
    return skipped.join(metrics.binary_metrics(long, ["variant"], threshold, label), "variant", "left")


def families(items: DataFrame, names: dict[int, str], threshold: float, score: str = "fused", shared: int = 0) -> DataFrame:
    """A-12, J-10: each positive class against the shared pool of class ``shared``.

    Items become counts per class and score first; those of the pool are exploded into every
    family, and one pass over them gives metrics and mean. Nothing is joined."""
    counts = items.groupBy("source_label", "binary_label", F.col(score).alias("score")).agg(F.count(F.lit(1)).alias("c"))
    every = F.array(*[F.lit(v) for v in names.values()])
    own = F.create_map(*[x for k, v in names.items() for x in (F.lit(k), F.array(F.lit(v)))])
    member = F.when(F.col("source_label") == shared, every).otherwise(F.try_element_at(own, F.col("source_label")))
    known, yes = F.col("score").isNotNull(), F.col("binary_label") == 1
    some = lambda when, name: F.sum(F.when(when, F.col("c")).otherwise(0)).alias(name)
    hist = counts.withColumn("family", F.explode(member)).groupBy("family", "score").agg(
        some(known & yes, "p"), some(known & ~yes, "n"), some(F.col("source_label") != shared, "own")
    )
    sums = {"_own": F.sum("own"), "_total": F.sum(F.coalesce("score", F.lit(0.0)) * F.col("own"))}
    out = metrics.from_histogram(hist, ["family"], threshold, more=sums)
    return out.withColumn("mean_score", F.try_divide(F.col("_total"), F.col("_own").cast("double"))).drop("_own", "_total")


def class_breakdown(versions: DataFrame, threshold: float) -> DataFrame:
    """A-13: accuracy and mean score per source class and condition."""
    right = (F.col("score") >= threshold) == (F.col("binary_label") == 1)
    return versions.groupBy("condition", "source_label").agg(
        F.count(F.lit(1)).alias("count"), F.avg(right.cast("double")).alias("accuracy"), F.avg("score").alias("mean_score")
    )


def _counted(rows: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """keys, _v, _c: how often each value occurs; a null value has 0. What makes the value is worked out once for a row, and not
    again by every pass over the counts."""
    return rows.groupBy(*keys, F.col(value).cast("double").alias("_v")).agg(F.count(F.col(value).cast("double")).alias("_c"))


def _with_quantiles(table: DataFrame, counted: DataFrame, keys: Sequence[str], **shares: float) -> DataFrame:
    """table, one row per key, with quantiles of the counted values: null for a key without any."""
    found = radix.quantiles(counted, keys, "_v", shares, "_c")
    out = table.alias("a").join(found.alias("q"), radix.same(keys, "a", "q"), "left")
    return out.select("a.*", *[F.col(f"q.{n}") for n in shares])


def distributions(versions: DataFrame, keys: Sequence[str] = ("condition", "source_label")) -> DataFrame:
    """A-14: quantiles are exact and interpolated; scores need not be rounded."""
    table = versions.groupBy(*keys).agg(F.count("score").alias("count"), F.avg("score").alias("mean"), F.stddev_pop("score").alias("std"))
    return _with_quantiles(table, _counted(versions, keys, "score"), keys, median=0.5, p05=0.05, p95=0.95)


def consistency_distribution(items: DataFrame, value: str = "consistency") -> DataFrame:
    """A-15, A-17."""
    counted = _counted(items, [], value)
    table = counted.agg(F.try_divide(F.sum(F.col("_v") * F.col("_c")), F.sum("_c").cast("double")).alias("mean"), F.min("_v").alias("min"))
    return _with_quantiles(table, counted, [], median=0.5, p05=0.05)


def runtime(items: DataFrame, seconds: str, patches: str) -> DataFrame:
    """A-16: the mean number of patches is truncated."""
    table = items.agg(
        F.avg(seconds).alias("mean"), F.min(seconds).alias("min"), F.max(seconds).alias("max"), F.sum(seconds).alias("total"),
        F.avg(patches).cast("int").alias("mean_patches"),
    )
    return _with_quantiles(table, _counted(items, [], seconds), [], median=0.5)


def score_drift(versions: DataFrame, baseline: str = "clean") -> DataFrame:
    """J-09, A-25: score change against ``own``, the item's own clean score that its wide
    row had (so ids need not be unique, and nothing is joined); null for an absent class."""
    rows = versions.where(F.col("condition") != baseline)
    moved = F.col("score") - F.col("own")
    return rows.groupBy("condition", "ordinal").agg(
        F.avg(moved).alias("drift"),
        F.avg(F.when(F.col("binary_label") == 1, moved)).alias("drift_positive"),
        F.avg(F.when(F.col("binary_label") == 0, moved)).alias("drift_negative"),
        F.avg(F.abs(F.col("score") - 0.5) - F.abs(F.col("own") - 0.5)).alias("confidence_drift"),
    )


def chain_report(versions: DataFrame, threshold: float) -> DataFrame:
    """A-25: drift and metrics per chain; the worst by F1 and by drift are flagged."""
    table = score_drift(versions).join(per_condition(versions, threshold).drop("ordinal"), "condition")
    every = W.partitionBy(F.lit(1))  # one row per chain
    worst = lambda by: F.min_by("condition", F.struct(by, "ordinal")).over(every)
    return table.withColumn("worst_by_f1", F.col("condition") == worst("f1")).withColumn("worst_by_drift", F.col("condition") == worst("drift"))


def severity_curve(table: DataFrame, levels: DataFrame) -> DataFrame:
    """A-36: metrics against levels(condition, family, level) of families with two points or more."""
    both = table.join(levels, "condition")
    many = F.count(F.lit(1)).over(W.partitionBy("family")) >= 2
    return both.withColumn("_many", many).where("_many").select("family", "level", "condition", "accuracy", "auc")


def score_histogram(versions: DataFrame, bins: int = 25) -> DataFrame:
    """A-37: equal bins over [0, 1], the last one closed; edges are compared as doubles."""
    at = F.least(F.floor(F.col("score") * bins), F.lit(bins - 1))
    at = F.when(F.col("score") >= (at + 1) / float(bins), at + 1).when(F.col("score") < at / float(bins), at - 1).otherwise(at)
    return versions.where(F.col("score").isNotNull()).groupBy("condition", F.least(at, F.lit(bins - 1)).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("count"))


def range_histogram(rows: DataFrame, keys: Sequence[str], value: str = "score", bins: int = 10) -> DataFrame:
    """A-37: equal bins between the least and the largest known value of each key, all of them, the last one closed.

    A key with one value has bins from half below to half above it. Rows are counted per bin
    in their tasks; only two numbers of a key are joined to them."""
    keys = list(keys)
    known = rows.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_x"))
    ends = known.groupBy(*keys).agg(F.min("_x").alias("_lo"), F.max("_x").alias("_hi"))
    flat = F.col("_lo") == F.col("_hi")
    ends = ends.select(*keys, F.when(flat, F.col("_lo") - 0.5).otherwise(F.col("_lo")).alias("_lo"), F.when(flat, F.col("_hi") + 0.5).otherwise(F.col("_hi")).alias("_hi"))
    edge = lambda k: F.when(k >= bins, F.col("_hi")).otherwise(F.col("_lo") + k * ((F.col("_hi") - F.col("_lo")) / float(bins)))
    both = known.alias("r").join(ends.alias("e"), radix.same(keys, "r", "e")).select("r.*", "e._lo", "e._hi")
    near = F.greatest(F.least(F.floor((F.col("_x") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * bins), F.lit(bins - 1)), F.lit(0))
    # edges are compared as doubles: a value on one is in the bin above it
    both = both.withColumn("_k", near)
    at = F.when(F.col("_x") < edge(F.col("_k")), F.col("_k") - 1).when((F.col("_k") < bins - 1) & (F.col("_x") >= edge(F.col("_k") + 1)), F.col("_k") + 1).otherwise(F.col("_k"))
    counts = both.groupBy(*keys, at.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("c"))
    every = ends.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    out = every.alias("e").join(counts.alias("c"), radix.same([*keys, "bin"], "e", "c"), "left")
    return out.select(*[f"e.{k}" for k in keys], "e.bin", edge(F.col("e.bin")).alias("lower"), edge(F.col("e.bin") + 1).alias("upper"), F.coalesce("c.c", F.lit(0)).alias("count"))


def mode_ablation(rows: DataFrame, threshold: float, baseline: str = "off") -> DataFrame:
    """A-26, R-18: rows(binary_label, mode, score, own, passes, seconds, coverage, reused) per
    mode against ``baseline``; ``own`` is the item's score in that one."""
    changed = (F.col("score") >= threshold) != (F.col("own") >= threshold)
    totals = rows.groupBy("mode").agg(
        F.avg("passes").alias("mean_passes"), F.sum("passes").alias("total_passes"), F.avg("seconds").alias("mean_seconds"),
        F.avg("coverage").alias("mean_coverage"), F.count_if(changed).alias("decisions_changed"), F.count_if("reused").alias("reused"),
    )
    table = totals.join(metrics.binary_metrics(rows, ["mode"], threshold), "mode")
    base = lambda c: F.max(F.when(F.col("mode") == baseline, F.col(c))).over(W.partitionBy(F.lit(1)))
    return table.withColumns({f"delta_{c}": F.col(c) - base(c) for c in ("f1", "recall", "fpr")})


def compare_models(a: DataFrame, b: DataFrame, names: Sequence[str] = SUMMARY_METRICS) -> DataFrame:
    """J-13, A-38: two per-condition tables as (condition, metric, before, after, delta)."""
    side = lambda t, c: t.unpivot(["condition"], list(names), "metric", c)
    both = side(a, "before").join(side(b, "after"), ["condition", "metric"])
    return both.withColumn("delta", F.col("after") - F.col("before"))


def reencode_probe(pairs: DataFrame, threshold: float) -> DataFrame:
    """A-27: pairs(original, reencoded)."""
    moved = F.col("reencoded") - F.col("original")
    kept = (F.col("reencoded") >= threshold) == (F.col("original") >= threshold)
    return pairs.agg(
        F.count(F.lit(1)).alias("count"), F.avg(moved).alias("mean_delta"), F.avg(F.abs(moved)).alias("mean_abs_delta"),
        F.max(F.abs(moved)).alias("max_abs_delta"), F.avg(kept.cast("double")).alias("decisions_kept"),
    )
