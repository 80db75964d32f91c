"""Exact binary-classification metrics as aggregates (A-01 to A-06, A-35, I-03).

Everything starts from a histogram: positives and negatives per (keys, score). It is a
partial aggregate, so a hot score costs one row per task. Running sums over it go digit by
digit (``radix``), so scores need not be rounded and no task holds a whole key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import radix

COUNTS = ("tp", "fp", "tn", "fn")


def ratio(a: Column, b: Column, empty: float | None = 0.0) -> Column:
    """a / b; ``empty`` where b is 0."""
    out = F.try_divide(a.cast("double"), b.cast("double"))
    return out if empty is None else F.coalesce(out, F.lit(empty))


def rates() -> dict[str, Column]:
    """A-02 over columns tp, fp, tn, fn; every 0/0 is 0, so FPR without negatives is 1."""
    tp, fp, tn, fn = (F.col(c) for c in COUNTS)
    recall, specificity = ratio(tp, tp + fn), ratio(tn, tn + fp)
    precision = ratio(tp, tp + fp)
    return {
        "accuracy": ratio(tp + tn, tp + fp + tn + fn),
        "precision_": precision,
        "recall": recall,
        "f1": ratio(2.0 * precision * recall, precision + recall),
        "specificity": specificity,
        "fpr": 1.0 - specificity,
        "fnr": 1.0 - recall,
        "balanced_accuracy": (recall + specificity) / 2.0,
        "youden_j": recall + specificity - 1.0,
    }


def with_rates(counts: DataFrame, *names: str) -> DataFrame:
    every = rates()
    return counts.withColumns({n: every[n] for n in (names or every)})


def confusion(label: Column, decision: Column) -> list[Column]:
    """A-01: aggregates tp, fp, tn, fn."""
    yes = label == 1
    return [
        F.count_if(yes & decision).alias("tp"),
        F.count_if(~yes & decision).alias("fp"),
        F.count_if(~yes & ~decision).alias("tn"),
        F.count_if(yes & ~decision).alias("fn"),
    ]


def histogram(df: DataFrame, keys: Sequence[str], label: str = "binary_label", score: str = "score") -> DataFrame:
    """keys, score, p, n."""
    return df.where(F.col(score).isNotNull()).groupBy(*keys, F.col(score).alias("score")).agg(
        F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) != 1).alias("n")
    )


def _auc() -> Column:
    """Null with a single class."""
    return F.try_divide(F.col("won"), F.col("p").cast("double") * F.col("n").cast("double"))


def roc_auc(hist: DataFrame, keys: Sequence[str]) -> DataFrame:
    """A-03: keys, auc; tied ranks averaged, null with a single class. W-01 by running sums."""
    return radix.auc_fold(hist, keys).select(*keys, _auc().alias("auc"))


def binary_metrics(
    df: DataFrame, keys: Sequence[str], threshold: float, label: str = "binary_label", score: str = "score", parts: int | None = None
) -> DataFrame:
    """A-07: counts, rates and AUC per group on one frozen threshold (inclusive, P-03). ``parts``: see ``radix.auc_fold``."""
    return from_histogram(histogram(df, keys, label, score), keys, threshold, parts=parts)


def from_histogram(
    hist: DataFrame, keys: Sequence[str], threshold: float, moments: bool = False, more: dict[str, Column] | None = None, parts: int | None = None
) -> DataFrame:
    """The same from (keys, score, p, n); with ``moments`` also count, mean_score and std_score (A-08),
    and with ``more`` further sums over the rows of a key."""
    yes = F.col("score") >= threshold
    count = lambda c, when: F.coalesce(F.sum(F.when(when, F.col(c))), F.lit(0))
    sums = {"tp": count("p", yes), "fp": count("n", yes), "tn": count("n", ~yes), "fn": count("p", ~yes)}
    if moments:
        m, x = F.col("p") + F.col("n"), F.col("score")
        sums |= {"_m": F.sum(m), "_x": F.sum(x * m), "_xx": F.sum(x * x * m)}
    out = radix.auc_fold(hist, keys, sums | (more or {}), parts)
    more = [*(more or {})]
    if moments:
        mean = F.col("_x") / F.col("_m")
        more += [F.col("_m").alias("count"), mean.alias("mean_score"), F.sqrt(F.greatest(F.col("_xx") / F.col("_m") - mean * mean, F.lit(0.0))).alias("std_score")]
    return with_rates(out.select(*keys, *COUNTS, _auc().alias("auc"), *more))


#: rows of a tie of positives whose precisions are summed from the histogram
FEW = 32


def tie_order(ident: Column) -> Column:
    """The first 60 bits of md5, as a number that sorts fast."""
    return F.conv(F.substring(F.md5(ident.cast("string")), 1, 15), 16, 10).cast("long")


def average_precision(df: DataFrame, keys: Sequence[str], ident: str, label: str = "binary_label", score: str = "score", order: str | None = None) -> DataFrame:
    """A-04: mean precision at the positives in descending score order, ties by md5(ident).

    Ties of one class, and single rows, follow from the histogram. Rows of other ties have
    rank and positives so far in three parts, so that no task holds a whole key or a whole
    tie: above the score (from the histogram), before the row's bucket among its tie (256
    buckets), and inside the bucket. A key without rows of a known score has no row, one
    without positives has null. ``order`` names a column with tie_order(ident), for callers
    that have several rows of an item.
    """
    keys = list(keys)
    hist = histogram(df, keys, label, score).withColumn("m", F.col("p") + F.col("n"))
    hist = radix.running(hist, keys, "score", ["m", "p"], descending=True)
    plain = (F.col("p") == 0) | ((F.col("n") == 0) & (F.col("m") <= FEW))
    steps = F.when(plain & (F.col("p") > 0), F.sequence(F.lit(1), F.col("p").cast("int")))
    each = F.aggregate(steps, F.lit(0.0), lambda s, j: s + (F.col("before_p") + j) / (F.col("before_m") + j))
    known = hist.groupBy(*keys).agg(F.sum(each).alias("_a"), F.sum("p").alias("_p"))

    mixed = hist.where(~plain).select(*keys, "score", F.col("before_m").alias("m0"), F.col("before_p").alias("p0"))
    rows = df.where(F.col(score).isNotNull()).select(*keys, F.col(score).alias("score"), (F.col(order) if order else tie_order(F.col(ident))).alias("h"), F.col(label).cast("int").alias("y"))
    at = [*keys, "score"]
    rows = rows.alias("r").join(mixed.alias("t"), radix.same(at, "r", "t")).select("r.*", "t.m0", "t.p0")
    rows = rows.withColumn("b", F.shiftright("h", 52))
    tied = rows.groupBy(*at, "b").agg(F.count(F.lit(1)).alias("m"), F.count_if(F.col("y") == 1).alias("p"))
    before = W.partitionBy(*at).orderBy("b").rowsBetween(W.unboundedPreceding, -1)
    tied = tied.select(*at, "b", F.coalesce(F.sum("m").over(before), F.lit(0)).alias("m1"), F.coalesce(F.sum("p").over(before), F.lit(0)).alias("p1"))
    inside = W.partitionBy(*at, "b").orderBy("h").rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("m2", F.row_number().over(inside)).withColumn("p2", F.count_if(F.col("y") == 1).over(inside))
    both = rows.alias("r").join(tied.alias("t"), radix.same([*at, "b"], "r", "t")).select("r.*", "t.m1", "t.p1")
    precision = (F.col("p0") + F.col("p1") + F.col("p2")) / (F.col("m0") + F.col("m1") + F.col("m2"))
    more = both.groupBy(*keys).agg(F.sum(F.when(F.col("y") == 1, precision)).alias("_b"))
    out = known.alias("k").join(more.alias("m"), radix.same(keys, "k", "m"), "left")
    total = F.coalesce("_a", F.lit(0.0)) + F.coalesce("_b", F.lit(0.0))
    return out.select(*[F.col(f"k.{k}") for k in keys], F.try_divide(total, F.col("_p").cast("double")).alias("average_precision"))


def sweep(df: DataFrame, keys: Sequence[str], first: int, last: int, label: str = "binary_label", score: str = "score") -> DataFrame:
    """J-07: tp, fp, tn, fn at thresholds first/100 .. last/100.

    Each row finds the highest threshold it reaches, so the corpus is aggregated once
    into at most last - first + 2 rows per key; suffix sums over these do the rest.
    """
    near = F.floor(F.col(score) * 100 + 0.5)
    reached = F.when(near / 100.0 <= F.col(score), near).otherwise(near - 1)
    step = F.greatest(F.least(reached, F.lit(last)), F.lit(first - 1)).cast("int")
    bins = df.where(F.col(score).isNotNull()).groupBy(*keys, step.alias("_k")).agg(
        F.count_if(F.col(label) == 1).alias("_p"), F.count_if(F.col(label) != 1).alias("_n")
    )
    total = bins.groupBy(*keys).agg(F.sum("_p").alias("all_p"), F.sum("_n").alias("all_n"))
    grid = total.withColumn("_k", F.explode(F.sequence(F.lit(first), F.lit(last))))
    grid = grid.join(bins, [*keys, "_k"], "left")
    upper = W.partitionBy(*keys).orderBy(F.desc("_k")).rowsBetween(W.unboundedPreceding, 0)
    reach = lambda c: F.sum(F.coalesce(c, F.lit(0))).over(upper)
    out = grid.withColumn("tp", reach("_p")).withColumn("fp", reach("_n"))
    return out.select(
        *keys, (F.col("_k") / 100.0).alias("threshold"), "tp", "fp",
        (F.col("all_n") - F.col("fp")).alias("tn"), (F.col("all_p") - F.col("tp")).alias("fn"),
    )


def threshold_curve(df: DataFrame, keys: Sequence[str] = (), **names: str) -> DataFrame:
    """T-10: rates at .01 to .99."""
    return with_rates(sweep(df, keys, 1, 99, **names))


def roc_pr_points(df: DataFrame, keys: Sequence[str] = (), **names: str) -> DataFrame:
    """A-35: 101 thresholds; precision is 1 where nothing is predicted positive."""
    points = with_rates(sweep(df, keys, 0, 100, **names), "recall", "fpr")
    none = (F.col("tp") + F.col("fp")) == 0
    precision = F.when(none, F.lit(1.0)).otherwise(ratio(F.col("tp"), F.col("tp") + F.col("fp")))
    return points.select(*keys, "threshold", "fpr", F.col("recall").alias("tpr"), precision.alias("precision_"), "recall")


def operating_points(curve: DataFrame, keys: Sequence[str] = (), target_fpr: float = 0.05) -> DataFrame:
    """T-06, T-07: balanced, F1, low-FPR and high-recall thresholds; the lowest one on full ties."""
    t = F.col("threshold")
    best = lambda *by: F.max_by("threshold", F.struct(*[b.alias(f"k{i}") for i, b in enumerate(by)]))
    met = F.min(F.when(F.col("fpr") <= target_fpr, t))
    return curve.groupBy(*keys).agg(
        best(F.col("youden_j"), -F.abs(t - 0.5), -t).alias("balanced"),
        best(F.col("f1"), -t).alias("f1_optimal"),
        F.coalesce(met, F.min_by("threshold", F.struct(F.col("fpr").alias("k0"), t.alias("k1")))).alias("low_fpr"),
        met.isNotNull().alias("target_met"),
        best(F.col("recall"), -F.col("fpr"), -t).alias("high_recall"),
    )


def frozen_threshold(validation: DataFrame, label: str = "binary_label", score: str = "score", ident: str = "doc_id", target_fpr: float = 0.05) -> DataFrame:
    """I-04: operating points of the validation rows' clean scores, to be used unchanged elsewhere.

    An error if one class is missing, or, with its id, if a row has no such score (P-11)."""
    found = validation.agg(
        F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) != 1).alias("n"), F.min(F.when(F.col(score).isNull(), F.col(ident))).alias("lacking"),
    ).first()
    if found["lacking"] is not None:
        raise ValueError(f"{found['lacking']} has no score {score!r}")
    if not found["p"] or not found["n"]:
        raise ValueError("a threshold needs validation rows of both classes")
    return operating_points(threshold_curve(validation, label=label, score=score), target_fpr=target_fpr)


def metrics_or_null(df: DataFrame, keys: Sequence[str], threshold: float, **names: str) -> DataFrame:
    """P-13: binary_metrics, with every rate null where a group lacks a class."""
    out = binary_metrics(df, keys, threshold, **names)
    both = (F.col("tp") + F.col("fn") > 0) & (F.col("fp") + F.col("tn") > 0)
    return out.withColumns({c: F.when(both, F.col(c)) for c in ("auc", *rates())})


def training_metrics(df: DataFrame, keys: Sequence[str], threshold: float, label: str = "binary_label", score: str = "score") -> DataFrame:
    """A-05: the training-side set, where FPR without negatives is 0."""
    out = binary_metrics(df, keys, threshold, label, score)
    return out.withColumn("fpr", ratio(F.col("fp"), F.col("fp") + F.col("tn")))


def by_subgroup(df: DataFrame, group: str, expected: DataFrame, threshold: float, **names: str) -> DataFrame:
    """A-06, J-11, U-05: expected(group) appears with count 0 where no row has it."""
    found = training_metrics(df.withColumn("_g", F.col(group)), ["_g"], threshold, **names)
    both = expected.select(group).union(found.select("_g")).distinct()
    out = both.join(found, both[group].eqNullSafe(found["_g"]), "left").drop("_g")
    zero = {c: F.coalesce(c, F.lit(0)) for c in COUNTS}
    return out.withColumns(zero)
