"""Evaluating and selecting abstention rules (A-24, I-05, I-10), confidence (A-23, I-07) and verdicts (I-06, I-08, I-09)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import rules
from . import calibration, metrics

# Selection bars and grids
MIN_ENRICHMENT, MAX_RATE, RATE_PENALTY = 1.5, 0.35, 0.05
GRIDS = (
    ("borderline", (0.0, 0.02, 0.05, 0.08, 0.10, 0.15)),
    ("drift", (1.0, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1)),
    ("consistency", (0.0, 0.1, 0.2, 0.3, 0.4, 0.5)),
    ("agreement", (0.0, 0.4, 0.5, 0.6, 0.7, 0.8)),
    ("crossing", (2.0, 0.4, 0.3, 0.2, 0.1)),
)
GAIN, FPR_RISE = 0.01, 0.05


def features(items: DataFrame, threshold: float, fused: Column, clean: Column, versions: rules.Scores, label: str = "binary_label") -> DataFrame:
    """I-10: what every candidate limit is compared with, once per item."""
    every = rules.joined(clean, versions)
    above, n = rules.share_above(every, threshold)
    minority = F.least(above, n - above) / n.cast("double")
    return items.select(
        "*", fused.alias("fused"), F.abs(fused - threshold).alias("distance"),
        (clean - rules.array_mean(versions)).alias("drop"), (clean >= threshold).alias("looked_positive"),
        rules.consistency(every).alias("consistency"), rules.agreement(versions, fused, threshold).alias("agreement"),
        minority.alias("minority"), ((fused >= threshold) == (F.col(label) == 1)).alias("correct"),
    )


def fires(rule: str, limit: Column | float) -> Column:
    """Whether a rule with that limit abstains; null inputs never do."""
    limit = limit if isinstance(limit, Column) else F.lit(limit)
    out = {
        "borderline": F.col("distance") < limit,
        "drift": F.col("looked_positive") & (F.col("drop") > limit),
        "consistency": F.col("consistency") < limit,
        "agreement": F.col("agreement") < limit,
        "crossing": F.col("minority") >= limit,
    }[rule]
    return F.coalesce(out, F.lit(False))


def evaluate(rows: DataFrame, abstains: Column, keys: Sequence[str] = ()) -> DataFrame:
    """A-24: error rates of all, abstained and answered rows; enrichment is 0 without errors."""
    wrong = (~F.col("correct")).cast("long")
    out = rows.withColumn("_a", abstains).withColumn("_w", wrong).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("count"), F.count_if("_a").alias("abstained"), F.coalesce(F.sum("_w"), F.lit(0)).alias("errors"),
        F.coalesce(F.sum(F.when(F.col("_a"), F.col("_w"))), F.lit(0)).alias("errors_abstained"),
    )
    return with_rates(out)


def with_rates(counts: DataFrame) -> DataFrame:
    """counts(count, abstained, errors, errors_abstained) with the rates of A-24."""
    answered = F.col("count") - F.col("abstained")
    base, away = metrics.ratio(F.col("errors"), F.col("count")), metrics.ratio(F.col("errors_abstained"), F.col("abstained"))
    left = metrics.ratio(F.col("errors") - F.col("errors_abstained"), answered)
    return counts.withColumns({
        "rate": metrics.ratio(F.col("abstained"), F.col("count")), "error_rate": base, "error_abstained": away, "error_answered": left,
        "accuracy_answered": F.when(answered > 0, 1.0 - left).otherwise(0.0), "enrichment": metrics.ratio(away, base),
    })


#: rules that fire more often as their limit gets lower
FALLING = ("drift", "crossing")


def sweep(rows: DataFrame, grids: Sequence = GRIDS, accepted: Column | None = None) -> DataFrame:
    """Every limit of every rule in one scan: rule, step, limit, counts and rates.

    A rule that fires at a limit fires at all laxer ones. So each row finds the first
    limit that it reaches, rows are counted by those (one row per limit and task), and
    running sums over a rule's limits do the rest."""
    ordered = {rule: sorted(enumerate(grid), key=lambda kv: -kv[1] if rule in FALLING else kv[1]) for rule, grid in grids}
    before = F.lit(False) if accepted is None else accepted
    first = {}
    for rule, limits in ordered.items():
        reached = F.when(before, 0)
        for place, (_, limit) in enumerate(limits):
            reached = reached.when(fires(rule, float(limit)), place)
        first[rule] = reached.otherwise(len(limits))
    wide = rows.select("correct", *[x.alias(r) for r, x in first.items()])
    bins = wide.unpivot(["correct"], [*first], "rule", "place").groupBy("rule", "place").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(~F.col("correct")).alias("w")
    )
    steps = [(r, k, float(v), place) for r, limits in ordered.items() for place, (k, v) in enumerate(limits)]
    table = rows.sparkSession.createDataFrame(steps, "rule string, step int, limit double, upto int")
    both = bins.join(F.broadcast(table), "rule")
    within = F.col("place") <= F.col("upto")
    counts = both.groupBy("rule", "step", "limit").agg(
        F.sum("n").alias("count"), F.sum(F.when(within, F.col("n")).otherwise(0)).alias("abstained"),
        F.sum("w").alias("errors"), F.sum(F.when(within, F.col("w")).otherwise(0)).alias("errors_abstained"),
    )
    return with_rates(counts)


def select(rows: DataFrame, grids: Sequence = GRIDS) -> list[tuple[str, float]]:
    """I-05: rules in their order, each on top of those accepted; five aggregates over cached features."""
    chosen: list[tuple[str, float]] = []
    rows = rows.select("correct", "distance", "drop", "looked_positive", "consistency", "agreement", "minority").persist()
    try:
        for rule, grid in grids:
            accepted = F.lit(False)
            for name, limit in chosen:
                accepted = accepted | fires(name, limit)
            table = sweep(rows, [(rule, grid)], accepted)
            value = F.col("accuracy_answered") - RATE_PENALTY * F.col("rate")
            good = table.where((F.col("rate") <= MAX_RATE) & (F.col("enrichment") >= MIN_ENRICHMENT))
            best = good.agg(F.max_by("limit", F.struct(value.alias("v"), -F.col("step")))).first()[0]
            if best is not None:
                chosen.append((rule, best))
        return chosen
    finally:
        rows.unpersist()


def confidence_report(rows: DataFrame, keys: Sequence[str] = (), confidence: str = "confidence", label: str = "label") -> DataFrame:
    """A-23: does confidence tell right from wrong? rows(.., correct boolean)."""
    keys = [*keys]
    known = F.col(confidence).isNotNull()
    hist = rows.groupBy(*keys, F.col(confidence).alias("score")).agg(
        F.count_if(F.col("correct") & known).alias("p"), F.count_if(~F.col("correct") & known).alias("n"), F.count_if((F.col(label) == "Uncertain") & known).alias("u")
    )
    # one scan and one shuffle; bins and ranks need no more than the histogram
    c, p, n = F.col("score"), F.col("p"), F.col("n")
    below = W.partitionBy(*keys).orderBy("score").rowsBetween(W.unboundedPreceding, -1)
    bins = hist.withColumn("under", F.coalesce(F.sum("n").over(below), F.lit(0))).groupBy(*keys, calibration.bin_of(c).alias("bin")).agg(
        F.sum("p").alias("p"), F.sum("n").alias("n"), F.sum("u").alias("u"), F.sum(c * p).alias("cp"), F.sum(c * n).alias("cn"),
        F.sum(c * c * (p + n)).alias("cc"), F.sum(p.cast("double") * (F.col("under") + n / 2.0)).alias("won"),
    )
    total = lambda x: F.sum(x).cast("double")
    all_, sx, sy = total(p + n), F.sum(F.col("cp") + F.col("cn")), total("p")
    spread = F.sqrt(F.greatest((all_ * F.sum("cc") - sx * sx) * (all_ * sy - sy * sy), F.lit(0.0)))
    right, wrong = F.try_divide(F.sum("cp"), total("p")), F.try_divide(F.sum("cn"), total("n"))
    return bins.groupBy(*keys).agg(
        right.alias("mean_right"), wrong.alias("mean_wrong"), (right - wrong).alias("gap"), F.try_divide(total("u"), all_).alias("uncertain_rate"),
        F.try_divide(all_ * F.sum("cp") - sx * sy, spread).alias("pearson"), F.try_divide(F.sum("won"), total("p") * total("n")).alias("auroc"),
        F.try_divide(F.sum(F.abs(p - F.col("cp") - F.col("cn"))), all_).alias("ece"),
    )


def prefer_variant(auroc_before: float, gap_before: float, auroc_after: float, gap_after: float, gain: float = GAIN) -> bool:
    """I-07."""
    return auroc_after - auroc_before > gain and gap_after >= gap_before


def preferred(report: DataFrame, first: str, gain: float = GAIN) -> DataFrame:
    """I-07 for all variants of a confidence_report(variant, auroc, gap) against the first one."""
    base = report.where(F.col("variant") == first).select(F.col("auroc").alias("_a"), F.col("gap").alias("_g"))
    rows = report.where(F.col("variant") != first).join(F.broadcast(base))
    return rows.select("variant", ((F.col("auroc") - F.col("_a") > gain) & (F.col("gap") >= F.col("_g"))).alias("preferred"))


def patch_verdict(table: DataFrame, baseline: str = "off", gain: float = 0.005) -> DataFrame:
    """I-06: whether any mode helps without more false positives."""
    better = ((F.col("delta_f1") > gain) | (F.col("delta_recall") > gain)) & (F.col("delta_fpr") <= 0)
    return table.where(F.col("mode") != baseline).agg(F.coalesce(F.bool_or(better), F.lit(False)).alias("helps"))


def retain(table: DataFrame) -> DataFrame:
    """I-08: compare_models() rows of one condition → whether the second model stays."""
    d = lambda m: F.max(F.when(F.col("metric") == m, F.col("delta")))
    keep = (F.greatest(d("recall"), d("f1")) >= GAIN) & (d("fpr") <= FPR_RISE)
    return table.groupBy("condition").agg(d("recall").alias("recall_gain"), d("f1").alias("f1_gain"), d("fpr").alias("fpr_rise"), keep.alias("retained"))


def best_loss(table: DataFrame, fpr_rise: float = FPR_RISE) -> DataFrame:
    """I-09: rows(loss, ordinal, recall_gain, f1_gain, fpr_rise) → the loss with the best gain under the same bars."""
    gain = F.greatest("recall_gain", "f1_gain")
    good = (gain >= GAIN) & (F.col("fpr_rise") <= fpr_rise)
    return table.agg(F.max_by("loss", F.when(good, F.struct(gain.alias("g"), -F.col("ordinal")))).alias("loss"))
