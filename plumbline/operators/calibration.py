"""Reliability, calibration error and calibrators (A-18 to A-21, I-01, I-02)."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import rules
from . import lineage, radix

# Upper edges of ten equal bins as doubles
EDGES = (0.1, 0.2, 0.30000000000000004, 0.4, 0.5, 0.6000000000000001, 0.7000000000000001, 0.8, 0.9)
DEGRADATION_LIMIT = 0.05


def bin_of(p: Column) -> Column:
    """A-18: 0 to 9; each bin holds its lower edge, the last one both."""
    out = F.lit(0)
    for edge in EDGES:
        out = out + (p >= edge).cast("int")
    return out


def reliability(df: DataFrame, keys: Sequence[str], p: str = "score", label: str = "binary_label") -> DataFrame:
    """A-18: ten rows per group, empty bins included."""
    found = df.where(F.col(p).isNotNull()).groupBy(*keys, bin_of(F.col(p)).alias("bin")).agg(
        F.count(F.lit(1)).alias("count"), F.avg(F.col(label).cast("double")).alias("accuracy"), F.avg(p).alias("mean_confidence")
    )
    grid = found.select(*keys).distinct().withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(9))))
    out = grid.join(found, [*keys, "bin"], "left")
    return out.withColumns({"count": F.coalesce("count", F.lit(0)), "low": F.col("bin") / 10.0, "high": (F.col("bin") + 1) / 10.0})


def ece_brier(df: DataFrame, keys: Sequence[str], p: str = "score", label: str = "binary_label") -> DataFrame:
    """A-19: two levels of aggregation, one shuffle of ten rows per group and task."""
    square = (F.col(p) - F.col(label)) * (F.col(p) - F.col(label))
    bins = df.where(F.col(p).isNotNull()).groupBy(*keys, bin_of(F.col(p)).alias("bin")).agg(
        F.count(F.lit(1)).alias("m"), F.sum(F.col(label).cast("double")).alias("y"), F.sum(p).alias("s"), F.sum(square).alias("q")
    )
    n = F.sum("m")
    return bins.groupBy(*keys).agg(
        n.alias("count"), F.try_divide(F.sum(F.abs(F.col("y") - F.col("s"))), n).alias("ece"),
        F.try_divide(F.sum("q"), n).alias("brier"), F.try_divide(F.sum("s"), n).alias("mean_confidence"),
    )


@dataclass(frozen=True)
class Calibrator:
    """p -> sigmoid(scale * logit(p) + bias)."""

    method: str
    scale: float
    bias: float

    def __call__(self, p: Column) -> Column:
        return rules.calibrated(p, self.scale, self.bias)

    @property
    def temperature(self) -> float:
        return 1.0 / self.scale


def by_condition(versions: DataFrame, calibrator: Calibrator) -> DataFrame:
    """A-20: raw and calibrated ECE, Brier and the shift of the mean against clean."""
    rows = versions.withColumn("calibrated", calibrator(F.col("score")))
    raw = ece_brier(rows, ["condition", "ordinal"]).select("condition", F.col("ece").alias("ece_raw"))
    out = ece_brier(rows, ["condition", "ordinal"], "calibrated").join(raw, "condition")
    base = F.max(F.when(F.col("condition") == "clean", F.col("mean_confidence"))).over(W.partitionBy(F.lit(1)))
    return out.withColumn("mean_shift", F.col("mean_confidence") - base)


def rollup(table: DataFrame) -> DataFrame:
    """A-21: the worst condition (the first on ties), the mean, and whether it stays near clean."""
    other = F.col("condition") != "clean"
    clean = F.max(F.when(~other, F.col("ece")))
    worst = F.max(F.when(other, F.col("ece")))
    return table.agg(
        clean.alias("clean_ece"), F.avg(F.when(other, F.col("ece"))).alias("mean_ece"), worst.alias("worst_ece"),
        F.max_by("condition", F.when(other, F.struct("ece", -F.col("ordinal")))).alias("worst_condition"),
        (worst - clean <= DEGRADATION_LIMIT).alias("stable"),
    )


def _grouped(df: DataFrame, label: str, score: str) -> DataFrame:
    """(x, p, n): one row per distinct score, so each step reads at most a million rows."""
    return df.where(F.col(score).isNotNull()).groupBy(rules.logit(F.col(score)).alias("x")).agg(
        F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) != 1).alias("n")
    )


def _loss(z: Column, target: Column) -> Column:
    """Negative log likelihood of a logit, without overflow."""
    return F.greatest(z, F.lit(0.0)) - z * target + F.log1p(F.exp(-F.abs(z)))


def fit_platt(df: DataFrame, label: str = "binary_label", score: str = "score", ridge: float = 1e-6, steps: int = 100, tolerance: float = 1e-9) -> Calibrator:
    """I-01: damped Newton steps on smoothed targets.

    A step is one aggregate of five sums; another evaluates the whole step, and only if
    that is no gain, further ones evaluate the halvings. The driver sees sums only."""
    hist = _grouped(df, label, score).persist()
    try:
        size = hist.agg(F.sum("p"), F.sum("n")).first()
        pos, neg = int(size[0] or 0), int(size[1] or 0)
        if not pos or not neg:
            raise ValueError("both classes are needed")
        high, low = (pos + 1.0) / (pos + 2.0), 1.0 / (neg + 2.0)
        x, p, n = F.col("x"), F.col("p"), F.col("n")

        def losses(candidates):
            fits = [F.sum(p * _loss(a * x + b, F.lit(high)) + n * _loss(a * x + b, F.lit(low))) for a, b in candidates]
            row = hist.agg(*[f.alias(f"l{k}") for k, f in enumerate(fits)]).first()
            return [v + 0.5 * ridge * (a * a + b * b) for v, (a, b) in zip(row, candidates, strict=True)]

        scale, bias = 1.0, 0.0
        now = losses([(scale, bias)])[0]
        for _ in range(steps):
            q = rules.sigmoid(scale * x + bias)
            off = p * (q - high) + n * (q - low)
            w = (p + n) * q * (1.0 - q)
            ga, gb, haa, hab, hbb = hist.agg(F.sum(off * x), F.sum(off), F.sum(w * x * x), F.sum(w * x), F.sum(w)).first()
            ga, gb, haa, hbb = ga + ridge * scale, gb + ridge * bias, haa + ridge, hbb + ridge
            if max(abs(ga), abs(gb)) < tolerance:
                break
            det = haa * hbb - hab * hab
            da, db = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det
            if da * ga + db * gb <= 1e-13 * max(1.0, abs(now)):  # what a step could still gain
                break
            found = None
            for some in (range(1), range(1, 14), range(14, 27), range(27, 40)):  # mostly the whole step is taken
                tries = [(scale - da / 2.0**k, bias - db / 2.0**k) for k in some]
                found = next(((c, v) for c, v in zip(tries, losses(tries), strict=True) if v <= now), None)
                if found:
                    break
            if found is None:
                break
            moved = max(abs(found[0][0] - scale), abs(found[0][1] - bias))
            (scale, bias), now = found
            if moved < tolerance:
                break
        return Calibrator("platt", scale, bias)
    finally:
        hist.unpersist()


def fit_temperature(df: DataFrame, label: str = "binary_label", score: str = "score", steps: int = 100, tolerance: float = 1e-9) -> Calibrator:
    """I-02: the slope alone, by undamped Newton steps with a floor of 1e-6."""
    hist = _grouped(df, label, score).persist()
    try:
        x, p, n = F.col("x"), F.col("p"), F.col("n")
        scale = 1.0
        for _ in range(steps):
            q = rules.sigmoid(scale * x)
            g, h = hist.agg(F.sum((p * (q - 1.0) + n * q) * x), F.sum((p + n) * q * (1.0 - q) * x * x)).first()
            if g is None:
                raise ValueError("no scores")
            after = max(scale - g / max(h, 1e-12), 1e-6)
            moved, scale = abs(after - scale), after
            if moved < tolerance:
                break
        return Calibrator("temperature", scale, 0.0)
    finally:
        hist.unpersist()


#: groups up to which their parameters are broadcast, and parts of a group beyond that
GROUPS, PARTS = 1 << 16, 32


def _beside(hist: DataFrame, state: DataFrame, keys: Sequence[str], few: bool) -> DataFrame:
    """hist with the columns of its group's state. Rows of a group stay spread over tasks."""
    if few:
        return hist.alias("h").join(F.broadcast(state).alias("s"), radix.same(keys, "h", "s")).select("h.*", *[f"s.{c}" for c in state.columns if c not in keys])
    parts = state.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    rows = hist.withColumn("_part", F.pmod(F.xxhash64("x"), F.lit(PARTS)).cast("int"))
    both = rows.alias("h").join(parts.alias("s"), radix.same([*keys, "_part"], "h", "s"))
    return both.select(*[f"h.{c}" for c in hist.columns], *[f"s.{c}" for c in state.columns if c not in keys])


def fit_groups(
    df: DataFrame, keys: Sequence[str], label: str = "binary_label", score: str = "score", ridge: float = 1e-6, steps: int = 100, tolerance: float = 1e-9
) -> DataFrame:
    """X-05, I-01: a Platt fit for each group: keys, scale, bias; null where a group lacks a class.

    All groups take their damped Newton steps together. A step is two aggregates, the sums of
    the gradient and then the losses of the halved steps, partial in every task, so no task
    holds a group; groups that have converged are left out of the next one."""
    keys = [*keys]
    hist = df.where(F.col(score).isNotNull()).groupBy(*keys, rules.logit(F.col(score)).alias("x")).agg(
        F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) != 1).alias("n")
    ).persist()
    try:
        x, p, n, a, b = (F.col(c) for c in ("x", "p", "n", "scale", "bias"))
        loss = lambda a, b: F.sum(p * _loss(a * x + b, F.col("high")) + n * _loss(a * x + b, F.col("low"))) + F.first(0.5 * ridge * (a * a + b * b))
        size = hist.groupBy(*keys).agg(F.sum("p").alias("pos"), F.sum("n").alias("neg")).select(
            *keys, ((F.col("pos") + 1.0) / (F.col("pos") + 2.0)).alias("high"), (1.0 / (F.col("neg") + 2.0)).alias("low"),
            F.lit(1.0).alias("scale"), F.lit(0.0).alias("bias"), ((F.col("pos") == 0) | (F.col("neg") == 0)).alias("lacking"),
        )
        size = lineage.settled(size)
        few = size.count() <= GROUPS
        lacking = size.where("lacking").select(*keys, F.lit(None).cast("double").alias("scale"), F.lit(None).cast("double").alias("bias"))
        fixed = ["high", "low", "scale", "bias"]
        first = _beside(hist, size.where("not lacking").drop("lacking"), keys, few)
        state = lineage.settled(first.groupBy(*keys).agg(*[F.first(c).alias(c) for c in fixed], loss(a, b).alias("now")))
        done = []
        fixed.append("now")
        for _ in range(steps):
            if state.isEmpty():
                break
            q = rules.sigmoid(a * x + b)
            off, w = p * (q - F.col("high")) + n * (q - F.col("low")), (p + n) * q * (1.0 - q)
            sums = _beside(hist, state, keys, few).groupBy(*keys).agg(
                *[F.first(c).alias(c) for c in fixed], (F.sum(off * x) + F.first(ridge * a)).alias("ga"), (F.sum(off) + F.first(ridge * b)).alias("gb"),
                (F.sum(w * x * x) + ridge).alias("haa"), F.sum(w * x).alias("hab"), (F.sum(w) + ridge).alias("hbb"),
            )
            det = F.expr("haa * hbb - hab * hab")
            tried = sums.withColumns({"da": F.expr("hbb * ga - hab * gb") / det, "db": F.expr("haa * gb - hab * ga") / det})
            # what a step could still gain
            flat = (F.greatest(F.abs("ga"), F.abs("gb")) < tolerance) | (F.expr("da * ga + db * gb") <= 1e-13 * F.greatest(F.lit(1.0), F.abs("now")))
            tried = tried.select(*keys, *fixed, "da", "db", flat.alias("flat"))
            halved = [(a - F.col("da") / 2.0**k, b - F.col("db") / 2.0**k) for k in (*range(6), 8, 12, 20, 39)]
            fits = F.array(*[F.struct(loss(s, t).alias("now"), F.first(s).alias("scale"), F.first(t).alias("bias")) for s, t in halved])
            after = _beside(hist, tried, keys, few).groupBy(*keys).agg(*[F.first(c).alias(c) for c in (*fixed, "flat")], fits.alias("fits"))
            better = F.get(F.filter("fits", lambda f: f["now"] <= F.col("now")), 0)
            still = ~F.col("flat") & better.isNotNull()
            after = after.withColumn("_f", F.when(still, better))
            moved = F.greatest(F.abs(F.col("_f.scale") - a), F.abs(F.col("_f.bias") - b))
            after = after.select(
                *keys, "high", "low", *[F.coalesce(f"_f.{c}", c).alias(c) for c in ("scale", "bias", "now")], F.coalesce(moved < tolerance, F.lit(True)).alias("done")
            )
            after = lineage.settled(after)
            done.append(after.where("done").select(*keys, "scale", "bias"))
            state = after.where("not done").drop("done")
        out = lacking
        for part in [*done, state.select(*keys, "scale", "bias")]:
            out = out.unionByName(part)
        return out
    finally:
        hist.unpersist()
