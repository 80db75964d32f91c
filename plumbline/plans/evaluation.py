"""Queries over scored items: metrics, robustness and calibration."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rules
from ..operators import calibration, metrics, robustness
from ..sources import adapters
from . import sql as S

T = 0.5
DIGITS = 8
PLATT = calibration.Calibrator("platt", 0.8, -0.3)
QUERIES: dict = {}
SQL: dict[str, str] = {}
V, I, D = adapters.VERSIONS_SQL, adapters.ITEMS_SQL, adapters.DOCS_SQL


def _add(query, sql: str | None = None):
    QUERIES[query.__name__] = query
    if sql:
        SQL[query.__name__] = sql


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, DIGITS) for n in names})


def rnd(*names: str, source: str = "") -> str:
    return ", ".join(f"round({source}{n}, {DIGITS}) AS {n}" for n in names)


def _table(spark, sf_dir) -> DataFrame:
    return robustness.per_condition(adapters.version_scores(spark, sf_dir), T)


TABLE_SQL = f"""{V}, {S.metrics('vs', 'condition', T)},
  st AS (SELECT condition, ordinal, count(score) AS count, avg(score) AS mean_score, stddev_pop(score) AS std_score FROM vs GROUP BY 1, 2),
  tab AS (SELECT * FROM st JOIN m USING (condition))"""
DROPS_SQL = TABLE_SQL + ", long AS (" + " UNION ALL ".join(
    f"SELECT '{n}' AS metric, condition, ordinal, {n} AS value FROM tab" for n in robustness.SUMMARY_METRICS
) + """), dr AS (SELECT l.*, c.value AS clean, c.value - l.value AS "drop", l.value / nullif(c.value, 0) AS ratio
  FROM long l JOIN long c ON l.metric = c.metric AND c.condition = 'clean' WHERE l.condition <> 'clean')"""


def per_condition_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P-01 to P-03, A-01 to A-03, A-07, A-08."""
    return rounded(_table(spark, sf_dir), "mean_score", "std_score", "auc")


_add(per_condition_metrics, f"WITH {TABLE_SQL} SELECT * REPLACE ({rnd('mean_score', 'std_score', 'auc')}) FROM tab")


def robustness_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A-09, J-08."""
    return rounded(robustness.summary(_table(spark, sf_dir)), "clean", "mean_value", "worst_value", "largest_drop", "mean_ratio")


_add(robustness_summary, f"""WITH {DROPS_SQL} SELECT metric, round(max(clean), {DIGITS}) AS clean, round(avg(value), {DIGITS}) AS mean_value,
  round(min(value), {DIGITS}) AS worst_value, first(condition ORDER BY "drop" DESC, ordinal) AS worst_condition,
  round(max("drop"), {DIGITS}) AS largest_drop, round(avg(ratio) FILTER (ratio <> 0), {DIGITS}) AS mean_ratio FROM dr GROUP BY metric""")


def robustness_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A-10, T-02."""
    return rounded(robustness.ranking(_table(spark, sf_dir)), "value", "drop", "ratio")


_add(robustness_ranking, f"""WITH {DROPS_SQL} SELECT condition, {rnd('value', '"drop"', 'ratio')},
  (row_number() OVER (ORDER BY "drop" DESC NULLS LAST, ordinal))::INT AS place FROM dr WHERE metric = 'accuracy'""")


def average_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A-04, W-02."""
    items = adapters.scored_items(spark, sf_dir).withColumn("order", metrics.tie_order(F.col("item_id")))  # once for the versions of an item
    versions = adapters.to_long(items, keep=("item_id", "binary_label", "order"))
    out = metrics.average_precision(versions, ["condition"], "item_id", order="order")
    return rounded(out, "average_precision")


_add(average_precision, f"""WITH {V} SELECT condition, round(avg(tp / r), {DIGITS}) AS average_precision FROM (
  SELECT condition, binary_label, sum(binary_label) OVER w AS tp, row_number() OVER w AS r FROM (SELECT *, md5(item_id) AS h FROM vs)
  WINDOW w AS (PARTITION BY condition ORDER BY score DESC, h ROWS UNBOUNDED PRECEDING)) WHERE binary_label = 1 GROUP BY condition""")

CURVE = lambda rel, score, keys, grid: f"""g AS (SELECT k, k / 100.0::DOUBLE AS threshold FROM range({grid}) t(k)),
  c AS (SELECT {keys}threshold, {S.counts(score + ' >= threshold')} FROM {rel} CROSS JOIN g GROUP BY ALL)"""  # noqa: E731


def threshold_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I-03, J-07, T-10 on labelled documents."""
    return metrics.threshold_curve(adapters.scored_documents(spark, sf_dir), score="clean")


_add(threshold_curve, f"WITH {D}, {CURVE('sd', 'clean', '', '1, 100')} SELECT *, {S.rates()} FROM c")


def operating_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T-06, T-07 per condition."""
    curve = metrics.threshold_curve(adapters.version_scores(spark, sf_dir), ["condition"])
    return metrics.operating_points(curve, ["condition"])


_add(operating_points, f"""WITH {V}, {CURVE('vs', 'score', 'condition, ', '1, 100')}, r AS (SELECT *, {S.rates()} FROM c)
  SELECT condition, first(threshold ORDER BY youden_j DESC, abs(threshold - 0.5::DOUBLE), threshold) AS balanced,
    first(threshold ORDER BY f1 DESC, threshold) AS f1_optimal,
    coalesce(min(threshold) FILTER (fpr <= 0.05::DOUBLE), first(threshold ORDER BY fpr, threshold)) AS low_fpr,
    count(*) FILTER (fpr <= 0.05::DOUBLE) > 0 AS target_met,
    first(threshold ORDER BY recall DESC, fpr, threshold) AS high_recall FROM r GROUP BY condition""")


def roc_pr_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A-35 per condition."""
    return metrics.roc_pr_points(adapters.version_scores(spark, sf_dir), ["condition"])


_add(roc_pr_points, f"""WITH {V}, {CURVE('vs', 'score', 'condition, ', '0, 101')} SELECT condition, threshold, {S.RATES['fpr']} AS fpr, {S.RECALL} AS tpr,
  CASE WHEN tp + fp = 0 THEN 1.0::DOUBLE ELSE {S.PRECISION} END AS precision_, {S.RECALL} AS recall FROM c""")


def _fused(spark, sf_dir) -> DataFrame:
    items = adapters.scored_items(spark, sf_dir)
    return items.withColumn("fused", F.round(rules.rgb_transform(F.col("clean"), adapters.transformed()), 6))


MEAN_T = "((0.0::DOUBLE + blur + noise + jpeg + crop) / 4)"
RGB_SQL = f"(clean * 0.7::DOUBLE + {MEAN_T} * 0.3::DOUBLE) / (0.7::DOUBLE + 0.3::DOUBLE)"
FUSED_SQL = f"{I}, fu AS (SELECT *, round({RGB_SQL}, 6) AS fused FROM items)"


def family_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A-12, J-10."""
    return rounded(robustness.families(_fused(spark, sf_dir), {1: "synthetic", 2: "tampered"}, T), "auc", "mean_score")


_add(family_metrics, f"""WITH {FUSED_SQL}, fam AS (
    SELECT 'synthetic' AS family, * FROM fu WHERE source_label IN (0, 1) UNION ALL SELECT 'tampered' AS family, * FROM fu WHERE source_label IN (0, 2)),
  {S.metrics('fam', 'family', T, score='fused')}, me AS (SELECT family, avg(coalesce(fused, 0)) AS mean_score FROM fam WHERE source_label <> 0 GROUP BY 1)
  SELECT m.* REPLACE (round(auc, {DIGITS}) AS auc), round(mean_score, {DIGITS}) AS mean_score FROM m JOIN me USING (family)""")


def class_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A-13."""
    return rounded(robustness.class_breakdown(adapters.version_scores(spark, sf_dir), T), "accuracy", "mean_score")


_add(class_breakdown, f"""WITH {V} SELECT condition, source_label, count(*) AS count, round(avg(((score >= {T}) = (binary_label = 1))::INT), {DIGITS}) AS accuracy,
  round(avg(score), {DIGITS}) AS mean_score FROM vs GROUP BY 1, 2""")


def subgroup_metrics_with_absent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A-05, A-06, J-11, U-05: two expected languages never occur."""
    docs = adapters.scored_documents(spark, sf_dir)
    expected = spark.createDataFrame([("en",), ("xx",), ("yy",)], "lang string")
    return rounded(metrics.by_subgroup(docs, "lang", expected, 0.3, score="clean"), "auc")


_add(subgroup_metrics_with_absent, f"""WITH {D}, {S.metrics('sd', 'lang', 0.3, score='clean')},
  e AS (SELECT unnest(['en', 'xx', 'yy']) AS lang UNION SELECT lang FROM sd)
  SELECT e.lang, coalesce(tp, 0) AS tp, coalesce(fp, 0) AS fp, coalesce(tn, 0) AS tn, coalesce(fn, 0) AS fn, round(auc, {DIGITS}) AS auc, accuracy, precision_,
    recall, f1, specificity, CASE WHEN m.tp IS NULL THEN NULL WHEN fp + tn = 0 THEN 0.0::DOUBLE ELSE fp::DOUBLE / (fp + tn) END AS fpr, fnr, balanced_accuracy, youden_j
  FROM e LEFT JOIN m ON e.lang IS NOT DISTINCT FROM m.lang""")


def variant_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R-03, R-04, R-06, A-11, P-07."""
    items = adapters.scored_items(spark, sf_dir)
    every = rules.variants(F.col("clean"), adapters.transformed(), F.col("patch"))
    wide = items.select("binary_label", *[F.round(c, 6).alias(n) for n, c in every.items()])
    return rounded(robustness.variant_metrics(wide, list(every), T), "auc")


WHOLE_SQL = f"((clean * 0.6::DOUBLE + patch * 0.2::DOUBLE) + {MEAN_T} * 0.2::DOUBLE) / (0.6::DOUBLE + 0.2::DOUBLE + 0.2::DOUBLE)"
_add(variant_metrics, f"""WITH {I}, va AS (
    SELECT binary_label, 'clean_only' AS variant, round(clean, 6) AS score FROM items UNION ALL SELECT binary_label, 'transform_mean', round({MEAN_T}, 6) FROM items
    UNION ALL SELECT binary_label, 'rgb_transform', round({RGB_SQL}, 6) FROM items UNION ALL SELECT binary_label, 'whole_patch_transform', round({WHOLE_SQL}, 6) FROM items),
  {S.metrics('va', 'variant', T)}, k AS (SELECT variant, count(score) AS count, count(*) FILTER (score IS NULL) AS skipped FROM va GROUP BY 1)
  SELECT k.*, m.* EXCLUDE (variant) REPLACE (round(auc, {DIGITS}) AS auc) FROM k JOIN m USING (variant)""")


def score_distributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A-14."""
    return rounded(robustness.distributions(adapters.version_scores(spark, sf_dir)), "mean", "std", "median", "p05", "p95")


_add(score_distributions, f"""WITH {V} SELECT condition, source_label, count(score) AS count, round(avg(score), {DIGITS}) AS mean, round(stddev_pop(score), {DIGITS}) AS std,
  round(quantile_cont(score, 0.5), {DIGITS}) AS median, round(quantile_cont(score, 0.05), {DIGITS}) AS p05, round(quantile_cont(score, 0.95), {DIGITS}) AS p95 FROM vs GROUP BY 1, 2""")


def runtime_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A-16 over events: value as seconds, user_id % 13 as the number of patches."""
    rows = adapters.table(spark, sf_dir, "events").select("value", (F.col("user_id") % 13).alias("patches"))
    return rounded(robustness.runtime(rows, "value", "patches"), "mean", "median", "min", "max", "total")


_add(runtime_summary, f"""SELECT round(avg(value), {DIGITS}) AS mean, round(quantile_cont(value, 0.5), {DIGITS}) AS median, round(min(value), {DIGITS}) AS min,
  round(max(value), {DIGITS}) AS max, round(sum(value), {DIGITS}) AS total, trunc(avg(user_id % 13))::INT AS mean_patches FROM events""")


def chain_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A-25, J-09."""
    return rounded(robustness.score_drift(adapters.version_scores(spark, sf_dir)), "drift", "drift_positive", "drift_negative", "confidence_drift")


DRIFT_SQL = f"""{V}, mv AS (SELECT *, own AS base FROM vs WHERE condition <> 'clean'),
  drf AS (SELECT condition, ordinal, avg(score - base) AS drift, avg(score - base) FILTER (binary_label = 1) AS drift_positive,
    avg(score - base) FILTER (binary_label = 0) AS drift_negative, avg(abs(score - 0.5::DOUBLE) - abs(base - 0.5::DOUBLE)) AS confidence_drift FROM mv GROUP BY 1, 2)"""
_add(chain_drift, f"WITH {DRIFT_SQL} SELECT condition, ordinal, {rnd('drift', 'drift_positive', 'drift_negative', 'confidence_drift')} FROM drf")


def chain_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A-25: the worst chains."""
    out = robustness.chain_report(adapters.version_scores(spark, sf_dir), T)
    return rounded(out.select("condition", "accuracy", "f1", "recall", "auc", "drift", "worst_by_f1", "worst_by_drift"), "auc", "drift")


_add(chain_metrics, f"""WITH {DRIFT_SQL}, {S.metrics('vs', 'condition', T)} SELECT condition, accuracy, f1, recall, round(auc, {DIGITS}) AS auc, round(drift, {DIGITS}) AS drift,
  condition = first(condition) OVER (ORDER BY f1, ordinal) AS worst_by_f1, condition = first(condition) OVER (ORDER BY drift, ordinal) AS worst_by_drift FROM drf JOIN m USING (condition)""")


def severity_curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A-36."""
    levels = spark.createDataFrame([("blur", "optical", 1.0), ("noise", "optical", 2.0), ("jpeg", "codec", 1.0)], "condition string, family string, level double")
    return rounded(robustness.severity_curve(_table(spark, sf_dir), levels), "auc")


_add(severity_curves, f"""WITH {TABLE_SQL} SELECT family, level, condition, accuracy, round(auc, {DIGITS}) AS auc
  FROM tab JOIN (VALUES ('blur', 'optical', 1.0::DOUBLE), ('noise', 'optical', 2.0::DOUBLE)) l(condition, family, level) USING (condition)""")


def score_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A-37."""
    return robustness.score_histogram(adapters.version_scores(spark, sf_dir))


_add(score_histogram, f"""WITH {V}, e AS (SELECT k, k / 25.0::DOUBLE AS low, CASE WHEN k = 24 THEN 2.0::DOUBLE ELSE (k + 1) / 25.0::DOUBLE END AS high FROM range(25) t(k))
  SELECT condition, k::INT AS bin, count(*) AS count FROM vs JOIN e ON score >= low AND score < high GROUP BY 1, 2""")


def reencode_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A-27 on two scores of labelled documents."""
    rows = adapters.scored_documents(spark, sf_dir).select(F.col("clean").alias("original"), F.col("length").alias("reencoded"))
    return rounded(robustness.reencode_probe(rows, 0.3), "mean_delta", "mean_abs_delta", "max_abs_delta", "decisions_kept")


_add(reencode_probe, f"""WITH {D} SELECT count(*) AS count, round(avg(length - clean), {DIGITS}) AS mean_delta, round(avg(abs(length - clean)), {DIGITS}) AS mean_abs_delta,
  round(max(abs(length - clean)), {DIGITS}) AS max_abs_delta, round(avg(((length >= 0.3::DOUBLE) = (clean >= 0.3::DOUBLE))::INT), {DIGITS}) AS decisions_kept FROM sd""")

BINS_SQL = lambda p: "(" + " + ".join(f"({p} >= {e!r}::DOUBLE)::INT" for e in calibration.EDGES) + ")"


def reliability_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A-18."""
    return rounded(calibration.reliability(adapters.version_scores(spark, sf_dir), ["condition"]), "accuracy", "mean_confidence")


_add(reliability_bins, f"""WITH {V}, b AS (SELECT condition, {BINS_SQL('score')} AS bin, count(*) AS n, avg(binary_label) AS a, avg(score) AS s FROM vs GROUP BY 1, 2)
  SELECT k.condition, k.bin::INT AS bin, coalesce(n, 0) AS count, round(a, {DIGITS}) AS accuracy, round(s, {DIGITS}) AS mean_confidence,
    k.bin / 10.0::DOUBLE AS low, (k.bin + 1) / 10.0::DOUBLE AS high
  FROM (SELECT DISTINCT condition, t.bin FROM vs, range(10) t(bin)) k LEFT JOIN b ON k.condition = b.condition AND k.bin = b.bin""")


def ece_brier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A-19."""
    return rounded(calibration.ece_brier(adapters.version_scores(spark, sf_dir), ["condition"]), "ece", "brier", "mean_confidence")


ECE = lambda rel, p, key, y="binary_label": f"""SELECT {key}, sum(m)::BIGINT AS count, sum(abs(y - s)) / sum(m) AS ece, sum(q) / sum(m) AS brier, sum(s) / sum(m) AS mean_confidence
  FROM (SELECT {key}, {BINS_SQL(p)} AS bin, count(*) AS m, sum({y})::DOUBLE AS y, sum({p}) AS s, sum(({p} - {y}) * ({p} - {y})) AS q FROM {rel} GROUP BY ALL) GROUP BY ALL"""  # noqa: E731
_add(ece_brier, f"WITH {V}, x AS ({ECE('vs', 'score', 'condition')}) SELECT condition, count, {rnd('ece', 'brier', 'mean_confidence')} FROM x")


def _calibration_table(spark, sf_dir):
    return calibration.by_condition(adapters.version_scores(spark, sf_dir), PLATT)


LOGIT = "ln(least(greatest(score, 1e-6::DOUBLE), 1 - 1e-6::DOUBLE) / least(greatest(1.0::DOUBLE - score, 1e-6::DOUBLE), 1.0::DOUBLE))"
CAL_SQL = f"""{V}, cs AS (SELECT *, 1.0::DOUBLE / (1.0::DOUBLE + exp(-(0.8::DOUBLE * {LOGIT} - 0.3::DOUBLE))) AS p FROM vs), raw AS ({ECE('vs', 'score', 'condition')}),
  cal AS ({ECE('cs', 'p', 'condition, ordinal')}),
  ct AS (SELECT cal.*, raw.ece AS ece_raw, cal.mean_confidence - (SELECT mean_confidence FROM cal WHERE condition = 'clean') AS mean_shift FROM cal JOIN raw USING (condition))"""


def condition_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A-20, R-01, R-02."""
    return rounded(_calibration_table(spark, sf_dir), "ece", "brier", "mean_confidence", "ece_raw", "mean_shift")


_add(condition_calibration, f"WITH {CAL_SQL} SELECT condition, ordinal, count, {rnd('ece', 'brier', 'mean_confidence', 'ece_raw', 'mean_shift')} FROM ct")


def calibration_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A-21."""
    return rounded(calibration.rollup(_calibration_table(spark, sf_dir)), "clean_ece", "mean_ece", "worst_ece")


_add(calibration_rollup, f"""WITH {CAL_SQL}, o AS (SELECT round(max(ece) FILTER (condition = 'clean'), {DIGITS}) AS clean_ece, round(avg(ece) FILTER (condition <> 'clean'), {DIGITS}) AS mean_ece,
  round(max(ece) FILTER (condition <> 'clean'), {DIGITS}) AS worst_ece, first(condition ORDER BY ece DESC, ordinal) FILTER (condition <> 'clean') AS worst_condition FROM ct)
  SELECT *, worst_ece - clean_ece <= 0.05::DOUBLE AS stable FROM o""")


def _hist_sql(rel: str, key: str, score: str) -> str:
    """CTE h: positives and negatives per logit of a score."""
    return f"""h AS (SELECT {key} AS g, ln(least(greatest({score}, 1e-6::DOUBLE), 1 - 1e-6::DOUBLE) / least(greatest(1.0::DOUBLE - {score}, 1e-6::DOUBLE), 1.0::DOUBLE)) AS x,
    count(*) FILTER (binary_label = 1) AS p, count(*) FILTER (binary_label <> 1) AS n FROM {rel} WHERE {score} IS NOT NULL GROUP BY 1, 2)"""


def _newton_sql(steps: int, slope_only: bool = False) -> str:
    """CTEs s0 to s<steps>: whole Newton steps written out one after another, from 0 (a slope alone: from 1)."""
    out = f"""tg AS (SELECT g, (sum(p) + 1.0::DOUBLE) / (sum(p) + 2.0::DOUBLE) AS high, 1.0::DOUBLE / (sum(n) + 2.0::DOUBLE) AS low FROM h GROUP BY 1), s0 AS (SELECT g, {int(slope_only)}::DOUBLE AS a, 0.0::DOUBLE AS b FROM tg)"""
    for k in range(steps):
        rows = f"(SELECT h.*, a, b, high, low, 1.0::DOUBLE / (1.0::DOUBLE + exp(-least(greatest(a * x + b, -60), 60))) AS q FROM h JOIN s{k} USING (g) JOIN tg USING (g))"
        if slope_only:
            out += f""", s{k + 1} AS (SELECT g, greatest(any_value(a) - sum((p * (q - 1) + n * q) * x) / greatest(sum((p + n) * q * (1 - q) * x * x), 1e-12::DOUBLE), 1e-6::DOUBLE) AS a, 0.0::DOUBLE AS b FROM {rows} GROUP BY g)"""
            continue
        out += f""", s{k + 1} AS (SELECT g, a - (hbb * ga - hab * gb) / (haa * hbb - hab * hab) AS a, b - (haa * gb - hab * ga) / (haa * hbb - hab * hab) AS b FROM (
      SELECT g, any_value(a) AS a, any_value(b) AS b, sum((p * (q - high) + n * (q - low)) * x) + 1e-6::DOUBLE * any_value(a) AS ga, sum(p * (q - high) + n * (q - low)) + 1e-6::DOUBLE * any_value(b) AS gb,
        sum((p + n) * q * (1 - q) * x * x) + 1e-6::DOUBLE AS haa, sum((p + n) * q * (1 - q) * x) AS hab, sum((p + n) * q * (1 - q)) + 1e-6::DOUBLE AS hbb FROM {rows} GROUP BY g))"""
    return out


def platt_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I-01: iterative; tests compare it with a row-level fit."""
    fit = calibration.fit_platt(adapters.scored_documents(spark, sf_dir), score="clean")
    return spark.createDataFrame([(fit.method, round(fit.scale, 6), round(fit.bias, 6))], "method string, scale double, bias double")


_add(platt_fit, f"WITH {D}, {_hist_sql('sd', '1', 'clean')}, {_newton_sql(16)} SELECT 'platt' AS method, round(a, 6) AS scale, round(b, 6) AS bias FROM s16")


def temperature_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I-02."""
    fit = calibration.fit_temperature(adapters.scored_documents(spark, sf_dir), score="clean")
    return spark.createDataFrame([(fit.method, round(fit.scale, 6), round(fit.temperature, 4))], "method string, scale double, temperature double")


_add(temperature_fit, f"WITH {D}, {_hist_sql('sd', '1', 'clean')}, {_newton_sql(24, True)} SELECT 'temperature' AS method, round(a, 6) AS scale, round(1.0::DOUBLE / a, 4) AS temperature FROM s24")


def platt_by_condition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X-05, I-01: a fit for each condition; tests compare with the fit of one."""
    out = calibration.fit_groups(adapters.version_scores(spark, sf_dir), ["condition"])
    return out.select("condition", F.round("scale", 6).alias("scale"), F.round("bias", 6).alias("bias"))


_add(platt_by_condition, f"WITH {V}, {_hist_sql('vs', 'condition', 'score')}, {_newton_sql(16)} SELECT g AS condition, round(a, 6) AS scale, round(b, 6) AS bias FROM s16")


def _modes(spark, sf_dir) -> DataFrame:
    """Three patch modes of one score, as a carrier."""
    items = adapters.scored_items(spark, sf_dir).withColumns({"off": F.col("clean"), "coarse": F.coalesce("patch", "clean"), "full": F.col("jpeg"), "own": F.col("clean")})
    rows = adapters.to_long(items, ("off", "coarse", "full"), ("item_id", "binary_label", "patch", "own")).withColumnRenamed("condition", "mode")
    passes = F.when(F.col("mode") == "off", 0).when(F.col("mode") == "coarse", 4).otherwise(12)
    return rows.withColumns({
        "passes": passes, "seconds": passes * 0.5, "coverage": F.when(F.col("mode") != "off", passes / 16.0),
        "reused": (F.col("mode") == "coarse") & F.col("patch").isNull(),
    })


def patch_mode_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A-26, R-18, J-08."""
    out = robustness.mode_ablation(_modes(spark, sf_dir), T)
    return rounded(out, "auc", "mean_passes", "mean_seconds", "mean_coverage", "delta_f1", "delta_recall", "delta_fpr")


MODES_SQL = f"""{I}, md AS (SELECT *, off AS own FROM (SELECT item_id, binary_label, clean AS off, 'off' AS mode, clean AS score, 0 AS passes, false AS reused FROM items UNION ALL
    SELECT item_id, binary_label, clean, 'coarse', coalesce(patch, clean), 4, patch IS NULL FROM items UNION ALL SELECT item_id, binary_label, clean, 'full', jpeg, 12, false FROM items)),
  {S.metrics('md', 'mode', T)},
  mt AS (SELECT mode, avg(passes)::DOUBLE AS mean_passes, sum(passes)::BIGINT AS total_passes, avg(passes * 0.5::DOUBLE) AS mean_seconds,
    avg(CASE WHEN mode <> 'off' THEN passes / 16.0::DOUBLE END) AS mean_coverage, count(*) FILTER ((score >= {T}) <> (own >= {T})) AS decisions_changed, count(*) FILTER (reused) AS reused FROM md GROUP BY 1),
  ma AS (SELECT mt.*, m.* EXCLUDE (mode) REPLACE (round(auc, {DIGITS}) AS auc), round(m.f1 - b.f1, {DIGITS}) AS delta_f1, round(m.recall - b.recall, {DIGITS}) AS delta_recall,
    round(m.fpr - b.fpr, {DIGITS}) AS delta_fpr FROM mt JOIN m USING (mode) CROSS JOIN (SELECT f1, recall, fpr FROM m WHERE mode = 'off') b)"""
_add(patch_mode_ablation, f"WITH {MODES_SQL} SELECT * FROM ma")


def model_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J-13, A-38, I-08's input: the fused score against the clean one per source class pool."""
    long = adapters.to_long(_fused(spark, sf_dir), ("clean", "fused"), ("item_id", "binary_label", "status"))
    table = lambda c: metrics.binary_metrics(long.where(F.col("condition") == c), ["status"], T).withColumnRenamed("status", "condition")
    return rounded(robustness.compare_models(table("clean"), table("fused")), "before", "after", "delta")


_add(model_comparison, f"""WITH {FUSED_SQL}, a AS (SELECT * FROM (WITH {S.metrics('fu', 'status', T, score='clean')} SELECT * FROM m)),
  b AS (SELECT * FROM (WITH {S.metrics('fu', 'status', T, score='fused')} SELECT * FROM m)), u AS (""" + " UNION ALL ".join(
    f"SELECT a.status AS condition, '{n}' AS metric, a.{n} AS before, b.{n} AS after FROM a JOIN b USING (status)" for n in robustness.SUMMARY_METRICS
) + f") SELECT condition, metric, round(before, {DIGITS}) AS before, round(after, {DIGITS}) AS after, round(after - before, {DIGITS}) AS delta FROM u")
