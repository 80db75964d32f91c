"""Queries over per-item rules: fusion, consistency, confidence, labels and abstention."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rules
from ..operators import abstain, metrics, robustness
from ..sources import adapters
from . import sql as S
from .evaluation import DIGITS, ECE, MEAN_T, RGB_SQL, rnd, rounded

T = 0.5
QUERIES: dict = {}
SQL: dict[str, str] = {}
I, D = adapters.ITEMS_SQL, adapters.DOCS_SQL
LIMITS = rules.AbstentionRules(margin=0.02, max_drift=0.3, min_consistency=0.2, min_agreement=0.7, crossing=0.5, min_coverage=0.0)


def _add(query, sql: str | None = None):
    QUERIES[query.__name__] = query
    if sql:
        SQL[query.__name__] = sql


def _items(spark, sf_dir) -> DataFrame:
    """Items with fused score, consistency, agreement, label and confidence."""
    items = adapters.scored_items(spark, sf_dir)
    clean, versions = F.col("clean"), adapters.transformed()
    items = items.withColumns({
        "fused": F.round(rules.rgb_transform(clean, versions), 6),
        "consistency": F.round(rules.consistency(rules.joined(clean, versions)), 6),
        "agreement": rules.agreement(versions, clean, T),
    })
    items = items.withColumn("label", rules.three_way(F.col("fused")))
    conf = rules.confidence(F.col("fused"), F.col("consistency"), F.col("agreement"))
    return items.withColumn("confidence", F.round(conf, 6)).withColumn("correct", (F.col("fused") >= T) == (F.col("binary_label") == 1))


MEAN5 = "((0.0::DOUBLE + clean + blur + noise + jpeg + crop) / 5)"
STD5 = "sqrt((0.0::DOUBLE + " + " + ".join(f"({c} - {MEAN5}) * ({c} - {MEAN5})" for c in adapters.CONDITIONS) + ") / 5)"
RANGE5 = "(greatest(clean, blur, noise, jpeg, crop) - least(clean, blur, noise, jpeg, crop))"
CONS_SQL = f"least(greatest(1.0::DOUBLE - ({STD5} / 0.2::DOUBLE * 0.5::DOUBLE + {RANGE5} / 0.6::DOUBLE * 0.5::DOUBLE), 0), 1)"
SIDES = lambda ref: "((" + " + ".join(f"(({c} >= {T}) = ({ref} >= {T}))::INT" for c in adapters.TRANSFORMED) + ") / 4.0::DOUBLE)"
LABEL = "CASE WHEN fused < 0.4::DOUBLE THEN 'Likely Authentic' WHEN fused >= 0.6::DOUBLE THEN 'Likely AI-Generated' ELSE 'Uncertain' END"
CONF = "least(greatest((least(greatest(abs(fused - 0.5::DOUBLE) * 2.0::DOUBLE, 0), 1) * 0.4::DOUBLE + consistency * 0.3::DOUBLE + agreement * 0.3::DOUBLE) / (0.4::DOUBLE + 0.3::DOUBLE + 0.3::DOUBLE), 0), 1)"
F_SQL = f"""{I}, f1 AS (SELECT *, round({RGB_SQL}, 6) AS fused, round({CONS_SQL}, 6) AS consistency, {SIDES('clean')} AS agreement FROM items),
  f AS (SELECT *, {LABEL} AS label, round({CONF}, 6) AS confidence, (fused >= {T}) = (binary_label = 1) AS correct FROM f1)"""
LEVEL = "CASE WHEN confidence >= 0.7::DOUBLE AND label <> 'Uncertain' THEN 'High' WHEN confidence >= 0.45::DOUBLE THEN 'Medium' ELSE 'Low' END"


def frequency_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R-05: the patch column stands in for the frequency score, which some rows lack."""
    items = _items(spark, sf_dir)
    fused = rules.frequency_fusion(F.col("clean"), adapters.transformed(), F.col("patch"), F.col("consistency"))
    return items.select("item_id", F.round(fused, 6).alias("fused"))


_add(frequency_fusion, f"""WITH {F_SQL} SELECT item_id, round(CASE WHEN patch IS NULL THEN {RGB_SQL} ELSE
  least(greatest(({RGB_SQL} * 0.5::DOUBLE + patch * 0.3::DOUBLE + (1.0::DOUBLE - consistency) * 0.2::DOUBLE) / 1.0::DOUBLE, 0), 1) END, 6) AS fused FROM f""")


def consistency_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R-07 to R-09, A-22 (a)."""
    every = rules.joined(F.col("clean"), adapters.transformed())
    items = _items(spark, sf_dir)
    return items.select(
        "item_id", F.round(rules.array_mean(every), 6).alias("mean"), F.round(rules.array_std(every), 6).alias("std"),
        F.round(rules.spread(every), 6).alias("range_"), "consistency", "agreement", rules.severity(F.col("consistency")).alias("severity"),
    )


_add(consistency_report, f"""WITH {F_SQL} SELECT item_id, round({MEAN5}, 6) AS mean, round({STD5}, 6) AS std, round({RANGE5}, 6) AS range_, consistency, agreement,
  CASE WHEN consistency >= 0.95::DOUBLE THEN 'low' WHEN consistency >= 0.85::DOUBLE THEN 'medium' ELSE 'high' END AS severity FROM f""")


def consistency_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A-15."""
    return rounded(robustness.consistency_distribution(_items(spark, sf_dir)), "mean", "median", "min", "p05")


_add(consistency_distribution, f"""WITH {F_SQL} SELECT round(avg(consistency), {DIGITS}) AS mean, round(quantile_cont(consistency, 0.5), {DIGITS}) AS median,
  round(min(consistency), {DIGITS}) AS min, round(quantile_cont(consistency, 0.05), {DIGITS}) AS p05 FROM f""")


def benchmark_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A-17: consistency, agreement and the number of each confidence level."""
    level = rules.confidence_level(F.col("confidence"), F.col("label"))
    out = _items(spark, sf_dir).agg(
        F.avg("consistency").alias("mean_consistency"), F.min("consistency").alias("min_consistency"), F.avg("agreement").alias("mean_agreement"),
        *[F.count_if(level == v).alias(v.lower()) for v in ("High", "Medium", "Low")],
    )
    return rounded(out, "mean_consistency", "mean_agreement")


_add(benchmark_totals, f"""WITH {F_SQL} SELECT round(avg(consistency), {DIGITS}) AS mean_consistency, min(consistency) AS min_consistency, round(avg(agreement), {DIGITS}) AS mean_agreement,
  count(*) FILTER (lv = 'High') AS high, count(*) FILTER (lv = 'Medium') AS medium, count(*) FILTER (lv = 'Low') AS low FROM (SELECT *, {LEVEL} AS lv FROM f)""")


def confidence_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R-10 to R-12, A-23: counts and accuracy by level and statement."""
    rows = _items(spark, sf_dir).withColumn("level", rules.confidence_level(F.col("confidence"), F.col("label")))
    out = rows.groupBy("level", rules.statement(F.col("label"), F.col("level")).alias("statement")).agg(
        F.count(F.lit(1)).alias("count"), F.avg(F.col("correct").cast("double")).alias("accuracy")
    )
    return rounded(out, "accuracy")


_add(confidence_levels, f"""WITH {F_SQL} SELECT level, concat(label, ' with ', lower(level), ' confidence') AS statement, count(*) AS count, round(avg(correct::INT), {DIGITS}) AS accuracy
  FROM (SELECT *, {LEVEL} AS level FROM f) GROUP BY 1, 2""")

REPORT = ("mean_right", "mean_wrong", "pearson", "uncertain_rate", "gap", "auroc", "ece")


def confidence_reliability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A-23 per line status."""
    return rounded(abstain.confidence_report(_items(spark, sf_dir), ["status"]), *REPORT)


def _report_sql(rel: str, key: str) -> str:
    return f"""cx AS (SELECT *, correct::INT AS y FROM {rel}), ca AS ({S.auc('cx', key, 'y', 'confidence')}), ce AS ({ECE('cx', 'confidence', key, 'y')}),
  cr AS (SELECT {key}, avg(confidence) FILTER (correct) AS mean_right, avg(confidence) FILTER (NOT correct) AS mean_wrong, corr(confidence, y) AS pearson, avg((label = 'Uncertain')::INT) AS uncertain_rate FROM cx GROUP BY 1),
  cz AS (SELECT cr.*, mean_right - mean_wrong AS gap, ca.auc AS auroc, ce.ece FROM cr JOIN ca USING ({key}) JOIN ce USING ({key}))"""


_add(confidence_reliability, f"WITH {F_SQL}, {_report_sql('f', 'status')} SELECT status, {rnd(*REPORT)} FROM cz")


def confidence_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R-15, A-23: three ways to use the patch evidence in confidence."""
    items = _items(spark, sf_dir)
    terms = rules.patch_agreement(F.col("patch"), F.col("clean"))
    wide = items.select("label", "correct", *[
        F.round(rules.confidence(F.col("fused"), F.col("consistency"), F.col("agreement"), term, 0.15), 6).alias(k) for k, term in terms.items()
    ])
    long = wide.unpivot(["label", "correct"], ["A", "B", "C"], "variant", "confidence")
    return rounded(abstain.confidence_report(long, ["variant"]), *REPORT)


CONF_P = """least(greatest((least(greatest(abs(fused - 0.5::DOUBLE) * 2.0::DOUBLE, 0), 1) * 0.4::DOUBLE + consistency * 0.3::DOUBLE + agreement * 0.3::DOUBLE + coalesce(pt * 0.15::DOUBLE, 0))
  / (0.4::DOUBLE + 0.3::DOUBLE + 0.3::DOUBLE + CASE WHEN pt IS NULL THEN 0.0::DOUBLE ELSE 0.15::DOUBLE END), 0), 1)"""
_add(confidence_variants, f"""WITH {F_SQL}, cv AS (SELECT 'A' AS variant, *, NULL::DOUBLE AS pt FROM f UNION ALL SELECT 'B', *, 1.0::DOUBLE - abs(patch - clean) FROM f
  UNION ALL SELECT 'C', *, CASE WHEN abs(patch - clean) <= 0.25::DOUBLE THEN 1.0::DOUBLE - abs(patch - clean) END FROM f),
  cw AS (SELECT variant, label, correct, round({CONF_P}, 6) AS confidence FROM cv), {_report_sql('cw', 'variant')} SELECT variant, {rnd(*REPORT)} FROM cz""")


def label_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P-04, R-20: labels around a threshold of 0.3."""
    low, high = rules.threshold_bands(rules.effective_threshold(0.3, None), 0.02)
    docs = adapters.scored_documents(spark, sf_dir).withColumn("label", rules.three_way(F.col("clean"), low, high))
    return docs.groupBy("lang", "label").agg(F.count(F.lit(1)).alias("count"), F.sum("binary_label").alias("positives"))


_add(label_bands, f"""WITH {D} SELECT lang, CASE WHEN clean < {0.3 - 0.02!r}::DOUBLE THEN 'Likely Authentic' WHEN clean >= {0.3 + 0.02!r}::DOUBLE THEN 'Likely AI-Generated' ELSE 'Uncertain' END AS label,
  count(*) AS count, sum(binary_label)::BIGINT AS positives FROM sd GROUP BY 1, 2""")


def failure_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P-05, T-01: the eight clearest errors of either kind and the totals (a top-k report)."""
    docs = adapters.scored_documents(spark, sf_dir).select("doc_id", "binary_label", "clean")
    high = docs.where((F.col("binary_label") == 0) & (F.col("clean") >= 0.3)).withColumn("kind", F.lit("false_positive"))
    low = docs.where((F.col("binary_label") == 1) & (F.col("clean") < 0.3)).withColumn("kind", F.lit("false_negative"))
    totals = high.unionByName(low).groupBy("kind").agg(F.count(F.lit(1)).alias("total"))
    top = high.orderBy(F.desc("clean"), "doc_id").limit(8).unionByName(low.orderBy("clean", "doc_id").limit(8))
    return top.join(F.broadcast(totals), "kind").select("kind", "doc_id", "clean", "total")


_add(failure_examples, f"""WITH {D}, e AS (SELECT CASE WHEN binary_label = 0 THEN 'false_positive' ELSE 'false_negative' END AS kind, doc_id, clean FROM sd
    WHERE (binary_label = 0 AND clean >= 0.3::DOUBLE) OR (binary_label = 1 AND clean < 0.3::DOUBLE)),
  r AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY CASE WHEN kind = 'false_positive' THEN -clean ELSE clean END, doc_id) AS k, count(*) OVER (PARTITION BY kind) AS total FROM e)
  SELECT kind, doc_id, clean, total FROM r WHERE k <= 8""")


def batch_grade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A-33, A-34, T-03: one pass over all documents; unlabelled ones have no outcome."""
    docs = adapters.table(spark, sf_dir, "documents").select("doc_id", "source")
    graded = docs.join(adapters.scored_documents(spark, sf_dir).select("doc_id", "binary_label", "clean"), "doc_id", "left")
    yes = F.col("clean") >= 0.3
    counts = graded.groupBy("source").agg(
        F.count(F.lit(1)).alias("seen"), F.count("clean").alias("labelled"), F.count_if(F.col("clean").isNull()).alias("unlabelled"),
        *metrics.confusion(F.col("binary_label"), yes),
    )
    return metrics.with_rates(counts, "accuracy", "f1", "balanced_accuracy")


_add(batch_grade, f"""WITH {D}, j AS (SELECT d.source, s.binary_label, s.clean FROM documents d LEFT JOIN sd s USING (doc_id)),
  c AS (SELECT source, count(*) AS seen, count(clean) AS labelled, count(*) FILTER (clean IS NULL) AS unlabelled, {S.counts('clean >= 0.3::DOUBLE')} FROM j GROUP BY 1)
  SELECT *, {S.rates('accuracy', 'f1', 'balanced_accuracy')} FROM c""")


def _flagged(spark, sf_dir) -> DataFrame:
    items = _items(spark, sf_dir)
    flags = LIMITS.flags(T, F.col("fused"), F.col("clean"), adapters.transformed(), F.col("consistency"), F.col("agreement"))
    abstains, fired = LIMITS.apply(flags)
    return items.withColumn("abstains", abstains).withColumn("fired", fired)


ABOVE = "(" + " + ".join(f"({c} >= {T})::INT" for c in adapters.CONDITIONS) + ")"
MINORITY = f"(least({ABOVE}, 5 - {ABOVE}) / 5.0::DOUBLE)"
FLAG_SQL = {
    "borderline": f"abs(fused - {T}) < 0.02::DOUBLE",
    "drift": f"clean >= {T} AND clean - {MEAN_T} > 0.3::DOUBLE",
    "consistency": "consistency < 0.2::DOUBLE",
    "crossing": f"{ABOVE} > 0 AND {ABOVE} < 5 AND {MINORITY} >= 0.5::DOUBLE",
    "agreement": "agreement < 0.7::DOUBLE",
}
FIRED = "concat_ws(',', " + ", ".join(f"CASE WHEN {v} THEN '{k}' END" for k, v in FLAG_SQL.items()) + ")"


def abstention_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R-13: which rules fire, per item."""
    rows = _flagged(spark, sf_dir)
    label = F.when(F.col("abstains"), "Uncertain").otherwise(F.col("label"))
    return rows.select("item_id", "abstains", F.array_join("fired", ",").alias("fired"), label.alias("label"))


_add(abstention_rules, f"""WITH {F_SQL}, a AS (SELECT item_id, label AS l, {FIRED} AS fired FROM f)
  SELECT item_id, fired <> '' AS abstains, fired, CASE WHEN fired <> '' THEN 'Uncertain' ELSE l END AS label FROM a""")

EVAL = ("rate", "error_rate", "error_abstained", "error_answered", "accuracy_answered", "enrichment")


def _eval_sql(rel: str, keys: str) -> str:
    """rel(keys.., correct, hit)."""
    d = S.div
    return f"""ev AS (SELECT {keys}count(*) AS count, count(*) FILTER (hit) AS abstained, count(*) FILTER (NOT correct) AS errors, count(*) FILTER (hit AND NOT correct) AS errors_abstained FROM {rel} GROUP BY ALL),
  er AS (SELECT *, {d('abstained', 'count')} AS rate, {d('errors', 'count')} AS error_rate, {d('errors_abstained', 'abstained')} AS error_abstained,
    {d('errors - errors_abstained', 'count - abstained')} AS error_answered FROM ev),
  ef AS (SELECT *, CASE WHEN count > abstained THEN 1.0::DOUBLE - error_answered ELSE 0.0::DOUBLE END AS accuracy_answered, {d('error_abstained', 'error_rate')} AS enrichment FROM er)"""


def abstention_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A-24 per source class."""
    return rounded(abstain.evaluate(_flagged(spark, sf_dir), F.col("abstains"), ["source_label"]), *EVAL)


_add(abstention_eval, f"WITH {F_SQL}, h AS (SELECT source_label, correct, {FIRED} <> '' AS hit FROM f), {_eval_sql('h', 'source_label, ')} SELECT * REPLACE ({rnd(*EVAL)}) FROM ef")


def _features(spark, sf_dir) -> DataFrame:
    items = adapters.scored_items(spark, sf_dir)
    fused = F.round(rules.rgb_transform(F.col("clean"), adapters.transformed()), 6)
    rows = abstain.features(items, T, fused, F.col("clean"), adapters.transformed())
    return rows.withColumn("consistency", F.round("consistency", 6)).withColumn("drop", F.round("drop", 6))


def abstention_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A-24 over the grids of I-05; the agreement is with the fused side (A-22 b)."""
    return rounded(abstain.sweep(_features(spark, sf_dir)), *EVAL)


_TESTS = {
    "borderline": f"abs(fused - {T}) < v", "drift": f"clean >= {T} AND round(clean - {MEAN_T}, 6) > v", "consistency": "consistency < v",
    "agreement": f"{SIDES('fused')} < v", "crossing": f"{MINORITY} >= v",
}
_add(abstention_sweep, f"WITH {F_SQL}, h AS (" + " UNION ALL ".join(
    f"SELECT '{r}' AS rule, k::INT AS step, v AS \"limit\", correct, {_TESTS[r]} AS hit FROM f CROSS JOIN (SELECT unnest({[float(x) for x in g]}::DOUBLE[]) AS v, unnest(range({len(g)})) AS k)" for r, g in abstain.GRIDS
) + f"), {_eval_sql('h', 'rule, step, \"limit\", ')} SELECT * REPLACE ({rnd(*EVAL)}) FROM ef")


def degradation_flips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R-14."""
    items = adapters.scored_items(spark, sf_dir)
    flip = rules.degradation_flip(F.col("clean"), adapters.transformed(), T, 0.25)
    return items.where(flip).groupBy("source_label").agg(F.count(F.lit(1)).alias("flips"))


_add(degradation_flips, f"""WITH {I} SELECT source_label, count(*) AS flips FROM items WHERE clean >= {T} AND {MEAN_T} < {T} AND clean - {MEAN_T} > 0.25::DOUBLE GROUP BY 1""")
