"""Queries for thresholds that are frozen, guards and verdicts (I-04 to I-09, P-11, P-13, J-01, C-15)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rules
from ..operators import abstain, dataset, metrics, robustness, splits
from ..sources import adapters
from . import evaluation, preparation, scoring
from . import sql as S
from .evaluation import DIGITS, rounded

T = 0.5
QUERIES: dict = {}
SQL: dict[str, str] = {}
I, D = adapters.ITEMS_SQL, adapters.DOCS_SQL


def _add(query, sql: str | None = None):
    QUERIES[query.__name__] = query
    if sql:
        SQL[query.__name__] = sql


def frozen_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I-04, P-11: one threshold from the clean scores of the validation half (W-07's buckets here)."""
    items = adapters.scored_documents(spark, sf_dir)
    split = splits.bucket(F.sha2(F.col("doc_id").cast("string"), 256), 0.5, 0.5)
    return metrics.frozen_threshold(items.where(split == "validation"), score="clean")


_add(frozen_threshold, f"""WITH {D}, va AS (SELECT * FROM sd WHERE ('0x' || substr(sha256(doc_id::VARCHAR), 1, 8))::BIGINT / 4294967296.0::DOUBLE >= 0.5::DOUBLE),
  {evaluation.CURVE('va', 'clean', '', '1, 100')}, r AS (SELECT *, {S.rates()} FROM c)
  SELECT first(threshold ORDER BY youden_j DESC, abs(threshold - 0.5::DOUBLE), threshold) AS balanced,
    first(threshold ORDER BY f1 DESC, threshold) AS f1_optimal,
    coalesce(min(threshold) FILTER (fpr <= 0.05::DOUBLE), first(threshold ORDER BY fpr, threshold)) AS low_fpr,
    count(*) FILTER (fpr <= 0.05::DOUBLE) > 0 AS target_met,
    first(threshold ORDER BY recall DESC, fpr, threshold) AS high_recall FROM r""")


def group_metrics_or_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P-13: a group with one class has no metrics, whatever its counts."""
    docs = adapters.scored_documents(spark, sf_dir).where("source is not null")
    return rounded(metrics.metrics_or_null(docs, ["source", "toxic"], 0.3, score="clean"), "auc")


_RATES = ("auc", *S.RATES)
_add(group_metrics_or_null, f"""WITH {D}, ts AS (SELECT *, concat(source, '#', toxic) AS gk FROM sd WHERE source IS NOT NULL), {S.metrics('ts', 'gk', 0.3, score='clean')}
  SELECT ks.source, ks.toxic, tp, fp, tn, fn, """ + ", ".join(f"CASE WHEN tp + fn > 0 AND fp + tn > 0 THEN {f'round({c}, {DIGITS})' if c == 'auc' else c} END AS {c}" for c in _RATES) + """
  FROM m JOIN (SELECT DISTINCT gk, source, toxic FROM ts) ks USING (gk)""")


def failure_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J-01: the rows whose id failed, by a semi join."""
    docs = adapters.scored_documents(spark, sf_dir)
    failed = docs.where((F.col("clean") >= 0.3) != (F.col("binary_label") == 1)).select("doc_id")
    return adapters.table(spark, sf_dir, "documents").join(failed, "doc_id", "left_semi").select("doc_id", "lang", "source")


_add(failure_rows, f"WITH {D} SELECT doc_id, lang, source FROM documents WHERE doc_id IN (SELECT doc_id FROM sd WHERE (clean >= 0.3::DOUBLE) <> (binary_label = 1))")


def patch_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I-06."""
    return abstain.patch_verdict(robustness.mode_ablation(evaluation._modes(spark, sf_dir), T))


_add(patch_verdict, f"""WITH {evaluation.MODES_SQL} SELECT coalesce(bool_or((delta_f1 > 0.005::DOUBLE OR delta_recall > 0.005::DOUBLE) AND delta_fpr <= 0), false) AS helps
  FROM ma WHERE mode <> 'off'""")


def preferred_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I-07: which confidence variants beat A."""
    return abstain.preferred(scoring.confidence_variants(spark, sf_dir), "A")


_add(preferred_variants, f"""WITH cv0 AS ({scoring.SQL['confidence_variants']})
  SELECT b.variant, b.auroc - a.auroc > {abstain.GAIN} AND b.gap >= a.gap AS preferred FROM cv0 b, cv0 a WHERE a.variant = 'A' AND b.variant <> 'A'""")


def _gains(spark, sf_dir) -> DataFrame:
    """Each transformed score against the clean one, as models against a first model."""
    names = ("recall", "f1", "fpr")
    versions = adapters.version_scores(spark, sf_dir)
    table = metrics.binary_metrics(versions, ["condition"], T).select("condition", *names)
    base = table.where("condition = 'clean'").select(*[F.col(n).alias(f"b_{n}") for n in names])
    rows = table.where("condition <> 'clean'").join(F.broadcast(base))
    long = F.array(*[F.struct(F.lit(n).alias("metric"), F.col(f"b_{n}").alias("before"), F.col(n).alias("after"), (F.col(n) - F.col(f"b_{n}")).alias("delta")) for n in names])
    return rows.select("condition", F.inline(long))


G_SQL = f"""{adapters.VERSIONS_SQL}, {S.metrics('vs', 'condition', T)},
  gn AS (SELECT m.condition, m.recall - b.recall AS recall_gain, m.f1 - b.f1 AS f1_gain, m.fpr - b.fpr AS fpr_rise FROM m CROSS JOIN (SELECT * FROM m WHERE condition = 'clean') b WHERE m.condition <> 'clean')"""


def model_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I-08: recall or F1 gains enough and false positives rise little."""
    return rounded(abstain.retain(_gains(spark, sf_dir)), "recall_gain", "f1_gain", "fpr_rise")


_add(model_retention, f"""WITH {G_SQL} SELECT condition, {evaluation.rnd('recall_gain', 'f1_gain', 'fpr_rise')},
  greatest(recall_gain, f1_gain) >= {abstain.GAIN} AND fpr_rise <= {abstain.FPR_RISE} AS retained FROM gn""")


def best_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I-09: the candidate with the best gain under the bars of I-08, with a wider bar for false positives on these scores."""
    rows = abstain.retain(_gains(spark, sf_dir)).withColumnRenamed("condition", "loss")
    names = F.array(*[F.lit(c) for c in adapters.CONDITIONS])
    return abstain.best_loss(rows.withColumn("ordinal", F.array_position(names, F.col("loss")).cast("int")), fpr_rise=1.0)


_add(best_loss, f"""WITH {G_SQL} SELECT first(condition ORDER BY greatest(recall_gain, f1_gain) DESC, list_position({list(adapters.CONDITIONS)}, condition))
  FILTER (greatest(recall_gain, f1_gain) >= {abstain.GAIN} AND fpr_rise <= 1.0) AS loss FROM gn""")


def _near_label(spark, sf_dir) -> DataFrame:
    """Features of I-10 for a label that follows from one score, so that errors lie near the threshold."""
    items = adapters.scored_items(spark, sf_dir).withColumn("binary_label", (F.col("jpeg") >= T).cast("int"))
    fused = F.round(rules.rgb_transform(F.col("clean"), adapters.transformed()), 6)
    rows = abstain.features(items, T, fused, F.col("clean"), adapters.transformed())
    return rows.withColumn("consistency", F.round("consistency", 6)).withColumn("drop", F.round("drop", 6)).withColumn("distance", F.round("distance", 6))


def abstention_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I-05: rules in their order, each on top of those accepted before."""
    chosen = abstain.select(_near_label(spark, sf_dir))
    return spark.createDataFrame([(k, r, float(v)) for k, (r, v) in enumerate(chosen)], "step int, rule string, limit double")


def _selection_sql() -> str:
    tests = {"borderline": "distance < v", "drift": f"clean >= {T} AND dropped > v", "consistency": "consistency < v", "agreement": "agr < v", "crossing": "minority >= v"}
    out = f"""WITH {scoring.F_SQL}, x0 AS (SELECT clean, round(abs(fused - {T}), 6) AS distance, round(clean - {scoring.MEAN_T}, 6) AS dropped, consistency, {scoring.SIDES('fused')} AS agr,
    {scoring.MINORITY} AS minority, (fused >= {T}) = (jpeg >= {T}) AS correct, false AS acc FROM f)"""
    for k, (rule, grid) in enumerate(abstain.GRIDS):
        out += f""", h{k} AS (SELECT k, v, correct, acc OR ({tests[rule]}) AS hit FROM x{k} CROSS JOIN (SELECT unnest({[float(x) for x in grid]}::DOUBLE[]) AS v, unnest(range({len(grid)})) AS k)),
    n{k} AS (SELECT k, v, count(*) AS n, count(*) FILTER (hit) AS a, count(*) FILTER (NOT correct) AS e, count(*) FILTER (hit AND NOT correct) AS ea FROM h{k} GROUP BY 1, 2),
    r{k} AS (SELECT k, v, {S.div('a', 'n')} AS rate, {S.div(S.div('ea', 'a'), S.div('e', 'n'))} AS enr, CASE WHEN n > a THEN 1.0::DOUBLE - {S.div('e - ea', 'n - a')} ELSE 0.0::DOUBLE END AS acc FROM n{k}),
    c{k} AS (SELECT first(v ORDER BY acc - {abstain.RATE_PENALTY}::DOUBLE * rate DESC, k) AS best FROM r{k} WHERE rate <= {abstain.MAX_RATE}::DOUBLE AND enr >= {abstain.MIN_ENRICHMENT}::DOUBLE),
    x{k + 1} AS (SELECT x{k}.* EXCLUDE (acc), acc OR coalesce(({tests[rule].replace(' v', ' best')}), false) AS acc FROM x{k} CROSS JOIN c{k})"""
    every = " UNION ALL ".join(f"SELECT {k} AS o, '{r}' AS rule, best AS \"limit\" FROM c{k}" for k, (r, _) in enumerate(abstain.GRIDS))
    return out + f""" SELECT (row_number() OVER (ORDER BY o) - 1)::INT AS step, rule, "limit" FROM ({every}) WHERE "limit" IS NOT NULL"""


_add(abstention_selection, _selection_sql())


def late_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R-13, rules 6 and 7: little coverage, and errors of stages other than the patches."""
    items = adapters.scored_items(spark, sf_dir)
    coverage = F.when(F.col("patch").isNotNull(), F.col("patch"))
    errors = F.array_compact(F.array(F.when(F.col("noise") > 0.9, F.lit("transforms")), F.when(F.col("blur") > 0.9, F.lit("patches"))))
    limits = rules.AbstentionRules(min_coverage=0.25, on_errors=True, rules=("coverage", "errors"))
    abstains, fired = limits.apply(limits.flags(T, F.col("clean"), F.col("clean"), adapters.transformed(), F.col("clean"), F.col("clean"), coverage, errors))
    return items.groupBy(F.array_join(fired, ",").alias("fired"), abstains.alias("abstains")).agg(F.count(F.lit(1)).alias("count"))


_add(late_rules, f"""WITH {I}, a AS (SELECT concat_ws(',', CASE WHEN patch < 0.25::DOUBLE THEN 'coverage' END, CASE WHEN noise > 0.9::DOUBLE THEN 'errors' END) AS fired FROM items)
  SELECT fired, fired <> '' AS abstains, count(*) AS count FROM a GROUP BY 1""")


def logit_probabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R-17: three scores as logits; the second class by softmax, and one logit by the sigmoid."""
    items = adapters.scored_items(spark, sf_dir)
    logits = F.array(*[F.col(c) * 4 - 2 for c in ("clean", "blur", "noise")])
    return items.select("item_id", F.round(rules.softmax(logits, 2), 6).alias("second"), F.round(rules.sigmoid(F.col("clean") * 4 - 2), 6).alias("one"))


_add(logit_probabilities, f"""WITH {I} SELECT item_id, round(exp(blur * 4 - 2) / (exp(clean * 4 - 2) + exp(blur * 4 - 2) + exp(noise * 4 - 2)), 6) AS second,
  round(1.0::DOUBLE / (1.0::DOUBLE + exp(-(clean * 4 - 2))), 6) AS one FROM items""")


def assembled_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C-14, C-15: records by split after isolation, quarantine and a mixture; groups are split as wholes here."""
    records = _whole_groups(preparation._records(spark, sf_dir))
    pool = adapters.table(spark, sf_dir, "pages").select(
        F.concat(F.lit("page_"), "page_id").alias("path"), F.lit(1).alias("label"), F.lit("pool").alias("split"), F.concat(F.lit("p"), F.col("page_id") % 50).alias("group_id"),
        F.sha2(F.col("page_id").cast("string"), 256).alias("hash"),
    )
    out = dataset.assemble(records, pool, 0.1)
    return out.groupBy("split", F.startswith("group_id", F.lit("synthetic_mixture")).alias("mixed")).agg(
        F.count(F.lit(1)).alias("count"), F.sum("label").alias("positives"), F.countDistinct("group_id").alias("groups")
    )


def _whole_groups(records: DataFrame) -> DataFrame:
    return records.withColumn("split", splits.bucket(F.sha2("group_id", 256), 0.1, 0.2))


SHARE = "(('0x' || substr(sha256(group_id), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"
_add(assembled_dataset, f"""WITH {preparation.REC},
  wg AS (SELECT path, label, group_id, hash, CASE WHEN {SHARE} < 0.1::DOUBLE THEN 'test' WHEN {SHARE} < {0.1 + 0.2!r}::DOUBLE THEN 'validation' ELSE 'train' END AS split FROM rec),
  kp AS (SELECT split, label, group_id FROM wg WHERE hash NOT IN (SELECT hash FROM wg GROUP BY hash HAVING count(DISTINCT label) > 1)),
  ba AS (SELECT round_even(count(*) * 0.1::DOUBLE / (1 - 0.1::DOUBLE), 0) AS wanted FROM kp WHERE split = 'train'),
  dr AS (SELECT page_id, row_number() OVER (ORDER BY sha256('1234:synthetic-mixture:page_' || page_id), 'page_' || page_id) AS r FROM pages),
  al AS (SELECT * FROM kp UNION ALL SELECT 'train', 1, 'synthetic_mixture:p' || (page_id % 50) FROM dr WHERE r <= (SELECT wanted FROM ba))
  SELECT split, starts_with(group_id, 'synthetic_mixture') AS mixed, count(*) AS count, sum(label)::BIGINT AS positives, count(DISTINCT group_id) AS groups FROM al GROUP BY 1, 2""")
