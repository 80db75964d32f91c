"""Queries over scores of full precision: ranks, running sums and quantiles of unrounded doubles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import metrics, radix, robustness
from ..sources import adapters
from . import sql as S
from .evaluation import DIGITS, rounded

QUERIES: dict = {}
SQL: dict[str, str] = {}


def _add(query, sql: str | None = None):
    QUERIES[query.__name__] = query
    if sql:
        SQL[query.__name__] = sql


def _prices(spark, sf_dir) -> DataFrame:
    """Line items scored by what they cost after discount, mostly untied, per ship mode of status; prices of returned ones count as positive."""
    rows = adapters.table(spark, sf_dir, "lineitem")
    return rows.select(
        F.concat_ws("-", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber").alias("item_id"), F.col("l_linestatus").alias("status"),
        (F.col("l_returnflag") == "R").cast("int").alias("binary_label"),
        F.when(F.col("l_linenumber") != 7, F.col("l_extendedprice") * (1 - F.col("l_discount")) / 110000.0).alias("score"),
    )


PRICES = """pr AS (SELECT concat_ws('-', l_orderkey, l_partkey, l_suppkey, l_linenumber) AS item_id, l_linestatus AS status, (l_returnflag = 'R')::INT AS binary_label,
  CASE WHEN l_linenumber <> 7 THEN l_extendedprice * (1 - l_discount) / 110000.0::DOUBLE END AS score FROM lineitem)"""


def unrounded_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A-01 to A-03, W-01: no score is rounded, so every task gets digits of a key and none a whole one."""
    rows = _prices(spark, sf_dir)
    return rounded(metrics.binary_metrics(rows, ["status"], 0.3, parts=radix.tasks(rows)), "auc")


_add(unrounded_metrics, f"WITH {PRICES}, {S.metrics('pr', 'status', 0.3)} SELECT * REPLACE (round(auc, {DIGITS}) AS auc) FROM m")


def unrounded_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A-04, W-02."""
    return rounded(metrics.average_precision(_prices(spark, sf_dir), ["status"], "item_id"), "average_precision")


_add(unrounded_precision, f"""WITH {PRICES} SELECT status, round(avg(tp / r), {DIGITS}) AS average_precision FROM (
  SELECT status, binary_label, sum(binary_label) OVER w AS tp, row_number() OVER w AS r FROM (SELECT *, md5(item_id) AS h FROM pr WHERE score IS NOT NULL)
  WINDOW w AS (PARTITION BY status ORDER BY score DESC, h ROWS UNBOUNDED PRECEDING)) WHERE binary_label = 1 GROUP BY status""")


def running_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W-01: per customer balance, negative ones included: how many customers of the segment have less, and of how many nations their keys sum up."""
    rows = adapters.table(spark, sf_dir, "customer")
    hist = rows.groupBy("c_mktsegment", "c_acctbal").agg(F.count(F.lit(1)).alias("customers"), F.sum("c_nationkey").alias("nations"))
    return radix.running(hist, ["c_mktsegment"], "c_acctbal", ["customers", "nations"])


_add(running_balance, """WITH h AS (SELECT c_mktsegment, c_acctbal, count(*) AS customers, sum(c_nationkey)::BIGINT AS nations FROM customer GROUP BY 1, 2)
  SELECT *, coalesce(sum(customers) OVER w, 0)::BIGINT AS before_customers, coalesce(sum(nations) OVER w, 0)::BIGINT AS before_nations FROM h
  WINDOW w AS (PARTITION BY c_mktsegment ORDER BY c_acctbal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")


SHARES = {"p01": 0.01, "p25": 0.25, "median": 0.5, "p75": 0.75, "p999": 0.999}


def exact_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A-14 on unrounded prices, by selection."""
    return rounded(radix.quantiles(_prices(spark, sf_dir), ["status", "binary_label"], "score", SHARES), *SHARES)


_add(exact_quantiles, f"WITH {PRICES} SELECT status, binary_label, " + ", ".join(f"round(quantile_cont(score, {q}), {DIGITS}) AS {n}" for n, q in SHARES.items()) + " FROM pr GROUP BY 1, 2")


def range_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A-37: ten bins over the range of each status's prices."""
    return rounded(robustness.range_histogram(_prices(spark, sf_dir), ["status"]), "lower", "upper")


_add(range_histogram, f"""WITH {PRICES}, e AS (SELECT status, min(score) AS lo, max(score) AS hi FROM pr GROUP BY 1),
  b AS (SELECT status, k, lo + k * ((hi - lo) / 10.0::DOUBLE) AS lower, CASE WHEN k = 9 THEN hi ELSE lo + (k + 1) * ((hi - lo) / 10.0::DOUBLE) END AS upper FROM e CROSS JOIN range(10) t(k))
  SELECT b.status, k::INT AS bin, round(lower, {DIGITS}) AS lower, round(upper, {DIGITS}) AS upper, count(score) AS count FROM b LEFT JOIN pr ON b.status = pr.status AND score >= lower AND (score < upper OR (k = 9 AND score <= upper)) GROUP BY ALL""")
