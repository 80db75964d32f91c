"""Quantiles of counted values, and that what makes the values is worked out in one pass."""

import random

import numpy as np
import pytest

from plumbline.operators import radix, robustness

SHARES = {"low": 0.05, "mid": 0.5, "high": 0.95}


def test_weighted_quantiles(spark):
    rng = random.Random(5)
    rows = [(g, v, rng.randrange(0, 6)) for g in ("a", None) for v in {round(rng.uniform(-2, 2), 2) for _ in range(150)}] + [("a", None, 0), ("b", None, 0)]
    found = radix.quantiles(spark.createDataFrame(rows, "g string, v double, c long"), ["g"], "v", SHARES, "c").collect()
    assert {r["g"] for r in found} == {"a", None}
    for r in found:
        each = [v for g, v, c in rows if g == r["g"] for _ in range(c)]
        assert [r[n] for n in SHARES] == pytest.approx([np.quantile(each, q) for q in SHARES.values()])


def test_nulls_and_no_values(spark):
    rows = spark.createDataFrame([(0.25,), (None,), (0.75,), (0.75,)], "consistency double")
    assert tuple(robustness.consistency_distribution(rows).first()) == pytest.approx((1.75 / 3, 0.25, 0.75, 0.3))
    assert [tuple(r) for r in robustness.consistency_distribution(rows.where("consistency > 1")).collect()] == [(None, None, None, None)]


def test_items_are_read_once(spark):
    from plumbline import plans

    out = plans.queries()["consistency_distribution"](spark, "/root/testdata/sf0.001")
    out.collect()
    done = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert done.count("FileScan parquet") == 1
