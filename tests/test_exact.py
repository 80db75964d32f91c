"""Digits, running sums, ranks and quantiles of doubles against plain sorting."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators import metrics, radix

ODD = [0.0, -0.0, 5e-324, -5e-324, 2.2250738585072014e-308, 1.0, math.nextafter(1.0, 0), math.nextafter(1.0, 2), 1 - 1e-16, 1e-13, 1.7976931348623157e308, -1.7976931348623157e308, 0.3, 0.1 + 0.2, 4.0, 8.0, 1e22]


def values(rng, n):
    near_one = [1 - rng.random() * 1e-9 for _ in range(n)]
    spread = [math.ldexp(rng.random() - 0.5, rng.randrange(-1070, 1020)) for _ in range(n)]
    return ODD + near_one + spread + [round(rng.random(), 2) for _ in range(n)]


def test_digits_keep_the_order(spark):
    rng = random.Random(1)
    rows = values(rng, 300) + [float("inf"), float("-inf"), float("nan")]
    found = radix.digits(spark.createDataFrame([(v,) for v in rows], "v double"), "v").collect()
    by_digits = sorted(found, key=lambda r: (r["_d1"], r["_d2"], r["v"]))
    assert math.isnan(by_digits[-1]["v"]) and by_digits[-2]["v"] == float("inf")
    assert [r["v"] for r in by_digits[:-1]] == sorted(v for v in rows if not math.isnan(v))
    # a digit pair has no more values than its bits allow: neighbours in it are less than 2^-31 apart
    pairs = {}
    for r in found:
        if math.isfinite(r["v"]) and abs(r["v"]) > 1e-300:
            pairs.setdefault((r["_d1"], r["_d2"]), []).append(abs(r["v"]))
    assert all(max(v) / min(v) <= 1 + 2**-30 for v in pairs.values())


@pytest.mark.parametrize("descending", [False, True])
def test_running_sums(spark, descending):
    rng = random.Random(2)
    rows = [(rng.choice(["a", None, "c"]), v, rng.randrange(5), rng.randrange(3)) for v in set(values(rng, 60)) for _ in (0,)]
    rows = list({(k, v): (k, v, m, p) for k, v, m, p in rows}.values())
    found = radix.running(spark.createDataFrame(rows, "k string, v double, m long, p long"), ["k"], "v", ["m", "p"], descending).collect()
    assert len(found) == len(rows)
    for r in found:
        before = [x for x in rows if x[0] == r["k"] and (x[1] > r["v"] if descending else x[1] < r["v"])]
        assert (r["before_m"], r["before_p"]) == (sum(x[2] for x in before), sum(x[3] for x in before))


def test_auc_and_precision_of_unrounded_scores(spark):
    rng = random.Random(3)
    rows = [(rng.choice([1, 2, None]), k, int(rng.random() < 0.4), rng.choice([1 - rng.random() * 1e-12, rng.random(), 0.5, -rng.random()])) for k in range(900)]
    rows += [(7, 1, 1, 0.1), (7, 2, 1, 0.2), (8, 3, 0, None)] + [(9, 10_000 + k, 1, 0.25) for k in range(100)] + [(9, 20_000, 0, 0.1)]
    df = spark.createDataFrame(rows, "k int, item long, binary_label int, score double")
    auc = {r["k"]: r["auc"] for r in metrics.roc_auc(metrics.histogram(df, ["k"]), ["k"]).collect()}
    ap = {r["k"]: r["average_precision"] for r in metrics.average_precision(df, ["k"], "item").collect()}
    import hashlib

    for k in (1, 2, None, 7, 9):
        own = [(y, s, hashlib.md5(str(i).encode()).hexdigest()) for g, i, y, s in rows if g == k and s is not None]
        pos, neg = [s for y, s, _ in own if y], [s for y, s, _ in own if not y]
        want = sum((p > n) + (p == n) / 2 for p in pos for n in neg) / (len(pos) * len(neg)) if pos and neg else None
        assert auc[k] == want or abs(auc[k] - want) < 1e-12
        hits, total = 0, 0.0
        for at, (y, _, _) in enumerate(sorted(own, key=lambda x: (-x[1], x[2])), 1):
            if y:
                hits += 1
                total += hits / at
        assert abs(ap[k] - total / hits) < 1e-12
    assert 8 not in auc and 8 not in ap


@pytest.mark.parametrize("keys", [["k"], []])
def test_quantiles_equal_numpy(spark, keys):
    rng = random.Random(4)
    wide = [v for v in values(rng, 80) if abs(v) < 1e300]
    rows = [(rng.choice(["a", None]), v) for v in wide] + [("one", 3.5), ("ties", 2.0), ("ties", 2.0), ("none", None), ("a", None)]
    shares = {"p0": 0.0, "p05": 0.05, "median": 0.5, "p95": 0.95, "p1": 1.0}
    found = radix.quantiles(spark.createDataFrame(rows, "k string, v double"), keys, "v", shares).collect()
    groups = {r["k"] if keys else 0: r for r in found}
    assert set(groups) == ({"a", None, "one", "ties"} if keys else {0})
    for k, r in groups.items():
        own = [v for g, v in rows if v is not None and (not keys or g == k)]
        for name, q in shares.items():
            assert np.isclose(r[name], np.quantile(own, q), rtol=1e-9, atol=0), (k, name, r[name], np.quantile(own, q), len(own))
    none = radix.quantiles(spark.createDataFrame([], "k string, v double"), keys, "v", shares).collect()
    assert none == [] if keys else list(none[0]) == [None] * len(shares)


def test_no_window_holds_a_whole_key(spark):
    """What windows see of one key stays far below its rows, also where scores crowd below 1."""
    rows = spark.range(200_000).select((F.lit(1.0) - F.col("id") * 1e-14).alias("score"))
    sizes = radix.digits(rows, "score").groupBy("_d1", "_d2").count().agg(F.max("count"), F.count(F.lit(1))).first()
    assert sizes[0] < 200_000 / 5 and sizes[1] < 200_000 / 5


def test_histogram_over_the_range_of_the_data(spark):
    from plumbline.operators import robustness

    rng = random.Random(9)
    rows = [(rng.choice(["a", None]), rng.choice([rng.random(), round(rng.random(), 1), -3.0])) for _ in range(400)] + [("one", 0.3)] * 3 + [("none", None)]
    found = robustness.range_histogram(spark.createDataFrame(rows, "k string, v double"), ["k"], "v").collect()
    for k in ("a", None, "one"):
        own = sorted((r["bin"], r["lower"], r["upper"], r["count"]) for r in found if r["k"] == k)
        counts, edges = np.histogram([v for g, v in rows if g == k and v is not None], 10)
        assert [r[3] for r in own] == counts.tolist() and np.allclose([r[1] for r in own], edges[:-1]) and np.allclose([r[2] for r in own], edges[1:])
    assert len(found) == 30
