import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators import abstain, audit, calibration, metrics, robustness, splits
from plumbline.functions import rules, scorers


def frame(spark, labels, scores):
    return spark.createDataFrame([(0, i, y, float(s)) for i, (y, s) in enumerate(zip(labels, scores))], "k int, item_id int, binary_label int, score double")


def pairwise(y, s):
    """Share of (positive, negative) pairs in the right order, ties counted half; None for one class."""
    won = [1.0 if a > b else 0.5 if a == b else 0.0 for a, i in zip(s, y) if i == 1 for b, j in zip(s, y) if j == 0]
    return sum(won) / len(won) if won else None


def test_auc_equals_all_pairs(spark):
    rng = np.random.default_rng(17)
    cases = [(rng.integers(0, 2, n).tolist(), (rng.integers(0, m, n) / m).tolist()) for n, m in ((7, 3), (30, 4), (60, 50), (45, 1), (80, 9))]
    cases += [([1] * 6, [0.1, 0.7, 0.7, 0.2, 0.9, 0.4]), ([0] * 3, [0.6, 0.6, 0.1])]
    rows = [(k, i, y, float(s)) for k, (labels, scores) in enumerate(cases) for i, (y, s) in enumerate(zip(labels, scores))]
    found = metrics.roc_auc(metrics.histogram(spark.createDataFrame(rows, "k int, item_id int, binary_label int, score double"), ["k"]), ["k"])
    found = {r["k"]: r["auc"] for r in found.collect()}
    for k, (y, s) in enumerate(cases):
        expected = pairwise(y, s)
        assert found[k] is None if expected is None else found[k] == pytest.approx(expected)


def test_confusion_and_rates(spark):
    row = metrics.binary_metrics(frame(spark, [1, 1, 0, 0], [0.9, 0.3, 0.8, 0.1]), ["k"], 0.5).first()
    assert [row[c] for c in metrics.COUNTS] == [1, 1, 1, 1]
    assert row["accuracy"] == row["f1"] == row["fpr"] == 0.5
    none = metrics.binary_metrics(frame(spark, [1, 1], [0.9, 0.3]), ["k"], 0.5).first()
    assert none["fpr"] == 1.0 and none["auc"] is None
    assert metrics.training_metrics(frame(spark, [1, 1], [0.9, 0.3]), ["k"], 0.5).first()["fpr"] == 0.0


def test_average_precision(spark):
    rng = np.random.default_rng(5)
    y, s = rng.integers(0, 2, 60), rng.permutation(60) / 60
    found = metrics.average_precision(frame(spark, y.tolist(), s), ["k"], "item_id").first()[1]
    order = np.argsort(-s)
    hits = np.cumsum(y[order]) / np.arange(1, 61)
    assert found == pytest.approx(hits[y[order] == 1].mean())
    assert metrics.average_precision(frame(spark, [0, 0], [0.3, 0.7]), ["k"], "item_id").first()[1] is None


def test_empty_and_null_scores(spark):
    empty = frame(spark, [], [])
    assert metrics.binary_metrics(empty, ["k"], 0.5).count() == 0
    nulls = empty.union(spark.createDataFrame([(0, 1, 1, None)], empty.schema))
    assert metrics.threshold_curve(nulls, ["k"]).count() == 0
    assert rules.logit(F.lit(None).cast("double")) is not None


def test_sweep_equals_direct_counts(spark):
    rng = np.random.default_rng(3)
    y, s = rng.integers(0, 2, 200), np.round(rng.random(200), 2)
    for row in metrics.threshold_curve(frame(spark, y.tolist(), s), ["k"]).collect():
        assert row["tp"] == int(((s >= row["threshold"]) & (y == 1)).sum())
        assert row["fp"] == int(((s >= row["threshold"]) & (y == 0)).sum())


def test_platt_equals_a_row_level_fit(spark):
    rng = np.random.default_rng(11)
    y = rng.integers(0, 2, 400)
    s = np.round(np.clip(0.5 + 0.15 * (y - 0.5) + rng.normal(0, 0.2, 400), 0.01, 0.99), 2)
    fit = calibration.fit_platt(frame(spark, y.tolist(), s))
    x = np.log(s / (1 - s))
    p, n = y.sum(), (1 - y).sum()
    t = np.where(y == 1, (p + 1) / (p + 2), 1 / (n + 2))
    w = np.array([1.0, 0.0])
    a = np.stack([x, np.ones(400)], 1)
    for _ in range(50):
        q = 1 / (1 + np.exp(-a @ w))
        w = w - np.linalg.solve((a * (q * (1 - q))[:, None]).T @ a + 1e-6 * np.eye(2), a.T @ (q - t) + 1e-6 * w)
    assert [fit.scale, fit.bias] == pytest.approx(w.tolist(), abs=1e-6)


def test_fits_of_groups_equal_single_fits(spark):
    rng = np.random.default_rng(4)
    rows = [(k, i, int(y), float(s)) for k in range(3) for i, (y, s) in enumerate((y, np.round(np.clip(0.4 + 0.2 * y + rng.normal(0, 0.2), 0.01, 0.99), 2)) for y in rng.integers(0, 2, 150))]
    df = spark.createDataFrame([*rows, (9, 0, 1, 0.5)], "k int, item_id int, binary_label int, score double")
    found = {r["k"]: (r["scale"], r["bias"]) for r in calibration.fit_groups(df, ["k"]).collect()}
    assert found.pop(9) == (None, None) and len(found) == 3
    for k, fit in found.items():
        one = calibration.fit_platt(df.where(F.col("k") == k))
        assert fit == pytest.approx((one.scale, one.bias), abs=1e-6)


def test_scorer_loads_once_and_passes_nulls(spark):
    rows = spark.createDataFrame([(1, [1.0, 2.0]), (2, None), (3, [0.5]), (4, [0.0, 0.0])], "id int, v array<double>").coalesce(1)
    out = {r["id"]: r["s"] for r in rows.select("id", scorers.scorer(scorers.linear([1.0, -1.0]))(F.col("v")).alias("s")).collect()}
    assert out[1] == pytest.approx(1 / (1 + np.e)) and out[2] is None and out[3] is None and out[4] == 0.5


def test_platt_is_finite_on_separable_scores(spark):
    fit = calibration.fit_platt(frame(spark, [0] * 10 + [1] * 10, [0.01] * 10 + [0.99] * 10))
    assert np.isfinite([fit.scale, fit.bias]).all() and fit.scale > 0
    with pytest.raises(ValueError):
        calibration.fit_platt(frame(spark, [1], [0.5]))


def test_reliability_edges(spark):
    rows = calibration.reliability(frame(spark, [1, 0, 1, 1], [0.3, 0.6, 0.7, 1.0]), ["k"]).orderBy("bin").collect()
    assert len(rows) == 10 and rows[9]["count"] == 1 and sum(r["count"] for r in rows) == 4
    assert rows[2]["count"] == 1  # 0.3 is under the third edge as a double


def test_selection_equals_a_plain_loop(spark):
    rng = np.random.default_rng(1)
    n = 300
    d = rng.random(n) * 0.5
    right = rng.random(n) < 0.5 + d
    rows = spark.createDataFrame(
        [(bool(r), float(v), 0.0, False, 1.0, 1.0, 0.0) for r, v in zip(right, d)],
        "correct boolean, distance double, drop double, looked_positive boolean, consistency double, agreement double, minority double",
    )
    best, value = None, None
    for limit in dict(abstain.GRIDS)["borderline"]:
        hit = d < limit
        base, away = (~right).mean(), (~right[hit]).mean() if hit.any() else 0.0
        score = right[~hit].mean() - abstain.RATE_PENALTY * hit.mean()
        if hit.mean() <= abstain.MAX_RATE and away / base >= abstain.MIN_ENRICHMENT and (value is None or score > value):
            best, value = limit, score
    assert dict(abstain.select(rows)).get("borderline") == best


def test_worst_condition_is_the_first_on_ties(spark):
    table = spark.createDataFrame([("clean", 0, 0.9), ("a", 1, 0.5), ("b", 2, 0.5)], "condition string, ordinal int, accuracy double")
    row = robustness.summary(table, ["accuracy"]).first()
    assert row["worst_condition"] == "a" and row["largest_drop"] == pytest.approx(0.4)


def test_near_pairs_equal_brute_force(spark):
    rng = np.random.default_rng(2)
    base = rng.integers(-(2**63), 2**63 - 1, 30)
    close = base ^ (np.int64(1) << rng.integers(0, 63, 30)) ^ (np.int64(1) << rng.integers(0, 63, 30))
    a, b = [int(x) for x in base], [int(x) for x in close]
    mk = lambda v: spark.createDataFrame([(x,) for x in v], "h long")
    found = {(r["h1"], r["h2"]) for r in audit.near_pairs(mk(a), mk(b), 2).collect()}
    assert found == {(x, y) for x in set(a) for y in set(b) if x != y and bin((x ^ y) & (2**64 - 1)).count("1") <= 2}


def test_pair_losses_equal_all_pairs(spark):
    rng = np.random.default_rng(8)
    data = [(int(g), int(y), float(v)) for g, y, v in zip(rng.integers(0, 4, 60), rng.integers(0, 2, 60), rng.random(60))]
    rows = spark.createDataFrame(data, "g int, y int, v double")
    for same in (None, "y"):
        key = lambda r: r[0] if same is None else r[:2]
        for r in audit.pair_loss(rows, "g", "v", same=same).collect():
            own = [x for x in data if key(x) == (r["g"] if same is None else (r["g"], r["y"]))]
            losses = [(a[2] - b[2]) ** 2 for i, a in enumerate(own) for b in own[:i]]
            assert r["count"] == len(own) and r["loss"] == pytest.approx(np.mean(losses))


def test_isolation(spark):
    rows = spark.createDataFrame([("g1", "train"), ("g2", "train"), ("g3", "validation"), ("g2", "test"), ("g1", "train")], "g string, split string")
    found = splits.collisions(rows, "g", "split", ("train", "validation", "test")).collect()
    assert [(r["g"], r["owner"], r["rows_elsewhere"]) for r in found] == [("g2", "train", 1)]
    with pytest.raises(ValueError):
        splits.assert_isolated(rows, "g", "split", ("train", "validation", "test"))


def test_unknown_rules_are_errors():
    with pytest.raises(ValueError):
        rules.AbstentionRules(rules=("other",))
    assert rules.effective_threshold(None, {"balanced": 0.69}, "f1") == 0.69


@pytest.mark.parametrize("few", [1 << 16, 0])
def test_joint_newton_steps_equal_single_fits(spark, few, monkeypatch):
    """Separable, skewed, tiny and one-class groups, and a null key, with the parameters broadcast or shuffled."""
    monkeypatch.setattr(calibration, "GROUPS", few)
    rng = np.random.default_rng(11)
    rows = [("big", int(y), float(np.clip(0.4 + 0.2 * y + rng.normal(0, 0.2), 0.001, 0.999))) for y in rng.integers(0, 2, 3000)]
    rows += [(None, int(y), float(rng.random())) for y in rng.integers(0, 2, 40)]
    rows += [("apart", y, 0.01 + 0.98 * y) for y in [0, 1] * 10] + [("two", 0, 0.3), ("two", 1, 0.6), ("one", 1, 0.5), ("none", 1, None)]
    df = spark.createDataFrame(rows, "g string, binary_label int, score double")
    found = {r["g"]: (r["scale"], r["bias"]) for r in calibration.fit_groups(df, ["g"]).collect()}
    assert set(found) == {"big", None, "apart", "two", "one"} and found.pop("one") == (None, None)
    for g, fit in found.items():
        one = calibration.fit_platt(df.where(F.col("g").eqNullSafe(F.lit(g))))
        assert fit == pytest.approx((one.scale, one.bias), abs=1e-5), g


@pytest.mark.parametrize("name", ["family_metrics", "consistency_report", "confidence_reliability", "abstention_eval", "average_precision", "per_condition_metrics"])
def test_generated_methods_stay_small(spark, name):
    """The JVM never compiles a method over 8,000 bytes."""
    from plumbline import plans

    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # an adaptive plan shows no code before it runs
    try:
        found = plans.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().debug().codegenToSeq()
        assert found.size() and max(found.apply(k)._3().maxMethodCodeSize() for k in range(found.size())) < 8000
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
