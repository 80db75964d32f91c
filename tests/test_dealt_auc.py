"""AUC of scores that mostly differ, dealt to a counted number of tasks."""

import random

from plumbline.operators import metrics, radix


def test_running_sums_are_dealt(spark, monkeypatch):
    monkeypatch.setattr(radix, "TASK", 40)
    rng = random.Random(8)
    rows = [(rng.choice(["a", None]), int(rng.random() < 0.4), rng.choice([rng.random(), 0.5, None])) for _ in range(400)]
    df = spark.createDataFrame(rows, "k string, binary_label int, score double")
    parts = radix.tasks(df)
    assert parts == 11
    dealt = metrics.binary_metrics(df, ["k"], 0.3, parts=parts)
    key = lambda r: str(r["k"])
    assert sorted(dealt.collect(), key=key) == sorted(metrics.binary_metrics(df, ["k"], 0.3).collect(), key=key)
    # a number of tasks that AQE doesn't lower again, for both levels of digits
    plan = dealt._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count(", 11), REPARTITION_BY_NUM") == 2
