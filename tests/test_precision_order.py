"""Average precision with the order of ties worked out once per item."""

from pyspark.sql import functions as F

from plumbline.operators import metrics


def test_order_by_item(spark):
    df = spark.range(400).select(F.concat(F.lit("i"), "id").alias("item"), (F.col("id") % 3 % 2).cast("int").alias("binary_label"), (F.col("id") % 7 / 8.0).alias("score"), F.lit("a").alias("k"))
    plain = metrics.average_precision(df, ["k"], "item").first()[1]
    given = df.withColumn("order", metrics.tie_order(F.col("item"))).drop("item")
    assert metrics.average_precision(given, ["k"], "item", order="order").first()[1] == plain
    rows = sorted(((-r["score"], r["order"], r["binary_label"]) for r in given.collect()))
    tp, total = 0, 0.0
    for rank, (_, _, y) in enumerate(rows, 1):
        tp += y
        total += y * tp / rank
    assert abs(plain - total / tp) < 1e-12
