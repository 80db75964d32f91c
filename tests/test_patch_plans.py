"""Patch queries at size: no join sends an item's boxes to the driver, and no task gathers those of many items."""

import random
import re

import pytest
from pyspark.sql import functions as F

from plumbline import plans
from plumbline.operators import geometry, patches

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["patch_scan", "patch_modes"])
def test_nothing_is_broadcast(spark, name):
    assert not re.search("Broadcast", plan(plans.queries()[name](spark, SF)))


@pytest.mark.parametrize("name", ["refine_boxes", "heatmap_coverage", "chosen_patches"])
def test_boxes_stay_in_their_item(spark, name):
    found = plan(plans.queries()[name](spark, SF))
    assert not re.search("Aggregate|Window|Join|Sort", found) and found.count("Exchange") == 1
    # what makes the boxes is above the shuffle that deals the items
    assert "transform(" not in found[found.index("Exchange") :]


def test_items_are_dealt_by_their_number(spark):
    images = spark.range(3 * geometry.ITEMS).select("id", F.lit(300).alias("width"), F.lit(200).alias("height"))
    assert geometry.grids(images).rdd.getNumPartitions() == 4


def test_heatmap_refine_chosen_against_loops(spark):
    rng = random.Random(4)
    some = lambda: [(k, rng.randrange(-300, 300), rng.randrange(-300, 300), rng.randrange(1, 300), rng.randrange(1, 300), rng.choice([None, 0.25, 0.5, 0.75])) for k in range(rng.randrange(6))]
    items = [(i, some()) for i in range(60)]
    df = spark.createDataFrame(items, "id long, boxes array<struct<place: int, x: int, y: int, w: int, h: int, score: double>>")
    cells, parts, chosen = {}, set(), set()
    for i, boxes in items:
        for _, x, y, w, h, score in boxes:
            for cx in range(-10, 20):
                for cy in range(-10, 20):
                    if x <= cx * 50 < x + w and y <= cy * 50 < y + h:
                        cells.setdefault((i, cx, cy), []).append(score)
            if min(w // 2, h // 2) >= 64:
                parts |= {(i, x + a * (w // 2), y + b * (h // 2), w // 2, h // 2) for a in (0, 1) for b in (0, 1)}
        chosen |= {(i, *b) for b in sorted(boxes, key=lambda b: (b[5] is None, -(b[5] or 0), b[0]))[:2]}
    mean = lambda s: sum(s) / len(s) if s else None
    want = {(*k, mean([x for x in s if x is not None]), len(s)) for k, s in cells.items()}
    assert want == {tuple(r) for r in geometry.heatmap(df, 50).collect()} and len(want) > 100
    rows = [tuple(r) for r in geometry.refine(df).collect()]
    assert len(rows) == len(set(rows)) and set(rows) == parts and parts
    assert {tuple(r) for r in geometry.chosen_patches(df, 2).collect()} == chosen


def test_covered_against_pixels(spark):
    rng = random.Random(5)
    items = [(i, [(rng.randrange(20), rng.randrange(20), rng.randrange(1, 12), rng.randrange(1, 12)) for _ in range(rng.randrange(7))]) for i in range(80)]
    df = spark.createDataFrame(items, "id long, b array<struct<x: int, y: int, w: int, h: int>>")
    found = {r[0]: r[1] for r in df.select("id", patches.covered(F.col("b"))).collect()}
    assert found == {i: len({(a, c) for x, y, w, h in b for a in range(x, x + w) for c in range(y, y + h)}) for i, b in items}
