"""Patch boxes, tiles, refinement and coverage (E-05 to E-09, T-09): built-in array functions only.

The boxes of an item stay in one array of its row (``grids``), and what is made of them is
made there: items never meet each other, so nothing is grouped, and a task holds one row.
Items are dealt to tasks by their number, as a small file of them makes many boxes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: items of one task, about
ITEMS = 1 << 13


def tasks(items: DataFrame) -> int:
    """How many tasks the items are dealt to; a table's rows are counted from its footers."""
    return 1 + items.count() // ITEMS


def dealt(rows: DataFrame, parts: int) -> DataFrame:
    """rows, those of an id in one task; the number of tasks is not for the planner to lower."""
    return rows.repartition(parts, "id")


def _least(a: Column, b) -> Column:
    return F.least(a, F.lit(b) if not isinstance(b, Column) else b)


def starts(length: Column, patch: Column, stride: Column) -> Column:
    """Start positions along one side, the last one flush with the edge."""
    last = length - patch
    return F.array_union(F.sequence(F.lit(0), last, stride), F.array(last))


def subsample(n: Column, most: int) -> Column:
    """T-09: at most ``most`` indices of n, spread evenly (half to even)."""
    even = F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda i: F.bround(i * (n - 1) / F.lit(float(max(most - 1, 1))), 0).cast("int"))
    return F.when(n <= most, F.sequence(F.lit(0), n - 1)).otherwise(F.array_distinct(even))


def opened(rows: DataFrame, columns: list, boxes: Column | str) -> DataFrame:
    """columns and the fields of each box, one row each; a box has an x.

    By inline(), the planner would filter by the arrays' sizes below the shuffle, and work the boxes out twice."""
    return rows.select(*columns, F.inline_outer(boxes)).where("x is not null")


def grids(images: DataFrame, size: int = 256, stride: int = 192, least: int = 64, most: int = 12, carry: tuple[str, ...] = ()) -> DataFrame:
    """E-05: images(id, width, height) → id, carry, boxes (place, x, y, w, h); images with a side under ``least`` have no row."""
    side = _least(F.least("width", "height"), size)
    rows = dealt(images, tasks(images)).where(F.least("width", "height") >= least).withColumn("s", side.cast("int")).withColumn("d", F.least(F.lit(stride), F.col("s")))
    xs, ys = starts(F.col("width"), F.col("s"), F.col("d")), starts(F.col("height"), F.col("s"), F.col("d"))
    boxes = F.flatten(F.transform(ys, lambda y: F.transform(xs, lambda x: F.struct(x.alias("x"), y.alias("y")))))
    rows = rows.withColumn("boxes", boxes)
    chosen = F.transform(subsample(F.size("boxes"), most), lambda i: F.get("boxes", i))
    rows = rows.withColumn("boxes", chosen)
    box = lambda b, k: F.struct(k.alias("place"), b["x"].alias("x"), b["y"].alias("y"), F.col("s").alias("w"), F.col("s").alias("h"))
    return rows.select("id", *carry, F.transform("boxes", box).alias("boxes"))


def patch_grid(images: DataFrame, size: int = 256, stride: int = 192, least: int = 64, most: int = 12) -> DataFrame:
    """E-05: images(id, width, height) → id, place, x, y, w, h; images with a side under ``least`` have none."""
    return opened(grids(images, size, stride, least, most), ["id"], "boxes")


def with_scores(items: DataFrame, score: Callable[[Column], Column]) -> DataFrame:
    """items(id, boxes) whose boxes have a score that follows from the box."""
    return items.withColumn("boxes", F.transform("boxes", lambda b: b.withField("score", score(b))))


def exact_grid(images: DataFrame, grid: int = 4, least: int = 64) -> DataFrame:
    """E-06: grid × grid tiles, the rest of a side in its last tile; none if a tile would be under ``least``."""
    rows = images.withColumn("tw", F.floor(F.col("width") / grid).cast("int")).withColumn("th", F.floor(F.col("height") / grid).cast("int"))
    rows = rows.where((F.col("tw") >= least) & (F.col("th") >= least))
    steps = F.sequence(F.lit(0), F.lit(grid - 1))
    rows = rows.withColumn("j", F.explode(steps)).withColumn("i", F.explode(steps))
    last = lambda k, side, t: F.when(F.col(k) == grid - 1, F.col(side) - F.col(t) * (grid - 1)).otherwise(F.col(t))
    return rows.select(
        "id", (F.col("j") * grid + F.col("i")).alias("place"), (F.col("i") * F.col("tw")).alias("x"), (F.col("j") * F.col("th")).alias("y"),
        last("i", "width", "tw").alias("w"), last("j", "height", "th").alias("h"),
    )


def refine(items: DataFrame, factor: int = 2, least: int = 64) -> DataFrame:
    """E-07: items(id, boxes) → id, x, y, w, h: each box in factor × factor parts of at least ``least``; equal boxes of an item once (W-09)."""
    steps = [(i, j) for j in range(factor) for i in range(factor)]

    def divided(b: Column) -> Column:
        pw, ph = F.floor(b["w"] / factor).cast("int"), F.floor(b["h"] / factor).cast("int")
        parts = [F.struct((b["x"] + i * pw).alias("x"), (b["y"] + j * ph).alias("y"), pw.alias("w"), ph.alias("h")) for i, j in steps]
        return F.when(F.least(pw, ph) >= least, F.array(*parts)).otherwise(F.array().cast("array<struct<x:int,y:int,w:int,h:int>>"))

    return opened(items, ["id"], F.array_distinct(F.flatten(F.transform("boxes", divided))))


def heatmap(items: DataFrame, cell: int) -> DataFrame:
    """E-08: items(id, boxes), with scores → id, cx, cy, mean score and number of boxes of each covered cell.

    A box covers the cells whose upper left corner it covers. The cells of an item are
    told apart as one number each, and each looks up the item's boxes."""
    first = lambda a: F.ceil(a / cell).cast("int")
    spans = lambda b: F.struct(
        first(b["x"]).alias("x0"), (first(b["x"] + b["w"]) - 1).alias("x1"), first(b["y"]).alias("y0"), (first(b["y"] + b["h"]) - 1).alias("y1"), b["score"].alias("score")
    )
    some = lambda b: (b["x0"] <= b["x1"]) & (b["y0"] <= b["y1"])
    rows = items.select("id", F.filter(F.transform("boxes", spans), some).alias("boxes"))
    half, whole = 1 << 31, 1 << 32
    own = lambda b: F.flatten(F.transform(F.sequence(b["x0"], b["x1"]), lambda x: F.transform(F.sequence(b["y0"], b["y1"]), lambda y: x.cast("long") * whole + y)))
    rows = rows.withColumn("cells", F.array_distinct(F.flatten(F.transform("boxes", own))))
    place = lambda c: F.struct(F.shiftright(c + half, 32).cast("int").alias("cx"), (c - F.shiftright(c + half, 32) * whole).cast("int").alias("cy"))
    rows = rows.withColumn("cells", F.transform("cells", place))
    met = lambda c: F.filter("boxes", lambda b: (b["x0"] <= c["cx"]) & (c["cx"] <= b["x1"]) & (b["y0"] <= c["cy"]) & (c["cy"] <= b["y1"]))
    cells = F.transform("cells", lambda c: F.struct(c["cx"].alias("x"), c["cy"].alias("cy"), F.transform(met(c), lambda b: b["score"]).alias("s")))
    rows = opened(rows, ["id"], cells)
    total = F.aggregate("s", F.lit(0.0), lambda a, x: a + F.coalesce(x, F.lit(0.0)))
    known = F.size(F.filter("s", lambda x: x.isNotNull()))
    return rows.select("id", F.col("x").alias("cx"), "cy", F.try_divide(total, known.cast("double")).alias("score"), F.size("s").cast("long").alias("boxes"))


def patch_mode(mode: str, clean: Column, low: float = 0.2, high: float = 0.8) -> Column:
    """E-09: what a configured mode does for one item; ``uncertain_only`` patches inside the band."""
    if mode not in ("off", "coarse", "full", "top_k", "uncertain_only"):
        raise ValueError(f"unknown patch mode {mode!r}")
    if mode == "uncertain_only":
        return F.when((clean >= low) & (clean <= high), F.lit("coarse")).otherwise(F.lit("off"))
    return F.lit(mode)


def chosen_patches(items: DataFrame, k: int) -> DataFrame:
    """E-09, T-04: items(id, boxes), with scores → the k highest boxes of each item, by place on ties."""
    ranked = F.sort_array(F.transform("boxes", lambda b: F.struct(b["score"].alias("s"), (-b["place"]).alias("p"), b.alias("b"))), False)
    return opened(items, ["id"], F.transform(F.slice(ranked, 1, k), lambda x: x["b"]))
