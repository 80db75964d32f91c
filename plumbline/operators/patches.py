"""Scoring of patches within a budget (E-09, with E-05 to E-07, R-16, T-04).

``scan`` gives one relation of scored boxes for any mode:

* ``off`` has none; ``coarse`` and ``full`` are one pass over a sparse or a dense grid;
* ``uncertain_only`` makes such a pass for items whose whole score is undecided;
* ``top_k`` scores the sparse grid, takes the k highest boxes of each item, divides them and
  scores the parts, first those of the highest box, while the item has budget left.

A box that covers the whole image has the item's whole score, and a box whose score is
already known (``known``) keeps it: neither is sent to the scorer. Items with a single box
are skipped unless it is to be divided. An item has at most ``most`` boxes, so its arrays
are small; items never meet each other, and the only shuffles are by item.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rules import let
from . import geometry

MODES = ("off", "coarse", "full", "top_k", "uncertain_only")
BOX = ("x", "y", "w", "h")


@dataclass(frozen=True)
class Settings:
    """Limits of a scan; an invalid one is an error."""

    mode: str = "full"
    base: str = "full"  # what ``uncertain_only`` does for an undecided item
    band: tuple[float, float] = (0.2, 0.8)
    size: int = 256
    stride: int = 192
    least: int = 64
    most: int = 24
    coarse: int = 12
    factor: int = 2
    k: int = 3

    def __post_init__(self):
        if self.mode not in MODES or self.base not in ("coarse", "full", "top_k"):
            raise ValueError(f"unknown patch mode {self.mode!r} or {self.base!r}")
        if min(self.size, self.stride, self.least, self.most, self.coarse, self.factor, self.k) < 1:
            raise ValueError("patch settings must be positive")
        if not 0.0 <= self.band[0] <= self.band[1] <= 1.0:
            raise ValueError("the band must be ascending within 0 and 1")


def _grid(images: DataFrame, s: Settings, dense: bool) -> DataFrame:
    """id, place, box, width, height, whole of items, and ``_n``, how many boxes the item has."""
    stride, most = (s.stride, s.most) if dense else (max(s.stride, s.size), s.coarse)
    rows = geometry.grids(images.where("id is not null"), s.size, stride, s.least, most, ("width", "height", "whole"))
    boxes = F.transform("boxes", lambda b: b.withField("_n", F.size("boxes")))
    return geometry.opened(rows, ["id", "width", "height", "whole"], boxes).select("id", "place", *BOX, "width", "height", "whole", "_n")


def _scored(boxes: DataFrame, scorer: Callable[[DataFrame], DataFrame], known: DataFrame | None) -> DataFrame:
    """boxes with score and ``origin``: whole, known or model. What is known of a box is in its ``_known``, if there is one, or in ``known``."""
    names = [c for c in boxes.columns if c != "_known"]
    covers = (F.col("x") == 0) & (F.col("y") == 0) & (F.col("w") == F.col("width")) & (F.col("h") == F.col("height")) & F.col("whole").isNotNull()
    rows = boxes if "_known" in boxes.columns else boxes.withColumn("_known", F.lit(None).cast("double"))
    if known is not None:
        cache = known.select("id", *BOX, F.col("score").alias("_cached")).dropDuplicates(["id", *BOX])
        rows = rows.join(cache.hint("merge"), ["id", *BOX], "left").withColumn("_known", F.coalesce("_known", "_cached"))
    score = F.when(covers, F.col("whole")).otherwise(F.col("_known"))
    rows = rows.withColumn("_score", score).withColumn("_origin", F.when(covers, "whole").when(F.col("_known").isNotNull(), "known").otherwise("model"))
    rows = rows.select(*names, "_score", "_origin")
    # two plain branches, so that a scorer in Python sees only what it has to score
    done = rows.where("_origin <> 'model'").select(*names, F.col("_score").alias("score"), F.col("_origin").alias("origin"))
    new = scorer(rows.where("_origin = 'model'").drop("_score", "_origin"))
    return done.unionByName(new.select(*names, "score", F.lit("model").alias("origin")))


def _parts(scored: DataFrame, s: Settings, tasks: int) -> DataFrame:
    """The parts of the k highest boxes of each item, each once, as far as the budget goes, with the score of an equal box as ``_known``."""
    best = F.struct((-F.col("score")).alias("s"), "place", *BOX)
    items = geometry.dealt(scored, tasks).groupBy("id", "width", "height", "whole").agg(F.sort_array(F.collect_list(best)).alias("b"))
    steps = [(i, j) for j in range(s.factor) for i in range(s.factor)]

    def divided(b: Column) -> Column:
        pw, ph = F.floor(b["w"] / s.factor).cast("int"), F.floor(b["h"] / s.factor).cast("int")
        part = lambda i, j: F.struct(
            F.least(b["x"] + i * pw, F.col("width") - pw).alias("x"), F.least(b["y"] + j * ph, F.col("height") - ph).alias("y"), pw.alias("w"), ph.alias("h")
        )
        return F.when(F.least(pw, ph) >= s.least, F.array(*[part(i, j) for i, j in steps])).otherwise(F.array().cast("array<struct<x:int,y:int,w:int,h:int>>"))

    each = F.array_distinct(F.flatten(F.transform(F.slice("b", 1, s.k), divided)))
    budget = F.greatest(F.lit(s.most) - F.size("b"), F.lit(0))
    rows = items.select("id", "width", "height", "whole", "b", F.slice(each, F.lit(1), budget).alias("parts"))
    same = lambda b, p: (b["x"] == p["x"]) & (b["y"] == p["y"]) & (b["w"] == p["w"]) & (b["h"] == p["h"])
    known = lambda p: -F.get(F.filter("b", lambda b: same(b, p)), F.lit(0))["s"]
    rows = rows.withColumn("parts", F.transform("parts", lambda p, k: F.struct((F.size("b") + k).alias("place"), *[p[c].alias(c) for c in BOX], known(p).alias("_known"))))
    return geometry.opened(rows, ["id", "width", "height", "whole"], "parts").select("id", "place", *BOX, "width", "height", "whole", "_known")


def scan(images: DataFrame, scorer: Callable[[DataFrame], DataFrame], settings: Settings, known: DataFrame | None = None) -> DataFrame:
    """id, place, x, y, w, h, score, pass, origin of every box that images(id, width, height, whole) get.

    ``scorer`` adds a column score to boxes (with id, x, y, w, h); it is called for boxes that
    nothing is known of. ``known`` has id, x, y, w, h, score. Scores are kept within 0 and 1."""
    s = settings
    images = images.select("id", F.col("width").cast("int").alias("width"), F.col("height").cast("int").alias("height"), "whole")
    mode = s.mode
    if mode == "uncertain_only":
        images, mode = images.where(F.col("whole").isNull() | F.col("whole").between(*s.band)), s.base
    if mode == "off":
        images = images.limit(0)
    boxes = _grid(images, s, mode == "full")
    if mode != "top_k":
        boxes = boxes.where("_n > 1")
    first = _scored(boxes.drop("_n"), scorer, known).withColumn("pass", F.lit(1))
    out = first
    if mode == "top_k" and s.factor > 1:
        # what the first pass has scored is known to the second
        second = _scored(_parts(first, s, geometry.tasks(images)), scorer, known)
        out = first.unionByName(second.withColumn("pass", F.lit(2)))
    return out.select("id", "place", *BOX, F.least(F.greatest("score", F.lit(0.0)), F.lit(1.0)).alias("score"), "pass", "origin")


def covered(boxes: Column) -> Column:
    """Pixels that at least one of an item's boxes (an array of structs with x, y, w, h) covers.

    The left and right edges of the boxes cut the image into strips; a strip's boxes are
    gone through from the top, and each adds what reaches below those before it."""
    spans = F.array_sort(F.transform(boxes, lambda b: F.struct(b["y"].alias("y"), (b["y"] + b["h"]).alias("t"), b["x"].alias("x"), (b["x"] + b["w"]).alias("r"))))
    edges = lambda o: F.array_sort(F.array_distinct(F.flatten(F.transform(o, lambda b: F.array(b["x"], b["r"])))))
    below = lambda a, b: F.greatest(b["t"] - F.greatest(a["end"], b["y"]), F.lit(0))
    step = lambda a, b: F.struct(F.greatest(a["end"], b["t"]).alias("end"), (a["n"] + below(a, b)).alias("n"))
    none = F.struct(F.lit(-(1 << 31)).cast("int").alias("end"), F.lit(0).cast("long").alias("n"))
    down = lambda o, at: F.aggregate(F.filter(o, lambda b: (b["x"] <= at) & (at < b["r"])), none, step, lambda a: a["n"])
    strips = lambda o, e: F.transform(F.slice(e, F.lit(1), F.size(e) - 1), lambda v, k: (F.get(e, k + 1) - v).cast("long") * down(o, v))
    total = lambda o: F.aggregate(let(edges(o), lambda e: strips(o, e)), F.lit(0).cast("long"), lambda a, v: a + v)
    return F.when(F.size(boxes) > 0, let(spans, total)).otherwise(F.lit(0).cast("long"))


def summary(images: DataFrame, boxes: DataFrame, threshold: float, k: int = Settings.k) -> DataFrame:
    """One row per image: available, boxes, passes, reused, evidence (mean of the k highest), agreement with the whole score's side, coverage."""
    box = F.struct("score", *BOX)
    tasks = geometry.tasks(images)
    own = geometry.dealt(boxes, tasks).groupBy("id").agg(
        F.collect_list(box).alias("b"), F.count_if(F.col("origin") == "model").alias("passes"), F.count_if(F.col("origin") != "model").alias("reused"),
        F.avg("score").alias("_mean"), F.count_if(F.col("score") >= threshold).alias("_yes"),
    )
    rows = geometry.dealt(images.select("id", "width", "height", "whole"), tasks).join(own.hint("merge"), "id", "left")
    top = F.slice(F.sort_array(F.transform("b", lambda x: x["score"]), False), 1, k)
    evidence = F.aggregate(top, F.lit(0.0), lambda a, x: a + x) / F.size(top)
    side = F.coalesce("whole", "_mean") >= threshold
    share = F.when(side, F.col("_yes")).otherwise(F.size("b") - F.col("_yes")).cast("double") / F.size("b")
    some = F.col("b").isNotNull()
    zero = lambda c: F.coalesce(c, F.lit(0))
    return rows.select(
        "id", some.alias("available"), zero(F.when(some, F.size("b"))).alias("boxes"), zero("passes").alias("passes"), zero("reused").alias("reused"),
        F.when(some, evidence).alias("evidence"), F.when(some, share).alias("agreement"),
        F.when(some, covered(F.col("b")) / (F.col("width").cast("double") * F.col("height"))).alias("coverage"),
    )


def every_mode(images: DataFrame, scorer: Callable[[DataFrame], DataFrame], settings: Settings, threshold: float) -> DataFrame:
    """A-26: summary() of each mode, with the mode's name."""
    out = None
    for mode in MODES:
        one = replace(settings, mode=mode)
        rows = summary(images, scan(images, scorer, one), threshold, one.k).withColumn("mode", F.lit(mode))
        out = rows if out is None else out.unionByName(rows)
    return out
