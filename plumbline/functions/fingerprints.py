"""Perceptual fingerprints of grey images as array expressions (C-03).

The difference hash reduces an image to 9 x 8 pixels and keeps, for each row, whether a
pixel is brighter than its left neighbour. The reduction is bilinear with area support: a
triangle as wide as the reduction weights all pixels that fall under it, so that a large
image is averaged and not sampled. As in the usual 8-bit resizers, weights are whole
numbers of 22 bits, and values are rounded to 8 bits after the columns and after the rows.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .arrays import bound

WIDE, HIGH = 9, 8
BITS = 22


def weights(size: int, out: int) -> list[tuple[int, list[int]]]:
    """For each of ``out`` places: the first of ``size`` pixels under its triangle, and the weights of these."""
    step = size / out
    reach = max(step, 1.0)
    found = []
    for k in range(out):
        middle = (k + 0.5) * step
        first, last = max(int(middle - reach + 0.5), 0), min(int(middle + reach + 0.5), size)
        near = [max(0.0, 1.0 - abs(j + 0.5 - middle) / reach) for j in range(first, last)]
        found.append((first, [int(0.5 + w / sum(near) * (1 << BITS)) for w in near]))
    return found


def luma(red: Column, green: Column, blue: Column) -> Column:
    """Grey of 8-bit colours, in whole numbers of 16 bits."""
    return F.shiftright(red.cast("int") * 19595 + green.cast("int") * 38470 + blue.cast("int") * 7471 + 32768, 16)


def _dot(parts: list[tuple[Column, int]]) -> Column:
    total = F.lit(1 << (BITS - 1)).cast("long")
    for x, w in parts:
        total = total + x * w
    return F.least(F.greatest(F.shiftright(total, BITS), F.lit(0)), F.lit(255))


def _resized(values: Column, rows: int, columns: int, plan: list[tuple[int, list[int]]]) -> Column:
    """Weighted sums along each of the rows of an image."""
    one = lambda row: F.array(*[_dot([(F.get(row, first + j), w) for j, w in enumerate(ws)]) for first, ws in plan])
    starts = F.array(*[F.lit(k * columns + 1) for k in range(rows)])
    return F.flatten(F.transform(starts, lambda at: bound(F.slice(values, at, F.lit(columns)), one)))


def _turned(values: Column, rows: int, columns: int) -> Column:
    """Columns as rows."""
    return F.transform(F.array(*[F.lit(r * columns + c) for c in range(columns) for r in range(rows)]), lambda at: F.get(values, at))


def difference_hash(pixels: Column, width: int, height: int) -> Column:
    """64 bits as a BIGINT, first row and leftmost pair highest; null unless there are width x height known pixels.

    ``pixels`` has grey values from 0 to 255, row by row."""
    whole = F.transform(pixels, lambda v: v.cast("long"))
    left = F.array(*[F.lit(r * WIDE + c) for r in range(HIGH) for c in range(WIDE - 1)])
    h = bound(
        whole,
        lambda v: _resized(v, height, width, weights(width, WIDE)),
        lambda v: _turned(v, height, WIDE),
        lambda v: _resized(v, WIDE, height, weights(height, HIGH)),
        lambda v: _turned(v, WIDE, HIGH),
        lambda v: F.aggregate(left, F.lit(0).cast("long"), lambda h, k: F.shiftleft(h, 1).bitwiseOR((F.get(v, k + 1) > F.get(v, k)).cast("long"))),
    )
    known = (F.size(pixels) == width * height) & ~F.exists(pixels, lambda v: v.isNull())
    return F.when(known, h)
