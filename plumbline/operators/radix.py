"""Running sums and quantiles of doubles without a task that holds a whole key (A-03, A-04, A-14, W-01, W-02).

A double is cut into digits that keep its order: sign, exponent and eleven bits of the
mantissa first (at most 2^22 values of a sign, some thousand in practice), then twenty
bits, then the rest (at most 2^21 values). Every window here runs inside one digit, so
its size is bounded whatever the data: no sample, no rounding, no range that one busy
value could fill.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

HIGH, MIDDLE = 11, 20  # bits of the first digit's mantissa, and of the second digit
DIGITS = ("_d1", "_d2")
TASK = 1 << 18  # rows of a task, about, where rows are dealt to a counted number of tasks


def digits(df: DataFrame, value: str) -> DataFrame:
    """df with _d1 and _d2 of a double; rows are ordered as by (value) by (_d1, _d2, value). Null stays null, NaN is the largest."""
    x = F.col(value)
    a = F.abs(x)
    finite = (a > 0) & (a < float("inf"))
    near = F.floor(F.log2(F.when(finite, a).otherwise(F.lit(1.0)))).cast("int")
    two = lambda e: F.pow(F.lit(2.0), e)  # noqa: E731  exact for whole numbers
    df = df.withColumn("_e", near).withColumn(
        "_e", F.when(finite & (a >= two(F.col("_e") + 1)), F.col("_e") + 1).when(finite & (a < two(F.col("_e"))), F.col("_e") - 1).otherwise(F.col("_e"))
    )
    # in [0, 1): every step below is exact, as powers of two only move the point
    df = df.withColumn("_m", F.when(finite, a / two(F.col("_e")) - 1.0).otherwise(F.lit(0.0)) * float(1 << HIGH))
    first = (F.col("_e").cast("long") + 1075) * (1 << HIGH) + F.floor("_m")
    second = F.floor((F.col("_m") - F.floor("_m")) * float(1 << MIDDLE))
    huge = F.lit((1024 + 1075) << HIGH).cast("long")
    sign = F.when(x < 0, F.lit(-1)).otherwise(F.lit(1)).cast("long")
    return df.withColumns({
        "_d1": F.when(F.isnan(x), huge + 1).when(a == float("inf"), huge * sign).when(x == 0, F.lit(0).cast("long")).otherwise(first * sign),
        "_d2": F.when(finite, second * sign).otherwise(F.lit(0).cast("long")),
    }).drop("_e", "_m")


def tasks(rows: DataFrame) -> int:
    """Tasks to deal rows to, for ``auc_fold``, if most of their scores differ; counts the rows."""
    return 1 + rows.count() // TASK


def _before(keys: Sequence[str], order: Column):
    return W.partitionBy(*(keys or [F.lit(1)])).orderBy(order).rowsBetween(W.unboundedPreceding, -1)


def auc_fold(hist: DataFrame, keys: Sequence[str], sums: Mapping[str, Column] = {}, parts: int | None = None) -> DataFrame:
    """keys, p, n, won and the given sums from hist(keys, score, p, n).

    ``won`` counts the pairs (positive, negative) in which the positive is higher, ties as
    half. It is added up digit by digit: inside a digit by running sums, and then with the
    negatives of the digits below. Counts become doubles before they are multiplied. With
    ``parts`` the running sums are dealt to that many tasks: left alone, AQE gives a task 64 MB of
    shuffled rows, which are packed so well that it sorts and adds up over a gigabyte."""
    keys = list(keys)
    deal = lambda df, by: df.repartition(parts, *by) if parts else df
    rows = deal(digits(hist, "score"), [*keys, *DIGITS])
    under = F.coalesce(F.sum("n").over(_before([*keys, *DIGITS], F.asc("score"))), F.lit(0))
    rows = rows.withColumn("_won", F.col("p").cast("double") * (under + F.col("n") / 2.0))
    total = [F.sum("p").alias("p"), F.sum("n").alias("n")]
    out = rows.groupBy(*keys, *DIGITS).agg(*total, F.sum("_won").alias("won"), *[c.alias(k) for k, c in sums.items()])
    for level in (1, 0):
        group = [*keys, *DIGITS[:level]]
        under = F.coalesce(F.sum("n").over(_before(group, F.asc(DIGITS[level]))), F.lit(0))
        out = deal(out, group) if level else out
        out = out.withColumn("won", F.col("won") + F.col("p").cast("double") * under)
        out = out.groupBy(*group).agg(*total, F.sum("won").alias("won"), *[F.sum(k).alias(k) for k in sums])
    return out


def same(keys: Sequence[str], left: str, right: str) -> Column:
    """Null-safe equality of the columns ``keys`` of two aliases."""
    out = F.lit(True)
    for k in keys:
        out = out & F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}"))
    return out


def running(hist: DataFrame, keys: Sequence[str], value: str, names: Sequence[str], descending: bool = False) -> DataFrame:
    """hist with before_<name>: the sum of a column over the rows of the key with a smaller (or larger) value.

    hist has one row per (keys, value)."""
    keys = list(keys)
    way = F.desc if descending else F.asc
    rows = digits(hist, value)
    levels = [rows]
    for level in (2, 1):
        levels.append(levels[-1].groupBy(*keys, *DIGITS[:level]).agg(*[F.sum(n).alias(n) for n in names]))
    order = [value, DIGITS[1], DIGITS[0]]
    out = None
    for level, df in zip((0, 1, 2), reversed(levels), strict=True):
        group = [*keys, *DIGITS[:level]]
        own = df.withColumns({f"before_{n}": F.coalesce(F.sum(n).over(_before(group, way(order[2 - level]))), F.lit(0)) for n in names})
        if out is not None:
            offsets = out.select(*group, *[F.col(f"before_{n}").alias(f"_o_{n}") for n in names])
            own = own.alias("a").join(offsets.alias("b"), same(group, "a", "b")).select(
                *[F.col(f"a.{c}") for c in df.columns], *[(F.col(f"a.before_{n}") + F.col(f"b._o_{n}")).alias(f"before_{n}") for n in names]
            )
        out = own
    return out.drop(*DIGITS)


def quantiles(df: DataFrame, keys: Sequence[str], value: str, shares: Mapping[str, float], weight: str | None = None) -> DataFrame:
    """keys and one column per share: exact quantiles of the non-null values, interpolated between neighbours.
    ``weight`` names a column with how often the row's value occurs, 0 for null (once without it).

    Selection in three counting passes: over first digits, over second digits inside those
    that hold a wanted rank, over values inside those. What a task holds is counts of digits;
    values are never gathered. A key without values has no row; without keys there is one row."""
    keys = list(keys)
    # a filter on the value would be moved below the aggregate that made the weights
    known, often = (F.col(weight) > 0, F.col(weight)) if weight else (F.col(value).isNotNull(), F.lit(1))
    rows = digits(df.where(known).select(*keys, F.col(value).cast("double").alias("_x"), often.cast("long").alias("_k")), "_x")
    wanted = F.array(*[F.struct(F.lit(f"{name}:{side}").alias("t"), F.lit(q).alias("q"), F.lit(side).alias("side")) for name, q in shares.items() for side in (0, 1)])
    found = None
    for level in (0, 1, 2):
        group = [*keys, *DIGITS[:level]]
        part = ["_d1", "_d2", "_x"][level]
        some = rows
        if found is not None:
            met = found.select(*group).distinct().alias("f")
            if weight:  # a semi join would be moved below the aggregate that made the weights, and that done anew for every pass
                some = rows.alias("r").join(met, same(group, "r", "f")).select("r.*")
            else:
                some = rows.alias("r").join(met, same(group, "r", "f"), "left_semi")
        counts = some.groupBy(*group, part).agg(F.sum("_k").alias("_c"))
        counts = counts.withColumn("_b", F.coalesce(F.sum("_c").over(_before(group, F.asc(part))), F.lit(0)))
        if found is None:
            counts = counts.withColumn("_n", F.sum("_c").over(W.partitionBy(*(keys or [F.lit(1)])))).withColumn("_w", F.explode(wanted))
            at = (F.col("_n") - 1) * F.col("_w.q")
            rank = F.floor(at) + F.when((F.col("_w.side") == 1) & (at > F.floor(at)), 1).otherwise(0)
            counts = counts.withColumns({"_t": F.col("_w.t"), "_rank": rank, "_part": at - F.floor(at)})
        else:
            counts = counts.alias("c").join(found.alias("f"), same(group, "c", "f")).select("c.*", "f._t", "f._rank", "f._part")
        met = counts.where((F.col("_b") <= F.col("_rank")) & (F.col("_rank") < F.col("_b") + F.col("_c")))
        found = met.select(*group, part, "_t", (F.col("_rank") - F.col("_b")).alias("_rank"), "_part")
    pick = lambda name, side: F.max(F.when(F.col("_t") == f"{name}:{side}", F.col("_x")))
    share = lambda name: F.max(F.when(F.col("_t") == f"{name}:0", F.col("_part")))
    return found.groupBy(*keys).agg(*[(pick(n, 0) + (pick(n, 1) - pick(n, 0)) * share(n)).alias(n) for n in shares])
