"""Duplicates, conflicts, quarantine and shortcuts (C-01 to C-12, A-28, A-29, A-31, A-32, J-05).

A record is (path, split, label, group_id, hash). Groups of copies are summed per
(hash, label, split) before they meet, and no pair within a group is ever made.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

CONFOUND_LIMIT = 0.80


def content_hash(content: Column) -> Column:
    """C-01."""
    return F.sha2(content.cast("binary"), 256)


def groups(records: DataFrame, hash_: str = "hash") -> DataFrame:
    """A-32: per content: copies, distinct labels and splits. Partial aggregation takes hot contents."""
    return records.where(F.col(hash_).isNotNull()).groupBy(hash_).agg(
        F.count(F.lit(1)).alias("members"), F.array_sort(F.collect_set("label")).alias("labels"), F.array_sort(F.collect_set("split")).alias("splits"),
        F.min("group_id").alias("_g0"), F.max("group_id").alias("_g1"),
    ).withColumn("same_group", F.col("_g0") == F.col("_g1")).drop("_g0", "_g1")


def conflicts(records: DataFrame, first: str = "hash", second: str | None = None) -> DataFrame:
    """C-04, C-10: contents with more than one label; by the second hash unless its members are the first's.

    A group of the second hash that holds one first hash has the same members as that
    first hash's group, which is reported already."""
    out = groups(records, first).where(F.size("labels") > 1).withColumn("reason", F.lit(first)).withColumnRenamed(first, "content")
    if second is None:
        return out
    spread = records.groupBy(second).agg(F.min(first).alias("_a"), F.max(first).alias("_b")).where(F.col("_a") != F.col("_b")).select(second)
    more = groups(records, second).where(F.size("labels") > 1).join(spread, second, "left_semi")
    return out.unionByName(more.withColumn("reason", F.lit(second)).withColumnRenamed(second, "content"))


def cross_split(records: DataFrame, hash_: str = "hash") -> DataFrame:
    """C-05."""
    return groups(records, hash_).where(F.size("splits") > 1)


def quarantine(records: DataFrame, hash_: str = "hash") -> DataFrame:
    """C-09: every member of a conflict, both sides, with how many rows share its content."""
    bad = conflicts(records, hash_).select(F.col("content").alias(hash_), "members", "labels")
    return records.join(bad, hash_).select("path", "split", "label", "group_id", hash_, F.lit("label_conflict").alias("reason"), (F.col("members") - 1).alias("shared_with"))


def keep(records: DataFrame, quarantined: DataFrame, on: str = "path") -> DataFrame:
    """P-08, J-04."""
    return records.join(quarantined.select(on).distinct(), on, "left_anti")


def sign_bits(vector: Column, size: int) -> Column:
    """C-03 for vectors: 64 sign bits as a BIGINT, first element highest."""
    bits = [F.shiftleft(F.when(F.get(vector, k) > 0, F.lit(1).cast("long")).otherwise(F.lit(0).cast("long")), size - 1 - k) for k in range(size)]
    out = bits[0]
    for b in bits[1:]:
        out = out.bitwiseOR(b)
    return out


def near_pairs(left: DataFrame, right: DataFrame, distance: int, bits: int = 64) -> DataFrame:
    """J-05, C-06: pairs of different contents within a Hamming distance, by the pigeonhole principle.

    left, right: (id, h). ``distance + 1`` bands: a close pair agrees on one of them, so
    banding loses nothing. Rows are reduced to distinct h first, so copies cost one row;
    the first agreeing band alone emits a pair, so nothing is de-duplicated afterwards.
    """
    bands = distance + 1
    edges = [bits * k // bands for k in range(bands + 1)]

    def pieces(h):
        return [F.shiftrightunsigned(F.shiftleft(h, 64 - edges[k + 1]), 64 - (edges[k + 1] - edges[k])) for k in range(bands)]

    def banded(df, name):
        parts = F.array(*[F.struct(F.lit(k).alias("band"), v.alias("piece")) for k, v in enumerate(pieces(F.col("h")))])
        return df.select("h").distinct().select(F.col("h").alias(name), F.inline(parts))

    pairs = banded(left, "h1").join(banded(right, "h2"), ["band", "piece"])
    apart = F.bit_count(F.col("h1").bitwiseXOR(F.col("h2")))
    same = F.array(*[(a == b) for a, b in zip(pieces(F.col("h1")), pieces(F.col("h2")), strict=True)])
    first = F.array_position(same, True) - 1 == F.col("band")
    return pairs.where((apart <= distance) & (F.col("h1") != F.col("h2")) & first).select("h1", "h2", apart.cast("int").alias("distance"))


def near_members(records: DataFrame) -> DataFrame:
    """C-06: records(id, content, h, ..) → id, content_id, class_id: the smallest id with that content, and with that fingerprint."""
    contents = records.groupBy("h", "content").agg(F.min("id").alias("content_id"))
    classes = records.groupBy("h").agg(F.min("id").alias("class_id"))
    return records.select("id", "h", "content").join(contents, ["h", "content"]).join(classes, "h").select("id", "content_id", "class_id")


def near_report(records: DataFrame, distance: int, train: str = "train") -> DataFrame:
    """C-06: pairs of class representatives within a Hamming distance: id1, id2, distance,
    cross_split (training rows on one side and others on the other), labels_differ.

    records: (id, content, h, split, label). Classes are fingerprints; distance 0 ties every
    other content of a class to its first one. ``near_members`` has who belongs to what."""
    about = [F.bool_or(F.col("split") == train).alias("t"), F.bool_or(F.col("split") != train).alias("o"), F.min("label").alias("lo"), F.max("label").alias("hi")]
    contents = records.groupBy("h", "content").agg(F.min("id").alias("id"), *about)
    classes = contents.groupBy("h").agg(
        F.min("id").alias("id"), F.bool_or("t").alias("t"), F.bool_or("o").alias("o"), F.min("lo").alias("lo"), F.max("hi").alias("hi"),
        F.min_by(F.struct("t", "o", "lo", "hi"), "id").alias("first"),
    )
    side = lambda k: classes.select(F.col("h").alias(f"h{k}"), F.struct("id", "t", "o", "lo", "hi").alias(f"c{k}"))
    pairs = near_pairs(classes, classes, distance).where("h1 < h2").join(side(1), "h1").join(side(2), "h2")
    head = classes.select("h", F.struct("id", "first.t", "first.o", "first.lo", "first.hi").alias("c1"))
    zero = contents.join(head, "h").where(F.col("id") != F.col("c1.id")).select("c1", F.struct("id", "t", "o", "lo", "hi").alias("c2"), F.lit(0).alias("distance"))
    both = pairs.select("c1", "c2", "distance").union(zero)
    cross = (F.col("c1.t") & F.col("c2.o")) | (F.col("c1.o") & F.col("c2.t"))
    same = (F.col("c1.lo") == F.col("c1.hi")) & (F.col("c2.lo") == F.col("c2.hi")) & (F.col("c1.lo") == F.col("c2.lo"))
    ids = F.least("c1.id", "c2.id").alias("id1"), F.greatest("c1.id", "c2.id").alias("id2")
    return both.select(*ids, "distance", cross.alias("cross_split"), (~same).alias("labels_differ"))


def bucketed(x: Column, edges: Sequence[float]) -> Column:
    """C-11: `<=edge` labels, upper bounds inclusive."""
    out = F.when(x.isNull(), F.lit(None).cast("string"))
    for e in edges:
        out = out.when(x <= e, f"<={e:g}")
    return out.otherwise(f">{edges[-1]:g}")


# Edges of the container attributes
MEGAPIXEL_EDGES = (0.25, 1.0, 4.0, 12.0)
ASPECT_EDGES = (0.8, 1.0, 1.34, 1.78)
BYTES_PER_PIXEL_EDGES = (0.05, 0.15, 0.5, 1.5)


def container_attributes(width: Column, height: Column, size: Column) -> dict[str, Column]:
    """C-11."""
    pixels = (width * height).cast("double")
    return {
        "resolution": F.concat_ws("x", width, height),
        "megapixels": bucketed(pixels / 1e6, MEGAPIXEL_EDGES),
        "aspect_ratio": bucketed(F.try_divide(width.cast("double"), height.cast("double")), ASPECT_EDGES),
        "bytes_per_pixel": bucketed(F.try_divide(size.cast("double"), pixels), BYTES_PER_PIXEL_EDGES),
    }


def confounds(rows: DataFrame, attributes: Sequence[str], label: str = "label") -> DataFrame:
    """A-28, C-12: how well each attribute alone separates the classes; values are counted per task first."""
    long = rows.unpivot([label], [F.col(a).cast("string").alias(a) for a in attributes], "attribute", "value")
    values = long.groupBy("attribute", "value").agg(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) != 1).alias("n"))
    out = values.groupBy("attribute").agg(
        F.count(F.lit(1)).alias("values"), (F.sum(F.greatest("p", "n")).cast("double") / F.sum(F.col("p") + F.col("n"))).alias("separation")
    )
    return out.withColumn("flagged", F.col("separation") >= CONFOUND_LIMIT)


def name_tokens(path: Column) -> Column:
    """A-29: tokens of a lower-case stem without empty and all-digit ones."""
    stem = F.regexp_replace(F.lower(F.element_at(F.split(path, "/"), -1)), r"\.[^.]*$", "")
    return F.filter(F.split(F.replace(stem, F.lit("-"), F.lit("_")), "_"), lambda t: (t != "") & ~t.rlike(r"^\d+$"))


def exclusive_tokens(rows: DataFrame, path: str, label: str, shown: int = 10) -> DataFrame:
    """A-29, U-02: tokens that one class alone has; flagged if both have some. The list of ten is the report."""
    tokens = rows.select(label, F.explode(F.array_distinct(name_tokens(F.col(path)))).alias("token"))
    owned = tokens.groupBy("token").agg(F.min(label).alias("a"), F.max(label).alias("b")).where("a = b")
    place = F.row_number().over(W.partitionBy("a").orderBy("token"))
    top = owned.withColumn("r", place).where(F.col("r") <= shown).groupBy("a").agg(F.array_join(F.array_sort(F.collect_list("token")), ",").alias("tokens"))
    sizes = owned.groupBy("a").agg(F.count(F.lit(1)).alias("count"))
    every = sizes.agg(F.count(F.lit(1)).alias("m"))
    return sizes.join(top, "a").join(F.broadcast(every)).select(F.col("a").alias("label"), "count", "tokens", (F.col("m") > 1).alias("flagged"))


def format_counts(rows: DataFrame, label: str, ext: Column) -> DataFrame:
    """A-31."""
    return rows.groupBy(label, ext.alias("extension")).agg(F.count(F.lit(1)).alias("count"))


def pair_loss(rows: DataFrame, group: str, value: str, kind: str = "mse", same: str | None = None) -> DataFrame:
    """J-06, R-19: mean loss over all pairs i < j of each group, or of its rows that agree on ``same``.

    The squared loss follows from sums, so no pair is made: sum over pairs of (a-b)^2 is
    n * sum(x^2) - sum(x)^2. The symmetric KL of Bernoullis, (a-b) * (logit a - logit b), is
    n * sum(x * l) - sum(x) * sum(l) in the same way. Centred sums keep the digits."""
    x = F.col(value)
    if kind == "mse":
        a, b = x, x
    else:
        a = F.least(F.greatest(x, F.lit(1e-6)), F.lit(1 - 1e-6))
        b = F.ln(a / (1.0 - a))
    n = F.count(x)
    keys = [group] if same is None else [group, same]
    out = rows.groupBy(*keys).agg(n.alias("count"), F.covar_pop(a, b).alias("_c")).where(F.col("count") > 1)
    # n * sum(ab) - sum(a) sum(b) = n^2 * covar_pop
    pairs = F.col("count").cast("double") * (F.col("count") - 1) / 2.0
    return out.select(*keys, "count", (F.col("count").cast("double") * F.col("count") * F.col("_c") / pairs * F.lit(1.0 if kind == "mse" else 0.5)).alias("loss"))
