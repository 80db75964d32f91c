"""Finding labelled images in folders and assembling a training set (S-07 to S-09, P-06, J-12, C-13 to C-15).

Files are relations of paths; nothing is opened but for the first bytes that tell a
format. Masks and group maps are joined, so that their number doesn't matter.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources import readers
from . import audit, splits

# Labels of subgroups, their default folders, folders that are not part of a group, mask endings
SUBGROUPS = {"authentic": 0, "synthetic": 1, "minor_edit": 1, "moderate_edit": 1, "transformed": 1}
FOLDERS = {"authentic": "authentic", "minor_edit": "ai_edited", "synthetic": "synthetic", "moderate_edit": "moderate_edit", "transformed": "transformed"}
CLASS_FOLDERS = ("authentic", "ai_edited")
MASKS = ("png", "jpg", "jpeg", "webp")
ORDER = ("train", "validation", "test")


def _parts(path: Column, root: str) -> Column:
    """Folders and name of a file below root, from the top; null if it is elsewhere."""
    return F.concat(F.reverse(readers.below(path, root)), F.array(F.element_at(F.split(path, "/"), -1)))


def _stem(name: Column) -> Column:
    return F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")


def group_of(parts: Column) -> Column:
    """P-06: the folders without a leading class folder, or a flat file's stem without an edit suffix."""
    rest = F.when(F.get(parts, 0).isin(*CLASS_FOLDERS), F.slice(parts, 2, F.size(parts))).otherwise(parts)
    folders = F.slice(rest, 1, F.greatest(F.size(rest) - 1, F.lit(0)))
    return F.when(F.size(folders) > 0, F.array_join(folders, "/")).otherwise(F.regexp_replace(_stem(F.element_at(rest, -1)), splits.SUFFIX, ""))


def mask_keys(files: DataFrame, root: str) -> DataFrame:
    """(key, mask_path): the best mask of each stem; one of the same name before one named ``_mask``, endings in their order."""
    parts = _parts(F.col("path"), root)
    name = F.element_at(parts, -1)
    ending, stem = F.lower(F.element_at(F.split(name, r"\."), -1)), _stem(name)
    folder = F.array_join(F.slice(parts, 1, F.size(parts) - 1), "/")
    place = F.array_position(F.array(*[F.lit(m) for m in MASKS]), ending)
    own = F.struct(F.concat_ws("/", F.nullif(folder, F.lit("")), stem).alias("key"), place.alias("rank"))
    named = F.struct(F.concat_ws("/", F.nullif(folder, F.lit("")), F.regexp_replace(stem, "_mask$", "")).alias("key"), (place + len(MASKS)).alias("rank"))
    rows = files.where(parts.isNotNull() & (place > 0)).select("path", F.explode(F.when(stem.endswith("_mask"), F.array(own, named)).otherwise(F.array(own))).alias("k"))
    return rows.groupBy("k.key").agg(F.min_by("path", "k.rank").alias("mask_path"))


def discover(files: DataFrame, root: str, split: str, folders: dict[str, str] | None = None, masks: DataFrame | None = None,
             mask_root: str = "", group_map: DataFrame | None = None, prefix: str | None = None) -> DataFrame:
    """S-07, S-08: files(path, content) → image_path, label, split, group_id, mask_path, subgroup, readable.

    Files outside the subgroups' folders are left out; unreadable ones stay, marked, so that
    they can be counted. A group map(name, group) is looked up by relative path, then by file
    name (J-12). With a prefix, groups are ``prefix:group`` (S-08)."""
    chosen = FOLDERS | (folders or {})
    if unknown := sorted(set(chosen) - set(SUBGROUPS)):
        raise ValueError(f"unknown subgroups: {unknown}")
    if len(set(chosen.values())) < len(chosen):
        raise ValueError("a folder belongs to one subgroup only")
    named = F.create_map(*[F.lit(x) for name, folder in chosen.items() for x in (folder, name)])
    labels = F.create_map(*[F.lit(x) for name, label in SUBGROUPS.items() for x in (name, label)])
    parts = F.col("_parts")
    ending = F.lower(F.element_at(F.split(F.element_at(parts, -1), r"\."), -1))
    rows = files.withColumn("_parts", _parts(F.col("path"), root)).where((F.size("_parts") > 1) & ending.isin(*readers.EXTENSIONS))
    rows = rows.withColumn("subgroup", F.try_element_at(named, F.get("_parts", 0))).where(F.col("subgroup").isNotNull())
    rows = rows.select(
        F.col("path").alias("image_path"), F.try_element_at(labels, F.col("subgroup")).alias("label"), F.lit(split).alias("split"), group_of(parts).alias("group_id"),
        "subgroup", readers.image_format(F.col("content")).isNotNull().alias("readable"), F.array_join(parts, "/").alias("_key"), F.element_at(parts, -1).alias("_name"),
    )
    if group_map is not None:
        by = lambda k: group_map.select(F.col("name").alias(k), F.col("group").alias(f"{k}_group"))
        rows = rows.join(by("_key"), "_key", "left").join(by("_name"), "_name", "left")
        rows = rows.withColumn("group_id", F.coalesce("_key_group", "_name_group", "group_id"))
    if prefix is not None:
        rows = rows.withColumn("group_id", F.concat_ws(":", F.lit(prefix), "group_id"))
    if masks is None:
        rows = rows.withColumn("mask_path", F.lit(None).cast("string"))
    else:
        rows = rows.withColumn("key", _stem(F.col("_key"))).join(mask_keys(masks, f"{mask_root.rstrip('/')}/{split}"), "key", "left")
    return rows.select("image_path", "label", "split", "group_id", "mask_path", "subgroup", "readable")


def discover_all(files: DataFrame, root: str, order: Sequence[str] = ORDER, **options) -> DataFrame:
    """S-09, U-01: the readable records of all splits; an error if a group is in two of them."""
    records = None
    for split in order:
        one = discover(files, f"{root.rstrip('/')}/{split}", split, **options)
        records = one if records is None else records.unionByName(one)
    records = records.where("readable")
    splits.assert_isolated(records, "group_id", "split", order)
    return records


def summary(records: DataFrame) -> DataFrame:
    """S-07: per split: files, readable and corrupt ones, classes, groups and missing masks."""
    yes = F.col("readable")
    return records.groupBy("split").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(yes).alias("valid"), F.count_if(~yes).alias("corrupt"),
        F.count_if(yes & (F.col("label") == 0)).alias("authentic"), F.count_if(yes & (F.col("label") == 1)).alias("edited"),
        F.countDistinct(F.when(yes, F.col("group_id"))).alias("groups"), F.count_if(yes & F.col("mask_path").isNull()).alias("missing_masks"),
    )


def assemble(records: DataFrame, pool: DataFrame | None = None, fraction: float = 0.0, group_limit: int | None = None,
             seed: int = 1234, order: Sequence[str] = ORDER) -> DataFrame:
    """C-15: isolation check, quarantine, group limit per split, mixture into the first split, check again.

    records, pool: (path, label, split, group_id, hash). The pool gives as many rows, drawn by
    hash, as make up ``fraction`` of the mixed split (C-14); its groups get a prefix."""
    if not 0.0 <= fraction < 1.0:
        raise ValueError("the fraction is in [0, 1)")
    splits.assert_isolated(records, "group_id", "split", order)
    kept = audit.keep(records, audit.quarantine(records))
    if group_limit is not None:
        one = lambda s: splits.group_limit(kept.where(F.col("split") == s), "group_id", group_limit, seed)
        parts = [one(s) for s in order]
        kept = parts[0]
        for more in parts[1:]:
            kept = kept.unionByName(more)
    if pool is not None and fraction > 0:
        base = kept.where(F.col("split") == order[0]).count()
        wanted = round(base * fraction / (1.0 - fraction))  # half to even
        drawn = splits.hash_sample(pool, wanted, "path", seed, "synthetic-mixture")
        drawn = drawn.withColumns({"split": F.lit(order[0]), "group_id": F.concat_ws(":", F.lit("synthetic_mixture"), "group_id")})
        kept = kept.unionByName(drawn.select(*kept.columns))
    splits.assert_isolated(kept, "group_id", "split", order)
    return kept


def check_holdout(trained: Sequence[str], held_out: Sequence[str], available: Sequence[str]) -> None:
    """C-13: generators held out for the test must exist and must not be trained on; errors name them."""
    for names, what in ((set(trained) & set(held_out), "trained on and held out"), (set(held_out) - set(available), "held out but not there")):
        if names:
            raise ValueError(f"generators {what}: {sorted(names)}")
    if not held_out:
        raise ValueError("no generator is held out, so nothing is known about new ones")
