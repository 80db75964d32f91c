"""Readers of labelled shards, image folders, score caches and logs (S-01 to S-12, P-06, P-10)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Folder names that tell a label, file extensions, limits of an image
NEGATIVE_FOLDERS = ("real", "authentic", "camera", "genuine", "0", "negative")
POSITIVE_FOLDERS = ("ai", "fake", "synthetic", "generated", "ai_generated", "full_synthetic", "tampered", "edited", "ai_edited", "1", "positive")
EXTENSIONS = ("jpg", "jpeg", "png", "webp")
MIN_SIDE, MAX_SIDE, MAX_PIXELS, MAX_BYTES = 32, 20_000, 50_000_000, 64 * 2**20


def shards(spark: SparkSession, folder: str, split: str | None = None) -> DataFrame:
    """S-01, S-02, S-03: all Parquet shards below a folder (of one split, if named), with shard and row number.

    Spark itself raises where no file matches."""
    pattern = f"{split}-*.parquet" if split else "*.parquet"
    rows = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).parquet(folder)
    return rows.select("*", F.col("_metadata.file_name").alias("shard"), F.col("_metadata.row_index").alias("row"))


def labelled(rows: DataFrame, known: tuple[int, ...] = (0, 1, 2), files: DataFrame | None = None) -> DataFrame:
    """S-02, S-04: img_id, content, format, label, shard, row; unknown labels and undecodable cells are left out.

    With files(path, content), a cell without bytes is read from its path there."""
    nested = dict(rows.dtypes)["image"].startswith("struct")
    rows = rows.withColumn("_content", F.col("image.bytes") if nested else F.col("image"))
    if nested and files is not None:
        there = files.select(F.col("path").alias("_path"), F.col("content").alias("_there"))
        rows = rows.withColumn("_path", F.when(F.col("_content").isNull(), F.col("image.path"))).join(there, "_path", "left")
        rows = rows.withColumn("_content", F.coalesce("_content", "_there"))
    out = rows.select(
        F.coalesce(F.col("img_id"), F.concat_ws(":", "shard", "row")).alias("img_id"), F.col("_content").alias("content"), image_format(F.col("_content")).alias("format"),
        "label", "shard", "row",
    )
    return out.where(F.col("label").isin(*known) & F.col("format").isNotNull())


def image_format(content: Column) -> Column:
    """S-03: by the first bytes; null if unknown."""
    head = F.hex(F.substring(content, 1, 12))
    return (
        F.when(head.startswith("FFD8FF"), "JPEG").when(head.startswith("89504E470D0A1A0A"), "PNG").when(head.startswith("424D"), "BMP")
        .when(head.startswith("52494646") & head.endswith("57454250"), "WEBP").when(head.startswith("47494638"), "GIF")
    )


def capped(rows: DataFrame, per_class: int | None = None, limit: int | None = None) -> DataFrame:
    """T-05, W-06: the first rows of each class in shard order, then a limit over all; tasks prune before the shuffle."""
    if per_class is not None:
        place = F.row_number().over(W.partitionBy("label").orderBy("shard", "row"))
        rows = rows.withColumn("_r", place).where(F.col("_r") <= per_class).drop("_r")
    return rows if limit is None else rows.orderBy("shard", "row").limit(limit)


def images(spark: SparkSession, folder: str, content: bool = False, ordered: bool = False) -> DataFrame:
    """S-06 to S-08: path, label by the folders below ``folder``, subgroup and size of image files; hidden ones are left out.
    Bytes are read, and rows sorted by path, only if asked."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    rows = rows.where(F.lower(F.element_at(F.split(name, r"\."), -1)).isin(*EXTENSIONS) & ~name.startswith("."))
    columns = ["path", F.col("length").alias("bytes"), folder_label(F.col("path"), folder).alias("label"), F.element_at(F.split("path", "/"), -2).alias("subgroup")]
    rows = rows.select(*columns, *(["content"] if content else []))
    return rows.orderBy("path") if ordered else rows


def below(path: Column, root: str) -> Column:
    """The folders between a root and a file, the nearest first; null if the file is elsewhere.

    Paths and root may have a scheme or not."""
    plain = lambda x: F.regexp_replace(x, "^[a-z][a-z0-9+.-]*:/*", "/")
    top = F.rtrim(plain(F.lit(root)), F.lit("/"))
    rest = F.substring(plain(path), F.length(top) + 2, F.length(path))
    folders = F.split(rest, "/")
    return F.when(F.startswith(plain(path), F.concat(top, F.lit("/"))), F.reverse(F.slice(folders, 1, F.size(folders) - 1)))


def folder_label(path: Column, root: str = "/") -> Column:
    """S-10: by the nearest folder below ``root`` with a known name; null without one."""
    near = F.get(F.filter(F.transform(below(path, root), F.lower), lambda f: f.isin(*NEGATIVE_FOLDERS, *POSITIVE_FOLDERS)), 0)
    return F.when(near.isin(*NEGATIVE_FOLDERS), 0).when(near.isin(*POSITIVE_FOLDERS), 1)


def image_error(bytes_: Column, extension: Column, format_: Column, width: Column, height: Column) -> Column:
    """P-10: the first failed check, null if all pass."""
    return (
        F.when(bytes_.isNull(), "missing").when(~F.lower(extension).isin(*EXTENSIONS), "extension").when(bytes_ == 0, "empty")
        .when(bytes_ > MAX_BYTES, "too_large").when(format_.isNull(), "format").when(F.least(width, height) < MIN_SIDE, "too_small")
        .when(F.greatest(width, height) > MAX_SIDE, "side").when(width.cast("long") * height > MAX_PIXELS, "pixels")
    )


def score_cache(spark: SparkSession, path: str, scores: str = "chain_scores", label: str = "binary_label") -> DataFrame:
    """S-11: a JSON document {"records": [...]} as item_id, binary_label, condition, score."""
    schema = f"records array<struct<img_id:string, {label}:int, {scores}:map<string,double>>>"
    rows = spark.read.schema(schema).option("multiLine", "true").json(path).select(F.inline("records"))
    return rows.select(F.col("img_id").alias("item_id"), F.col(label).alias("binary_label"), F.explode(scores).alias("condition", "score"))


def score_log(spark: SparkSession, path: str, schema: str, key: str = "image_path") -> DataFrame:
    """S-12: JSON lines; blank and broken ones are skipped, the last line of each key wins.

    Lines are ordered by file, by the place of their part in it, and inside the part."""
    lines = spark.read.text(path).select("value", "_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("line"))
    parsed = F.from_json("value", f"{schema}, _bad string", {"columnNameOfCorruptRecord": "_bad"})
    rows = lines.where(F.trim("value") != "").select(parsed.alias("r"), F.struct("file_path", "file_block_start", "line").alias("at"))
    rows = rows.where(F.col("r._bad").isNull() & F.col("r").getField(key).isNotNull())
    last = rows.groupBy(F.col("r").getField(key).alias("key")).agg(F.max_by("r", "at").alias("r"))
    return last.select(*[F.col("r").getField(c).alias(c) for c in rows.schema["r"].dataType.names if c != "_bad"])


def checked_cache(spark: SparkSession, path: str, expected: dict[str, str]) -> DataFrame:
    """S-20, Z-04: a Parquet table written by ``sinks.cache``; refused if its provenance differs."""
    rows = spark.read.parquet(path)
    found = spark.read.json(f"{path}-provenance").first().asDict()
    if found != expected:
        raise ValueError(f"the cache was made with {found}, not {expected}")
    return rows
