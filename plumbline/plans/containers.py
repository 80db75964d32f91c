"""Queries over the bytes of image files: headers, checks, confounds and fingerprints.

The tables hold no images, so files are built from ``part``: eight kinds of content with
sides that follow from the key and the size, some of them cut."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fingerprints
from ..functions.arrays import bound
from ..operators import audit
from ..sources import adapters, headers
from .evaluation import DIGITS, rounded
from .preparation import _edges

QUERIES: dict = {}
SQL: dict[str, str] = {}


def _add(query, sql: str | None = None):
    QUERIES[query.__name__] = query
    if sql:
        SQL[query.__name__] = sql


def _big(x, size: int) -> Column:
    x = F.lit(x) if isinstance(x, int) else x
    return F.lpad(F.hex(x.cast("long")), 2 * size, F.lit("0"))


def _little(x, size: int) -> Column:
    x = (F.lit(x) if isinstance(x, int) else x).cast("long")
    return F.concat(*[_big(F.pmod(F.shiftright(x, 8 * k), F.lit(256)), 1) for k in range(size)])


def file_bytes(key: Column, width: Column, height: Column, size: Column) -> Column:
    """A file whose kind follows from ``key``, with ``size`` bytes of data in it."""
    data = F.repeat(F.lit("5A"), size.cast("int"))
    ihdr = F.concat(F.lit("49484452"), _big(width, 4), _big(height, 4), F.lit("08"), F.when(key % 3 == 0, "00").when(key % 3 == 1, "02").otherwise("06"), F.lit("000000"))
    png = F.concat(
        F.lit("89504E470D0A1A0A0000000D"), ihdr, _big(F.crc32(F.unhex(ihdr)), 4), _big(size, 4), F.lit("49444154"), data, F.lit("00000000" + headers.IEND),
    )
    parts = F.when(key % 3 == 0, 1).when(key % 3 == 1, 3).otherwise(4)
    jpeg = F.concat(
        F.lit("FFD8FFE000104A46494600010100000100010000FFE1"), _big(size + 2, 2), data, F.lit("FFFFDB004300" + "10" * 64 + "FFC0"), _big(parts * 3 + 8, 2), F.lit("08"),
        _big(height, 2), _big(width, 2), _big(parts, 1), F.repeat(F.lit("012200"), parts), F.lit("FFDA0008010100003F001234FFD9"),
    )
    riff = lambda kind, body: F.concat(
        F.lit("52494646"), _little(F.length(body) / 2 + 12, 4), F.lit("57454250" + kind), _little(F.length(body) / 2, 4), body
    )
    lossy = riff("56503820", F.concat(F.lit("3001009D012A"), _little(width, 2), _little(height, 2), data))
    bits = (width.cast("long") - 1) + (height.cast("long") - 1) * (1 << 14) + (key % 2) * (1 << 28)
    lossless = riff("5650384C", F.concat(F.lit("2F"), _little(bits, 4), data))
    extended = riff("56503858", F.concat(_big((key % 2) * 16, 1), F.lit("000000"), _little(width - 1, 3), _little(height - 1, 3), data))
    gif = F.concat(F.lit("474946383961"), _little(width, 2), _little(height, 2), F.lit("800000"), data, F.lit("3B"))
    rows = F.when(key % 2 == 0, height.cast("long")).otherwise(-height.cast("long"))
    bmp = F.concat(
        F.lit("424D"), _little(size + 54, 4), F.lit("000000003600000028000000"), _little(width, 4), _little(rows, 4), F.lit("01001800" + "00" * 24), data,
    )
    kinds = [png, jpeg, lossy, lossless, extended, gif, bmp, F.concat(F.lit("00112233445566778899AABB"), data)]
    out = kinds[-1]
    for k, v in enumerate(kinds[:-1]):
        out = F.when(key % 8 == k, v).otherwise(out)
    return F.unhex(out)


def _files(spark, sf_dir) -> DataFrame:
    """id, path, label, content: every eleventh file lacks its last five bytes, every thirteenth all but 14, every 29th all."""
    key, size = F.col("p_partkey"), F.col("p_size") * 20
    length = lambda whole: F.when(key % 29 == 0, 0).when(key % 13 == 0, 14).when(key % 11 == 0, F.octet_length(whole) - 5).otherwise(F.octet_length(whole))
    content = bound(file_bytes(key, 20 + key % 900, 10 + F.col("p_size") * 17, size), lambda whole: F.substring(whole, F.lit(1), length(whole)))
    kind = F.get(F.array(*[F.lit(x) for x in ("png", "jpg", "webp", "WEBP", "webp", "gif", "bmp", "png")]), (key % 8).cast("int"))
    return adapters.table(spark, sf_dir, "part").select(
        key.alias("id"), F.concat(F.lit("folder.x/"), key, F.lit("."), kind).alias("path"), (F.col("p_size") % 2).alias("label"), content.alias("content"),
    )


FILES = """f AS (SELECT p_partkey AS id, p_size % 2 AS label, p_partkey % 8 AS k, p_partkey % 29 = 0 AS none, p_partkey % 29 <> 0 AND p_partkey % 13 = 0 AS head,
    p_partkey % 29 <> 0 AND p_partkey % 13 <> 0 AND p_partkey % 11 = 0 AS cut, (20 + p_partkey % 900)::INT AS w, (10 + p_size * 17)::INT AS h,
    p_size * 20 + CASE p_partkey % 8 WHEN 0 THEN 57 WHEN 1 THEN 118 + CASE p_partkey % 3 WHEN 0 THEN 3 WHEN 1 THEN 9 ELSE 12 END WHEN 2 THEN 30 WHEN 3 THEN 25 WHEN 4 THEN 30 WHEN 5 THEN 14 WHEN 6 THEN 54 ELSE 12 END AS size,
    CASE WHEN p_partkey % 8 IN (0, 1) THEN ['L', 'RGB', 'RGBA'][1 + p_partkey % 3] WHEN p_partkey % 8 IN (3, 4) THEN ['RGB', 'RGBA'][1 + p_partkey % 2] ELSE ['', '', 'RGB', '', '', 'P', 'RGB', NULL][1 + p_partkey % 8] END AS m FROM part),
  hd AS (SELECT id, label, k, CASE WHEN none OR k = 7 THEN NULL ELSE ['PNG', 'JPEG', 'WEBP', 'WEBP', 'WEBP', 'GIF', 'BMP'][1 + k] END AS format,
    CASE WHEN NOT none AND k < 7 AND (NOT head OR k = 5) THEN w END AS width, CASE WHEN NOT none AND k < 7 AND (NOT head OR k = 5) THEN h END AS height,
    CASE WHEN NOT none AND (NOT head OR k = 5) THEN CASE WHEN k = 1 AND m = 'RGBA' THEN 'CMYK' ELSE m END END AS mode,
    CASE WHEN none THEN 'empty' WHEN k = 7 THEN 'format' WHEN head OR cut THEN 'truncated' END AS error,
    CASE WHEN none THEN 0 WHEN head THEN 14 WHEN cut THEN size - 5 ELSE size END AS bytes,
    ['png', 'jpg', 'webp', 'webp', 'webp', 'gif', 'bmp', 'png'][1 + k] AS extension FROM f)"""


def image_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S-03, S-02: what the headers say."""
    return _files(spark, sf_dir).select("id", F.inline(F.array(headers.header(F.col("content")))))


_add(image_headers, f"WITH {FILES} SELECT id, format, width, height, mode, error FROM hd")


def image_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P-10: the first failed check of every file."""
    return headers.inspected(_files(spark, sf_dir)).select("id", "bytes", "error")


_add(image_checks, f"""WITH {FILES} SELECT id, bytes::INT AS bytes, CASE WHEN extension NOT IN ('png', 'jpg', 'webp') THEN 'extension' WHEN error IN ('empty', 'format') THEN error
  WHEN error = 'truncated' THEN error WHEN least(width, height) < 32 THEN 'too_small' END AS error FROM hd""")


def container_confounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C-11, C-12, A-28: how far what the headers say gives the label away."""
    rows = headers.inspected(_files(spark, sf_dir)).where("width is not null and (error is null or error not in ('truncated', 'header'))")
    every = audit.container_attributes(F.col("width"), F.col("height"), F.col("bytes"))
    extension = F.lower(F.element_at(F.split("path", r"\."), -1)).alias("extension")
    rows = rows.select("label", extension, "format", "mode", *[c.alias(n) for n, c in every.items()])
    return rounded(audit.confounds(rows, HEADER_ATTRIBUTES), "separation")


HEADER_ATTRIBUTES = ("extension", "format", "mode", "resolution", "megapixels", "aspect_ratio", "bytes_per_pixel")
_add(container_confounds, f"""WITH {FILES}, a AS (SELECT label, extension, format, mode, width || 'x' || height AS resolution, {_edges('width::BIGINT * height / 1e6::DOUBLE', audit.MEGAPIXEL_EDGES)} AS megapixels,
    {_edges('width::DOUBLE / height', audit.ASPECT_EDGES)} AS aspect_ratio, {_edges('bytes::DOUBLE / (width::BIGINT * height)', audit.BYTES_PER_PIXEL_EDGES)} AS bytes_per_pixel
    FROM hd WHERE width IS NOT NULL AND (error IS NULL OR extension NOT IN ('png', 'jpg', 'webp'))),
  l AS (""" + " UNION ALL ".join(f"SELECT label, '{a}' AS attribute, {a} AS value FROM a" for a in HEADER_ATTRIBUTES) + f"""),
  v AS (SELECT attribute, value, count(*) FILTER (label = 1) AS p, count(*) FILTER (label = 0) AS n FROM l GROUP BY 1, 2)
  SELECT attribute, count(*) AS "values", round(sum(greatest(p, n))::DOUBLE / sum(p + n), {DIGITS}) AS separation, sum(greatest(p, n))::DOUBLE / sum(p + n) >= 0.8::DOUBLE AS flagged FROM v GROUP BY 1""")


WIDTH, HEIGHT = 16, 4


def _grey(spark, sf_dir) -> DataFrame:
    """Embeddings as 16 x 4 grey images, each with a copy of coarser brightness, as if saved again."""
    rows = adapters.table(spark, sf_dir, "embeddings")
    grey = F.transform("embedding", lambda v: F.least(F.greatest(F.floor(128 + 300 * v.cast("double") + 0.5), F.lit(0)), F.lit(255)).cast("int"))
    rows = rows.select("vec_id", "label", grey.alias("pixels")).withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1))))
    coarse = F.transform("pixels", lambda p: (F.floor(p / 4) * 4).cast("int"))
    return rows.select((F.col("vec_id") * 2 + F.col("copy")).alias("id"), "label", "copy", F.when(F.col("copy") == 1, coarse).otherwise(F.col("pixels")).alias("pixels"))


def difference_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C-03."""
    return _grey(spark, sf_dir).select("id", fingerprints.difference_hash(F.col("pixels"), WIDTH, HEIGHT).alias("h"))


def near_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C-03, C-06, J-05: originals are for training, copies for testing; hashes within three bits."""
    rows = _grey(spark, sf_dir)
    split = F.when(F.col("copy") == 0, "train").otherwise("test")
    rows = rows.select("id", F.col("pixels").alias("content"), fingerprints.difference_hash(F.col("pixels"), WIDTH, HEIGHT).alias("h"), split.alias("split"), "label")
    return audit.near_report(rows, 3)


def _dot_sql(name: str, at, plan) -> str:
    sums = " + ".join(f"{name}[{at(first + j) + 1}]::BIGINT * {w}" for first, ws in [plan] for j, w in enumerate(ws))
    return f"least(greatest(({sums} + {1 << (fingerprints.BITS - 1)}) >> {fingerprints.BITS}, 0), 255)"


_columns = fingerprints.weights(WIDTH, fingerprints.WIDE)
_rows = fingerprints.weights(HEIGHT, fingerprints.HIGH)
_narrow = ", ".join(_dot_sql("px", lambda c, r=r: r * WIDTH + c, plan) for r in range(HEIGHT) for plan in _columns)
_small = ", ".join(_dot_sql("nw", lambda r, c=c: r * fingerprints.WIDE + c, plan) for plan in _rows for c in range(fingerprints.WIDE))
_bits = " || ".join(
    f"(sm[{r * fingerprints.WIDE + c + 2}] > sm[{r * fingerprints.WIDE + c + 1}])::INT" for r in range(fingerprints.HIGH) for c in range(fingerprints.WIDE - 1)
)
GREY = f"""g AS (SELECT vec_id, label, list_transform(embedding, lambda v: least(greatest(floor(128 + 300 * v::DOUBLE + 0.5::DOUBLE), 0), 255)::INT) AS px FROM embeddings),
  im AS (SELECT vec_id * 2 AS id, label, 0 AS copy, px FROM g UNION ALL SELECT vec_id * 2 + 1, label, 1, list_transform(px, lambda p: p // 4 * 4) FROM g),
  nr AS (SELECT *, [{_narrow}] AS nw FROM im), sl AS (SELECT *, [{_small}] AS sm FROM nr), dh AS (SELECT id, label, copy, px, {_bits} AS b FROM sl)"""
_add(difference_hashes, f"""WITH {GREY}, u AS (SELECT id, list_reduce(list_prepend(0::HUGEINT, list_transform(string_split(b, ''), lambda x: x::HUGEINT)), lambda s, x: s * 2 + x) AS u FROM dh)
  SELECT id, (CASE WHEN u >= 9223372036854775808::HUGEINT THEN u - 18446744073709551616::HUGEINT ELSE u END)::BIGINT AS h FROM u""")
_add(near_images, f"""WITH {GREY}, e AS (SELECT id, px AS content, label, CASE copy WHEN 0 THEN 'train' ELSE 'test' END AS split, b AS h FROM dh),
  k AS (SELECT h, content, min(id) AS id, bool_or(split = 'train') AS t, bool_or(split <> 'train') AS o, min(label) AS lo, max(label) AS hi FROM e GROUP BY 1, 2),
  c AS (SELECT h, min(id) AS id, bool_or(t) AS t, bool_or(o) AS o, min(lo) AS lo, max(hi) AS hi FROM k GROUP BY 1),
  p AS (SELECT a.id AS i, b.id AS j, hamming(a.h, b.h) AS distance, (a.t AND b.o) OR (a.o AND b.t) AS cross_split, NOT (a.lo = a.hi AND b.lo = b.hi AND a.lo = b.lo) AS labels_differ
    FROM c a JOIN c b ON a.h < b.h WHERE hamming(a.h, b.h) <= 3
    UNION ALL SELECT f.id, k.id, 0, (f.t AND k.o) OR (f.o AND k.t), NOT (f.lo = f.hi AND k.lo = k.hi AND f.lo = k.lo) FROM k JOIN c USING (h) JOIN k f ON f.id = c.id WHERE k.id <> c.id)
  SELECT least(i, j) AS id1, greatest(i, j) AS id2, distance::INT AS distance, cross_split, labels_differ FROM p""")
