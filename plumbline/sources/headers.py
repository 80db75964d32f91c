"""What the headers of image files say (S-02, S-03, P-10, C-11): column expressions over their bytes.

``header`` gives format, width, height, mode and error of a file without decoding it. A
file is ``truncated`` if its header or its end is missing, ``header`` if the header is there
and contradicts itself (a check sum, a size of 0), and ``format`` if its first bytes belong
to none of the five formats. Sides and mode are null where they can't be read.

* PNG: the IHDR chunk with its check sum; the IEND chunk within the last ``TAIL`` bytes.
* JPEG: segments are walked up to the frame header, as application data of any length may
  come before it; the end mark within the last ``TAIL`` bytes.
* WEBP: lossy, lossless and extended; the length in the container header.
* GIF and BMP: the fixed header; the trailer, or the length that the header names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import bound
from .readers import image_error, image_format

# Marks of the formats, in hexadecimal
IEND = "0000000049454E44AE426082"
PNG_MODES = {0: "L", 2: "RGB", 3: "P", 4: "LA", 6: "RGBA"}
JPEG_MODES = {1: "L", 3: "RGB", 4: "CMYK"}
BMP_MODES = {1: "1", 4: "P", 8: "P", 16: "RGB", 24: "RGB", 32: "RGB"}
TAIL = 1024
SEGMENTS = 1024  # of a JPEG file that are looked at before its frame header


def number(content: Column, at: Column | int, size: int, little: bool = False) -> Column:
    """An unsigned number of up to seven bytes from position ``at`` (from 1) on; null if the content ends before."""
    at = F.lit(at) if isinstance(at, int) else at
    if little:
        parts = [number(content, at + k, 1) * (1 << (8 * k)) for k in range(size)]
        return sum(parts[1:], parts[0])
    found = F.substring(content, at, F.lit(size))
    return F.when(F.octet_length(found) == size, F.conv(F.hex(found), 16, 10).cast("long"))


def _named(key: Column, names: dict[int, str]) -> Column:
    out = F.lit(None).cast("string")
    for k, v in names.items():
        out = F.when(key == k, F.lit(v)).otherwise(out)
    return out


def _ends(content: Column, mark: str) -> Column:
    """Whether a mark is among the last bytes, at a whole byte."""
    return F.coalesce(F.hex(F.substring(content, -TAIL, TAIL)).rlike(f"^(?:..)*?{mark}"), F.lit(False))


def _found(width: Column, height: Column, mode: Column, sound: Column, complete: Column) -> Column:
    """Sides and mode, and what is wrong with them."""

    def judged(v: Column) -> Column:
        known = v["w"].isNotNull() & v["h"].isNotNull()
        error = (
            F.when(~known, "truncated").when(~F.coalesce(v["sound"], F.lit(False)) | (v["w"] <= 0) | (v["h"] <= 0), "header")
            .when(~F.coalesce(v["complete"], F.lit(False)), "truncated")
        )
        side = lambda c: F.when(known, v[c].cast("int"))
        return F.struct(side("w").alias("width"), side("h").alias("height"), F.when(known, v["mode"]).alias("mode"), error.alias("error"))

    return bound(F.struct(width.alias("w"), height.alias("h"), mode.alias("mode"), sound.alias("sound"), complete.alias("complete")), judged)


def _png(c: Column) -> Column:
    named = F.hex(F.substring(c, 13, 4)) == "49484452"
    depth, kind = number(c, 25, 1), number(c, 26, 1)
    mode = F.when((kind == 0) & (depth == 1), "1").when((kind == 0) & (depth == 16), "I;16").otherwise(_named(kind, PNG_MODES))
    sound = named & (F.crc32(F.substring(c, 13, 17)) == number(c, 30, 4)) & mode.isNotNull()
    return _found(number(c, 17, 4), number(c, 21, 4), mode, sound, _ends(c, IEND))


def _jpeg(c: Column) -> Column:
    """Each step reads one segment: its mark and length tell where the next one is."""
    start = F.struct(F.lit(3).cast("long").alias("at"), F.lit(False).alias("done"), F.lit(None).cast("long").alias("frame"))

    def read(s: Column) -> Column:
        at = s["at"]
        return F.struct(at.alias("at"), number(c, at, 1).alias("lead"), number(c, at + 1, 1).alias("mark"), number(c, at + 2, 2).alias("size"))

    def kind(v: Column) -> Column:
        mark = v["mark"]
        return F.struct(
            v["at"].alias("at"), mark.alias("mark"), v["size"].alias("size"), F.coalesce(v["lead"] == 0xFF, F.lit(False)).alias("lead"),
            F.coalesce((mark == 1) | mark.between(0xD0, 0xD8), F.lit(False)).alias("alone"),  # marks without data
            F.coalesce(mark.between(0xC0, 0xCF) & ~mark.isin(0xC4, 0xC8, 0xCC), F.lit(False)).alias("frame"),
        )

    def move(v: Column) -> Column:
        at, again = v["at"], v["mark"] == 0xFF  # 0xFF may be repeated before a mark
        stop = ~v["lead"] | v["mark"].isNull() | v["mark"].isin(0xD9, 0xDA) | v["frame"] | (~again & ~v["alone"] & v["size"].isNull())
        onward = F.when(again, at + 1).when(v["alone"], at + 2).otherwise(at + 2 + F.greatest(v["size"], F.lit(2)))
        return F.struct(onward.alias("at"), F.coalesce(stop, F.lit(True)).alias("done"), F.when(v["lead"] & v["frame"], at).alias("frame"))

    def step(s: Column, _: Column) -> Column:
        return F.when(s["done"], s).otherwise(bound(read(s), kind, move))

    def found(at: Column) -> Column:
        mode = _named(number(c, at + 9, 1), JPEG_MODES)
        return _found(number(c, at + 7, 2), number(c, at + 5, 2), mode, mode.isNotNull(), _ends(c, "FFD9"))

    steps = F.sequence(F.lit(1), F.least(F.lit(SEGMENTS), F.greatest(F.octet_length(c), F.lit(1))))
    return bound(F.aggregate(steps, start, step)["frame"], found)


def _webp(c: Column) -> Column:
    kind = F.substring(c, 13, 4).cast("string")
    lossy = F.hex(F.substring(c, 24, 3)) == "9D012A"
    bits = number(c, 22, 4, little=True)
    width = F.when(kind == "VP8 ", number(c, 27, 2, True) % (1 << 14)).when(kind == "VP8L", bits % (1 << 14) + 1).when(
        kind == "VP8X", number(c, 25, 3, True) + 1
    )
    height = F.when(kind == "VP8 ", number(c, 29, 2, True) % (1 << 14)).when(kind == "VP8L", F.shiftright(bits, 14) % (1 << 14) + 1).when(
        kind == "VP8X", number(c, 28, 3, True) + 1
    )
    alpha = F.when(kind == "VP8L", F.shiftright(bits, 28) % 2 == 1).when(kind == "VP8X", F.shiftright(number(c, 21, 1), 4) % 2 == 1).otherwise(F.lit(False))
    sound = F.when(kind == "VP8 ", lossy).when(kind == "VP8L", number(c, 21, 1) == 0x2F).otherwise(F.lit(True))
    complete = number(c, 5, 4, little=True) + 8 <= F.octet_length(c)
    return _found(width, height, F.when(alpha, "RGBA").otherwise("RGB"), sound, complete)


def _gif(c: Column) -> Column:
    return _found(number(c, 7, 2, True), number(c, 9, 2, True), F.lit("P"), F.lit(True), F.hex(F.substring(c, -1, 1)) == "3B")


def _bmp(c: Column) -> Column:
    signed = lambda x: F.when(x >= 1 << 31, x - (1 << 32)).otherwise(x)
    mode = _named(number(c, 29, 2, True), BMP_MODES)
    height = F.abs(signed(number(c, 23, 4, True)))  # negative: rows from the top
    return _found(signed(number(c, 19, 4, True)), height, mode, mode.isNotNull(), number(c, 3, 4, True) <= F.octet_length(c))


def _header(content: Column) -> Column:
    kind = image_format(content)
    none = F.struct(F.lit(None).cast("int").alias("width"), F.lit(None).cast("int").alias("height"), F.lit(None).cast("string").alias("mode"), F.lit("format").alias("error"))
    read = (
        F.when(kind == "PNG", _png(content)).when(kind == "JPEG", _jpeg(content)).when(kind == "WEBP", _webp(content)).when(kind == "GIF", _gif(content))
        .when(kind == "BMP", _bmp(content)).otherwise(none)
    )
    return F.when(content.isNotNull(), F.struct(kind.alias("format"), F.when(F.octet_length(content) == 0, "empty").alias("_none"), read.alias("read")))


def header(content: Column) -> Column:
    """format, width, height, mode, error of the bytes of a file; null for null, error ``empty`` without bytes."""
    found = lambda h: F.when(
        h.isNotNull(),
        F.struct(
            h["format"].alias("format"), h["read"]["width"].alias("width"), h["read"]["height"].alias("height"), h["read"]["mode"].alias("mode"),
            F.coalesce(h["_none"], h["read"]["error"]).alias("error"),
        ),
    )
    return bound(content, _header, found)


def inspected(files: DataFrame, content: str = "content", path: str = "path") -> DataFrame:
    """P-10: files with bytes, format, width, height, mode and the first failed check: of the limits, then of the header."""
    c = F.col(content)
    extension = F.element_at(F.split(F.element_at(F.split(F.col(path), "/"), -1), r"\."), -1)
    # a generator, so that the header is read once and not for each column that is used
    rows = files.select("*", F.octet_length(c).alias("bytes"), F.inline(F.array(header(c)))).withColumnRenamed("error", "_broken")
    first = image_error(F.col("bytes"), extension, F.col("format"), F.col("width"), F.col("height"))
    broken = F.when(F.col("_broken").isin("truncated", "header"), F.col("_broken"))
    # a limit on the sides is only asked of sides that were read
    return rows.withColumn("error", F.when(first.isin("too_small", "side", "pixels") | first.isNull(), F.coalesce(broken, first)).otherwise(first)).drop("_broken")
