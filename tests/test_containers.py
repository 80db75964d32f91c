"""Headers of hand-made files, the difference hash and patch scans against plain Python."""

import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.functions import fingerprints
from plumbline.operators import patches
from plumbline.sources import headers


def png(w, h, depth=8, kind=2, crc=None, end=True):
    ihdr = b"IHDR" + struct.pack(">IIBBBBB", w, h, depth, kind, 0, 0, 0)
    out = b"\x89PNG\r\n\x1a\n" + struct.pack(">I", 13) + ihdr + struct.pack(">I", zlib.crc32(ihdr) if crc is None else crc)
    return out + (struct.pack(">I", 0) + b"IEND" + struct.pack(">I", zlib.crc32(b"IEND")) if end else b"\0\0")


def jpeg(w, h, parts=3, before=b"", frame=0xC0, end=b"\xff\xd9"):
    size = struct.pack(">BHHB", 8, h, w, parts) + b"\x01\x22\x00" * parts
    return b"\xff\xd8" + before + bytes([0xFF, frame]) + struct.pack(">H", len(size) + 2) + size + b"\xff\xda\x00\x02xx" + end


def segment(mark, data):
    return bytes([0xFF, mark]) + struct.pack(">H", len(data) + 2) + data


def riff(kind, body, more=0):
    return b"RIFF" + struct.pack("<I", len(body) + 12 + more) + b"WEBP" + kind + struct.pack("<I", len(body)) + body


LOSSY = b"\x30\x01\x00\x9d\x01\x2a" + struct.pack("<HH", 640, 480) + b"data"
BITS = struct.pack("<I", 99 | 49 << 14 | 1 << 28)
CASES = [
    (png(300, 200), ("PNG", 300, 200, "RGB", None)), (png(3, 70000, kind=6), ("PNG", 3, 70000, "RGBA", None)), (png(5, 5, depth=16, kind=0), ("PNG", 5, 5, "I;16", None)),
    (png(5, 5, depth=1, kind=0), ("PNG", 5, 5, "1", None)), (png(5, 6, crc=1), ("PNG", 5, 6, "RGB", "header")), (png(0, 6), ("PNG", 0, 6, "RGB", "header")),
    (png(300, 200, end=False), ("PNG", 300, 200, "RGB", "truncated")), (png(300, 200)[:20], ("PNG", None, None, None, "truncated")),
    (jpeg(640, 480), ("JPEG", 640, 480, "RGB", None)), (jpeg(1, 2, 1, frame=0xC2), ("JPEG", 1, 2, "L", None)), (jpeg(9, 8, 4), ("JPEG", 9, 8, "CMYK", None)),
    # a thumbnail with a frame of its own inside application data, tables that look like a frame, repeated fill bytes
    (jpeg(640, 480, before=segment(0xE1, jpeg(16, 12)) + segment(0xC4, b"\xff\xc0\0\x11\x08\0\x01\0\x01\x03") + b"\xff\xff" + segment(0xFE, b"x" * 60000)), ("JPEG", 640, 480, "RGB", None)),
    (jpeg(640, 480, before=b"".join(segment(0xE2, b"icc" * 20) for _ in range(300))), ("JPEG", 640, 480, "RGB", None)),
    (jpeg(640, 480, end=b""), ("JPEG", 640, 480, "RGB", "truncated")), (jpeg(640, 480, before=segment(0xE1, b"y" * 500))[:200], ("JPEG", None, None, None, "truncated")),
    (b"\xff\xd8\xff", ("JPEG", None, None, None, "truncated")), (b"\xff\xd8" + b"\xff\xda\x00\x02xx\xff\xd9", ("JPEG", None, None, None, "truncated")),
    (riff(b"VP8 ", LOSSY), ("WEBP", 640, 480, "RGB", None)), (riff(b"VP8 ", LOSSY, more=9), ("WEBP", 640, 480, "RGB", "truncated")),
    (riff(b"VP8 ", b"\x30\x01\x00\x00\x01\x2a" + LOSSY[6:]), ("WEBP", 640, 480, "RGB", "header")),
    (riff(b"VP8L", b"\x2f" + BITS + b"zz"), ("WEBP", 100, 50, "RGBA", None)), (riff(b"VP8X", b"\x10\0\0\0" + b"\x0f\x27\0" + b"\x01\0\0"), ("WEBP", 10000, 2, "RGBA", None)),
    (b"GIF89a" + struct.pack("<HH", 7, 9) + b"\0\0\0;", ("GIF", 7, 9, "P", None)), (b"GIF89a" + struct.pack("<HH", 7, 9) + b"\0\0", ("GIF", 7, 9, "P", "truncated")),
    (b"BM" + struct.pack("<IIIIiiHH", 54, 0, 54, 40, 33, -44, 1, 24) + bytes(24), ("BMP", 33, 44, "RGB", None)),
    (b"BM" + struct.pack("<IIIIiiHH", 99, 0, 54, 40, 33, 44, 1, 8) + bytes(24), ("BMP", 33, 44, "P", "truncated")),
    (b"plain text", (None, None, None, None, "format")), (b"", (None, None, None, None, "empty")), (None, (None, None, None, None, None)),
]


def test_headers(spark):
    rows = spark.createDataFrame([(k, bytearray(c) if c is not None else None) for k, (c, _) in enumerate(CASES)], "k int, content binary")
    found = {r["k"]: tuple(r)[1:] for r in rows.select("k", F.inline_outer(F.array(headers.header(F.col("content"))))).collect()}
    for k, (_, want) in enumerate(CASES):
        assert found[k] == want, (k, found[k], want)


def test_checks_of_files_in_a_folder(spark, tmp_path):
    for name, content in (("a.png", png(300, 200)), ("b.jpg", jpeg(640, 480)[:-2]), ("c.txt", png(300, 200)), ("d.webp", riff(b"VP8L", b"\x2f" + struct.pack("<I", 9 | 49 << 14))), ("f.jpeg", b"junk")):
        (tmp_path / name).write_bytes(content)
    files = spark.read.format("binaryFile").load(str(tmp_path))
    found = {r["path"].rsplit("/")[-1]: (r["width"], r["error"]) for r in headers.inspected(files.select("path", "content")).collect()}
    assert found == {"a.png": (300, None), "b.jpg": (640, "truncated"), "c.txt": (300, "extension"), "d.webp": (10, "too_small"), "f.jpeg": (None, "format")}


def plain_hash(pixels, width, height):
    """Area-weighted triangles, 8-bit rounding after each direction, in numpy floats."""

    def reduce(rows, out):
        size = rows.shape[1]
        step, cols = size / out, []
        reach = max(step, 1.0)
        for k in range(out):
            middle = (k + 0.5) * step
            w = np.maximum(0, 1 - np.abs(np.arange(size) + 0.5 - middle) / reach)
            lo, hi = max(int(middle - reach + 0.5), 0), min(int(middle + reach + 0.5), size)
            w[:lo], w[hi:] = 0, 0
            w = np.floor(w / w.sum() * (1 << 22) + 0.5)
            cols.append(np.clip(np.floor((rows @ w + (1 << 21)) / (1 << 22)), 0, 255))
        return np.stack(cols, axis=1)

    small = reduce(reduce(np.array(pixels, float).reshape(height, width), 9).T, 8).T
    value = 0
    for bit in (small[:, 1:] > small[:, :-1]).flatten():
        value = value << 1 | int(bit)
    return value - (1 << 64) if value >= 1 << 63 else value


@pytest.mark.parametrize("width,height", [(9, 8), (30, 21), (5, 40)])
def test_difference_hash(spark, width, height):
    rng = random.Random(width)
    tiles = [[rng.randrange(256) for _ in range(width * height)] for _ in range(12)] + [[7] * (width * height), list(range(width)) * height]
    rows = [(k, t) for k, t in enumerate(tiles)] + [(100, [1, 2]), (101, None), (102, [None] * (width * height))]
    df = spark.createDataFrame(rows, "k int, pixels array<int>")
    found = {r["k"]: r["h"] for r in df.select("k", fingerprints.difference_hash(F.col("pixels"), width, height).alias("h")).collect()}
    assert all(found[k] == plain_hash(t, width, height) for k, t in enumerate(tiles))
    assert found[12] == 0 and (found[13] == -1 or width < 9) and found[100] is found[101] is found[102] is None
    grey = spark.createDataFrame([(255, 0, 0), (10, 200, 30)], "r int, g int, b int").select(fingerprints.luma(F.col("r"), F.col("g"), F.col("b"))).collect()
    assert [r[0] for r in grey] == [76, 124]


def plain_scan(image, known, s):
    i, width, height, whole = image
    score = lambda x, y, w, h: ((x * 7 + y * 13 + w * 3 + i) % 101) / 101.0
    if min(width, height) < s.least:
        return []
    side = min(s.size, width, height)
    stride, most = min(max(s.stride, s.size), side), s.coarse
    at = lambda length: sorted({*range(0, length - side + 1, stride), length - side})
    boxes = [(x, y, side, side) for y in at(height) for x in at(width)]
    if len(boxes) > most:
        boxes = [boxes[k] for k in sorted({int(v) for v in np.linspace(0, len(boxes) - 1, most).round()})]
    cache = dict(known)

    def scored(b, step):
        origin = "whole" if b == (0, 0, width, height) and whole is not None else "known" if (i, *b) in cache else "model"
        v = whole if origin == "whole" else cache[(i, *b)] if origin == "known" else score(*b)
        cache[(i, *b)] = v
        return (*b, min(max(v, 0.0), 1.0), step, origin)

    out = [scored(b, 1) for b in boxes]
    best = sorted(range(len(out)), key=lambda k: (-out[k][4], k))[: s.k]
    parts = []
    for k in best:
        x, y, w, h = boxes[k]
        pw, ph = w // s.factor, h // s.factor
        if min(pw, ph) >= s.least:
            parts += [(min(x + a * pw, width - pw), min(y + b * ph, height - ph), pw, ph) for b in range(s.factor) for a in range(s.factor)]
    out += [scored(b, 2) for b in list(dict.fromkeys(parts))[: max(0, s.most - len(boxes))]]
    return [(i, k, *b) for k, b in enumerate(out)]


def test_patch_scan(spark):
    rng = random.Random(6)
    images = [(k, rng.randrange(30, 900), rng.randrange(30, 700), rng.choice([None, 0.1, 0.5, 0.9])) for k in range(25)] + [(90, 200, 200, 0.4), (91, 200, 200, None)]
    s = patches.Settings(mode="top_k", most=14, k=4)
    known = {(90, 0, 0, 100, 100): 1.5, (3, 0, 0, 10, 10): 0.3, (91, 0, 0, 200, 200): 0.25}
    df = spark.createDataFrame(images, "id long, width int, height int, whole double")
    cache = spark.createDataFrame([(*b, v) for b, v in known.items()], "id long, x int, y int, w int, h int, score double")
    model = lambda b: b.withColumn("score", ((F.col("x") * 7 + F.col("y") * 13 + F.col("w") * 3 + F.col("id")) % 101) / 101.0)
    found = patches.scan(df, model, s, cache)
    want = [x for i in images for x in plain_scan(i, known, s)]
    assert sorted(tuple(r) for r in found.collect()) == sorted(want)
    assert {x[-1] for x in want} == {"whole", "known", "model"}
    shares = {r["id"]: r["coverage"] for r in patches.summary(df, found, 0.5).collect()}
    for i, width, height, _ in images:
        seen = np.zeros((height, width), bool)
        for x in want:
            if x[0] == i:
                seen[x[3] : x[3] + x[5], x[2] : x[2] + x[4]] = True
        assert (shares[i] is None and not seen.any()) or abs(shares[i] - seen.mean()) < 1e-12
    assert patches.scan(df, model, patches.Settings(mode="off")).count() == 0
    with pytest.raises(ValueError):
        patches.Settings(mode="dense")
    with pytest.raises(ValueError):
        patches.Settings(band=(0.9, 0.1))
