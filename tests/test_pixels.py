import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.functions import pixels

H, W = 10, 12


def tile(seed):
    return np.round(np.random.default_rng(seed).random((H, W)) * 255) / 255


def grid(v):
    return math.floor(min(max(v, 0.0), 1.0) * 255 + 0.5) / 255


def at(x, i, j):
    return x[min(max(i, 0), len(x) - 1)][min(max(j, 0), len(x[0]) - 1)]


def plain_blur(x, sigma):
    reach = max(1, int(3 * sigma + 0.5))
    k = [math.exp(-0.5 * (d / sigma) ** 2) for d in range(-reach, reach + 1)]
    steps = list(zip(range(-reach, reach + 1), [v / sum(k) for v in k]))
    return [[sum(a * b * at(x, i + p, j + q) for p, a in steps for q, b in steps) for j in range(len(x[0]))] for i in range(len(x))]


def plain_box(x, scale):
    """Every small pixel is the mean of those whose centres lie in it."""
    h, w = max(1, round(len(x) * scale)), max(1, round(len(x[0]) * scale))
    inside = lambda n, m, k: [i for i in range(n) if -0.5 < (i + 0.5 - (k + 0.5) * n / m) / max(n / m, 1) <= 0.5]
    return [[np.mean([x[p][q] for p in inside(len(x), h, i) for q in inside(len(x[0]), w, j)]) for j in range(w)] for i in range(h)]


def plain_jpeg(x, quality):
    scale = 5000 // quality if quality < 50 else 200 - 2 * quality
    h, w = len(x), len(x[0])
    out = [[0.0] * w for _ in range(h)]
    c = lambda k: math.sqrt((1 if k == 0 else 2) / 8)
    wave = [[math.cos((2 * i + 1) * u * math.pi / 16) * c(u) for i in range(8)] for u in range(8)]
    for a in range(0, h, 8):
        for b in range(0, w, 8):
            block = [[at(x, a + i, b + j) * 255 - 128 for j in range(8)] for i in range(8)]
            kept = [[0.0] * 8 for _ in range(8)]
            for u in range(8):
                for v in range(8):
                    step = min(max((int(pixels.LUMINANCE[u][v]) * scale + 50) // 100, 1), 255)
                    kept[u][v] = float(np.rint(sum(wave[u][i] * wave[v][j] * block[i][j] for i in range(8) for j in range(8)) / step)) * step
            for i in range(min(8, h - a)):
                for j in range(min(8, w - b)):
                    out[a + i][b + j] = (sum(wave[u][i] * wave[v][j] * kept[u][v] for u in range(8) for v in range(8)) + 128) / 255
    return out


def close(found, expected):
    """Equal but for a last digit that rounds to the next grid step."""
    expected = np.array([[grid(v) for v in row] for row in expected])
    assert found.shape == expected.shape
    off = np.abs(found - expected)
    assert off.max() <= 1.01 / 255 and (off > 1e-9).mean() < 0.02


@pytest.mark.parametrize("seed", [1, 2])
def test_transforms_equal_plain_loops(seed):
    x = tile(seed)
    run = lambda name: pixels.apply(x[None], *pixels.OPERATIONS[name], 77)[0]
    close(run("blur_s1"), plain_blur(x, 1.0))
    for q in (90, 30):
        close(run(f"jpeg_q{q}"), plain_jpeg(x, q))
    assert np.allclose(pixels._both(x[None], pixels.resampling(H, 5, "box"), pixels.resampling(W, 6, "box"))[0], plain_box(x, 0.5))
    assert run("resize_0.5x").shape == (H, W) and run("center_crop_80").tolist() == x[1:9, 1:11].tolist()
    draws = np.random.default_rng(77).normal(0, 0.05 * 255, (H, W))
    assert np.allclose(run("noise_s0.05"), np.floor(np.clip(x * 255 + draws, 0, 255)) / 255)
    bright, contrast = np.random.default_rng(77).uniform(0.8, 1.2, 2)
    lit = [[grid(v * bright) for v in row] for row in x]
    mean = grid(np.mean(lit))
    close(run("color_jitter"), [[mean + (v - mean) * contrast for v in row] for row in lit])
    soft = [[grid(v) for v in row] for row in plain_blur(x, 2.0)]
    close(run("sharpen"), [[v + 1.2 * (v - s) if abs(v - s) >= 3 / 255 else v for v, s in zip(a, b)] for a, b in zip(x, soft)])
    assert run("screenshot").shape == (6, 7)


def test_resampling_keeps_constants_and_lines():
    for kind in pixels.FILTERS:
        assert np.allclose(pixels.resampling(9, 4, kind) @ np.ones(9), 1) and np.allclose(pixels.resampling(5, 5, kind), np.eye(5))
    up = pixels.resampling(6, 12, "cubic") @ np.arange(6.0)
    assert np.allclose(np.diff(up)[4:-4], 0.5)


def test_chains():
    table = dict(pixels.chains(1234))
    assert len(table) == 14 and table["recompress_x5"] == ["jpeg_q70"] * 5
    for d in (1, 2, 3, 5):
        assert len(set(table[f"generation_{d}"])) == d and set(table[f"generation_{d}"]) <= set(pixels.POOL)
    assert len(table["generation_10"]) == 10 and set(table["generation_10"]) == set(pixels.POOL) and len(pixels.drawn_chain(3, 12)) == 12
    assert table["generation_3"] == [pixels.POOL[k] for k in np.random.default_rng(1234 + 3 * 7919).choice(10, size=3, replace=False)]
    x = tile(3)[None]
    step = pixels.apply(pixels.apply(x, "noise", 0.02, 9), "noise", 0.02, 9 + 104729)
    assert np.array_equal(pixels.apply_chain(x, ["noise_s0.02", "noise_s0.02"], 9), step)
    with pytest.raises(ValueError):
        pixels.drawn_chain(1, 0)


def test_chain_table(spark):
    rows = pixels.chain_table(spark, 5).where("chain = 'crop_jpeg_color'").orderBy("position").collect()
    assert [(r["op"], r["seed"]) for r in rows] == [("center_crop_80", 5), ("jpeg_q50", 5 + 104729), ("color_jitter", 5 + 2 * 104729)]


def test_relations_of_tiles(spark):
    x = tile(4)
    rows = [(1, x.reshape(-1).tolist()), (2, None), (3, [0.5] * 7), (4, [None] * (H * W)), (5, [0.25] * (H * W)), (5, [0.25] * (H * W)), (6, [])]
    tiles = spark.createDataFrame(rows, "id long, pixels array<double>").coalesce(1)
    out = pixels.transform(tiles, H, W, seed=3).collect()
    assert len(out) == 14 * len(rows)
    for r in out:
        assert (r["error"] is None) == (r["id"] in (1, 5)) and (r["pixels"] is None) == (r["error"] is not None)
        if r["id"] == 1:
            kind, value = pixels.OPERATIONS[r["condition"]]
            assert np.allclose(r["pixels"], pixels.apply(x[None], kind, value, (3 + zlib.crc32(r["condition"].encode())) % 2**32).reshape(-1))
            assert r["height"] * r["width"] == len(r["pixels"])
    bad = pixels.transform(tiles, H, W, [("odd", "jpeg", "x"), ("fine", "crop", 0.5)]).where("id = 1").orderBy("ordinal").collect()
    assert [r["error"] for r in bad] == ["TypeError", None]
    assert pixels.transform_chains(tiles, H, W, 3).where("error is null").count() == 14 * 3
    assert pixels.transform(tiles.limit(0), H, W).count() == 0
    hashes = {(r["id"], r["h"]) for r in tiles.select("id", pixels.pixel_hash(F.col("pixels"), H, W).alias("h")).collect()}
    assert len(hashes) == 6 and sum(h is None for _, h in hashes) == 4


def test_features_equal_plain_loops(spark):
    x = tile(6)
    tiles = spark.createDataFrame([(1, x.reshape(-1).tolist()), (2, None)], "id long, pixels array<double>")
    found = {r["id"]: r for r in pixels.frequency(tiles, H, W).collect()}
    assert found[2]["high"] is None and found[2]["profile"] is None
    wave = lambda u, v: abs(sum(x[i, j] * np.exp(-2j * np.pi * (u * i / H + v * j / W)) for i in range(H) for j in range(W)))
    rings, counts = [0.0] * 16, [0] * 16
    far = math.hypot((H - 1) / 2, (W - 1) / 2)
    for i in range(H):
        for j in range(W):
            k = min(int(math.hypot(i - (H - 1) / 2, j - (W - 1) / 2) / far * 16), 15)
            rings[k] += math.log1p(wave(i - H // 2, j - W // 2))
            counts[k] += 1
    profile = [a / max(b, 1) for a, b in zip(rings, counts)]
    assert found[1]["profile"] == pytest.approx(profile) and found[1]["high"] == pytest.approx(sum(profile[8:]) / sum(profile))
    mirror = lambda i, n: -i if i < 0 else 2 * (n - 1) - i if i >= n else i
    near = lambda i, j: x[mirror(i, H), mirror(j, W)]
    laplace = [abs(4 * x[i, j] - near(i - 1, j) - near(i + 1, j) - near(i, j - 1) - near(i, j + 1)) for i in range(H) for j in range(W)]
    rest = [x[i, j] - np.mean([near(i + a, j + b) for a in (-1, 0, 1) for b in (-1, 0, 1)]) for i in range(H) for j in range(W)]
    assert found[1]["laplacian"] == pytest.approx(np.mean(laplace)) and found[1]["residual"] == pytest.approx(np.std(rest))
    c = lambda n, u: math.sqrt((1 if u == 0 else 2) / n)
    size = lambda u, v: abs(c(H, u) * c(W, v) * sum(x[i, j] * math.cos((2 * i + 1) * u * math.pi / (2 * H)) * math.cos((2 * j + 1) * v * math.pi / (2 * W)) for i in range(H) for j in range(W)))
    total = sum(size(u, v) for u in range(H) for v in range(W))
    assert found[1]["cosine"] == pytest.approx((total - size(0, 0)) / total)
