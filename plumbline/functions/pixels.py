"""Pixel transforms, chains and frequency features on grey tiles (E-01 to E-04, E-10, C-02).

A tile is an array of ``height * width`` values in [0, 1], kept on the grid of 255 steps
as images are. All tiles of an Arrow slice go through a transform at once, as one
(tiles, rows, columns) array: blur, resampling and cosine transforms are products with
small matrices. JPEG is its luminance part: 8x8 cosine transform and quantisation.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values: (name, kind, parameter) of the default transforms, in their order
DEFAULT_SPECS = (
    ("jpeg_q90", "jpeg", 90), ("jpeg_q70", "jpeg", 70), ("jpeg_q50", "jpeg", 50), ("jpeg_q30", "jpeg", 30),
    ("blur_s0.5", "blur", 0.5), ("blur_s1", "blur", 1.0), ("blur_s2", "blur", 2.0), ("resize_0.5x", "resize", 0.5), ("resize_0.25x", "resize", 0.25),
    ("noise_s0.02", "noise", 0.02), ("noise_s0.05", "noise", 0.05), ("noise_s0.1", "noise", 0.1), ("color_jitter", "jitter", 0.2), ("center_crop_80", "crop", 0.8),
)
# The operations of chains beyond those, the named chains, the pool and depths of drawn ones
MORE_SPECS = (("resize_0.7x", "resize", 0.7), ("center_crop_90", "crop", 0.9), ("screenshot", "screenshot", 0.6), ("sharpen", "sharpen", 1.2))
CHAINS = (
    ("resize_jpeg_crop", ("resize_0.5x", "jpeg_q70", "center_crop_80")),
    ("blur_jitter_jpeg", ("blur_s1", "color_jitter", "jpeg_q70")),
    ("noise_resize_blur", ("noise_s0.05", "resize_0.5x", "blur_s1")),
    ("crop_jpeg_color", ("center_crop_80", "jpeg_q50", "color_jitter")),
    ("screenshot", ("screenshot",)),
    ("screenshot_reshare", ("screenshot", "jpeg_q70", "resize_0.7x")),
    ("recompress_x3", ("jpeg_q70",) * 3),
    ("recompress_x5", ("jpeg_q70",) * 5),
    ("sharpen_recompress", ("sharpen", "jpeg_q50")),
)
POOL = ("jpeg_q70", "jpeg_q50", "blur_s1", "blur_s0.5", "resize_0.7x", "noise_s0.02", "color_jitter", "center_crop_90", "screenshot", "sharpen")
DEPTHS = (1, 2, 3, 5, 10)
DEPTH_STEP, PLACE_STEP = 7919, 104729
# The luminance quantisation of JPEG at quality 50
LUMINANCE = np.array([
    [16, 11, 10, 16, 24, 40, 51, 61], [12, 12, 14, 19, 26, 58, 60, 55], [14, 13, 16, 24, 40, 57, 69, 56], [14, 17, 22, 29, 51, 87, 80, 62],
    [18, 22, 37, 56, 68, 109, 103, 77], [24, 35, 55, 64, 81, 104, 113, 92], [49, 64, 78, 87, 103, 121, 120, 101], [72, 92, 95, 98, 112, 100, 103, 99],
])
SCREEN_QUALITY, SHARPEN_RADIUS, SHARPEN_LEAST = 85, 2.0, 3 / 255
RINGS = 16
SLICE = 4096


def transform_seed(seed: int, name: str) -> int:
    """E-02: every transform has draws of its own, whatever the order."""
    return (seed + zlib.crc32(name.encode())) % 2**32


def drawn_chain(seed: int, depth: int, pool: Sequence[str] = POOL) -> list[str]:
    """E-04: operations in a drawn order, the same for all items; they repeat only beyond the pool's size."""
    if depth < 1:
        raise ValueError("a chain has one operation or more")
    rng = np.random.default_rng(seed + depth * DEPTH_STEP)
    return [pool[k] for k in rng.choice(len(pool), size=depth, replace=depth > len(pool))]


def chains(seed: int) -> list[tuple[str, list[str]]]:
    return [(n, [*ops]) for n, ops in CHAINS] + [(f"generation_{d}", drawn_chain(seed, d)) for d in DEPTHS]


def chain_table(spark: SparkSession, seed: int) -> DataFrame:
    """E-04: chain, ordinal, position, op, seed."""
    table = spark.createDataFrame([(k, n, ops) for k, (n, ops) in enumerate(chains(seed))], "ordinal int, chain string, ops array<string>")
    out = table.select("chain", "ordinal", F.posexplode("ops").alias("position", "op"))
    return out.withColumn("seed", F.lit(seed).cast("long") + PLACE_STEP * F.col("position"))


def _grid(x: np.ndarray) -> np.ndarray:
    return np.floor(np.clip(x, 0.0, 1.0) * 255.0 + 0.5) / 255.0


def _both(x: np.ndarray, rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
    return rows @ x @ columns.T


def _gauss(n: int, sigma: float) -> np.ndarray:
    """The n x n matrix of a Gaussian blur; beyond the border its value goes on."""
    reach = max(1, int(3 * sigma + 0.5))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    out = np.zeros((n, n))
    for k, weight in zip(range(-reach, reach + 1), kernel / kernel.sum(), strict=True):
        np.add.at(out, (np.arange(n), np.clip(np.arange(n) + k, 0, n - 1)), weight)
    return out


FILTERS: dict[str, tuple[float, Callable]] = {
    "box": (0.5, lambda t: ((t > -0.5) & (t <= 0.5)).astype(float)),
    "triangle": (1.0, lambda t: np.maximum(1.0 - np.abs(t), 0.0)),
    "cubic": (2.0, lambda t: np.where(np.abs(t) < 1, (1.5 * np.abs(t) - 2.5) * t**2 + 1, np.where(np.abs(t) < 2, ((-0.5 * np.abs(t) + 2.5) * np.abs(t) - 4) * np.abs(t) + 2, 0.0))),
}


def resampling(n: int, m: int, kind: str) -> np.ndarray:
    """The m x n matrix that resamples n values to m; the filter widens when it shrinks."""
    _, weight = FILTERS[kind]
    ratio = n / m
    centre = (np.arange(m) + 0.5) * ratio
    out = weight((np.arange(n)[None, :] + 0.5 - centre[:, None]) / max(ratio, 1.0))
    return out / out.sum(1, keepdims=True)


def _resize(x: np.ndarray, scale: float, rng=None) -> np.ndarray:
    small = [max(1, round(n * scale)) for n in x.shape[1:]]
    down = _grid(_both(x, *[resampling(n, m, "box") for n, m in zip(x.shape[1:], small, strict=True)]))
    return _both(down, *[resampling(m, n, "cubic") for n, m in zip(x.shape[1:], small, strict=True)])


def cosines(n: int) -> np.ndarray:
    """The orthonormal cosine transform."""
    out = np.sqrt(2 / n) * np.cos(np.pi * np.arange(n)[:, None] * (2 * np.arange(n) + 1) / (2 * n))
    out[0] /= np.sqrt(2)
    return out


def _jpeg(x: np.ndarray, quality: float, rng=None) -> np.ndarray:
    h, w = x.shape[1:]
    scale = 5000 // quality if quality < 50 else 200 - 2 * quality
    table = np.clip((LUMINANCE * scale + 50) // 100, 1, 255)
    padded = np.pad(x, ((0, 0), (0, -h % 8), (0, -w % 8)), mode="edge") * 255.0 - 128.0
    n, rows, cols = padded.shape
    blocks = padded.reshape(n, rows // 8, 8, cols // 8, 8).transpose(0, 1, 3, 2, 4)
    c = cosines(8)
    kept = np.rint(c @ blocks @ c.T / table) * table
    out = (c.T @ kept @ c).transpose(0, 1, 3, 2, 4).reshape(n, rows, cols)
    return (out[:, :h, :w] + 128.0) / 255.0


def _crop(x: np.ndarray, share: float, rng=None) -> np.ndarray:
    """The middle; the tile gets smaller."""
    h, w = (max(1, round(n * share)) for n in x.shape[1:])
    a, b = (x.shape[1] - h) // 2, (x.shape[2] - w) // 2
    return x[:, a : a + h, b : b + w]


def _blur(x: np.ndarray, sigma: float, rng=None) -> np.ndarray:
    return _both(x, _gauss(x.shape[1], sigma), _gauss(x.shape[2], sigma))


def _noise(x: np.ndarray, sigma: float, rng) -> np.ndarray:
    """The same draws for all tiles; values are cut down to the grid, not rounded."""
    noisy = x * 255.0 + rng.normal(0.0, sigma * 255.0, x.shape[1:])
    return np.floor(np.clip(noisy, 0.0, 255.0)) / 255.0


def _jitter(x: np.ndarray, limit: float, rng) -> np.ndarray:
    """Brightness, then contrast about the mean; the third draw, saturation, leaves grey as it is."""
    bright, contrast, _ = (rng.uniform(1.0 - limit, 1.0 + limit) for _ in range(3))
    x = _grid(x * bright)
    mean = _grid(x.mean(axis=(1, 2), keepdims=True))
    return mean + (x - mean) * contrast


def _screenshot(x: np.ndarray, scale: float, rng=None) -> np.ndarray:
    small = [max(1, int(n * scale)) for n in x.shape[1:]]
    return _jpeg(_grid(_both(x, *[resampling(n, m, "triangle") for n, m in zip(x.shape[1:], small, strict=True)])), SCREEN_QUALITY)


def _sharpen(x: np.ndarray, amount: float, rng=None) -> np.ndarray:
    edge = x - _grid(_blur(x, SHARPEN_RADIUS))
    return np.where(np.abs(edge) >= SHARPEN_LEAST, x + amount * edge, x)


KINDS: dict[str, Callable] = {
    "jpeg": _jpeg, "blur": _blur, "resize": _resize, "noise": _noise, "jitter": _jitter, "crop": _crop, "screenshot": _screenshot, "sharpen": _sharpen,
}
OPERATIONS = {name: (kind, value) for name, kind, value in (*DEFAULT_SPECS, *MORE_SPECS)}


def apply(x: np.ndarray, kind: str, value: float, seed: int) -> np.ndarray:
    """One transform of tiles on the grid."""
    return _grid(KINDS[kind](x, value, np.random.default_rng(seed)))


def apply_chain(x: np.ndarray, ops: Sequence[str], seed: int) -> np.ndarray:
    """E-03, E-04: one operation after the other, each with draws of its place."""
    for place, op in enumerate(ops):
        x = apply(x, *OPERATIONS[op], seed + PLACE_STEP * place)
    return x


def _tiles(batches, height: int, width: int) -> Iterator[tuple]:
    """(ids, which rows are tiles, their array) by slices."""
    import pyarrow as pa

    for batch in batches:
        for k in range(0, batch.num_rows, SLICE):
            part = batch.slice(k, SLICE)
            pixels = part.column("pixels").cast(pa.list_(pa.float64()))
            sizes = pixels.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            flat = pixels.flatten()
            values, bad = flat.to_numpy(zero_copy_only=False), np.concatenate(([0], np.cumsum(flat.is_null().to_numpy(zero_copy_only=False))))
            ends = np.cumsum(sizes)
            good = (sizes == height * width) & (bad[ends] == bad[ends - sizes])
            at = (ends - sizes)[good][:, None] + np.arange(height * width)
            yield part.column("id"), good, _grid(values[at].reshape(-1, height, width)) if good.any() else np.zeros((0, height, width))


def _rows(pa, ids, good, name: str, ordinal: int, made):
    """Arrow rows of one transform; made is its array, or the error."""
    n = len(good)
    errors = [None if g else "not a tile" for g in good]
    if isinstance(made, str):
        errors, sizes, shape, values = [made if g else e for g, e in zip(good, errors, strict=True)], np.zeros(n, np.int64), (None, None), np.zeros(0)
        good = np.zeros(n, bool)
    else:
        shape, values = made.shape[1:], made.reshape(-1)
        sizes = np.where(good, shape[0] * shape[1], 0)
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32()), pa.array(values), mask=pa.array(~good))
    side = lambda k: pa.array([shape[k] if g else None for g in good], pa.int32())
    return pa.RecordBatch.from_arrays(
        [ids, pa.array([name] * n), pa.array([ordinal] * n, pa.int32()), side(0), side(1), lists, pa.array(errors, pa.string())],
        names=["id", "condition", "ordinal", "height", "width", "pixels", "error"],
    )


def _mapped(tiles: DataFrame, height: int, width: int, works: Sequence[tuple[str, Callable]]) -> DataFrame:
    def run(batches):
        import pyarrow as pa

        for ids, good, x in _tiles(batches, height, width):
            for k, (name, work) in enumerate(works):
                try:
                    made = work(x) if len(x) else np.zeros((0, 1, 1))
                except Exception as error:  # reported, so that one transform does not fail the job
                    made = type(error).__name__
                yield _rows(pa, ids, good, name, k + 1, made)

    kind = dict(tiles.dtypes)["id"]
    return tiles.select("id", "pixels").mapInArrow(run, f"id {kind}, condition string, ordinal int, height int, width int, pixels array<double>, error string")


def transform(tiles: DataFrame, height: int, width: int, specs: Sequence[tuple] = DEFAULT_SPECS, seed: int = 0) -> DataFrame:
    """E-01, E-03, X-02: tiles(id, pixels) → id, condition, ordinal, height, width, pixels, error.

    Null pixels or a wrong size give rows with an error. Draws depend on the seed and the
    transform's name, so a task that runs again gives the same rows."""
    one = lambda n, k, v: (lambda x: apply(x, k, v, transform_seed(seed, n)))
    return _mapped(tiles, height, width, [(n, one(n, k, v)) for n, k, v in specs])


def transform_chains(tiles: DataFrame, height: int, width: int, seed: int = 0) -> DataFrame:
    """E-04: the same rows for the named and the drawn chains."""
    one = lambda ops: (lambda x: apply_chain(x, ops, seed))
    return _mapped(tiles, height, width, [(n, one(ops)) for n, ops in chains(seed)])


def pixel_hash(pixels: Column, height: int, width: int) -> Column:
    """C-02: a digest of shape and pixel values, equal for re-encoded copies of the same pixels; null for no tile."""
    steps = F.transform(pixels, lambda v: F.floor(F.least(F.greatest(v, F.lit(0.0)), F.lit(1.0)) * 255.0 + 0.5).cast("int"))
    known = (F.size(pixels) == height * width) & ~F.exists(pixels, lambda v: v.isNull())
    return F.when(known, F.sha2(F.concat(F.lit(f"{height}x{width}:"), F.array_join(steps, ",")), 256))


def features(x: np.ndarray, rings: int = RINGS) -> dict[str, np.ndarray]:
    """E-10: log spectrum by rings, its outer half's share, cosine energy outside the low corner, Laplacian, residual."""
    h, w = x.shape[1:]
    spectrum = np.log1p(np.abs(np.fft.fftshift(np.fft.fft2(x), axes=(1, 2))))
    radius = np.hypot(np.arange(h)[:, None] - (h - 1) / 2, np.arange(w) - (w - 1) / 2)
    ring = np.minimum((radius / (radius.max() or 1.0) * rings).astype(int), rings - 1)
    of = (ring.reshape(-1)[:, None] == np.arange(rings)).astype(float)
    profile = spectrum.reshape(len(x), h * w) @ of / np.maximum(of.sum(0), 1)
    share = lambda part, whole: np.where(whole > 0, part / np.where(whole > 0, whole, 1.0), 0.0)
    waves = np.abs(_both(x, cosines(h), cosines(w)))
    total, low = waves.sum((1, 2)), waves[:, : max(1, h // 8), : max(1, w // 8)].sum((1, 2))
    edge = np.pad(x, ((0, 0), (1, 1), (1, 1)), mode="reflect")
    near = lambda i, j: edge[:, i : i + h, j : j + w]
    laplace = 4 * x - near(0, 1) - near(2, 1) - near(1, 0) - near(1, 2)
    mean = sum(near(i, j) for i in range(3) for j in range(3)) / 9
    return {
        "profile": profile, "high": share(profile[:, rings // 2 :].sum(1), profile.sum(1)), "cosine": share(total - low, total),
        "laplacian": np.abs(laplace).mean((1, 2)), "residual": (x - mean).std((1, 2)),
    }


def frequency(tiles: DataFrame, height: int, width: int, rings: int = RINGS) -> DataFrame:
    """E-10 for tiles(id, pixels); null where pixels are no tile."""

    def run(batches):
        import pyarrow as pa

        for ids, good, x in _tiles(batches, height, width):
            made = features(x, rings)
            where = np.cumsum(good) - 1
            one = lambda v: pa.array([float(v[k]) if g else None for g, k in zip(good, where, strict=True)], pa.float64())
            profile = pa.array([made["profile"][k] if g else None for g, k in zip(good, where, strict=True)], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([ids, one(made["high"]), profile, one(made["cosine"]), one(made["laplacian"]), one(made["residual"])], names=["id", "high", "profile", "cosine", "laplacian", "residual"])

    kind = dict(tiles.dtypes)["id"]
    return tiles.select("id", "pixels").mapInArrow(run, f"id {kind}, high double, profile array<double>, cosine double, laplacian double, residual double")
