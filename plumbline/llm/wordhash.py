"""Vectorised words and word hashes of UTF-8 texts, for use inside tasks.

Words are maximal runs of bytes other than space and 0x09-0x0D. A word's 64-bit hash
does not depend on where the word stands, so texts can be handled piece by piece;
memory stays at a few arrays over one piece plus eight bytes a word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

PIECE = 1 << 19
_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (multiply and shift)."""
    x = x.astype(_U, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


_BYTES = mix(np.arange(1, 257, dtype=_U) * _U(0x9E3779B97F4A7C15))
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0xD1342543DE82EF95
_powers: list[np.ndarray] = [np.ones(1, _U), np.ones(1, _U)]


def _up_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    if len(_powers[0]) < n:
        size = max(n, PIECE + 1)
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base, _U)
            steps[0] = 1
            _powers[k] = np.cumprod(steps, dtype=_U)
    return _powers[0], _powers[1]


def _piece(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    raw = np.frombuffer(data, np.uint8)
    space = _SPACE[raw]
    edge = np.diff(np.concatenate(([True], space, [True])).astype(np.int8))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    power, inverse = _up_to(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, _U)
    np.cumsum(_BYTES[raw] * power[: len(raw)], out=sums[1:])
    own = (sums[end] - sums[start]) * inverse[start]
    return mix(own ^ ((end - start).astype(_U) * _U(0xA0761D6478BD642F))), start, end


def words(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first byte and end of every word."""
    if len(data) <= PIECE:
        return _piece(data)
    found, at = [], 0
    while at < len(data):
        cut = min(at + PIECE, len(data))
        if cut < len(data):  # back to a space, or on to the next one if there is none
            back = max(data.rfind(c, at, cut) for c in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c"))
            if back > at:
                cut = back
            else:
                later = [x for c in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c") if (x := data.find(c, cut)) >= 0]
                cut = min(later, default=len(data))
        h, s, e = _piece(data[at:cut])
        found.append((h, s + at, e + at))
        at = cut
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def grouped(texts: list[bytes]) -> Iterator[tuple[range, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Texts, many short ones at once: their numbers, word hashes, starts, ends (from
    the text's own start), and bounds so that text k of the group has words
    bounds[k]:bounds[k + 1]. A text longer than a piece is a group of its own."""
    k = 0
    while k < len(texts):
        last, size = k + 1, len(texts[k])
        while last < len(texts) and size + len(texts[last]) + 1 <= PIECE:
            size += len(texts[last]) + 1
            last += 1
        h, start, end = words(b" ".join(texts[k:last]))
        begins = np.cumsum([0] + [len(t) + 1 for t in texts[k:last]])
        bounds = np.searchsorted(start, begins)
        base = np.repeat(begins[:-1], np.diff(bounds))
        yield range(k, last), h, start - base, end - base, bounds
        k = last


def shingles(h: np.ndarray, bounds: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``size`` successive words of one text each, and their new bounds.
    A text of fewer words, but not none, has the hash of all its words."""
    counts = np.diff(bounds)
    if len(h) >= size:
        joined = np.zeros(len(h) - size + 1, _U)
        for j in range(size):
            joined = mix(joined + h[j : len(h) - size + 1 + j])
    else:
        joined = np.zeros(0, _U)
    whole = counts >= size
    new = np.zeros(len(bounds), np.int64)
    new[1:] = np.cumsum(np.where(whole, counts - size + 1, np.minimum(counts, 1)))
    out = np.zeros(new[-1], _U)
    first = np.repeat(bounds[:-1], np.diff(new)) + np.arange(new[-1]) - np.repeat(new[:-1], np.diff(new))
    full = np.repeat(whole, np.diff(new))
    out[full] = joined[first[full]]
    for k in np.flatnonzero((counts > 0) & ~whole):
        x = np.full(1, counts[k], _U)
        for w in h[bounds[k] : bounds[k + 1]]:
            x = mix(x + w)
        out[new[k]] = mix(x ^ _U(0x5851F42D4C957F2D))[0]
    return out, new


def small(batches, size: int = 1 << 22):
    """Slices of Arrow batches of about ``size`` bytes, a row at least: what Python makes
    of a batch is several times as large."""
    for batch in batches:
        step = max(1, batch.num_rows * size // max(batch.nbytes, 1))
        for k in range(0, batch.num_rows, step):
            yield batch.slice(k, step)


def utf8(column) -> list[bytes]:
    """The bytes of an Arrow string column; null is empty."""
    import pyarrow as pa

    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]
