"""Canonical length-limited Huffman codes over integer ids, on arrays."""

from __future__ import annotations

import numpy as np

LIMIT = 20  # bits of the longest code; a table of 2 ** LIMIT entries decodes
STEP = 256  # ids between two bit-offset checkpoints
_U = np.uint64


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Bits of each id's code by package-merge; 0 for ids that don't occur."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.int64)
    if len(used) < 2:
        out[used] = 1
        return out
    if len(used) > 1 << limit:
        raise ValueError("more ids than codes of that length")
    order = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[order].astype(np.int64)
    levels, merged = [], leaves
    kinds = np.ones(len(leaves), bool)
    for _ in range(limit):
        levels.append(kinds)
        pairs = len(merged) // 2
        packs = merged[0 : 2 * pairs : 2] + merged[1 : 2 * pairs : 2]
        both = np.concatenate((leaves, packs))
        rank = np.argsort(both, kind="stable")
        merged, kinds = both[rank], (rank < len(leaves))
    take = 2 * len(leaves) - 2
    lengths = np.zeros(len(leaves), np.int64)
    for kinds in reversed(levels):
        own = int(kinds[:take].sum())
        lengths[:own] += 1
        take = 2 * (take - own)
    out[order] = lengths
    return out


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Codes in order of (length, id): the lengths alone are enough to rebuild them."""
    codes = np.zeros(len(lengths), np.int64)
    code, last = 0, 0
    used = np.flatnonzero(lengths)
    order = used[np.lexsort((used, lengths[used]))]
    sizes = lengths[order]
    for bits in np.unique(sizes):
        own = order[sizes == bits]
        code <<= int(bits) - last
        codes[own] = code + np.arange(len(own))
        code, last = code + len(own), int(bits)
    return codes


def decode_table(lengths: np.ndarray, limit: int = LIMIT) -> tuple[np.ndarray, np.ndarray]:
    """Id and length for each value of the next ``limit`` bits."""
    codes = canonical(lengths)
    used = np.flatnonzero(lengths)
    order = used[np.argsort(codes[used] << (limit - lengths[used]), kind="stable")]
    width = np.int64(1) << (limit - lengths[order])
    ids, bits = np.zeros(1 << limit, np.uint32), np.ones(1 << limit, np.uint8)
    n = int(width.sum())
    ids[:n] = np.repeat(order, width)
    bits[:n] = np.repeat(lengths[order], width)
    return ids, bits


def pack(ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Big-endian 64-bit words with the codes one after another, and checkpoints."""
    size = lengths[ids]
    offset = np.concatenate(([0], np.cumsum(size)))
    words = np.zeros((int(offset[-1]) + 63) // 64 + 1, _U)
    at = offset[:-1]
    if len(ids):
        left = codes[ids].astype(_U) << (64 - size).astype(_U)
        where, shift = at >> 6, (at & 63).astype(_U)
        first = np.concatenate(([0], np.flatnonzero(np.diff(where)) + 1))
        words[where[first]] = np.bitwise_or.reduceat(left >> shift, first)
        over = np.flatnonzero((at & 63) + size > 64)
        words[where[over] + 1] |= (left[over] << _U(1)) << (_U(63) - shift[over])
    return words[:-1].astype(">u8").tobytes(), at[::STEP]


def unpack(blocks: list[tuple[bytes, np.ndarray, int]], table, limit: int = LIMIT) -> list[np.ndarray]:
    """Ids of (bits, checkpoints, number of ids) blocks; all their segments in step."""
    ids, bits = table
    words, base, starts, sizes = [], 0, [], []
    for data, marks, n in blocks:
        own = np.frombuffer(data, ">u8").astype(_U)
        words.append(own)
        starts.append(marks + base * 64)
        sizes.append(np.minimum(STEP, n - np.arange(len(marks)) * STEP))
        base += len(own)
    stream = np.concatenate([*words, np.zeros(2, _U)])
    at, left = np.concatenate(starts).astype(np.int64), np.concatenate(sizes)
    out = np.zeros((len(at), STEP), np.uint32)
    for k in range(int(left.max(initial=0))):
        place, shift = at >> 6, (at & 63).astype(_U)
        place = np.minimum(place, len(stream) - 2)
        ahead = (stream[place] << shift) | ((stream[place + 1] >> _U(1)) >> (_U(63) - shift))
        ahead >>= _U(64 - limit)
        out[:, k] = ids[ahead]
        at = at + bits[ahead]
    found, row = [], 0
    for _, marks, n in blocks:
        found.append(out[row : row + len(marks)].reshape(-1)[:n])
        row += len(marks)
    return found
