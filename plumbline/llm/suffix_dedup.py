"""Suffix-array deduplication of bytes by deep-shallow sorting.

Every byte that a ``LENGTH``-byte string covers which also starts anywhere else in the
corpus is removed (each text apart, the same text included, overlaps counted). Equal
texts are settled by their digests. For the others a sampled suffix array decides:
suffixes that begin at selected grams (see ``regions``), and the reversed prefixes
before them, are sorted per gram, and common prefixes of neighbours tell which
windows around the gram occur twice.

The sort is deep-shallow: multikey quicksort on four bytes at a time down to a shallow
depth, then blind tries (insertion by branching characters only, one comparison of
whole strings each) order the groups with longer common prefixes.

Edge cases: a null text is empty; a text under ``LENGTH`` bytes keeps all; repeated
rows are two places of one string, so both lose it; rows with a null doc_id, or with one
that other texts have too, take part like any other; empty tables give empty results;
other columns are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import regions, wordhash
from .shared import hand_over, materialize, scope, sweep

LENGTH = 400
GRAM = 200
SHALLOW = 64  # characters of four bytes: the gram and a little more


def multikey_quicksort(chars: np.ndarray, groups: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, bucket of each place in it); rows of one bucket agree on ``depth`` chars.

    All buckets are partitioned at once: less than, equal to and greater than the
    bucket's pivot; the equal part goes on with the next character."""
    order = np.argsort(groups, kind="stable")
    bucket = np.cumsum(np.concatenate(([0], np.diff(groups[order]) != 0)))
    at = np.zeros(len(order), np.int64)
    while len(order):
        first = np.concatenate(([0], np.flatnonzero(np.diff(bucket)) + 1))
        size = np.diff(np.append(first, len(order)))
        live = np.repeat((size > 1) & (at[first] < depth), size)
        if not live.any():
            break
        place = np.flatnonzero(live)
        pivot = np.repeat(order[first + size // 2], size)[place]
        level = at[place]
        own, other = chars[order[place], level], chars[pivot, level]
        side = np.where(own < other, 0, np.where(own == other, 1, 2))
        moved = np.argsort(bucket[place] * 3 + side, kind="stable")
        order[place] = order[place][moved]
        at[place] = (level + (side == 1))[moved]
        key = bucket * 3
        key[place] = (bucket[place] * 3 + side)[moved]
        bucket = np.cumsum(np.concatenate(([0], np.diff(key) != 0)))
    return order, bucket


def blind_trie_order(rows: np.ndarray, members: np.ndarray) -> list[int]:
    """Members in the order of their rows. Inner nodes are (depth, {character: node}),
    leaves are lists of equal members."""
    width = rows.shape[1]
    root = [int(members[0])]
    for x in map(int, members[1:]):
        own, node = rows[x], root
        while isinstance(node, tuple):  # blind: only branching characters are looked at
            node = node[1].get(int(own[node[0]])) or next(iter(node[1].values()))
        differ = own != rows[node[0]]
        at = int(differ.argmax()) if differ.any() else width
        if at == width:
            node.append(x)
            continue
        above, node = None, root
        while isinstance(node, tuple) and node[0] < at:
            above, node = node, node[1][int(own[node[0]])]
        if isinstance(node, tuple) and node[0] == at:
            node[1][int(own[at])] = [x]
            continue
        sample = node
        while isinstance(sample, tuple):
            sample = next(iter(sample[1].values()))
        split = (at, {int(rows[sample[0]][at]): node, int(own[at]): [x]})
        if above is None:
            root = split
        else:
            above[1][int(own[above[0]])] = split
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        if isinstance(node, tuple):
            stack.extend(node[1][c] for c in sorted(node[1], reverse=True))
        else:
            out.extend(node)
    return out


def deep_shallow_order(rows: np.ndarray, groups: np.ndarray, shallow: int = SHALLOW) -> np.ndarray:
    """Order of rows (a matrix of 16-bit symbols, zero-padded) within their groups."""
    n, width = rows.shape
    chars = np.zeros((n, -(-width // 4)), np.uint64)
    for j in range(width):
        chars[:, j // 4] |= rows[:, j].astype(np.uint64) << np.uint64(16 * (3 - j % 4))
    order, bucket = multikey_quicksort(chars, groups, min(shallow, chars.shape[1]))
    first = np.concatenate(([0], np.flatnonzero(np.diff(bucket)) + 1)) if n else np.zeros(0, int)
    size = np.diff(np.append(first, n))
    for a, k in zip(first[size > 1], size[size > 1], strict=True):
        order[a : a + k] = blind_trie_order(rows, order[a : a + k])
    return order


def _covered(spec: regions.Spec):
    """Runs of offsets whose window occurs twice, per distinct context."""

    def run(batches):
        import pyarrow as pa

        for frame in regions.grouped_batches(batches):
            g = frame["g"].to_numpy()
            new = np.concatenate(([True], g[1:] != g[:-1]))
            group = np.cumsum(new)
            alone = np.bincount(group)[group] == 1
            lo, hi = (frame[c].to_numpy(np.int64) for c in ("lo", "hi"))
            base = int(lo.min())
            flags = np.zeros((len(frame), int(hi.max()) - base + 1), bool)
            pick = np.flatnonzero(~alone)
            if len(pick):
                after = regions.matrix(frame["after"].iloc[pick].tolist(), 1, spec.length, False)
                before = regions.matrix(frame["before"].iloc[pick].tolist(), 1, spec.length, True)
                by_after = deep_shallow_order(after, group[pick])
                by_before = deep_shallow_order(before, group[pick])
                for o, rows, found in regions.window_classes(
                    before, after, by_before, by_after, group[pick], lo[pick], hi[pick], spec.length
                ):
                    twice = np.bincount(found)[found] > 1
                    flags[pick[rows[twice]], o - base] = True
            where, first, last = regions.runs(flags, base)
            columns = [frame[c].to_numpy(np.int64)[where] for c in ("g", "c1", "c2")]
            columns += [first.astype(np.int32), last.astype(np.int32)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["g", "c1", "c2", "first", "last"])

    return run


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, crowd: int = regions.CROWD) -> DataFrame:
    """(doc, key, whole, spans) of regions.nodes that lose bytes; whole ones, or byte spans."""
    spec = regions.Spec("byte", length, gram, (length - gram) // 2)
    with scope():
        docs = regions.nodes(docs)
        grams, classes = regions.scan(docs, spec)
        rows = regions.contexts(docs, regions.repeated(grams), spec)
        sweep(docs.sparkSession)
        unique = regions.unique_contexts(rows)
        few, crowded = regions.open_contexts(docs, unique, spec, crowd)
        found = few.mapInArrow(_covered(spec), "g long, c1 long, c2 long, first int, last int")
        windows = regions.crowd_windows(crowded, spec)
        twice = windows.groupBy("g", "o", "w").agg(F.sum("n").alias("all")).where(F.col("all") > 1).select("g", "o", "w")
        counted = windows.join(twice, ["g", "o", "w"]).select(
            "g", "c1", "c2", F.col("o").alias("first"), F.col("o").alias("last")
        )
        # a context that occurs twice covers all its windows; others as found
        twice = unique.where("n > 1").select("g", "c1", "c2", F.col("lo").alias("first"), F.col("hi").alias("last"))
        span = ["doc", "key", (F.col("pos") - F.col("last")).alias("a"), (F.col("pos") - F.col("first") + length).alias("b")]
        spans = rows.select("g", "c1", "c2", "doc", "key", "pos").join(found.union(counted).union(twice), ["g", "c1", "c2"]).select(*span)
        copies = classes.where((F.col("copies") > 1) & (F.col("size") >= length)).select("doc", "key").distinct()
        whole = copies.select("doc", "key", F.lit(True).alias("whole"), F.lit(None).cast("array<struct<a:long,b:long>>").alias("spans"))
        part = regions.listed_spans(spans).join(copies, ["doc", "key"], "left_anti").select("doc", "key", F.lit(False).alias("whole"), "spans")
        return hand_over(materialize(whole.union(part), "spans"))


def _remover(batches):
    import pyarrow as pa

    for batch in wordhash.small(batches):
        texts = wordhash.utf8(batch.column("text"))
        removed, counts, kept = [], [], []
        for text, whole, spans in zip(texts, batch.column("whole").to_pylist(), batch.column("spans").to_pylist(), strict=True):
            starts, ends = np.zeros(0, np.int64), np.zeros(0, np.int64)
            if whole:
                starts, ends = np.array([0]), np.array([len(text)])
            elif spans:
                a = np.array([(s["a"], s["b"]) for s in spans], np.int64)
                a = np.minimum(a, len(text))
                a = a[a[:, 0] < a[:, 1]]
                if len(a):
                    starts, ends = regions.merge(a[:, 0], a[:, 1])
            removed.append(int((ends - starts).sum()))
            counts.append(len(starts))
            kept.append(b"".join(text[a:b] for a, b in zip(np.append(0, ends), np.append(starts, len(text)), strict=True)))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(map(len, texts), pa.int64()), pa.array(removed, pa.int64()), pa.array(counts, pa.int64()), pa.array(kept, pa.binary())],
            names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"],
        )


def deduplicate(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept): kept holds the remaining bytes."""
    spans = repeated_spans(docs, **options)
    rows = regions.with_spans(docs.select("doc_id", "text"), spans).select("row.*", "whole", "spans")
    return rows.mapInArrow(_remover, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
