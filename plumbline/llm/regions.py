"""Repeated windows of fixed length over a whole corpus, found by sampled positions.

A document is a row of elements (bytes, or word hashes). Every window of ``length``
elements selects the gram of ``gram`` elements with the smallest hash in it, the last
one on ties. The choice depends on the window alone, so equal windows select equal
grams at equal offsets, and it is enough to compare windows around equal grams. One
selected gram stands for a whole run of windows: about 2 rows per
``length - gram`` elements leave the scan, not one per element.

The tables made here, in order:

* ``scan``: selected grams of one document of each class of equal ones.
* ``repeated``: those that occur at least twice, by document.
* ``contexts``: those grams with a digest of the elements that their windows touch.
* ``unique``: distinct contexts of a gram with their number; a gram inside a passage
  that a third of all documents share has one row here.
* ``open``: contexts of grams with several ones, with their elements; they go from the
  documents straight to the tasks of their grams.

The callers decide which windows of a context count and get spans per document back.
A gram with more than ``crowd`` distinct contexts is not gathered into a task: its
windows are counted as rows of an aggregation instead, with the same result for equal
windows; ``passage_dedup`` finds near ones of such grams in parts.

A document is known by (doc, key), see ``nodes``: rows that share a doc_id or have none
keep their own spans.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import wordhash
from .shared import discard, materialize, packed, sized

_U = np.uint64
_MASK = _U((1 << 20) - 1)
PIECE = 1 << 19
CROWD = 20_000


#: stands for a null doc_id, after all others
LAST = (1 << 63) - 1


def _node() -> tuple:
    return F.coalesce("doc_id", F.lit(LAST)).alias("doc"), F.xxhash64("text", "doc_id").alias("key")


def nodes(docs: DataFrame) -> DataFrame:
    """(doc, key, text): doc is doc_id or LAST; key tells texts of one doc apart."""
    return docs.select(*_node(), "text")


@dataclass(frozen=True)
class Spec:
    unit: str  # "byte" or "word"
    length: int
    gram: int
    side: int  # elements beside a gram that two windows around it surely share: half the rest at most
    bands: int = 1

    @property
    def width(self) -> int:  # bytes an element takes in a context
        return 1 if self.unit == "byte" else 8


def _byte_grams(raw: np.ndarray, size: int) -> np.ndarray:
    power, inverse = wordhash._up_to(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, _U)
    np.cumsum(wordhash._BYTES[raw] * power[: len(raw)], out=sums[1:])
    n = len(raw) - size + 1
    return wordhash.mix((sums[size:] - sums[:n]) * inverse[:n])


def _word_grams(h: np.ndarray, size: int) -> np.ndarray:
    n = len(h) - size + 1
    out = np.zeros(n, _U)
    for j in range(size):
        out = wordhash.mix(out + h[j : j + n])
    return out


def _selected(grams: np.ndarray, ends: np.ndarray, spec: Spec):
    """Runs of windows: selected position, first and last window start.

    ends: for each window start, the end of its document in elements."""
    n = len(ends) - spec.length + 1
    if n <= 0:
        return np.zeros((3, 0), np.int64)
    span = spec.length - spec.gram + 1
    key = (grams & ~_MASK) | (_MASK - np.arange(len(grams), dtype=_U))
    low, have = key, 1
    while have * 2 <= span:
        low = np.minimum(low[:-have], low[have:])
        have *= 2
    low = np.minimum(low[:n], low[span - have : span - have + n])
    at = (_MASK - (low & _MASK)).astype(np.int64)
    starts = np.flatnonzero(np.arange(n) + spec.length <= ends[:n])
    if not len(starts):
        return np.zeros((3, 0), np.int64)
    new = np.flatnonzero(np.concatenate(([True], (np.diff(at[starts]) != 0) | (np.diff(starts) != 1))))
    last = np.append(new[1:], len(starts)) - 1
    return np.stack([at[starts[new]], starts[new], starts[last]])


def _pieces(elements: np.ndarray, bounds: np.ndarray, spec: Spec):
    """(gram, document, position in it, lowest and highest offset) arrays."""
    total = len(elements)
    for a in range(0, max(total - spec.length + 1, 0), PIECE):
        part = elements[a : a + PIECE + spec.length - 1]
        grams = (_byte_grams if spec.unit == "byte" else _word_grams)(part, spec.gram)
        where = np.searchsorted(bounds, np.arange(a, a + len(part)), "right") - 1
        ends = bounds[where + 1] - a
        for band in range(spec.bands):
            own = grams if not band else wordhash.mix(grams ^ _U(0x9E3779B97F4A7C15 * band % (1 << 64)))
            at, first, last = _selected(own, ends, spec)
            doc = where[at]
            yield own[at], doc, at + a - bounds[doc], (at - last), (at - first)


def _elements(texts: list[bytes], spec: Spec):
    """(numbers, elements, bounds) of groups of texts."""
    if spec.unit == "word":
        for rows, h, _, _, bounds in wordhash.grouped([t.lower() for t in texts]):
            yield rows, h, bounds
        return
    k = 0
    while k < len(texts):
        last, size = k + 1, len(texts[k])
        while last < len(texts) and size + len(texts[last]) <= PIECE:
            size += len(texts[last])
            last += 1
        yield range(k, last), np.frombuffer(b"".join(texts[k:last]), np.uint8), np.cumsum([0] + [len(t) for t in texts[k:last]])
        k = last


def _scanner(spec: Spec):
    def run(batches):
        import pyarrow as pa
        import xxhash

        seen = set()
        lists = [("g", pa.int64()), ("pos", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32())]
        schema = pa.schema(
            [(n, pa.int64()) for n in ("doc", "key", "size", "d1", "d2")]
            + [(n, pa.list_(t)) for n, t in lists]
        )
        for batch in wordhash.small(batches):
            texts = wordhash.utf8(batch.column("text"))
            sizes, digests, grams = [], [], []
            for rows, elements, bounds in _elements(texts, spec):
                found = [np.concatenate(x) for x in zip(*_pieces(elements, bounds, spec), strict=True)] or [np.zeros(0, np.int64)] * 5
                order = np.argsort(found[1], kind="stable")
                cut = np.searchsorted(found[1][order], np.arange(len(rows) + 1))
                for k in range(len(rows)):
                    own = elements[bounds[k] : bounds[k + 1]]
                    x = xxhash.xxh3_128_intdigest(own.tobytes())
                    new = x not in seen
                    if new:
                        seen.add(x)
                    sizes.append(len(own))
                    digests.append(((x >> 64) - (1 << 63), (x & ((1 << 64) - 1)) - (1 << 63)))
                    pick = order[cut[k] : cut[k + 1]] if new else None
                    grams.append(None if pick is None else (found[0][pick].view(np.int64), found[2][pick], found[3][pick].astype(np.int32), found[4][pick].astype(np.int32)))
            columns = [batch.column("doc"), batch.column("key"), pa.array(sizes, pa.int64()), pa.array([d[0] for d in digests], pa.int64()), pa.array([d[1] for d in digests], pa.int64())]
            columns += [pa.array([None if g is None else g[j] for g in grams], pa.list_(t)) for j, (_, t) in enumerate(lists)]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return run


def scan(docs: DataFrame, spec: Spec) -> tuple[DataFrame, DataFrame]:
    """(grams, classes) of nodes: the selected grams of one document of each class of equal
    ones, and classes(doc, key, size, rep, copies) with one row per document."""
    table = docs.mapInArrow(
        _scanner(spec), "doc long, key long, size long, d1 long, d2 long, g array<long>, pos array<long>, lo array<int>, hi array<int>"
    )
    table = materialize(table, "scan")
    own = F.struct("doc", "key")
    same = table.groupBy("d1", "d2", "size").agg(
        F.min(own).alias("rep"),
        F.count(F.lit(1)).alias("copies"),
        F.min(F.when(F.col("g").isNotNull(), own)).alias("holder"),
    )
    classes = materialize(table.select("doc", "key", "size", "d1", "d2").join(same, ["d1", "d2", "size"]), "classes")
    holders = classes.where(own == F.col("holder")).select("doc", "key", "rep").distinct()
    grams = table.where("g is not null").join(holders, ["doc", "key"]).select("rep.doc", "rep.key", F.arrays_zip("g", "pos", "lo", "hi").alias("at"))
    grams = materialize(grams, "grams")
    discard(table)
    return grams, classes


def repeated(grams: DataFrame) -> DataFrame:
    """(doc, key, at): the grams of each document that occur twice or more in all.

    Their list is written first, so that a gram of very many documents joins as a
    broadcast, or as a side that is split where it is skewed."""
    rows = grams.select("doc", "key", F.explode("at").alias("a")).select("doc", "key", "a.*")
    twice = materialize(rows.groupBy("g").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("g"), "twice")
    found = rows.join(sized(twice), "g").groupBy("doc", "key").agg(F.collect_list(F.struct("g", "pos", "lo", "hi")).alias("at"))
    found = materialize(found, "repeated")
    discard(grams, twice)
    return found


_PLACE = [("g", "long"), ("doc", "long"), ("key", "long"), ("pos", "long"), ("lo", "int"), ("hi", "int"), ("c1", "long"), ("c2", "long")]
_NEAR = [("l", "long"), ("r", "long")]
_WHOLE = [("n", "long"), ("before", "binary"), ("after", "binary")]


def _range_digests(values: np.ndarray):
    """A function of arrays (from, to): 64-bit digests of those ranges of values."""
    power, inverse = wordhash._up_to(len(values) + 1)
    sums = np.zeros(len(values) + 1, _U)
    np.cumsum(values * power[: len(values)], out=sums[1:])
    return lambda a, b: wordhash.mix((sums[b] - sums[a]) * inverse[a] + (b - a).astype(_U))


def _slices(values: np.ndarray, a: np.ndarray, b: np.ndarray):
    """Arrow binaries of the ranges a[k]:b[k] of values."""
    import pyarrow as pa

    w, size = values.itemsize, b - a
    ends = np.cumsum(size)
    at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(a - (ends - size), size)
    offsets = np.concatenate(([0], ends * w)).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(a), [None, pa.py_buffer(offsets), pa.py_buffer(values[at])])


def _cutter(spec: Spec, whole: bool):
    """Rows of contexts: the elements that a gram's windows touch, before and from it
    on, as a digest or whole; and digests of the gram with ``side`` elements before or
    after it (null where the document ends sooner)."""

    def run(batches):
        import pyarrow as pa

        fields = [*_PLACE, *_NEAR, *(_WHOLE if whole else [])]
        kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
        schema = pa.schema([(name, kinds[kind]) for name, kind in fields])
        for batch in wordhash.small(batches):
            ids = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("doc", "key")]
            listed = batch.column("at")
            flat, cut = listed.flatten(), np.concatenate(([0], np.cumsum(listed.value_lengths().to_numpy(zero_copy_only=False))))
            every = {flat.type.field(k).name: flat.field(k).to_numpy(zero_copy_only=False) for k in range(flat.type.num_fields)}
            texts = wordhash.utf8(batch.column("text"))
            for rows, elements, bounds in _elements(texts, spec):
                first, last = cut[rows[0]], cut[rows[-1] + 1]
                at = {c: v[first:last] for c, v in every.items()}
                own = np.repeat(np.arange(len(rows)), np.diff(cut[rows[0] : rows[-1] + 2]))
                begin, end, lo, hi = bounds[own], bounds[own + 1], at["lo"].astype(np.int64), at["hi"].astype(np.int64)
                values = wordhash._BYTES[elements] if spec.unit == "byte" else elements
                one, two = _range_digests(values), _range_digests(wordhash.mix(values ^ _U(0x5851F42D4C957F2D)))
                for k in range(0, len(own), 1 << 14):
                    p = slice(k, k + (1 << 14))
                    pos = begin[p] + at["pos"][p]
                    a, b = pos - hi[p], pos + spec.length - lo[p]
                    form = wordhash.mix((lo[p] * spec.length + hi[p]).astype(_U))
                    before, after = pos - spec.side, pos + spec.gram + spec.side
                    columns = [
                        at["g"][p], ids[0][rows[0] + own[p]], ids[1][rows[0] + own[p]], at["pos"][p], at["lo"][p], at["hi"][p],
                        (one(a, b) ^ form).view(np.int64), (two(a, b) ^ form).view(np.int64),
                    ]
                    columns = [pa.array(c, t) for c, t in zip(columns, schema.types, strict=False)]
                    columns += [
                        pa.array(one(np.maximum(before, 0), pos + spec.gram).view(np.int64), mask=before < begin[p]),
                        pa.array(one(pos, np.minimum(after, len(values))).view(np.int64), mask=after > end[p]),
                    ]
                    if whole:
                        columns += [pa.array(at["n"][p], pa.int64()), _slices(elements, a, pos), _slices(elements, pos, b)]
                    yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return run


def _at_places(docs: DataFrame, places: DataFrame, spec: Spec, whole: bool) -> DataFrame:
    """Contexts at places(doc, key, at); only documents that have any are read on."""
    texts = docs.join(sized(places.select("doc", "key")), ["doc", "key"], "left_semi").join(places, ["doc", "key"])
    fields = [*_PLACE, *_NEAR, *(_WHOLE if whole else [])]
    return texts.mapInArrow(_cutter(spec, whole), ", ".join(f"{name} {kind}" for name, kind in fields))


def contexts(docs: DataFrame, places: DataFrame, spec: Spec) -> DataFrame:
    """One row per repeated gram of docs, its context as a digest."""
    rows = materialize(_at_places(docs, places, spec, False), "contexts")
    discard(places)
    return rows


def unique_contexts(rows: DataFrame) -> DataFrame:
    """One row per distinct context of a gram: its number and earliest place."""
    slim = rows.groupBy("g", "c1", "c2").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("doc", "key", "pos")).alias("e"),
        F.min("lo").alias("lo"), F.min("hi").alias("hi"), F.min("l").alias("l"), F.min("r").alias("r"),
    )
    return materialize(slim, "unique")


def open_contexts(docs: DataFrame, unique: DataFrame, spec: Spec, crowd: int, near: bool = False) -> tuple[DataFrame, DataFrame]:
    """(few, crowded): the contexts, as a whole, of those that may share a window with
    another one; of ordinary grams, dealt out and sorted for grouped_batches, and of
    grams with more than ``crowd`` of them.

    A window around a gram holds the gram and ``side`` elements more before it or after
    it, so a context that shares neither with another context shares no window. With
    near, windows need not be equal, and all contexts of grams with several ones stay."""
    slim = unique.select("g", "c1", "c2", "n", "e.doc", "e.key", "e.pos", "lo", "hi", "l", "r")
    if near:
        several = materialize(unique.groupBy("g").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("g"), "several")
        some = slim.join(sized(several), "g")
    else:
        sides = unique.select("g", F.explode(F.array(F.struct(F.lit(0).alias("s"), F.col("l").alias("k")), F.struct(F.lit(1).alias("s"), F.col("r").alias("k")))).alias("x"))
        shared = sides.where("x.k is not null").groupBy("g", "x.s", "x.k").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
        left = shared.where("s = 0").select("g", F.col("k").alias("l"), F.lit(True).alias("in_l"))
        right = shared.where("s = 1").select("g", F.col("k").alias("r"), F.lit(True).alias("in_r"))
        some = slim.join(left, ["g", "l"], "left").join(right, ["g", "r"], "left").where("in_l or in_r")
    some = materialize(some.select("g", "doc", "key", "pos", "lo", "hi", "n"), "some")
    many = materialize(some.groupBy("g").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > crowd).select("g"), "crowded")
    listed = lambda rows: materialize(rows.groupBy("doc", "key").agg(F.collect_list(F.struct("g", "pos", "lo", "hi", "n")).alias("at")), "places")
    parts = int(unique.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    few = _at_places(docs, listed(some.join(sized(many), "g", "left_anti")), spec, True)
    few = few.select("g", "c1", "c2", "n", "doc", "key", "pos", "lo", "hi", "before", "after").repartition(parts, "g").sortWithinPartitions("g")
    columns = ", ".join(f"{name} {kind}" for name, kind in [*_PLACE, *_NEAR, *_WHOLE])
    if many.isEmpty():
        return few, unique.sparkSession.createDataFrame([], columns)
    return few, materialize(_at_places(docs, listed(some.join(sized(many), "g", "left_semi")), spec, True), "open")


def grouped_batches(batches, column: str = "g", rows: int = 4096):
    """Pandas frames of whole groups from a stream sorted by ``column``."""
    import pandas as pd

    held = None
    for batch in batches:
        frame = batch.to_pandas()
        frame = frame if held is None else pd.concat([held, frame], ignore_index=True)
        if not len(frame):
            continue
        keys = frame[column].to_numpy()
        at = 0
        while True:
            end = min(at + rows, len(keys))
            if end < len(keys):
                end = int(np.searchsorted(keys, keys[end - 1], "right"))
            if end >= len(keys):
                break
            yield frame.iloc[at:end].reset_index(drop=True)
            at = end
        # the last group may go on in the next batch
        start = max(at, int(np.searchsorted(keys, keys[-1], "left")))
        if start > at:
            yield frame.iloc[at:start].reset_index(drop=True)
        held = frame.iloc[start:].reset_index(drop=True)
    if held is not None and len(held):
        yield held


def matrix(values: list[bytes], width: int, columns: int, reverse: bool) -> np.ndarray:
    """A row of elements plus one for each value, zero-padded on the right."""
    kind = np.uint16 if width == 1 else _U
    out = np.zeros((len(values), columns), kind)
    for k, v in enumerate(values):
        row = np.frombuffer(v, np.uint8 if width == 1 else _U)
        row = row[::-1] if reverse else row
        out[k, : len(row)] = row
        if width == 1:
            out[k, : len(row)] += 1
    return out


def lcp(sorted_rows: np.ndarray, groups: np.ndarray) -> np.ndarray:
    """Common prefix of each row and the one before; -1 where a group begins."""
    out = np.full(len(groups), -1, np.int64)
    if len(groups) > 1:
        differ = sorted_rows[1:] != sorted_rows[:-1]
        out[1:] = np.where(differ.any(1), differ.argmax(1), sorted_rows.shape[1])
        out[1:][groups[1:] != groups[:-1]] = -1
    return out


def window_classes(before, after, order_before, order_after, groups, lo, hi, length):
    """Yields (offset, eligible rows, class of each): equal classes are equal windows.

    Rows of one class at offset o agree on o elements before and length - o after."""
    n = len(groups)
    common_a = lcp(after[order_after], groups[order_after])
    common_b = lcp(before[order_before], groups[order_before])
    for o in range(int(lo.min()), int(hi.max()) + 1):
        rows = np.flatnonzero((lo <= o) & (o <= hi))
        if len(rows) < 2:
            continue
        class_a, class_b = np.empty(n, np.int64), np.empty(n, np.int64)
        class_a[order_after] = np.cumsum(common_a < length - o)
        class_b[order_before] = np.cumsum(common_b < o)
        _, found = np.unique(class_a[rows] * (n + 1) + class_b[rows], return_inverse=True)
        yield o, rows, found


def runs(flags: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first, last) of the maximal runs of true values in each row, counted from base."""
    none = np.zeros((len(flags), 1), np.int8)
    edge = np.diff(np.concatenate((none, flags.astype(np.int8), none), axis=1), axis=1)
    row, first = np.nonzero(edge == 1)
    return row, first + base, np.nonzero(edge == -1)[1] - 1 + base


def crowd_windows(crowded: DataFrame, spec: Spec) -> DataFrame:
    """(g, c1, c2, o, w, n, doc, key, pos): each window of a crowded gram by its digest w."""
    whole = F.concat("before", "after")
    at = ((F.col("hi") - F.col("o")) * spec.width + 1).cast("int")
    rows = crowded.withColumn("o", F.explode(F.sequence("lo", "hi")))
    window = F.substring(whole, at, F.lit(spec.length * spec.width))
    return rows.select("g", "c1", "c2", "o", F.md5(window).alias("w"), "n", "doc", "key", "pos")


def listed_spans(spans: DataFrame) -> DataFrame:
    """(doc, key, spans): unions of the (a, b) rows of each document."""
    before = W.partitionBy("doc", "key").orderBy("a").rowsBetween(W.unboundedPreceding, -1)
    new = F.coalesce(F.col("a") > F.max("b").over(before), F.lit(True)).cast("int")
    island = spans.select("doc", "key", "a", "b", new.alias("new"))
    upto = W.partitionBy("doc", "key").orderBy("a").rowsBetween(W.unboundedPreceding, 0)
    island = island.withColumn("k", F.sum("new").over(upto)).groupBy("doc", "key", "k").agg(F.min("a").alias("a"), F.max("b").alias("b"))
    return island.groupBy("doc", "key").agg(F.collect_list(F.struct("a", "b")).alias("spans"))


def with_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """(row, whole, spans): each row of docs as a struct with its node's spans; spans is a written table."""
    weight = F.lit(1) + F.coalesce(F.size("spans"), F.lit(0))
    rows = docs.select(packed(docs.columns), *_node())
    return rows.join(sized(spans, weight=weight), ["doc", "key"], "left").select("row", "whole", "spans")


def merge(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unions of touching or overlapping spans, sorted."""
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    new = np.concatenate(([True], starts[1:] > ends[:-1]))
    last = np.append(np.flatnonzero(new)[1:] - 1, len(starts) - 1)
    return starts[new], ends[last]
