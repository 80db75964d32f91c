"""Substring deduplication by paragraph MinHash banding.

A paragraph is a window of ``LENGTH`` words at any place of a text, over line breaks
as well, so that a passage is found inside whatever paragraph it was put into. Its
MinHash values are the smallest hashes of its five-word shingles under ``BANDS`` hash
functions, and each value is a band of its own: at Jaccard 0.75 a window is met with
probability 1 - 0.25 ** BANDS (0.94 for two), at 1 always, and neighbouring windows
add further chances. Successive windows share their minimum, so the scan lists about
two rows a band for every 45 words, not one for each window.

Two windows are compared if they select the same gram at the same offset, at every
offset that both contexts have: equal words (in classes of equal windows, for any number
of copies), or exact Jaccard of shingles of at least 0.75. All such pairs are found:
stars around the earliest windows first, then the pairs across components that share a
shingle among the rarest of each. Of the windows that links reach from one another (over
all bands and grams) the earliest by (doc_id, position) stays and the others are removed.
Contexts of a gram with more than ``crowd`` of them meet in parts, any two in one of them
(after those go that share too few shingles with others), so work on near copies of a
passage beyond that number grows with its square over ``crowd``. Equal
documents of at least ``LENGTH`` words are one component: the smallest doc_id stays.
Only words inside such windows go, all of them: where windows overlap, as in a text that
repeats one word, those before the first repeat stay. Texts without such a window stay as
they are, byte for byte.

Edge cases: a null text has no words and stays null; a text under ``LENGTH`` words
stays; repeated rows are equal documents with one id, and stay, as the row that is
kept cannot be told apart; rows with a null doc_id come after all others; rows that share
a doc_id and differ in text are places of their own; empty tables give empty results;
further columns, whatever their names, are returned by ``drop_repeats`` and not read
otherwise.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import regions, wordhash
from .shared import connected_components, discard, hand_over, materialize, scope, sized, sweep

LENGTH = 50
SHINGLE = 5
BANDS = 2
PERCENT = 75
HALF = LENGTH - SHINGLE  # most words of a window before its gram
PAIRS = 1 << 14  # compared at once
STARS = 3


def _aligned(before, after, grp, lo, hi):
    """(numbers of the shingles of each context, offsets at which a near copy is possible).

    Column k of both is counted from the gram, so the window at offset o has columns
    HALF - o to 2 * HALF - o; -1 is no shingle. A window in which fewer than PERCENT of
    the shingles occur in another context of its gram has no near copy."""
    words = np.concatenate([before[:, :HALF][:, ::-1], after], axis=1)
    grams = np.zeros((len(words), 2 * HALF + 1), np.uint64)
    for j in range(SHINGLE):
        grams = wordhash.mix(grams + words[:, j : j + 2 * HALF + 1])
    grams = wordhash.mix(grams ^ (grp.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))[:, None])
    place = np.arange(-HALF, HALF + 1)
    row, col = np.nonzero((place >= -hi[:, None]) & (place <= HALF - lo[:, None]))
    values = grams[row, col]
    order = np.argsort(values, kind="stable")
    differ = values[order][1:] != values[order][:-1]
    number = np.concatenate(([0], np.cumsum(differ)))
    again = np.concatenate(([False], ~differ & (row[order][1:] == row[order][:-1])))
    several = (np.bincount(number[~again]) > 1)[number]
    codes = np.full(grams.shape, -1, np.int32)
    codes[row[order], col[order]] = number
    shared = np.zeros((len(words), 2 * HALF + 2), np.int32)
    shared[row[order], col[order] + 1] = several
    shared = np.cumsum(shared, axis=1)
    repeats = np.bincount(row[order][again], minlength=len(words))
    offsets = np.arange(HALF + 1)
    met = shared[:, 2 * HALF + 1 - offsets] - shared[:, HALF - offsets]
    return codes, 100 * met >= PERCENT * (HALF + 1 - repeats)[:, None]


def _near(sets, size, a, b) -> np.ndarray:
    """Exact Jaccard of the pairs of sets a[k], b[k] of at least PERCENT."""
    out = np.zeros(len(a), bool)
    for k in range(0, len(a), PAIRS):
        x, y = a[k : k + PAIRS], b[k : k + PAIRS]
        both = np.sort(np.concatenate([sets[x], sets[y]], axis=1), axis=1)
        met = ((both[:, 1:] == both[:, :-1]) & (both[:, 1:] >= 0)).sum(1)
        out[k : k + PAIRS] = 100 * met >= PERCENT * (size[x] + size[y] - met)
    return out


def _tie(label, a, b) -> np.ndarray:
    """label, the least member of each component, after the links a[k], b[k]."""
    while True:
        x, y = label[a], label[b]
        if (x == y).all():
            return label
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (label[label] != label).any():
            label = label[label]


def _components(sets, size, grp) -> np.ndarray:
    """The least row that links of near sets within a group reach from each row.

    Stars around the first rows first; then every pair across components whose sets
    share a shingle among their rarest ones, which all near sets do."""
    n, label = len(sets), np.arange(len(sets))
    left = label
    for _ in range(STARS):
        lead = np.full(grp.max() + 1, n)
        np.minimum.at(lead, grp[left], left)
        leads = lead[grp[left]]
        near = (leads == left) | _near(sets, size, leads, left)
        label = _tie(label, leads[near], left[near])
        left = left[~near]
        if not len(left):
            break
    low, high = np.full(grp.max() + 1, n), np.zeros(grp.max() + 1, np.int64)
    np.minimum.at(low, grp, label)
    np.maximum.at(high, grp, label)
    live = np.flatnonzero((low < high)[grp])
    if not len(live):
        return label
    own, m = sets[live], size[live]
    count = np.bincount(own[own >= 0])
    key = np.where(own >= 0, count[own] * np.int64(len(count)) + own, np.iinfo(np.int64).max)
    own = np.take_along_axis(own, np.argsort(key, axis=1), axis=1)
    row, at = np.nonzero(np.arange(own.shape[1]) < (m + PERCENT * -m // 100 + 1)[:, None])
    code = own[row, at]
    order = np.argsort(code, kind="stable")
    row, at, code = row[order], at[order], code[order]
    end = np.searchsorted(code, code, "right")
    k, step = np.arange(len(code)), 1
    while len(k := k[k + step < end[k]]):
        x, y = row[k], row[k + step]
        # nothing before the first shared shingle is shared
        rest = np.minimum(m[x] - at[k], m[y] - at[k + step])
        pick = (label[live[x]] != label[live[y]]) & ((100 + PERCENT) * rest >= PERCENT * (m[x] + m[y]))
        x, y = live[x[pick]], live[y[pick]]
        near = _near(sets, size, x, y)
        label = _tie(label, x[near], y[near])
        step += 1
    return label


def _links(codes, o, rows, grp):
    """The first row of the component of each of rows, different windows in their order."""
    sets = np.sort(codes[rows, HALF - o : 2 * HALF + 1 - o], axis=1)
    sets[:, 1:][sets[:, 1:] == sets[:, :-1]] = -1
    size = (sets >= 0).sum(1)
    several = np.bincount(sets[sets >= 0]) > 1
    keep = np.flatnonzero(100 * (several[sets] & (sets >= 0)).sum(1) >= PERCENT * size)
    first = rows.copy()
    if len(keep) > 1:
        first[keep] = rows[keep[_components(sets[keep], size[keep], grp[rows[keep]])]]
    return first


_FOUND = "doc long, key long, pos long, first int, last int, to_doc long, to_key long, to_start long"


def _later(spec: regions.Spec, parts: bool = False):
    """Runs of offsets at which a context's first place repeats an earlier window of its
    gram, equal or near; and links (doc, key, pos, to_doc, to_key, to_start) from the
    start of each near copy to that of the earliest of its component.

    A window stands for all equal ones. With parts, groups are parts of a gram's
    contexts, so equal windows are linked as well if they have a near copy."""

    def run(batches):
        import pyarrow as pa

        names = [c.split()[0] for c in _FOUND.split(", ")]
        kinds = [pa.int32() if c in ("first", "last") else pa.int64() for c in names]
        schema = pa.schema(list(zip(names, kinds, strict=True)))
        rows_of = lambda n, given: pa.RecordBatch.from_arrays(
            [pa.array(given[c], t) if c in given else pa.nulls(n, t) for c, t in zip(names, kinds, strict=True)], schema=schema
        )
        for frame in regions.grouped_batches(batches):
            g = frame["g"].to_numpy()
            group = np.cumsum(np.concatenate(([True], g[1:] != g[:-1])))
            pick = np.flatnonzero(np.bincount(group)[group] > 1)
            if not len(pick):
                continue
            part, grp = frame.iloc[pick], group[pick]
            lo, hi, doc, key, pos = (part[c].to_numpy(np.int64) for c in ("lo", "hi", "doc", "key", "pos"))
            rank = np.empty(len(part), np.int64)
            rank[np.lexsort((pos, key, doc))] = np.arange(len(part))
            after = regions.matrix(part["after"].tolist(), 8, spec.length, False)
            before = regions.matrix(part["before"].tolist(), 8, spec.length, True)
            codes, possible = _aligned(before, after, grp, lo, hi)
            by_after = np.lexsort((*after.T[::-1], grp))
            by_before = np.lexsort((*before.T[::-1], grp))
            base = int(lo.min())
            flags = np.zeros((len(part), int(hi.max()) - base + 1), bool)
            for o, rows, found in regions.window_classes(before, after, by_before, by_after, grp, lo, hi, spec.length):
                least = np.full(found.max() + 1, len(part))
                np.minimum.at(least, found, rank[rows])
                later = rank[rows] > least[found]
                flags[rows[later], o - base] = True
                firsts = rows[~later & possible[rows, o]]
                firsts = firsts[np.argsort(rank[firsts])]
                if len(firsts) < 2:
                    continue
                root = _links(codes, o, firsts, grp)
                if parts:
                    tied = np.zeros(len(part), bool)
                    tied[firsts[root != firsts]] = tied[root[root != firsts]] = True
                    of = rows[~later][np.argsort(found[~later])][found]  # the first row of each class
                    copies = later & tied[of]
                    firsts, root = np.append(firsts, rows[copies]), np.append(root, of[copies])
                a, b = firsts[root != firsts], root[root != firsts]
                flags[a, o - base] = True
                if len(a):
                    yield rows_of(len(a), {"doc": doc[a], "key": key[a], "pos": pos[a] - o, "to_doc": doc[b], "to_key": key[b], "to_start": pos[b] - o})
            where, first, last = regions.runs(flags, base)
            if len(where):
                yield rows_of(len(where), {"doc": doc[where], "key": key[where], "pos": pos[where], "first": first, "last": last})

    return run


def _exploded(batches):
    """Distinct shingles of each context, and the number that a near copy has to share."""
    import pyarrow as pa

    for batch in batches:
        out: list[tuple] = []
        rows = batch.to_pylist()
        for r in rows:
            s = regions._word_grams(np.frombuffer(r["before"] + r["after"], np.uint64), SHINGLE)
            own = np.unique(s)
            need = PERCENT * (HALF + 1 - (len(s) - len(own)))
            out += [(r["g"], r["c1"], r["c2"], need, x) for x in own.view(np.int64).tolist()]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["g", "c1", "c2", "need", "s"])


def _crowd_parts(crowded: DataFrame, crowd: int) -> DataFrame:
    """Contexts of crowded grams that may have near copies, in parts of about ``crowd``
    such that any two contexts of a gram meet in one of them.

    What goes has too few shingles that another context of its gram has as well."""
    each = crowded.select("g", "c1", "c2", "before", "after").mapInArrow(_exploded, "g long, c1 long, c2 long, need long, s long")
    each = materialize(each, "shingles")
    counts = materialize(each.groupBy("g", "s").agg(F.count(F.lit(1)).alias("c")).where("c > 1"), "shared")
    hot = counts.where(F.col("c") > crowd).select("g", "s", F.lit(True).alias("hot"))
    marked = each.join(sized(hot), ["g", "s"], "left")
    cold = marked.where("hot is null").drop("hot").join(counts.where(F.col("c") <= crowd).select("g", "s"), ["g", "s"])
    met = marked.where("hot").drop("hot").unionByName(cold).groupBy("g", "c1", "c2", "need").agg(F.count(F.lit(1)).alias("m"))
    some = materialize(met.where("100 * m >= need").select("g", "c1", "c2"), "candidates")
    discard(each)
    discard(counts)
    blocks = some.groupBy("g").agg(F.ceil(F.count(F.lit(1)) / F.lit(max(crowd // 2, 1))).cast("int").alias("k"))
    own = F.pmod(F.xxhash64("c1", "c2"), F.col("k")).cast("int")
    rows = some.join(sized(materialize(blocks, "blocks")), "g").withColumn("own", own)
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    part = F.xxhash64("g", F.least("own", "other"), F.greatest("own", "other"))
    rows = crowded.join(rows.select("g", "c1", "c2", part.alias("part")), ["g", "c1", "c2"])
    rows = rows.select(F.col("part").alias("g"), "doc", "key", "pos", "lo", "hi", "before", "after")
    parts = int(crowded.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, "g").sortWithinPartitions("g")


def _beaten(found: DataFrame) -> DataFrame:
    """(doc, key, a, b): windows that are the earliest of a component of one gram, but
    belong to an earlier window by way of another gram, band or part.

    Links lead to the earliest window of a gram's own component, so components of
    components are tied where a window has links to several such ones, or is one itself."""
    links = found.where("to_doc is not null").withColumns({"w": F.xxhash64("doc", "key", "pos"), "t": F.xxhash64("to_doc", "to_key", "to_start")})
    # few windows are of that kind: they are found by hashes, and tied by their places
    both = links.select("w", "t", F.lit(0).alias("head")).union(links.select("t", F.lit(None).cast("long"), F.lit(1)))
    tied = both.groupBy("w").agg(F.min("t").alias("low"), F.max("t").alias("high"), F.max("head").alias("head"))
    tied = materialize(tied.where("low is not null and (low <> high or head = 1)").select("w"), "tied")
    place = lambda *names: F.struct(*[F.col(n).alias(c) for n, c in zip(names, ("doc", "key", "start"), strict=True)])
    some = links.join(sized(tied), "w", "left_semi").select("w", "t", place("doc", "key", "pos").alias("a"), place("to_doc", "to_key", "to_start").alias("b"))
    some = materialize(some, "ties")
    nodes = materialize(some.select(F.col("w").alias("node"), F.col("a").alias("at")).union(some.select("t", "b")).distinct(), "nodes")
    if nodes.groupBy("node").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
        # no two places have one hash, so components of hashes are those of places
        placed = materialize(nodes.join(connected_components(some.select(F.col("w").alias("a"), F.col("t").alias("b"))), "node"), "placed")
        first = placed.groupBy("component").agg(F.min("at").alias("first"))
        beaten = placed.join(first, "component").where(F.col("at") != F.col("first")).select("at")
    else:
        beaten = connected_components(some.select("a", "b")).where("node <> component").select(F.col("node").alias("at"))
    return beaten.select("at.doc", "at.key", F.col("at.start").alias("a"), (F.col("at.start") + LENGTH).alias("b"))


def repeated_spans(docs: DataFrame, crowd: int = regions.CROWD) -> DataFrame:
    """(doc, key, whole, spans) of regions.nodes that lose words; whole ones, or word spans."""
    spec = regions.Spec("word", LENGTH, SHINGLE, SHINGLE, BANDS)
    with scope():
        docs = regions.nodes(docs)
        grams, classes = regions.scan(docs, spec)
        rows = regions.contexts(docs, regions.repeated(grams), spec)
        sweep(docs.sparkSession)
        unique = regions.unique_contexts(rows)
        few, crowded = regions.open_contexts(docs, unique, spec, crowd, near=True)
        found = few.mapInArrow(_later(spec), _FOUND)
        if not crowded.isEmpty():
            found = found.union(_crowd_parts(crowded, crowd).mapInArrow(_later(spec, True), _FOUND))
        found = materialize(found, "found")
        sweep(docs.sparkSession)
        windows = regions.crowd_windows(crowded, spec)
        earliest = windows.groupBy("g", "o", "w").agg(F.min(F.struct("doc", "key", "pos")).alias("e"))
        counted = (
            windows.join(earliest, ["g", "o", "w"]).where(F.col("e") < F.struct("doc", "key", "pos"))
            .select("doc", "key", "pos", F.col("o").alias("first"), F.col("o").alias("last"))
        )
        # what holds for a context's earliest place holds for all; the others repeat it as a whole
        firsts = found.where("to_doc is null").select("doc", "key", "pos", "first", "last").union(counted)
        early = unique.where("n > 1").select("g", "c1", "c2", "e")
        others = (
            rows.select("g", "c1", "c2", "doc", "key", "pos", "lo", "hi").join(early, ["g", "c1", "c2"])
            .where(F.col("e") != F.struct("doc", "key", "pos")).select("doc", "key", "pos", F.col("lo").alias("first"), F.col("hi").alias("last"))
        )
        span = ["doc", "key", (F.col("pos") - F.col("last")).alias("a"), (F.col("pos") - F.col("first") + LENGTH).alias("b")]
        spans = regions.listed_spans(firsts.union(others).select(*span).union(_beaten(found)))
        copies = classes.where((F.struct("doc", "key") != F.col("rep")) & (F.col("size") >= LENGTH)).select("doc", "key").distinct()
        whole = copies.select("doc", "key", F.lit(True).alias("whole"), F.lit(None).cast("array<struct<a:long,b:long>>").alias("spans"))
        gone = whole.union(spans.select("doc", "key", F.lit(False).alias("whole"), "spans"))
        gone = gone.groupBy("doc", "key").agg(F.max("whole").alias("whole"), F.flatten(F.collect_list("spans")).alias("spans"))
        return hand_over(materialize(gone, "spans"))


def _cut(text: bytes, whole: bool, spans) -> tuple[int, int, int, bytes]:
    """Words, removed words, spans, and the text without them."""
    _, begin, end = wordhash.words(text)
    n = len(begin)
    starts, ends = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if whole and n:
        starts, ends = np.array([0]), np.array([n])
    elif spans:
        a = np.minimum(np.array([(s["a"], s["b"]) for s in spans], np.int64), n)
        a = a[a[:, 0] < a[:, 1]]
        if len(a):
            starts, ends = regions.merge(a[:, 0], a[:, 1])
    if not len(starts):
        return n, 0, 0, text
    # a span goes with the space after it
    cut_from = begin[starts]
    cut_to = np.where(ends < n, begin[np.minimum(ends, n - 1)], len(text))
    kept = b"".join(text[a:b] for a, b in zip(np.append(0, cut_to), np.append(cut_from, len(text)), strict=True))
    return n, int((ends - starts).sum()), len(starts), kept


def _remover(batches):
    """key, text without the repeated words, and three counts."""
    import pyarrow as pa

    for batch in wordhash.small(batches):
        rows = batch.column("row")
        texts, null = wordhash.utf8(rows.field("text")), rows.field("text").is_null().to_pylist()
        cut = [_cut(t, w, s) for t, w, s in zip(texts, batch.column("whole").to_pylist(), batch.column("spans").to_pylist(), strict=True)]
        kept = pa.array([None if z else c[3].decode() for z, c in zip(null, cut, strict=True)], pa.string())
        counts = [pa.array([c[j] for c in cut], pa.int64()) for j in range(3)]
        yield pa.RecordBatch.from_arrays([rows, kept, *counts], names=["row", "text", "n_words", "n_removed", "n_spans"])


def cut_repeats(docs: DataFrame, **options) -> DataFrame:
    """(row, text, n_words, n_removed, n_spans): each row of docs as a struct, and its cut text."""
    rows = regions.with_spans(docs, repeated_spans(docs, **options))
    counts = [T.StructField(c, T.LongType()) for c in ("n_words", "n_removed", "n_spans")]
    return rows.mapInArrow(_remover, T.StructType([rows.schema["row"], T.StructField("text", T.StringType()), *counts]))


def drop_repeats(docs: DataFrame, **options) -> DataFrame:
    """docs with repeated passages cut out; documents of which nothing is left go.

    If docs has n_chars, it is the length of the text that is left where words were cut."""
    out = cut_repeats(docs, **options).where("n_removed = 0 or n_removed < n_words")
    own = F.col("row")
    new = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        length = F.char_length("text").cast(docs.schema["n_chars"].dataType)
        new["n_chars"] = F.when(F.col("n_removed") > 0, length).otherwise(own["n_chars"])
    return out.select(*[new.get(c, own[c]).alias(c) for c in docs.columns])
