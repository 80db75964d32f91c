"""Audit of how sources differ: exact divergences between the word counts of groups.

Rows of documents(text, lang, source) form groups (lang, source). Every language keeps the
terms that at least ``LEAST`` of its documents have. With N the kept occurrences and V the
kept terms, a group (or the whole language) gives a term with ``count`` occurrences
p = 1 + floor(10^9 (count + 2) / (N + 2 V)), and two of these differ by
f = floor((p - q)^2 / (p + q)). The result has, for every group, the sum of f with every
other source of its language, and the terms that it has more of than its language.

Plan. Tasks count terms per group before anything is shuffled, so a source with a third of
all rows costs no more rows than another one. Kept terms of a language are dealt by hash
into blocks of about ``TERMS``, its sources into blocks of about ``GROUPS``. A tile is the
dense int64 matrix of one block of terms and two blocks of sources; all pairs of its rows
are compared by broadcasting. Partial pair sums are added up by Spark, and every tile gives
each of its sources a heap of its ``TOP`` terms, which are merged per source. Terms that
neither block has are not sent to a tile: they all differ by the same f, which is added once
per pair for as many as are lacking. No task gets more than a tile.

Edge cases: null text, lang and source are read as ''; groups without terms, and languages
without kept terms, have pairs (value 0 where V is 0) and no terms; every row is a document,
repeated ones included; ties go to the item that is smaller in UTF-8; long texts are counted
piece by piece; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import terms, wordhash
from .shared import hand_over, materialize, scope, sized

LEAST = 10
TOP = 10
SCALE = 1_000_000_000
TERMS = 2048  # of one tile, about
GROUPS = 64  # of each side of a tile, about
ENTRIES = 1 << 19  # terms that a task holds before it hands its counts on
BYTES = 1 << 28  # text that it reads before that
CELLS = 1 << 20  # of one broadcast comparison, about


def _counts(batches):
    """(lang, source, term, count, docs) of what a task has read."""
    import pyarrow as pa

    def rows():
        for (lang, source), (n, docs) in held.items():
            keys = list(n)
            for k in range(0, len(keys), 1 << 16):
                part = keys[k : k + (1 << 16)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([lang] * len(part), pa.string()), pa.array([source] * len(part), pa.string()), terms.binary(part).cast(pa.string()),
                        pa.array([n[t] for t in part], pa.int64()), pa.array([docs[t] for t in part], pa.int64()),
                    ],
                    names=["lang", "source", "term", "count", "docs"],
                )

    held, read = {}, 0
    for batch in wordhash.small(batches):
        langs, sources = batch.column("lang").to_pylist(), batch.column("source").to_pylist()
        for lang, source, raw in zip(langs, sources, wordhash.utf8(batch.column("text")), strict=True):
            n, docs = held.setdefault((lang, source), (Counter(), Counter()))
            seen = set()
            for found in terms.pieces(raw, terms.LETTERS):
                n.update(found)
                seen.update(found)
            docs.update(seen)
            read += len(raw)
        if read > BYTES or sum(len(n) for n, _ in held.values()) > ENTRIES:
            yield from rows()
            held, read = {}, 0
    yield from rows()


def _share(count: str, total: str, kept: str):
    """1 + floor(SCALE (count + 2) / (total + 2 kept)), exactly: in decimals, as counts may pass 10^10."""
    over = F.expr(f"cast({SCALE} as decimal(10,0)) * cast({count} + 2 as decimal(20,0)) div cast({total} + 2 * {kept} as decimal(20,0))")
    return (over + 1).cast("long")


def _apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def _tile(top: int):
    """The pairs and the heaps of one tile; rows without a term list its sources."""

    def run(key, table):
        import pyarrow as pa

        lang, gi, gj = key[0].as_py(), key[1].as_py(), key[2].as_py()
        listed = table.filter(table.column("term").is_null())
        names, p0, block = listed.column("source").to_pylist(), listed.column("p0").to_numpy(), listed.column("g").to_numpy()
        rest = table.filter(table.column("term").is_valid())
        coded = rest.column("term").combine_chunks().dictionary_encode()
        coded = coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded
        words, at = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False)
        place = {s: k for k, s in enumerate(names)}
        row = np.array([place[s] for s in rest.column("source").to_pylist()], np.int64)
        p = np.repeat(p0.astype(np.int64)[:, None], len(words), axis=1)
        p[row, at] = rest.column("p").to_numpy()

        left, right = np.flatnonzero(block == gi), np.flatnonzero(block == gj)
        out = [[], [], [], [], [], []]
        step = max(1, CELLS // max(1, len(right) * len(words)))
        for k in range(0, len(left), step):
            some = left[k : k + step]
            sums = _apart(p[some][:, None, :], p[right][None, :, :]).sum(axis=2)
            plain = _apart(p0[some][:, None], p0[right][None, :])
            for i, a in enumerate(some):
                for j, b in enumerate(right):
                    for x, y in ((a, b), (b, a)) if gi != gj else ((a, b),):
                        if x != y:
                            for column, v in zip(out, ("pair", names[x], names[y], int(sums[i, j]), len(words), int(plain[i, j])), strict=True):
                                column.append(v)
        if gi == gj and len(words):
            q = np.zeros(len(words), np.int64)
            q[at] = rest.column("q").to_numpy()
            order = np.empty(len(words), np.int64)
            order[sorted(range(len(words)), key=lambda k: words[k].encode())] = np.arange(len(words))
            here = np.zeros(p.shape, bool)
            here[row, at] = True
            for a in left:
                more = np.flatnonzero(here[a] & (p[a] > q))
                f = _apart(p[a][more], q[more])
                for k in np.lexsort((order[more], -f))[:top]:
                    for column, v in zip(out, ("term", names[a], words[more[k]], int(f[k]), 0, 0), strict=True):
                        column.append(v)
        kinds = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
        columns = [pa.array(c, t) for c, t in zip(out, kinds, strict=True)]
        first = pa.array([lang] * len(out[0]), pa.string())
        kept = pa.array([table.column("v")[0].as_py()] * len(out[0]), pa.int64())
        return pa.table([first, *columns, kept], names=["lang", "part", "source", "item", "value", "met", "plain", "v"])

    return run


def audit(docs: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank): pairs of sources and telling terms, see above."""
    with scope():
        return _audit(docs, least, top)


def _audit(docs: DataFrame, least: int, top: int) -> DataFrame:
    docs = docs.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")])
    counts = docs.mapInArrow(_counts, "lang string, source string, term string, count long, docs long")
    counts = counts.groupBy("lang", "source", "term").agg(F.sum("count").alias("count"), F.sum("docs").alias("docs"))
    # one row per source that has the term
    both = W.partitionBy("lang", "term")
    kept = counts.withColumns({
        "every": F.sum("docs").over(both), "all": F.sum("count").over(both), "first": F.min("source").over(both) == F.col("source"),
    })
    kept = materialize(kept.where(F.col("every") >= least).select("lang", "source", "term", "count", "all", "first"), "terms")

    # of each group and each language: occurrences, kept terms, blocks
    spoken = kept.groupBy("lang").agg(F.sum("count").alias("m"), F.count_if("first").alias("v"))
    own = kept.groupBy("lang", "source").agg(F.sum("count").alias("n"))
    groups = docs.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("docs")).join(own, ["lang", "source"], "left")
    size = groups.groupBy("lang").agg(F.count(F.lit(1)).alias("size")).join(spoken, "lang", "left").select(
        "lang", "m", F.coalesce("v", F.lit(0)).alias("v"), F.ceil(F.col("size") / GROUPS).cast("int").alias("gs"),
        F.greatest(F.ceil(F.col("v") / TERMS), F.lit(1)).cast("int").alias("ts"),
    )
    groups = groups.join(size, "lang").select(
        "lang", "source", "m", "v", "gs", "ts", F.coalesce("n", F.lit(0)).alias("n"), F.pmod(F.xxhash64("source"), F.col("gs")).cast("int").alias("g"),
    )
    p0 = F.when(F.col("v") > 0, _share("0", "n", "v")).otherwise(F.lit(1))
    groups = materialize(groups.withColumn("p0", p0), "groups")

    shares = kept.join(sized(groups), ["lang", "source"]).select(
        "lang", "source", "term", _share("count", "n", "v").alias("p"), _share("`all`", "m", "v").alias("q"), "p0", "g", "gs", "v",
        F.pmod(F.xxhash64("term"), F.col("ts")).cast("int").alias("tb"),
    )
    no_term, no_share = F.lit(None).cast("string").alias("term"), F.lit(None).cast("long")
    listed = groups.select(
        "lang", "source", no_term, no_share.alias("p"), no_share.alias("q"), "p0", "g", "gs", "v", F.explode(F.sequence(F.lit(0), F.col("ts") - 1)).alias("tb"),
    )
    rows = shares.union(listed).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("gs") - 1)))
    rows = rows.withColumn("gi", F.least("g", "o")).withColumn("gj", F.greatest("g", "o")).drop("gs", "o")
    shape = "lang string, part string, source string, item string, value long, met long, plain long, v long"
    found = hand_over(materialize(rows.groupBy("lang", "gi", "gj", "tb").applyInArrow(_tile(top), shape), "tiles"))

    ranked = F.row_number().over(W.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    pairs = found.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg(
        # terms that no tile had are in neither of the two
        (F.sum("value") + (F.max("v") - F.sum("met")) * F.max("plain")).alias("value")
    ).withColumn("rank", ranked)
    heaps = found.where("part = 'term'").select("lang", "source", "part", "item", "value").withColumn("rank", ranked).where(F.col("rank") <= top)
    return pairs.unionByName(heaps)
