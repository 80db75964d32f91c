"""Exact n-gram Jaccard self-join with vertical partitioning, and its components.

A document's set holds its distinct five-word shingles (64-bit hashes; words are runs
of bytes other than space and 0x09-0x0D, A-Z lower-cased). Two documents link when
100 * intersection >= 75 * union. The result is one row per document with the smallest
doc_id that links reach.

Plan. All shingles stand in one global order: rare ones by hash, then the frequent
ones, the less frequent first. The frequent ones are counted over the whole corpus
first, in two steps: among the smallest hashes of every set, then, for sets that have a
frequent one there, as far as their head may reach once such ones stand last. The list is kept under a fixed size by
raising its threshold; the order changes cost, never the result. It is cut into
fragments, and overlaps are counted fragment by fragment:

* The head of a set is its first n - ceil(0.75 n) + 1 shingles. Linked sets share one
  there, so only heads are shuffled by shingle. What a pair shares in its heads, and the
  rest that the order leaves to either set after that, bound its overlap.
* The rest is cut by hash, into as many fragments as the larger set of a pair needs for
  about ``FRAGMENT`` shingles each, and one of the frequent ones. The partial overlaps
  are summed per pair. A long document is thus never one row.

1. Copies: equal sets form a class, and one document stands for it.
2. Postings: head entries whose shingle at least two documents have. Rows of
   frequent shingles are dealt out with a salt.
3. Stars: every posting is paired with a leader of its shingle only, so a group of m
   near copies gives about m pairs, not m * m / 2. Pairs pass length and position
   bounds, then are counted in full.
4. Rest: after stars, shingles whose documents already lie in one component are
   done. For the others, pairs across components are counted over their heads. The
   changed words of a near copy are rare and so come first in the order, which makes the
   position of the first shared shingle tell distant members of two groups apart. What
   is left is counted in full as well, so no link is lost.

Edge cases: null and wordless texts have empty sets and link with nothing; fewer than
five words make one shingle; repeated rows give repeated equal result rows; a null
doc_id has no links but to a copy of its text, whose component it then has; if rows
share a doc_id and differ in text, every text is a class of its own and these classes are
tied, so the document has the links of either (texts are never mixed); empty tables give an empty result; other columns are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import wordhash
from .shared import connected_components, discard, hand_over, materialize, scope, sized, sweep

SHINGLE = 5
PERCENT = 75
FREQUENT = 64  # documents that have a shingle
FREQUENT_LIST = 1 << 20  # most entries in the list that tasks get: 12 MB
SALTS = 64
SPREAD = 16
FRAGMENT = 1 << 12  # rare shingles of one fragment, about


def prefix_size(n: int) -> int:
    """Linked sets share a shingle among the first ones of each."""
    return n - -(-PERCENT * n // 100) + 1 if n else 0


def index_size(n: int) -> int:
    """In the smaller set it is among these."""
    return n - -(-2 * PERCENT * n // (100 + PERCENT)) + 1 if n else 0


def _sets(batch):
    """(row in the batch, sorted distinct shingles) of every text."""
    texts = [t.lower() for t in wordhash.utf8(batch.column("text"))]
    for rows, h, _, _, bounds in wordhash.grouped(texts):
        grams, cut = wordhash.shingles(h, bounds, SHINGLE)
        for k, row in enumerate(rows):
            yield row, np.unique(grams[cut[k] : cut[k + 1]])


def _digest(tokens: np.ndarray) -> tuple[int, int]:
    import xxhash

    x = xxhash.xxh3_128_intdigest(tokens.tobytes())
    return (x >> 64) - (1 << 63), (x & ((1 << 64) - 1)) - (1 << 63)


def _summaries(batches):
    """One row per document; the head of its prefix by hash, if the task met its set first here."""
    import pyarrow as pa

    seen = set()
    for batch in wordhash.small(batches):
        out = {"doc_id": batch.column("doc_id"), "n": [], "d1": [], "d2": [], "toks": []}
        known = batch.column("doc_id").is_valid().to_pylist()
        for row, tokens in _sets(batch):
            d1, d2 = _digest(tokens)
            new = known[row] and len(tokens) > 0 and (d1, d2) not in seen
            if new:
                seen.add((d1, d2))
            for key, v in (("n", len(tokens)), ("d1", d1), ("d2", d2)):
                out[key].append(v)
            out["toks"].append(tokens[: index_size(len(tokens))].view(np.int64) if new else None)
        yield pa.RecordBatch.from_pydict(
            out | {"toks": pa.array(out["toks"], pa.list_(pa.int64()))},
            schema=pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64()), ("toks", pa.list_(pa.int64()))]),
        )


def _rank(tokens: np.ndarray, frequent) -> np.ndarray:
    """Place of each token among the frequent ones from 1 on; 0 for a rare one."""
    known, rank = frequent
    if not len(known):
        return np.zeros(len(tokens), np.int32)
    at = np.minimum(np.searchsorted(known, tokens), len(known) - 1)
    return np.where(known[at] == tokens, rank[at], 0)


def _reach(tokens: np.ndarray, known) -> int:
    """How far in hash order the head of a set may go, once its frequent shingles stand
    last; 0 if none is among its smallest hashes. Their share there is taken for all."""
    n = len(tokens)
    share = (_rank(tokens[: index_size(n)], known) > 0).mean() if n else 0.0
    return min(n, int(1.25 * prefix_size(n) / (1 - share)) + 8) if 0 < share < 1 else n if share else 0


def _longer_heads(frequent):
    """What the head of a set may reach, for sets that have a frequent shingle among their smallest hashes."""

    def run(batches):
        import pyarrow as pa

        seen, known = set(), frequent.value
        for batch in wordhash.small(batches):
            ids = batch.column("doc_id").to_pylist()
            docs, found = [], []
            for row, tokens in _sets(batch):
                reach = 0 if ids[row] is None else _reach(tokens, known)
                if not reach:
                    continue
                key = _digest(tokens)
                if key not in seen:
                    seen.add(key)
                    docs.append(ids[row])
                    found.append(tokens[:reach].view(np.int64))
            if docs:
                yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(found, pa.list_(pa.int64()))], names=["doc", "toks"])

    return run


def _postings(frequent):
    def run(batches):
        import pyarrow as pa

        seen, known = set(), frequent.value
        names = ["tok", "doc", "x", "n", "pos", "hot"]
        for batch in wordhash.small(batches):
            ids = batch.column("doc_id").to_pylist()
            parts = []
            for row, tokens in _sets(batch):
                key = _digest(tokens)
                if ids[row] is None or not len(tokens) or key in seen:
                    continue
                seen.add(key)
                rank = _rank(tokens, known)
                order = np.argsort(rank, kind="stable")[: prefix_size(len(tokens))]
                parts.append((tokens[order], ids[row], key[0], len(tokens), rank[order] > 0))
                if len(parts) >= 2000:
                    yield _rows(pa, names, parts)
                    parts = []
            if parts:
                yield _rows(pa, names, parts)

    return run


def _rows(pa, names, parts):
    sizes = [len(p[0]) for p in parts]
    columns = [
        np.concatenate([p[0] for p in parts]).view(np.int64),
        np.repeat(np.array([p[1] for p in parts], np.int64), sizes),
        np.repeat(np.array([p[2] for p in parts], np.int64), sizes),
        np.repeat(np.array([p[3] for p in parts], np.int32), sizes),
        np.concatenate([np.arange(s, dtype=np.int32) for s in sizes]),
        np.concatenate([p[4] for p in parts]),
    ]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)


def _fragments(frequent):
    """(doc, x, n, cut, frag, toks): sets of documents, cut as ``cuts`` asks; x tells texts of one doc apart."""

    def run(batches):
        import pyarrow as pa

        known = frequent.value
        for batch in wordhash.small(batches):
            ids, cuts = batch.column("doc_id").to_pylist(), batch.column("cuts").to_pylist()
            rows, toks = [], []
            for row, tokens in _sets(batch):
                rare, x = _rank(tokens, known) == 0, _digest(tokens)[0]
                for cut in cuts[row]:
                    place = np.where(rare, tokens >> np.uint64(64 - cut) if cut else 0, 1 << cut)
                    for f in np.unique(place):
                        rows.append((ids[row], x, len(tokens), cut, int(f)))
                        toks.append(tokens[place == f].view(np.int64))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32()]
            columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.array([], t) for t in kinds]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(toks, pa.list_(pa.int64()))], names=["doc", "x", "n", "cut", "frag", "toks"])

    return run


def _listed(sets: DataFrame, name: str):
    """Broadcast of the frequent shingles of sets(toks) and their ranks, at most FREQUENT_LIST of them."""
    counts = sets.select(F.explode("toks").alias("tok")).groupBy("tok").agg(F.count(F.lit(1)).alias("c"))
    counts = materialize(counts.where(F.col("c") > FREQUENT), name)
    least = FREQUENT
    while counts.where(F.col("c") > least).count() > FREQUENT_LIST:
        least *= 4
    found = counts.where(F.col("c") > least).toPandas()
    known, c = found["tok"].to_numpy(np.int64).view(np.uint64), found["c"].to_numpy(np.int64)
    discard(counts)
    rank = np.empty(len(known), np.int32)
    rank[np.lexsort((known, c))] = np.arange(1, len(known) + 1)
    order = np.argsort(known)
    return sets.sparkSession.sparkContext.broadcast((known[order], rank[order]))


def _frequent(docs: DataFrame, heads: DataFrame, copies: DataFrame):
    """The frequent shingles of the corpus, each set counted once; heads have the smallest hashes of each."""
    one = sized(copies.select("doc").distinct())  # it sets the order, not the result
    first = _listed(heads.select(F.col("doc_id").alias("doc"), "toks").join(one, "doc", "left_anti"), "frequent")
    if not len(first.value[0]):
        return first
    longer = docs.mapInArrow(_longer_heads(first), "doc long, toks array<long>")
    return _listed(longer.join(one, "doc", "left_anti"), "frequent")


def _bounds(left: str, right: str):
    """Length and position bounds for two postings of one shingle."""
    c = lambda side, name: F.col(f"{side}.{name}").cast("long")
    total = c(left, "n") + c(right, "n")
    rest = F.least(c(left, "n") - c(left, "pos"), c(right, "n") - c(right, "pos"))
    return (
        (100 * F.least(c(left, "n"), c(right, "n")) >= PERCENT * F.greatest(c(left, "n"), c(right, "n")))
        & ((100 + PERCENT) * rest >= PERCENT * total)
    )


def _pair(left: str, right: str):
    """The pair with the smaller doc_id first, and both set sizes."""
    swap = F.col(f"{left}.doc") > F.col(f"{right}.doc")
    pick = lambda name, a, b: F.when(swap, F.col(f"{b}.{name}")).otherwise(F.col(f"{a}.{name}"))
    return [
        pick("doc", left, right).alias("a"), pick("doc", right, left).alias("b"),
        pick("n", left, right).alias("na"), pick("n", right, left).alias("nb"),
    ]


def _heads(posts: DataFrame) -> DataFrame:
    """(doc, p, t): the shingles of each prefix that other documents have, in order."""
    rows = posts.groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("pos", "tok"))).alias("h"))
    return materialize(rows.select("doc", F.col("h.pos").alias("p"), F.col("h.tok").alias("t")), "heads")


def _promising(pairs: DataFrame, heads: DataFrame) -> DataFrame:
    """Pairs whose overlap may be large enough after the first cut of the order.

    One of the two prefixes ends first. Of its set no shingle up to there is shared but
    those counted here, so at most the rest of its set may follow; of the other set,
    what comes after the last shared one."""
    side = lambda k: heads.select(F.col("doc").alias(k), F.col("p").alias(f"p{k}"), F.col("t").alias(f"t{k}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").withColumn("s", F.array_intersect("ta", "tb"))
    last = F.element_at("s", -1)
    rest = lambda k: F.col(f"n{k}") - 1 - F.element_at(f"p{k}", F.array_position(f"t{k}", last).cast("int"))
    beyond = lambda k: F.expr(f"({PERCENT} * cast(n{k} as long) + 99) div 100 - 1")  # n less its prefix
    most = F.size("s") + F.greatest(F.least(beyond("a"), rest("b")), F.least(rest("a"), beyond("b")))
    total = F.col("na").cast("long") + F.col("nb")
    kept = both.where((F.size("s") > 0) & ((100 + PERCENT) * most >= PERCENT * total))
    return materialize(kept.select("a", "b", "na", "nb"), "promising")


def _verified(pairs: DataFrame, docs: DataFrame, frequent) -> DataFrame:
    """The pairs (a, b) that link: overlaps counted per fragment, summed per pair."""
    need = F.greatest("na", "nb").cast("double") / FRAGMENT
    pairs = pairs.withColumn("cut", F.greatest(F.ceil(F.log2(need)), F.lit(0)).cast("int"))
    side = lambda k: pairs.select(F.col(k).alias("doc_id"), "cut")
    ids = side("a").union(side("b")).groupBy("doc_id").agg(F.sort_array(F.collect_set("cut")).alias("cuts"))
    ids = materialize(ids, "ids")
    parts = docs.join(sized(ids), "doc_id").select("doc_id", "text", "cuts")
    parts = parts.mapInArrow(_fragments(frequent), "doc long, x long, n long, cut int, frag int, toks array<long>")
    parts = materialize(parts, "fragments")
    side = lambda k: parts.select(
        F.col("doc").alias(k), F.col("x").alias(f"x{k}"), F.col("n").cast("int").alias(f"n{k}"), "cut", "frag", F.col("toks").alias(f"t{k}")
    )
    overlaps = (
        pairs.join(side("a"), ["a", "na", "cut"]).join(side("b"), ["b", "nb", "cut", "frag"])
        .select("a", "b", "na", "nb", "xa", "xb", "frag", F.size(F.array_intersect("ta", "tb")).alias("part"))
        .groupBy("a", "b", "na", "nb", "xa", "xb", "frag").agg(F.max("part").alias("part"))  # once for repeated rows
        .groupBy("a", "b", "na", "nb", "xa", "xb").agg(F.sum("part").alias("both"))
    )
    total = F.col("na").cast("long") + F.col("nb")
    links = materialize(overlaps.where(100 * F.col("both") >= PERCENT * (total - F.col("both"))).select("a", "b").distinct(), "links")
    discard(parts, ids)
    return links


def components(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of docs(doc_id, text)."""
    with scope():
        return _components(docs.select("doc_id", "text"))


def _components(docs: DataFrame) -> DataFrame:
    sums = materialize(
        docs.mapInArrow(_summaries, "doc_id long, n long, d1 long, d2 long, toks array<long>"), "sets"
    )
    classes = sums.where("n > 0 and doc_id is not null").groupBy("d1", "d2", "n").agg(F.min("doc_id").alias("rep"))
    named = sums.select("doc_id", "n", "d1", "d2").join(classes, ["d1", "d2", "n"], "left").select("doc_id", "n", "d1", "rep")
    named = hand_over(materialize(named, "classes"))
    # by text (x), as a document may have several
    copies = materialize(named.where("doc_id <> rep").select(F.col("doc_id").alias("doc"), F.col("d1").alias("x"), "rep").distinct(), "copies")
    # the classes of one document's texts have the same links
    several = named.where("rep is not null").groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("z")).where("a <> z").select("doc_id", "a")
    ties = named.join(sized(materialize(several, "several")), "doc_id").where("rep <> a").select("a", F.col("rep").alias("b")).distinct()
    ties = materialize(ties, "ties")
    frequent = _frequent(docs, sums.where("toks is not null"), copies)
    discard(sums)

    rows = docs.mapInArrow(_postings(frequent), "tok long, doc long, x long, n int, pos int, hot boolean")
    # everything up to the leaders happens in one partitioning, by shingle (and salt)
    salted = rows.withColumn("salt", F.when(F.col("hot"), F.pmod(F.xxhash64("doc"), F.lit(SALTS))).otherwise(F.lit(0)))
    shared = salted.withColumn("c", F.expr("count(*) over (partition by tok, salt)")).where("c > 1 or hot")
    posts = (
        shared.join(sized(copies), ["doc", "x"], "left")
        .groupBy("tok", "salt", F.coalesce("rep", "doc").alias("doc"), "n")
        .agg(F.max("pos").alias("pos"), F.max("hot").alias("hot"))
        .withColumn("c", F.expr("count(*) over (partition by tok, salt)")).where("c > 1 or hot")
        # the leader has the fewest shingles of its own before this one: among near copies
        # that is the original, or the copy with the fewest edits
        .withColumn("l", F.expr("min(struct(pos, doc, n)) over (partition by tok, salt)"))
        .select("tok", "hot", "doc", "n", "pos", F.struct("l.doc", "l.n", "l.pos").alias("l"))
    )
    posts = materialize(posts, "postings")
    sweep(docs.sparkSession)

    # a frequent shingle has one leader for all its salts; FREQUENT_LIST bounds their number
    chiefs = materialize(posts.where("hot").groupBy("tok").agg(F.min(F.struct("l.pos", "l.doc", "l.n")).alias("m")), "chiefs")
    chief = F.when(F.col("m").isNotNull(), F.struct("m.doc", "m.n", "m.pos")).otherwise(F.col("l"))
    led = posts.join(sized(chiefs), "tok", "left").select(F.struct("doc", "n", "pos").alias("p"), chief.alias("l"))
    stars = led.where((F.col("p.doc") != F.col("l.doc")) & _bounds("p", "l"))
    stars = materialize(stars.select(*_pair("p", "l")).distinct(), "stars")
    heads = _heads(posts)
    links = _verified(_promising(stars, heads), docs, frequent).union(ties)
    joined = _joined(links)
    sweep(docs.sparkSession)

    placed = posts.join(sized(joined).withColumnRenamed("node", "doc"), "doc", "left").select(
        "tok", "hot", "doc", "n", "pos", F.coalesce("component", "doc").alias("comp")
    )
    open_ = placed.groupBy("tok").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("tok")
    left = materialize(placed.join(sized(materialize(open_, "shingles")), "tok"), "open")
    # rows of a frequent shingle meet in SPREAD tasks; a rare one has at most FREQUENT
    one_side = left.withColumn("part", F.when(F.col("hot"), F.pmod(F.xxhash64("doc"), F.lit(SPREAD))).otherwise(F.lit(0).cast("long")))
    other = left.withColumn("part", F.explode(F.when(F.col("hot"), F.sequence(F.lit(0).cast("long"), F.lit(SPREAD - 1).cast("long"))).otherwise(F.array(F.lit(0).cast("long")))))
    # shared shingles that pass the bounds are the first ones that a pair shares, so the
    # pair's whole overlap is at most their number and the rest after the last of them
    total = F.col("na").cast("long") + F.col("nb")
    rest = F.least(F.col("na") - 1 - F.col("pa"), F.col("nb") - 1 - F.col("pb"))
    across = (
        one_side.alias("p").join(other.alias("q"), ["tok", "part"])
        .where((F.col("p.doc") < F.col("q.doc")) & (F.col("p.comp") != F.col("q.comp")) & _bounds("p", "q"))
        .groupBy(F.col("p.doc").alias("a"), F.col("q.doc").alias("b"), F.col("p.n").alias("na"), F.col("q.n").alias("nb"))
        .agg(F.count(F.lit(1)).alias("c"), F.max("p.pos").alias("pa"), F.max("q.pos").alias("pb"))
        .where((100 + PERCENT) * (F.col("c") + rest) >= PERCENT * total)
        .select("a", "b", "na", "nb")
    )
    across = materialize(across.join(stars, ["a", "b"], "left_anti"), "across")
    across = _promising(across, heads)
    if not across.isEmpty():
        more = _verified(across, docs, frequent)
        if not more.isEmpty():
            joined = _joined(links.union(more))
    sweep(docs.sparkSession)

    found = hand_over(joined).select(F.col("node").alias("rep"), "component")
    return named.join(found, "rep", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "rep", "doc_id").alias("component_id")
    )


def _joined(links: DataFrame) -> DataFrame:
    with scope():
        return hand_over(materialize(connected_components(links), "components"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of docs whose document is the first of its component."""
    with scope():
        gone = components(docs).where("doc_id <> component_id").select(F.col("doc_id").alias("gone")).distinct()
        gone = hand_over(materialize(gone, "gone"))
    return docs.join(sized(gone), docs["doc_id"] == gone["gone"], "left_anti")
