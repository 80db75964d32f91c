"""Benchmark decontamination by winnowing (DataFrame functions only).

Words are ``[0-9a-z]`` and non-ASCII runs after lower-casing A-Z. Texts are
fingerprinted by the smallest 5-word hash of every 6 successive ones (10 words): two
texts that share any 10 successive words share a fingerprint, so the join of
fingerprints misses no shared window. Candidate documents are then extended: their
own 10-word windows are joined with the windows of the items on the words
themselves. Items of fewer than 10 words are one window each; as winnowing promises
nothing for those, windows of these lengths are joined directly.

Cost: the corpus is scanned once for fingerprints; only those that an item has leave
the first join (the benchmark's fingerprints are written first, so the planner knows
their size and broadcasts them only under its threshold). The second scan reads
candidate documents alone. A document's rows are its hits, never all of its windows.

Edge cases: null or wordless texts have no words, no windows and no hits; items with a
null item_id count for hits, and as one item without a name in the list of names; rows are
told apart by doc_id (null or not) and text, so repeated rows get the same result each;
empty tables give empty results or documents without hits; other columns, of any name, are
returned by ``drop_contaminated`` and not read otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import hand_over, materialize, packed, scope

WINDOW = 10
GRAM = 5
SPLIT = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    lower = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    return F.filter(F.split(lower, SPLIT), lambda w: w != "")


def _grams(df: DataFrame, source: str, target: str, size: int) -> DataFrame:
    """target: hash of the words' hashes from each position on; shorter texts have none."""
    parts = lambda i: [F.get(source, i + j) for j in range(size)]
    return df.withColumn(
        target,
        F.slice(
            F.transform(source, lambda x, i: F.xxhash64(*parts(i))),
            F.lit(1),
            F.greatest(F.size(source) - (size - 1), F.lit(0)),
        ),
    )


def fingerprints(df: DataFrame, keys: list[str]) -> DataFrame:
    """keys and one row ``fp`` for each winnowed fingerprint of ``_words``."""
    span = WINDOW - GRAM + 1
    out = df.select(*keys, F.transform("_words", lambda w: F.xxhash64(w)).alias("_w"))
    out = _grams(out, "_w", "_g", GRAM)
    out = out.withColumn(
        "_m",
        F.slice(
            F.transform("_g", lambda x, i: F.least(*[F.get("_g", i + j) for j in range(span)])),
            F.lit(1),
            F.greatest(F.size("_g") - (span - 1), F.lit(0)),
        ),
    )
    # a minimum lasts over several windows: one row where it changes
    kept = F.filter("_m", lambda x, i: (i == 0) | (x != F.get("_m", i - 1)))
    return out.select(*keys, F.explode(kept).alias("fp"))


def _windows(df: DataFrame, keys: list[str], length: int) -> DataFrame:
    """keys, position and text of every window of ``length`` words."""
    count = F.size("_words") - (length - 1)
    starts = F.when(count > 0, F.sequence(F.lit(1), count))
    return df.withColumn("pos", F.explode(starts)).select(
        *keys, "pos", F.array_join(F.slice("_words", F.col("pos"), F.lit(length)), " ").alias("win")
    )


def item_table(benchmark: DataFrame) -> DataFrame:
    items = benchmark.select("item_id", words(F.col("text")).alias("_words"))
    return materialize(items.where(F.size("_words") > 0), "items")


def hits(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, _key, item_id, pos, length): each place where a window of an item starts."""
    keyed = docs.select("doc_id", F.xxhash64("text").alias("_key"), "text")
    lengths = [
        r["n"] for r in items.select(F.least(F.size("_words"), F.lit(WINDOW)).alias("n")).distinct().collect()
    ]  # at most ten numbers
    found = None
    for n in sorted(lengths):
        wanted = items.where(F.size("_words") == n) if n < WINDOW else items.where(F.size("_words") >= WINDOW)
        wins = materialize(
            _windows(wanted, ["item_id"], n).select("item_id", "win").distinct(), "windows"
        )
        part = keyed
        if n == WINDOW:
            prints = materialize(fingerprints(wanted, []).distinct(), "fingerprints")
            marks = keyed.select("doc_id", "_key", words(F.col("text")).alias("_words"))
            near = fingerprints(marks, ["doc_id", "_key"]).join(prints, "fp", "left_semi")
            near = materialize(near.select("doc_id", "_key").distinct(), "candidates")
            part = _null_safe(keyed, near, "left_semi")
        part = part.select("doc_id", "_key", words(F.col("text")).alias("_words"))
        own = _windows(part, ["doc_id", "_key"], n)
        own = own.join(wins, "win").select("doc_id", "_key", "item_id", "pos", F.lit(n).alias("length"))
        found = own if found is None else found.unionByName(own)
    if found is None:
        return keyed.where("false").select(
            "doc_id", "_key", F.lit(None).cast("long").alias("item_id"), F.lit(0).alias("pos"), F.lit(0).alias("length")
        )
    return found


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, _key, n_hit, n_items, items): documents with hits; items as sorted strings."""
    found = hits(docs, item_table(benchmark))
    # word positions are merged from sorted starts: each adds what the previous ones leave
    spans = found.groupBy("doc_id", "_key", "pos").agg(F.max("length").alias("length"))
    per_doc = spans.groupBy("doc_id", "_key").agg(
        F.sort_array(F.collect_list(F.struct("pos", "length"))).alias("_spans")
    )
    merged = F.aggregate(
        "_spans",
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end")),
        lambda a, s: F.struct(
            (a["n"] + F.greatest(s["pos"] + s["length"] - F.greatest(a["end"], s["pos"]), F.lit(0))).alias("n"),
            F.greatest(a["end"], s["pos"] + s["length"]).alias("end"),
        ),
    )
    names = (
        found.select("doc_id", "_key", F.col("item_id").cast("string").alias("item")).distinct()
        .groupBy("doc_id", "_key").agg(F.sort_array(F.collect_list("item")).alias("items"), F.count(F.lit(1)).alias("n_items"))
    )
    counted = per_doc.select("doc_id", "_key", merged["n"].alias("n_hit"))
    return _null_safe(counted, names, "inner").drop("_id2", "_key2")


def _null_safe(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
    right = right.withColumnsRenamed({"doc_id": "_id2", "_key": "_key2"})
    on = F.col("doc_id").eqNullSafe(F.col("_id2")) & (F.col("_key") == F.col("_key2"))
    return left.join(right, on, how)


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row for every document, hit or not."""
    with scope():
        found = hand_over(materialize(contamination(docs, benchmark), "contaminated"))
    n_words = F.size(F.filter(F.split(F.coalesce("text", F.lit("")), _ANY_CASE), lambda w: w != ""))
    rows = docs.select("doc_id", F.xxhash64("text").alias("_key"), n_words.cast("long").alias("n_words"))
    joined = _null_safe(rows, found, "left")
    listed = F.coalesce(F.array_join("items", ","), F.lit(""))
    return joined.select(
        "doc_id",
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.sha2(listed, 256).alias("items_sha256"),
        F.coalesce(F.col("n_hit") > 0, F.lit(False)).alias("contaminated"),
    )


#: the same words before lower-casing: A-Z belong to them
_ANY_CASE = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs without any hit, with the columns of docs."""
    with scope():
        found = hits(docs, item_table(benchmark)).select("doc_id", "_key").distinct()
        found = hand_over(materialize(found, "contaminated"))
    rows = docs.select(packed(docs.columns), "doc_id", F.xxhash64("text").alias("_key"))
    return _null_safe(rows, found, "left_anti").select("row.*")
