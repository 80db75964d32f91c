"""Importance resampling towards a target distribution, by hashed n-gram features.

A document's features are its runs of 1 to ``order`` words. Every distinct feature falls
into a bucket, crc32 modulo ``buckets``. With s of the S features of the corpus and t of the
T features of the target in a bucket, its gain is
floor(1000 ln((t + 1)(S + buckets) / ((s + 1)(T + buckets)))), a document's weight is the
floored mean of the gains of its features, and its score adds Gumbel noise that follows from
its id. The ``percent`` highest scores of documents with ``least`` words are drawn.

Plan. Feature strings are counted once over the whole corpus (tasks add up what they read
before anything is shuffled); the dictionary of distinct strings is hashed once per string,
and its counts are added up by bucket. Gains go back to documents by joining the dictionary
to the features of each document. Of the dictionary, the most frequent strings (at most
``HOT``, of at most ``SHORT`` + 1 bytes each) are sent to all tasks, so that only features
that are no larger share of the corpus than 1/HOT are shuffled: no key of the join is hot.
A feature of over ``SHORT`` bytes is replaced by its digest, and hashed by the task that
meets it.

Ranks need no global sort: scores are whole numbers within about 120,000 values, so counts per score
give every score its first rank, and rows are numbered inside their score.

Edge cases: null text has no features and weight 0; a null id is read as '' in the noise and
comes last in ties; every row is a document, so repeated rows count twice and are all
returned; long texts are read piece by piece; an empty table gives an empty result, an empty
target only shifts the gains; other columns are not read, ``resample`` carries them.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import terms, wordhash
from .shared import discard, hand_over, materialize, scope

ORDER = 1
BUCKETS = 10_000
SEED = 2024
PERCENT = 10
LEAST = 20
HOT = 1 << 17
SHORT = 64
ENTRIES = 1 << 19  # features that a task holds before it hands its counts on
BYTES = 1 << 28  # text that it reads before that


def _key(feature: bytes) -> bytes:
    """The feature itself, or a digest of a long one; no feature begins with a zero byte."""
    return feature if len(feature) <= SHORT else b"\0" + hashlib.blake2b(feature, digest_size=32).digest()


def _features(raw: bytes, order: int):
    """Lists of features, piece by piece, each with the number of words of the piece."""
    last: list[bytes] = []
    for words in terms.pieces(raw, terms.WORDS):
        out = list(words)
        joined = last + words
        for size in range(2, order + 1):
            skip = max(0, len(last) - size + 1)  # runs that end in this piece
            some = joined[skip:]
            out += [b" ".join(some[k : k + size]) for k in range(len(some) - size + 1)]
        last = joined[-(order - 1) :] if order > 1 else []
        yield out, len(words)


def _counted(order: int):
    """(key, crc, n) of what a task has read; crc of digests only."""

    def run(batches):
        import pyarrow as pa

        def rows():
            keys = list(held)
            for k in range(0, len(keys), 1 << 16):
                part = keys[k : k + (1 << 16)]
                yield pa.RecordBatch.from_arrays(
                    [
                        terms.binary([_key(f) for f in part]), pa.array([zlib.crc32(f) if len(f) > SHORT else None for f in part], pa.int64()),
                        pa.array([held[f] for f in part], pa.int64()),
                    ],
                    names=["key", "crc", "n"],
                )

        held, read = Counter(), 0
        for batch in wordhash.small(batches):
            for raw in wordhash.utf8(batch.column("text")):
                for found, _ in _features(raw, order):
                    held.update(found)
                read += len(raw)
            if read > BYTES or len(held) > ENTRIES:
                yield from rows()
                held, read = Counter(), 0
        yield from rows()

    return run


def dictionary(docs: DataFrame, order: int = ORDER, buckets: int = BUCKETS) -> DataFrame:
    """(key, bucket, n) of every distinct feature of docs(text)."""
    counts = docs.select("text").mapInArrow(_counted(order), "key binary, crc long, n long")
    counts = counts.groupBy("key").agg(F.sum("n").alias("n"), F.max("crc").alias("crc"))
    return counts.select("key", F.pmod(F.coalesce("crc", F.crc32("key")), F.lit(buckets)).cast("int").alias("bucket"), "n")


def gains(own: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, gain) of the buckets of own(bucket, n); at most ``buckets`` rows. Both are written tables."""
    side = lambda df, name: df.groupBy("bucket").agg(F.sum("n").alias(name))
    total = lambda df: float(df.agg(F.sum("n")).first()[0] or 0)  # noqa: E731  one number
    both = side(own, "s").join(F.broadcast(side(target, "t")), "bucket", "left")
    s1, t1 = F.col("s").cast("double") + 1, F.coalesce("t", F.lit(0)).cast("double") + 1
    return both.select("bucket", F.floor(1000 * F.ln(t1 * (total(own) + buckets) / (s1 * (total(target) + buckets)))).alias("gain"))


def _frequent(words: DataFrame) -> tuple[dict[bytes, int], int]:
    """At most HOT of words(key, gain, n), all those with more than a number of occurrences, and that number."""
    step = F.floor(F.log2("n") * 4).cast("int")  # counts within a fifth of each other
    sizes = words.groupBy(step.alias("k")).agg(F.count(F.lit(1)).alias("m"), F.max("n").alias("most")).orderBy(F.desc("k")).collect()
    met, most = 0, 0
    for r in sizes:  # a few hundred at most
        met += r["m"]
        if met > HOT:
            most = r["most"]
            break
    return {bytes(r["key"]): r["gain"] for r in words.where(F.col("n") > most).select("key", "gain").collect()}, most


def _weighed(order: int, hot):
    """(doc_id, n_words, n_features, sum, keys, counts): gains of frequent features summed, the other features listed."""

    def run(batches):
        import pyarrow as pa

        gain = hot.value
        for batch in wordhash.small(batches):
            out = [[], [], [], [], []]
            for raw in wordhash.utf8(batch.column("text")):
                words = features = total = 0
                left: Counter = Counter()
                for found, n in _features(raw, order):
                    words, features = words + n, features + len(found)
                    own = [gain.get(f) for f in found]
                    total += sum(filter(None, own))
                    for f, n in Counter(f for f, g in zip(found, own, strict=True) if g is None).items():
                        key = _key(f)
                        if key in gain:  # of a long feature
                            total += n * gain[key]
                        else:
                            left[key] += n
                for column, v in zip(out, (words, features, total, list(left), list(left.values())), strict=True):
                    column.append(v)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.binary()), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *[pa.array(c, t) for c, t in zip(out, kinds, strict=True)]],
                names=["doc_id", "n_words", "n_features", "sum", "keys", "counts"],
            )

    return run


def _scores(docs: DataFrame, target: DataFrame, order: int, buckets: int, seed: int) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score) of every row of docs(doc_id, text)."""
    counted = materialize(dictionary(docs, order, buckets), "dictionary")
    aim = materialize(dictionary(target, order, buckets), "target")
    gain = materialize(gains(counted, aim, buckets), "gains")
    words = counted.join(F.broadcast(gain), "bucket").select("key", "gain", "n")  # at most ``buckets`` rows
    frequent, most = _frequent(words)
    hot = docs.sparkSession.sparkContext.broadcast(frequent)
    each = docs.select("doc_id", "text").mapInArrow(
        _weighed(order, hot), "doc_id long, n_words long, n_features long, sum long, keys array<binary>, counts array<long>"
    )
    each = materialize(each.withColumn("row", F.monotonically_increasing_id()), "weighed")
    rest = each.select("row", F.explode(F.arrays_zip("keys", "counts")).alias("f")).select("row", F.col("f.keys").alias("key"), F.col("f.counts").alias("c"))
    rest = rest.join(words.where(F.col("n") <= most), "key").groupBy("row").agg(F.sum(F.col("c") * F.col("gain")).alias("more"))
    total = F.col("sum") + F.coalesce("more", F.lit(0))
    out = each.drop("keys", "counts").join(rest, "row", "left").withColumn("sum", total)
    weight = F.when(F.col("n_features") > 0, F.expr("(sum - pmod(sum, n_features)) div n_features")).otherwise(F.lit(0)).cast("long")
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.ln(-F.ln((h + 0.5) / 4294967296.0)))
    out = out.select("doc_id", "n_words", "n_features", weight.alias("weight"), (weight + noise).alias("score"))
    out = materialize(out, "scores")
    discard(counted, aim, gain, each)
    return out


def _ranked(scores: DataFrame, draws: int, least: int) -> DataFrame:
    """scores with rank: of the first ``draws`` rows by score that have ``least`` words, ties by id."""
    able = F.col("n_words") >= least
    one = scores.where(able).groupBy("score").agg(F.count(F.lit(1)).alias("m")).withColumn("high", F.shiftright("score", 8))
    before = lambda *keys: W.partitionBy(*keys).rowsBetween(W.unboundedPreceding, -1)
    high = one.groupBy("high").agg(F.sum("m").alias("m")).select("high", F.coalesce(F.sum("m").over(before().orderBy(F.desc("high"))), F.lit(0)).alias("above"))
    one = one.withColumn("over", F.coalesce(F.sum("m").over(before("high").orderBy(F.desc("score"))), F.lit(0))).join(high, "high")
    first = one.select(F.col("score").alias("_s"), (F.col("above") + F.col("over")).alias("_first")).where(F.col("_first") < draws)
    # scores are whole numbers between about -50,000 and 70,000
    both = scores.join(F.broadcast(first), (F.col("score") == F.col("_s")) & able, "left")
    place = F.col("_first") + F.row_number().over(W.partitionBy("score").orderBy(F.asc_nulls_last("doc_id")))
    met = both.where("_first is not null").withColumn("rank", place.cast("long"))
    met = met.withColumn("rank", F.when(F.col("rank") <= draws, F.col("rank")))
    rest = both.where("_first is null").withColumn("rank", F.lit(None).cast("long"))
    return met.union(rest).drop("_s", "_first")


def draw(
    docs: DataFrame, target: DataFrame, order: int = ORDER, buckets: int = BUCKETS, seed: int = SEED, percent: int = PERCENT, least: int = LEAST,
) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank) of every row of docs(doc_id, text); rank is null if it isn't drawn."""
    with scope():
        scores = hand_over(_scores(docs, target, order, buckets, seed))
        draws = scores.where(F.col("n_words") >= least).count() * percent // 100
        return _ranked(scores, draws, least)


def resample(docs: DataFrame, target: DataFrame, **given) -> DataFrame:
    """The rows of docs whose id is drawn, with their columns; given as in draw()."""
    drawn = draw(docs, target, **given).where("rank is not null").select(F.col("doc_id").alias("_drawn")).distinct()
    return docs.join(drawn, docs["doc_id"].eqNullSafe(drawn["_drawn"]), "left_semi")
