"""Toxicity by multiple-instance learning: labels of documents, scores of sentences.

A document is a bag of sentences. A sentence is toxic with probability
p = sigmoid(bias + sum of the weights of its distinct words), and a document with
1 - (1 - leak) * product of (1 - p) over its sentences (noisy-or): one bad sentence is
enough, and the leak stands for labels that no sentence explains. A word's weight is the
sum of those of its parts: the whole word, and its runs of ``GRAM`` characters with marks at
both ends, so that a new compound of a known stem has a weight too. Weights, bias and leak
are fitted together from document labels alone; afterwards the sentences that a document
owes its score to are located.

Learning reads a bounded sample of labelled rows: about ``SAMPLE`` documents of each label,
chosen by a hash of the id among texts of at most ``LONGEST`` bytes, each weighted so that
the classes keep their shares. Equal texts count once, with their mean label, so that a
large group of copies is not learned by heart. Of the parts in the sample, those ``PARTS``
enter whose presence depends most on the label. The sample reaches the driver as part
numbers per sentence and is fitted there in numpy; every other step runs in tasks, and the
model (some thousand parts) is what they are sent.

Edge cases: null and empty texts have no sentences and score the leak; ids are read for the
sample only, a null id is never learned from; several labels of an id count as toxic if one
is; repeated rows are scored alike and all returned; a table without usable labels gives a
leak of 0.5 and no parts, so every score is 0.5; very long texts are scored whole, sentence
by sentence; an empty table gives an empty result; other columns are carried by name or not
read.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import terms, wordhash
from .shared import materialize, scope, sized

FOLDS = 5
SAMPLE = 4096
LONGEST = 1 << 16
PARTS = 2048
GRAM = 5
LIKELY = 0.5
STEPS = 400
RATE = 0.05
PENALTY = 0.2  # of the squared weights, in documents
LONG = 48  # characters of a word that is looked at
KNOWN = 1 << 19  # words whose weight a task remembers
SENTENCE = re.compile(rb"[.!?]+(?=[\x20\x09-\x0D]|\Z)|\n")


def held_out(ident: Column) -> Column:
    """Whether rows of this id are never learned from."""
    return F.coalesce(F.pmod(F.crc32(ident.cast("string").cast("binary")), F.lit(FOLDS)) == 0, F.lit(False))


@dataclass
class Model:
    weights: dict[str, float] = field(default_factory=dict)
    bias: float = -100.0
    leak: float = 0.5


def _places(low: bytes):
    """(first byte, end) of every sentence, as in _sentences; marks at its end belong to it."""
    at = 0
    for mark in [*SENTENCE.finditer(low), None]:
        end = mark.end() if mark else len(low)
        if terms.WORDS.search(low, at, end):
            yield at, end
        at = end


def _sentences(low: bytes):
    """The distinct words of every sentence that has a letter or digit."""
    for part in SENTENCE.split(low):
        words = terms.LETTERS.findall(part)
        if words or terms.WORDS.search(part):
            yield set(words)


def parts(word: bytes) -> set[str]:
    """A word between marks, and its runs of GRAM characters with them."""
    if len(word) > 4 * LONG:
        return set()
    marked = f"<{word.decode(errors='replace')}>"
    return {marked, *(marked[k : k + GRAM] for k in range(len(marked) - GRAM + 1))} if len(marked) <= LONG + 2 else set()


class _Memo(dict):
    """What ``of`` gives for each word; emptied when it holds too many."""

    def __init__(self, of):
        super().__init__()
        self.of = of

    def __missing__(self, word):
        if len(self) >= KNOWN:
            self.clear()
        out = self[word] = self.of(word)
        return out


def _presence(batches):
    """(part, toxic, n): documents of the sample with a part, by label."""
    import pyarrow as pa

    held: dict[int, Counter] = {0: Counter(), 1: Counter()}
    for batch in wordhash.small(batches):
        for toxic, raw in zip(batch.column("toxic").to_pylist(), wordhash.utf8(batch.column("text")), strict=True):
            words = {w for found in terms.pieces(raw, terms.LETTERS) for w in found}
            held[toxic].update(set().union(*map(parts, words)))
    for toxic, n in held.items():
        columns = [pa.array(list(n), pa.string()), pa.array([toxic] * len(n), pa.int32()), pa.array(list(n.values()), pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=["part", "toxic", "n"])


def _bags(number: dict[str, int]):
    """(digest, toxic, blank, ids): a text, its sentences without known parts, the part numbers of the others, -1 after each."""

    def run(batches):
        import pyarrow as pa
        import xxhash

        known = _Memo(lambda w: sorted(number[p] for p in parts(w) if p in number))
        for batch in wordhash.small(batches):
            out = [[], [], []]
            for raw in wordhash.utf8(batch.column("text")):
                low, blank, ids = raw.lower(), 0, []
                for words in _sentences(low):
                    met = sorted(k for w in words for k in known[w])
                    if met:
                        ids += [*met, -1]
                    else:
                        blank += 1
                for column, v in zip(out, (xxhash.xxh3_128_digest(raw), blank, ids), strict=True):
                    column.append(v)
            columns = [pa.array(c, t) for c, t in zip(out, (pa.binary(), pa.int64(), pa.list_(pa.int32())), strict=True)]
            yield pa.RecordBatch.from_arrays([columns[0], batch.column("toxic"), *columns[1:]], names=["digest", "toxic", "blank", "ids"])

    return run


def _sample(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, dict[int, float]]:
    """(text, toxic) of the documents to learn from, and how many each stands for, by label."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic"))
    known = materialize(known, "labelled")
    sizes = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = {y: min(1.0, SAMPLE / n) for y, n in sizes.items()}
    part = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1 << 20))
    chosen = known.where(part < F.when(F.col("toxic") == 1, int(share.get(1, 0.0) * (1 << 20))).otherwise(int(share.get(0, 0.0) * (1 << 20))))
    chosen = materialize(chosen.withColumnRenamed("doc_id", "_id"), "sampled")
    some = docs.where(F.octet_length("text") <= LONGEST).join(sized(chosen), F.col("doc_id") == F.col("_id")).select("text", "toxic")
    return materialize(some, "toxic-sample"), {y: 1 / s for y, s in share.items()}


def _vocabulary(some: DataFrame) -> list[str]:
    """The parts whose presence tells most about the label, by the square of its standardised log odds."""
    total = {r["toxic"]: r["n"] for r in some.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    n1, n0 = float(total.get(1, 0)), float(total.get(0, 0))
    found = some.mapInArrow(_presence, "part string, toxic int, n long").groupBy("part").agg(
        F.sum(F.col("n") * F.col("toxic")).alias("a"), F.sum(F.col("n") * (1 - F.col("toxic"))).alias("b")
    )
    odds = lambda c, n: F.ln((F.col(c) + 0.5) / (F.greatest(F.lit(n) - F.col(c), F.lit(0.0)) + 0.5))
    spread = sum((1 / (F.col(c) + 0.5) for c in ("a", "b")), F.lit(0.0))
    best = found.where(F.col("a") + F.col("b") >= 3).withColumn("z", F.pow(odds("a", n1) - odds("b", n0), 2) / spread)
    return [r["part"] for r in best.orderBy(F.desc("z"), "part").limit(PARTS).select("part").collect()]


def _softplus(z: np.ndarray) -> np.ndarray:
    return np.maximum(z, 0) + np.log1p(np.exp(-np.abs(z)))


def _sigmoid(z):
    return np.exp(-_softplus(-np.asarray(z, float)))


def fit(y: np.ndarray, c: np.ndarray, blank: np.ndarray, bag: np.ndarray, line: np.ndarray, ids: np.ndarray, size: int) -> tuple[np.ndarray, float, float]:
    """Weights, bias and leak from bags with mean label y, weight c and a number of blank sentences; the
    other sentences have the bag of each in ``bag``, and part ids[k] is in sentence line[k].

    Adam on the penalised likelihood of the document labels; no randomness."""
    mean = float((y * c).sum() / c.sum())
    x = np.zeros(size + 2)
    x[size], x[size + 1] = -5.0, np.log(max(mean, 1e-3) / 4)
    m, v = np.zeros_like(x), np.zeros_like(x)
    for step in range(1, STEPS + 1):
        w, bias, leak = x[:size], x[size], x[size + 1]
        z = bias + np.bincount(line, w[ids], len(bag))
        clean = -_softplus(leak) - blank * _softplus(bias) - np.bincount(bag, _softplus(z), len(y))
        clean = np.minimum(clean, -1e-12)  # log of the probability that nothing is toxic
        slope = c * ((1 - y) - y * np.exp(clean) / -np.expm1(clean))
        on = -slope[bag] * _sigmoid(z)
        grad = np.concatenate((
            np.bincount(ids, on[line], size) - PENALTY * w, [on.sum() - (slope * blank).sum() * _sigmoid(bias), -slope.sum() * _sigmoid(leak)],
        )) / c.sum()
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        x = x + RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return x[:size], float(x[size]), float(_sigmoid(x[size + 1]))


def learn(docs: DataFrame, labels: DataFrame) -> Model:
    """A model from docs(doc_id, text) and labels(doc_id, toxic) of rows that are not held out."""
    with scope():
        some, stands = _sample(docs, labels)
        every = _vocabulary(some)
        number = {p: k for k, p in enumerate(every)}
        rows = some.mapInArrow(_bags(number), "digest binary, toxic int, blank long, ids array<int>")
        same = rows.groupBy("digest").agg(
            F.avg(F.col("toxic").cast("double")).alias("y"), F.first("blank").alias("blank"), F.first("ids").alias("ids"),
        ).orderBy("digest").select("y", "blank", "ids").toArrow()  # the sample, as part numbers
    if not same.num_rows:
        return Model()
    y, blank = same.column("y").to_numpy(), same.column("blank").to_numpy().astype(float)
    listed = same.column("ids").combine_chunks()
    ids, ends = listed.flatten().to_numpy(), np.cumsum(listed.value_lengths().to_numpy())
    stop = ids < 0  # after each sentence
    bag = np.searchsorted(ends, np.flatnonzero(stop), side="right").astype(np.int32)
    line = (np.cumsum(stop) - stop).astype(np.int32)[~stop]
    c = y * stands.get(1, 1.0) + (1 - y) * stands.get(0, 1.0)
    weights, bias, leak = fit(y, c, blank, bag, line, ids[~stop], len(every))
    return Model({p: float(x) for p, x in zip(every, weights, strict=True) if abs(x) > 1e-3}, bias, leak)


def _scored(model):
    def run(batches):
        import math

        import pyarrow as pa

        weights, bias, leak = model.value.weights, model.value.bias, model.value.leak
        weight = _Memo(lambda w: math.fsum(weights[p] for p in parts(w) if p in weights))
        spot = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))
        base = math.log1p(-min(leak, 1 - 1e-12))
        for batch in wordhash.small(batches):
            scores, counts, spots = [], [], []
            for raw in wordhash.utf8(batch.column("text")):
                low = raw.lower()
                # an exact sum, as the order of a set differs between tasks
                z = bias + np.array([math.fsum(map(weight.__getitem__, words)) for words in _sentences(low)])
                scores.append(-math.expm1(base - _softplus(z).sum()))
                counts.append(len(z))
                likely = _sigmoid(z) if len(z) and z.max() >= 0 else ()
                spots.append([{"start": s, "end": e, "score": p} for (s, e), p in zip(_places(low), likely, strict=True) if p >= LIKELY] if len(likely) else [])
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), pa.array(scores, pa.float64()), pa.array(counts, pa.int64()), pa.array(spots, spot)],
                names=["row", "score", "n_sentences", "located"],
            )

    return run


def score(docs: DataFrame, model: Model, carry: list[str]) -> DataFrame:
    """(row, score, n_sentences, located) for every row of docs(text, ..): the columns named in carry as
    a struct, and the sentences that are likelier toxic than not, as first byte, end and probability."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row"), "text")
    kind = rows.schema["row"].dataType.simpleString() if all(re.fullmatch(r"\w+", c) for c in carry) else None
    if kind is None:
        raise ValueError("carried columns need plain names")
    shape = f"row {kind}, score double, n_sentences long, located array<struct<start: bigint, end: bigint, score: double>>"
    return rows.mapInArrow(_scored(sent), shape)


def passages(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, start, end, score, sentence): every located sentence with its text."""
    rows = score(docs, model, ["doc_id", "text"]).select("row.doc_id", "row.text", F.explode("located").alias("s"))
    sentence = F.substring(F.col("text").cast("binary"), F.col("s.start").cast("int") + 1, (F.col("s.end") - F.col("s.start")).cast("int")).cast("string")
    return rows.select("doc_id", "s.start", "s.end", "s.score", sentence.alias("sentence"))
