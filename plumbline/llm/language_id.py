"""Language identification by unigram pieces, summed over all segmentations.

A word (a run of letters, Unicode category L, lower-cased, with the vocabulary's word mark before it) can
be cut into pieces of a fixed public vocabulary in many ways. Its probability in a
language is the sum over all cuts of the product of the pieces' probabilities there,
computed by a forward pass; a text's log-probability adds up its words. The prediction
is the most probable language, its score the posterior under equal priors.

Piece probabilities of each language are learned by a few rounds of expectation
maximisation (forward-backward counts over all cuts) on the words of at most
``SAMPLE`` labelled documents of it, chosen by a hash, and smoothed towards all
languages together. Only the model (pieces by languages) meets the driver.

In tasks, all new words of a batch go through the forward pass at once, as arrays; a
task keeps the scores of words it has seen in a table that is emptied when full.

Edge cases: a null text, or one without a letter, is ``und`` with score 0; with no
labelled rows all texts are; characters outside the vocabulary have one small
probability in every language; a null doc_id is not held out and not learned from;
a word of over ``LONGEST`` letters is not learned from, and is scored exactly in a pass
that keeps the last few places only; repeated rows are predicted alike; empty tables give
empty results; other columns (lang and source included) are not read when predicting.
"""

from __future__ import annotations

import uuid

import numpy as np
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import wordhash

SAMPLE = 3000  # labelled documents of a language that are learned from
ROUNDS = 3
SMOOTHING = 50.0  # expected pieces given to the pooled distribution
UNKNOWN = -18.0  # log-probability of a character that no piece has
MARK = "▁"
WORDS = 400_000  # scores that a task keeps
_U = np.uint64
LONGEST = 256  # letters of a word whose whole lattice is held
STEP = 4096  # places of a longer one whose pieces are looked up together
_LETTERS = regex.compile(r"\p{L}+")
_BASE = _U(0x9E3779B97F4A7C15)


def words_of(text: str) -> list[str]:
    return _LETTERS.findall(text.lower())


class Pieces:
    """The vocabulary as a table from hashes of code points to piece numbers."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        plain = [k for k in range(len(model)) if not (model.is_control(k) or model.is_unknown(k) or model.is_byte(k))]
        texts = [model.id_to_piece(k) for k in plain]
        self.size, self.longest = len(model), max(map(len, texts))
        self.slots = 1 << 18
        self.keys, self.ids = np.zeros(self.slots, _U), np.full(self.slots, -1, np.int32)
        for k, t in zip(plain, texts, strict=True):
            h = _U(0)
            with np.errstate(over="ignore"):
                for c in t:
                    h = h * _BASE + _U(ord(c))
            h = wordhash.mix(np.array([h]))[0]
            at = int(h) & (self.slots - 1)
            while self.ids[at] >= 0:
                at = (at + 1) & (self.slots - 1)
            self.keys[at], self.ids[at] = h, k

    def find(self, h: np.ndarray) -> np.ndarray:
        h = wordhash.mix(h)
        out = np.full(len(h), -1, np.int32)
        todo, at = np.arange(len(h)), (h & _U(self.slots - 1)).astype(np.int64)
        while len(todo):
            ids = self.ids[at]
            same = (ids >= 0) & (self.keys[at] == h[todo])
            out[todo[same]] = ids[same]
            on = (ids >= 0) & ~same
            todo, at = todo[on], (at[on] + 1) & (self.slots - 1)
        return out

    def lattices(self, words: list[str], rows: int = 20_000):
        """Groups of words of one length: (their numbers, {(start, end): pieces})."""
        sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
        order = np.argsort(sizes, kind="stable")
        cut = np.flatnonzero(np.diff(sizes[order])) + 1
        for same in np.split(order, cut):
            for a in range(0, len(same), rows):
                pick = same[a : a + rows]
                n = int(sizes[pick[0]]) if len(pick) else 0
                if not n:
                    continue
                text = "".join(MARK + words[k] for k in pick.tolist())
                codes = np.frombuffer(text.encode("utf-32-le"), np.uint32).reshape(len(pick), n).astype(_U)
                spans = {}
                for i in range(n):
                    h = np.zeros(len(pick), _U)
                    for j in range(i, min(n, i + self.longest)):
                        h = h * _BASE + codes[:, j]
                        found = self.find(h)
                        if j == i or (found >= 0).any():
                            spans[i, j + 1] = found
                yield pick, n, spans

    def long(self, word: str, logp: np.ndarray) -> np.ndarray:
        """What _forward gives at the end of one word of any length, by language."""
        codes = np.frombuffer((MARK + word).encode("utf-32-le"), np.uint32).astype(_U)
        n, reach = len(codes), self.longest
        ahead = np.full((reach + 1, logp.shape[1]), -np.inf)  # log-sums of the place and those after it, in turn
        ahead[0] = 0.0
        sizes = np.arange(1, reach + 1)
        for a in range(0, n, STEP):
            starts = np.arange(a, min(a + STEP, n))
            h, ids = np.zeros(len(starts), _U), np.full((len(starts), reach), -1)
            for k in range(reach):
                inside = np.flatnonzero(starts + k < n)
                h[inside] = h[inside] * _BASE + codes[starts[inside] + k]
                ids[inside, k] = self.find(h[inside])
            for i, found in zip(starts.tolist(), ids, strict=True):
                weight = logp[found]
                weight[found < 0] = -np.inf
                if found[0] < 0:
                    weight[0] = UNKNOWN
                to = (i + sizes) % (reach + 1)
                ahead[to] = np.logaddexp(ahead[to], ahead[i % (reach + 1)] + weight)
                ahead[i % (reach + 1)] = -np.inf
        return ahead[n % (reach + 1)]


def _forward(n: int, spans: dict, logp: np.ndarray, reverse: bool = False) -> np.ndarray:
    """Log-sums over all cuts up to (or from) each place: [place, word, language]."""
    count = len(next(iter(spans.values())))
    out = np.full((n + 1, count, logp.shape[1]), -np.inf)
    out[n if reverse else 0] = 0.0
    keys = sorted(spans, key=(lambda s: (-s[0], s[1])) if reverse else (lambda s: (s[1], s[0])))
    for i, j in keys:
        here, there = (j, i) if reverse else (i, j)
        out[there] = np.logaddexp(out[there], out[here] + _weight(spans[i, j], logp, j - i))
    return out


def _weight(pieces: np.ndarray, logp: np.ndarray, size: int) -> np.ndarray:
    own = logp[pieces]
    own[pieces < 0] = UNKNOWN if size == 1 else -np.inf
    return own


def _learner(path: str):
    """Expected piece counts of one language from its (word, n) rows."""

    def run(frame):
        import pandas as pd

        pieces = Pieces(path)
        words, n = frame["word"].tolist(), frame["n"].to_numpy(float)
        lattices = list(pieces.lattices(words))
        counts = np.ones(pieces.size)
        for _ in range(ROUNDS):
            logp = np.log(counts / counts.sum())[:, None]
            counts = np.full(pieces.size, 1e-3)
            for pick, size, spans in lattices:
                before, after = _forward(size, spans, logp), _forward(size, spans, logp, True)
                for (i, j), found in spans.items():
                    known = found >= 0
                    log = before[i] + _weight(found, logp, j - i) + after[j] - before[size]
                    np.add.at(counts, found[known], np.exp(log[known, 0]) * n[pick][known])
        kept = np.flatnonzero(counts > 0.01)
        return pd.DataFrame({"lang": frame["lang"].iloc[0], "piece": kept, "n": counts[kept]})

    return run


def _word_rows(batches):
    import pyarrow as pa
    from collections import Counter

    for batch in batches:
        total: Counter = Counter()
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
            for w, n in Counter(words_of(text)).items():
                if len(w) <= LONGEST:
                    total[lang, w] += n
        yield pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in total], pa.string()), pa.array([k[1] for k in total], pa.string()), pa.array(list(total.values()), pa.int64())],
            names=["lang", "word", "n"],
        )


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learn(docs: DataFrame, path: str) -> tuple[list[str], np.ndarray]:
    """(languages, log-probabilities of pieces by language)."""
    rows = docs.where(~held_out()).where("lang is not null and text is not null and doc_id is not null")
    totals = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    langs = sorted(totals)
    if not langs:
        return [], np.zeros((0, 0))
    # a row is taken if its hash lies below the share of its language that makes SAMPLE
    share = F.create_map(*[F.lit(x) for k in langs for x in (k, min(1.0, SAMPLE / totals[k]))])
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    some = rows.where(place < F.element_at(share, F.col("lang"))).select("lang", "text")
    counted = some.mapInArrow(_word_rows, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    found = counted.groupBy("lang").applyInPandas(_learner(path), "lang string, piece int, n double").toPandas()
    pieces = int(found["piece"].max()) + 1 if len(found) else 1
    counts = np.zeros((Pieces(path).size if pieces else 1, len(langs)))
    counts[found["piece"].to_numpy(int), [langs.index(x) for x in found["lang"]]] = found["n"].to_numpy(float)
    pooled = (counts.sum(1) + 0.01) / (counts.sum() + 0.01 * len(counts))
    return langs, np.log((counts + SMOOTHING * pooled[:, None]) / (counts.sum(0) + SMOOTHING))


_known: dict = {}


class Scorer:
    """Log-probabilities of words, kept from batch to batch."""

    def __init__(self, path: str, logp: np.ndarray):
        self.pieces, self.logp = Pieces(path), logp
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.scores = np.zeros((WORDS, self.logp.shape[1]), np.float32)

    def _learn(self, new: list[str]) -> None:
        base = len(self.number)
        short = np.array([k for k, w in enumerate(new) if len(w) <= LONGEST], np.int64)
        for pick, n, spans in self.pieces.lattices([new[k] for k in short]):
            self.scores[base + short[pick]] = _forward(n, spans, self.logp)[n]
        for k, w in enumerate(new):
            if len(w) > LONGEST:
                self.scores[base + k] = self.pieces.long(w, self.logp)
        self.number.update(zip(new, range(base, base + len(new)), strict=True))

    def totals(self, texts: list[list[str]]) -> np.ndarray:
        """Log-probability of each list of words in each language."""
        out = np.zeros((len(texts), self.logp.shape[1]))
        for k, words in enumerate(texts):
            for a in range(0, len(words), WORDS // 4):
                part = words[a : a + WORDS // 4]
                self.prepare([part])
                out[k] += self.scores[list(map(self.number.__getitem__, part))].sum(0, dtype=np.float64)
        return out

    def prepare(self, texts: list[list[str]]) -> None:
        """Scores new words together, if the table holds them."""
        new = {w for words in texts for w in words if w not in self.number}
        if new and len(self.number) + len(new) > WORDS:
            self.clear()
            new = {w for words in texts for w in words}
        if new and len(new) <= WORDS:
            self._learn(list(new))


def _predictor(path: str, model, key: str):
    def run(batches):
        import pyarrow as pa

        langs, logp = model.value
        if langs and key not in _known:  # a worker keeps the words of its latest model
            _known.clear()
            _known[key] = Scorer(path, logp)
        scorer = _known.get(key)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                texts = [words_of(t) if t else [] for t in part.column("text").to_pylist()]
                pred, score = [], []
                if langs:
                    scorer.prepare(texts)
                    total = scorer.totals(texts)
                    total -= total.max(1, keepdims=True)
                    share = np.exp(total) / np.exp(total).sum(1, keepdims=True)
                for k, words in enumerate(texts):
                    none = not words or not langs
                    pred.append("und" if none else langs[int(share[k].argmax())])
                    score.append(0.0 if none else float(share[k].max()))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("held_out"), pa.array(pred, pa.string()), pa.array(score, pa.float64())],
                    names=["doc_id", "held_out", "lang_pred", "score"],
                )

    return run


def predict(docs: DataFrame, langs: list[str], logp: np.ndarray, path: str) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every row of docs(doc_id, text)."""
    rows = docs.select("doc_id", held_out().alias("held_out"), "text")
    model = docs.sparkSession.sparkContext.broadcast((langs, logp))
    kind = dict(rows.dtypes)["doc_id"]
    return rows.mapInArrow(_predictor(path, model, uuid.uuid4().hex), f"doc_id {kind}, held_out boolean, lang_pred string, score double")
