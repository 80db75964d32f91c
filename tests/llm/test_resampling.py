"""op11, op12 and op13 against plain loops, and held-out accuracy of op12."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest

pytest.importorskip("public_tokenizers")

from plumbline.llm import catalog, divergence, importance, terms, toxicity  # noqa: E402

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, term string, n long, `a.b` string"


def rows(texts, langs=("en", None, "fr"), sources=("s1", "s2", None, "s3")):
    return [(k if k != 5 else None, t, langs[k % len(langs)], sources[k % len(sources)], "term", 1, "x") for k, t in enumerate(texts)]


def texts():
    rng = random.Random(3)
    words = ["The", "a", "é", "naïve", "x1", "B", "word", "other", "ÀB", "zz9"] + [f"w{k}" for k in range(30)]
    say = lambda n: " ".join(rng.choice(words) + rng.choice(["", ".", ",", "  "]) for _ in range(n))
    out = [say(rng.choice([3, 19, 20, 40, 200])) for _ in range(60)]
    return out + [None, "", "...", out[0], out[0], "y" * 5000 + " y", say(6000)]


def frame(spark, texts):
    return spark.createDataFrame(rows(texts), SCHEMA)


def words(text, letters=False):
    first = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+" if letters else r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    return re.findall(first, re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def test_long_texts_are_read_in_pieces(monkeypatch):
    whole = [list(terms.WORDS.findall(t.encode().lower())) for t in map(str, texts()[:60])]
    monkeypatch.setattr(terms, "PIECE", 7)
    assert [[w for p in terms.pieces(t.encode(), terms.WORDS) for w in p] for t in map(str, texts()[:60])] == whole
    for raw in (b"aa bb cc dd ee", b"aaaaaaaaaaaaaaaaaaaa b", b"       a"):
        own = [w for p, _ in importance._features(raw, 3) for w in p]
        w = raw.split()
        assert sorted(own) == sorted(b" ".join(w[k : k + n]) for n in (1, 2, 3) for k in range(len(w) - n + 1))


@pytest.mark.parametrize("order,hot", [(1, 1 << 17), (1, 3), (2, 5), (1, 0)])
def test_resampling_equals_plain_loops(spark, order, hot, monkeypatch):
    monkeypatch.setattr(importance, "HOT", hot)
    given = texts()
    docs, target = frame(spark, given), spark.createDataFrame([("the naïve word",), (None,), ("w1 w2 w3 zz9 é",)], "text string")
    grams = lambda t: [" ".join(w[k : k + n]) for w in [words(t)] for n in range(1, order + 1) for k in range(len(w) - n + 1)]
    bucket = lambda g: zlib.crc32(g.encode()) % 50
    s, t = Counter(), Counter()
    for x in given:
        s.update(map(bucket, grams(x)))
    for x in ("the naïve word", "w1 w2 w3 zz9 é"):
        t.update(map(bucket, grams(x)))
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (big_s + 50) / ((s[b] + 1) * (big_t + 50)))) for b in s}
    want = []
    for k, x in enumerate(given):
        g = grams(x)
        weight = sum(gain[bucket(f)] for f in g) // len(g) if g else 0
        h = int(hashlib.sha256(f"2024:{'' if k == 5 else k}".encode()).hexdigest()[:8], 16)
        want.append([None if k == 5 else k, len(g), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words(x))])
    able = sorted((w for w in want if w[4] >= 20), key=lambda w: (-w[3], w[0] is None, w[0]))
    rank = {w[0]: k for k, w in enumerate(able[: len(able) * 30 // 100], 1)}
    found = importance.draw(docs, target, order=order, buckets=50, percent=30).collect()
    assert sorted(((r["doc_id"], r["n_features"], r["weight"], r["score"], r["rank"]) for r in found), key=str) == sorted(
        ((w[0], w[1], w[2], w[3], rank.get(w[0])) for w in want), key=str
    )
    if hot == 3:
        kept = importance.resample(docs, target, order=order, buckets=50, percent=30)
        assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == set(rank)


def test_resampling_of_nothing(spark):
    none, some = frame(spark, []), spark.createDataFrame([("a b",)], "text string")
    assert importance.draw(none, some).count() == 0
    alone = importance.draw(frame(spark, ["a b", None]), some.limit(0)).collect()
    assert {(r["doc_id"], r["n_features"], r["rank"]) for r in alone} == {(0, 2, None), (1, 0, None)}


def plain_audit(given, least, top):
    groups, docs = {}, {}
    for _, t, lang, source, *_ in given:
        lang, source = lang or "", source or ""
        w = words(t, letters=True)
        groups.setdefault(lang, {}).setdefault(source, Counter()).update(w)
        docs.setdefault(lang, Counter()).update(set(w))
    out = []
    for lang, own in groups.items():
        kept = [t for t, n in docs[lang].items() if n >= least]
        share = lambda c: {t: 1 + 10**9 * (c[t] + 2) // (sum(c[x] for x in kept) + 2 * len(kept)) for t in kept}
        p = {s: share(c) for s, c in own.items()}
        q = share(sum(own.values(), Counter()))
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s, c in own.items():
            pairs = sorted((-sum(f(p[s][t], p[o][t]) for t in kept), o.encode()) for o in own if o != s)
            telling = sorted((-f(p[s][t], q[t]), t.encode()) for t in kept if c[t] and p[s][t] > q[t])[:top]
            for part, found in (("pair", pairs), ("term", telling)):
                out += [(lang, s, part, x.decode(), -v, k) for k, (v, x) in enumerate(found, 1)]
    return sorted(out)


@pytest.mark.parametrize("tile,groups", [(2048, 64), (3, 2), (1, 1)])
def test_audit_equals_plain_loops(spark, tile, groups, monkeypatch):
    monkeypatch.setattr(divergence, "TERMS", tile)
    monkeypatch.setattr(divergence, "GROUPS", groups)
    monkeypatch.setattr(divergence, "CELLS", tile * 3)
    given = rows(texts()) + [(900, "only here", "qq", "s1", "", 1, ""), (901, None, "qq", "s2", "", 1, ""), (902, "", "zz", None, "", 1, "")]
    found = divergence.audit(spark.createDataFrame(given, SCHEMA), least=4, top=3).collect()
    assert sorted(tuple(r) for r in found) == plain_audit(given, 4, 3)
    assert divergence.audit(spark.createDataFrame([], SCHEMA)).count() == 0


def test_shares_are_exact_beyond_sixty_four_bits(spark):
    one = spark.sql("select 9000000000000 as n, 30000000000007 as total, 12345678 as kept")
    assert one.select(divergence._share("n", "total", "kept")).first()[0] == 1 + 10**9 * (9000000000000 + 2) // (30000000000007 + 2 * 12345678)


BAD = ("You absolute grobnik. ", "what a Grobnikel\n", "blarg off! ")


def labelled(spark, n=700):
    rng = random.Random(8)
    fine = [f"w{k}" for k in range(200)]
    docs, labels, bad = [], [], {}
    for k in range(n):
        toxic = rng.random() < 0.2
        lines = [" ".join(rng.choice(fine) for _ in range(rng.randint(3, 9))).capitalize() + ". " for _ in range(rng.randint(1, 12))]
        if toxic:
            at = rng.randrange(len(lines) + 1)
            lines.insert(at, rng.choice(BAD))
            bad[k] = lines[at].strip()
        docs.append((k, "".join(lines), "en", "s", "t", 1, "x"))
        labels.append((k, 1, int(toxic)))
    docs += [(5000, None, None, None, None, None, None), (5001, "", "en", "s", "t", 1, "x"), (None, docs[0][1], "en", "s", "t", 1, "x"), docs[1]]
    docs.append((5002, "Fine words here. " * 60000 + "blarg off! " + "w1 w2. " * 10, "en", "s", "t", 1, "x"))
    labels += [(0, 1, labels[0][2]), (1, None, None), (None, 1, 1)]
    return spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), docs, dict((a, c) for a, _, c in labels if c is not None), bad


def test_toxicity_finds_documents_and_sentences(spark):
    docs, labels, given, truth, bad = labelled(spark)
    model = toxicity.learn(docs, labels)
    found = toxicity.score(docs, model, ["doc_id", "n"]).collect()
    assert len(found) == len(given)
    weight = lambda w: math.fsum(model.weights.get(p, 0.0) for p in toxicity.parts(w))
    by_id = {}
    for r in found:
        by_id.setdefault(r["row"]["doc_id"], []).append(r)
    for k, t, *_ in given:
        r, clean, n = by_id[k][0], 1 - model.leak, 0
        for s in re.split(rb"[.!?]+(?=\s|\Z)|\n", (t or "").encode().lower()):
            if re.search(rb"[0-9a-z\x80-\xff]", s):
                n += 1
                z = model.bias + sum(weight(w) for w in set(re.findall(rb"[a-z\x80-\xff]+", s)))
                clean *= 1 - 1 / (1 + math.exp(-z))
        assert r["n_sentences"] == n and abs(r["score"] - (1 - clean)) < 1e-9
    out = [k for k in truth if k is not None and zlib.crc32(str(k).encode()) % 5 == 0]
    assert len(out) > 100 and all((by_id[k][0]["score"] >= 0.5) == bool(truth[k]) for k in out)
    spots = {}
    for r in toxicity.passages(docs, model).collect():
        spots.setdefault(r["doc_id"], set()).add(r["sentence"].strip())
    assert {k: spots.get(k) for k in out if truth[k]} == {k: {bad[k]} for k in out if truth[k]} and not any(k in spots for k in out if not truth[k])
    assert by_id[5000][0]["score"] == by_id[5001][0]["score"] < 0.5 and by_id[5002][0]["score"] > 0.5
    assert by_id[1][0]["score"] == by_id[1][1]["score"] and by_id[0][0]["score"] == by_id[None][0]["score"]


def test_toxicity_learns_nothing_from_held_out_rows(spark):
    docs, labels, *_ = labelled(spark, 200)
    changed = labels.withColumn("toxic", toxicity.F.when(toxicity.held_out(toxicity.F.col("doc_id")), 1 - labels["toxic"]).otherwise(labels["toxic"]))
    assert toxicity.learn(docs, labels) == toxicity.learn(docs, changed)
    other = docs.withColumn("lang", toxicity.F.lit("xx")).withColumn("source", toxicity.F.lit("yy"))
    assert toxicity.learn(docs, labels) == toxicity.learn(other, labels)
    none = toxicity.learn(docs, labels.limit(0))
    assert {r["score"] for r in toxicity.score(docs, none, ["doc_id"]).collect()} == {0.5}
    assert toxicity.score(docs.limit(0), none, ["doc_id"]).count() == 0


@pytest.mark.parametrize("name", ["op11_importance_resampling", "op12_toxicity", "op13_source_divergence"])
def test_registered(spark, name):
    import duckdb

    found = catalog.queries()[name](spark, SF)
    sql = catalog.oracle_sql().get(name)
    if sql is None:
        assert found.select("doc_id", "held_out", "score", "predicted").where("score between 0 and 1").count() == 200
        return
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    got = con.execute(f"SELECT {', '.join(found.columns)} FROM ({sql})").fetchall()
    assert sorted(map(tuple, found.collect()), key=str) == sorted(got, key=str)
