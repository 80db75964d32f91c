import hashlib
import random
import zlib

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from plumbline.llm import (  # noqa: E402
    bpe, decontaminate, huffman, jaccard_join, language_id, license_scan, passage_dedup, quality, regions, shared, suffix_dedup, token_file, url_filter, wordhash,
)
from plumbline.llm.q08_bpe import vocabulary  # noqa: E402

WORDS = [f"w{k}x" for k in range(400)]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n int, tok string, h string"


def corpus():
    rng = random.Random(4)
    say = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    passage = say(120)
    base = say(200)
    near = base.split()
    near[50] = "changed"
    texts = [
        base, base, " ".join(near), say(80) + " " + passage + " " + say(60), say(70) + " " + passage, passage + " " + passage, None, "", "one two",
        say(30), "ééé ünï " * 90, say(8000), "x" * 3000, say(100),
    ]
    return texts


def frame(spark, texts):
    rows = [(k, t, "en", "src", len(t or ""), 1, "tok", "h") for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark, corpus())


def test_suffix_dedup_equals_brute_force(spark, docs):
    texts = [(t or "").encode() for t in corpus()]
    size, seen = suffix_dedup.LENGTH, {}
    for d, t in enumerate(texts):
        for i in range(len(t) - size + 1):
            seen.setdefault(hashlib.md5(t[i : i + size]).digest(), []).append((d, i))
    gone = [np.zeros(len(t), bool) for t in texts]
    for places in seen.values():
        if len(places) > 1:
            for d, i in places:
                gone[d][i : i + size] = True
    for r in suffix_dedup.deduplicate(docs).collect():
        g = gone[r["doc_id"]]
        kept = bytes(b for b, x in zip(texts[r["doc_id"]], g) if not x)
        spans = int(np.diff(np.concatenate(([0], g.astype(int)))).clip(min=0).sum())
        assert (r["n_removed"], r["n_spans"], bytes(r["kept"])) == (int(g.sum()), spans, kept)


@pytest.mark.parametrize("edges", [1 << 16, 40])
def test_components_equal_a_plain_search(spark, edges, monkeypatch):
    monkeypatch.setattr(shared, "EDGES", edges)  # in one partition, and over several
    rng = random.Random(edges)
    pairs = [(rng.randrange(400), rng.randrange(400)) for _ in range(230)] + [(1000 + k, 1001 + k) for k in range(60)] + [(2000, k) for k in range(2001, 2050)] + [(None, 1), (7, None)]
    root = {}

    def top(k):
        while root.setdefault(k, k) != k:
            k = root[k]
        return k

    for a, b in pairs:
        if a is not None and b is not None and a != b:
            x, y = sorted((top(a), top(b)))
            root[y] = x
    found = shared.connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()
    assert len(found) == len(root) and {r["node"]: r["component"] for r in found} == {k: top(k) for k in root}
    assert shared.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_jaccard_equals_brute_force(spark, docs):
    sets = []
    for t in corpus():
        w = (t or "").lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    comp = list(range(len(sets)))
    for _ in sets:
        for a in range(len(sets)):
            for b in range(len(sets)):
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                    comp[a] = comp[b] = min(comp[a], comp[b])
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.components(docs).collect()}
    assert found == {k: (len(s), comp[k]) for k, s in enumerate(sets)}
    assert {r["doc_id"] for r in jaccard_join.keep_one(docs).collect()} == {k for k in comp if comp[k] == k}


def test_passages_go_once(spark, docs):
    out = {r["row"]["doc_id"]: r["n_removed"] for r in passage_dedup.cut_repeats(docs).collect()}
    assert len(out) == len(corpus())
    assert out[4] >= 100 and out[3] == 0  # the first place stays
    assert out[13] == 0 and out[9] == 0
    left = {r["doc_id"]: r for r in passage_dedup.drop_repeats(docs).collect()}
    assert left[4]["n_chars"] == len(left[4]["text"]) < len(corpus()[4]) and left[6]["text"] is None and left[0].asDict() == docs.where("doc_id = 0").first().asDict()


def near_removed(texts, flags=False):
    """Words that go (their number, or a flag for each), by brute force: all pairs of windows with the same gram at the same offset."""
    spec = regions.Spec("word", passage_dedup.LENGTH, passage_dedup.SHINGLE, passage_dedup.SHINGLE, passage_dedup.BANDS)
    meet, sets = {}, {}
    for d, t in enumerate(texts):
        w = t.split()
        h = wordhash.words(t.encode())[0]
        for band in range(spec.bands):
            grams = regions._word_grams(h, spec.gram)
            grams = wordhash.mix(grams ^ np.uint64(0x9E3779B97F4A7C15 * band % (1 << 64))) if band else grams
            for at, first, last in regions._selected(grams, np.full(len(h), len(h)), spec).T.tolist():
                for s in range(first, last + 1):
                    meet.setdefault((band, int(grams[at]), at - s), []).append((d, s))
                    sets[d, s] = {tuple(w[k : k + 5]) for k in range(s, s + 46)}
    root = {p: p for p in sets}

    def top(p):
        while root[p] != p:
            p = root[p]
        return p

    for places in meet.values():
        for i, p in enumerate(places):
            for q in places[:i]:
                if len(sets[p] & sets[q]) >= 0.75 * len(sets[p] | sets[q]):
                    a, b = sorted((top(p), top(q)))
                    root[b] = a
    gone = [np.zeros(len(t.split()), bool) for t in texts]
    for d, s in root:
        if top((d, s)) != (d, s):
            gone[d][s : s + 50] = True
    return gone if flags else [int(x.sum()) for x in gone]


def near_texts(seed):
    """Passages with one changed word in other surroundings, all with one boilerplate phrase."""
    rng = random.Random(seed)
    say = lambda n: [rng.choice(WORDS) for _ in range(n)]
    phrase, texts = say(10), []
    texts += [say(60) + phrase + say(60) for _ in range(4)]
    for size in (55, 60, 70):
        passage = say(size // 2) + phrase + say(size - size // 2 - 10)
        for _ in range(4):
            own = list(passage)
            own[rng.randrange(size)] = "changed"
            texts.append(say(rng.randrange(20, 60)) + own + say(rng.randrange(20, 60)))
    return [" ".join(t) for t in texts]


def removed(spark, texts, **options):
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = {r["row"]["doc_id"]: r["n_removed"] for r in passage_dedup.cut_repeats(rows, **options).collect()}
    return [out[k] for k in range(len(texts))]


def test_near_passages_beyond_the_earliest_equal_brute_force(spark):
    texts = near_texts(1)
    expected = near_removed(texts)
    assert sum(x > 0 for x in expected) >= 6
    assert removed(spark, texts) == expected


def test_near_passages_at_every_offset(spark):
    rng = random.Random(3)
    say = lambda n: [rng.choice(WORDS) for _ in range(n)]
    texts = []
    for _ in range(12):
        passage = say(55)
        for at in (None, 27):
            own = list(passage)
            own[at or 0] = "changed" if at else own[0]
            texts.append(" ".join(say(rng.randrange(20, 60)) + own + say(rng.randrange(20, 60))))
    expected = near_removed(texts)
    assert sum(x > 0 for x in expected) >= 10
    assert removed(spark, texts) == expected


def test_near_passages_of_crowded_grams(spark):
    texts = near_texts(2)
    assert removed(spark, texts, crowd=4) == removed(spark, texts) == near_removed(texts)


def test_decontamination(spark, docs):
    item = " ".join(corpus()[13].split()[20:35])
    bench = spark.createDataFrame([("i1", item), ("i2", None), ("i3", "one two"), ("i4", "nothing of this kind")], "item_id string, text string")
    rows = {r["doc_id"]: r for r in decontaminate.report(docs, bench).collect()}
    assert {k for k, r in rows.items() if r["contaminated"]} == {13, 8} and rows[13]["n_hit"] == 15 and rows[6]["n_words"] == 0
    assert decontaminate.drop_contaminated(docs, bench).count() == len(rows) - 2


def test_null_doc_ids(spark):
    text = corpus()[13]
    item = " ".join(text.split()[20:35])
    bench = spark.createDataFrame([("i1", item), (None, item)], "item_id string, text string")
    rows = spark.createDataFrame([(None, text), (1, text)], "doc_id long, text string").coalesce(1)
    assert [(r["n_hit"], r["n_items"], r["contaminated"]) for r in decontaminate.report(rows, bench).collect()] == [(15, 2, True)] * 2
    assert decontaminate.drop_contaminated(rows, bench).count() == 0


@pytest.mark.parametrize("parts", [1, 3])
@pytest.mark.parametrize("backwards", [False, True])
def test_null_and_repeated_ids_in_suffix_dedup(spark, parts, backwards):
    rng = random.Random(9)
    say = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    t = say(1000)
    rows = [(None, t), (5, t), (6, say(50) + t[:800] + say(60)), (7, say(900)), (8, u := say(900)), (8, say(700)), (8, t[100:800])]
    rows = rows[::-1] if backwards else rows
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts) if parts > 1 else spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    out = sorted((r["doc_id"] or 0, r["n_bytes"], r["n_removed"]) for r in suffix_dedup.deduplicate(frame).collect())
    assert out == sorted([(0, 1000, 1000), (5, 1000, 1000), (6, 910, 800), (7, 900, 0), (8, len(u), 0), (8, 700, 0), (8, 700, 700)])


def test_null_and_repeated_ids_in_passage_dedup(spark):
    rng = random.Random(5)
    say = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    t, u = say(120), say(90)
    rows = spark.createDataFrame([(None, t), (1, t), (1, u), (1, u), (2, say(30) + " " + t[:-20] + " " + say(30))], "doc_id long, text string")
    out = sorted((r["row"]["doc_id"] or 0, r["n_words"], r["n_removed"] > 0) for r in passage_dedup.cut_repeats(rows).collect())
    assert [(d, gone) for d, _, gone in out] == [(0, True), (1, False), (1, False), (1, False), (2, True)]


def test_bpe_round_trip(spark, docs):
    enc = bpe.encoding(*vocabulary())
    for r in bpe.encode(docs, *vocabulary(), carry=("doc_id", "text"), decode=True).collect():
        assert np.frombuffer(bytes(r["ids"]), "<u4").tolist() == enc.encode_ordinary(r["text"] or "")
        assert bytes(r["decoded"]) == (r["text"] or "").encode()


def test_token_file_equals_the_library(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    end = "<|endoftext|>"
    texts = [*corpus(), end, f"one {end} two", f"x{end}{end}y  {end}  z", "a <|endof", "text|> b", "<|endoftext", (f"word {end}, " * 40_000), "q" * 600_000]
    start = 0
    found = {r["doc_id"]: r for r in token_file.read(*token_file.write(frame(spark, texts).coalesce(1), public_tokenizers.path("byte_bpe_50k.json"))).collect()}
    for k, text in enumerate(texts):
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        assert (found[k]["start"], found[k]["n_tokens"], found[k]["ids_crc32"]) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_huffman_lengths_are_a_limited_prefix_code():
    counts = np.array([2**k for k in range(30)], np.int64)
    lengths = huffman.code_lengths(counts, 8)
    assert lengths.max() <= 8 and sum(2.0 ** -int(x) for x in lengths) <= 1.0


def test_url_rules(spark):
    urls = ["http://a.com/x", "http://www.example.com/en/p", "HTTPS://EXAMPLE.com/en/q?x", "http://b.net/fr/", "http://b.net/de/", None, "no host", ""]
    pages = spark.createDataFrame([(k, u) for k, u in enumerate(urls)], "page_id long, url string")
    rules = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]
    from plumbline.llm import q03_url_filter as q

    out = {r["page_id"]: (r["rule"], r["verdict"]) for r in url_filter.judge(pages, getattr(q, "RULES", rules)).collect()}
    assert out[1] == ("www.example.com/en/", "allow") and out[2] == ("example.com/en/", "block") and out[3][1] == "block" and out[4][0] is None
    assert len(out) == len(urls)


def test_quality_on_edge_cases(spark, docs):
    out = {r["row"]["doc_id"]: r for r in quality.judge(docs, ["doc_id", "source"]).collect()}
    assert len(out) == len(corpus())
    assert out[6]["q"]["n_words"] == 0 and out[6]["base_failed"] and not out[6]["kept"]
    assert out[0]["q"]["n_words"] == 200 and not out[0]["base_failed"]


def test_a_host_with_many_failures_is_rejected(spark):
    rng = random.Random(2)
    good = lambda: " ".join(rng.choice(WORDS) for _ in range(80))
    symbols = lambda: good() + " #$%&*|<>" * 60
    texts = [("bad", symbols()) for _ in range(30)] + [("bad", good()) for _ in range(3)] + [(f"h{k % 9}", good()) for k in range(200)] + [("h1", symbols()), (None, symbols())]
    rows = spark.createDataFrame([(k, t, s) for k, (s, t) in enumerate(texts)], "doc_id long, text string, source string")
    out = {r["row"]["doc_id"]: r for r in quality.judge(rows, ["doc_id"]).collect()}
    assert [out[k]["kept"] for k in range(30)] == [False] * 30 and all(out[k]["host_rejected"] for k in range(33))
    # clean documents of the host stay, and so do milder failures elsewhere
    assert all(out[k]["kept"] for k in range(30, len(texts))) and not any(r["base_failed"] for r in out.values())


def test_clashing_column_names(spark, docs):
    odd = docs.withColumns({c: docs["n"] for c in ("q", "_w", "_n", "_t", "row", "_row", "_key", "_words", "key", "doc", "spans", "whole", "gone", "toks", "a b:c", "kept")})
    bench = spark.createDataFrame([("i1", "one two")], "item_id string, text string")
    for work in (quality.filter_quality, passage_dedup.drop_repeats, jaccard_join.keep_one, lambda d: decontaminate.drop_contaminated(d, bench)):
        out = work(odd)
        assert out.columns == odd.columns
        assert {tuple(r[c] for c in odd.columns[8:]) for r in out.collect()} == {(1,) * 16}


def test_language_accuracy_on_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    path = public_tokenizers.path("piece_bpe_32k.model")
    langs, logp = language_id.learn(docs, path)
    rows = language_id.predict(docs, langs, logp, path).join(docs.select("doc_id", "lang"), "doc_id").where("held_out and lang is not null and lang_pred <> 'und'").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in rows]) >= 0.9


def test_forward_pass_sums_all_cuts():
    pieces = language_id.Pieces(public_tokenizers.path("piece_bpe_32k.model"))
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    texts = {model.id_to_piece(k): k for k in range(len(model)) if not (model.is_control(k) or model.is_unknown(k) or model.is_byte(k))}
    rng = np.random.default_rng(3)
    logp = np.log(rng.dirichlet(np.ones(pieces.size), 2)).T

    def cuts(text):
        if not text:
            return [[]]
        return [[text[:k], *rest] for k in range(1, len(text) + 1) if text[:k] in texts or k == 1 for rest in cuts(text[k:])]

    words = ["the", "thing", "straße", "ab", "☃"]
    for pick, n, spans in pieces.lattices(words):
        out = language_id._forward(n, spans, logp)[n]
        for row, k in enumerate(pick):
            each = [sum((logp[texts[p]] if p in texts else np.full(2, language_id.UNKNOWN)) for p in cut) for cut in cuts(language_id.MARK + words[k])]
            assert np.allclose(out[row], np.logaddexp.reduce(each))


def test_letters_and_long_runs():
    assert language_id.words_of("½ ² ① 12 _") == [] and language_id.words_of("Straße é1b") == ["straße", "é", "b"]
    assert [len(w) for w in language_id.words_of("x" * 600)] == [600]


@pytest.fixture(scope="module")
def scanner(spark):
    return license_scan.train(frame(spark, [*corpus(), "plain line\nLicensed under the Apache License, Version 2.0.", "the permission to speak was given late"]))


def test_license_classifier(spark, scanner):
    scanner, held = scanner
    rows = scanner.classify(held.withColumnRenamed("family", "truth")).collect()
    notices = [r for r in rows if r["truth"] != "unknown"]
    assert np.mean([r["truth"] == r["family"] for r in notices]) >= 0.9
    # of what gets a family, nearly all is right
    named = [r for r in rows if r["family"] != "unknown"]
    assert np.mean([r["truth"] == r["family"] for r in named]) >= 0.97
    assert scanner.gate_recall >= 0.97 and 0.5 <= scanner.limit < 0.99


LICENCES = {
    "All rights reserved.": "proprietary", "The MIT License": "MIT", "GNU General Public License": "GPL", "GNU GPL v3": "GPL", "CC BY-SA 4.0": "CC-BY-SA",
    "// SPDX-License-Identifier: MIT": "MIT", "# SPDX-License-Identifier: BSD-3-Clause": "BSD", "Licensed under the ISC License.": "ISC",
    "Distributed under the Boost Software License, Version 1.0.": "BSL-1.0",
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND,\nEXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY": "MIT",
    "This program is distributed in the hope that it will be useful,\nbut WITHOUT ANY WARRANTY; without even the implied warranty of\nMERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.": "GPL",
    " * Redistribution and use in source and binary forms, with or without\n * modification, are permitted provided that the following conditions\n * are met:": "BSD",
    # families that nothing was learned of, and plain sentences
    "Licensed under the Academic Free License version 3.0.": "", "This file is released under the Microsoft Public License.": "", "Distributed under the terms of the CeCILL license.": "",
    "the rights of all were reserved for later": "", "The permission to speak was given late.": "", "A free copy of the program was sent to the public library.": "",
}


def test_license_lines(spark, scanner):
    docs = frame(spark, [*corpus(), *(f"some words before\n\n{x}\n\nand after" for x in LICENCES)])
    found = license_scan.scan(docs.union(docs.where("doc_id >= 14")), scanner[0]).collect()
    out = {r["doc_id"]: r for r in found}
    n = len(corpus())
    assert {x: out[n + k]["licenses"] for k, x in enumerate(LICENCES)} == LICENCES
    assert len(found) == 2 * len(LICENCES) + n and all(r["n_confirmed"] <= 1 for r in found)
    assert out[6]["n_paragraphs"] == 0 and out[n]["n_paragraphs"] == 3 and out[n + 9]["n_paragraphs"] == 3
    assert license_scan.scan(frame(spark, []), scanner[0]).count() == 0


def test_recall_of_near_passages(spark):
    """Share of planted near passages found, against all windows of 50 words on their diagonal."""
    rng = random.Random(6)
    words = [f"v{k}" for k in range(3000)]
    say = lambda n: [rng.choice(words) for _ in range(n)]
    texts, due = [], []
    for k in range(80):
        passage = say(rng.randrange(55, 110))
        near = [w if rng.random() >= 0.01 * (k % 6) else rng.choice(words) for w in passage]
        a, b = say(rng.randrange(20, 50)), say(rng.randrange(20, 50))
        texts += [a + passage + say(25), b + near + say(25)]
        grams = lambda t, s: {tuple(t[i : i + 5]) for i in range(s, s + 46)}
        pairs = [(grams(passage, s), grams(near, s)) for s in range(len(passage) - 49)]
        if any(100 * len(x & y) >= 75 * len(x | y) for x, y in pairs):
            due.append(2 * k + 1)
    out = removed(spark, [" ".join(t) for t in texts])
    assert len(due) > 50 and np.mean([out[k] > 0 for k in due]) >= 0.9
    assert not any(out[k] for k in range(len(texts)) if k % 2 == 0)


def test_very_long_texts(spark):
    rng = random.Random(3)
    long = " ".join(rng.choice(WORDS) for _ in range(150_000))
    passage = " ".join(long.split()[70_000:70_200])
    texts = [long, passage, "x" * 1_000_000, "lorem " * 100_000]
    docs = frame(spark, texts)
    out = {r["row"]["doc_id"]: r["q"]["n_words"] for r in quality.judge(docs, ["doc_id"]).collect()}
    assert out == {0: 150_000, 1: 200, 2: 1, 3: 100_000}
    bench = spark.createDataFrame([("i", " ".join(passage.split()[:12]))], "item_id string, text string")
    assert {r["doc_id"]: r["n_hit"] for r in decontaminate.report(docs, bench).collect()} == {0: 12, 1: 12, 2: 0, 3: 0}
    assert {r["row"]["doc_id"]: r["n_removed"] for r in passage_dedup.cut_repeats(docs).collect()} == {0: 0, 1: 200, 2: 0, 3: 99_999}
    assert {r["doc_id"]: r["component_id"] for r in jaccard_join.components(docs).collect()} == {k: k for k in range(4)}
    pages = spark.createDataFrame([(1, "http://a.net/fr/" + "y" * 200_000), (2, "http://" + "z" * 200_000 + ".net/es/")], "page_id long, url string")
    rules = [("block", "net/es/"), ("block", "net/fr/")]
    assert {r["page_id"]: r["rule"] for r in url_filter.judge(pages, rules).collect()} == {1: "net/fr/", 2: "net/es/"}


def test_repeated_rows(spark):
    one = frame(spark, corpus()).where("doc_id in (0, 3, 6, 13)")
    twice = one.union(one)
    bench = spark.createDataFrame([("i", " ".join(corpus()[13].split()[:12]))], "item_id string, text string")
    for work in (lambda d: decontaminate.report(d, bench), jaccard_join.components, lambda d: bpe.encode(d, *vocabulary(), carry=("doc_id",))):
        key = lambda r: str(r)
        assert sorted(map(tuple, work(twice).collect()), key=key) == sorted([x for r in work(one).collect() for x in (tuple(r), tuple(r))], key=key)
    assert passage_dedup.drop_repeats(twice).count() == 8 and all(r["n_removed"] == r["n_bytes"] for r in suffix_dedup.deduplicate(twice).collect() if r["n_bytes"] >= 400)


def test_empty_tables(spark):
    none = frame(spark, [])
    items = spark.createDataFrame([], "item_id string, text string")
    assert suffix_dedup.deduplicate(none).count() == 0
    assert jaccard_join.components(none).count() == 0
    assert passage_dedup.drop_repeats(none).count() == 0
    assert bpe.encode(none, *vocabulary()).count() == 0
    assert quality.filter_quality(none).count() == 0
    assert decontaminate.report(none, items).count() == 0 and decontaminate.drop_contaminated(frame(spark, corpus()), items).count() == len(corpus())
    assert url_filter.judge(spark.createDataFrame([], "page_id long, url string"), [("allow", "com/")]).count() == 0
    assert token_file.read(*token_file.write(none, public_tokenizers.path("byte_bpe_50k.json"))).count() == 0


def test_two_large_groups_with_a_shared_passage(spark):
    rng = random.Random(8)
    say = lambda n: [rng.choice(WORDS) for _ in range(n)]
    passage, texts = say(40), []
    for _ in range(2):
        base = passage + say(50)
        for _ in range(110):
            own = list(base)
            for _ in range(rng.randrange(5)):
                own[rng.randrange(len(own))] = f"new{rng.randrange(10**6)}"
            texts.append(" ".join(own))
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (t.split() for t in texts)]
    comp = list(range(len(sets)))

    def top(k):
        while comp[k] != k:
            k = comp[k]
        return k

    for a in range(len(sets)):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)))
                comp[y] = x
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in jaccard_join.components(rows).collect()} == {k: top(k) for k in range(len(texts))}
