"""op1's crowds, op2, op3, op8 and op9 against plain loops over random rows."""

import hashlib
import random
import re

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from plumbline.llm import bpe, decontaminate, quality, suffix_dedup, url_filter  # noqa: E402
from plumbline.llm.q03_url_filter import RULES  # noqa: E402
from plumbline.llm.q08_bpe import vocabulary  # noqa: E402


def frame(spark, texts):
    """Texts with columns whose names the operators use themselves."""
    return spark.createDataFrame([(k, t, "s", 1, "x") for k, t in enumerate(texts)], "doc_id long, text string, source string, n int, `a.b` string")


@pytest.mark.parametrize("crowd", [3, 20_000])
def test_suffix_dedup_of_crowds(spark, crowd):
    """Few or many contexts of a gram, ordered by tries or counted as rows: the same bytes go."""
    rng = random.Random(1)
    common = "".join(rng.choice("abcd ") for _ in range(430))
    texts = ["".join(rng.choice("abcd") for _ in range(rng.randrange(90))) + common[rng.randrange(25) :] + str(k) for k in range(14)]
    texts += ["ab" * 500, "xyz" * 300, texts[0], None, "", common[:399], "é" * 450]
    raw = [(t or "").encode() for t in texts]
    seen = {}
    for d, t in enumerate(raw):
        for i in range(len(t) - 399):
            seen.setdefault(hashlib.md5(t[i : i + 400]).digest(), []).append((d, i))
    gone = [np.zeros(len(t), bool) for t in raw]
    for places in seen.values():
        if len(places) > 1:
            for d, i in places:
                gone[d][i : i + 400] = True
    for r in suffix_dedup.deduplicate(frame(spark, texts), crowd=crowd).collect():
        kept = bytes(np.frombuffer(raw[r["doc_id"]], np.uint8)[~gone[r["doc_id"]]])
        assert (r["n_removed"], bytes(r["kept"])) == (int(gone[r["doc_id"]].sum()), kept)


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def test_decontamination_of_items_of_every_length(spark):
    rng = random.Random(2)
    few = ["A", "b", "c1", "é", "dd"]
    say = lambda n: " ".join(rng.choice(few) + rng.choice(["", ",", ". "]) for _ in range(n))
    items = [(k, say(n)) for k, n in enumerate([1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 14, 30])] + [(50, None), (51, "..."), (52, "zz q zz"), (53, "zz q zz")]
    texts = [say(rng.choice([0, 1, 5, 12, 60])) for _ in range(25)] + [items[12][1], "x " + items[11][1] + " y " + items[8][1], "zz q zz q zz", None, ""]
    own = {i: words(t) for i, t in items}
    found = {r["doc_id"]: r for r in decontaminate.report(frame(spark, texts), spark.createDataFrame(items, "item_id long, text string")).collect()}
    for d, t in enumerate(texts):
        w, hit, met = words(t), set(), set()
        for i, v in own.items():
            size = min(len(v), 10)
            windows = {tuple(v[k : k + size]) for k in range(len(v) - size + 1)} if v else set()
            for k in range(len(w) - size + 1):
                if tuple(w[k : k + size]) in windows:
                    hit |= set(range(k, k + size))
                    met.add(str(i))
        r = found[d]
        assert (r["n_words"], r["n_hit"], r["n_items"], r["contaminated"]) == (len(w), len(hit), len(met), bool(hit))
        assert r["items_sha256"] == hashlib.sha256(",".join(sorted(met)).encode()).hexdigest()


def test_url_rules_on_random_urls(spark):
    rng = random.Random(3)
    part = lambda of: "".join(rng.choice(of) for _ in range(rng.randrange(4)))
    urls = [part(["http", "https", "x"]) + rng.choice(["://", "://", "", ":/"]) + part(["www.", "Example.com", "example.com", "a", ".", "net", "NET", "com", ".net"]) + part(["/", "en/", "/en/", "es/", "/fr/", "?", "#", "q", "/es/", "é"]) for _ in range(600)]
    urls += [None, "", "://", "http://net/es/", "http://a.net/es/x?y", "http://anet/es/", "http://www.example.com/en/", "http://x.www.example.com/en/a", "http://example.com/en", "http://net/es/"]
    pages = spark.createDataFrame([(k, u, 1) for k, u in enumerate(urls)], "page_id long, url string, rule int")
    for r in url_filter.judge(pages, RULES).collect():
        u = urls[r["page_id"]] or ""
        rest = u.split("://", 1)[1] if "://" in u else ""
        host = re.sub("[A-Z]", lambda m: m.group().lower(), re.split(r"[/?#]", rest)[0])
        path = re.split(r"[?#]", rest[len(host) :])[0]
        fits = [(len(p), p, v) for v, p in RULES for h, _, f in [p.partition("/")] if (host == h or host.endswith("." + h)) and path.startswith("/" + f)]
        _, rule, verdict = max(fits, default=(0, None, "allow"))
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == (host, path, rule, verdict), u


def test_quality_counts_on_random_texts(spark):
    rng = random.Random(4)
    texts = ["".join(rng.choice(["a", "b", " ", "  ", "\n", "\t", "é", "#", "$x", "漢字", "\r", "word"]) for _ in range(rng.choice([0, 3, 40, 400]))) for _ in range(60)] + [None, "", "\n\n", "a b c " * 40]
    for r in quality.judge(frame(spark, texts), ["doc_id", "a.b"]).collect():
        t = texts[r["row"]["doc_id"]] or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        at = {}
        for k in range(len(w) - 2):
            at.setdefault(tuple(w[k : k + 3]), []).append(k)
        repeat = {p for places in at.values() if len(places) > 1 for k in places for p in (k, k + 1, k + 2)}
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(repeat))
        q = r["q"]
        assert (q["n_words"], q["word_chars"], q["n_symbols"], q["n_dup_lines"], q["n_repeat_words"]) == want
        assert r["base_failed"] == (len(w) < 50 or 100 * len(repeat) > 50 * len(w))


def test_byte_pairs_of_a_megabyte(spark):
    rng = random.Random(5)
    texts = [" ".join("".join(rng.choice("abcdé漢 ") for _ in range(9)) for _ in range(60_000)), "x" * 300_000, "\n" * 1000, None]
    for r in bpe.encode(frame(spark, texts), *vocabulary(), carry=("doc_id", "text"), decode=True).collect():
        assert bytes(r["decoded"]) == (r["text"] or "").encode() and r["n_tokens"] * 4 == len(r["ids"])
