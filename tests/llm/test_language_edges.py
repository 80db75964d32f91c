"""op6: long runs, nulls, ties, repeated rows and empty tables."""

import random

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from plumbline.llm import language_id  # noqa: E402

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.mark.parametrize("step", [4096, 5])
def test_long_runs_are_scored_exactly(monkeypatch, step):
    monkeypatch.setattr(language_id, "STEP", step)
    pieces, rng = language_id.Pieces(PATH), random.Random(1)
    logp = np.log(np.random.default_rng(2).random((pieces.size, 3)) / pieces.size)
    for n in (1, 2, 17, 40, 300):
        word = "".join(rng.choice("etaoinshrdluéß漢") for _ in range(n))
        _, size, spans = next(iter(pieces.lattices([word])))
        assert np.allclose(pieces.long(word, logp), language_id._forward(size, spans, logp)[size][0], rtol=1e-12)


def test_edge_rows(spark):
    rng = random.Random(3)
    say = lambda letters, n: " ".join("".join(rng.choice(letters) for _ in range(5)) for _ in range(n))
    rows = [(k, say("abcde" if k % 2 else "vwxyz", 30), "one" if k % 2 else "two", "s", 1) for k in range(80)]
    long_a, long_b = "".join(rng.choice("abcde") for _ in range(20_000)), "".join(rng.choice("vwxyz") for _ in range(20_000))
    odd = [(200, None, "one", "s", 1), (201, "", "one", "s", 1), (202, "12 34 !?", None, None, 1), (203, long_a, None, "s", 1), (204, long_b, "one", "s", 1), (None, rows[1][1], "two", "s", 1), rows[4], rows[4]]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string, source string, `score` int")
    found = language_id.predict(docs, *language_id.learn(docs, PATH), PATH).collect()
    assert len(found) == len(rows) + len(odd)
    by_id = {}
    for r in found:
        by_id.setdefault(r["doc_id"], []).append((r["lang_pred"], r["score"], r["held_out"]))
    assert all(by_id[k][0][:2] == ("und", 0.0) for k in (200, 201, 202))
    assert by_id[203][0][0] == "one" and by_id[204][0][0] == "two" and by_id[None][0][0] == "one" and not by_id[None][0][2]
    assert len(by_id[4]) == 3 and len(set(by_id[4])) == 1
    assert all(by_id[k][0][0] == lang and 0 <= by_id[k][0][1] <= 1 for k, _, lang, *_ in rows)
    none = docs.limit(0)
    assert language_id.predict(none, *language_id.learn(docs, PATH), PATH).count() == 0
    assert {r["lang_pred"] for r in language_id.predict(docs, *language_id.learn(none, PATH), PATH).collect()} == {"und"}
