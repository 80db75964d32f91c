"""Ids that several texts share, and columns of any name."""

import random

import pytest

pytest.importorskip("public_tokenizers")

from plumbline.llm import decontaminate, jaccard_join, passage_dedup, quality, shared, token_file  # noqa: E402

WORDS = [f"w{k}" for k in range(300)]


def changed(words, rng, count):
    words = list(words)
    for _ in range(count):
        words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
    return words


def components(rows):
    """(doc_id, set size, component) by plain loops: rows of one id are one document."""
    sets = []
    for _, text in rows:
        w = (text or "").lower().split()
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    root = {d: d for d, _ in rows}

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                x, y = sorted((top(rows[i][0]), top(rows[j][0])))
                root[y] = x
    return sorted((d, len(s), top(d)) for (d, _), s in zip(rows, sets, strict=True))


def test_a_document_with_two_texts_has_the_links_of_both(spark):
    rng = random.Random(2)
    t, u = ([rng.choice(WORDS) for _ in range(100)] for _ in range(2))
    near = changed(u, rng, 1)
    rows = [(1, " ".join(t)), (5, " ".join(t)), (5, " ".join(u)), (9, " ".join(near))]
    found = jaccard_join.components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(tuple(r) for r in found) == components(rows) and {r["component_id"] for r in found} == {1}


@pytest.mark.parametrize("frequent,seed", [(64, 1), (3, 2)])
def test_shared_ids_equal_plain_loops(spark, frequent, seed, monkeypatch):
    monkeypatch.setattr(jaccard_join, "FREQUENT", frequent)
    rng = random.Random(seed)
    common = [rng.choice(WORDS) for _ in range(12)]
    bases = [common + [rng.choice(WORDS) for _ in range(rng.choice([8, 60]))] for _ in range(25)]
    rows = [(rng.randrange(40), " ".join(changed(rng.choice(bases), rng, rng.choice([0, 0, 1, 3])))) for _ in range(90)]
    rows += rows[:5] + [(3, None), (41, ""), (42, "one two")]
    found = jaccard_join.components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    # a text without words has no links, so its row is alone even where its id has other texts
    lone = {(d, 0, d) for d, t in rows if not (t or "").split()}
    assert sorted(tuple(r) for r in found if r["n_shingles"]) == [x for x in components(rows) if x[1]]
    assert {tuple(r) for r in found if not r["n_shingles"]} == lone


def test_columns_of_any_name(spark):
    rng = random.Random(5)
    say = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    passage = say(80)
    texts = [say(60) + " " + passage, say(70) + " " + passage, say(90), None]
    schema = "doc_id long, text string, lang string, source string, n_chars long, `a.b` string, `row` int, `we``ird` int, spans int"
    docs = spark.createDataFrame([(k, t, "en", "s", len(t or ""), "x.y", k, 2 * k, 7) for k, t in enumerate(texts)], schema)
    bench = spark.createDataFrame([(1, " ".join(texts[2].split()[:12]))], "item_id long, text string")
    for work, kept in (
        (quality.filter_quality, {0, 1, 2}), (lambda d: decontaminate.drop_contaminated(d, bench), {0, 1, 3}), (passage_dedup.drop_repeats, {0, 1, 2, 3}),
        (jaccard_join.keep_one, {0, 1, 2, 3}),
    ):
        out = work(docs)
        rows = out.collect()
        assert out.columns == docs.columns and {r["doc_id"] for r in rows} == kept
        assert all((r["a.b"], r["row"], r["we`ird"], r["spans"]) == ("x.y", r["doc_id"], 2 * r["doc_id"], 7) for r in rows)


def test_a_token_file_leaves_no_plain_ids(spark):
    import public_tokenizers

    docs = spark.createDataFrame([(1, "some text"), (2, None)], "doc_id long, text string")
    with shared.scope() as tables:
        token_file.write(docs, public_tokenizers.path("byte_bpe_50k.json"))
        assert len([t for t in tables if t._shared_path]) == 2  # codes and blocks
