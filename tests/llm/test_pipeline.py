import random
import re

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

import corpus_pipeline  # noqa: E402
from plumbline.llm import bpe  # noqa: E402
from plumbline.llm.q08_bpe import vocabulary  # noqa: E402

from test_operators import near_removed  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, extra string"
WORDS = [f"w{k}x" for k in range(900)]


def texts():
    rng = random.Random(11)
    say = lambda n: [rng.choice(WORDS) for _ in range(n)]
    passage, base, item = say(70), say(150), say(14)
    near = list(base)
    near[40] = "changed"
    out = [base, near, base, say(90) + passage + say(40), say(60) + passage + say(80), say(30), None, [], ["same"] * 90, say(70) + item + say(50), say(120), passage]
    return [None if t is None else " ".join(t) for t in out], " ".join(item)


def plain(rows, item):
    """The five stages in plain Python: {doc_id: text}."""
    def good(t):
        w = (t or "").split()
        seen = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        covered = {i + j for i, s in enumerate(seen) if seen.count(s) > 1 for j in range(3)}
        return len(w) >= 50 and 100 * len(covered) <= 50 * len(w)

    kept = {d: t for d, t in rows.items() if good(t)}
    sets = {d: {tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for d, t in kept.items()}
    first = {d: d for d in kept}
    for _ in kept:
        for a in kept:
            for b in kept:
                if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                    first[a] = first[b] = min(first[a], first[b])
    kept = {d: t for d, t in kept.items() if first[d] == d}
    ids = sorted(kept)
    gone = dict(zip(ids, near_removed([kept[d] for d in ids], flags=True), strict=True))
    kept = {d: " ".join(w for w, g in zip(t.split(), gone[d]) if not g) for d, t in kept.items() if not gone[d].all()}
    windows = {tuple(item.split()[i : i + 10]) for i in range(len(item.split()) - 9)}
    parts = lambda t: [w for w in re.split(r"[^0-9a-z]+", t.lower()) if w]
    return {d: t for d, t in kept.items() if not windows & {tuple(parts(t)[i : i + 10]) for i in range(len(parts(t)) - 9)}}


@pytest.fixture
def folder(spark, tmp_path):
    rows, item = texts()
    data = [(k, t, "en", f"s{k % 3}", len(t or ""), "x") for k, t in enumerate(rows)]
    spark.createDataFrame(data, SCHEMA).repartition(3).write.parquet(f"file://{tmp_path}/documents.parquet")
    spark.createDataFrame([("i", item)], "item_id string, text string").write.parquet(f"file://{tmp_path}/benchmark.parquet")
    return f"file://{tmp_path}"


def test_pipeline_equals_plain_python(spark, folder):
    rows, item = texts()
    expected = plain(dict(enumerate(rows)), item)
    assert 9 not in expected and 1 not in expected and len(expected[4].split()) < 200
    enc = bpe.encoding(*vocabulary())
    found = {r["doc_id"]: np.frombuffer(bytes(r["ids"]), "<u4").tolist() for r in corpus_pipeline.run(spark, folder).collect()}
    assert {d: enc.decode(ids).split() for d, ids in found.items()} == {d: t.split() for d, t in expected.items()}
    assert all(ids == enc.encode_ordinary(enc.decode(ids)) for ids in found.values())


def test_stages_keep_the_columns(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns
        docs = spark.createDataFrame(out.collect(), docs.schema)
    assert all(r["n_chars"] == len(r["text"]) for r in docs.collect())


def test_empty_documents(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"file://{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id string, text string").write.parquet(f"file://{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, f"file://{tmp_path}").count() == 0
