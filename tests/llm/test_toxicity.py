from itertools import product

import numpy as np
import pyarrow as pa
import pytest

from tempolink.llm import toxicity as tox
from tempolink.llm.shared import text_slices


def paths(s, move, start):
    for y in product((0, 1), repeat=len(s)):
        w = np.exp(start * y[0] + sum(a * b for a, b in zip(s, y)))
        for a, b in zip(y, y[1:]):
            w *= move[a, b]
        yield y, w


@pytest.mark.parametrize("n", [1, 2, 5, 9])
def test_marginals_are_those_of_all_paths(n):
    r = np.random.default_rng(n)
    s, move, start = r.standard_normal(n) * 2, np.exp(r.standard_normal((2, 2))), 0.3
    total = sum(w for _, w in paths(s, move, start))
    want = [sum(w for y, w in paths(s, move, start) if y[t]) / total for t in range(n)]
    # two chains of different length at once
    got = tox.marginals(np.concatenate([s, [1.0, -1.0]]), np.array([0, n, n + 2]), move, start)
    assert np.allclose(got[:n], want)
    live = np.ones((1, n), bool)
    node, edge = tox._expected(s[None], live, move, start)
    assert np.allclose(node[0], want)
    pairs = np.zeros((2, 2))
    for y, w in paths(s, move, start):
        for a, b in zip(y, y[1:]):
            pairs[a, b] += w / total
    assert np.allclose(edge, pairs)


def made(n, seed):
    r = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        w = [f"w{r.integers(300)}" for _ in range(40)]
        toxic = int(i % 4 == 0)
        if toxic:
            for k in r.integers(0, 40, 2):
                w[k] = "vile" + str(r.integers(10**6))
        rows.append((" ".join(w[:20]) + ". " + " ".join(w[20:]), toxic))
    return rows


def test_spans_of_an_affix_are_learned_and_found(spark):
    field = tox.train(made(400, 1), 0.25)
    test = made(100, 2)
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(test)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in tox.score_documents(docs, field).collect()}
    right = sum((got[i]["score"] >= 0.5) == bool(y) for i, (_, y) in enumerate(test))
    assert right >= 98
    for i, (t, y) in enumerate(test):
        for s in got[i]["spans"]:
            assert y and t[s["start"] : s["end"]].startswith("vile")


def test_offsets_are_characters(spark):
    field = tox.train(made(400, 1), 0.25)
    t = "é😀ß w1 vile77 w2"
    (span,) = tox.score_documents(spark.createDataFrame([(0, "x"), (1, t)], "doc_id long, text string"), field).where("doc_id = 1").head()["spans"]
    assert t[span["start"] : span["end"]] == "vile77"


def test_chains_cover_all_tokens_and_are_bounded():
    text = "a " * 300 + ". b c\nd"
    for _, data, offs in text_slices(pa.array([text, "", "e. f"])):
        t = tox.tokenise(data, offs)
        assert t.chain[0] == 0 and t.chain[-1] == len(t.starts) and np.diff(t.chain).max() <= tox.LONGEST_CHAIN
        assert np.isin(t.first[:-1][np.diff(t.first) > 0], t.chain).all()


def test_odd_cases(odd, nothing, spark):
    labels = spark.createDataFrame([(1, 1), (5, 0), (None, 1), (9, None)], "doc_id long, toxic int")
    for docs in (odd, nothing):
        field = tox.fit(docs, labels)
        got = tox.score_documents(docs, field).collect()
        assert len(got) == docs.count() and all(0 <= r["score"] <= 1 for r in got)
    with_both = tox.train(made(40, 1), 0.25)
    assert all(0 <= r["score"] <= 1 for r in tox.score_documents(odd, with_both).collect())


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    both = tox.op7_toxicity(spark, d).join(labels, "doc_id").where("held_out").select("predicted", "toxic").collect()
    assert np.mean([r["predicted"] == r["toxic"] for r in both]) > 0.96
