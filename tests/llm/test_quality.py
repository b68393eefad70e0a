import math
import re

import numpy as np
import pyarrow as pa

from tempolink.llm import quality
from tempolink.llm.shared import prefix_hash, span_hash, text_slices


def bags(texts):
    for _, data, offs in text_slices(pa.array(texts, pa.string()), most=1 << 40):
        return quality.passages(data, offs)


def test_passages_cover_the_text():
    text = " ".join(f"w{i}" for i in range(150))
    x, row = bags([text, "", "one two", " "])
    assert np.diff(row).tolist() == [3, 1, 1, 1]
    assert np.allclose(np.expm1(x[:, quality.N_KINDS]), [64, 64, 22, 0, 2, 0])
    alone, _ = bags([text])
    assert np.allclose(alone, x[:3])


def plainly(text, net):
    """The score of one text, word by word and passage by passage."""
    data = (text or "").encode()
    spans = [m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", data)]
    parts = [spans[i : i + quality.PASSAGE] for i in range(0, len(spans), quality.PASSAGE)] or [[]]
    starts = [0] + [p[0][0] for p in parts[1:]]
    encoded = []
    for k, part in enumerate(parts):
        own = data[starts[k] : starts[k + 1] if k + 1 < len(parts) else len(data)]
        words = [data[a:b].lower() for a, b in part]
        n, sizes = max(1, len(words)), [len(w) for w in words]
        mean = sum(sizes) / n
        x = [math.sqrt(sum(quality._KIND[c] == kind for c in own) / max(1, len(own))) for kind in range(quality.N_KINDS)]
        x += [math.log1p(len(words)), mean / 8, math.sqrt(max(0, sum(z * z for z in sizes) / n - mean**2)) / 8]
        x += [sum(z <= 3 for z in sizes) / n, sum(z == 1 for z in sizes) / n, sum(a == b for a, b in zip(words, words[1:])) / n, len(set(words)) / n, sum(z > 20 for z in sizes) / n]
        cells = [0] * quality.HASHED
        for w in words:
            if len(w) <= 4:
                b = np.frombuffer(w, np.uint8)
                cells[int(span_hash(prefix_hash(b), np.array([0]), np.array([len(b)]))[0]) % quality.HASHED] += 1
        x += [math.sqrt(c / n) for c in cells]
        x = [(v - m) / s for v, m, s in zip(x, net.mean, net.scale)]
        encoded.append([math.tanh(sum(v * w for v, w in zip(x, net.p["W"][:, j])) + net.p["b"][j]) for j in range(quality.HIDDEN)])
    weight = []
    for h in encoded:
        gate = [math.tanh(np.dot(h, net.p["V"][:, j])) / (1 + math.exp(-np.dot(h, net.p["U"][:, j]))) for j in range(quality.GATE)]
        weight.append(math.exp(np.dot(gate, net.p["w"])))
    z = [sum(a * h[j] for a, h in zip(weight, encoded)) / sum(weight) for j in range(quality.HIDDEN)]
    return 1 / (1 + math.exp(-(np.dot(z, net.p["c"]) + net.p["d"][0])))


def test_scores_are_those_of_a_plain_reading(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    net = quality.fit(docs, spark.read.parquet(f"{small}/labels.parquet"))
    assert isinstance(net, quality.Network)
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    got = {r["doc_id"]: r["score"] for r in quality.op10_quality(spark, small).collect()}
    assert got.keys() == text.keys()
    for i in sorted(text, key=lambda i: len(text[i]))[:120]:
        assert math.isclose(got[i], plainly(text[i], net), rel_tol=1e-9, abs_tol=1e-9), i


def test_gradients_are_numeric_ones():
    r = np.random.default_rng(0)
    x, row = r.standard_normal((7, quality.WIDTH)), np.array([0, 3, 4, 7])
    y, weight = np.array([1.0, 0.0, 1.0]), np.array([1.0, 2.0, 0.5])
    net = quality.Network(np.zeros(quality.WIDTH), np.ones(quality.WIDTH))

    def loss():
        s, _ = net.forward(x, row)
        return -(weight * (y * np.log(s) + (1 - y) * np.log(1 - s))).sum()

    s, kept = net.forward(x, row)
    g = net.gradients(kept, weight * (s - y))
    for name, value in net.p.items():
        at = tuple(r.integers(0, n) for n in value.shape)
        was = value[at]
        value[at] = was + 1e-5
        up = loss()
        value[at] = was - 1e-5
        down = loss()
        value[at] = was
        assert np.isclose(g[name][at], (up - down) / 2e-5, rtol=1e-4, atol=1e-7), name


def test_attention_sums_to_one():
    x, row = bags([" ".join(["w"] * 200), "b"])
    net = quality.Network(np.zeros(quality.WIDTH), np.ones(quality.WIDTH))
    _, kept = net.forward(x, row)
    assert np.allclose(np.add.reduceat(kept["a"], row[:-1]), 1)


def test_odd_cases(odd, nothing, spark):
    labels = spark.createDataFrame([(1, 1), (5, 0), (None, 1), (9, None)], "doc_id long, quality int")
    model = quality.train([("good words here", 1), ("| | |", 0)] * 5, 0.8)
    for docs in (odd, nothing):
        share = quality.fit(docs, labels)
        for m in (model, share):
            got = quality.score_documents(docs, m).collect()
            assert len(got) == docs.count() and all(0 <= r["score"] <= 1 for r in got)
        kept = quality.keep_good(docs, 0.9)
        assert kept.columns == docs.columns and kept.count() == docs.count()
        assert quality.keep_good(docs, 0.1).count() == 0


def test_held_out_quality(spark):
    d = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    both = quality.op10_quality(spark, d).join(labels, "doc_id").where("held_out").select("predicted", "quality").collect()
    good = [r["predicted"] for r in both if r["quality"] == 1]
    bad = [r["predicted"] for r in both if r["quality"] == 0]
    assert np.mean(good) > 0.98 and np.mean(bad) < 0.1
