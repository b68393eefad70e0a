"""Quality classifier: attention-based multiple-instance learning.

A document is a bag of passages of 64 words.  Every passage is encoded; a gated
attention network, learned from document labels alone, weighs the passages; the
weighted mean of their encodings is scored.

Defined cases: a null or empty text, or one without words, is one empty passage;
a null doc_id stays null; repeated rows are each scored; an empty table gives no
rows; without labels of both kinds the score is the labels' share; a text of any
length is read whole, all its passages weigh in.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .labelled import fit_in_task, held_out
from .shared import NOT_BLANK, pick, prefix_hash, small_batches, span_hash, text_slices, word_spans

#: Labelled documents that are learned from: good and others.
SAMPLE = {1: 4000, 0: 2000}
PASSAGE = 64
HASHED = 16
HIDDEN = 24
GATE = 12
#: Documents below this score are of low quality.
GOOD = 0.3

#: Kinds of bytes whose shares describe a passage.
_KIND = np.full(256, 1, dtype=np.int64)
_KIND[48:58] = 2
_KIND[65:91] = 3
_KIND[97:123] = 4
_KIND[128:] = 5
for _kind, _chars in enumerate((" ", "\n\r\x0b\x0c\t", ".,;:", "|", "$%&*#@^~", "!?", "<>[]{}()=/\\_+-", "'\""), 6):
    _KIND[[ord(c) for c in _chars]] = _kind
N_KINDS = 14
WIDTH = N_KINDS + 8 + HASHED


def passages(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Encodings of all passages of a slice's rows, and each row's first passage."""
    starts, ends, first = word_spans(data, offs, NOT_BLANK)
    n_words = np.diff(first)
    n = np.maximum(1, -(-n_words // PASSAGE))
    row = np.concatenate([[0], np.cumsum(n)])
    total = int(row[-1])
    within = np.arange(len(starts)) - np.repeat(first[:-1], n_words)
    of_word = np.repeat(row[:-1], n_words) + within // PASSAGE
    # bytes of a passage: from its first word, or its row's start, to the next passage
    begin = np.repeat(offs[:-1], n)
    later = np.flatnonzero(within % PASSAGE == 0)
    begin[of_word[later]] = np.where(within[later] == 0, begin[of_word[later]], starts[later])
    size = np.diff(np.append(begin, len(data)))
    of_byte = np.repeat(np.arange(total), size)
    kinds = np.bincount(of_byte * N_KINDS + _KIND[data], minlength=total * N_KINDS).reshape(total, N_KINDS)
    out = np.zeros((total, WIDTH))
    out[:, :N_KINDS] = np.sqrt(kinds / np.maximum(1, size)[:, None])
    count = np.bincount(of_word, minlength=total).astype(float)
    some = np.maximum(1, count)
    length = (ends - starts).astype(float)
    words = span_hash(prefix_hash(data), starts, ends)
    same = np.zeros(len(words), dtype=bool)
    same[1:] = (words[1:] == words[:-1]) & (of_word[1:] == of_word[:-1])
    mean = np.bincount(of_word, length, minlength=total) / some
    order = np.lexsort((words, of_word))
    new = np.ones(len(words), dtype=bool)
    new[1:] = (words[order][1:] != words[order][:-1]) | (of_word[order][1:] != of_word[order][:-1])
    c = N_KINDS
    out[:, c] = np.log1p(count)
    out[:, c + 1] = mean / 8
    out[:, c + 2] = np.sqrt(np.maximum(0, np.bincount(of_word, length**2, minlength=total) / some - mean**2)) / 8
    out[:, c + 3] = np.bincount(of_word, length <= 3, minlength=total) / some
    out[:, c + 4] = np.bincount(of_word, length == 1, minlength=total) / some
    out[:, c + 5] = np.bincount(of_word, same, minlength=total) / some
    out[:, c + 6] = np.bincount(of_word[order], new, minlength=total) / some
    out[:, c + 7] = np.bincount(of_word, length > 20, minlength=total) / some
    short = length <= 4
    cell = of_word[short] * HASHED + (words[short] % np.uint64(HASHED)).astype(np.int64)
    out[:, c + 8 :] = np.sqrt(np.bincount(cell, minlength=total * HASHED).reshape(total, HASHED) / some[:, None])
    return out, row


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Network:
    """Encoder, gated attention and score: parameters by name."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, seed: int = 9):
        rng = np.random.default_rng(seed)
        draw = lambda a, b: rng.standard_normal((a, b)) / np.sqrt(a)
        self.mean, self.scale = mean, scale
        self.p = {
            "W": draw(WIDTH, HIDDEN), "b": np.zeros(HIDDEN), "V": draw(HIDDEN, GATE), "U": draw(HIDDEN, GATE),
            "w": draw(GATE, 1)[:, 0], "c": draw(HIDDEN, 1)[:, 0], "d": np.zeros(1),
        }

    def forward(self, x: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, dict]:
        """Scores of bags; row: each bag's first passage, and the end."""
        p, at, n = self.p, row[:-1], np.diff(row)
        x = (x - self.mean) / self.scale
        h = np.tanh(x @ p["W"] + p["b"])
        v, u = np.tanh(h @ p["V"]), _sigmoid(h @ p["U"])
        e = (v * u) @ p["w"]
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, at), n))
        a = e / np.repeat(np.add.reduceat(e, at), n)
        z = np.add.reduceat(a[:, None] * h, at)
        s = _sigmoid(z @ p["c"] + p["d"])
        return s, {"x": x, "h": h, "v": v, "u": u, "a": a, "z": z, "n": n, "at": at}

    def gradients(self, kept: dict, delta: np.ndarray) -> dict:
        """delta: each bag's derivative of the loss by its score before the sigmoid."""
        p, h, v, u, a, n, at = self.p, *(kept[k] for k in ("h", "v", "u", "a", "n", "at"))
        g = {"c": kept["z"].T @ delta, "d": delta.sum(keepdims=True)}
        dz = np.repeat(delta, n)[:, None] * p["c"]
        da = (dz * h).sum(axis=1)
        de = a * (da - np.repeat(np.add.reduceat(a * da, at), n))
        dh = a[:, None] * dz
        g["w"] = (v * u).T @ de
        dv, du = de[:, None] * p["w"] * u * (1 - v**2), de[:, None] * p["w"] * v * u * (1 - u)
        g["V"], g["U"] = h.T @ dv, h.T @ du
        dh = (dh + dv @ p["V"].T + du @ p["U"].T) * (1 - h**2)
        g["W"], g["b"] = kept["x"].T @ dh, dh.sum(axis=0)
        return g


def train(rows: list[tuple[str, int]], share: float, epochs: int = 60, batch: int = 256, seed: int = 3) -> Network | float:
    """A network trained on (text, good) rows; the share alone if they are of one kind."""
    y = np.array([label for _, label in rows], dtype=float)
    if not len(y) or y.min() == y.max():
        return share
    xs, ends = [], [np.zeros(1, np.int64)]
    for _, data, offs in text_slices(pa.array([t for t, _ in rows], pa.string())):
        x, row = passages(data, offs)
        xs.append(x)
        ends.append(row[1:] + ends[-1][-1])
    x, row = np.concatenate(xs), np.concatenate(ends)
    net = Network(x.mean(axis=0), x.std(axis=0) + 1e-3)
    weight = np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean()))
    rng = np.random.default_rng(seed)
    m = {k: np.zeros_like(v) for k, v in net.p.items()}
    s = {k: np.zeros_like(v) for k, v in net.p.items()}
    t = 0
    for epoch in range(epochs):
        rate = 0.01 * (1 - 0.95 * epoch / epochs)
        for part in np.array_split(rng.permutation(len(y)), max(1, len(y) // batch)):
            n = np.diff(row)[part]
            bags = np.concatenate([[0], np.cumsum(n)])
            flat = np.arange(bags[-1]) - np.repeat(bags[:-1], n) + np.repeat(row[part], n)
            score, kept = net.forward(x[flat], bags)
            g = net.gradients(kept, weight[part] * (score - y[part]) / len(part))
            t += 1
            for k in net.p:
                d = g[k] + (1e-4 * net.p[k] if k not in "bd" else 0)
                m[k] = 0.9 * m[k] + 0.1 * d
                s[k] = 0.999 * s[k] + 0.001 * d**2
                net.p[k] = net.p[k] - rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(s[k] / (1 - 0.999**t)) + 1e-8)
    return net


def _scored(texts: pa.Array, model: Network | float) -> list[np.ndarray]:
    """Each text's score, passages, and greatest weight of one passage."""
    found = [(np.zeros(0), np.zeros(0, np.int64), np.zeros(0))]
    for _, data, offs in text_slices(texts):
        x, row = passages(data, offs)
        n = np.diff(row)
        if isinstance(model, float):
            found.append((np.full(len(n), model), n, 1 / n))
        else:
            score, kept = model.forward(x, row)
            found.append((score, n, np.maximum.reduceat(kept["a"], row[:-1])))
    return [np.concatenate(c) for c in zip(*found)]


def score_documents(docs: DataFrame, model: Network | float) -> DataFrame:
    """(doc_id, score, n_passages, attention): attention is the greatest weight of one passage."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [pa.array(c) for c in _scored(batch.column(1), model)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *found], names=["doc_id", "score", "n_passages", "attention"])

    return pick(docs, doc_id="long", text="string").mapInArrow(run, "doc_id long, score double, n_passages long, attention double")



def keep_good(docs: DataFrame, model: Network | float) -> DataFrame:
    """The rows, all columns, whose ``text`` isn't of low quality."""
    small_batches(docs.sparkSession)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(_scored(batch.column(at).cast(pa.string()), model)[0] >= GOOD))

    return docs.mapInArrow(run, docs.schema)


def fit(docs: DataFrame, labels: DataFrame) -> Network | float:
    """The network trained on the bounded sample, in one task."""
    return fit_in_task(docs, labels, "quality", SAMPLE, train)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = score_documents(docs, model)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= GOOD).cast("int").alias("predicted"), "n_passages", "attention")
