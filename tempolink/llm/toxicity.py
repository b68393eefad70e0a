"""Toxicity: a linear-chain conditional random field tags toxic spans.

Labels exist for documents only, so tokens are labelled from them: in a toxic
document, tokens are toxic whose word or affix is tied to toxic documents by a
likelihood-ratio test over the sample; all others aren't.  The field is trained
on these tokens.  A text is cut into sentences; forward and backward passes
over each give every token's marginal, the marginals' sums and maxima give the
document's score through a logistic layer, and runs of likely tokens are the
offending spans.

Defined cases: a null or empty text, or one without words, has the score of no
evidence and no spans; a null doc_id stays null; repeated rows are each scored; an
empty table gives no rows; without labels of both kinds the score is the
labels' share; a text of any length is read whole, a sentence of more than
``LONGEST_CHAIN`` tokens as several chains that don't see each other.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .labelled import fit_in_task, held_out
from .shared import WORDLIKE, mix, pick, prefix_hash, span_hash, text_slices, word_spans

#: Labelled documents that are learned from: toxic and others.
SAMPLE = {1: 1000, 0: 3000}
LONGEST_CHAIN = 64
PREFIXES = range(3, 11)
SUFFIXES = range(3, 6)
N_FEATURES = 1 + len(PREFIXES) + len(SUFFIXES)
SLOTS = 1 << 20
_BREAK = np.zeros(256, dtype=bool)
_BREAK[[10, 33, 46, 63]] = True


def features(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Feature slots of words: the word itself, its prefixes and suffixes; slot 0 is none."""
    out = np.zeros((len(starts), N_FEATURES), dtype=np.int32)
    size = ends - starts
    top = np.uint64(SLOTS - 1)

    def put(column, kind, a, b, rows):
        h = mix(span_hash(sums, a, b) + np.uint64(kind * 0x9E3779B97F4A7C15 % 2**64))
        out[rows, column] = (h % top).astype(np.int32) + 1

    put(0, 1, starts, ends, slice(None))
    at = 1
    for k in PREFIXES:
        rows = np.flatnonzero(size > k)
        put(at, 10 + k, starts[rows], starts[rows] + k, rows)
        at += 1
    for k in SUFFIXES:
        rows = np.flatnonzero(size > k)
        put(at, 40 + k, ends[rows] - k, ends[rows], rows)
        at += 1
    return out


@dataclass
class Tokens:
    """Tokens of a slice of texts, distinct words apart, in chains."""

    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray  # each row's first token
    word: np.ndarray  # each token's distinct word
    keys: np.ndarray  # hash of each distinct word
    slots: np.ndarray  # feature slots of each distinct word
    chain: np.ndarray  # first token of each chain, and the end


def tokenise(data: np.ndarray, offs: np.ndarray) -> Tokens:
    starts, ends, first = word_spans(data, offs, WORDLIKE)
    sums = prefix_hash(data)
    keys, at, word = np.unique(span_hash(sums, starts, ends), return_index=True, return_inverse=True)
    slots = features(sums, starts[at], ends[at])
    breaks = np.cumsum(_BREAK[data], dtype=np.int64)
    sentence = breaks[starts] if len(starts) else breaks[:0]
    new = np.ones(len(starts), dtype=bool)
    new[1:] = sentence[1:] != sentence[:-1]
    new[first[:-1][first[:-1] < len(starts)]] = True
    chain = np.flatnonzero(new)
    # chains beyond the longest are cut
    size = np.diff(np.append(chain, len(starts)))
    if len(size) and size.max() > LONGEST_CHAIN:
        n = -(-size // LONGEST_CHAIN)
        within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        chain = np.repeat(chain, n) + within * LONGEST_CHAIN
    return Tokens(starts, ends, first, word, keys, slots, np.append(chain, len(starts)))


def tokenise_all(texts: list[str]) -> Tokens:
    """Tokens of all texts, taken in slices of bounded size; places in bytes are left out."""
    parts = [tokenise(data, offs) for _, data, offs in text_slices(pa.array(texts, pa.string()))]
    keys, at, inverse = np.unique(np.concatenate([t.keys for t in parts]), return_index=True, return_inverse=True)
    slots = np.concatenate([t.slots for t in parts])[at]
    n_keys = np.cumsum([0] + [len(t.keys) for t in parts])
    n_tokens = np.cumsum([0] + [len(t.word) for t in parts])
    word = np.concatenate([inverse[t.word + k] for t, k in zip(parts, n_keys)])
    first = np.concatenate([t.first[:-1] + n for t, n in zip(parts, n_tokens)] + [n_tokens[-1:]])
    chain = np.concatenate([t.chain[:-1] + n for t, n in zip(parts, n_tokens)] + [n_tokens[-1:]])
    none = np.zeros(0, np.int64)
    return Tokens(none, none, first, word, keys, slots, chain)


def _by_length(chain: np.ndarray):
    """Chains of like length as matrices of token numbers, -1 where a chain has ended."""
    size = np.diff(chain)
    low = 0
    for top in (4, 8, 16, 32, LONGEST_CHAIN):
        rows = np.flatnonzero((size > low) & (size <= top))
        low = top
        if len(rows):
            at = chain[:-1][rows][:, None] + np.arange(top)
            yield np.where(np.arange(top) < size[rows][:, None], at, -1)


def marginals(score: np.ndarray, chain: np.ndarray, move: np.ndarray, start: float) -> np.ndarray:
    """Each token's probability of label 1.

    ``score``: emission of label 1 over 0; ``move[a, b]``: exponentiated weight
    of b after a.  With two labels the passes need only the labels' ratio.
    """
    out = np.zeros(len(score) + 1)
    gain = np.exp(np.clip(np.append(score, 0.0), -30, 30))
    for at in _by_length(chain):
        ahead = np.empty(at.shape)
        r = np.full(len(at), np.exp(start))
        for t in range(at.shape[1]):
            r = gain[at[:, t]] * (r if t == 0 else (r * move[1, 1] + move[0, 1]) / (r * move[1, 0] + move[0, 0]))
            ahead[:, t] = r
        back = np.ones(len(at))
        for t in reversed(range(at.shape[1])):
            if t + 1 < at.shape[1]:
                g = gain[at[:, t + 1]] * back
                back = np.where(at[:, t + 1] < 0, 1.0, (move[1, 1] * g + move[1, 0]) / (move[0, 1] * g + move[0, 0]))
            odds = ahead[:, t] * back
            out[at[:, t]] = odds / (1 + odds)
    return out[:-1]


@dataclass
class Field:
    """The trained field, and the logistic layer over a document's marginals."""

    weights: np.ndarray
    move: np.ndarray
    start: float
    layer: np.ndarray
    share: float

    def tags(self, tokens: Tokens) -> np.ndarray:
        return marginals(self.weights[tokens.slots].sum(axis=1)[tokens.word], tokens.chain, self.move, self.start)


def evidence(p: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A row for each document: 1, greatest marginal, log of the sum, sum for each token, log of likely tokens."""
    n = np.diff(first)
    out = np.zeros((len(n), 5))
    out[:, 0] = 1
    full = np.flatnonzero(n)
    if len(full):
        at = first[:-1][full]
        total = np.add.reduceat(p, at)
        out[full, 1] = np.maximum.reduceat(p, at)
        out[full, 2] = np.log1p(total)
        out[full, 3] = np.sqrt(total / n[full])
        out[full, 4] = np.log1p(np.add.reduceat((p > 0.5).astype(float), at))
    return out


def _token_labels(tokens: Tokens, toxic: np.ndarray) -> np.ndarray:
    """Tokens of toxic documents whose word or an affix goes with toxic documents."""
    n = np.diff(tokens.first)
    doc = np.repeat(np.arange(len(n)), n)
    pairs = np.unique(doc * len(tokens.slots) + tokens.word)
    d, w = pairs // len(tokens.slots), pairs % len(tokens.slots)
    pos, neg = np.zeros(SLOTS), np.zeros(SLOTS)
    for c in range(N_FEATURES):
        cells = np.unique(d * SLOTS + tokens.slots[w, c] % SLOTS)
        is_toxic, slot = toxic[cells // SLOTS] == 1, cells % SLOTS
        pos += np.bincount(slot[is_toxic], minlength=SLOTS)
        neg += np.bincount(slot[~is_toxic], minlength=SLOTS)
    p, q = max(1, toxic.sum()), max(1, (toxic == 0).sum())
    share = p / (p + q)
    seen = pos + neg
    with np.errstate(divide="ignore", invalid="ignore"):
        g2 = 2 * (pos * np.log(pos / (seen * share)) + np.where(neg > 0, neg * np.log(neg / (seen * (1 - share))), 0))
        # a chance of one false mark among all features seen twice (the tail of chi-squared)
        least = 2 * np.log(max(100, (seen > 1).sum())) - 3.6
        marked = (g2 > least) & (pos / p > 6 * neg / q)
    marked[0] = False
    tied = marked[tokens.slots % SLOTS].any(axis=1)
    return (tied[tokens.word] & (toxic[doc] == 1)).astype(np.int64)


def train(rows: list[tuple[str, int]], share: float, rounds: int = 8, seed: int = 5) -> Field:
    """Trains the field on (text, toxic) rows; ``share``: label 1's share of all labels."""
    toxic = np.array([y for _, y in rows], dtype=np.int64)
    none = Field(np.zeros(SLOTS + 1), np.ones((2, 2)), 0.0, np.zeros(5), share)
    if not len(toxic) or toxic.min() == toxic.max():
        return none
    tokens = tokenise_all([t for t, _ in rows])
    y = _token_labels(tokens, toxic)
    rng = np.random.default_rng(seed)
    # chains with a toxic token, and as many and more without
    size = np.diff(tokens.chain)
    keep = size > 0
    begins, size = tokens.chain[:-1][keep], size[keep]
    hot = np.add.reduceat(y, begins) > 0
    cold = np.flatnonzero(~hot)
    chosen = np.concatenate([np.flatnonzero(hot), rng.permutation(cold)[: max(20_000, 4 * int(hot.sum()))]])
    weights = np.zeros(SLOTS + 1)
    squares = np.full(SLOTS + 1, 1e-3)
    trans, start = np.zeros((2, 2)), 0.0
    trans_sq, start_sq = np.full((2, 2), 1e-3), 1e-3
    for _ in range(rounds):
        order = rng.permutation(chosen)
        for part in np.array_split(order, max(min(16, len(order)), len(order) // 2048)):
            length = min(LONGEST_CHAIN, int(size[part].max()))
            at = begins[part][:, None] + np.arange(length)
            live = np.arange(length) < size[part][:, None]
            at = np.where(live, at, 0)
            slots = tokens.slots[tokens.word[at]]
            s = np.where(live, weights[slots].sum(axis=2), 0.0)
            node, edge = _expected(s, live, np.exp(trans), start)
            truth = y[at] * live
            g = np.where(live, node - truth, 0.0) / len(part)
            grad = np.bincount(slots[live].ravel(), weights=np.repeat(g[live], N_FEATURES), minlength=SLOTS + 1)
            grad[0] = 0.0
            touched = np.flatnonzero(grad)
            step = grad[touched] + 1e-6 * weights[touched]
            squares[touched] += step**2
            weights[touched] -= 0.1 * step / np.sqrt(squares[touched])
            seen = np.zeros((2, 2))
            both = live[:, 1:]
            np.add.at(seen, (truth[:, :-1][both], truth[:, 1:][both]), 1)
            g2 = (edge - seen) / len(part)
            trans_sq += g2**2
            trans -= 0.1 * g2 / np.sqrt(trans_sq)
            g3 = (node[:, 0] - truth[:, 0]).mean()
            start_sq += g3**2
            start -= 0.1 * g3 / np.sqrt(start_sq)
    field = Field(weights, np.exp(trans), float(start), np.zeros(5), share)
    x = evidence(field.tags(tokens), tokens.first)
    weight = np.where(toxic == 1, share / toxic.mean(), (1 - share) / (1 - toxic.mean()))
    field.layer = _logistic(x, toxic, weight)
    return field


def _expected(s: np.ndarray, live: np.ndarray, move: np.ndarray, start: float):
    """Node marginals of label 1, and summed edge expectations, of padded chains."""
    n, length = s.shape
    e = np.stack([np.ones_like(s), np.exp(np.clip(s, -30, 30))], axis=2)
    a = np.empty((n, length, 2))
    v = e[:, 0] * np.array([1.0, np.exp(start)])
    for t in range(length):
        if t:
            v = np.where(live[:, t, None], (v @ move) * e[:, t], v)
        v = v / v.sum(axis=1, keepdims=True)
        a[:, t] = v
    node = np.empty((n, length))
    edge = np.zeros((2, 2))
    b = np.ones((n, 2))
    for t in reversed(range(length)):
        post = a[:, t] * b
        node[:, t] = post[:, 1] / post.sum(axis=1)
        if t:
            eb = e[:, t] * b
            pair = a[:, t - 1, :, None] * move * eb[:, None, :]
            pair /= pair.sum(axis=(1, 2), keepdims=True)
            edge += pair[live[:, t]].sum(axis=0)
            nb = eb @ move.T
            b = np.where(live[:, t, None], nb / nb.sum(axis=1, keepdims=True), b)
    return node, edge


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 50) -> np.ndarray:
    """Ridge logistic regression by Newton steps."""
    c = np.zeros(x.shape[1])
    ridge = np.diag([1e-6] + [1e-2] * (x.shape[1] - 1)) * len(y)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ c, -30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + ridge * 0.01 + 1e-9 * np.eye(len(c)), x.T @ (weight * (p - y)) + ridge @ c * 0.01)
        c -= step
        if np.abs(step).max() < 1e-8:
            break
    return c


_SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])


def score_documents(docs: DataFrame, field: Field) -> DataFrame:
    """(doc_id, score, spans): spans are offending places in characters, the end exclusive."""
    sent = docs.sparkSession.sparkContext.broadcast(field)  # a fixed size: its slots

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        blank = model.layer.any()
        for batch in batches:
            scores, spans = [], []
            for _, data, offs in text_slices(batch.column(1)):
                tokens = tokenise(data, offs)
                p = model.tags(tokens) if len(tokens.starts) else np.zeros(0)
                z = evidence(p, tokens.first) @ model.layer
                scores.append(1 / (1 + np.exp(-np.clip(z, -30, 30))) if blank else np.full(len(offs) - 1, model.share))
                rows: list[list] = [[] for _ in range(len(offs) - 1)]
                likely = np.flatnonzero(p > 0.5)
                if len(likely):
                    chars = np.cumsum((data & 0xC0) != 0x80)
                    doc = np.searchsorted(tokens.first, likely, "right") - 1
                    part = np.flatnonzero(np.append(True, (np.diff(likely) > 1) | (np.diff(doc) > 0)))
                    for i, j in zip(part, np.append(part[1:], len(likely)) - 1):
                        d, a, b = doc[i], tokens.starts[likely[i]], tokens.ends[likely[j]]
                        base = chars[offs[d]] - 1
                        rows[d].append({"start": int(chars[a] - 1 - base), "end": int(chars[b - 1] - base), "score": float(p[likely[i] : likely[j] + 1].max())})
                spans += rows
            if scores:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(scores)), pa.array(spans, pa.list_(_SPAN))], names=["doc_id", "score", "spans"])

    return pick(docs, doc_id="long", text="string").mapInArrow(run, "doc_id long, score double, spans array<struct<start: long, end: long, score: double>>")


def fit(docs: DataFrame, labels: DataFrame) -> Field:
    """The field trained on the bounded sample, in one task."""
    return fit_in_task(docs, labels, "toxic", SAMPLE, _light)


def _light(rows: list[tuple[str, int]], share: float) -> Field:
    """The trained field, its weights in single precision."""
    field = train(rows, share)
    field.weights = field.weights.astype(np.float32)
    return field


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scored = score_documents(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    places = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["start"], s["end"])), ",")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), places.alias("spans"))
