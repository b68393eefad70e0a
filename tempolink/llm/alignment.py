"""Alignment of two tokenizers' tokens by lockstep merging.

Both tokenizers read a text with a blank before it; their tokens tile the same
bytes.  One numpy state holds, for every document of a batch, a pointer into its
tokens of either side.  Each step links the two tokens that the pointers name,
cuts where they end at the same byte, and advances the one that ends first, or
both; documents at their end drop out of the state.  A long document runs as
several lanes, which start at bytes where tokens of both sides end.

A pair of ids counts once for every document that holds it linked.  Tasks add
the documents of a unit (one batch) up before pairs are shuffled, so the shuffle
grows with the units' distinct pairs, not with the links.  Each unit gets its
pairs' counts back by a join on the unit, where they are summed over its
documents' links; no table of pairs is ever sent to all tasks.

Defined cases: texts that are null, empty, or that a tokenizer doesn't give back
byte by byte have no tokens, so zeros and an empty hash; special tokens' strings
are plain text; rows that repeat an id or text are documents of their own; null
ids stay null; an empty table gives no rows; other columns go no further; a text
of any length is read whole, in a task's memory.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import Scratch
from .shared import pick

#: Tokens of side A after which a long document may go on as another lane, and among how many ends a common one is looked for.
LANE, LOOK = 1024, 64
#: Bytes of text that advance together.
TOGETHER = 2 << 20
#: Characters that the rank file's splitter certainly reads as the tokenizer does; a text with another one goes to the tokenizer.
_OTHER = re.compile("[^\t\n\r -~¡-ɏ]")


@dataclass(frozen=True)
class Files:
    """Places, on the executors, of A's tokenizer and the same vocabulary's ranks with their splitting pattern, and of B's model."""

    a: str
    ranks: str
    pattern: str
    b: str


def installed() -> Files:
    import public_tokenizers as public

    return Files(public.path("byte_bpe_50k.json"), public.path("byte_bpe_50k.tiktoken"), public.PATTERN, public.path("piece_bpe_32k.model"))


def _byte_of() -> dict[str, int]:
    """The byte for which each character of a byte-level vocabulary stands: printable ones for themselves, the others in order from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


class Tokenizers:
    """Ids and bytes of both sides."""

    def __init__(self, files: Files):
        import tiktoken
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(files.a)
        self.model.encode_special_tokens = True
        with open(files.ranks, "rb") as lines:
            ranks = {base64.b64decode(x): int(y) for x, y in map(bytes.split, lines)}
        self.ranked = tiktoken.Encoding("ranks", pat_str=files.pattern, mergeable_ranks=ranks, special_tokens={})
        self.pieces = SentencePieceProcessor(model_file=files.b)
        self.bytes_a = self._bytes_a()
        self.bytes_b = [self._bytes_b(self.pieces.id_to_piece(i)) for i in range(self.pieces.get_piece_size())]
        self.sizes_a, self.sizes_b = (np.array([len(x) for x in side], dtype=np.int64) for side in (self.bytes_a, self.bytes_b))
        written = lambda n: np.array([[f"{i}{mark}".encode() for i in range(n)] for mark in ",|;"], dtype="S8").view(np.uint8).reshape(3, n, 8)
        self.written_a, self.written_b = written(len(self.bytes_a)), written(len(self.bytes_b))

    def _bytes_a(self) -> list[bytes]:
        byte_of, out = _byte_of(), [b""] * self.model.get_vocab_size()
        for token, i in self.model.get_vocab().items():
            out[i] = bytes(byte_of[c] for c in token) if all(c in byte_of for c in token) else token.encode()
        return out

    @staticmethod
    def _bytes_b(piece: str) -> bytes:
        if re.fullmatch("<0x[0-9A-Fa-f]{2}>", piece):
            return bytes([int(piece[3:5], 16)])
        return piece.replace("▁", " ").encode()

    def pair(self, text: str) -> tuple[list[int], list[int]]:
        """Ids of both sides; none if either side's bytes aren't the text's."""
        if not text:
            return [], []
        spaced = " " + text
        a = self.model.encode(spaced, add_special_tokens=False).ids if _OTHER.search(text) else self.ranked.encode_ordinary(spaced)
        b = self.pieces.encode(text)
        data = spaced.encode()
        if b"".join(map(self.bytes_a.__getitem__, a)) != data or b"".join(map(self.bytes_b.__getitem__, b)) != data:
            return [], []
        return a, b


@lru_cache(maxsize=1)
def worker_tokenizers(files: Files) -> Tokenizers:
    """One pair per Python worker."""
    return Tokenizers(files)


# --- documents in lockstep ----------------------------------------------------


def lanes(ends_a: np.ndarray, ends_b: np.ndarray, first_a: np.ndarray, first_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(A start, B start, A stop) of every lane; ``first_*`` are the documents' first tokens and the end of all."""
    some = first_a[1:] > first_a[:-1]
    starts_a, starts_b = first_a[:-1][some], first_b[:-1][some]
    tries = [np.arange(lo + LANE, hi - LANE, LANE) for lo, hi in zip(first_a[:-1], first_a[1:]) if hi - lo > 2 * LANE]
    if tries:
        at = np.concatenate(tries)[:, None] + np.arange(min(LOOK, LANE))
        meets = np.searchsorted(ends_b, ends_a[at])
        same = ends_b[meets] == ends_a[at]
        row, column = np.flatnonzero(same.any(axis=1)), same.argmax(axis=1)
        starts_a = np.concatenate([starts_a, at[row, column[row]] + 1])
        starts_b = np.concatenate([starts_b, meets[row, column[row]] + 1])
        order = np.argsort(starts_a)
        starts_a, starts_b = starts_a[order], starts_b[order]
    return starts_a, starts_b, np.append(starts_a[1:], first_a[-1])


def lockstep(ends_a: np.ndarray, ends_b: np.ndarray, a: np.ndarray, b: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(A of links, B of links, A of cuts, B of cuts): token places, as all lanes advance together."""
    links_a, links_b, cuts_a, cuts_b = [], [], [], []
    while len(a):
        links_a.append(a)
        links_b.append(b)
        x, y = ends_a[a], ends_b[b]
        same = x == y
        cuts_a.append(a[same])
        cuts_b.append(b[same])
        a, b = a + (x <= y), b + (y <= x)
        going = a < stop
        if not going.all():
            a, b, stop = a[going], b[going], stop[going]
    return tuple(np.concatenate(x) if x else np.zeros(0, np.int64) for x in (links_a, links_b, cuts_a, cuts_b))


class Merged:
    """The tokens, links and groups of documents that advanced together."""

    def __init__(self, tokens: Tokenizers, texts: list[str | None]):
        pairs = [tokens.pair(t or "") for t in texts]
        self.tokens, self.n = tokens, len(texts)
        side = lambda k: np.fromiter((i for p in pairs for i in p[k]), dtype=np.int64, count=sum(len(p[k]) for p in pairs))
        first = lambda k: np.concatenate([[0], np.cumsum([len(p[k]) for p in pairs])]).astype(np.int64)
        self.a, self.b, self.first_a, self.first_b = side(0), side(1), first(0), first(1)
        del pairs
        ends_a, ends_b = np.cumsum(tokens.sizes_a[self.a]), np.cumsum(tokens.sizes_b[self.b])
        self.links_a, self.links_b, cuts_a, cuts_b = lockstep(ends_a, ends_b, *lanes(ends_a, ends_b, self.first_a, self.first_b))
        self.last_a, self.last_b = np.zeros(len(self.a), dtype=bool), np.zeros(len(self.b), dtype=bool)
        self.last_a[cuts_a] = self.last_b[cuts_b] = True
        self.ends_a = ends_a

    def document_of(self, first: np.ndarray) -> np.ndarray:
        return np.repeat(np.arange(self.n), np.diff(first))

    def counts(self) -> list[np.ndarray]:
        """Tokens of A and B, groups and links of each document."""
        of_a = self.document_of(self.first_a)
        return [np.diff(self.first_a), np.diff(self.first_b), np.bincount(of_a[self.last_a], minlength=self.n), np.bincount(of_a[self.links_a], minlength=self.n)]

    def linked(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, pair, links): the distinct id pairs of each document, in order; a pair is A's id times the size of B plus B's."""
        pair = self.a[self.links_a] * len(self.tokens.bytes_b) + self.b[self.links_b]
        both, links = np.unique((self.document_of(self.first_a)[self.links_a] << 32) | pair, return_counts=True)
        return both >> 32, both & 0xFFFFFFFF, links

    def groups(self) -> tuple[np.ndarray, np.ndarray]:
        """The group of each token of A and of B, from 0 over all documents."""
        return tuple(np.cumsum(last) - last for last in (self.last_a, self.last_b))

    def hashes(self) -> list[str]:
        """sha256 of each document's groups in writing; empty without tokens."""
        tokens, (of_a, of_b) = self.tokens, self.groups()
        n = int(self.last_a.sum())
        before = lambda of: np.concatenate([[0], np.cumsum(np.bincount(of, minlength=n))])
        out = np.zeros((len(self.a) + len(self.b), 8), dtype=np.uint8)
        out[np.arange(len(self.a)) + before(of_b)[of_a]] = tokens.written_a[self.last_a.astype(np.int8), self.a]
        out[np.arange(len(self.b)) + before(of_a)[of_b + 1]] = tokens.written_b[2 * self.last_b.astype(np.int8), self.b]
        ends = np.concatenate([[0], np.cumsum((out != 0).sum(axis=1))])[self.first_a + self.first_b]
        data = out[out != 0].tobytes()
        return [hashlib.sha256(data[lo : hi - 1]).hexdigest() if hi > lo else "" for lo, hi in zip(ends[:-1], ends[1:])]


def merged_slices(tokens: Tokenizers, texts: list[str | None]) -> Iterator[tuple[int, Merged]]:
    """(first row, merged) of runs of rows with a bounded number of characters."""
    at, size = 0, 0
    for i, text in enumerate(texts):
        size += len(text or "")
        if size >= TOGETHER or i + 1 == len(texts):
            yield at, Merged(tokens, texts[at : i + 1])
            at, size = i + 1, 0


# --- jobs ---------------------------------------------------------------------


def _packed(values: np.ndarray) -> bytes:
    """Small numbers, byte planes apart, compressed."""
    planes = values.astype("<u4").view(np.uint8).reshape(-1, 4).T
    return pa.compress(np.ascontiguousarray(planes).tobytes(), codec="zstd", asbytes=True)


def _unpacked(data: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(data, 4 * n, codec="zstd", asbytes=True), dtype=np.uint8).reshape(4, n)
    return np.ascontiguousarray(planes.T).view("<u4").reshape(-1).astype(np.int64)


FOUND = "unit long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_pairs long, steps binary, links binary, at long, a long, b long, docs long"
_TYPES = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
OF_DOC = [c.split()[0] for c in FOUND.split(", ")[:10]]


def _found(docs: DataFrame, files: Files | None) -> DataFrame:
    """Rows of documents (``at`` null) and of the distinct pairs of each unit, numbered in order from 0."""
    names = [c.split()[0] for c in FOUND.split(", ")]
    kinds = [_TYPES[c.split()[1]] for c in FOUND.split(", ")]

    def batch_of(n: int, **columns) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(columns[c], kind) if c in columns else pa.nulls(n, kind) for c, kind in zip(names, kinds)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = worker_tokenizers(files or installed())
        unit = TaskContext.get().partitionId() << 32
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            counts, hashes, documents, pairs, times = [[], [], [], []], [], [], [], []
            for at, m in merged_slices(tokens, texts):
                for all_of, some in zip(counts, m.counts()):
                    all_of.append(some)
                hashes += m.hashes()
                document, pair, links = m.linked()
                documents.append(document + at)
                pairs.append(pair.astype(np.uint32))
                times.append(links.astype(np.uint32))
            if not texts:
                continue
            documents, times = np.concatenate(documents), np.concatenate(times)
            distinct, place, n_docs = np.unique(np.concatenate(pairs), return_inverse=True, return_counts=True)
            cuts = np.searchsorted(documents, np.arange(len(texts) + 1))
            # a document's pairs are in order, so their places rise
            steps = [_packed(np.diff(place[lo:hi], prepend=0)) for lo, hi in zip(cuts[:-1], cuts[1:])]
            links = [_packed(times[lo:hi]) for lo, hi in zip(cuts[:-1], cuts[1:])]
            n, units = len(texts), np.full(len(texts), unit)
            some = dict(zip(("n_a", "n_b", "n_groups", "n_links"), map(np.concatenate, counts)))
            yield batch_of(n, unit=units, doc_id=ids, groups_sha256=hashes, n_pairs=np.diff(cuts), steps=steps, links=links, **some)
            size_b = len(tokens.bytes_b)
            for lo in range(0, len(distinct), 1 << 16):
                part = distinct[lo : lo + (1 << 16)].astype(np.int64)
                yield batch_of(len(part), unit=np.full(len(part), unit), at=np.arange(lo, lo + len(part)), a=part // size_b, b=part % size_b, docs=n_docs[lo : lo + (1 << 16)])
            unit += 1

    return pick(docs, doc_id="long", text="string").mapInArrow(run, FOUND)


ALIGNED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def pair_counts(found: DataFrame) -> DataFrame:
    """(a, b, n, best): in how many documents each id pair is linked, and whether no pair of its A id is in more."""
    counts = found.where("at IS NOT NULL").groupBy("a", "b").agg(F.sum("docs").alias("n"))
    # as many rows as A has ids at most
    most = counts.groupBy("a").agg(F.max("n").alias("most"))
    return counts.join(F.broadcast(most), "a").select("a", "b", "n", (F.col("n") == F.col("most")).alias("best"))


def align(docs: DataFrame, files: Files | None = None) -> DataFrame:
    """A row for each document: tokens, groups, links, and how the links stand in the whole corpus.

    ``n_best`` counts links whose pair is in the most documents of all pairs of
    its A id, ``count_sum`` adds up the documents that hold each link's pair.
    """
    found = Scratch(docs.sparkSession, "alignment").keep(_found(docs, files))
    of_pairs = found.where("at IS NOT NULL").select("unit", "at", "a", "b").join(pair_counts(found), ["a", "b"]).select(F.col("unit").alias("of_unit"), "at", "n", "best")
    of_docs = found.where("at IS NULL").select(*OF_DOC)

    def summed(rows: pa.Table, pairs: pa.Table) -> pa.Table:
        n, best = (np.zeros(pairs.num_rows, dtype=np.int64) for _ in range(2))
        at = pairs.column("at").to_numpy()
        n[at], best[at] = pairs.column("n").to_numpy(), pairs.column("best").to_numpy(zero_copy_only=False)
        sums = []
        for size, steps, links in zip(*(rows.column(c).to_pylist() for c in ("n_pairs", "steps", "links"))):
            where, times = np.cumsum(_unpacked(steps, size)), _unpacked(links, size)
            sums.append((int(best[where] @ times), int(n[where] @ times)))
        out = {c: rows.column(c) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")}
        out |= {"n_best": pa.array([x for x, _ in sums], pa.int64()), "count_sum": pa.array([x for _, x in sums], pa.int64()), "groups_sha256": rows.column("groups_sha256")}
        return pa.table(out)

    return of_docs.groupBy("unit").cogroup(of_pairs.groupBy("of_unit")).applyInArrow(summed, ALIGNED)


GROUPS = "doc_id long, number long, start long, end long, a array<int>, b array<int>"


def aligned_groups(docs: DataFrame, files: Files | None = None) -> DataFrame:
    """A row for each group of each document: its place among them, its bytes in blank and text, its ids of both sides."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = worker_tokenizers(files or installed())
        for batch in batches:
            for at, m in merged_slices(tokens, batch.column(1).to_pylist()):
                ends = m.ends_a[m.last_a]
                starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
                document = m.document_of(m.first_a)[m.last_a]
                first = np.searchsorted(document, document)
                lists = [pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.flatnonzero(last) + 1]).astype(np.int32)), pa.array(ids.astype(np.int32))) for ids, last in ((m.a, m.last_a), (m.b, m.last_b))]
                base = starts[first] if len(starts) else starts
                columns = [batch.column(0).take(pa.array(document + at)), pa.array(np.arange(len(document)) - first), pa.array(starts - base), pa.array(ends - base), *lists]
                yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in GROUPS.split(", ")])

    return pick(docs, doc_id="long", text="string").mapInArrow(run, GROUPS)


def op11_alignment(spark, sf_dir: str) -> DataFrame:
    return align(spark.read.parquet(f"{sf_dir}/documents.parquet"))
