"""Hierarchical multi-length packing of documents into training sequences.

A document is its token ids and an end id.  Whole windows are cut off first;
what remains is routed to the smallest tier (512, 1024 or 2048 tokens) that
holds it.  Each tier packs its own pieces, largest first.  A gap in a long
window is filled from the shorter tiers, and at last by cutting one piece, so a
sequence is exactly full.  Sequences whose length is a power of two need no
padding.  A partition's sequences, in the order they are packed, form step groups
of 131,072 tokens; the last two share evenly what is left, so that none is less
than half full but for a partition that holds less.

Each Spark partition packs on its own while it streams through its rows, so
there is no shuffle, memory is bounded by one pool of pieces, and a lost task is
simply run again with the same result.

Defined cases: a null or empty text is the end id alone; equal rows are packed
each on its own; an empty table gives no rows; a null doc_id stays null; a text
of any length is cut.
"""

from __future__ import annotations

import base64
import re
import zlib
from array import array
from bisect import bisect_right, insort
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import pick

TIERS = (512, 1024, 2048)
END_ID = 1
#: Pieces that wait in one tier before it packs a round.
POOL = 2048
#: Distinct chunks of text whose ids a worker remembers.
REMEMBERED = 400_000
STEP_TOKENS = 131_072

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, step_group long"


#: Blanks other than the space and the line feed.
_OTHER_BLANK = re.compile("[\t\x0b-\x0d\x1c-\x1f\x85\xa0  -     　]")
_MARKS = set(".,!?;:|")
_BEYOND_LATIN = re.compile("[^\x00-ɏ]")


class ChunkTokenizer:
    """Ids of whole texts, each blank-separated chunk looked up once.

    The vocabulary's splitting rule always breaks before a single space and
    around a single line feed between other characters, so chunks between them
    are tokenised independently.  A text with any other arrangement of blanks
    goes to the tokenizer whole.  Chunks of Latin letters are read with the same
    vocabulary's ranks, which gives the same ids several times faster.
    """

    def __init__(self, path: str, ranks: str, pattern: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.added = [t.content for t in self.model.get_added_tokens_decoder().values()]
        with open(ranks, "rb") as lines:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.latin = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        self.piece = self.latin._core_bpe.encode_single_piece
        self.feed = self._encode("\n")
        self.spaced: dict[str, bytes] = {}
        self.heads: dict[str, bytes] = {}

    def _encode(self, text: str) -> bytes:
        return array("I", self.model.encode(text, add_special_tokens=False).ids).tobytes()

    def _chunk(self, text: str) -> bytes:
        if _BEYOND_LATIN.search(text):
            return self._encode(text)
        stem = text[:-1]
        if text[-1:] in _MARKS and stem[1:].isalpha() and stem[0] == " ":  # the rule parts a word from a mark
            if stem[1:] not in self.spaced:
                self.spaced[stem[1:]] = self._chunk(stem)
            return self.spaced[stem[1:]] + self._chunk(text[-1])
        if text[1:].isalpha() and text[0] == " ":
            return array("I", self.piece(text.encode())).tobytes()
        return array("I", self.latin.encode_ordinary(text)).tobytes()

    def ids(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        spaced, heads = self.spaced, self.heads
        if len(spaced) + len(heads) > REMEMBERED:
            spaced.clear()
            heads.clear()
        out = []
        for text in texts:
            if any(map(text.__contains__, self.added)) or "  " in text or "\n\n" in text or " \n" in text or "\n " in text or text[:1].isspace() or text[-1:].isspace() or _OTHER_BLANK.search(text):
                out.append(self._encode(text))
                continue
            lines = []
            for line in text.split("\n"):
                head, *rest = line.split(" ")
                try:
                    ids = b"".join(map(spaced.__getitem__, rest))
                except KeyError:
                    for c in set(rest).difference(spaced):
                        spaced[c] = self._chunk(" " + c)
                    ids = b"".join(map(spaced.__getitem__, rest))
                if head not in heads:
                    heads[head] = self._chunk(head)
                lines.append(heads[head] + ids)
            out.append(self.feed.join(lines))
        return out


@lru_cache(maxsize=1)
def worker_tokenizer(path: str, ranks: str, pattern: str) -> ChunkTokenizer:
    """One per Python worker; later tasks find its chunks known."""
    return ChunkTokenizer(path, ranks, pattern)


class Packer:
    """Packs the pieces of one partition; yields (sequence, tier, pieces)."""

    def __init__(self, tiers: tuple[int, ...]):
        self.tiers = tiers
        self.pools: dict[int, list] = {t: [] for t in tiers}

    def add(self, doc, n: int) -> Iterator[tuple[int, list]]:
        """doc: the document's key; n: its tokens.  Pieces are (length, doc, start)."""
        window, at = self.tiers[-1], 0
        while n - at >= window:
            yield window, [(window, doc, at)]
            at += window
        if at < n:
            self._put((n - at, doc, at))
            if sum(map(len, self.pools.values())) >= POOL:
                yield from self.flush(final=False)

    def _put(self, piece) -> None:
        insort(self.pools[next(t for t in self.tiers if piece[0] <= t)], piece)

    def _best(self, room: int, tier: int):
        """The longest waiting piece of at most ``room``, long tiers first."""
        for t in reversed([t for t in self.tiers if t <= tier]):
            pool = self.pools[t]
            k = bisect_right(pool, room, key=lambda p: p[0])
            if k:
                return pool.pop(k - 1)
        return None

    def _cut(self, room: int, tier: int):
        """The first ``room`` tokens of the shortest piece that is longer."""
        for t in (t for t in self.tiers if t <= tier):
            pool = self.pools[t]
            k = bisect_right(pool, room, key=lambda p: p[0])
            if k < len(pool):
                n, doc, at = pool.pop(k)
                self._put((n - room, doc, at + room))
                return room, doc, at
        return None

    def flush(self, final: bool) -> Iterator[tuple[int, list]]:
        """Packs the pools, long tiers first; at the end also the last tokens."""
        for tier in reversed(self.tiers):
            left = sum(p[0] for t in self.tiers if t <= tier for p in self.pools[t])
            while self.pools[tier] and left >= tier:
                room, row = tier, []
                while room:
                    piece = self._best(room, tier) or self._cut(room, tier)
                    row.append(piece)
                    room -= piece[0]
                left -= tier
                yield tier, row
        if final:
            size = self.tiers[-1]
            rest = sorted((p for pool in self.pools.values() for p in pool), reverse=True)
            total = sum(p[0] for p in rest)
            while total:
                while size > total:
                    size //= 2
                room, row = size, []
                while room:
                    n, doc, at = rest.pop(0)
                    row.append((min(n, room), doc, at))
                    if n > room:
                        rest.insert(0, (n - room, doc, at + room))
                    room -= row[-1][0]
                total -= size
                yield size, row
            self.pools = {t: [] for t in self.tiers}


def pack_documents(
    docs: DataFrame,
    vocabulary: tuple[str, str, str] | None = None,
    tiers: tuple[int, ...] = TIERS,
    with_ids: bool = True,
) -> DataFrame:
    """One row per piece; with ``with_ids`` also its token ids.

    ``vocabulary``: the tokenizer file, the same vocabulary's rank file, both on
    the executors, and its splitting pattern; by default those installed.
    """
    schema = PIECES + (", ids array<int>" if with_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = vocabulary
        if files is None:
            import public_tokenizers as public

            files = public.path("byte_bpe_50k.json"), public.path("byte_bpe_50k.tiktoken"), public.PATTERN
        tokens, packer = worker_tokenizer(*files), Packer(tiers)
        base = TaskContext.get().partitionId() << 36
        texts: dict[int, list] = {}  # key -> [doc_id, ids, tokens still unpacked]
        n_sequences, n_groups = 0, 0
        waiting: list[tuple[int, list[tuple]]] = []  # sequences without a group, less than two groups' tokens
        rows: list[tuple] = []

        def close(most: int):
            """The first waiting sequences of so many tokens become a step group."""
            nonlocal n_groups
            size, n = 0, 0
            while n < len(waiting) and size + waiting[n][0] <= most:
                size += waiting[n][0]
                n += 1
            rows.extend(row[:8] + (base + n_groups,) + row[8:] for _, sequence in waiting[:n] for row in sequence)
            del waiting[:n]
            n_groups += 1

        def emit(sequences):
            nonlocal n_sequences
            for size, pieces in sequences:
                offset, sequence = 0, []
                for length, key, start in pieces:
                    doc = texts[key]
                    ids = doc[1][4 * start : 4 * (start + length)]
                    row = (doc[0], start, length, zlib.crc32(ids), len(doc[1]) // 4, base + n_sequences, offset, size)
                    sequence.append(row + (np.frombuffer(ids, dtype="<i4"),) if with_ids else row)
                    offset += length
                    doc[2] -= length
                    if not doc[2]:
                        del texts[key]
                waiting.append((size, sequence))
                n_sequences += 1
                if len(waiting) % 64 == 0 and sum(s for s, _ in waiting) >= 2 * STEP_TOKENS:
                    close(STEP_TOKENS)

        def flushed() -> pa.RecordBatch:
            columns = list(zip(*rows))
            arrays = [pa.array(c, pa.int32() if i == 7 else pa.list_(pa.int32()) if i == 9 else pa.int64()) for i, c in enumerate(columns)]
            names = [x.split()[0] for x in schema.split(", ")]
            rows.clear()
            return pa.RecordBatch.from_arrays(arrays, names=names)

        key = 0
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                for doc_id, ids in zip(part.column(0).to_pylist(), tokens.ids(part.column(1).fill_null("").to_pylist())):
                    ids += END_ID.to_bytes(4, "little")
                    n = len(ids) // 4
                    texts[key] = [doc_id, ids, n]
                    emit(packer.add(key, n))
                    key += 1
                    if len(rows) >= 4096:
                        yield flushed()
        emit(packer.flush(final=True))
        left = sum(s for s, _ in waiting)
        while left > STEP_TOKENS:
            close(STEP_TOKENS if left > 2 * STEP_TOKENS else left // 2 + tiers[-1])
            left = sum(s for s, _ in waiting)
        if waiting:
            close(left)
        if rows:
            yield flushed()

    return pick(docs, doc_id="long", text="string").mapInArrow(run, schema)


def op4_packing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pack_documents(docs, with_ids=False).withColumn("padded", F.lit(0).cast("long"))
