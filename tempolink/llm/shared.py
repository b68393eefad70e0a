"""Text helpers used by several operators."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Most rows and bytes that a batch for Python holds: what a task needs besides
#: Spark's own memory is a few times the bytes, whatever the texts' length.
BATCH_ROWS = 2048
BATCH_BYTES = 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's limits of batches for Python to those above."""
    for key, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{key}"
        now = spark.conf.get(key).rstrip("b")
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, cast: ``pick(docs, doc_id="long", text="string")``.

    Whatever else the table carries, clashing names included, goes no further.
    """
    small_batches(df.sparkSession)
    return df.select(*[F.col(c).cast(t).alias(c) for c, t in columns.items()])


# --- vectorised words and shingles ------------------------------------------

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: ASCII blanks: space and the characters 9 to 13.
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[32, 9, 10, 11, 12, 13]] = True
NOT_BLANK = ~_BLANK
#: Letters, digits and every byte of a non-ASCII character.
WORDLIKE = np.zeros(256, dtype=bool)
WORDLIKE[48:58] = WORDLIKE[65:91] = WORDLIKE[97:123] = WORDLIKE[128:] = True

_rng = np.random.default_rng(20240)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 2**64)
_SHINGLE = _rng.integers(1, 2**63, 8, dtype=np.uint64) | np.uint64(1)
_SHORT = _rng.integers(1, 2**63, 8, dtype=np.uint64)
_powers: dict[int, np.ndarray] = {}

SHINGLE_WORDS = 5


def _power_table(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 20)
        have = np.full(size, base, dtype=np.uint64)
        have[0] = 1
        have = _powers[base] = np.multiply.accumulate(have)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_slices(column: pa.Array, most: int = 1 << 19):
    """Parts of a string column as ``(first row, bytes, offsets)``.

    A part holds whole rows and about ``most`` bytes, so temporary arrays stay
    small whatever a batch holds.  Null texts are empty.
    """
    column = column.cast(pa.large_string()) if column.type != pa.large_string() else column
    column = column.fill_null("")
    n = len(column)
    _, offs, data = column.buffers()
    offs = np.frombuffer(offs, dtype=np.int64)[column.offset : column.offset + n + 1] if n else np.zeros(1, np.int64)
    data = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        end = max(row + 1, int(np.searchsorted(offs, offs[row] + most, "right")) - 1)
        end = min(end, n)
        yield row, data[offs[row] : offs[end]], offs[row : end + 1] - offs[row]
        row = end


def word_spans(data: np.ndarray, offs: np.ndarray, kind: np.ndarray = NOT_BLANK):
    """Byte spans of the words of a slice, and each row's first word.

    ``kind`` says which bytes belong to words.  A word never crosses rows.
    """
    inside = np.zeros(len(data) + 2, dtype=bool)
    inside[1:-1] = kind[data]
    starts = inside[1:-1] & ~inside[:-2]
    ends = inside[1:-1] & ~inside[2:]
    edge = offs[1:-1]
    edge = edge[(edge > 0) & (edge < len(data))]
    starts[edge] = inside[1:-1][edge]
    ends[edge - 1] = inside[1:-1][edge - 1]
    starts, ends = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return starts, ends, np.searchsorted(starts, offs)


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Sums from which ``span_hash`` gets the hash of any byte span."""
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[_LOWER[data]] * _power_table(_BASE, len(data)), out=sums[1:])
    return sums


def span_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of byte spans, ASCII letters lower-cased; equal bytes, equal hash."""
    return mix((sums[ends] - sums[starts]) * _power_table(_BASE_INV, len(sums))[starts])


def shingle_sets(data: np.ndarray, offs: np.ndarray):
    """Sorted distinct shingle hashes of each row: ``(values, row offsets)``.

    A shingle is five words; a shorter text is one shingle, one without words
    has none.
    """
    starts, ends, first = word_spans(data, offs)
    words = span_hash(prefix_hash(data), starts, ends)
    k = SHINGLE_WORDS
    n = len(words)
    rolled = np.zeros(n, dtype=np.uint64)
    for i in range(min(k, n)):
        rolled[: n - i] += words[i:] * _SHINGLE[i]
    rolled = mix(rolled)
    out, sizes = [], np.zeros(len(offs) - 1, dtype=np.int64)
    for row in range(len(offs) - 1):
        a, b = first[row], first[row + 1]
        if b - a >= k:
            v = rolled[a : b - k + 1].copy()
            v.sort()
            keep = np.empty(len(v), dtype=bool)
            keep[0] = True
            np.not_equal(v[1:], v[:-1], out=keep[1:])
            v = v[keep]
        elif b > a:
            v = mix((words[a:b] * _SHINGLE[: b - a]).sum(keepdims=True) + _SHORT[b - a : b - a + 1])
        else:
            continue
        out.append(v)
        sizes[row] = len(v)
    values = np.concatenate(out) if out else np.zeros(0, dtype=np.uint64)
    return values, np.concatenate([[0], np.cumsum(sizes)])
