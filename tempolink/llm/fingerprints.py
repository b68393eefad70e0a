"""Document fingerprints: bottom-k sketches of shingle hashes.

A fingerprint holds the ``K`` smallest distinct 48-bit hashes of a text's
five-word shingles.  Fingerprints of parts merge into that of the whole, and
estimate resemblance, containment and the number of distinct shingles.

Sketches are ``array<long>`` columns in ascending order; ``sketch_merge`` and
the estimators are plain column functions.  ``sketch_parts`` merges any number
of parts a key, pre-aggregated per partition, so a hot key is no burden.

Defined cases: a null or empty text, or one without words, has an empty
sketch; two empty sketches resemble each other fully (1.0), an empty and another
one not at all (0.0); equal texts have equal sketches; an empty table gives no
rows; repeated rows are sketched each on its own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .shared import pick, shingle_sets, text_slices

K = 128
_TOP = 1 << 48


def bottom_k(column: pa.Array, k: int = K) -> list[np.ndarray]:
    """The sketch of each text of a string column."""
    out = []
    for _, data, offs in text_slices(column):
        values, ends = shingle_sets(data, offs)
        values = values >> np.uint64(16)
        for a, b in zip(ends[:-1], ends[1:]):
            # the sets are sorted; only the smallest count, less those that 48 bits make equal
            out.append(np.unique(values[a : min(b, a + 2 * k)])[:k].astype(np.int64))
    return out


def likeness(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated resemblance of two sketches."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    if len(a) == len(b) and (a == b).all():
        return 1.0
    both = np.concatenate([a, b])
    both.sort()
    same = both[1:][both[1:] == both[:-1]]
    if not len(same):
        return 0.0
    union = np.unique(both)[:k]
    return float(np.searchsorted(same, union[-1], "right")) / len(union)


def estimated(sketch: np.ndarray, k: int = K) -> float:
    """Estimated number of distinct shingles; exact below ``k``."""
    return float(len(sketch)) if len(sketch) < k else (k - 1) * _TOP / (int(sketch[-1]) + 1)


def fingerprint_text(sketch: np.ndarray) -> str:
    """Twelve hex digits for each hash."""
    return sketch.astype(">i8").view(np.uint8).reshape(-1, 8)[:, 2:].tobytes().hex()


def sketch_documents(docs: DataFrame, k: int = K) -> DataFrame:
    """(doc_id, sketch array<long>) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sketches = pa.array(bottom_k(batch.column(1), k), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), sketches], names=["doc_id", "sketch"])

    return pick(docs, doc_id="long", text="string").mapInArrow(run, "doc_id long, sketch array<long>")


def sketch_merge(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of the union of what two sketches stand for."""
    return F.slice(F.array_sort(F.array_union(a, b)), 1, k)


#: Parts of a key that one task merges at a time, keys whose sketches a task holds, and rounds of merging.
FAN, HELD, ROUNDS = 64, 4096, 3


def sketch_parts(parts: DataFrame, key: str, k: int = K) -> DataFrame:
    """(key, sketch): the merged sketches of each key's parts.

    Takes a ``sketch`` column.  A task merges what it reads of a key before
    anything is shuffled, so at most k hashes of a key leave it, and more only
    where it meets more than ``HELD`` keys.  Then come ``ROUNDS`` rounds: the parts of
    a key from ``FAN`` neighbouring tasks, of as many such groups, and so on, so
    that no group of a hot key is large.  Null sketches are empty; null keys are
    one key.
    """
    kind = parts.schema[key].dataType
    schema = T.StructType([T.StructField("key", kind), T.StructField("part", T.LongType()), T.StructField("sketch", T.ArrayType(T.LongType()))])
    arrow = to_arrow_type(kind)

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        keys, places, sketches = zip(*rows)
        return pa.RecordBatch.from_arrays([pa.array(keys, arrow), pa.array(places, pa.int64()), pa.array(sketches, pa.list_(pa.int64()))], names=["key", "part", "sketch"])

    def lowest(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.unique(np.concatenate([a, b]))[:k]

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = TaskContext.get().partitionId(), {}
        for batch in batches:
            for name, hashes in zip(batch.column(0).to_pylist(), batch.column(1)):
                own = np.zeros(0, np.int64) if not hashes.is_valid else hashes.values.to_numpy(zero_copy_only=False)
                held[name] = lowest(held.get(name, own[:0]), own)
            if len(held) > HELD:
                yield batch_of([(name, part, sketch) for name, sketch in held.items()])
                held = {}
        if held:
            yield batch_of([(name, part, sketch) for name, sketch in held.items()])

    def merged(table: pa.Table) -> pa.Table:
        sketch = np.zeros(0, np.int64)
        for hashes in table.column("sketch"):
            sketch = lowest(sketch, hashes.values.to_numpy(zero_copy_only=False))
        return pa.Table.from_batches([batch_of([(table.column("key")[0].as_py(), table.column("part")[0].as_py() // FAN, sketch)])])

    rows = parts.select(F.col(key).alias("key"), F.col("sketch").cast("array<long>").alias("sketch")).mapInArrow(near, schema)
    for level in range(ROUNDS):
        group = F.floor(F.col("part") / FAN) if level + 1 < ROUNDS else F.lit(0)
        rows = rows.groupBy("key", group.alias("g")).applyInArrow(merged, schema)
    return rows.select(F.col("key").alias(key), "sketch")


def distinct_count(sketch: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles; exact below ``k``."""
    full = (k - 1) * F.lit(float(_TOP)) / (F.element_at(sketch, -1) + 1)
    return F.when(F.size(sketch) < k, F.size(sketch).cast("double")).otherwise(full)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard similarity of what two sketches stand for."""
    union = sketch_merge(a, b, k)
    shared = F.size(F.array_intersect(union, F.array_intersect(a, b)))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), (F.size(a) == F.size(b)).cast("double")).otherwise(shared / F.size(union))


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b has."""
    overlap = resemblance(a, b, k) * distinct_count(sketch_merge(a, b, k), k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), overlap / distinct_count(a, k)))


PAIRED = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_shingles_estimate double, n_both_estimate double, contained_next double"


def with_next(docs: DataFrame, rows_per_run: int = 4096, many: int = 2048, rows_then: int = 65_536) -> DataFrame:
    """The rows cut into runs of descending doc_id, each run followed by its successor.

    Returns (run, doc_id, text, tag, spare): within a run, sorted by it, each
    row's next document is the row after it.  Spare rows only serve as the
    last row's next.  Rows of one id follow each other by ``tag``; null ids come
    last; after the last of all comes the first.

    Runs come from quantiles of the ids alone, so the texts are shuffled once.
    A partition is one run, sorted with spilling.  Runs hold ``rows_per_run`` rows
    until there are ``many``, then grow to ``rows_then``, and then their number
    grows with the rows: what lies between two quantiles is cut evenly.  All rows
    of one id, or without one, are in one run.
    """
    rows = pick(docs, doc_id="long", text="string").withColumn("text", F.coalesce("text", F.lit("")))
    rows = rows.withColumn("tag", F.xxhash64("text"))
    ids = rows.select("doc_id")
    n_rows = ids.count()
    n_cuts = min(many, max(1, -(-n_rows // rows_per_run)))
    pieces = max(1, -(-n_rows // (n_cuts * max(rows_per_run, rows_then))))
    cuts: list[int] = []
    if n_cuts > 1:
        shares = [i / n_cuts for i in range(1, n_cuts)]
        found = ids.agg(F.percentile_approx("doc_id", shares, 20 * n_cuts), F.min("doc_id"), F.max("doc_id")).head()
        cuts = sorted(set(found[0] or []))
    # run 0 holds null ids; the others are in rising order of ids
    step = _steps(F.col("doc_id"), cuts)
    if pieces > 1 and cuts:
        bounds = F.array(*map(F.lit, [found[1], *cuts, found[2]]))
        low, high = (F.get(bounds, step + i).cast("double") for i in (0, 1))
        share = F.when(high > low, (F.col("doc_id") - low) / (high - low)).otherwise(0.0)
        step = step * pieces + F.least(F.lit(pieces - 1), F.greatest(F.lit(0), F.floor(share * pieces))).cast("int")
    run = F.when(F.col("doc_id").isNull(), 0).otherwise(step + 1)
    tops = ids.withColumn("run", run).groupBy("run").agg(F.max("doc_id").alias("top")).orderBy("run").collect()
    # what follows the bottom of a run is the top of the run below, at last that of the highest
    spares = [(below["top"], above["run"]) for below, above in zip(tops, tops[1:] + tops[:1])]
    table = docs.sparkSession.createDataFrame(spares, "top long, to int")
    own = F.struct(run.alias("run"), F.lit(False).alias("spare"))
    extra = F.struct(F.col("to").alias("run"), F.lit(True).alias("spare"))
    places = F.when(F.col("to").isNull(), F.array(own)).otherwise(F.array(own, extra))
    placed = rows.join(F.broadcast(table), F.col("doc_id").eqNullSafe(F.col("top")), "left").select("doc_id", "text", "tag", F.explode(places).alias("p"))
    placed = placed.select("p.run", "doc_id", "text", "tag", "p.spare")
    return placed.repartitionById((len(cuts) + 1) * pieces + 1, F.col("run")).sortWithinPartitions("spare", F.col("doc_id").desc_nulls_last(), "tag")


def _steps(value: Column, cuts: list[int]) -> Column:
    """How many of the sorted cuts lie below the value, by halving."""
    if not cuts:
        return F.lit(0)
    m = len(cuts) // 2
    return F.when(value <= cuts[m], _steps(value, cuts[:m])).otherwise(_steps(value, cuts[m + 1 :]) + (m + 1))


def compare_with_next(docs: DataFrame, k: int = K) -> DataFrame:
    """Each document's fingerprint beside those of its edited text and of the next document.

    The edited text has the last third of the characters replaced by as many
    of the next document's first.  ``n_both_estimate`` counts the distinct shingles
    of document and next together, by their merged sketch; ``contained_next`` is the
    share of the document's that the next one has.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # (run, doc_id, text, sketch) of the row before
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                runs, ids, texts, _, spare = (c.to_pylist() for c in part.columns)
                rows = list(zip(runs, ids, texts, bottom_k(part.column(2), k), spare))
                own, edited, out = [], [], []
                for row in rows:
                    if held is not None and row[0] == held[0] and not held[4]:
                        n = len(held[2])
                        cut = n // 3
                        own.append((held, row))
                        edited.append(held[2][: n - cut] + row[2][:cut])
                    held = row
                for (a, b), text, sketch in zip(own, edited, bottom_k(pa.array(edited, pa.string()), k)):
                    n = len(a[2])
                    count, next_like = estimated(a[3], k), likeness(a[3], b[3], k)
                    both = estimated(np.unique(np.concatenate([a[3], b[3]]))[:k], k)  # of the merged sketch
                    shared = min(1.0, next_like * both / count) if count else 1.0
                    out.append((a[1], n, hashlib.sha256(text.encode()).hexdigest(), fingerprint_text(a[3]), fingerprint_text(sketch), likeness(a[3], sketch, k), next_like, count, both, shared))
                if out:
                    names = [x.split()[0] for x in PAIRED.split(", ")]
                    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), *[pa.float64()] * 5]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=names)

    return with_next(docs).mapInArrow(run, PAIRED)


def op3_fingerprints(spark, sf_dir: str) -> DataFrame:
    return compare_with_next(spark.read.parquet(f"{sf_dir}/documents.parquet"))
