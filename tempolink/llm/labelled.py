"""Bounded samples of labelled documents, and the fold that is never learned from."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from typing import TypeVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import pick

T = TypeVar("T")

#: Longest text, in characters, that a sample takes.
LONGEST = 20_000


def held_out(doc_id: Column) -> Column:
    """Rows whose labels no model sees: crc32 of the id as text is a multiple of 5."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def sample_rows(docs: DataFrame, labels: DataFrame, column: str, most: dict[int, int], longest: int = LONGEST) -> tuple[DataFrame, float]:
    """(doc_id, text, label) of at most ``most[label]`` training documents a label, and label 1's share of all.

    Documents are taken in the order of a hash of their id; texts longer than
    ``longest`` aren't taken, so the sample has a bound in bytes too.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(column).cast("int").alias("label"))
    known = known.where(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("label").alias("label"))
    counts = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    chosen = None
    for label, n in most.items():
        part = known.where(F.col("label") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
        chosen = part if chosen is None else chosen.unionByName(part)
    texts = pick(docs, doc_id="long", text="string").join(F.broadcast(chosen), "doc_id").where(F.length("text") <= longest)
    total = sum(counts.values())
    # of rows that share an id the first text counts
    return texts.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("label").alias("label")), counts.get(1, 0) / total if total else 0.0


def fit_in_task(docs: DataFrame, labels: DataFrame, column: str, most: dict[int, int], train: Callable[[list[tuple[str, int]], float], T]) -> T:
    """``train`` of the bounded sample, by id, and label 1's share; run in one task, so that the driver holds the model only."""
    rows, share = sample_rows(docs, labels, column, most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sorted(r for b in batches for r in zip(*(c.to_pylist() for c in b.columns)))
        model = train([(text, label) for _, text, label in known], share)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], names=["model"])

    found = rows.select("doc_id", "text", "label").coalesce(1).mapInArrow(run, "model binary").collect()
    return pickle.loads(found[0]["model"]) if found else train([], share)
