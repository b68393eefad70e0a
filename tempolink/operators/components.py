"""Connected components of an edge table, in rounds of joins.

Edges first shrink where they lie: a task joins up the edges of a bounded batch
and passes on a spanning forest; if all came from one batch, that is the answer.
What is left is one more batch if it fits into one.  Else every round hooks each vertex to the first of its neighbours and itself,
follows the pointers a few steps, and contracts the edges to what still differs.
First is the smallest number, which settles stars, or in most rounds the smallest
hash, by which a long chain needs few rounds, however it is numbered.  Aggregates are partial before they shuffle, so
a vertex with very many edges is no burden, and every round's tables go to the
shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import Scratch

JUMPS = 2
#: Edges that a task joins up at a time.
BATCH = 1 << 19


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(root, vertex) of every vertex but the roots, the smallest of their components."""
    names, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    label = np.arange(len(names))
    while (label[a] != label[b]).any():
        low = np.minimum(label[a], label[b])
        to = np.arange(len(names))
        np.minimum.at(to, label[a], low)
        np.minimum.at(to, label[b], low)
        while (to[to] != to).any():
            to = to[to]
        label = to[label]
    keep = label != np.arange(len(names))
    return names[label[keep]], names[keep]


def _shrunk(edges: DataFrame) -> DataFrame:
    """(u, v, batch) with the same components: a spanning forest of each batch of edges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = TaskContext.get().partitionId() << 32

        def joined(us, vs):
            u, v = forest(np.concatenate(us), np.concatenate(vs))
            return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v), pa.array(np.full(len(u), done))], names=["u", "v", "batch"])

        us, vs, n = [], [], 0
        for batch in batches:
            us.append(batch.column(0).to_numpy(zero_copy_only=False))
            vs.append(batch.column(1).to_numpy(zero_copy_only=False))
            n += batch.num_rows
            if n >= BATCH:
                yield joined(us, vs)
                us, vs, n = [], [], 0
                done += 1
        if n:
            yield joined(us, vs)

    return edges.mapInArrow(run, "u long, v long, batch long")


def components(edges: DataFrame, scratch: Scratch, most_rounds: int = 60) -> DataFrame:
    """(vertex, component): the smallest vertex that each vertex of an edge can reach.

    ``edges`` has long columns ``u`` and ``v``; self-links and repeats do no
    harm.  Vertices without edges aren't returned; the edges must have no nulls.
    """
    counts = {"n": F.count(F.lit(1)), "low": F.min("batch"), "high": F.max("batch")}
    edges = scratch.keep(_shrunk(edges.where("u <> v").select("u", "v")), **counts)
    pointers: list[DataFrame] = []
    while edges.counts["low"] != edges.counts["high"]:
        if edges.counts["n"] <= BATCH:
            batch = scratch.keep(_shrunk(edges.select("u", "v").coalesce(1)), **counts)
            scratch.drop(edges)
            edges = batch
            if edges.counts["low"] == edges.counts["high"]:
                break
        if len(pointers) == most_rounds:
            raise RuntimeError(f"components not settled after {most_rounds} rounds")
        by = len(pointers) % 3
        order = lambda c: F.struct((F.xxhash64(c, F.lit(len(pointers))) if by else F.col(c)).alias("h"), F.col(c).alias("p"))
        ends = F.array(F.struct(F.col("u").alias("u"), order("u").alias("o")), F.struct(F.col("u").alias("u"), order("v").alias("o")), F.struct(F.col("v").alias("u"), order("u").alias("o")), F.struct(F.col("v").alias("u"), order("v").alias("o")))
        parents = edges.select(F.explode(ends).alias("e")).groupBy("e.u").agg(F.min("e.o")["p"].alias("p"))
        parents = scratch.keep(parents)
        up = parents.select(F.col("u").alias("p"), F.col("p").alias("pp"))
        jumped = parents
        for _ in range(JUMPS):
            jumped = jumped.join(up, "p").select("u", F.col("pp").alias("p"))
        jumped = scratch.keep(jumped)
        scratch.drop(parents)
        a, b = jumped.select("u", F.col("p").alias("a")), jumped.select(F.col("u").alias("v"), F.col("p").alias("b"))
        ab = edges.join(a, "u").join(b, "v").where("a <> b").select(F.col("a").alias("u"), F.col("b").alias("v"))
        contracted = scratch.keep(_shrunk(ab), **counts)
        scratch.drop(edges)
        edges = contracted
        pointers.append(jumped)
    # the last edges are stars around their smallest vertices; from these few back to all
    stars = edges.select("u", "v").unionByName(edges.select("u", F.col("u").alias("v")).distinct())
    if not pointers:
        return scratch.keep(stars.select(F.col("v").alias("vertex"), F.col("u").alias("component")))
    tops = stars.select(F.col("v").alias("u"), F.col("u").alias("p"))
    for below in reversed(pointers):
        above = tops.select(F.col("u").alias("p"), F.col("p").alias("top"))
        tops = below.join(above, "p", "left").select("u", F.coalesce("top", "p").alias("p"))
    tops = scratch.keep(tops)
    names = tops.groupBy("p").agg(F.min("u").alias("component"))
    return scratch.keep(tops.join(names, "p").select(F.col("u").alias("vertex"), "component"))
