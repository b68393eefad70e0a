"""Embedding near-dedup: random-hyperplane sign hashing in several tables.

Equal vectors of one label are one from here on.  Each table hashes a vector to
the signs of its products with ``bits`` random directions; vectors that share a
bucket of a table are compared by exact cosine in double precision.  ``bits``
grows with the logarithm of the number of vectors, so buckets keep to about
``BUCKET`` unrelated ones, and the number of tables follows from the recall that
pairs at the threshold need.  A table's rows carry the vector's own components,
in single precision where that is exact.
A bucket's vectors are dealt into blocks and each two blocks meet once, so one
bucket never has to fit one task, and no pair is left out.  A pair that meets in
several tables counts in the first.  Links become counts and components where
they are found: a group of blocks gives sums and a few edges, never all pairs.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite
components link with nothing, nor do those without label or of unlike length;
a row without vec_id links with nothing and has a null component and is kept;
rows of one vec_id are one vertex, each is returned, and their links are those of
all its vectors; ties go to the smallest vec_id; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.components import components
from ..sources.scratch import Scratch
from .shared import pick

THRESHOLD = 0.93
RECALL = 0.999
BLOCK = 256
#: Unrelated vectors that share a bucket: more of them need fewer tables.
BUCKET = 128
SEED = 4242


def plan(n: int, threshold: float = THRESHOLD, recall: float = RECALL) -> tuple[int, int]:
    """Bits and tables for n vectors."""
    bits = max(4, min(48, math.ceil(math.log2(max(2, n) / BUCKET))))
    together = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(1 - recall) / math.log(1 - together))


def directions(dim: int, bits: int, tables: int) -> np.ndarray:
    return np.random.default_rng([SEED, dim]).standard_normal((tables * bits, dim))


def _units(packed: list[bytes], dim: int) -> np.ndarray:
    """Packed vectors of one length as unit vectors in double precision."""
    m = np.stack([np.frombuffer(v, np.float32 if len(v) == 4 * dim else np.float64) for v in packed]).astype(np.float64)
    with np.errstate(over="ignore"):
        norm = np.linalg.norm(m, axis=1)
    odd = (norm < 1e-150) | (norm > 1e150)
    if odd.any():
        m[odd] /= np.abs(m[odd]).max(axis=1, keepdims=True)
        norm[odd] = np.linalg.norm(m[odd], axis=1)
    return m / norm[:, None]


def _packed(rows: DataFrame) -> DataFrame:
    """(vec_id, label, dim, packed): a vector's components, null where it can't link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(2)
            values = column.values.cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False)
            ends, out = column.offsets.to_numpy(), []
            for a, b, ok in zip(ends[:-1], ends[1:], column.is_valid().to_pylist()):
                v = values[a:b] + 0.0  # of the two zeros one
                if not ok or b == a or not np.isfinite(v).all() or not v.any():
                    out.append(None)
                    continue
                with np.errstate(over="ignore", under="ignore"):
                    single = v.astype(np.float32)
                out.append((single if (single == v).all() else v).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.diff(ends).astype(np.int32)), pa.array(out, pa.binary())], names=["vec_id", "label", "dim", "packed"])

    return rows.mapInArrow(run, "vec_id long, label string, dim int, packed binary")


def _codes(classes: DataFrame, bits: int, tables: int) -> DataFrame:
    """(id, label, dim, t, code): a row for each vector and table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                by_dim: dict[int, list[int]] = {}
                packed = part.column(3).to_pylist()
                for i, dim in enumerate(part.column(2).to_pylist()):
                    by_dim.setdefault(dim, []).append(i)
                for dim, rows in by_dim.items():
                    if dim not in planes:
                        planes[dim] = directions(dim, bits, tables)
                    m = _units([packed[i] for i in rows], dim)
                    signs = (m @ planes[dim].T > 0).reshape(len(rows), tables, bits)
                    codes = signs @ (np.int64(1) << np.arange(bits, dtype=np.int64))
                    n = len(rows)
                    pick_ = pa.array(np.repeat(rows, tables))
                    yield pa.RecordBatch.from_arrays(
                        [*(part.column(i).take(pick_) for i in range(3)), pa.array(np.tile(np.arange(tables, dtype=np.int32), n)), pa.array(codes.ravel())],
                        names=["id", "label", "dim", "t", "code"],
                    )

    return classes.select("id", "label", "dim", "packed").mapInArrow(run, "id long, label string, dim int, t int, code long")


def _met(groups: DataFrame, threshold: float, bits: int, tables: int) -> DataFrame:
    """(id, links, other): links found in each two blocks that meet, pre-summed.

    ``links`` counts the vec_ids that a vector links with in the group, copies
    included; ``other`` is the smallest linked id, enough to keep the group's
    components together with the edges of its spanning forest.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        for batch in batches:
            out: list[tuple] = []
            for row in batch.to_pylist():
                a, b = row["a"], row["b"] if row["b"] is not None else row["a"]
                same = row["b"] is None
                dim = row["dim"]
                if dim not in planes:
                    planes[dim] = directions(dim, bits, tables)
                x, y = (_units([r["packed"] for r in s], dim) for s in (a, b))
                i, j = np.array([r["id"] for r in a]), np.array([r["id"] for r in b])
                close = np.triu(x @ y.T >= threshold, 1) if same else x @ y.T >= threshold
                p, q = np.nonzero(close)
                if row["t"] and len(p):
                    # pairs that an earlier table has already brought together count there
                    before = row["t"] * bits
                    us, at_u = np.unique(p, return_inverse=True)
                    vs, at_v = np.unique(q, return_inverse=True)
                    pl = planes[dim][:before].T
                    cu = (x[us] @ pl > 0).reshape(len(us), -1, bits)
                    cv = (y[vs] @ pl > 0).reshape(len(vs), -1, bits)
                    new = np.empty(len(p), bool)
                    for k in range(0, len(p), 4096):
                        s = slice(k, k + 4096)
                        new[s] = ~(cu[at_u[s]] == cv[at_v[s]]).all(axis=2).any(axis=1)
                    p, q = p[new], q[new]
                if not len(p):
                    continue
                na, nb = np.array([r["copies"] for r in a]), np.array([r["copies"] for r in b])
                links: dict[int, int] = {}
                for ids, others, copies in ((i[p], q, nb), (j[q], p, na)):
                    for v, c in zip(ids.tolist(), copies[others].tolist()):
                        links[v] = links.get(v, 0) + c
                # a spanning forest of the group's links
                root: dict[int, int] = {}

                def top(v):
                    while root.setdefault(v, v) != v:
                        root[v] = v = root[root[v]]
                    return v

                for u, v in zip(i[p].tolist(), j[q].tolist()):
                    u, v = top(u), top(v)
                    if u != v:
                        root[max(u, v)] = min(u, v)
                out += [(v, n, top(v)) for v, n in links.items()]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=["id", "links", "other"])

    return groups.select("dim", "t", "a", "b").mapInArrow(run, "id long, links long, other long")


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of each row of (vec_id, embedding, label)."""
    scratch = Scratch(vectors.sparkSession, "nearvec")
    rows = pick(vectors, vec_id="long", label="string", embedding="array<double>")
    vecs = scratch.keep(_packed(rows))
    usable = vecs.where("packed is not null and label is not null and vec_id is not null")
    per_id = usable.select("vec_id", "label", "dim", "packed").distinct()
    # a class is one vector of one label; its copies are the ids that hold it
    vector = ["label", "dim", "packed"]
    classes = per_id.groupBy(*vector).agg(F.min("vec_id").alias("first"), F.count("*").alias("copies"))
    classes = scratch.keep(classes.withColumn("id", F.monotonically_increasing_id()), n=F.count(F.lit(1)))
    bits, tables = plan(classes.counts["n"], threshold, recall)
    codes = scratch.keep(_codes(classes, bits, tables))
    bucket = ["label", "dim", "t", "code"]
    sizes = codes.groupBy(*bucket).agg(F.count("*").alias("size")).where("size > 1")
    shared = codes.join(sizes, bucket).withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int"))
    shared = shared.withColumn("block", F.pmod(F.xxhash64("id", "t"), F.col("blocks")).cast("int"))
    item = F.struct("id", "copies", "packed")
    dealt = shared.join(classes.select("id", "packed", "copies"), "id").groupBy(*bucket, "block", "blocks").agg(F.collect_list(item).alias("a"))
    dealt = scratch.keep(dealt)
    kind = dealt.schema["a"].dataType
    within = dealt.select("dim", "t", "a", F.lit(None).cast(kind).alias("b"))
    sent = dealt.where("blocks > 1 and block > 0").select(*bucket, F.explode(F.sequence(F.lit(0), F.col("block") - 1)).alias("block"), F.col("a").alias("b"))
    across = dealt.where("blocks > 1").select(*bucket, "block", "a").join(sent, [*bucket, "block"]).select("dim", "t", "a", "b")
    met = scratch.keep(_met(within.unionByName(across), threshold, bits, tables))
    linked = met.groupBy("id").agg(F.sum("links").alias("links"))
    names = classes.select("id", "first")
    edges = met.select("id", "other").where("id <> other").distinct()
    edges = edges.join(names, "id").withColumnRenamed("first", "u").join(names.select(F.col("id").alias("other"), F.col("first").alias("v")), "other").select("u", "v")
    members = per_id.join(classes.select(*vector, F.col("id").alias("class"), "first", "copies"), vector).select("vec_id", "class", "first", "copies")
    members = scratch.keep(members)
    edges = edges.unionByName(members.where("vec_id <> first").select(F.col("vec_id").alias("u"), F.col("first").alias("v")))
    labels = components(edges, scratch)
    counts = members.join(linked, F.col("class") == F.col("id"), "left").groupBy("vec_id").agg(F.sum(F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    counts = scratch.keep(counts)
    scratch.release(vecs, counts, labels)
    out = vecs.select("vec_id").join(counts, "vec_id", "left").join(labels, F.col("vec_id") == F.col("vertex"), "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def op2_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
