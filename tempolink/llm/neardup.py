"""MinHash near-dedup: a chosen-path set similarity join over word shingles.

Every text becomes its set of five-word shingles and ``WIDTH`` minwise tokens.
Equal sets are one from here on.  A forest of ``TREES`` independent trees
branches the sets by selected tokens: sets that agree on a node's tokens meet in
that node.  First-level nodes of up to ``LEAF`` sets are compared exhaustively;
in a larger one every set meets the closest of a few pivots, which joins up a
large family of copies by few pairs.  From here on only nodes that hold sets of
several components count.  Those of more than ``NODE`` sets branch on, level by
level, and all others are compared exhaustively: sizes and token bytes first,
then full sets, two sets of one component never.  A node with many more candidate
pairs than sets is compared in blocks that hold the full sets and give a
spanning forest, so no group's pairs are ever listed.  The links'
connected components give the classes.

A pair at the threshold is missed by the first level with probability
(1 - 0.75)^24 = 4e-15.  Deeper levels keep a pair at the threshold alive with
3/2 children of 0.75 each, so that of the 24 nodes each holds a chance of 0.33 at
any depth: 6e-5 of such pairs are missed.  The byte test passes over 1.4 in 10,000
pairs right at the threshold; such a pair is found only through links of others.

Defined cases: a null or empty text, or one without words, has no shingles and
links with nothing; rows of one doc_id are one vertex, and each row is returned
with its own set's size; a row without doc_id is returned with a null component
and kept; ties go to the smallest doc_id; an empty table gives no rows; texts of
any length are whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.components import components
from ..sources.scratch import Scratch
from .shared import mix, pick, shingle_sets, text_slices

WIDTH = 128
TREES = 12
BRANCHES = 2
LEAF = 16
PIVOTS = 8
BLOCK = 64
#: Sets that one node may compare exhaustively; a larger one branches on, at most so deep.
NODE = 2048
DEEPEST = 12
#: Candidate pairs a set beyond which a node is compared in blocks of so many bytes of full sets.
DENSE = 16
BLOCK_BYTES = 2_000_000
#: Of 128 token bytes that must agree: 3.7 standard errors below 0.75.
AGREE = 78

_rng = np.random.default_rng(77)
_MUL = _rng.integers(1, 2**63, WIDTH, dtype=np.uint64) | np.uint64(1)
_ADD = _rng.integers(1, 2**63, WIDTH, dtype=np.uint64)


def _binary(matrix: np.ndarray) -> pa.Array:
    """Rows of a matrix as binary values."""
    rows, width = matrix.shape[0], matrix.dtype.itemsize * matrix.shape[1]
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(width), rows, [None, pa.py_buffer(np.ascontiguousarray(matrix).tobytes())]).cast(pa.binary())


def _matrix(column: pa.Array, dtype) -> np.ndarray:
    """Binary values of one length as rows of a matrix."""
    n = len(column)
    _, offs, data = column.buffers()
    offs = np.frombuffer(offs, dtype=np.int32)[column.offset : column.offset + n + 1]
    return np.frombuffer(data, dtype=np.uint8)[offs[0] : offs[-1]].view(dtype).reshape(n, -1)


def _hashes(values: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each set, whose sorted values lie between the ends; 0 for an empty one."""
    full = np.diff(ends) > 0
    hi, lo = np.zeros(len(full), np.uint64), np.zeros(len(full), np.uint64)
    if full.any():
        at = ends[:-1][full]
        hi[full] = np.add.reduceat(mix(values), at)
        lo[full] = np.add.reduceat(mix(values ^ np.uint64(0xA5A5A5A5A5A5A5A5)), at)
    return hi, lo


def sketch(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, hi, lo, tokens): set size, set hash, minwise tokens.

    ``tokens`` is 128 unsigned 32-bit integers, null for an empty set.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, his, los, tokens = [], [], [], []
            for _, data, offs in text_slices(batch.column(1)):
                values, ends = shingle_sets(data, offs)
                n = np.diff(ends)
                sizes.append(n)
                full = n > 0
                hi = lo = np.zeros(len(n), np.uint64)
                found = np.zeros((len(n), WIDTH), np.uint32)
                if full.any():
                    at = ends[:-1][full]
                    hi, lo = _hashes(values, ends)
                    room = np.empty_like(values)
                    least = np.empty((WIDTH, len(at)), np.uint64)
                    for j in range(WIDTH):
                        np.multiply(values, _MUL[j], out=room)
                        np.add(room, _ADD[j], out=room)
                        least[j] = np.minimum.reduceat(room, at)
                    found[full] = (mix(least.T) >> np.uint64(32)).astype(np.uint32)
                his.append(hi)
                los.append(lo)
                tokens.append(found)
            if sizes:
                n = np.concatenate(sizes)
                columns = [batch.column(0), pa.array(n), pa.array(np.concatenate(his).view(np.int64)), pa.array(np.concatenate(los).view(np.int64)), _binary(np.concatenate(tokens))]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_shingles", "hi", "lo", "tokens"])

    return pick(docs, doc_id="long", text="string").mapInArrow(run, "doc_id long, n_shingles long, hi long, lo long, tokens binary")


def _roots(sets: DataFrame) -> DataFrame:
    """(node, id): the first level of all trees, each with tokens of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = TREES * BRANCHES
        place = np.arange(k, dtype=np.uint64) << np.uint64(32)
        for batch in batches:
            if batch.num_rows:
                ids, tokens = batch.column(0).to_numpy(zero_copy_only=False), _matrix(batch.column(1), np.uint32)
                nodes = mix(tokens[:, :k].astype(np.uint64) + place + np.uint64(1 << 40))
                yield pa.RecordBatch.from_arrays([pa.array(nodes.ravel().view(np.int64)), pa.array(np.repeat(ids, k))], names=["node", "id"])

    return sets.select("id", "tokens").mapInArrow(run, "node long, id long")


def _children(rows: DataFrame) -> DataFrame:
    """(node, id, label) one level down, from (node, id, label, tokens).

    A node's hash selects one token place or two, 3/2 children for each set: of a
    pair at the threshold more than one survives on average.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            nodes = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            ids, labels, tokens = batch.column(1).to_numpy(zero_copy_only=False), batch.column(2).to_numpy(zero_copy_only=False), _matrix(batch.column(3), np.uint32)
            h = mix(nodes ^ np.uint64(0x5851F42D4C957F2D))
            each = np.arange(len(ids))
            for places, rows_ in ((h % np.uint64(WIDTH), each), ((h >> np.uint64(20)) % np.uint64(WIDTH), np.flatnonzero((h >> np.uint64(40)) % np.uint64(2) == 0))):
                p = places[rows_].astype(np.int64)
                child = mix(nodes[rows_] * np.uint64(0x2545F4914F6CDD1D) + (p.astype(np.uint64) << np.uint64(32)) + tokens[rows_, p])
                yield pa.RecordBatch.from_arrays([pa.array(child.view(np.int64)), pa.array(ids[rows_]), pa.array(labels[rows_])], names=["node", "id", "label"])

    return rows.select("node", "id", "label", "tokens").mapInArrow(run, "node long, id long, label long")


_SET = "struct<id: long, n: long, label: long, brief: binary>"


def _compared(groups: DataFrame) -> DataFrame:
    """(a, b), a < b: pairs of different labels that sizes and token bytes let pass.

    A group has ``own`` sets and ``others``, both lists of (id, n, label, brief).
    Without others its own are compared with each other, else every one meets
    that of the others which it agrees with most.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def unpack(column):
            flat = column.values
            fields = [flat.field(k).to_numpy(zero_copy_only=False) for k in ("id", "n", "label")]
            return column.offsets.to_numpy(), *fields, _matrix(flat.field("brief"), np.uint8) if len(flat) else None

        for batch in batches:
            found_a, found_b = [], []
            oe, oid, on, ol, ob = unpack(batch.column(0))
            xe, xid, xn, xl, xb = unpack(batch.column(1))
            for g in range(batch.num_rows):
                i = slice(oe[g], oe[g + 1])
                within = xe[g + 1] == xe[g]
                ids, n, label, brief = oid[i], on[i], ol[i], ob[i]
                j = slice(xe[g], xe[g + 1])
                jd, jn, jl, jb = (ids, n, label, brief) if within else (xid[j], xn[j], xl[j], xb[j])
                # sizes first: a similarity of 0.75 needs sizes within it
                ok = (label[:, None] != jl) & (100 * np.minimum(n[:, None], jn) >= 75 * np.maximum(n[:, None], jn))
                if within:
                    ok &= ids[:, None] < jd
                p, q = np.nonzero(ok)
                if not len(p):
                    continue
                agree = (brief[p] == jb[q]).sum(axis=1)
                ok = agree >= AGREE
                if not within:
                    order = np.lexsort((jd[q], -agree, p))
                    first = np.zeros(len(p), dtype=bool)
                    first[order[np.append(True, p[order][1:] != p[order][:-1])]] = True
                    ok &= first
                found_a.append(ids[p[ok]])
                found_b.append(jd[q[ok]])
            if found_a:
                a, b = np.concatenate(found_a), np.concatenate(found_b)
                pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    return groups.select("own", "others").mapInArrow(run, "a long, b long").distinct()


#: Pairs up to which the list of wanted documents is sent to every task (16 MB of ids).
SEND = 500_000


def _similar(x: bytes, y: bytes) -> bool:
    x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
    shared = len(np.intersect1d(x, y, assume_unique=True))
    return shared > 0 and 100 * shared >= 75 * (len(x) + len(y) - shared)


def _full(wanted: DataFrame, few: bool, sets: DataFrame, docs: DataFrame) -> DataFrame:
    """(id, full): whole shingle sets of the wanted ids, read from the texts.

    Only a list of bounded size is sent to all tasks.  Of rows that share a
    doc_id, those count whose set it is.
    """
    named = sets.select("id", "first", "hi", "lo").join(wanted, "id")
    texts = pick(docs, doc_id="long", text="string")
    texts = texts.join(F.broadcast(named) if few else named, F.col("doc_id") == F.col("first")).select("id", "hi", "lo", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            his, los = (batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 2))
            for row, data, offs in text_slices(batch.column(3)):
                values, ends = shingle_sets(data, offs)
                n = len(ends) - 1
                hi, lo = _hashes(values, ends)
                own = (hi.view(np.int64) == his[row : row + n]) & (lo.view(np.int64) == los[row : row + n])
                full = [values[a:b].tobytes() if ok else None for a, b, ok in zip(ends[:-1], ends[1:], own)]
                out = pa.RecordBatch.from_arrays([batch.column(0).slice(row, n), pa.array(full, pa.binary())], names=["id", "full"])
                yield out.filter(pa.array(own))

    return texts.mapInArrow(run, "id long, full binary")


def confirm(pairs: DataFrame, sets: DataFrame, docs: DataFrame, scratch: Scratch) -> DataFrame:
    """Those of the kept pairs (a, b) whose full shingle sets have a similarity of 0.75 or more."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    full = scratch.keep(_full(wanted, pairs.counts["n"] <= SEND, sets, docs))
    both = pairs.join(full.select(F.col("id").alias("b"), F.col("full").alias("fb")), "b").join(full.select(F.col("id").alias("a"), F.col("full").alias("fa")), "a")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [_similar(x.as_buffer(), y.as_buffer()) for x, y in zip(batch.column(2), batch.column(3))]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    links = scratch.keep(both.select("a", "b", "fa", "fb").mapInArrow(run, "a long, b long").distinct())
    scratch.drop(full)
    return links


def _mixed(rows: DataFrame) -> DataFrame:
    """(node, id, size, label) of the nodes among rows (node, id, label) that hold more than one label."""
    nodes = rows.groupBy("node").agg(F.count(F.lit(1)).alias("size"), F.min("label").alias("x"), F.max("label").alias("y"))
    return rows.join(nodes.where("x <> y").select("node", "size"), "node").select("node", "id", "size", "label")


def _candidates(n: np.ndarray, label: np.ndarray, brief: np.ndarray, split: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(x, y): places of sets of different labels that sizes and token bytes let pass, by x.

    All x < y, or with ``split`` those before it against those from it on.
    """
    place, low = np.arange(len(n)), 0 if split is None else split
    for i in range(0, len(n) if split is None else split, 32):
        s = slice(i, i + 32 if split is None else min(i + 32, split))
        p, q = np.nonzero((label[s, None] != label[low:]) & (place[s, None] < place[low:]) & (100 * np.minimum(n[s, None], n[low:]) >= 75 * np.maximum(n[s, None], n[low:])))
        for k in range(0, len(p), 1 << 14):
            x, y = p[k : k + (1 << 14)] + i, q[k : k + (1 << 14)] + low
            ok = (brief[x] == brief[y]).sum(axis=1) >= AGREE
            yield x[ok], y[ok]


def _screened(groups: DataFrame) -> DataFrame:
    """(node, a, b): candidate pairs a < b of a node's ``own`` sets, of different labels.

    A node with more than ``DENSE`` pairs a set gives the sets concerned
    instead, b being null.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                flat = batch.column(1)[at].values
                ids, n, label = (flat.field(k).to_numpy(zero_copy_only=False) for k in ("id", "n", "label"))
                pairs, n_found, seen = [], 0, np.zeros(len(ids), bool)
                for x, y in _candidates(n, label, _matrix(flat.field("brief"), np.uint8)):
                    n_found += len(x)
                    seen[x] = seen[y] = True
                    if n_found <= DENSE * len(ids):
                        pairs.append((x, y))
                if not n_found:
                    continue
                if n_found <= DENSE * seen.sum():
                    x, y = (ids[np.concatenate(c)] for c in zip(*pairs))
                    a, b = pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))
                else:
                    a = pa.array(ids[seen])
                    b = pa.nulls(len(a), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(a), batch.column(0)[at].as_py())), a, b], names=["node", "a", "b"])

    return groups.select("node", "own").mapInArrow(run, "node long, a long, b long")


def _blocks(of: DataFrame, size: Column, item: Column) -> DataFrame:
    """(own, others): every block of each node alone, and every two blocks of it."""
    blocks = of.groupBy("node").agg(F.ceil(size).cast("int").alias("blocks"))
    dealt = of.join(blocks, "node").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    own = dealt.groupBy("node", "block").agg(F.collect_list(item).alias("own"))
    sent = own.where("block > 0").select("node", F.explode(F.sequence(F.lit(0), F.col("block") - 1)).alias("block"), F.col("own").alias("others"))
    none = F.array().cast(own.schema["own"].dataType)
    return own.select("own", none.alias("others")).unionByName(own.join(sent, ["node", "block"]).select("own", "others"))


def _joined(groups: DataFrame) -> DataFrame:
    """(a, b): a spanning forest of each group's links between sets of different labels, found on the full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                own, others = (c[at].as_py() for c in batch.columns)
                everyone = own + others
                brief = np.frombuffer(b"".join(r["brief"] for r in everyone), np.uint8).reshape(len(everyone), -1)
                ids, label, size = (np.array([r[k] for r in everyone], dtype=np.int64) for k in ("id", "label", "n"))
                values, flat = np.unique(np.frombuffer(b"".join(r["full"] for r in everyone), np.uint64), return_inverse=True)
                sets = np.split(flat, np.cumsum(size)[:-1])
                marked = np.zeros(len(values), np.int32)
                root, a, b = label.copy(), [], []
                for p, q in _candidates(size, label, brief, len(own) if others else None):
                    for i, k in zip(*np.unique(p, return_index=True)):
                        j = q[k : np.searchsorted(p, i, "right")]
                        j = j[root[j] != root[i]]
                        if not len(j):
                            continue
                        marked[sets[i]] = 1
                        shared = np.add.reduceat(marked[np.concatenate([sets[m] for m in j])], np.cumsum(size[j]) - size[j])
                        marked[sets[i]] = 0
                        for m in j[100 * shared >= 75 * (size[i] + size[j] - shared)]:
                            if root[m] != root[i]:
                                root[root == root[m]] = root[i]
                                a.append(min(ids[i], ids[m]))
                                b.append(max(ids[i], ids[m]))
                if a:
                    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return groups.select("own", "others").mapInArrow(run, "a long, b long").distinct()


def link(sets: DataFrame, docs: DataFrame, scratch: Scratch) -> list[DataFrame]:
    """Tables of confirmed links (a, b) between the ids of different sets.

    ``sets``: kept rows (id, first, hi, lo, n, tokens).  The links join up all
    sets that any chain of similar sets joins; sets that are joined already
    aren't compared.
    """
    n = F.count(F.lit(1))
    brief = sets.select("id", "n", _brief(F.col("tokens")).alias("brief"))
    item = F.struct("id", "n", "label", "brief")
    none = F.array().cast(f"array<{_SET}>")

    # the first level: small nodes whole, large ones against pivots
    nodes = _roots(sets)
    rows = scratch.keep(nodes.join(nodes.groupBy("node").agg(n.alias("size")).where("size > 1"), "node").select("node", "id", "size"), n=n)
    if not rows.counts["n"]:
        return []
    blocks = F.when(F.col("size") <= LEAF, F.lit(1)).otherwise(F.ceil(F.col("size") / BLOCK)).cast("int")
    full = rows.withColumn("label", F.col("id")).withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("id", "node"), F.col("blocks")).cast("int")).join(brief, "id")
    own = full.groupBy("node", "block").agg(F.collect_list(item).alias("own"))
    # pivots are chosen alike in all nodes, so that pairs of nodes that share sets coincide
    pivots = [F.min(F.struct(F.xxhash64("id", F.lit(i)).alias("h"), "id"))["id"] for i in range(PIVOTS)]
    chosen = rows.where(F.col("size") > LEAF).groupBy("node").agg(F.array(*pivots).alias("p")).select("node", F.explode(F.array_distinct("p")).alias("id"))
    chosen = chosen.withColumn("label", F.col("id")).join(brief, "id").groupBy("node").agg(F.collect_list(item).alias("others"))
    met = scratch.keep(_compared(own.join(chosen, "node", "left").select("own", F.coalesce("others", none).alias("others"))), n=n)
    links = [confirm(met, sets, docs, scratch)]

    # what large nodes still hold apart branches until nodes are small
    labels = components(_edges(links), scratch)
    held = rows.where(F.col("size") > LEAF).join(labels, F.col("id") == F.col("vertex"), "left").select("node", "id", F.coalesce("component", "id").alias("label"))
    held = _mixed(held)
    small, depth = [], 0
    counts = {"n": n, "large": F.count_if(F.col("size") > NODE)}
    while True:
        held = scratch.keep(held, **counts)
        if held.counts["n"]:
            small.append(held.where(F.col("size") <= NODE))
        if not held.counts["large"] or depth == DEEPEST:
            break
        depth += 1
        large = held.where(F.col("size") > NODE).select("node", "id", "label")
        held = _mixed(_children(large.join(sets.select("id", "tokens"), "id")))
    whole = [held.where(F.col("size") > NODE).select("node", "id")] if held.counts["large"] else []
    if small:
        groups = _united(small).join(brief, "id").groupBy("node").agg(F.collect_list(item).alias("own"))
        found = scratch.keep(_screened(groups), n=n, dense=F.count_if(F.col("b").isNull()))
        if found.counts["n"] > found.counts["dense"]:
            pairs = found.where("b is not null").select("a", "b").distinct().join(met.select("a", "b"), ["a", "b"], "left_anti")
            links.append(confirm(scratch.keep(pairs, n=n), sets, docs, scratch))
        if found.counts["dense"]:
            whole.append(found.where("b is null").select("node", F.col("a").alias("id")))
    if whole:
        of = _united(whole).join(labels, F.col("id") == F.col("vertex"), "left").select("node", "id", F.coalesce("component", "id").alias("label"))
        of = scratch.keep(of, n=n)
        full = scratch.keep(_full(of.select("id").distinct(), of.counts["n"] <= SEND, sets, docs).dropDuplicates(["id"]))
        links.append(scratch.keep(_joined(_blocks(of.join(brief, "id").join(full, "id"), F.sum("n") * 8 / BLOCK_BYTES, F.struct("id", "n", "label", "brief", "full")))))
    return links


def _united(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for more in frames[1:]:
        out = out.unionByName(more)
    return out


def _brief(tokens: Column) -> Column:
    """The low byte of each token."""
    return F.unhex(F.regexp_replace(F.hex(tokens), "(..)......", "$1"))


def _edges(links: list[DataFrame]) -> DataFrame:
    return _united(links).select(F.col("a").alias("u"), F.col("b").alias("v"))


def _classes(docs: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """The kept sketches, and the labels (vertex, component) of doc_ids that link with others."""
    sketches = scratch.keep(sketch(docs))
    full = sketches.where("n_shingles > 0 and doc_id is not null")
    sets = full.groupBy("hi", "lo", F.col("n_shingles").alias("n")).agg(F.min("doc_id").alias("first"), F.first("tokens").alias("tokens"))
    sets = scratch.keep(sets.withColumn("id", F.monotonically_increasing_id()))
    links = link(sets, docs, scratch)
    copies = full.select("doc_id", "hi", "lo", "n_shingles").join(sets.select("hi", "lo", F.col("n").alias("n_shingles"), "first"), ["hi", "lo", "n_shingles"])
    edges = copies.where("doc_id <> first").select(F.col("doc_id").alias("u"), F.col("first").alias("v"))
    if links:
        name = lambda c: sets.select(F.col("id").alias(c), F.col("first").alias(f"doc_{c}"))
        named = _united(links).join(name("a"), "a").join(name("b"), "b")
        edges = edges.unionByName(named.select(F.col("doc_a").alias("u"), F.col("doc_b").alias("v")))
    labels = components(edges, scratch)
    scratch.release(sketches, labels)
    return sketches, labels


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of each row of (doc_id, text)."""
    sketches, labels = _classes(docs, Scratch(docs.sparkSession, "neardup"))
    out = sketches.select("doc_id", "n_shingles").join(labels, F.col("doc_id") == F.col("vertex"), "left")
    out = out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def drop_copies(docs: DataFrame) -> DataFrame:
    """The rows, all columns, that stay: one of each group of near duplicates.

    Rows without doc_id all stay, as do documents without words.  Rows that share
    a doc_id are one document: the one of the smallest text hash stays, if any.
    """
    scratch = Scratch(docs.sparkSession, "dropcopies")
    found = scratch.keep(near_duplicates(docs).select("doc_id", "kept"))
    ids = found.where("doc_id is not null").groupBy("doc_id").agg(F.count_if("kept").alias("rows"))
    ids = scratch.keep(ids.where("rows <> 1").select(F.col("doc_id").alias("id"), "rows"), n=F.count(F.lit(1)), again=F.count_if(F.col("rows") > 1))
    out = docs.join(F.broadcast(ids) if ids.counts["n"] <= 2 * SEND else ids, docs["doc_id"].cast("long") == ids["id"], "left_anti")
    if not ids.counts["again"]:
        return out
    again = ids.where("rows > 1")
    rows = docs.join(again, docs["doc_id"].cast("long") == again["id"], "left_semi")
    order = Window.partitionBy(F.col("_row.doc_id").cast("long")).orderBy(F.xxhash64("_row.text"), F.to_json("_row"))
    first = rows.select(F.struct(*docs.columns).alias("_row")).withColumn("_at", F.row_number().over(order)).where("_at = 1")
    return out.unionByName(first.select("_row.*"))


def op1_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
