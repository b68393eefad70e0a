"""Whitening of embeddings by a bidiagonal qd solver.

Components become whole numbers, so their sums are exact.  Every task centres
its rows and reduces them, a block at a time, to one triangle by QR; triangles
are stacked and reduced again, a bounded number at a time, until one is left,
whose singular values are the centred rows'.  Householder reflections from both
sides turn it into a bidiagonal matrix B.  The differential qd algorithm with
shifts (dqds) finds the squares of B's singular values to high relative
accuracy; each of the largest ones gives its vector by the twisted factorisation
of B'B less that square, joined from above and below where the last pivot is
least.  Vectors of values closer than a thousandth are made orthogonal.
Reflected back, they are the covariance's unit eigenvectors; divided by the root
of their eigenvalue they whiten.

No covariance is ever formed, so small variances aren't lost to squaring.  What a
task holds is one block and one triangle; the driver gets one triangle.

Defined cases: vectors that are null, empty, or hold null, NaN, infinite or
larger components than ``LARGEST`` are left out, as are those whose length isn't
the most frequent one (of ties the longest); repeated rows and ids count each;
null ids stay null; an empty table gives no rows.  A component whose standard
deviation is nil to rounding (fewer vectors than components, dependent or
constant dimensions) is whitened to null and explains 0.  A deviation beyond 64
bits is null.  Other columns go no further.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import Scratch
from .shared import small_batches

SCALE, SHIFT = 1024, 100_000
#: Components of vectors are below this, so that sums of a batch fit in 64 bits.
LARGEST = 2.0**38
#: Values of a block of rows, and bytes of triangles that one task joins at a time.
BLOCK = 1 << 18
JOINED = 32 << 20
EPS = float(np.finfo(np.float64).eps)
TINY = 1e-290

# --- one triangle -------------------------------------------------------------


def _reflector(x: np.ndarray) -> tuple[np.ndarray, float]:
    """(v, beta): I - beta v v' turns ``x`` into a multiple of the first axis."""
    v = x.copy()
    rest = float(v[1:] @ v[1:])
    if rest == 0.0:
        return v, 0.0
    head = float(v[0])
    v[0] = head + np.copysign(np.sqrt(head * head + rest), head)
    return v, 2.0 / (float(v[0]) ** 2 + rest)


def bidiagonal(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(diagonal, upper diagonal, Q) of a square matrix: it is U B Q' with orthogonal U and Q."""
    m, n = np.array(r, dtype=np.float64), len(r)
    q = np.eye(n)
    for k in range(n):
        v, beta = _reflector(m[k:, k])
        m[k:, k:] -= beta * np.outer(v, v @ m[k:, k:])
        if k + 2 < n:
            v, beta = _reflector(m[k, k + 1 :])
            m[k:, k + 1 :] -= beta * np.outer(m[k:, k + 1 :] @ v, v)
            q[:, k + 1 :] -= beta * np.outer(q[:, k + 1 :] @ v, v)
    return np.diagonal(m).copy(), np.diagonal(m, 1).copy(), q


def _pair(q0: float, e: float, q1: float) -> tuple[float, float]:
    """Larger and smaller eigenvalue of the last two rows of a qd array."""
    total = q0 + q1 + e
    if total == 0.0:
        return 0.0, 0.0
    half = total / 2
    root = np.sqrt(max(0.0, half * half - q0 * q1))
    big = half + root
    return float(big), float(q0 * (q1 / big))


def _step(q: list[float], e: list[float], shift: float) -> tuple[list[float], list[float], float] | None:
    """One dqds transform and its least d; None if the shift was too large."""
    d, qs, es = q[0] - shift, [], []
    least = d
    if d < 0:
        return None
    for k in range(len(e)):
        new = d + e[k]
        ratio = q[k + 1] / new if new > 0 else 0.0
        qs.append(new)
        es.append(e[k] * ratio)
        d = (d * ratio if new > 0 else q[k + 1]) - shift
        if d < 0:
            return None
        least = min(least, d)
    return [*qs, d], es, least


def dqds(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squares of the singular values of the upper bidiagonal (a, b), falling."""
    found: list[float] = []
    waiting = [([float(x) ** 2 for x in a], [float(x) ** 2 for x in b], 0.0)] if len(a) else []
    near = (8 * EPS) ** 2
    while waiting:
        q, e, at = waiting.pop()
        shift, tries = 0.0, 0
        while True:
            n = len(q)
            if n == 1:
                found.append(at + q[0])
                break
            if n == 2:
                found.extend(at + x for x in _pair(q[0], e[0], q[1]))
                break
            cut = next((k for k in range(n - 2, -1, -1) if e[k] <= near * (at + min(q[k], q[k + 1])) or e[k] < TINY), None)
            if cut is not None:  # two parts without influence on each other
                waiting.append((q[: cut + 1], e[:cut], at))
                q, e, shift = q[cut + 1 :], e[cut + 1 :], 0.0
                continue
            if q[0] < q[-1]:  # the small ones belong to the end
                q, e = q[::-1], e[::-1]
            done = _step(q, e, shift)
            if done is None:  # the shift passed the least value: a smaller one
                tries += 1
                shift = shift / 4 if tries < 4 else 0.0
                continue
            at += shift
            q, e, least = done
            tries = 0
            # a value that the least one is likely to be above: of the last two rows, less what couples them to the others
            low = _pair(q[-2], e[-1], q[-1])[1]
            shift = max(0.0, min(low, least) * (1 - 1e-3) if e[-1] > 1e-8 * (q[-1] + TINY) else min(low, least) * (1 - 8 * EPS * n))
    return np.sort(np.maximum(found, 0.0))[::-1]


class Twisted:
    """The twisted factorisations of B'B less one eigenvalue: all joints in one pass down and one up."""

    def __init__(self, a: np.ndarray, b: np.ndarray, value: float):
        n = len(a)
        least = max(TINY, EPS * EPS * float(np.abs(a).max()))
        self.n = n
        s, p, down, up = np.empty(n), np.empty(n), np.zeros(n), np.zeros(n)
        s[0] = -value
        for i in range(n - 1):
            ai = a[i] if abs(a[i]) > least else least
            d = s[i] + ai * ai
            down[i] = ai * b[i] / (d if d else least)
            s[i + 1] = down[i] * (b[i] / ai) * s[i] - value
        p[n - 1] = a[n - 1] ** 2 - value
        for i in range(n - 2, -1, -1):
            ai = a[i] if abs(a[i]) > least else least
            d = b[i] ** 2 + p[i + 1]
            ratio = ai * ai / (d if d else least)
            up[i] = (b[i] / ai) * ratio
            p[i] = p[i + 1] * ratio - value
        self.down, self.up = down, up
        self.gamma = np.abs(s + p + value)

    def vector(self, k: int) -> tuple[np.ndarray, float]:
        """The unit vector joined at ``k``, and its residual."""
        z = np.zeros(self.n)
        z[k] = 1.0
        for i in range(k - 1, -1, -1):
            z[i] = -self.down[i] * z[i + 1]
        for i in range(k, self.n - 1):
            z[i + 1] = -self.up[i] * z[i]
        size = np.abs(z).max()
        if not np.isfinite(size):
            return np.eye(self.n)[k], np.inf
        norm = size * float(np.sqrt(((z / size) ** 2).sum()))
        return z / norm, float(self.gamma[k]) / norm


def vectors(a: np.ndarray, b: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Unit eigenvectors of B'B, a column each, for its largest eigenvalues in falling order."""
    out, first = np.zeros((len(a), len(values))), 0
    for j, value in enumerate(values):
        if j and values[j - 1] - value > 1e-3 * values[j - 1]:
            first = j
        twisted, near = Twisted(a, b, float(value)), out[:, first:j]
        order = np.argsort(twisted.gamma, kind="stable")
        tried = [twisted.vector(int(k)) for k in (order if j > first else order[:3])]
        good = max(10 * min(r for _, r in tried), 100 * EPS * float(values[0]))
        best, most = None, -1.0
        for z, residual in tried:
            if residual <= good:
                for _ in range(2 if j > first else 0):
                    z = z - near @ (near.T @ z)
                size = float(np.sqrt(z @ z))
                if size > most + 1e-3:
                    best, most = z, size
        for _ in range(2):
            best = best / np.sqrt(best @ best)
            best = best - out[:, :j] @ (out[:, :j].T @ best)
        out[:, j] = best / np.sqrt(best @ best)
    return out


def solve(r: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(values, directions) of a triangle: all squared singular values falling, and unit right vectors of the first ``most``."""
    size = float(np.abs(r).max()) if r.size else 0.0
    if size == 0.0:
        return np.zeros(len(r)), np.eye(len(r))[:, :most]
    a, b, q = bidiagonal(r / size)
    values = dqds(a, b)
    directions = q @ vectors(a, b, values[:most])
    return values * size * size, directions


# --- rows in tasks ------------------------------------------------------------


@dataclass(frozen=True)
class Centre:
    """The fit list's size and whole sums; means are ``whole + rest / n``."""

    n: int
    whole: np.ndarray
    rest: np.ndarray

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.whole).astype(np.float64) - self.rest / float(self.n)

    def deviation(self, x: np.ndarray) -> list[int | None]:
        d = x - self.whole
        largest = (int(np.abs(d).max(initial=0)) + 1) * self.n
        if largest * largest * x.shape[1] < 2**63:
            v = d * self.n - self.rest
            return (v * v).sum(axis=1).tolist()
        v = d.astype(object) * self.n - self.rest.astype(object)
        return [t if t < 2**63 else None for t in (v * v).sum(axis=1)]


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, x): the rows that can be fitted, components as whole numbers."""
    small_batches(vectors.sparkSession)
    e = F.col("embedding").cast("array<double>")
    good = F.coalesce((F.size(e) > 0) & F.forall(e, lambda c: F.coalesce(F.abs(c) < LARGEST, F.lit(False))), F.lit(False))
    x = F.transform(e, lambda c: F.floor(c * SCALE).cast("long") + SHIFT)
    # under the condition, so that no filter on the whole numbers is tried on other rows
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.when(good, x).alias("x")).where("x IS NOT NULL")


def _folded(scratch: Scratch, parts: DataFrame, merge: Callable[[np.ndarray], np.ndarray], width: int) -> np.ndarray | None:
    """All tasks' parts (rows of ``width`` numbers) merged into one, a bounded number in a task at a time."""
    most = int(max(2, min(64, JOINED // (8 * width))))

    def joined(table: pa.Table) -> pa.Table:
        rows = table.sort_by("part").column("packed").combine_chunks()
        out = merge(_matrix(rows, width)).reshape(-1)
        return pa.table({"part": pa.array([table.column("part")[0].as_py() // most], pa.int64()), "packed": pa.array([out], pa.list_(pa.float64()))})

    count = {"n": F.count(F.lit(1))}
    parts = scratch.keep(parts, **count)
    while parts.counts["n"] > 1:
        # parts are numbered from 0 without gaps by their order, so each round has a ``most``-th of them
        ranked = parts.select("part", "packed")
        parts = scratch.keep(ranked.groupBy(F.floor(F.col("part") / most).alias("g")).applyInArrow(joined, "part long, packed array<double>"), **count)
    row = parts.head()
    return None if row is None else np.asarray(row["packed"])


def _each_task(x: DataFrame, dims: int, add: Callable, start: Callable, width: int) -> DataFrame:
    """(part, packed): every task's rows, added to its part a block at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, rows, held = start(), [], 0
        for batch in batches:
            m = _matrix(batch.column(0), dims)
            for at in range(0, len(m), max(1, BLOCK // dims)):
                rows.append(m[at : at + max(1, BLOCK // dims)])
                held += rows[-1].size
                if held >= BLOCK:
                    state, rows, held = add(state, np.concatenate(rows)), [], 0
        if rows:
            state = add(state, np.concatenate(rows))
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([state.reshape(-1)], pa.list_(pa.float64()))], names=["part", "packed"])

    return x.select("x").mapInArrow(run, "part long, packed array<double>")


def _triangle(rows: np.ndarray) -> np.ndarray:
    """The triangle of so many rows, filled up with rows of zeros."""
    r = np.linalg.qr(rows, mode="r")
    return r if len(r) == r.shape[1] else np.vstack([r, np.zeros((r.shape[1] - len(r), r.shape[1]))])


def _joined_moments(parts: np.ndarray, k: int) -> np.ndarray:
    """(n, means, centred products) of several lists together."""
    n, mean, products = 0.0, np.zeros(k), np.zeros((k, k))
    for p in parts:
        m, far = p[0], p[1 : k + 1] - mean
        total = n + m
        products = products + p[k + 1 :].reshape(k, k) + np.outer(far, far) * (n * m / total)
        mean, n = mean + far * (m / total), total
    return np.concatenate([[n], mean, products.reshape(-1)])


@dataclass(frozen=True)
class Whitening:
    """A fitted transform: ``(x - mean) @ scaled`` has unit covariance in the components ``sound``."""

    centre: Centre
    directions: np.ndarray
    values: np.ndarray
    explained: np.ndarray
    scaled: np.ndarray
    sound: np.ndarray


def fit(x: DataFrame, components: int = 8, scratch: Scratch | None = None) -> Whitening | None:
    """The transform of all rows of ``usable``; None if there are none."""
    scratch = scratch or Scratch(x.sparkSession, "whitening")
    sizes = x.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).head()
    if sizes is None:
        return None
    dims, n = sizes["d"], sizes["n"]
    x = x.where(F.size("x") == dims)
    sums = x.select(F.posexplode("x").alias("at", "v")).groupBy("at").agg(F.sum(F.col("v").cast("decimal(20,0)")).alias("s")).orderBy("at").collect()
    both = [divmod(int(r["s"]), n) for r in sums]
    centre = Centre(n, np.array([a for a, _ in both], dtype=np.int64), np.array([b for _, b in both], dtype=np.int64))

    def add(r: np.ndarray | None, rows: np.ndarray) -> np.ndarray:
        rows = centre.centred(rows)
        return _triangle(rows if r is None else np.vstack([r, rows]))

    parts = _each_task(x, dims, add, lambda: None, dims * dims)
    r = _folded(scratch, parts, lambda rows: _triangle(rows.reshape(-1, dims)), dims * dims).reshape(dims, dims)
    k = min(components, dims)
    squares, directions = solve(r, k)
    values, total = squares[:k] / n, float(squares.sum()) / n
    sound = np.sqrt(values) > 8 * dims * EPS * np.sqrt(values.max(initial=0.0))
    scaled = directions / np.where(sound, np.sqrt(np.where(sound, values, 1.0)), 1.0)
    return Whitening(centre, directions, values, np.where(sound, values / (total or 1.0), 0.0), scaled, sound)


def identity_error(x: DataFrame, model: Whitening, scratch: Scratch) -> float:
    """The largest entry of the whitened rows' covariance less the identity, over sound components."""
    dims, k = model.scaled.shape

    def add(state: np.ndarray | None, rows: np.ndarray) -> np.ndarray:
        w = model.centre.centred(rows) @ model.scaled
        mean = w.mean(axis=0)
        new = np.concatenate([[len(w)], mean, ((w - mean).T @ (w - mean)).reshape(-1)])
        return new if state is None else _joined_moments(np.stack([state, new]), k)

    width = 1 + k + k * k
    found = _folded(scratch, _each_task(x, dims, add, lambda: None, width), lambda rows: _joined_moments(rows, k), width)
    off = (found[k + 1 :].reshape(k, k) / found[0] - np.eye(k))[np.ix_(model.sound, model.sound)]
    return float(np.abs(off).max(initial=0.0))


SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(vectors: DataFrame, components: int = 8) -> DataFrame:
    """A row for each usable vector and component, numbered from 1 by falling variance."""
    spark = vectors.sparkSession
    scratch = Scratch(spark, "whitening")
    x = usable(vectors)
    model = fit(x, components, scratch)
    if model is None:
        return spark.createDataFrame([], SCHEMA)
    dims, k = model.scaled.shape
    x = x.where(F.size("x") == dims)
    error = identity_error(x, model, scratch)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = _matrix(batch.column(1), dims)
            w = model.centre.centred(rows) @ model.scaled
            n = len(rows)
            each = lambda values, kind: pa.array(np.tile(values, n), kind)
            again = pa.array(np.repeat(np.arange(n), k))
            columns = [
                batch.column(0).take(again), each(np.arange(1, k + 1), pa.int32()), pa.array(np.full(n * k, model.centre.n), pa.int64()), pa.array(model.centre.deviation(rows), pa.int64()).take(again),
                pa.array(w.reshape(-1), pa.float64(), mask=np.tile(~model.sound, n)), each(model.explained, pa.float64()), pa.array(np.full(n * k, error), pa.float64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in SCHEMA.split(", ")])

    return x.mapInArrow(run, SCHEMA)


def op12_whitening(spark, sf_dir: str) -> DataFrame:
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
