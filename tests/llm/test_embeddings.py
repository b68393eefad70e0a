import math

import numpy as np
import pytest

from tempolink.llm import embeddings

SCHEMA = "vec_id long, embedding array<float>, label int, kept string, component string, n_links int"


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], y, "k", "c", 1) for i, v, y in rows], SCHEMA)


def brute(rows):
    unit = []
    for i, v, y in rows:
        v = None if v is None or None in list(v) else np.array(v, np.float32).astype(float)
        n = 0 if v is None else np.linalg.norm(v)
        unit.append((i, v / n if n and math.isfinite(n) else None, y))
    links, root = {i: 0 for i, _, _ in rows}, {i: i for i, _, _ in rows}

    def top(v):
        while root[v] != v:
            v = root[v]
        return v

    for k, (i, a, y) in enumerate(unit):
        for j, b, z in unit[:k]:
            if a is not None and b is not None and y is not None and y == z and len(a) == len(b) and a @ b >= 0.93:
                links[i] += 1
                links[j] += 1
                u, v = top(i), top(j)
                root[max(u, v)] = min(u, v)
    return {i: (links[i], top(i)) for i in links}


def cloud(n, dim=16, seed=4):
    r = np.random.default_rng(seed)
    centre = r.standard_normal((6, dim))
    rows = [(i, centre[i % 6] + r.standard_normal(dim) * (0.05 + 0.3 * (i % 5) / 5), i % 2) for i in range(n)]
    return rows + [(1000 + i, rows[0][1], 0) for i in range(40)]


@pytest.mark.parametrize("block", [256, 8])
def test_links_are_those_of_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(embeddings, "BLOCK", block)
    rows = cloud(150)
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embeddings.near_vectors(frame(spark, rows), recall=1 - 1e-9).collect()}
    assert got == brute(rows)


def test_odd_cases(spark):
    v = [1.0, 2.0, 3.0]
    rows = [(1, v, 0), (2, None, 0), (3, [], 0), (4, [0, 0, 0], 0), (5, [1, None, 3], 0), (6, [1, math.nan, 3], 0), (7, [1, math.inf, 3], 0), (8, v, None), (9, v, 1), (10, v, 0), (11, [1, 2], 0), (12, [2, 4, 6], 0)]
    got = embeddings.near_vectors(frame(spark, rows)).collect()
    assert {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in got} == {i: (n, c, c == i) for i, (n, c) in brute(rows).items()}
    again = embeddings.near_vectors(frame(spark, [(1, v, 0), (1, v, 0), (2, v, 0), (None, v, 0)])).collect()
    assert sorted((r["vec_id"] or 0, r["n_links"], r["component_id"] or 0, r["kept"]) for r in again) == [(0, 0, 0, True), (1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False)]
    assert embeddings.near_vectors(frame(spark, [])).count() == 0


def test_more_vectors_get_more_bits():
    assert embeddings.plan(100)[0] < embeddings.plan(10**9)[0] <= 48
    bits, tables = embeddings.plan(50_000)
    assert 1 - (1 - (1 - math.acos(0.93) / math.pi) ** bits) ** tables >= embeddings.RECALL


def test_unlike_lengths_of_one_label_link_with_nothing(spark):
    r = np.random.default_rng(3)
    short, long = r.standard_normal(8), r.standard_normal(4104)
    rows = [(i, [float(x) for x in v], 1) for i, v in enumerate([short, long] * 40)]
    rows += [(100, [float(x) for x in np.append(short, np.zeros(8))], 1), (101, [1e200, 0.0], 2), (102, [1.0, 0.0], 2), (103, [1e-200, 0.0], 2), (104, [0.1, 0.0], 2)]
    got = {x["vec_id"]: (x["n_links"], x["component_id"]) for x in embeddings.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert got == {i: (39, i % 2) for i in range(80)} | {100: (0, 100)} | {i: (3, 101) for i in range(101, 105)}


def test_recall_at_the_default_setting(spark):
    """Against all pairs of a larger table, many of them right at the threshold."""
    r = np.random.default_rng(5)
    base = r.standard_normal((400, 64))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    side = r.standard_normal((400, 8, 64))
    side -= (side * base[:, None]).sum(axis=2, keepdims=True) * base[:, None]
    side /= np.linalg.norm(side, axis=2, keepdims=True)
    cos = r.uniform(0.925, 0.95, (400, 8, 1))
    m = np.concatenate([base, (cos * base[:, None] + np.sqrt(1 - cos**2) * side).reshape(-1, 64)]).astype(np.float32)
    label = np.concatenate([np.arange(400), np.repeat(np.arange(400), 8)]) % 7
    rows = [(i, [float(x) for x in v], int(y)) for i, (v, y) in enumerate(zip(m, label))]
    d = m.astype(float)
    d /= np.linalg.norm(d, axis=1, keepdims=True)
    want = ((d @ d.T >= 0.93) & (label[:, None] == label)).sum(axis=1) - 1
    got = {x["vec_id"]: x["n_links"] for x in embeddings.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()}
    assert all(got[i] <= want[i] for i in got) and sum(got.values()) >= 0.99 * want.sum() > 4000
