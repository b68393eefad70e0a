import numpy as np
import pytest

from tempolink.llm import whitening
from tempolink.sources.scratch import Scratch

rng = np.random.default_rng(3)
turn = lambda n: np.linalg.qr(rng.normal(size=(n, n)))[0]
TRIANGLES = {
    "one": np.array([[3.0]]),
    "random": np.linalg.qr(rng.normal(size=(200, 64)), mode="r"),
    "clusters": np.linalg.qr(rng.normal(size=(900, 32)) + 9 * rng.normal(size=(5, 32))[rng.integers(0, 5, 900)], mode="r"),
    "unit": np.eye(20),
    "repeated values": turn(40) @ np.diag([3.0] * 10 + [1.0] * 30) @ turn(40),
    "falling": turn(30) @ np.diag(10.0 ** -np.arange(30.0)) @ turn(30),
    "almost equal": turn(30) @ np.diag(1 + 1e-10 * np.arange(30)) @ turn(30),
    "pairs": np.diag(np.abs(np.arange(-16.0, 16))) + np.diag(np.ones(31), 1),
    "dependent": np.linalg.qr(rng.normal(size=(40, 3)) @ rng.normal(size=(3, 40)), mode="r"),
    "zero": np.zeros((6, 6)),
    "zeros within": np.diag([1.0, 0, 2, 0, 3]) + np.diag([1.0, 1, 0, 1], 1),
}


@pytest.mark.parametrize("name", TRIANGLES)
def test_solver(name):
    r = TRIANGLES[name]
    values, v = whitening.solve(r, 8)
    k, want = v.shape[1], np.linalg.svd(r, compute_uv=False)
    top = want[0] or 1.0
    assert np.abs(np.sqrt(values) - want).max() < 1e-14 * top * len(r)
    assert np.abs(v.T @ v - np.eye(k)).max() < 1e-14 * len(r)
    assert np.abs(r.T @ (r @ v) - v * values[:k]).max() < 1e-14 * top**2 * len(r)


def test_small_values_keep_their_digits():
    """Singular values of a bidiagonal matrix over twenty magnitudes, against exact products: det(B)^2 is their product."""
    a, b = 10.0 ** -np.arange(20.0), 10.0 ** -np.arange(19.0)
    values = whitening.dqds(a, b)
    assert np.log(values).sum() == pytest.approx(2 * np.log(a).sum(), rel=1e-13) and (values > 0).all()


def rows(spark, vectors, ids=None):
    return spark.createDataFrame([(i if ids is None else ids[i], v, 1, "x") for i, v in enumerate(vectors)], "vec_id long, embedding array<float>, label int, component string")


def plain(vectors, k=8):
    x = np.floor(np.array(vectors, dtype=np.float32).astype(float) * 1024).astype(np.int64) + 100000
    n, s = len(x), x.sum(axis=0)
    c = x - s / n
    e, u = np.linalg.eigh(c.T @ c / n)
    e, u = e[::-1], u[:, ::-1]
    return x, n, s, c, e[:k], u[:, :k], e.sum()


def against(got, vectors):
    x, n, s, c, e, u, trace = plain(vectors)
    k = len(e)
    assert len(got) == len(x) * k
    w = np.zeros((len(x), k))
    for r in got:
        w[r["vec_id"], r["component"] - 1] = r["whitened"]
        assert r["n"] == n and r["deviation"] == sum((n * int(a) - int(b)) ** 2 for a, b in zip(x[r["vec_id"]], s))
        assert r["explained"] == pytest.approx(e[r["component"] - 1] / trace, rel=1e-9)
    want = c @ u / np.sqrt(e)
    sign = np.sign((w * want).sum(axis=0))
    assert np.abs(w - want * sign).max() < 1e-8
    centred = w - w.mean(axis=0)
    (error,) = {r["identity_error"] for r in got}
    assert error == pytest.approx(np.abs(centred.T @ centred / n - np.eye(k)).max(), abs=1e-11) and error < 1e-9


def test_equals_a_plain_reading(spark):
    scale = np.linspace(1, 3, 12)
    vectors = (np.random.default_rng(7).normal(size=(500, 12)) * scale + 5).astype(np.float32).tolist()
    against(whitening.whiten(rows(spark, vectors).repartition(7)).collect(), vectors)


def test_on_the_small_tables(spark, small):
    table = spark.read.parquet(f"{small}/embeddings.parquet").orderBy("vec_id").collect()
    ids = {r["vec_id"]: i for i, r in enumerate(table)}
    got = [r.asDict() | {"vec_id": ids[r["vec_id"]]} for r in whitening.op12_whitening(spark, small).collect()]
    against(got, [r["embedding"] for r in table])


def test_parts_are_joined_in_rounds(spark, monkeypatch):
    monkeypatch.setattr(whitening, "JOINED", 1)
    monkeypatch.setattr(whitening, "BLOCK", 16)
    vectors = np.random.default_rng(8).normal(size=(300, 4)).astype(np.float32).tolist()
    against(whitening.whiten(rows(spark, vectors).repartition(11)).collect(), vectors)


def test_few_dimensions(spark):
    vectors = [[1.0, 2.0], [2.0, -1.0], [0.5, 0.25], [3.0, 3.0], [1.0, 2.0]]
    against(whitening.whiten(rows(spark, vectors)).collect(), vectors)


def test_unusable_vectors_go(spark):
    good = [[1.0, 2.0], [2.0, -1.0], [0.5, 0.25], [3.0, 3.0]]
    bad = [None, [], [1.0, None], [float("nan"), 1.0], [float("inf"), 1.0], [1e30, 1.0], [1.0], [1.0, 2.0, 3.0]]
    against(whitening.whiten(rows(spark, good + bad)).collect(), good)


def test_no_variance(spark):
    got = whitening.whiten(rows(spark, [[1.0, 2.0, 3.0]] * 3, [None, 5, 5])).collect()
    assert len(got) == 9 and all(r["whitened"] is None and r["explained"] == 0 and r["deviation"] == 0 and r["identity_error"] == 0 for r in got)
    assert sorted(r["vec_id"] or 0 for r in got) == [0] * 3 + [5] * 6
    flat = [[float(i), 2.0 * i, 7.0] for i in (1, 2, 4, 9)]  # one direction only
    got = whitening.whiten(rows(spark, flat)).collect()
    assert {(r["component"], r["whitened"] is None) for r in got} == {(1, False), (2, True), (3, True)}


def test_empty(spark):
    none = rows(spark, [[1.0]]).where("1 = 0")
    got = whitening.whiten(none)
    assert got.count() == 0 and got.columns == whitening.whiten(rows(spark, [[1.0]])).columns


def test_wide_deviations(spark):
    vectors = [[2.0**30, 0.0], [-(2.0**30), 0.0], [0.0, 1.0]]
    got = whitening.whiten(rows(spark, vectors)).collect()
    x, n, s, *_ = plain(vectors)
    for r in got:
        want = sum((n * int(a) - int(b)) ** 2 for a, b in zip(x[r["vec_id"]], s))
        assert r["deviation"] == (want if want < 2**63 else None)


def test_fit_is_the_same_however_dealt(spark):
    vectors = np.random.default_rng(9).normal(size=(200, 6)).tolist()
    a, b = (whitening.fit(whitening.usable(rows(spark, vectors).repartition(p)), 6, Scratch(spark, "t")) for p in (1, 9))
    assert np.abs(a.values / b.values - 1).max() < 1e-12
    assert np.abs(np.abs((a.directions * b.directions).sum(axis=0)) - 1).max() < 1e-9
