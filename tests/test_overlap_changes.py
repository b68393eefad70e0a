import random
import re
from collections import Counter
from datetime import datetime

import numpy as np
import pytest

from tempolink.operators import changes, overlap
from tempolink.plans.catalogue import QUERIES
from tempolink.sources import tables

SCHEMA = "id long, lo long, hi long"


def plain(left, right):
    sane = lambda rows: [(i, a, b) for i, a, b in rows if a is not None and b is not None and a <= b]
    return Counter((i, j, max(a, c), min(b, d)) for i, a, b in sane(left) for j, c, d in sane(right) if a <= d and c <= b)


def joined(spark, left, right, grain, most=overlap.MOST):
    return overlap.overlap_join(spark.createDataFrame(left, SCHEMA), spark.createDataFrame(right, SCHEMA), grain, most)


@pytest.mark.parametrize(("seed", "grain", "most"), [(1, 1, 4096), (2, 7, 3), (3, 50, 1), (4, 1000, 4096), (5, 3, 2)])
def test_pairs_equal_all_pairs(spark, seed, grain, most):
    pick = random.Random(seed)

    def some(n, k):
        rows = []
        for i in range(n):
            lo = pick.choice([pick.randrange(-60, 60), 10, 10])
            rows.append((k + i, lo, lo + pick.choice([0, 0, 1, 3, 8, 40, 120, pick.randrange(200)])))
        return rows + [(k, 10, 10), (k, 10, 10), (k + n, None, 5), (k + n, 5, None), (k + n, 9, 8), (None, 0, 1)]

    left, right = some(45, 0), some(45, 100)
    got = Counter(map(tuple, joined(spark, left, right, grain, most).collect()))
    assert got == plain(left, right)


def test_far_and_wide(spark):
    big = 2**50
    left = [(1, -big, big), (2, big - 1, big), (3, 0, 0)]
    right = [(4, big, big), (5, -big - 5, -big), (6, 1, big + 7)]
    assert Counter(map(tuple, joined(spark, left, right, 1).collect())) == plain(left, right)
    assert joined(spark, left, [], 1).count() == joined(spark, [], [], 1).count() == 0


def test_no_nested_loop_and_a_hot_cell_splits(spark):
    hot = [(i, 5, 6) for i in range(300)]
    df = joined(spark, hot, [(1000 + i, 6, 7) for i in range(20)], 1, most=16)
    assert df.count() == 6000
    plan = df._jdf.queryExecution().toString()
    assert not re.search("CartesianProduct|BroadcastNestedLoopJoin.*(lo|hi)", plan)


def test_sessions_of_users_together(spark):
    at = lambda m: datetime(2024, 1, 1, 0, m)
    events = spark.createDataFrame([(1, at(0), 7), (2, at(20), 7), (3, at(50), 8), (4, None, 8), (5, at(1), None)], "event_id long, ts timestamp_ntz, user_id long")
    got = [tuple(r) for r in overlap.together(overlap.user_sessions(events), 60_000_000).collect()]
    assert got == [(7, 8, 1, 0)]  # one ends at minute 50, when the other begins


def test_counted_difference_is_that_of_multisets(spark):
    pick = random.Random(3)
    some = lambda: [(pick.choice([1, 2, 3, None]), pick.choice("ab")) for _ in range(40)]
    before, after = some(), some() + [(9, "z")] * 3
    a, b = Counter(before), Counter(after)
    frames = [spark.createDataFrame(x, "k long, s string").selectExpr("*", "1 AS other") for x in (before, after)]
    got = {(r["k"], r["s"]): r for r in changes.counted_difference(*frames, "k", "s").collect()}
    assert set(got) == set(a) | set(b)
    for key, r in got.items():
        assert (r["n_before"], r["n_after"], r["n_lost"], r["n_gained"], r["n_kept"]) == (a[key], b[key], (a - b)[key], (b - a)[key], (a & b)[key])
    pairs = lambda df: {(r["k"], r["s"]): r["n"] for r in df.collect()}
    assert pairs(changes.except_all(*frames, "k", "s")) == dict(a - b) and pairs(changes.intersect_all(*frames, "k", "s")) == dict(a & b)
    spark_own = Counter((r["k"], r["s"]) for r in frames[0].select("k", "s").exceptAll(frames[1].select("k", "s")).collect())
    assert spark_own == a - b


def test_edge_changes(spark):
    day = lambda m, d=3: datetime(2024, m, d)
    rows = [(1, 1, 2, day(1)), (2, 1, 2, day(2)), (3, 1, 2, day(2, 9)), (4, 3, 4, day(2)), (5, 1, 2, day(3)), (6, 5, 6, day(5)), (7, 8, 9, None), (8, 3, 4, day(3))]
    got = {(r["period"].month, r["src"]): (r["n_before"], r["n_after"], r["change"]) for r in changes.edge_changes(spark.createDataFrame(rows, tables.EDGES)).collect()}
    assert got == {(2, 1): (1, 2, "more"), (2, 3): (0, 1, "gained"), (3, 1): (2, 1, "fewer"), (3, 3): (1, 1, "kept"), (4, 1): (1, 0, "lost"), (4, 3): (1, 0, "lost"), (5, 5): (0, 1, "gained")}
    none = spark.createDataFrame([], tables.EDGES)
    assert changes.edge_changes(none).count() == 0 and changes.counted_difference(none, none, "src").count() == 0


def test_each_query_has_rows_of_every_kind(spark, small):
    kinds = {r["change"] for r in QUERIES["edge_changes"](spark, small).select("change").distinct().collect()}
    assert {"gained", "lost"} <= kinds


@pytest.mark.parametrize(("users", "pairs"), [(1024, 1 << 20), (3, 5)])
def test_users_together_in_blocks_equal_all_pairs(spark, monkeypatch, users, pairs):
    """No overlap is shuffled, as each was before."""
    monkeypatch.setattr(overlap, "USERS", users)
    monkeypatch.setattr(overlap, "PAIRS", pairs)
    pick = random.Random(11)
    rows = [((u, lo), lo, lo + pick.choice([0, 2, 9, 40])) for u in range(-4, 9) for lo in pick.sample(range(0, 200), 8)]
    sane = rows + [((3, 5), 5, 5), ((3, 5), 5, 5)]
    df = spark.createDataFrame(sane + [((None, 1), 1, 9), ((1, 9), 9, 1), ((1, 2), None, 2)], "id struct<user_id long, start long>, lo long, hi long")
    want = {}
    for (s, a, b) in sane:
        for (t, c, d) in sane:
            if s[0] < t[0] and a <= d and c <= b:
                n, m = want.get((s[0], t[0]), (0, 0))
                want[s[0], t[0]] = n + 1, m + min(b, d) - max(a, c)
    found = overlap.together(df)
    assert {(r[0], r[1]): (r[2], r[3]) for r in found.collect()} == want and found.count() == len(want)
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert overlap.together(df.where("false")).count() == 0


@pytest.mark.parametrize("users", [1, 3, 100])
def test_parts_of_blocks_equal_all_pairs(monkeypatch, users):
    """a block is more users than are counted at a time."""
    monkeypatch.setattr(overlap, "USERS", users)
    pick = random.Random(12)
    some = lambda first, n: [(u, lo, lo + pick.choice([0, 3, 30])) for u in range(first, first + n) for lo in pick.choices(range(150), k=6)]
    for left, right in ((some(-6, 12), some(6, 7)), (some(0, 11), None), (some(6, 3), some(-9, 4)), ([], some(1, 2))):
        want = {}
        for s, a, b in left:
            for t, c, d in right or left:
                if (right or s < t) and a <= d and c <= b:
                    n, m = want.get((min(s, t), max(s, t)), (0, 0))
                    want[min(s, t), max(s, t)] = n + 1, m + min(b, d) - max(a, c)
        block = lambda rows: [np.array([r[i] for r in rows], np.int64) for i in range(3)]
        got = [r for found in overlap._all_meetings(block(left), block(right) if right else None) for r in zip(*(c.tolist() for c in found))]
        assert {r[:2]: r[2:] for r in got} == want and len(got) == len(want)


def test_blocks_are_few():
    """before, there was one for each 1,024 users, and all sessions were shuffled for each."""
    assert overlap._blocks(90_000, 6_000_000) == 16 and overlap._blocks(1_500, 100_000) == 2 and overlap._blocks(0, 0) == 1
    assert overlap._blocks(10**6, 10**6) == 123 and overlap._blocks(100, 1 << 24) == 32
