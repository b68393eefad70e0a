import random
from datetime import datetime, timedelta
from itertools import combinations
from math import comb

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from tempolink.functions.time import micros, period
from tempolink.operators import graph
from tempolink.plans.catalogue import QUERIES
from tempolink.sources.tables import EDGES, EXPOSURES, SCHEMAS, read_edges, write_edges

T = lambda day, hour=0: datetime(2024, 1, day, hour)


def edges(spark, rows):
    return spark.createDataFrame(rows, EDGES)


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_exposures_are_distinct_and_without_nulls(spark):
    lineitem = spark.createDataFrame([(1, 5), (1, 5), (1, None), (None, 6), (2, 7), (9, 8)], "l_orderkey bigint, l_partkey bigint")
    orders = spark.createDataFrame([(1, T(1)), (2, None)], "o_orderkey bigint, o_orderdate timestamp_ntz")
    assert rows(graph.exposures(lineitem, orders)) == [(1, 5, T(1)), (2, 7, None)]


def test_an_empty_table_has_no_edges(spark):
    assert graph.pair_edges(spark.createDataFrame([], EXPOSURES)).count() == 0


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.sets(st.tuples(st.integers(0, 3), st.integers(0, 5)), max_size=15))
def test_an_episode_of_n_nodes_has_n_choose_two_edges(spark, seen):
    exposed = spark.createDataFrame([(g, n, T(1)) for g, n in seen], EXPOSURES)
    found = graph.pair_edges(exposed)
    sizes = [sum(g == k for g, _ in seen) for k in range(4)]
    assert found.count() == sum(comb(n, 2) for n in sizes)
    total = sum(r["degree"] for r in graph.degree(graph.adjacency(found)).collect())
    assert total == 2 * found.count()


def test_history_degree_and_gaps(spark):
    e = edges(spark, [(1, 1, 2, T(1)), (2, 1, 2, T(4)), (3, 1, 3, T(4))])
    assert rows(graph.edge_history(e)) == [(1, 2, 2, T(1), T(4)), (1, 3, 1, T(4), T(4))]
    adj = graph.adjacency(e)
    assert rows(graph.degree(adj)) == [(1, 3, 2), (2, 2, 1), (3, 1, 1)]
    gaps = {(r["u"], r["group_id"]): r["gap_days"] for r in graph.gaps(adj).collect()}
    assert gaps[1, 1] is None and gaps[1, 2] == 3 and gaps[1, 3] == 0 and gaps[3, 3] is None


def test_cumulative_degree(spark):
    e = edges(spark, [(1, 1, 2, datetime(2024, 1, 5)), (2, 1, 3, datetime(2024, 3, 5))])
    got = rows(graph.cumulative(graph.snapshots(graph.adjacency(e))).where("u = 1"))
    assert got == [(1, datetime(2024, 1, 1), 1, 1), (1, datetime(2024, 3, 1), 1, 2)]


def test_recent_neighbours_break_ties_by_episode_then_node(spark):
    e = edges(spark, [(1, 1, 2, T(3)), (2, 1, 3, T(3)), (2, 1, 4, T(3)), (1, 1, 5, T(1))])
    assert [r["v"] for r in graph.recent_k(graph.adjacency(e), 3).where("u = 1").orderBy("rank").collect()] == [4, 3, 2]


def test_asof_takes_the_last_strictly_earlier_row(spark):
    schema = "id bigint, by bigint, ts timestamp_ntz"
    left = spark.createDataFrame([(10, 1, T(1, 10)), (11, 1, T(1, 1)), (12, 2, T(1, 10)), (13, 1, T(1, 10))], schema)
    right = spark.createDataFrame([(1, 1, T(1, 10)), (2, 1, T(1, 3)), (4, 1, T(1, 9)), (3, 1, T(1, 9)), (5, 1, T(1, 11))], schema)
    got = {r["id"]: r["right_id"] for r in graph.asof(left, right, "by", "ts", "id").collect()}
    assert got == {10: 4, 13: 4, 11: None, 12: None}


def test_paths_respect_time_horizon_and_return(spark):
    e = edges(spark, [(1, 1, 2, T(1)), (2, 2, 3, T(2)), (3, 2, 4, T(1)), (4, 1, 2, T(5)), (5, 2, 9, datetime(2024, 3, 1))])
    # 1-2-3; from 3 and 4 over 2 back to 1 on day 5; 4-2-3; edges at the same time make no path
    got = dict(rows(graph.paths2(graph.adjacency(e), 30)))
    assert got == {1: 1, 3: 1, 4: 2}


def brute_triangles(pairs):
    nodes = sorted({n for p in pairs for n in p})
    return sum({(a, b), (b, c), (a, c)} <= pairs for a, b, c in combinations(nodes, 3))


def test_triangles_with_a_hub(spark):
    pairs = {(0, i) for i in range(1, 12)} | {(1, 2), (2, 3), (1, 3), (4, 5), (10, 11)}
    e = edges(spark, [(k, a, b, T(1)) for k, (a, b) in enumerate(sorted(pairs))] * 2)
    assert graph.triangles(e).head()[0] == brute_triangles(pairs)
    moved = edges(spark, [(k, 100 - b, 100 - a, T(1)) for k, (a, b) in enumerate(sorted(pairs))])
    assert graph.triangles(moved).head()[0] == brute_triangles(pairs)


def test_components(spark):
    chain = [(k, k, k + 1, T(1)) for k in range(10, 40)]
    got = dict(rows(graph.component_labels(edges(spark, [(0, 1, 3, T(1)), (0, 3, 7, T(1)), (0, 2, 9, T(1)), *chain]))))
    assert {got[n] for n in (1, 3, 7)} == {1} and got[9] == 2 and {got[n] for n in range(10, 41)} == {10}
    assert graph.component_labels(edges(spark, [])).count() == 0


def test_common_neighbours(spark):
    e = edges(spark, [(1, 1, 2, T(1)), (1, 1, 3, T(1)), (1, 2, 3, T(1)), (2, 3, 4, T(1))])
    got = {(r["src"], r["dst"]): r["n_common"] for r in graph.common_neighbors(e).collect()}
    assert got == {(1, 2): 1, (1, 3): 1, (2, 3): 1}


def test_sliding_windows(spark):
    events = spark.createDataFrame([(T(10, 5), "a", 1), (T(10, 6), "a", 1), (T(10, 6), "a", 2)], "ts timestamp_ntz, event_type string, user_id bigint")
    got = graph.sliding(events).collect()
    assert len(got) == 7 and {(r["n"], r["n_users"]) for r in got} == {(3, 2)} and min(r["window_start"] for r in got) == T(4)


def test_components_of_a_long_chain_take_few_rounds(spark, tmp_path, monkeypatch):
    """Edges dealt one by one, so that no task joins them up by itself."""
    from tempolink.operators import components as module
    from tempolink.sources.scratch import Scratch

    monkeypatch.setattr(module, "_shrunk", lambda e: e.select("u", "v", F.monotonically_increasing_id().alias("batch")).dropDuplicates(["u", "v"]))
    links = spark.range(400).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v")).unionByName(spark.createDataFrame([(900, 901), (901, 900)], "u long, v long"))
    got = dict(map(tuple, module.components(links, Scratch(spark, "chain"), most_rounds=12).collect()))
    assert got == {**dict.fromkeys(range(401), 0), 900: 900, 901: 900}


@pytest.mark.parametrize("most", [4, 1 << 19])
def test_what_fits_into_a_batch_needs_no_rounds(spark, monkeypatch, most):
    """Edges of many tasks, few of them; with a smaller batch the rounds give the same."""
    from tempolink.operators import components as module
    from tempolink.sources.scratch import Scratch

    monkeypatch.setattr(module, "BATCH", most)
    merged = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(merged, "false")
    try:
        links = spark.range(0, 60, 1, 12).select(F.pmod(F.col("id") * 7, F.lit(61)).alias("u"), F.pmod(F.col("id") * 7 + 7, F.lit(61)).alias("v")).where("u <> 30 AND v <> 30")
        scratch = Scratch(spark, "few")
        got = dict(map(tuple, module.components(links, scratch).collect()))
    finally:
        spark.conf.unset(merged)
    up = {n: n for n in range(61)}
    pairs = [tuple(r) for r in links.collect()]
    for u, v in pairs * len(up):
        up[u] = up[v] = min(up[u], up[v])
    assert got == {n: up[n] for p in pairs for n in p}
    assert (len(scratch.paths) <= 3) == (most > 4)


def test_a_batch_shrinks_to_its_forest():
    from tempolink.operators.components import forest

    u, v = forest(np.array([5, 9, 7, 30, 12]), np.array([9, 7, 5, 12, 40]))
    assert sorted(zip(u.tolist(), v.tolist())) == [(5, 7), (5, 9), (12, 30), (12, 40)]


def test_components_of_all_months(spark, tmp_path):
    """Links of orders in every month, against union-find."""
    orders = [(o, [10 * (o % 4) + (o * k) % 7 for k in (1, 2)] if o < 24 else [90, 30], datetime(1995 + o % 7, 1 + o % 12, 3)) for o in range(25)]
    lines = [(o, n, 1, i, *[1.0] * 4, "A", "F", t) for o, nodes, t in orders for i, n in enumerate(nodes)]
    spark.createDataFrame(lines, SCHEMAS["lineitem"]).write.parquet(str(tmp_path / "lineitem.parquet"))
    spark.createDataFrame([(o, 1, "F", 1.0, t, "1") for o, _, t in orders], SCHEMAS["orders"]).write.parquet(str(tmp_path / "orders.parquet"))
    up = {}

    def root(n):
        while up.setdefault(n, n) != n:
            n = up[n]
        return n

    for _, (a, b), _ in orders:
        if a != b:
            a, b = sorted((root(a), root(b)))
            up[b] = a
    want = sorted((n, root(n)) for n in up)
    assert len({c for _, c in want}) >= 4
    assert rows(QUERIES["components_all"](spark, str(tmp_path))) == want


@pytest.fixture(params=["UTC", "America/New_York", "Australia/Lord_Howe"])
def zone(spark, request):
    spark.conf.set("spark.sql.session.timeZone", request.param)
    yield request.param
    spark.conf.set("spark.sql.session.timeZone", "UTC")


#: Times around a change to summer time, some of which don't exist there.
TIMES = [datetime(2024, 3, 10, 1, 59, 59, 999_999), datetime(2024, 3, 10, 2, 30), datetime(2024, 3, 10, 3, 10), datetime(2024, 11, 3, 1, 30), datetime(1969, 12, 31, 23, 59, 59, 1), datetime(2024, 10, 6, 2, 15)]


def test_times_without_zone_are_the_same_in_every_session_zone(spark, zone):
    df = spark.createDataFrame([(t,) for t in TIMES], "ts timestamp_ntz")
    for r in df.select("ts", micros("ts").alias("m"), *[period(u, "ts").alias(u) for u in ("hour", "day", "month")]).collect():
        t = r["ts"]
        assert r["m"] == (t - datetime(1970, 1, 1)) // timedelta(microseconds=1)
        assert r["hour"] == t.replace(minute=0, second=0, microsecond=0) and r["day"] == datetime(t.year, t.month, t.day) and r["month"] == datetime(t.year, t.month, 1)


def test_the_last_earlier_row_in_every_zone_and_without_key(spark, zone):
    schema = "id bigint, by bigint, ts timestamp_ntz"
    left = spark.createDataFrame([(1, 7, TIMES[2]), (2, None, TIMES[2]), (3, 7, TIMES[1]), (4, 7, None)], schema)
    right = spark.createDataFrame([(11, 7, TIMES[1]), (12, None, TIMES[1]), (13, 7, None), (14, 7, TIMES[0])], schema)
    got = {r["id"]: r["right_id"] for r in graph.asof(left, right, "by", "ts", "id").collect()}
    assert got == {1: 11, 2: None, 3: 14, 4: None}


def test_edges_are_read_from_the_very_time(spark, tmp_path):
    write_edges(edges(spark, [(k, 1, 2, datetime(2024, m, d)) for k, (m, d) in enumerate([(1, 5), (1, 20), (2, 3), (3, 9)])]), str(tmp_path / "e"))
    read = lambda **w: sorted(r["ts"].strftime("%m-%d") for r in read_edges(spark, str(tmp_path / "e"), **w).collect())
    assert read(since="2024-01-10") == ["01-20", "02-03", "03-09"] and read(since="2024-01-20", until="2024-03-09") == ["01-20", "02-03"]
    assert read(since="2025-01-01") == [] and read(until="2024-01-05") == [] and len(read()) == 4


def test_gaps_over_periods_equal_a_plain_walk(spark):
    pick = random.Random(3)
    days = [None] + [datetime(2024, 1, 1) + timedelta(days=17 * k, hours=pick.randrange(30)) for k in range(20)]
    adj = graph.adjacency(edges(spark, [(g, *pick.sample(range(5), 2), pick.choice(days)) for g in range(120)]))
    want, last = [], {}
    for r in sorted(adj.collect(), key=lambda r: (r["u"], r["ts"] or datetime.min, r["group_id"], r["v"])):
        before = last.get(r["u"])
        want.append((*r, (r["ts"].date() - before.date()).days if before and r["ts"] else None))
        last[r["u"]] = r["ts"]
    for unit in ("month", "day", "year"):
        assert sorted(map(str, map(tuple, graph.gaps(adj, unit).collect()))) == sorted(map(str, want))


def test_asof_over_periods_equals_a_plain_search(spark):
    pick = random.Random(9)
    schema = "id bigint, by bigint, ts timestamp_ntz"
    some = lambda n, k: [(k + i, pick.choice([1, 2, None]), pick.choice([None, *(datetime(2024, 1, 1) + timedelta(hours=7 * h) for h in range(40))])) for i in range(n)]
    left, right = some(60, 0), some(60, 1000)
    want = {}
    for i, by, t in left:
        seen = [(x, j) for j, b, x in right if by is not None and t is not None and b == by and x is not None and x < t]
        want[i] = max(seen)[1] if seen else None
    for unit in ("day", "month"):
        got = graph.asof(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema), "by", "ts", "id", unit)
        assert {r["id"]: r["right_id"] for r in got.collect()} == want and got.count() == len(left)


@pytest.mark.parametrize("shift", [0, 1 << 40])
def test_open_triples_are_never_rows(spark, shift):
    """Ids beyond 32 bits too; two edges that may be closed were a shuffled row each before."""
    pick = random.Random(5)
    pairs = {tuple(sorted(pick.sample(range(40), 2))) for _ in range(220)} | {(0, i) for i in range(1, 40)}
    e = edges(spark, [(k, a + shift, b + shift, T(1)) for k, (a, b) in enumerate(sorted(pairs))])
    found = graph.closed_triples(e)
    want = [t for t in combinations(range(40), 3) if set(combinations(t, 2)) <= pairs]
    assert sorted(tuple(sorted(n - shift for n in r)) for r in found.collect()) == want
    assert all(r["b"] < r["c"] for r in found.collect())
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "array_intersect" in plan and plan.count("Join") == 1
