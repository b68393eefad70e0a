import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tempolink.operators import profiles, rollups
from tempolink.plans.catalogue import QUERIES
from tempolink.sources.tables import SCHEMAS, table

DAY = datetime(2024, 1, 1)


def test_levels_are_near_the_exact_ones(spark):
    pick = random.Random(1)
    rows = [(i, DAY + timedelta(hours=pick.randrange(96)), pick.randrange(5000), pick.choice("ab"), pick.gauss(0, 10), "{}") for i in range(20_000)]
    sketches = rollups.stored(spark.createDataFrame(rows, SCHEMAS["events"]))
    assert sketches.count() == 8
    got = rollups.rolled(sketches).collect()
    assert sorted(r["level"] for r in got) == [0] * 8 + [1] * 4 + [2] * 2 + [3]
    for r in got:
        own = [x for x in rows if (r["level"] >= 2 or x[1].date() == r["period"].date()) and (r["level"] % 2 or x[3] == r["event_type"])]
        users, values = {x[2] for x in own}, sorted(x[4] for x in own)
        assert r["n"] == len(own) and r["n_users"] == pytest.approx(len(users), rel=0.06)
        assert abs(sum(v <= r["median"] for v in values) / len(values) - 0.5) < 0.03


def test_stored_rows_merge_whatever_their_source(spark):
    rows = lambda lo: spark.createDataFrame([(i, DAY, i % 100, "a", float(i), "{}") for i in range(lo, lo + 500)], SCHEMAS["events"])
    whole = rollups.rolled(rollups.stored(rows(0)).unionByName(rollups.stored(rows(500))), []).collect()
    assert [(r["level"], r["n"], r["n_users"]) for r in whole] == [(3, 1000, 100)] and abs(whole[0]["median"] - 500) < 40


def test_the_query_counts_as_the_table_does(spark, small):
    exact = {(r["event_type"]): (r["n"], r["u"]) for r in table(spark, small, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("u")).collect()}
    for r in QUERIES["activity_rollup"](spark, small).where("level = 2").collect():
        assert (r["n"], r["n_users"]) == (exact[r["event_type"]][0], pytest.approx(exact[r["event_type"]][1], rel=0.05))


def test_rollup_odd_cases(spark):
    rows = [(1, None, None, None, None, None), (2, DAY, 5, "a", float("nan"), None), (2, DAY, 5, "a", None, None)]
    got = {(r["level"], r["event_type"], r["period"]): (r["n"], r["n_users"], r["median"]) for r in rollups.rolled(rollups.stored(spark.createDataFrame(rows, SCHEMAS["events"]))).collect()}
    assert got[3, None, None] == (3, 1, None) and got[0, None, None] == (1, 0, None) and got[0, "a", DAY] == (2, 1, None)
    assert rollups.rolled(rollups.stored(spark.createDataFrame([], SCHEMAS["events"])), ["period"]).count() == 0


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ('{"a": 1, "b": 2.5}', {"a": 1.0, "b": 2.5}), ('{"a": "3", "b": "x", "c": null, "d": {"e": 1}, "f": [1]}', {"a": 3.0}), ('{"a": 1, "a": 7}', {"a": 7.0}),
        ("{}", {}), ("[1]", {}), ("no json", {}), (None, {}), ('{"ä b": -1e3}', {"ä b": -1000.0}), ('{"a": "NaN"}', {}),
    ],
)
def test_features_of_odd_json(spark, text, want):
    df = spark.createDataFrame([(text,)], "props string")
    assert df.select(profiles.json_features("props").alias("f")).head()["f"] == want


def test_merge_and_cosine(spark):
    rows = [(1, {"a": 1.0, "b": 2.0}, 2.0), (1, {"b": 1.0}, 1.0), (1, None, 1.0), (1, {"c": 1.0}, None), (2, {}, 1.0), (None, {"z": 1.0}, 1.0)]
    df = spark.createDataFrame(rows, "k long, features map<string,double>, w double")
    got = {r["k"]: r["features"] for r in profiles.merged(df, ["k"], weight=F.col("w")).collect()}
    assert got == {1: {"a": 2.0, "b": 5.0}, 2: {}, None: {"z": 1.0}}
    pairs = [({"a": 3.0, "b": 4.0}, {"b": 2.0, "c": 9.0}), ({"a": 1.0}, {"a": -2.0}), ({}, {"a": 1.0}), (None, {"a": 1.0}), ({"a": 0.0}, {"a": 1.0})]
    out = [r[0] for r in spark.createDataFrame(pairs, "a map<string,double>, b map<string,double>").select(profiles.cosine("a", "b")).collect()]
    assert out == [pytest.approx(8 / (5 * 85**0.5)), -1.0, None, None, None]


def test_drift(spark):
    late = datetime(2024, 2, 1)
    rows = [(1, DAY, 7, "a", 0.0, '{"k": 1}'), (2, late, 7, "a", 0.0, '{"k": 1}'), (3, DAY, 8, "a", 0.0, None), (4, late, 8, "b", 0.0, "{}"), (5, DAY, 9, None, 0.0, "{}"), (6, None, 9, "a", 0.0, "{}"), (7, DAY, None, "a", 0.0, "{}")]
    got = {r["user_id"]: tuple(r)[1:] for r in profiles.drift(spark.createDataFrame(rows, SCHEMAS["events"]), "2024-01-16").collect()}
    assert got == {7: (2, 2, pytest.approx(1.0)), 8: (1, 1, 0.0), 9: (0, 0, None)}
    assert profiles.drift(spark.createDataFrame([], SCHEMAS["events"]), "2024-01-16").count() == 0
