from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tempolink.plans.catalogue import QUERIES
from tempolink.sources.tables import SCHEMAS, table
from tempolink.streaming import alerts, joins, windows


def stream(spark, tmp_path, batches):
    """Events as one file for each batch."""
    for i, rows in enumerate(batches):
        df = spark.createDataFrame([(e, t, u, "view", 1.0, "{}") for e, t, u in rows], SCHEMAS["events"])
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "events.parquet"))
    return windows.event_stream(spark, str(tmp_path))


def at(day, minute=0):
    return datetime(2024, 1, day, 0, minute)


def test_closed_windows_agree_with_batch(spark, tmp_path):
    rows = [(i, at(1 + i % 5, i % 50), 1) for i in range(20)] + [(99, at(20), 1)]
    got = windows.drain(spark, windows.tumbling(stream(spark, tmp_path, [rows])))
    assert sorted((r["window_start"].day, r["n"]) for r in got.collect()) == [(d, 4) for d in range(1, 6)]


def test_sessions_end_after_a_gap(spark, tmp_path):
    rows = [(1, at(1, 0), 7), (2, at(1, 20), 7), (3, datetime(2024, 1, 1, 5), 7), (4, at(1, 0), 8), (5, at(20), 9)]
    got = windows.drain(spark, windows.sessions(stream(spark, tmp_path, [rows])))
    assert sorted((r["user_id"], r["n"]) for r in got.collect()) == [(7, 1), (7, 2), (8, 1)]


def test_repeats_are_dropped(spark, tmp_path):
    rows = [(1, at(1), 7), (2, at(1, 5), 7)]
    got = windows.drain(spark, windows.deduplicated(stream(spark, tmp_path, [rows, rows])))
    assert sorted(r["event_id"] for r in got.collect()) == [1, 2]


def counted(df):
    return sorted(tuple(map(str, r)) for r in df.collect())


def in_batch(spark, folder, name):
    """The query as a batch over all rows."""
    events = table(spark, folder, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    if name == "stream_tumbling":
        return events.groupBy(F.window("ts", "1 day"), "event_type").count().select("window.start", "event_type", "count")
    return events.groupBy(F.session_window("ts", "30 minutes"), "user_id").count().select("user_id", "session_window.start", "session_window.end", "count")


@pytest.mark.parametrize("name", ["stream_tumbling", "stream_session"])
def test_whole_streams_equal_the_batch(spark, small, name):
    got = counted(QUERIES[name](spark, small))
    assert got == counted(in_batch(spark, small, name))
    assert sum(int(r[-1]) for r in got) == table(spark, small, "events").count()


@pytest.mark.parametrize("name", ["stream_tumbling", "stream_session"])
def test_late_rows_and_open_windows_count_over_many_files(spark, tmp_path, name):
    batches = [[(1, at(20), 7), (2, at(20, 10), 7)], [(3, at(1), 7), (4, at(20, 35), 7)], [(5, at(1, 20), 8)]]
    stream(spark, tmp_path, batches)
    got = counted(QUERIES[name](spark, str(tmp_path)))
    assert got == counted(in_batch(spark, str(tmp_path), name)) and sum(int(r[-1]) for r in got) == 5
    stream(spark, tmp_path / "none", [[]])
    assert QUERIES[name](spark, str(tmp_path / "none")).count() == 0


@pytest.mark.parametrize("name", ["stream_tumbling", "stream_session", "stream_dedup"])
def test_another_session_zone_changes_nothing(spark, small, name):
    want = counted(QUERIES[name](spark, small))
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        assert counted(QUERIES[name](spark, small)) == want
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def bought(spark, tmp_path, files):
    """Events of (id, time, user, kind), a file each."""
    for rows in files:
        df = spark.createDataFrame([(e, t, u, kind, 1.0, "{}") for e, t, u, kind in rows], SCHEMAS["events"])
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "events.parquet"))
    return windows.event_stream(spark, str(tmp_path))


def test_purchases_have_their_views_or_none(spark, tmp_path):
    first = [(1, at(1, 10), 7, "view"), (2, at(1, 20), 7, "purchase"), (3, at(1, 20), 7, "view"), (4, at(1, 21), 8, "purchase"), (5, at(2), None, "purchase"), (6, at(2), None, "view"), (7, None, 7, "purchase"), (8, at(1, 55), 7, "purchase")]
    second = [(9, at(1, 50), 7, "view"), (10, at(1, 50), 7, "view"), (11, at(3), 9, "purchase"), (2, at(1, 20), 7, "purchase")]
    drained = joins.Drained(spark, ["purchase", "view"])
    open_now = drained.run(bought(spark, tmp_path, [first]), joins.views_before)
    assert {(r["event_id"], r["view_id"]) for r in open_now.collect()} == {(2, 1)}  # what may still be matched is held back
    got = drained.finish(bought(spark, tmp_path, [second]), joins.views_before)
    assert sorted((r["event_id"], r["view_id"] or 0) for r in got.collect()) == [(2, 1), (2, 1), (4, 0), (5, 0), (8, 9), (8, 10), (11, 0)]


def test_what_is_later_than_the_delay_is_dropped(spark, tmp_path):
    drained = joins.Drained(spark, ["purchase", "view"])
    drained.run(bought(spark, tmp_path, [[(1, at(10), 7, "purchase"), (2, at(10), 7, "view")]]), joins.views_before)
    got = drained.finish(bought(spark, tmp_path, [[(3, at(2), 7, "purchase"), (4, at(9, 50), 7, "purchase"), (5, at(9, 40), 7, "view")]]), joins.views_before)
    assert sorted((r["event_id"], r["view_id"] or 0) for r in got.collect()) == [(1, 0), (4, 5)]


def test_silence_is_told_when_it_is_certain_and_after_a_restart(spark, tmp_path):
    view = lambda e, t, u: (e, t, u, "view")
    first = [view(1, at(1), 7), view(2, at(1), 7), view(3, at(4), 7), view(4, at(1), 8), view(5, at(2), 8), view(6, at(4), None), view(7, None, 9), view(8, at(5), 9)]
    second = [view(9, at(4, 30), 8), view(10, at(8), 7)]  # in time: within a day of the latest
    third = [view(11, at(2), 7), view(12, at(7, 30), 8)]  # the first is too late
    got = lambda df: sorted((r["user_id"], r["last_ts"], r["alert_ts"]) for r in df.collect())
    day = timedelta(days=1)
    with alerts.keyed_state(spark):
        drained = joins.Drained(spark, ["close"])
        told = got(drained.run(bought(spark, tmp_path, [first]), alerts.silent_users))
        assert told == [(7, at(1), at(1) + day), (8, at(2), at(2) + day)]
        drained.run(bought(spark, tmp_path, [second]), alerts.silent_users)
        told = got(drained.finish(bought(spark, tmp_path, [third]), alerts.silent_users))
    last = [(7, at(1)), (7, at(4)), (7, at(8)), (8, at(2)), (8, at(4, 30)), (8, at(7, 30)), (9, at(5))]
    assert told == [(u, t, t + day) for u, t in last]
    assert "RocksDB" not in spark.conf.get("spark.sql.streaming.stateStore.providerClass")


def test_a_users_batch_is_one_read_and_one_write_of_state():
    """However many events: keyed state and timers cost a call to Spark each."""
    calls, held, timers = [], [None], []

    class State:
        def get(self):
            calls.append("get")
            return held[0]

        def update(self, value):
            calls.append("update")
            held[0] = value

        def clear(self):
            held[0] = None

    class Handle:
        getValueState = lambda self, *_: State()
        registerTimer = lambda self, at: timers.append(at)

    class Now:
        def __init__(self, at):
            self.getExpiryTimeInMs = self.getCurrentWatermarkInMs = lambda: at

    silence = alerts.Silence(10_000)
    silence.init(Handle())
    list(silence.handleInputRows((7,), iter([{"at": 5000 * k} for k in [*range(1000), 2000, 3]]), Now(0)))
    assert (calls, timers) == (["get", "update"], [10])
    found = list(silence.handleExpiredTimer((7,), Now(5100), Now(5010)))
    assert [(r["last"], r["due"]) for r in found] == [(4_995_000, 5_005_000)]
    assert (held, timers) == ([([10_000_000],)], [10, 10_010])
    assert len(list(silence.handleExpiredTimer((7,), Now(10_010), Now(10_010)))) == 1 and held == [None]
    assert list(silence.handleExpiredTimer((7,), Now(10_010), Now(10_010))) == []
