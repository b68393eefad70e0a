"""Alerts of what does not happen: state for each user, and timers of event time."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.time import instant, utc
from .joins import END

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """While it lasts, queries of this session keep their state where maps and timers are supported."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_PROVIDER)
        else:
            spark.conf.set(_PROVIDER, before)


class Silence(StatefulProcessor):
    """Holds the times of a user's events until it is settled whether another one follows within the gap.

    That is when the watermark has passed the time and the gap: no event in
    between can still come.  So rows may arrive in any order within the delay,
    and state holds the events of one gap and delay only.  A user's times are one
    value, read and written once for each batch and timer, and only the first of
    them has a timer.
    """

    def __init__(self, gap_micros: int):
        self.gap = gap_micros

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.times = handle.getValueState("times", "at array<long>")

    def _hold(self, times: list[int]) -> None:
        self.times.update((times,))
        self.handle.registerTimer(-(-(times[0] + self.gap) // 1000))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        held = self.times.get()
        times = set(held[0] if held else ())
        times.update(row["at"] for row in rows)
        self._hold(sorted(times))
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        # all that is due by now; a timer of a time that an earlier one joined later may find nothing
        now = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs()) * 1000
        held = self.times.get()
        times = held[0] if held else []
        due = bisect_right(times, now - self.gap)
        if due == len(times):
            self.times.clear()
        elif due:
            self._hold(list(times[due:]))
        for at, following in zip(times[:due], [*times[1 : due + 1], None]):
            if following is None or following > at + self.gap:
                yield Row(user_id=key[0], last=at, due=at + self.gap)

    def close(self) -> None:
        pass


def silent_users(stream: DataFrame, delay: str = "1 day", hours: int = 24) -> DataFrame:
    """(user_id, last_ts, alert_ts): each time that no event of a user follows another within so many hours.

    An event exactly that long after another is in time; events of one time are
    one.  Rows without user or time count for none; rows later than ``delay`` are
    dropped.
    """
    known = stream.where("user_id IS NOT NULL AND ts IS NOT NULL").select("user_id", "ts", F.unix_micros("ts").alias("at")).withWatermark("ts", delay)
    found = known.groupBy("user_id").transformWithState(Silence(hours * 3_600_000_000), "user_id long, last long, due long", "Append", "eventTime")
    instants = found.select("user_id", F.timestamp_micros("last").alias("last"), F.timestamp_micros("due").alias("due"))
    return instants.where(F.col("last") < instant(F.lit(END))).select("user_id", utc("last").alias("last_ts"), utc("due").alias("alert_ts"))
