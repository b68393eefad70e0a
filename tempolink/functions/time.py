"""Column helpers for event time."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


EPOCH = "TIMESTAMP_NTZ '1970-01-01 00:00:00'"


def micros(ts: Column | str) -> Column:
    """Microseconds from 1970 to a timestamp without zone, whatever the session's zone."""
    ts = (F.col(ts) if isinstance(ts, str) else ts).cast("timestamp_ntz")
    return ((ts - F.expr(EPOCH)).cast("interval second").cast("decimal(20,6)") * 1_000_000).cast("bigint")


def period(unit: str, ts: Column | str) -> Column:
    """Start of the unit (second to year) that holds the time without zone, again without zone."""
    ts = (F.col(ts) if isinstance(ts, str) else ts).cast("timestamp_ntz")
    size = {"second": 1, "minute": 60, "hour": 3600}.get(unit)
    if size is None:
        day = ts.cast("date")
        return (day if unit == "day" else F.trunc(day, unit)).cast("timestamp_ntz")
    start = F.floor(micros(ts) / (size * 1_000_000)) * size
    return F.expr(EPOCH) + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), start.cast("decimal(18,6)"))


def instant(ts: Column | str) -> Column:
    """A time without zone as the instant at which UTC shows it, whatever the session's zone."""
    return F.timestamp_micros(micros(ts))


def utc(at: Column | str) -> Column:
    """What UTC shows at an instant, as a time without zone."""
    seconds = (F.unix_micros(at).cast("decimal(20,0)") / 1_000_000).cast("decimal(18,6)")
    return F.expr(EPOCH) + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds)


def cents(amount: Column | str) -> Column:
    """An amount as whole cents, so that sums are exact."""
    amount = F.col(amount) if isinstance(amount, str) else amount
    return F.round(amount * 100).cast("bigint")
