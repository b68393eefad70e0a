"""Totals of any level from stored sketches, which merge where distinct counts and quantiles don't.

One pass over the events stores, for each day and type, a count, a distinct-count
sketch of users (HyperLogLog, about 1.6 % error) and a quantile sketch of values
(KLL, about 1.3 % of rank).  Every coarser level is merged from these few rows;
no event is read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.time import period

#: Logarithm of the registers of a distinct count, and size of a quantile sketch: each is some kilobytes at most.
LG_K, KLL_K = 12, 200


def stored(events: DataFrame, unit: str = "day") -> DataFrame:
    """(period, event_type, n, users, values): a row of sketches for each period and type, null ones too.

    Null users and values are in no sketch, their events count; repeats count each.
    """
    value = F.when(~F.isnan("value"), F.col("value"))
    return events.groupBy(period(unit, "ts").alias("period"), "event_type").agg(F.count("*").alias("n"), F.hll_sketch_agg("user_id", LG_K).alias("users"), F.kll_sketch_agg_double(value, KLL_K).alias("values"))


def rolled(sketches: DataFrame, *levels: list[str]) -> DataFrame:
    """(period, event_type, level, n, n_users, median): one row for each group of each level, from stored rows of whatever times and sources.

    ``levels`` are lists of ``period`` and ``event_type``; by default all four.  ``level`` has a
    bit for what is summed over: 2 the period, 1 the type.  No values, no median.
    """
    sets = [list(x) for x in levels] or [["period", "event_type"], ["period"], ["event_type"], []]
    merged = sketches.groupingSets(sets, "period", "event_type").agg(
        F.grouping_id().cast("bigint").alias("level"), F.sum("n").alias("n"), F.hll_union_agg("users").alias("users"), F.kll_merge_agg_double("values").alias("values")
    )
    known = F.kll_sketch_get_n_double("values") > 0
    return merged.select("period", "event_type", "level", "n", F.hll_sketch_estimate("users").alias("n_users"), F.when(known, F.kll_sketch_get_quantile_double("values", F.lit(0.5))).alias("median"))
