"""What changed between snapshots that may hold rows more than once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.time import period


def _change(before: Column, after: Column) -> Column:
    return F.when(before == 0, "gained").when(after == 0, "lost").when(after > before, "more").when(after < before, "fewer").otherwise("kept")


def counted_difference(before: DataFrame, after: DataFrame, *keys: str) -> DataFrame:
    """(keys, n_before, n_after, n_lost, n_gained, n_kept, change): one row for each distinct key of either.

    ``n_lost`` is how often the key stands in before EXCEPT ALL after,
    ``n_gained`` the other way round, ``n_kept`` in INTERSECT ALL.  Both sides are
    counted in one shuffle, partly before it, so a key that repeats very often is
    no burden.  Null keys equal each other; other columns go no further.
    """
    side = lambda df, b, a: df.select(*keys, F.lit(b).alias("b"), F.lit(a).alias("a"))
    both = side(before, 1, 0).unionByName(side(after, 0, 1)).groupBy(*keys).agg(F.sum("b").alias("n_before"), F.sum("a").alias("n_after"))
    b, a = F.col("n_before"), F.col("n_after")
    zero = F.lit(0).cast("bigint")
    return both.select(*keys, b, a, F.greatest(b - a, zero).alias("n_lost"), F.greatest(a - b, zero).alias("n_gained"), F.least(a, b).alias("n_kept"), _change(b, a).alias("change"))


def except_all(left: DataFrame, right: DataFrame, *keys: str) -> DataFrame:
    """(keys, n): what is left of each key of ``left`` after taking away as many as ``right`` has."""
    return counted_difference(left, right, *keys).where("n_lost > 0").select(*keys, F.col("n_lost").alias("n"))


def intersect_all(left: DataFrame, right: DataFrame, *keys: str) -> DataFrame:
    """(keys, n): how often each key stands in both."""
    return counted_difference(left, right, *keys).where("n_kept > 0").select(*keys, F.col("n_kept").alias("n"))


def edge_changes(edges: DataFrame, unit: str = "month") -> DataFrame:
    """(period, src, dst, n_before, n_after, change): every pair's edges in each period against the one before.

    All periods but the first are compared, periods without any edges too; what
    is in neither has no row.  Each pair's count of a period is sent to that
    period as what is there and to the next as what was before, so one more
    shuffle compares them all.  Edges without time are in no period; null ends are
    ends that equal each other.
    """
    counts = edges.where("ts IS NOT NULL").groupBy(period(unit, "ts").alias("period"), "src", "dst").agg(F.count("*").alias("n"))
    follows = F.col("period") + {"day": F.expr("INTERVAL 1 DAY"), "month": F.expr("INTERVAL 1 MONTH"), "year": F.expr("INTERVAL 1 YEAR")}[unit]
    sent = F.array(F.struct(F.col("period"), F.lit(0).cast("bigint").alias("b"), F.col("n").alias("a")), F.struct(follows.alias("period"), F.col("n").alias("b"), F.lit(0).cast("bigint").alias("a")))
    both = counts.select("src", "dst", F.explode(sent).alias("s")).groupBy("s.period", "src", "dst").agg(F.sum("s.b").alias("n_before"), F.sum("s.a").alias("n_after"))
    ends = edges.agg(period(unit, F.min("ts")).alias("first"), period(unit, F.max("ts")).alias("last"))
    within = both.join(F.broadcast(ends), (F.col("period") > F.col("first")) & (F.col("period") <= F.col("last")))
    return within.select("period", "src", "dst", "n_before", "n_after", _change(F.col("n_before"), F.col("n_after")).alias("change"))
