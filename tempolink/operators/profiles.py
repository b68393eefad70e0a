"""Sparse feature maps from JSON whose keys aren't known beforehand."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def json_features(props: str) -> Column:
    """A map of a JSON object's keys with numeric values.

    Other values, null ones too, are no features; of a repeated key the last
    value counts; what is no JSON object has none.
    """
    entries = F.coalesce(F.from_json(props, "map<string,string>", {"mode": "PERMISSIVE"}), F.create_map().cast("map<string,string>"))
    numbers = F.transform(F.map_entries(entries), lambda e: F.struct(e["key"].alias("key"), e["value"].try_cast("double").alias("value")))
    sound = F.filter(numbers, lambda e: e["value"].isNotNull() & ~F.isnan(e["value"]))
    last = F.filter(sound, lambda e, i: ~F.exists(F.slice(sound, i + 2, F.size(sound)), lambda x: x["key"] == e["key"]))
    return F.map_from_entries(last)


def merged(rows: DataFrame, by: list[str], features: str = "features", weight: Column | None = None) -> DataFrame:
    """(by, features): the weighted sum of the maps of each group, keys in order.

    Keys are summed in millionths before they are put together, each group's and
    key's partly before the shuffle, so what meets in one place is a group's
    distinct keys.  Null maps and weights add nothing; a group without any
    feature has an empty map.
    """
    w = F.lit(1.0) if weight is None else weight
    parts = rows.select(*by, w.alias("_w"), F.explode_outer(features).alias("key", "value"))
    sums = parts.groupBy(*by, "key").agg(F.sum(F.round(F.col("value") * F.col("_w") * 1e6).cast("bigint")).alias("v"))
    listed = sums.groupBy(*by).agg(F.sort_array(F.collect_list(F.when(F.col("key").isNotNull() & F.col("v").isNotNull(), F.struct("key", (F.col("v") / F.lit(1e6)).alias("value"))))).alias("f"))
    return listed.select(*by, F.map_from_entries("f").alias("features"))


def _dot(a: Column, b: Column) -> Column:
    """The sum over the keys of both, in the order of the first."""
    return F.aggregate(F.map_entries(a), F.lit(0.0), lambda total, e: total + e["value"] * F.coalesce(F.try_element_at(b, e["key"]), F.lit(0.0)))


def cosine(a: str, b: str) -> Column:
    """Cosine of two maps; null if either is null, empty or zero."""
    x, y = F.col(a), F.col(b)
    norm = F.sqrt(_dot(x, x)) * F.sqrt(_dot(y, y))
    return F.when(norm > 0, _dot(x, y) / norm)


def drift(events: DataFrame, cut: str) -> DataFrame:
    """(user_id, n_before, n_after, cosine): how alike each user's profiles before a time and from it on are.

    A profile sums the numbers of an event's JSON by key and counts events by
    type.  Events without time or user are in none; without events on one side
    the profile is empty and the cosine null.
    """
    types = F.when(F.col("event_type").isNotNull(), F.create_map(F.concat(F.lit("type:"), "event_type"), F.lit(1.0)))
    at = F.lit(cut).cast("timestamp_ntz")
    rows = events.where("ts IS NOT NULL AND user_id IS NOT NULL").select("user_id", (F.col("ts") >= at).alias("late"), F.array(json_features("props"), types).alias("maps"))
    rows = rows.select("user_id", "late", F.explode("maps").alias("features"))
    both = merged(rows, ["user_id", "late"]).groupBy("user_id").agg(F.max_by("features", ~F.col("late")).alias("a"), F.max_by("features", "late").alias("b"), F.count_if(~F.col("late")).alias("na"), F.count_if("late").alias("nb"))
    none = F.create_map().cast("map<string,double>")
    sides = both.select("user_id", F.when(F.col("na") > 0, F.col("a")).otherwise(none).alias("a"), F.when(F.col("nb") > 0, F.col("b")).otherwise(none).alias("b"))
    return sides.select("user_id", F.size("a").alias("n_before"), F.size("b").alias("n_after"), cosine("a", "b").alias("cosine"))
