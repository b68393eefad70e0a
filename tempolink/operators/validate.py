"""Checks of graph structure, features and time order.

Each returns the faults it finds; on clean data all are empty or zero.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def dangling_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(group_id, src, dst, ts, missing): edge ends that are no node, null ends too; an edge has a row for each such end, repeats have theirs."""
    known = nodes.select(F.col("node_id").alias("missing"))
    ends = edges.select("*", F.explode(F.array("src", "dst")).alias("missing"))
    return ends.join(known, "missing", "left_anti").select("group_id", "src", "dst", "ts", "missing")


def duplicate_exposures(raw: DataFrame, *key: str) -> DataFrame:
    """Raw keys that occur more than once, and how often; null keys equal each other."""
    return raw.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def missing_features(nodes: DataFrame, features: DataFrame, vector: str = "embedding") -> DataFrame:
    """(node_id): nodes without a feature vector that has values; a node without id has none, repeated nodes stay."""
    usable = features.where(F.col(vector).isNotNull() & (F.size(vector) > 0)).select("node_id")
    return nodes.select("node_id").join(usable, "node_id", "left_anti")


def time_violations(lineitem: DataFrame, orders: DataFrame) -> DataFrame:
    """One row: lines, and those shipped before they were ordered; without both times a line isn't early, without its order it doesn't count."""
    both = lineitem.select("l_orderkey", "l_shipdate").join(orders.select("o_orderkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey"))
    return both.agg(F.count("*").alias("n_lines"), F.count_if(F.col("l_shipdate") < F.col("o_orderdate")).alias("n_early"))


def profile_rollup(lineitem: DataFrame) -> DataFrame:
    """Lines by return flag and status, with totals of each flag and of all; ``level`` tells totals from null flags, null quantities add nothing."""
    out = lineitem.rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.sum(F.col("l_quantity").cast("bigint")).alias("quantity"), F.grouping_id().cast("bigint").alias("level"))
    return out


def edge_invariants(edges: DataFrame, first: str, last: str) -> DataFrame:
    """One row: self-loops, wrong order, missing times, times outside [first, last]; a null end is in no order, a null time is missing only."""
    outside = (F.col("ts") < F.lit(first).cast("timestamp_ntz")) | (F.col("ts") > F.lit(last).cast("timestamp_ntz"))
    return edges.agg(
        F.count("*").alias("n_edges"),
        F.count_if(F.col("src") == F.col("dst")).alias("self_loops"),
        F.count_if(F.col("src") >= F.col("dst")).alias("wrong_order"),
        F.count_if(F.col("ts").isNull()).alias("null_time"),
        F.count_if(outside).alias("outside"),
    )
