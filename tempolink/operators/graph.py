"""Temporal interaction graphs: building, snapshots, neighbourhoods, traversal.

An exposure is a node in an episode at a time.  Two nodes of one episode make
an edge, stored once with ``src < dst``; no self-loops; one edge for each episode.
``before`` is strict: nothing sees its own time.  The total order of a node's
edges is (ts, group_id, v).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.time import micros, period
from ..sources.scratch import Scratch
from ..sources.tables import EDGES, EXPOSURES, check
from .components import components


def exposures(lineitem: DataFrame, orders: DataFrame) -> DataFrame:
    """Distinct (group_id, node_id, ts); rows without episode or node are no exposure."""
    seen = lineitem.select(F.col("l_orderkey").alias("group_id"), F.col("l_partkey").alias("node_id")).dropna().distinct()
    when = orders.select(F.col("o_orderkey").alias("group_id"), F.col("o_orderdate").alias("ts"))
    return check(seen.join(when, "group_id").select("group_id", "node_id", "ts"), EXPOSURES, "exposures")


def pair_edges(exposed: DataFrame) -> DataFrame:
    """(group_id, src, dst, ts): all pairs of an episode's nodes.

    The join key is the episode; both sides are clustered on it by one shuffle.
    """
    a = exposed.select("group_id", F.col("node_id").alias("src"), "ts")
    b = exposed.select("group_id", F.col("node_id").alias("dst"))
    return check(a.join(b, "group_id").where("src < dst").select("group_id", "src", "dst", "ts"), EDGES, "edges")


def edge_history(edges: DataFrame) -> DataFrame:
    """Each pair's number of edges and its first and last time; edges without time count, and repeats count each."""
    return edges.groupBy("src", "dst").agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def adjacency(edges: DataFrame) -> DataFrame:
    """(u, v, ts, group_id): every edge from both ends, in one pass over the edges; nulls and repeats stay."""
    ends = F.array(F.struct(F.col("src").alias("u"), F.col("dst").alias("v")), F.struct(F.col("dst").alias("u"), F.col("src").alias("v")))
    return edges.select(F.explode(ends).alias("e"), "ts", "group_id").select("e.u", "e.v", "ts", "group_id")


def snapshots(adj: DataFrame, unit: str = "month") -> DataFrame:
    """Each node's degree in each period; edges without time count in the null period."""
    return adj.groupBy("u", period(unit, "ts").alias("period")).agg(F.count("*").alias("degree"))


def cumulative(snap: DataFrame) -> DataFrame:
    """Adds each node's degree up to and in each period; the null period comes first."""
    upto = Window.partitionBy("u").orderBy("period").rowsBetween(Window.unboundedPreceding, 0)
    return snap.withColumn("cumulative_degree", F.sum("degree").over(upto))


def degree(adj: DataFrame) -> DataFrame:
    """Each node's edges and distinct neighbours; repeated edges count each, a null neighbour is one."""
    pairs = adj.groupBy("u", "v").agg(F.count("*").alias("n"))
    return pairs.groupBy("u").agg(F.sum("n").alias("degree"), F.count("*").alias("n_neighbors"))


def gaps(adj: DataFrame, unit: str = "month") -> DataFrame:
    """Each edge end with the days since the node's previous edge; null for the first.

    Edges without time come first and have no days, nor has the next one; rows
    that repeat follow each other.  Windows hold a node's edges of one period, and
    a period's first edge gets the last time of the node's period before, so that a
    node with very many edges is many tasks.
    """
    timed = adj.withColumn("_period", period(unit, "ts"))
    order = Window.partitionBy("u", "_period").orderBy("ts", "group_id", "v")
    lasts = timed.groupBy("u", "_period").agg(F.max("ts").alias("_last"))
    before = lasts.select("u", "_period", F.lag("_last").over(Window.partitionBy("u").orderBy("_period")).alias("_before"))
    near = timed.withColumn("_near", F.lag("ts").over(order)).withColumn("_first", F.row_number().over(order) == 1)
    both = near.join(before, ["u", "_period"], "left")
    return both.select(*adj.columns, F.datediff("ts", F.when(F.col("_first"), F.col("_before")).otherwise(F.col("_near"))).alias("gap_days"))


def sliding(events: DataFrame, length: str = "7 days", step: str = "1 day") -> DataFrame:
    """Events and users of each type in each sliding window; events without time are in none, no user is none."""
    w = F.window("ts", length, step)
    counted = events.groupBy(w, "event_type", "user_id").agg(F.count("*").alias("n"))
    return counted.groupBy("window", "event_type").agg(F.sum("n").alias("n"), F.count("user_id").alias("n_users")).select(F.col("window.start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", "n_users")


def asof(left: DataFrame, right: DataFrame, by: str, ts: str, row_id: str, unit: str = "day") -> DataFrame:
    """Each left row with the last strictly earlier right row of the same key, or nulls.

    One sort of both sides replaces a join: the greatest (time, id) among right
    rows in a range that ends a microsecond before.  Of rows tied in time, the
    greatest id is the last.  A row without key or time finds nothing and isn't
    found; rows that repeat each find theirs.  A window holds a key's rows of one
    period; what is last in the periods before comes from a table with one row for
    each key and period, so a key with very many rows is many tasks.
    """
    side = lambda df, is_right: df.select(F.col(by), F.col(ts), F.col(row_id), micros(ts).alias("_t"), F.lit(is_right).alias("_right"))
    both = side(left, False).unionByName(side(right.where(F.col(by).isNotNull() & F.col(ts).isNotNull()), True)).withColumn("_period", period(unit, ts))
    found = F.max(F.when(F.col("_right"), F.struct(F.col("_t"), F.col(row_id).alias("id"), F.col(ts).alias("at"))))
    earlier = Window.partitionBy(by, "_period").orderBy("_t").rangeBetween(Window.unboundedPreceding, -1)
    periods = both.groupBy(by, "_period").agg(found.alias("_best"))
    upto = Window.partitionBy(by).orderBy("_period").rowsBetween(Window.unboundedPreceding, -1)
    carried = periods.select(by, "_period", F.max("_best").over(upto).alias("_carried"))
    out = both.withColumn("_near", found.over(earlier)).where(~F.col("_right")).join(carried, [by, "_period"], "left")
    out = out.withColumn("_last", F.coalesce("_near", "_carried"))
    return out.select(row_id, by, ts, F.col("_last.id").alias("right_id"), F.col("_last.at").alias("right_ts"))


def recent_k(adj: DataFrame, k: int = 3) -> DataFrame:
    """Each node's k most recent edges, ranked from 1; ties in time go by episode and neighbour, no time is the oldest."""
    order = Window.partitionBy("u").orderBy(F.desc("ts"), F.desc("group_id"), F.desc("v"))
    return adj.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def paths2(adj: DataFrame, horizon_days: int = 30) -> DataFrame:
    """Each node's paths u-v-w, w another node, whose second edge follows the first within the horizon.

    The time range is bucketed by the horizon, so an edge meets those of its
    own and the next bucket only, whatever the middle node's degree.  Edges
    without time or end are on no path; equal times don't follow each other.
    """
    step = horizon_days * 86_400_000_000
    timed = adj.withColumn("_t", micros("ts"))
    first = timed.select("u", F.col("v").alias("m"), F.col("_t").alias("t1"), F.explode(F.sequence(F.floor(F.col("_t") / step), F.floor((F.col("_t") + step) / step))).alias("_b"))
    second = timed.select(F.col("u").alias("m"), F.col("v").alias("w"), F.col("_t").alias("t2"), F.floor(F.col("_t") / step).alias("_b"))
    on = first.join(second, ["m", "_b"]).where((F.col("t2") > F.col("t1")) & (F.col("t2") <= F.col("t1") + step) & (F.col("w") != F.col("u")))
    return on.groupBy("u").agg(F.count("*").alias("n_paths"))


def _pairs(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(src, dst) of distinct edges, kept, with ``counts["high"]``, the id farthest from 0, and (n, d), each node's number of them."""
    scratch = Scratch(edges.sparkSession, "pairs")
    pairs = scratch.keep(edges.select("src", "dst").distinct(), high=F.max(F.greatest(F.abs("src"), F.abs("dst"))))
    return pairs, scratch.keep(pairs.select(F.explode(F.array("src", "dst")).alias("n")).groupBy("n").agg(F.count("*").alias("d")))


def _closed(pairs: DataFrame, deg: DataFrame) -> DataFrame:
    """``closed_triples`` of what ``_pairs`` gives.

    Every node's list of neighbours of higher degree is sent to each of these with
    the part that is behind it, and meets that one's own list: two edges that may
    be closed are an id in an array, never a row, before it is known that they are.
    """
    sized = pairs.join(deg.select(F.col("n").alias("src"), F.col("d").alias("ds")), "src").join(deg.select(F.col("n").alias("dst"), F.col("d").alias("dd")), "dst")
    up = (F.col("ds") < F.col("dd")) | ((F.col("ds") == F.col("dd")) & (F.col("src") < F.col("dst")))
    higher = F.when(up, F.struct(F.col("dd").alias("d"), F.col("dst").alias("n"))).otherwise(F.struct(F.col("ds").alias("d"), F.col("src").alias("n")))
    lists = sized.groupBy(F.when(up, F.col("src")).otherwise(F.col("dst")).alias("a")).agg(F.sort_array(F.collect_list(higher)).alias("l"))
    # ids take half the room where all fit
    ids = "array<int>" if (pairs.counts["high"] or 0) < 1 << 31 else "array<bigint>"
    lists = Scratch(pairs.sparkSession, "lists").keep(lists.select("a", F.col("l.n").cast(ids).alias("l")))
    sent = lists.select("a", F.posexplode("l").alias("i", "b"), "l").select("a", F.col("b").cast("bigint").alias("b"), F.slice("l", F.col("i") + 2, F.size("l")).alias("behind"))
    met = sent.where(F.size("behind") > 0).join(lists.select(F.col("a").alias("b"), F.col("l").alias("own")).hint("shuffle_hash"), "b")
    closed = met.select("a", "b", F.explode(F.array_intersect("behind", "own")).alias("c")).withColumn("c", F.col("c").cast("bigint"))
    return closed.select("a", F.least("b", "c").alias("b"), F.greatest("b", "c").alias("c"))


def closed_triples(edges: DataFrame) -> DataFrame:
    """(a, b, c), b < c: each triangle of distinct edges once.

    Edges point from the lower to the higher degree (ties by id), so no node
    has more than the root of twice the edges to pair up, hubs included.  Edges
    with a null end are in no triangle; repeats count once.
    """
    return _closed(*_pairs(edges))


def triangles(edges: DataFrame) -> DataFrame:
    """(n_triangles): triangles of distinct edges."""
    return closed_triples(edges).agg(F.count("*").alias("n_triangles"))


def common_neighbors(edges: DataFrame) -> DataFrame:
    """Each linked pair's shared neighbours and Adamic-Adar index; pairs with none are absent.

    A shared neighbour of a linked pair closes a triangle, so triangles are
    listed once and give a row to each of their three pairs.  Terms are rounded
    to a millionth before they are summed, so the sum is the same in any order.
    Degrees are those that the triangles' listing counts too.
    """
    pairs, degrees = _pairs(edges)
    deg = degrees.select(F.col("n").alias("z"), "d")
    side = lambda x, y, z: F.struct(F.least(x, y).alias("src"), F.greatest(x, y).alias("dst"), F.col(z).alias("z"))
    three = _closed(pairs, degrees).select(F.explode(F.array(side("a", "b", "c"), side("a", "c", "b"), side("b", "c", "a"))).alias("p")).select("p.*")
    term = F.round(F.lit(1e6) / F.log(F.col("d").cast("double"))).cast("bigint")
    return three.join(deg, "z").groupBy("src", "dst").agg(F.count("*").alias("n_common"), (F.sum(term) / 1e6).alias("adamic_adar"))


def component_labels(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node that each node of an edge can reach."""
    scratch = Scratch(edges.sparkSession, "components")
    found = components(edges.select(F.col("src").alias("u"), F.col("dst").alias("v")), scratch)
    return found.select(F.col("vertex").alias("node"), "component")
