"""Registered queries over the given tables: one for each operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import changes, features, graph, learn, overlap, profiles, rollups, temporal, traverse, validate
from ..sources.scratch import Scratch
from ..sources.tables import table
from ..streaming import alerts, joins, windows

#: Exposures of a bucket of the tables that models read.
BUCKET = 1 << 17
CUT = "2000-01-01"
#: Models learn from what is new between this and the cut, by what came before.
START = "1999-01-01"
NOW = "2002-01-01"
#: The part types that have a column each; any other one is marked as such.
TYPES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]


def _exposures(spark, d):
    return graph.exposures(table(spark, d, "lineitem"), table(spark, d, "orders"))


def _edges(spark, d):
    return graph.pair_edges(_exposures(spark, d))


def _adj(spark, d):
    return graph.adjacency(_edges(spark, d))


def _nodes(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("node_id"))


def _part_features(spark, d):
    return features.node_features(table(spark, d, "part"), [])


def _vectors(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("node_id"), "embedding")


def _asof(spark, d):
    events = table(spark, d, "events")
    kind = lambda k: events.where(F.col("event_type") == k)
    return graph.asof(kind("purchase"), kind("view"), "user_id", "ts", "event_id")


def _components_all(spark, d):
    return graph.component_labels(_edges(spark, d))


def _firsts(spark, d):
    """First links, kept: held-out pairs, degrees and negatives all follow from them."""
    return Scratch(spark, "firsts").keep(learn.first_links(_edges(spark, d)))


def _scored_of(spark, d, firsts):
    pairs = learn.new_pairs(firsts, learn.negative_samples(firsts, _nodes(spark, d)), CUT)
    return learn.link_scores(pairs, learn.degrees_before(firsts, CUT))


def _scored(spark, d):
    return _scored_of(spark, d, _firsts(spark, d))


def _trained(spark, d, firsts):
    """A model of pairs first linked in the year before the cut, by what came before that year."""
    pairs = learn.new_pairs(firsts, learn.negative_samples(firsts, _nodes(spark, d), seed="neg-2"), START, CUT)
    return learn.train_link_model(learn.pair_features(learn.link_scores(pairs, learn.degrees_before(firsts, START))))


def _by_model(use):
    def query(spark, d):
        firsts = _firsts(spark, d)
        return use(_trained(spark, d, firsts), learn.pair_features(_scored_of(spark, d, firsts)))

    return query


def _temporal(use):
    """A model of all that is new before the cut, by states of the start; then ``use`` on it, all pairs new from the cut on, and states of the cut."""

    def query(spark, d):
        scratch = Scratch(spark, "temporal")
        # dealt by group and by pair once, as joins and sums by these follow
        buckets = 1 + table(spark, d, "lineitem").count() // BUCKET
        exposed = scratch.keep_dealt(_exposures(spark, d).repartition(buckets, "group_id"), buckets, "group_id")
        edges = graph.pair_edges(exposed).select("src", "dst", "ts").repartition(buckets, "src", "dst")
        firsts = scratch.keep_dealt(learn.first_links(edges), buckets, "src", "dst")
        x = features.node_features(table(spark, d, "part"), TYPES)
        start, now = temporal.states_of_groups(exposed, x, START, CUT)
        scratch.drop(exposed)
        seen = learn.new_pairs(firsts, learn.negative_samples(firsts, _nodes(spark, d), seed="neg-2"), START, CUT)
        model = temporal.fit(temporal.with_states(seen, start, temporal.width(len(x.columns) - 1)), len(x.columns) - 1)
        pairs = learn.new_pairs(firsts, learn.negative_samples(firsts, _nodes(spark, d)), CUT)
        return use(model, pairs, now, firsts)

    return query


def _temporal_auc(model, pairs, states, firsts):
    """The trained model's AUC beside the degree product's, on the same pairs, kept."""
    pairs = Scratch(firsts.sparkSession, "pairs").keep(pairs)
    scored = {"degree product": learn.link_scores(pairs, learn.degrees_before(firsts, CUT)), "temporal": temporal.predict_from(model, pairs, states)}
    rows = [learn.auc(s.withColumn("score", F.col("score").cast("double"))).select(F.lit(name).alias("model"), "n_pos", "n_neg", "auc") for name, s in scored.items()]
    return rows[0].unionByName(rows[1])


def _arrivals(spark, d):
    """From all nodes of the first episodes."""
    adj = Scratch(spark, "adjacency").keep(_adj(spark, d))
    first = adj.agg(F.min("ts").alias("ts"))
    sources = adj.select(F.col("u").alias("node"), "ts").join(F.broadcast(first), "ts").distinct()
    return traverse.earliest_arrival(adj, sources)


def _walks(spark, d):
    return traverse.random_walks(_adj(spark, d), _nodes(spark, d).select(F.col("node_id").alias("node")), per_node=2)


def _split(spark, d):
    return learn.chrono_split(_edges(spark, d), CUT).groupBy("fold").agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def _views_before(spark, d):
    return joins.Drained(spark, ["purchase", "view"]).finish(windows.event_stream(spark, d), joins.views_before)


def _silent_users(spark, d):
    with alerts.keyed_state(spark):
        return joins.Drained(spark, ["close"]).finish(windows.event_stream(spark, d), alerts.silent_users)


def _stream(of):
    return lambda spark, d: windows.drain(spark, of(windows.event_stream(spark, d)))


def _whole_stream(of):
    return lambda spark, d: windows.drain_whole(spark, of(windows.event_stream(spark, d), delay=None))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "exposures": _exposures,
    "temporal_edges": _edges,
    "edge_history": lambda s, d: graph.edge_history(_edges(s, d)),
    "adjacency": _adj,
    "snapshot_degree": lambda s, d: graph.snapshots(_adj(s, d)),
    "cumulative_degree": lambda s, d: graph.cumulative(graph.snapshots(_adj(s, d))),
    "degree": lambda s, d: graph.degree(_adj(s, d)),
    "inter_event_gap": lambda s, d: graph.gaps(_adj(s, d)),
    "sliding_activity": lambda s, d: graph.sliding(table(s, d, "events")),
    "asof_last_view": _asof,
    "recent_neighbors": lambda s, d: graph.recent_k(_adj(s, d)),
    "two_hop_paths": lambda s, d: graph.paths2(_adj(s, d)),
    "triangles": lambda s, d: graph.triangles(_edges(s, d)),
    "common_neighbors": lambda s, d: graph.common_neighbors(_edges(s, d)),
    "components": _components_all,
    "components_all": _components_all,
    "earliest_arrival": _arrivals,
    "random_walks": _walks,
    "dangling_edges": lambda s, d: validate.dangling_edges(_edges(s, d), _vectors(s, d)),
    "duplicate_exposures": lambda s, d: validate.duplicate_exposures(table(s, d, "lineitem"), "l_orderkey", "l_partkey"),
    "missing_features": lambda s, d: validate.missing_features(_nodes(s, d), _vectors(s, d)),
    "time_violations": lambda s, d: validate.time_violations(table(s, d, "lineitem"), table(s, d, "orders")),
    "profile_rollup": lambda s, d: validate.profile_rollup(table(s, d, "lineitem")),
    "edge_invariants": lambda s, d: validate.edge_invariants(_edges(s, d), "1995-01-01", "2001-12-31"),
    "node_features": lambda s, d: features.node_features(table(s, d, "part"), TYPES),
    "node_features_all": lambda s, d: features.node_features(table(s, d, "part"), TYPES).drop("is_other"),
    "sparse_node_features": lambda s, d: features.sparse_features(table(s, d, "part")),
    "class_centroid": lambda s, d: features.class_centroids(table(s, d, "embeddings")),
    "class_centroid_all": lambda s, d: features.class_centroids(table(s, d, "embeddings")),
    "event_attributes": lambda s, d: features.event_attributes(table(s, d, "events")),
    "mean_message": lambda s, d: features.mean_message(_adj(s, d), _part_features(s, d)),
    "decayed_message": lambda s, d: features.decayed_message(_adj(s, d), _part_features(s, d), NOW),
    "chrono_split": _split,
    "negative_samples": lambda s, d: learn.negative_samples(_edges(s, d), _nodes(s, d)),
    "link_scores": _scored,
    "train_link_model": _by_model(learn.predict_links),
    "auc": lambda s, d: learn.auc(_scored(s, d)),
    "hits_at_k": lambda s, d: learn.hits_at_k(_scored(s, d)),
    "linear_attribution": _by_model(learn.linear_attribution),
    "temporal_model": _temporal(lambda model, pairs, states, _: temporal.predict_from(model, pairs, states)),
    "temporal_auc": _temporal(_temporal_auc),
    "explain_links": _temporal(lambda model, pairs, states, _: temporal.explain_ages(model, temporal.with_states(pairs, states, temporal.width(model.n_features)))),
    "occlusion": lambda s, d: learn.occlusion(_adj(s, d), _part_features(s, d)),
    "profile_drift": lambda s, d: profiles.drift(table(s, d, "events"), "2024-01-16"),
    "activity_rollup": lambda s, d: rollups.rolled(rollups.stored(table(s, d, "events"))),
    "overlapping_sessions": lambda s, d: overlap.together(overlap.user_sessions(table(s, d, "events"))),
    "edge_changes": lambda s, d: changes.edge_changes(_edges(s, d)),
    "stream_views_before": _views_before,
    "stream_silent_users": _silent_users,
    "stream_tumbling": _whole_stream(windows.tumbling),
    "stream_session": _whole_stream(windows.sessions),
    "stream_dedup": _stream(windows.deduplicated),
}


