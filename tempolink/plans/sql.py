"""The catalogue's queries in SQL, written for another engine and apart from the DataFrame code."""

from __future__ import annotations

_EXPOSURES = "x AS (SELECT DISTINCT l_orderkey AS group_id, l_partkey AS node_id, o_orderdate AS ts FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"
_EDGES = _EXPOSURES + ", e AS (SELECT a.group_id, a.node_id AS src, b.node_id AS dst, a.ts FROM x a JOIN x b ON a.group_id = b.group_id AND a.node_id < b.node_id)"
_ADJ = _EDGES + ", adj AS (SELECT src AS u, dst AS v, ts, group_id FROM e UNION ALL SELECT dst, src, ts, group_id FROM e)"
_PRICE = ", price AS (SELECT p_partkey AS v, round(p_retailprice * 100)::BIGINT AS c FROM part WHERE p_retailprice IS NOT NULL)"
_CUT = "TIMESTAMP '2000-01-01'"
_SCORED = _EDGES + f""", nodes AS (SELECT p_partkey AS node_id FROM part),
ord AS (SELECT node_id, row_number() OVER (ORDER BY md5('neg-1:' || node_id), node_id) - 1 AS place FROM nodes),
want AS (SELECT node_id, (('0x' || substr(md5('neg-1:' || node_id || ':' || i), 1, 12))::BIGINT % (SELECT count(*) FROM nodes)) AS place FROM nodes, (VALUES (1), (2)) t(i)),
prop AS (SELECT DISTINCT least(w.node_id, o.node_id) AS src, greatest(w.node_id, o.node_id) AS dst FROM want w JOIN ord o USING (place) WHERE w.node_id <> o.node_id),
neg AS (SELECT src, dst FROM prop WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.src = prop.src AND e.dst = prop.dst)),
old AS (SELECT DISTINCT src, dst FROM e WHERE ts < {_CUT}),
pos AS (SELECT DISTINCT src, dst FROM e WHERE ts >= {_CUT} AND NOT EXISTS (SELECT 1 FROM old WHERE old.src = e.src AND old.dst = e.dst)),
deg AS (SELECT node, count(*) AS d FROM (SELECT src AS node FROM old UNION ALL SELECT dst FROM old) GROUP BY node),
sc AS (SELECT p.src, p.dst, p.label, coalesce(a.d, 0)::BIGINT AS d_src, coalesce(b.d, 0)::BIGINT AS d_dst, (coalesce(a.d, 0) * coalesce(b.d, 0))::BIGINT AS score
  FROM (SELECT *, 1 AS label FROM pos UNION ALL SELECT *, 0 FROM neg) p LEFT JOIN deg a ON a.node = p.src LEFT JOIN deg b ON b.node = p.dst)"""

# each node's component falls to the smallest of its neighbours' until none does
_COMPONENTS = f"""WITH RECURSIVE {_ADJ}, s AS MATERIALIZED (SELECT DISTINCT u, v FROM adj),
cc(node, component) USING KEY (node) AS (
  SELECT DISTINCT u, u FROM s
  UNION
  SELECT s.v, min(cc.component) FROM cc JOIN s ON s.u = cc.node JOIN recurring.cc o ON o.node = s.v WHERE cc.component < o.component GROUP BY s.v)
SELECT node, component FROM cc"""
_WALKS = f"""WITH RECURSIVE {_ADJ}, pl AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY u ORDER BY ts, group_id, v) AS place, count(*) OVER (PARTITION BY u ORDER BY ts RANGE UNBOUNDED PRECEDING) AS upto, count(*) OVER (PARTITION BY u) AS n FROM adj),
ends AS MATERIALIZED (SELECT DISTINCT u, ts, upto, n FROM pl),
w AS (
  SELECT p_partkey AS start, walk, 0 AS step, NULL::BIGINT AS u, p_partkey AS v, NULL::TIMESTAMP AS ts, NULL::BIGINT AS group_id, 0::BIGINT AS upto, n FROM part JOIN (SELECT DISTINCT u, n FROM pl) s ON s.u = p_partkey, (VALUES (1), (2)) t(walk)
  UNION ALL
  SELECT w.start, w.walk, w.step + 1, pl.u, pl.v, pl.ts, pl.group_id, e.upto, e.n
  FROM (SELECT *, ('0x' || substr(md5('walk-1:' || start || ':' || walk || ':' || (step + 1)), 1, 12))::BIGINT::DOUBLE / 281474976710656::DOUBLE AS x FROM w WHERE step < 5 AND upto < n) w
  JOIN pl ON pl.u = w.v AND pl.place = w.upto + 1 + floor(w.x * w.x * (w.n - w.upto))::BIGINT JOIN ends e ON e.u = pl.v AND e.ts = pl.ts)
SELECT start, walk, step, u, v, ts, group_id FROM w WHERE step > 0"""
_ARRIVALS = f"""WITH RECURSIVE {_ADJ}, s AS MATERIALIZED (SELECT DISTINCT u, v, ts FROM adj),
r(node, arrival, hops) USING KEY (node) AS (
  SELECT DISTINCT u, ts, 0 FROM s WHERE ts = (SELECT min(ts) FROM s)
  UNION
  SELECT s.v, min(s.ts), max(r.hops) + 1 FROM r JOIN s ON s.u = r.node AND s.ts > r.arrival LEFT JOIN recurring.r o ON o.node = s.v WHERE o.arrival IS NULL OR s.ts < o.arrival GROUP BY s.v)
SELECT node, arrival, hops FROM r"""
_CENTROIDS = """SELECT label, component::INTEGER AS component, count(*) AS n, sum(round(x::DOUBLE * 1e6)::BIGINT)::DOUBLE / count(*) / 1e6 AS mean
FROM (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS component FROM embeddings) WHERE x IS NOT NULL GROUP BY ALL"""

_SESSIONS = """g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g),
sessions AS (SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end, count(*) AS n FROM s GROUP BY user_id, k)"""

ORACLE_SQL = {
    "exposures": f"WITH {_EXPOSURES} SELECT * FROM x",
    "temporal_edges": f"WITH {_EDGES} SELECT * FROM e",
    "edge_history": f"WITH {_EDGES} SELECT src, dst, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM e GROUP BY src, dst",
    "adjacency": f"WITH {_ADJ} SELECT * FROM adj",
    "snapshot_degree": f"WITH {_ADJ} SELECT u, date_trunc('month', ts)::TIMESTAMP AS period, count(*) AS degree FROM adj GROUP BY ALL",
    "cumulative_degree": f"WITH {_ADJ}, s AS (SELECT u, date_trunc('month', ts)::TIMESTAMP AS period, count(*) AS degree FROM adj GROUP BY ALL) SELECT *, (sum(degree) OVER (PARTITION BY u ORDER BY period))::BIGINT AS cumulative_degree FROM s",
    "degree": f"WITH {_ADJ} SELECT u, count(*) AS degree, count(DISTINCT v) AS n_neighbors FROM adj GROUP BY u",
    "inter_event_gap": f"WITH {_ADJ} SELECT *, date_diff('day', lag(ts) OVER (PARTITION BY u ORDER BY ts, group_id, v), ts)::INTEGER AS gap_days FROM adj",
    "sliding_activity": "SELECT date_trunc('day', ts)::TIMESTAMP - to_days(k::INTEGER) AS window_start, event_type, count(*) AS n, count(DISTINCT user_id) AS n_users FROM events, range(7) r(k) GROUP BY ALL",
    "asof_last_view": """SELECT p.event_id, p.user_id, p.ts, w.event_id AS right_id, w.ts AS right_ts FROM (SELECT * FROM events WHERE event_type = 'purchase') p
        LEFT JOIN LATERAL (SELECT event_id, ts FROM events v WHERE v.event_type = 'view' AND v.user_id = p.user_id AND v.ts < p.ts ORDER BY ts DESC, event_id DESC LIMIT 1) w ON true""",
    "recent_neighbors": f"WITH {_ADJ} SELECT *, row_number() OVER (PARTITION BY u ORDER BY ts DESC, group_id DESC, v DESC)::INTEGER AS rank FROM adj QUALIFY rank <= 3",
    "two_hop_paths": f"WITH {_ADJ} SELECT a.u, count(*) AS n_paths FROM adj a JOIN adj b ON a.v = b.u AND b.ts > a.ts AND b.ts <= a.ts + INTERVAL 30 DAY AND b.v <> a.u GROUP BY a.u",
    "triangles": f"WITH {_EDGES}, p AS (SELECT DISTINCT src, dst FROM e) SELECT count(*) AS n_triangles FROM p a JOIN p b ON a.dst = b.src JOIN p c ON c.src = a.src AND c.dst = b.dst",
    "common_neighbors": f"""WITH {_ADJ}, p AS (SELECT DISTINCT u, v FROM adj), d AS (SELECT u AS z, count(*) AS d FROM p GROUP BY u)
        SELECT a.u AS src, a.v AS dst, count(*) AS n_common, sum(round(1e6 / ln(d.d::DOUBLE))::BIGINT)::DOUBLE / 1e6 AS adamic_adar
        FROM p a JOIN p b ON b.u = a.u JOIN p c ON c.u = a.v AND c.v = b.v JOIN d ON d.z = b.v WHERE a.u < a.v GROUP BY a.u, a.v""",
    "components": _COMPONENTS,
    "components_all": _COMPONENTS,
    "earliest_arrival": _ARRIVALS,
    "random_walks": _WALKS,
    "dangling_edges": f"WITH {_EDGES} SELECT e.*, m.missing FROM e, LATERAL (SELECT unnest([src, dst]) AS missing) m WHERE NOT EXISTS (SELECT 1 FROM embeddings WHERE vec_id = m.missing)",
    "duplicate_exposures": "SELECT l_orderkey, l_partkey, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1",
    "missing_features": "SELECT p_partkey AS node_id FROM part WHERE p_partkey NOT IN (SELECT vec_id FROM embeddings WHERE len(embedding) > 0)",
    "time_violations": "SELECT count(*) AS n_lines, count(*) FILTER (l_shipdate < o_orderdate) AS n_early FROM lineitem JOIN orders ON l_orderkey = o_orderkey",
    "profile_rollup": "SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_quantity::BIGINT)::BIGINT AS quantity, grouping(l_returnflag, l_linestatus)::BIGINT AS level FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)",
    "edge_invariants": f"""WITH {_EDGES} SELECT count(*) AS n_edges, count(*) FILTER (src = dst) AS self_loops, count(*) FILTER (src >= dst) AS wrong_order, count(*) FILTER (ts IS NULL) AS null_time,
        count(*) FILTER (ts < TIMESTAMP '1995-01-01' OR ts > TIMESTAMP '2001-12-31') AS outside FROM e""",
    "node_features": "SELECT p_partkey AS node_id, p_size AS size, round(p_retailprice * 100)::BIGINT AS price_cents, "
    + "".join(f"(p_type = '{t}')::INTEGER AS is_{t.lower()}, " for t in ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"))
    + "(p_type NOT IN ('ECONOMY', 'LARGE', 'MEDIUM', 'PROMO', 'SMALL', 'STANDARD'))::INTEGER AS is_other FROM part",
    "node_features_all": "SELECT p_partkey AS node_id, p_size AS size, round(p_retailprice * 100)::BIGINT AS price_cents, "
    + ", ".join(f"(p_type = '{t}')::INTEGER AS is_{t.lower()}" for t in ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD")) + " FROM part",
    "sparse_node_features": """SELECT * FROM (SELECT p_partkey AS node_id, 'size' AS feature, p_size::BIGINT AS value FROM part
        UNION ALL SELECT p_partkey, 'price_cents', round(p_retailprice * 100)::BIGINT FROM part UNION ALL SELECT p_partkey, 'is_' || replace(lower(p_type), ' ', '_'), 1 FROM part)
        WHERE feature IS NOT NULL AND value IS NOT NULL""",
    "class_centroid": _CENTROIDS,
    "class_centroid_all": _CENTROIDS,
    "event_attributes": "SELECT event_id, (props->>'$.k')::BIGINT AS k, hour(ts)::INTEGER AS hour, round(sin(hour(ts) * (2 * pi() / 24)), 9) + 0.0 AS hour_sin, round(cos(hour(ts) * (2 * pi() / 24)), 9) + 0.0 AS hour_cos FROM events",
    "mean_message": f"WITH {_ADJ}{_PRICE} SELECT u, count(*) AS n, sum(c)::DOUBLE / count(*) AS mean_price_cents FROM adj JOIN price USING (v) GROUP BY u",
    "decayed_message": f"""WITH {_ADJ}{_PRICE}, a AS (SELECT u, c, (epoch_us(TIMESTAMP '2002-01-01') - epoch_us(ts)) / 86400000000.0::DOUBLE / 365.0::DOUBLE AS age FROM adj JOIN price USING (v) WHERE ts IS NOT NULL),
        m AS (SELECT u, floor(age)::BIGINT AS step, c, round(exp(floor(age) - age) * 1e9)::BIGINT AS w FROM a),
        k AS (SELECT u, step, sum(w)::BIGINT::DOUBLE AS w, sum(w * c)::BIGINT::DOUBLE AS s FROM m GROUP BY u, step),
        f AS (SELECT *, round(exp((min(step) OVER (PARTITION BY u) - step)::DOUBLE) * 1e9) / 1e9 AS f FROM k)
        SELECT u, list_reduce(list(s * f ORDER BY step), lambda a, x: a + x) / list_reduce(list(w * f ORDER BY step), lambda a, x: a + x) AS decayed_price_cents FROM f GROUP BY u""",
    "chrono_split": f"WITH {_EDGES} SELECT CASE WHEN ts < {_CUT} THEN 'train' WHEN ts >= {_CUT} THEN 'test' END AS fold, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM e GROUP BY 1",
    "negative_samples": f"WITH {_SCORED} SELECT src, dst FROM neg",
    "link_scores": f"WITH {_SCORED} SELECT * FROM sc",
    "auc": f"""WITH {_SCORED}, pairs AS (SELECT sum(CASE WHEN a.score > b.score THEN 2 WHEN a.score = b.score THEN 1 ELSE 0 END * a.n * b.n)::DOUBLE AS h
        FROM (SELECT score, count(*) AS n FROM sc WHERE label = 1 GROUP BY score) a, (SELECT score, count(*) AS n FROM sc WHERE label = 0 GROUP BY score) b)
        SELECT count(*) FILTER (label = 1) AS n_pos, count(*) FILTER (label = 0) AS n_neg, (SELECT h FROM pairs) / (2.0::DOUBLE * count(*) FILTER (label = 1) * count(*) FILTER (label = 0)) AS auc FROM sc""",
    "hits_at_k": f"""WITH {_SCORED}, r AS (SELECT src, label, rank() OVER (PARTITION BY src ORDER BY score DESC) AS k FROM sc),
        s AS (SELECT src, max(CASE WHEN k <= 10 THEN label ELSE 0 END) AS hit FROM r GROUP BY src HAVING max(label) = 1)
        SELECT count(*) AS n_sources, sum(hit)::BIGINT AS n_hits, sum(hit)::DOUBLE / count(*) AS hit_rate FROM s""",
    "occlusion": f"""WITH {_ADJ}{_PRICE}, p AS (SELECT u, v, count(*) AS n, sum(c) AS s FROM adj JOIN price USING (v) GROUP BY u, v), t AS (SELECT u, sum(n)::BIGINT AS n, sum(s)::BIGINT AS s FROM p GROUP BY u)
        SELECT p.u, p.v, t.s::DOUBLE / t.n - CASE WHEN t.n > p.n THEN (t.s - p.s)::DOUBLE / (t.n - p.n) END AS change FROM p JOIN t USING (u)""",
    "stream_tumbling": "SELECT date_trunc('day', ts)::TIMESTAMP AS window_start, event_type, count(*) AS n FROM events GROUP BY ALL",
    "stream_session": f"WITH {_SESSIONS} SELECT * FROM sessions",
    "overlapping_sessions": f"""WITH {_SESSIONS} SELECT a.user_id AS user_a, b.user_id AS user_b, count(*) AS n_overlaps,
        sum(epoch_us(least(a.session_end, b.session_end)) - epoch_us(greatest(a.session_start, b.session_start)))::BIGINT AS micros
        FROM sessions a JOIN sessions b ON a.user_id < b.user_id AND a.session_start <= b.session_end AND b.session_start <= a.session_end GROUP BY ALL""",
    "edge_changes": f"""WITH {_EDGES}, c AS (SELECT date_trunc('month', ts)::TIMESTAMP AS period, src, dst, count(*) AS n FROM e GROUP BY ALL),
        d AS (SELECT coalesce(a.period, b.period + INTERVAL 1 MONTH) AS period, coalesce(a.src, b.src) AS src, coalesce(a.dst, b.dst) AS dst, coalesce(b.n, 0) AS n_before, coalesce(a.n, 0) AS n_after
          FROM c a FULL JOIN c b ON a.src = b.src AND a.dst = b.dst AND a.period = b.period + INTERVAL 1 MONTH)
        SELECT *, CASE WHEN n_before = 0 THEN 'gained' WHEN n_after = 0 THEN 'lost' WHEN n_after > n_before THEN 'more' WHEN n_after < n_before THEN 'fewer' ELSE 'kept' END AS change
        FROM d WHERE period > (SELECT min(period) FROM c) AND period <= (SELECT max(period) FROM c)""",
    "profile_drift": """WITH f AS (
          SELECT user_id, ts >= TIMESTAMP '2024-01-16' AS late, 'type:' || event_type AS key, 1.0::DOUBLE AS value FROM events
          UNION ALL SELECT user_id, late, key, try_cast(json_extract_string(props, '$."' || key || '"') AS DOUBLE) FROM (SELECT user_id, ts >= TIMESTAMP '2024-01-16' AS late, props, unnest(json_keys(props)) AS key FROM events)),
        p AS (SELECT user_id, key, coalesce(sum(round(value * 1e6)::BIGINT) FILTER (NOT late), 0)::BIGINT::DOUBLE / 1e6 AS a, coalesce(sum(round(value * 1e6)::BIGINT) FILTER (late), 0)::BIGINT::DOUBLE / 1e6 AS b,
          count(*) FILTER (NOT late) > 0 AS in_a, count(*) FILTER (late) > 0 AS in_b FROM f WHERE value IS NOT NULL GROUP BY user_id, key),
        d AS (SELECT user_id, count(*) FILTER (in_a)::INTEGER AS n_before, count(*) FILTER (in_b)::INTEGER AS n_after, list_reduce(list(a * b ORDER BY key), lambda x, y: x + y) AS ab,
          sqrt(list_reduce(list(a * a ORDER BY key), lambda x, y: x + y)) * sqrt(list_reduce(list(b * b ORDER BY key), lambda x, y: x + y)) AS norm FROM p GROUP BY user_id)
        SELECT user_id, n_before, n_after, CASE WHEN norm > 0 THEN ab / norm END AS cosine FROM d""",
    "stream_silent_users": """SELECT user_id, ts AS last_ts, ts + INTERVAL 24 HOUR AS alert_ts
        FROM (SELECT user_id, ts, lead(ts) OVER (PARTITION BY user_id ORDER BY ts) AS next FROM (SELECT DISTINCT user_id, ts FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL))
        WHERE next IS NULL OR next > ts + INTERVAL 24 HOUR""",
    "stream_views_before": """SELECT p.event_id, p.user_id, p.ts, v.event_id AS view_id, v.ts AS view_ts FROM (SELECT * FROM events WHERE event_type = 'purchase' AND ts IS NOT NULL) p
        LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') v ON v.user_id = p.user_id AND v.ts < p.ts AND v.ts >= p.ts - INTERVAL 30 MINUTE""",
    "stream_dedup": "SELECT DISTINCT event_id, ts, user_id, event_type FROM events",
}
