"""SQL twins for another engine of what it can express by comparing all pairs."""

from __future__ import annotations

from .licenses import BASE, COVERAGE, LONGER, SLACK, TEMPLATES, K

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_REACH = """reach AS (SELECT DISTINCT x AS node, x AS other FROM bidi UNION SELECT r.node, b.y FROM reach r JOIN bidi b ON b.x = r.other),
comp AS (SELECT node, min(other) AS component FROM reach GROUP BY node)"""

NEARDUP = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[\x20\x09-\x0D]+'), lambda v: v <> '') AS w FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_distinct([array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)])
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM w),
t AS MATERIALIZED (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
link AS MATERIALIZED (
  SELECT a.doc_id AS x, b.doc_id AS y FROM t a JOIN t b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id
  HAVING 100 * count(*) >= 75 * (any_value(a.n) + any_value(b.n) - count(*))),
bidi AS (SELECT x, y FROM link UNION ALL SELECT y, x FROM link),
{_REACH}
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, least(s.doc_id, coalesce(component, s.doc_id)) AS component_id, s.doc_id = least(s.doc_id, coalesce(component, s.doc_id)) AS kept
FROM s LEFT JOIN comp ON comp.node = s.doc_id
"""

EMBEDDINGS = f"""
WITH RECURSIVE v AS MATERIALIZED (
  SELECT vec_id, label, embedding::DOUBLE[] AS e, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS norm FROM embeddings
  WHERE label IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
link AS MATERIALIZED (
  SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND a.vec_id < b.vec_id AND len(a.e) = len(b.e)
  WHERE a.norm > 0 AND b.norm > 0 AND list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.93),
bidi AS (SELECT x, y FROM link UNION ALL SELECT y, x FROM link),
n AS (SELECT x, count(*) AS n FROM bidi GROUP BY x),
{_REACH}
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, least(vec_id, coalesce(component, vec_id)) AS component_id, vec_id = least(vec_id, coalesce(component, vec_id)) AS kept
FROM embeddings LEFT JOIN n ON n.x = vec_id LEFT JOIN comp ON comp.node = vec_id
"""

_LISTED = [(i, label, text, True) for i, (label, text) in enumerate(BASE)] + [(len(BASE) + i, label, text, False) for i, (label, text) in enumerate(TEMPLATES)]
_VALUES = ", ".join(f"({i}, '{label}', '{text}', {base})" for i, label, text, base in _LISTED)
_WORDS = rf"list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda v: v <> '')"
_GRAMS = f"[array_to_string(w[i:i + {K - 1}], ' ') FOR i IN range(1, len(w) - {K - 2})]"

LICENSES = f"""
WITH tw AS (SELECT template, label, base, {_WORDS} AS w FROM (VALUES {_VALUES}) t(template, label, text, base)),
tg AS (SELECT template, label, base, len(w) - {K - 1} AS n, unnest({_GRAMS}) AS gram, generate_subscripts({_GRAMS}, 1) - 1 AS tpos FROM tw),
dw AS MATERIALIZED (SELECT doc_id, {_WORDS} AS w FROM documents),
dg AS (SELECT doc_id, unnest({_GRAMS}) AS gram, generate_subscripts({_GRAMS}, 1) - 1 AS pos FROM dw WHERE len(w) >= {K}),
hits AS (SELECT doc_id, template, label, base, n, pos - tpos AS diagonal, pos, tpos FROM dg JOIN tg USING (gram)),
parted AS (
  SELECT *, CASE WHEN diagonal - lag(diagonal) OVER o > CASE WHEN base THEN 0 ELSE {SLACK} END THEN 1 ELSE 0 END AS new
  FROM (SELECT DISTINCT doc_id, template, base, diagonal FROM hits) WINDOW o AS (PARTITION BY doc_id, template ORDER BY diagonal)),
numbered AS (SELECT doc_id, template, diagonal, sum(new) OVER (PARTITION BY doc_id, template ORDER BY diagonal) AS span FROM parted),
placed AS (SELECT * FROM hits JOIN numbered USING (doc_id, template, diagonal)),
stretches AS (
  SELECT a.doc_id, a.template, a.label, a.base, a.n, a.span, a.pos AS a, max(b.pos) + {K} AS z, count(DISTINCT b.tpos) AS votes
  FROM (SELECT DISTINCT doc_id, template, label, base, n, span, pos FROM placed) a
  JOIN placed b ON a.doc_id = b.doc_id AND a.template = b.template AND a.span = b.span AND b.pos >= a.pos AND b.pos + {K} - a.pos <= {LONGER}::DOUBLE * (a.n + {K - 1})
  GROUP BY ALL),
good AS (
  SELECT * FROM stretches WHERE votes >= CASE WHEN base THEN n ELSE ceil({COVERAGE}::DOUBLE * n) END
  QUALIFY row_number() OVER (PARTITION BY doc_id, template, span ORDER BY votes DESC, a) = 1),
d AS (
  SELECT doc_id, count(*) FILTER (base) AS n_base, min(a) FILTER (base) AS f, max(a) FILTER (base) AS l,
    coalesce(array_to_string(list_sort(list(DISTINCT label) FILTER (base)), ','), '') AS bl, array_to_string(list_sort(list(DISTINCT label)), ',') AS al,
    max(votes::DOUBLE / n) AS score FROM good GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, f::BIGINT AS first_word, l::BIGINT AS last_word,
  coalesce(bl, '') AS base_labels, coalesce(al, '') AS labels, coalesce(score, 0.0)::DOUBLE AS score
FROM dw LEFT JOIN d USING (doc_id)
"""
