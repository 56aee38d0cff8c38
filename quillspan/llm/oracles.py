"""DuckDB SQL for the rows of op2 and op5: all pairs that share a shingle, and windows joined as texts."""

from __future__ import annotations

import string

_LOWER = f"translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}')"

NEAR_SQL = rf"""
WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS MATERIALIZED (SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(len(w) - 4), lambda i: array_to_string(w[i + 1:i + 5], ' ')) END)) AS g FROM d),
h AS MATERIALIZED (SELECT doc_id, len(g) AS n, g, md5(array_to_string(g, chr(10))) AS k FROM s),
reps AS MATERIALIZED (SELECT k, min(doc_id) AS r, any_value(g) AS g, any_value(n) AS n FROM h WHERE n > 0 GROUP BY k),
x AS MATERIALIZED (SELECT r, n, unnest(g) AS g FROM reps),
p AS (SELECT a.r AS a, b.r AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS c FROM x AS a JOIN x AS b ON a.g = b.g AND a.r < b.r GROUP BY a.r, b.r),
links AS MATERIALIZED (SELECT a, b FROM p WHERE 100 * c >= 75 * (na + nb - c)),
edges AS MATERIALIZED (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT r AS node, r AS root FROM reps UNION SELECT e.b, reach.root FROM reach JOIN edges AS e ON e.a = reach.node),
comp AS (SELECT node, min(root) AS least FROM reach GROUP BY node)
SELECT doc_id, h.n::BIGINT AS n_shingles, coalesce(least, doc_id) AS component_id, coalesce(least, doc_id) = doc_id AS kept
FROM h LEFT JOIN reps ON h.k = reps.k AND h.n > 0 LEFT JOIN comp ON comp.node = reps.r
"""

LEAKS_SQL = rf"""
WITH d AS MATERIALIZED (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS MATERIALIZED (
    SELECT DISTINCT item_id, l, array_to_string(w[i + 1:i + l], ' ') AS g
    FROM (SELECT item_id, w, l, unnest(range(len(w) - l + 1)) AS i FROM (SELECT item_id, w, least(len(w), 10) AS l FROM b WHERE len(w) > 0) y) z),
dw AS (SELECT doc_id, l, i, array_to_string(w[i + 1:i + l], ' ') AS g FROM (SELECT doc_id, w, l, unnest(range(len(w) - l + 1)) AS i FROM d, (SELECT DISTINCT l FROM bw) AS sizes WHERE len(w) >= l) z),
hits AS MATERIALIZED (SELECT doc_id, i, l, item_id FROM dw JOIN bw USING (l, g)),
covered AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + l)) AS place FROM hits) c GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS digest FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits) n GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, coalesce(digest, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)
"""
