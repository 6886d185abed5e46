"""DuckDB SQL for the queries that SQL can express on whole tables."""

_OP1 = r"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS ws FROM documents),
w AS (SELECT doc_id, unnest(ws) AS w, unnest(range(len(ws))) AS p FROM d),
g AS (SELECT doc_id, p, w, string_agg(w, ' ') OVER win AS g, count(*) OVER win AS n FROM w
  WINDOW win AS (PARTITION BY doc_id ORDER BY p ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING)),
m AS (SELECT g, min(doc_id) AS least FROM g WHERE n = 13 GROUP BY g),
f AS (SELECT g.doc_id, g.p, g.w, max(CASE WHEN g.n = 13 AND m.least < g.doc_id THEN 1 ELSE 0 END)
  OVER (PARTITION BY g.doc_id ORDER BY g.p ROWS BETWEEN 12 PRECEDING AND CURRENT ROW) AS gone FROM g LEFT JOIN m USING (g)),
k AS (SELECT doc_id, sum(gone)::BIGINT AS n_removed, string_agg(w, ' ' ORDER BY p) FILTER (gone = 0) AS kept FROM f GROUP BY doc_id)
SELECT d.doc_id, len(d.ws)::BIGINT AS n_words, coalesce(k.n_removed, 0) AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)"""

_OP9 = r"""
WITH t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(13, len(ws)) AS n, array_to_string(list_slice(ws, p, p + least(13, len(ws)) - 1), ' ') AS g
  FROM (SELECT item_id, ws, unnest(range(1, len(ws) - least(13, len(ws)) + 2)) AS p FROM b WHERE len(ws) > 0)),
dw AS (SELECT doc_id, n, p, array_to_string(list_slice(ws, p, p + n - 1), ' ') AS g
  FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS p FROM t, (SELECT DISTINCT n FROM bw) WHERE len(ws) >= n)),
h AS (SELECT dw.doc_id, dw.p, dw.n, bw.item_id FROM dw JOIN bw USING (n, g)),
c AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM h) GROUP BY doc_id),
i AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM h) GROUP BY doc_id)
SELECT t.doc_id, len(t.ws)::BIGINT AS n_words, coalesce(c.n_hit, 0) AS n_hit, coalesce(i.n_items, 0) AS n_items, sha256(coalesce(i.items, '')) AS items_sha256,
  coalesce(c.n_hit, 0) > 0 AND 20 * coalesce(c.n_hit, 0) >= len(t.ws) AS contaminated FROM t LEFT JOIN c USING (doc_id) LEFT JOIN i USING (doc_id)"""

_OP10 = r"""
WITH h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, p, substring(h, 2 * p + 1, 100) AS g FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 49)) AS p FROM h WHERE length(h) >= 100)),
m AS (SELECT g, min(doc_id) AS least FROM w GROUP BY g HAVING min(doc_id) < max(doc_id)),
r AS (SELECT w.doc_id, w.p FROM w JOIN m USING (g) WHERE m.least < w.doc_id),
s AS (SELECT doc_id, p, CASE WHEN p <= lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 50 THEN 0 ELSE 1 END AS new FROM r),
n AS (SELECT doc_id, p, sum(new) OVER (PARTITION BY doc_id ORDER BY p) AS span FROM s),
x AS (SELECT doc_id, span, min(p) AS a, max(p) + 50 AS b FROM n GROUP BY 1, 2),
y AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM x),
z AS (SELECT y.doc_id, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans, string_agg(substring(h.h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS head, max(b) AS last FROM y JOIN h USING (doc_id) GROUP BY y.doc_id)
SELECT h.doc_id, length(h.h) // 2 AS n_bytes, coalesce(z.n_removed, 0) AS n_removed, coalesce(z.n_spans, 0) AS n_spans,
  sha256(unhex(coalesce(z.head, '') || substring(h.h, 2 * coalesce(z.last, 0) + 1))) AS kept_sha256 FROM h LEFT JOIN z USING (doc_id)"""

_OP8 = r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS ws FROM documents),
c AS (SELECT array_to_string(ws, ' ') AS t, min(doc_id) AS rep, count(*) AS copies, any_value(ws) AS ws FROM d WHERE len(ws) > 0 GROUP BY 1),
s AS (SELECT DISTINCT rep, array_to_string(list_slice(ws, p, p + 4), ' ') AS g FROM (SELECT rep, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS p FROM c)),
n AS (SELECT rep, count(*) AS n FROM s GROUP BY rep),
j AS (SELECT a.rep AS a, b.rep AS b, count(*) AS common FROM s a JOIN s b ON a.g = b.g AND a.rep <> b.rep GROUP BY 1, 2),
l AS MATERIALIZED (SELECT j.a, j.b FROM j JOIN n x ON x.rep = j.a JOIN n y ON y.rep = j.b WHERE 5 * j.common >= 4 * (x.n + y.n - j.common)),
r AS (SELECT a AS node, b AS reach FROM l UNION SELECT r.node, l.b FROM r JOIN l ON l.a = r.reach),
k AS (SELECT node, least(node, min(reach)) AS class_id FROM r GROUP BY node),
e AS (SELECT l.a AS rep, sum(c.copies) AS links FROM l JOIN c ON c.rep = l.b GROUP BY l.a)
SELECT d.doc_id, coalesce(k.class_id, c.rep, d.doc_id) AS class_id, (coalesce(e.links, 0) + coalesce(c.copies - 1, 0))::BIGINT AS n_links
FROM d LEFT JOIN c ON c.t = array_to_string(d.ws, ' ') AND len(d.ws) > 0 LEFT JOIN k ON k.node = c.rep LEFT JOIN e ON e.rep = c.rep"""

_OP13 = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(lang, '') AS part, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
m AS (SELECT t, min(doc_id) AS least FROM d GROUP BY t),
l AS (SELECT doc_id, max(quality) = 1 AS good, max(toxic) = 1 AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT d.part, coalesce(l.good, false) AS good, coalesce(l.toxic, false) AS toxic, len(ws) < 200 AS a, 100 * len(list_distinct(ws)) < 50 * len(ws) AS b,
  100 * len(regexp_extract_all(t, '[A-Z]')) > 3 * length(t) AS c, regexp_matches(t, '[#$%&*|]') AS d, coalesce(m.least < d.doc_id, false) AS e FROM d JOIN m USING (t) LEFT JOIN l USING (doc_id)),
x AS (SELECT *, a::INT + b::INT + c::INT + d::INT + e::INT AS k FROM f),
o AS (SELECT p.c || q.c || r.c || s.c || u.c AS o FROM (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c) p, (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c) q, (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c) r,
  (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c) s, (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c) u
  WHERE p.c <> q.c AND r.c NOT IN (p.c, q.c) AND s.c NOT IN (p.c, q.c, r.c) AND u.c NOT IN (p.c, q.c, r.c, s.c)),
y AS (SELECT part, good, toxic, k, (CASE WHEN a THEN 'A' ELSE '' END) || (CASE WHEN b THEN 'B' ELSE '' END) || (CASE WHEN c THEN 'C' ELSE '' END) || (CASE WHEN d THEN 'D' ELSE '' END) || (CASE WHEN e THEN 'E' ELSE '' END) AS fails,
  count(*) AS n FROM x GROUP BY ALL),
z AS (SELECT y.*, o.o, s.step, contains(fails, o.o[s.step]) AS own, s.step > 1 AND length(translate(fails, o.o[1:s.step - 1], '')) < length(fails) AS gone, fails = o.o[s.step] AS alone
  FROM y, o, (SELECT unnest(range(1, 6))::INT AS step) s),
g AS (SELECT part, o AS filter_order, step, sum(CASE WHEN NOT own AND NOT gone THEN n ELSE 0 END)::BIGINT AS kept, sum(CASE WHEN own AND NOT gone THEN n ELSE 0 END)::BIGINT AS removed,
  sum(CASE WHEN own AND gone THEN n ELSE 0 END)::BIGINT AS redundant, sum(CASE WHEN alone THEN n ELSE 0 END)::BIGINT AS unique_fails, sum(CASE WHEN own AND NOT gone AND good THEN n ELSE 0 END)::BIGINT AS good_lost,
  sum(CASE WHEN own AND NOT gone AND toxic THEN n ELSE 0 END)::BIGINT AS toxic_lost FROM z GROUP BY ALL)
SELECT *, (sum(removed) OVER (PARTITION BY part, filter_order[step]))::BIGINT AS shapley FROM g"""

_OP11 = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
m AS (SELECT h, max(page_id) AS top FROM p WHERE strlen(h) >= 1000 GROUP BY h)
SELECT p.page_id, strlen(p.h)::BIGINT AS payload_bytes, sha1(p.h) AS payload_digest, CASE WHEN coalesce(p.page_id < m.top, false) THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN p.page_id < m.top THEN m.top END AS refers_to FROM p LEFT JOIN m USING (h)"""

_OP12 = r"""
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS MATERIALIZED (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_sum(list_transform(list_zip(a.v, b.v), lambda z: z[1] * z[2]))::BIGINT AS score FROM e a JOIN e b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, positive_id, (row_number() OVER win)::INT AS rank, s.vec_id AS negative_id, positive_score, s.score AS negative_score FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same
  AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score
WINDOW win AS (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) QUALIFY row_number() OVER win <= 3"""

ORACLE_SQL = {"op1_de_bruijn": _OP1, "op8_minhash": _OP8, "op9_winnowing": _OP9, "op10_suffix_array": _OP10, "op11_warc": _OP11, "op12_hard_negatives": _OP12, "op13_filter_audit": _OP13}
