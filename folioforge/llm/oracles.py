"""SQL (DuckDB) for the rows of corpus queries that SQL can express, in tables of a test's size."""

OP2_SQL = """
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g
      FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n na ON na.doc_id = x JOIN n nb ON nb.doc_id = y WHERE 100 * k >= 75 * (na.n + nb.n - k)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, e.y FROM r JOIN e ON r.b = e.x),
c AS (SELECT a, min(b) AS component_id FROM r GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN c ON c.a = d.doc_id
"""

OP6_SQL = """
WITH s AS (SELECT doc_id, coalesce(text, '') AS text, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(range(len(ls))) AS line_no, unnest(ls) AS line FROM s),
t AS (SELECT DISTINCT doc_id, line_no, w
      FROM (SELECT doc_id, line_no, unnest(regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+')) AS w FROM l)),
n AS (SELECT doc_id, line_no, count(*) AS n, string_agg(w, ' ' ORDER BY w) AS key FROM t GROUP BY ALL HAVING count(*) >= 5),
k AS (SELECT key, n, min({'d': doc_id, 'l': line_no}) AS f FROM n GROUP BY ALL),
ct AS (SELECT key, n, f, unnest(string_split(key, ' ')) AS w FROM k),
df AS (SELECT w, count(*) AS c FROM ct GROUP BY 1),
pr AS (SELECT key, n, f, w FROM (SELECT ct.*, row_number() OVER (PARTITION BY key ORDER BY c, w) AS rk FROM ct JOIN df USING (w))
       WHERE rk <= n - (n * 90 + 99) // 100 + 1),
cand AS (SELECT DISTINCT a.key AS ka, b.key AS kb FROM pr a JOIN pr b ON a.w = b.w AND a.f < b.f
         AND 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n)),
sim AS (SELECT DISTINCT kb FROM (SELECT ka, kb FROM cand JOIN ct a ON a.key = ka JOIN ct b ON b.key = kb AND a.w = b.w
        GROUP BY ka, kb, a.n, b.n HAVING 190 * count(*) >= 90 * (a.n + b.n))),
gone AS (SELECT n.doc_id, n.line_no FROM n JOIN k USING (key) LEFT JOIN sim ON sim.kb = n.key
         WHERE sim.kb IS NOT NULL OR n.doc_id > k.f.d OR (n.doc_id = k.f.d AND n.line_no > k.f.l)),
g AS (SELECT doc_id, count(*) AS n_removed, string_agg(line_no, ',' ORDER BY line_no) AS removed FROM gone GROUP BY 1)
SELECT s.doc_id, CASE WHEN s.text = '' THEN 0 ELSE len(s.ls) END AS n_lines, coalesce(g.n_removed, 0) AS n_removed, coalesce(g.removed, '') AS removed
FROM s LEFT JOIN g USING (doc_id)
"""

OP10_SQL = """
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[0-9a-z\\x{80}-\\x{10FFFF}]+') AS w
  FROM documents),
b AS (
  SELECT item_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[0-9a-z\\x{80}-\\x{10FFFF}]+') AS w
  FROM benchmark),
bp AS (SELECT item_id, w, least(len(w), 10) AS m, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, m, array_to_string(w[i:i + m - 1], ' ') AS g FROM bp),
dp AS (SELECT rid, w, m, unnest(range(1, len(w) - m + 2)) AS i
       FROM d CROSS JOIN (SELECT DISTINCT m FROM win) WHERE len(w) >= m),
occ AS (SELECT DISTINCT dp.rid, dp.i, dp.m, win.item_id
        FROM dp JOIN win ON win.m = dp.m AND win.g = array_to_string(dp.w[dp.i:dp.i + dp.m - 1], ' ')),
hit AS (SELECT rid, count(DISTINCT p) AS n_hit
        FROM (SELECT rid, unnest(range(i, i + m)) AS p FROM (SELECT DISTINCT rid, i, m FROM occ)) GROUP BY rid),
its AS (SELECT rid, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
        FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS item_id FROM occ WHERE item_id IS NOT NULL) GROUP BY rid)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(hit.n_hit, 0) AS n_hit, coalesce(its.n_items, 0) AS n_items,
       sha256(coalesce(its.ids, '')) AS items_sha256, coalesce(hit.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (rid) LEFT JOIN its USING (rid)
"""
