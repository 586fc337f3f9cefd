"""The same questions in DuckDB's SQL, for the operators that SQL can state."""

from __future__ import annotations

SPLIT = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"

ORACLE_OP2 = f"""
WITH d AS (SELECT doc_id, {SPLIT} AS w FROM documents),
t AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS i, len(w) AS n FROM d),
g AS (
  SELECT doc_id, i, x, CASE WHEN i + 19 <= n THEN md5(string_agg(x, ' ') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING)) END AS k FROM t
),
f AS (SELECT *, k IS NOT NULL AND row_number() OVER (PARTITION BY k ORDER BY doc_id, i) > 1 AS late FROM g),
c AS (SELECT doc_id, i, x, bool_or(late) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS gone FROM f),
s AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, string_agg(x, ' ' ORDER BY i) FILTER (NOT gone) AS kept FROM c GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN s USING (doc_id)
"""

ORACLE_OP4 = f"""
WITH RECURSIVE d AS (SELECT doc_id, md5(coalesce(text, '')) AS k, {SPLIT} AS w FROM documents),
reps AS (SELECT k, min(doc_id) AS id, count(*) AS n_copies FROM d GROUP BY k),
t AS (SELECT doc_id AS id, unnest(w) AS x, generate_subscripts(w, 1) AS i, len(w) AS n FROM d WHERE doc_id IN (SELECT id FROM reps)),
g AS (SELECT id, i, n, concat_ws(' ', x, lead(x, 1) OVER o, lead(x, 2) OVER o, lead(x, 3) OVER o, lead(x, 4) OVER o) AS s FROM t WINDOW o AS (PARTITION BY id ORDER BY i)),
s AS (SELECT DISTINCT id, s FROM g WHERE i + 4 <= n OR (n < 5 AND i = 1)),
c AS (SELECT id, count(*) AS n FROM s GROUP BY id),
p AS (SELECT a.id AS a, b.id AS b, count(*) AS n FROM s a JOIN s b ON a.s = b.s AND a.id < b.id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN c x ON x.id = a JOIN c y ON y.id = b WHERE p.n >= 0.8 * (x.n + y.n - p.n)),
two AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT id, id AS root FROM reps UNION SELECT two.b, r.root FROM r JOIN two ON two.a = r.id),
l AS (SELECT id, min(root) AS class_id FROM r GROUP BY id)
SELECT doc_id, class_id, doc_id = class_id AS is_first, n_copies FROM d JOIN reps USING (k) JOIN l ON l.id = reps.id
"""

LETTERS = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'"

ORACLE_OP6 = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS h FROM pages),
g AS (SELECT page_id, string_agg(l, '' ORDER BY i, j) AS payload_digest FROM (
  SELECT page_id, i, j, substr({LETTERS}, ((CAST('0x' || substr(h, i * 5 + 1, 5) AS INT) >> (15 - 5 * j)) & 31) + 1, 1) AS l FROM p, range(8) a(i), range(4) b(j)) GROUP BY page_id),
f AS (SELECT h, body, min(page_id) AS of FROM p GROUP BY h, body)
SELECT p.page_id, CAST(octet_length(encode(body)) AS BIGINT) AS payload_bytes, payload_digest, CASE WHEN p.page_id = of THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN p.page_id <> of THEN of END AS refers_to
FROM p JOIN f USING (h, body) JOIN g ON g.page_id = p.page_id
"""

ORACLE_OP10 = """
WITH d AS (SELECT doc_id, lower(hex(encode(coalesce(text, '')))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
w AS (SELECT doc_id, i, md5(substr(h, CAST(2 * i + 1 AS INT), 400)) AS k FROM d, range(0, greatest(n - 199, 0)) t(i)),
f AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY k) AS c FROM w) WHERE c > 1),
b AS (SELECT *, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 200 THEN 0 ELSE 1 END AS new FROM f),
s AS (SELECT doc_id, g, min(i) AS a, max(i) + 200 AS z FROM (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM b) GROUP BY doc_id, g),
q AS (SELECT *, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS last FROM s),
k AS (SELECT q.doc_id, sum(z - a) AS n_removed, count(*) AS n_spans, string_agg(substr(h, CAST(2 * last + 1 AS INT), CAST(2 * (a - last) AS INT)), '' ORDER BY a) || substr(any_value(h), CAST(2 * max(z) + 1 AS INT)) AS kept
  FROM q JOIN d USING (doc_id) GROUP BY q.doc_id)
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
"""
