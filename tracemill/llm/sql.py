"""SQL of the training-data queries that it can express, written from their contracts."""

from __future__ import annotations

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_PARTS = rf"regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+')"

SQL: dict[str, str] = {
    "op2_decontamination": f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
 b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark),
 starts AS (SELECT item, w, least(10, len(w)) AS n, unnest(range(1, greatest(2, len(w) - 8))) AS s FROM b WHERE len(w) > 0),
 wanted AS (SELECT DISTINCT item, n, array_to_string(w[s:s + n - 1], ' ') AS k FROM starts),
 sizes AS (SELECT DISTINCT n FROM wanted),
 places AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, sizes WHERE len(w) >= n),
 hits AS (SELECT p.doc_id, p.s, p.n, x.item FROM (SELECT doc_id, s, n, array_to_string(w[s:s + n - 1], ' ') AS k FROM places) p JOIN wanted x ON x.n = p.n AND x.k = p.k),
 covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM hits) GROUP BY doc_id),
 items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(c.n_hit, 0) AS n_hit, coalesce(i.n_items, 0) AS n_items, sha256(coalesce(i.ids, '')) AS items_sha256, coalesce(c.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered c ON c.doc_id = d.doc_id LEFT JOIN items i ON i.doc_id = d.doc_id""",
    "op5_near_dedup": f"""
WITH RECURSIVE d AS (SELECT doc_id, {_PARTS} AS w FROM documents),
 places AS (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - 1))) AS s FROM d WHERE len(w) > 0),
 shingles AS (SELECT DISTINCT doc_id, array_to_string(w[s:s + 2], ' ') AS k FROM places),
 sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
 shared AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM shingles x JOIN shingles y ON x.k = y.k AND x.doc_id < y.doc_id GROUP BY x.doc_id, y.doc_id),
 links AS (SELECT a, b FROM shared JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * c >= 85 * (p.n + q.n - c)),
 edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
 reach AS (SELECT a AS doc_id, b AS other FROM edges UNION SELECT r.doc_id, e.b FROM reach r JOIN edges e ON e.a = r.other),
 least_of AS (SELECT doc_id, min(other) AS m FROM reach GROUP BY doc_id)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, least(d.doc_id, coalesce(l.m, d.doc_id)) AS component_id, d.doc_id <= coalesce(l.m, d.doc_id) AS kept
FROM d LEFT JOIN sizes s ON s.doc_id = d.doc_id LEFT JOIN least_of l ON l.doc_id = d.doc_id""",
    "op13_divergence": rf"""
WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS r, regexp_extract_all({_LOWER}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
 words AS (SELECT lang, source, r, unnest(w) AS term FROM d),
 counts AS (SELECT lang, source, term, count(*) AS n FROM words GROUP BY lang, source, term),
 kept AS (SELECT lang, term, count(*) AS n FROM words GROUP BY lang, term HAVING count(DISTINCT r) >= 3),
 groups AS (SELECT DISTINCT lang, source FROM d),
 sizes AS (SELECT g.lang, count(k.term) AS v, coalesce(sum(k.n), 0) AS n FROM (SELECT DISTINCT lang FROM groups) g LEFT JOIN kept k ON k.lang = g.lang GROUP BY g.lang),
 cells AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, k.n AS lang_n FROM groups g JOIN kept k ON k.lang = g.lang LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
 totals AS (SELECT lang, source, sum(n) AS n FROM cells GROUP BY lang, source),
 p AS (SELECT c.lang, c.source, c.term, c.n, 1 + 1000000000::HUGEINT * (c.n + 1) // (t.n + z.v) AS p, 1 + 1000000000::HUGEINT * (c.lang_n + 1) // (z.n + z.v) AS q
 FROM cells c JOIN totals t ON t.lang = c.lang AND t.source = c.source JOIN sizes z ON z.lang = c.lang),
 pairs AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM p a JOIN p b ON b.lang = a.lang AND b.term = a.term AND b.source <> a.source GROUP BY a.lang, a.source, b.source),
 valued AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(x.value, 0) AS BIGINT) AS value FROM groups a JOIN groups b ON b.lang = a.lang AND b.source <> a.source
 LEFT JOIN pairs x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
 UNION ALL SELECT lang, source, 'term', term, CAST((p - q) * (p - q) // q AS BIGINT) FROM p WHERE n > 0 AND p > q),
 ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM valued)
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 200""",
}
