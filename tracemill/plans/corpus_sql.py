"""SQL of the queries over the transcript corpus, written from the tables that its transcripts were made of."""

from __future__ import annotations

from tracemill.plans.sql import _CALLS, _CHANGE, _EPOCHS, _PREDICTED

#: What was put into the transcripts, as figures of calls: roots, agents (depth null: placed nowhere) and all that have a place.
_ROOT = """root AS (SELECT user_id, event_id AS e, call_index AS k, ts_ms, model, input, cache_creation AS cc, cache_read AS cr, output FROM calls),
 agents AS (SELECT user_id, event_id AS e, 'g' || event_id AS conv, j AS k, ts_ms + 1000 * (j + 1) AS ts_ms, event_id % 7 AS input, (event_id + j) % 31 AS cc, 10 * j AS cr, (event_id + 13 * j) % 101 AS output, 1 AS depth
 FROM calls, unnest(range(0, 1 + event_id % 3)) AS t(j) WHERE model = 'purchase' AND event_id % 20 = 0
 UNION ALL SELECT user_id, event_id, 'h' || event_id, 0, ts_ms + 5000, 3, 5, 0, event_id % 17, 2 FROM calls WHERE model = 'purchase' AND event_id % 120 = 0
 UNION ALL SELECT user_id, event_id, 'k' || event_id, 0, ts_ms + 500, 2, 4, 1, event_id % 19, 1 FROM calls WHERE model = 'click' AND event_id % 100 = 0
 UNION ALL SELECT user_id, event_id, CASE event_id % 20 WHEN 10 THEN 'o' ELSE 'x' END || event_id, 0, ts_ms + 900, 1, 1, 1, 7, NULL FROM calls WHERE model = 'purchase' AND event_id % 20 IN (10, 15)),
 every AS (SELECT user_id, e, '' AS conv, k, ts_ms, model, input, cc, cr, output, 0 AS depth FROM root UNION ALL SELECT user_id, e, conv, k, ts_ms, 'purchase', input, cc, cr, output, depth FROM agents),
 placed AS (SELECT *, 20 * input + 25 * cc + 2 * cr + 20 * output AS spend20 FROM every WHERE depth IS NOT NULL),
 ids AS (SELECT user_id, max(n) AS n FROM (SELECT user_id, count(*) AS n FROM events GROUP BY user_id UNION ALL SELECT conv_id, 0 FROM conversations) GROUP BY user_id),
 forks AS (SELECT a.conv, a.e, a.user_id, max(r.k) AS at FROM agents a JOIN root r ON r.user_id = a.user_id AND r.ts_ms <= a.ts_ms WHERE a.conv LIKE 'k%' GROUP BY a.conv, a.e, a.user_id)"""
_BASE = f"{_CALLS}, {_ROOT}"
_SPACES = """spaces AS (SELECT user_id, n, CASE WHEN user_id % 7 <> 3 AND n > 0 THEN '/srv/work-' || user_id % 5 ELSE 'proj-' || user_id % 7 END AS workspace FROM ids)"""
_PRICED = f"""priced AS (SELECT *, (20 * input + 25 * cc + 2 * cr + 100 * output) * CASE model WHEN 'view' THEN CASE WHEN ts_ms < {_CHANGE} THEN 3.0::DOUBLE ELSE 4.0::DOUBLE END WHEN 'click' THEN 1.0::DOUBLE WHEN 'purchase' THEN 5.0::DOUBLE WHEN 'signup' THEN 2.0::DOUBLE END AS usd FROM placed)"""
_LIST = f"""{_SPACES}, {_PRICED}, ends AS (SELECT user_id, ts_ms AS a, ts_ms + 1 AS b FROM placed UNION ALL SELECT user_id, ts_ms, ts_ms + CASE WHEN e % 28 = 0 THEN 800 ELSE 700 END FROM root WHERE model <> 'signup' AND e % 4 <> 1),
 extents AS (SELECT user_id, min(a) AS started_ms, (2 * (max(b) - min(a)) + 60000) // 120000 AS wall_min FROM ends GROUP BY user_id),
 sums AS (SELECT user_id, count(*) AS calls, count(*) FILTER (WHERE depth > 0) AS spawned_calls, max(depth) AS max_depth, (sum(spend20) + 10) // 20 AS tok_eq, (sum(CASE WHEN depth > 0 THEN spend20 ELSE 0 END) + 10) // 20 AS spawned_tok_eq,
 round(coalesce(sum(usd), 0) / 20000000.0::DOUBLE, 4) AS usd, (sum(CASE WHEN usd IS NULL THEN spend20 ELSE 0 END) + 10) // 20 AS unpriced_tok_eq, string_agg(DISTINCT model, ', ' ORDER BY model) AS models FROM priced GROUP BY user_id),
 list AS (SELECT 's' || i.user_id AS session_id, regexp_extract(i.workspace, '[^/]+$') AS project, i.workspace, coalesce(x.started_ms, 0) AS started_ms, coalesce(x.wall_min, 0) AS wall_min, coalesce(s.calls, 0) AS calls, coalesce(s.spawned_calls, 0) AS spawned_calls, CAST(coalesce(s.max_depth, 0) AS BIGINT) AS max_depth,
 CAST(coalesce(s.tok_eq, 0) AS BIGINT) AS tok_eq, CAST(coalesce(s.spawned_tok_eq, 0) AS BIGINT) AS spawned_tok_eq, coalesce(s.usd, 0) AS usd, CAST(coalesce(s.unpriced_tok_eq, 0) AS BIGINT) AS unpriced_tok_eq, coalesce(s.models, '') AS models
 FROM spaces i LEFT JOIN extents x ON x.user_id = i.user_id LEFT JOIN sums s ON s.user_id = i.user_id)"""
#: Activities: what a root call's tool says, else what the last call with a tool said; agents have that of the root call that spawned them.
_ACTS = """own AS (SELECT user_id, e, k, CASE model WHEN 'view' THEN 'exploration' WHEN 'click' THEN 'scm' WHEN 'purchase' THEN CASE WHEN e % 20 = 0 OR e % 6 = 5 THEN 'exploration' ELSE 'implementation' END WHEN 'error' THEN 'unclassified' END AS a FROM root),
 runs AS (SELECT *, count(a) OVER (PARTITION BY user_id ORDER BY k ROWS UNBOUNDED PRECEDING) AS run FROM own),
 acts AS (SELECT user_id, e, k, coalesce(max(a) OVER (PARTITION BY user_id, run), 'unclassified') AS activity FROM runs),
 active AS (SELECT p.*, a.activity FROM placed p JOIN acts a ON a.user_id = p.user_id AND a.e = p.e WHERE p.conv NOT LIKE 'k%' UNION ALL SELECT p.*, a.activity FROM placed p JOIN forks f ON f.user_id = p.user_id AND f.conv = p.conv JOIN acts a ON a.user_id = f.user_id AND a.k = f.at)"""
_LEDGERS = f"""{_ACTS}, wholes AS (SELECT user_id, sum(spend20) AS whole FROM placed GROUP BY user_id),
 entries AS (SELECT user_id, 'activity' AS ledger, activity AS key, spend20 AS v, 1 AS n FROM active UNION ALL SELECT user_id, 'depth', CASE depth WHEN 0 THEN 'main conversation' ELSE 'spawned depth ' || depth END, spend20, 1 FROM placed UNION ALL SELECT user_id, 'model', model, spend20, 1 FROM placed
 UNION ALL SELECT user_id, 'tool', CASE model WHEN 'view' THEN 'Read' WHEN 'click' THEN 'Bash' WHEN 'error' THEN 'Odd' WHEN 'purchase' THEN CASE WHEN e % 20 = 0 THEN 'Agent' ELSE 'Edit' END END, spend20, 1 FROM placed WHERE conv = '' AND model <> 'signup'
 UNION ALL SELECT user_id, 'tool', 'Agent', spend20, 1 FROM placed WHERE conv LIKE 'g%' AND k = 0 AND e % 120 = 0
 UNION ALL SELECT user_id, 'cache', 'uncached input', 20 * input, 0 FROM placed UNION ALL SELECT user_id, 'cache', 'cache writes', 25 * cc, 0 FROM placed UNION ALL SELECT user_id, 'cache', 'cache reads', 2 * cr, 0 FROM placed UNION ALL SELECT user_id, 'cache', 'output', 20 * output, 0 FROM placed),
 ledgers AS (SELECT user_id, ledger, key, CAST(sum(v) AS BIGINT) AS amount20, CAST(sum(n) AS BIGINT) AS calls FROM entries GROUP BY user_id, ledger, key)"""
#: What entered the root's context before each call, and what agents produced themselves.
_ARRIVALS = """arrivals AS (SELECT user_id, '' AS conv, k + 1 AS born, 'toolResult' AS source, (e % 400 + 2) // 4 AS tokens FROM root WHERE model <> 'signup' AND e % 4 <> 1 UNION ALL SELECT user_id, '', k + 1, 'toolResult', 1 FROM root WHERE model <> 'signup' AND e % 28 = 0
 UNION ALL SELECT c.conv_id, '', least(c.turn, i.n), 'userText', (length(c.text) + 2) // 4 FROM conversations c JOIN ids i ON i.user_id = c.conv_id WHERE c.role = 'user' AND length(c.text) > 0
 UNION ALL SELECT c.conv_id, '', least(c.turn, i.n), 'attachment', (length(CAST(json_object('type', c.role, 'content', c.text) AS VARCHAR)) + 2) // 4 FROM conversations c JOIN ids i ON i.user_id = c.conv_id WHERE c.role <> 'user'
 UNION ALL SELECT user_id, '', k, 'attachment', (length('{"type":"file","content":""}') + e % 50 + 2) // 4 FROM root WHERE e % 11 = 0 UNION ALL SELECT user_id, conv, k + 1, 'assistantOutput', output FROM every)"""
#: The fit of visible output per model, and how each placed call's output divides.
_OUTPUTS = """shown AS (SELECT user_id, 's' || user_id || '/' || conv AS transcript, conv, k, model, output, depth, conv = '' AND e % 3 = 0 AS reasoned,
 CASE WHEN conv = '' AND e % 3 = 0 THEN output ELSE 3 * output + e % 7 END + CASE WHEN conv LIKE 'g%' THEN CASE WHEN k = 0 AND e % 120 = 0 THEN length('{"prompt":"on"}') ELSE 0 END WHEN conv <> '' THEN 0 ELSE CASE model WHEN 'view' THEN length('{"file_path":"src/f0.py"}') WHEN 'click' THEN length('{"command":"git status"}')
 WHEN 'error' THEN length('{"n":0}') WHEN 'purchase' THEN CASE WHEN e % 20 = 0 THEN length('{"prompt":"go"}') WHEN e % 6 = 5 THEN length('{"file_path":"/tmp/x.py"}') ELSE length('{"file_path":"src/a.py"}') END ELSE 0 END END AS chars,
 1 + CASE WHEN (conv = '' AND model <> 'signup') OR (conv LIKE 'g%' AND k = 0 AND e % 120 = 0) THEN 1 ELSE 0 END AS blocks FROM every),
 points AS (SELECT * FROM shown WHERE NOT reasoned), parity AS (SELECT model, transcript, row_number() OVER (PARTITION BY model ORDER BY transcript) % 2 = 1 AS train FROM (SELECT DISTINCT model, transcript FROM points)),
 moments AS (SELECT p.model, count(*) AS n, count(*) FILTER (WHERE q.train) AS trained, count(*) FILTER (WHERE NOT q.train) AS tested, sum(chars::DOUBLE * chars) AS xx, sum(blocks::DOUBLE * blocks) AS bb, sum(chars::DOUBLE * blocks) AS xb, sum(chars::DOUBLE * output) AS xy, sum(blocks::DOUBLE * output) AS by_ FROM points p JOIN parity q ON q.model = p.model AND q.transcript = p.transcript GROUP BY p.model),
 free AS (SELECT *, xx * bb - xb * xb AS det FROM moments), solved AS (SELECT *, CASE WHEN det > 0 THEN (xy * bb - by_ * xb) / det END AS a0, CASE WHEN det > 0 THEN (by_ * xx - xy * xb) / det END AS b0, greatest(0.0::DOUBLE, coalesce(xy / nullif(xx, 0), 0)) AS a1, greatest(0.0::DOUBLE, coalesce(by_ / nullif(bb, 0), 0)) AS b1 FROM free),
 fitted AS (SELECT model, CASE WHEN a0 >= 0 AND b0 >= 0 THEN a0 WHEN a1 * a1 * xx - 2 * a1 * xy <= b1 * b1 * bb - 2 * b1 * by_ THEN a1 ELSE 0 END AS a, CASE WHEN a0 >= 0 AND b0 >= 0 THEN b0 WHEN a1 * a1 * xx - 2 * a1 * xy <= b1 * b1 * bb - 2 * b1 * by_ THEN 0 ELSE b1 END AS b FROM solved WHERE n >= 32 AND trained > 0 AND tested > 0),
 divided AS (SELECT s.user_id, s.model, s.output, s.reasoned, f.model IS NOT NULL AS known, CAST(floor(s.chars / (1 / f.a) + s.blocks * f.b + 0.5::DOUBLE) AS BIGINT) AS visible FROM shown s LEFT JOIN fitted f ON f.model = s.model AND f.a > 0 WHERE s.depth IS NOT NULL),
 totals AS (SELECT user_id, CAST(sum(output) AS BIGINT) AS total, CAST(coalesce(sum(visible) FILTER (WHERE known), 0) AS BIGINT) AS visible, CAST(coalesce(sum(output - visible) FILTER (WHERE known AND reasoned), 0) AS BIGINT) AS reasoning, CAST(coalesce(sum(output - visible) FILTER (WHERE known AND NOT reasoned), 0) AS BIGINT) AS estimator_error,
 CAST(coalesce(sum(output) FILTER (WHERE NOT known), 0) AS BIGINT) AS uncalibrated, count(*) FILTER (WHERE known AND reasoned) AS reasoned_calls, count(*) FILTER (WHERE NOT known) AS unknown_calls, coalesce(string_agg(DISTINCT CASE WHEN NOT known THEN model END, ',' ORDER BY CASE WHEN NOT known THEN model END), '') AS models FROM divided GROUP BY user_id)"""
_BELOW = """below AS (SELECT r.user_id, r.k, r.output, r.input, coalesce(g.o, 0) + coalesce(f.o, 0) AS o, coalesce(g.i, 0) + coalesce(f.i, 0) AS i FROM root r
 LEFT JOIN (SELECT user_id, e, sum(output) AS o, sum(input) AS i FROM placed WHERE conv LIKE 'g%' OR conv LIKE 'h%' GROUP BY user_id, e) g ON g.user_id = r.user_id AND g.e = r.e
 LEFT JOIN (SELECT x.user_id, x.at, sum(p.output) AS o, sum(p.input) AS i FROM forks x JOIN placed p ON p.user_id = x.user_id AND p.conv = x.conv GROUP BY x.user_id, x.at) f ON f.user_id = r.user_id AND f.at = r.k)"""

#: Tools as requested, with what one sees of their input.
_TOOLS = """asked AS (SELECT user_id, '' AS conv, e, k, ts_ms, 't' || e AS id, CASE model WHEN 'view' THEN 'Read' WHEN 'click' THEN 'Bash' WHEN 'error' THEN 'Odd' WHEN 'purchase' THEN CASE WHEN e % 20 = 0 THEN 'Agent' ELSE 'Edit' END END AS name,
 CASE model WHEN 'view' THEN 'src/f' || e % 9 || '.py' WHEN 'click' THEN 'git status' WHEN 'error' THEN '7 chars' ELSE CASE WHEN e % 20 = 0 THEN 'go' WHEN e % 6 = 5 THEN '/tmp/x.py' ELSE 'src/a.py' END END AS summary, e % 4 <> 1 AS answered FROM root WHERE model <> 'signup'
 UNION ALL SELECT user_id, conv, e, k, ts_ms, 't' || e || 'x', 'Agent', 'on', FALSE FROM agents WHERE conv LIKE 'g%' AND k = 0 AND e % 120 = 0)"""
#: Each arrival with its label.
_NAMED = """named AS (SELECT user_id, conv, k + 1 AS born, 'toolResult' AS source, name, name || ' ' || summary AS label, (e % 400 + 2) // 4 AS tokens FROM asked WHERE answered UNION ALL SELECT user_id, conv, k + 1, 'toolResult', name, name || ' ' || summary, 1 FROM asked WHERE answered AND e % 28 = 0
 UNION ALL SELECT c.conv_id, '', least(c.turn, i.n), 'userText', 'user text', substr(regexp_replace(substr(c.text, 1, 200), '\\s+', ' ', 'g'), 1, 90), (length(c.text) + 2) // 4 FROM conversations c JOIN ids i ON i.user_id = c.conv_id WHERE c.role = 'user' AND length(c.text) > 0
 UNION ALL SELECT c.conv_id, '', least(c.turn, i.n), 'attachment', c.role, c.role, (length(CAST(json_object('type', c.role, 'content', c.text) AS VARCHAR)) + 2) // 4 FROM conversations c JOIN ids i ON i.user_id = c.conv_id WHERE c.role <> 'user'
 UNION ALL SELECT user_id, '', k, 'attachment', 'file', 'file', (length('{"type":"file","content":""}') + e % 50 + 2) // 4 FROM root WHERE e % 11 = 0
 UNION ALL SELECT user_id, conv, k + 1, 'assistantOutput', 'prior output', 'assistant output of call ' || k, output FROM every)"""
_SPANS = """counted AS (SELECT user_id, sum(n) AS n FROM (SELECT DISTINCT user_id, 1 AS n FROM placed UNION ALL SELECT user_id, count(*) FROM placed GROUP BY user_id UNION ALL SELECT user_id, count(*) FROM asked GROUP BY user_id UNION ALL SELECT user_id, count(DISTINCT conv) FROM placed WHERE conv <> '' GROUP BY user_id
 UNION ALL SELECT c.conv_id, count(*) FROM conversations c JOIN ids i ON i.user_id = c.conv_id WHERE c.role = 'user' AND c.turn < i.n GROUP BY c.conv_id) GROUP BY user_id)"""

SQL: dict[str, str] = {
    "trace_parse_stats": f"""WITH {_BASE}, l AS (SELECT user_id, '' AS conv, 'assistant' AS kind, 'assistant' AS type, 1 + CASE WHEN e % 2 = 0 THEN 1 ELSE 0 END + CASE WHEN e % 30 = 0 OR (e % 34 = 0 AND output > 0) THEN 1 ELSE 0 END AS n FROM root UNION ALL SELECT user_id, conv, 'assistant', 'assistant', 1 FROM agents
 UNION ALL SELECT user_id, '', 'user', 'user', 1 + CASE WHEN e % 28 = 0 THEN 1 ELSE 0 END FROM root WHERE model <> 'signup' AND e % 4 <> 1 UNION ALL SELECT conv_id, '', CASE role WHEN 'user' THEN 'user' ELSE 'attachment' END, CASE role WHEN 'user' THEN 'user' ELSE 'attachment' END, 1 FROM conversations
 UNION ALL SELECT user_id, '', 'attachment', 'attachment', 1 FROM root WHERE e % 11 = 0 UNION ALL SELECT user_id, '', 'meta', 'summary', 1 FROM root WHERE e % 50 = 0 UNION ALL SELECT user_id, '', 'unknown', 'novelty', 1 FROM root WHERE e % 70 = 0 UNION ALL SELECT user_id, '', 'unparseable', NULL, 1 FROM root WHERE e % 97 = 0)
 SELECT 's' || user_id AS session_id, conv AS conv_id, kind, type, CAST(sum(n) AS BIGINT) AS lines FROM l GROUP BY user_id, conv, kind, type""",
    "trace_tools": f"""WITH {_BASE}, {_TOOLS} SELECT 's' || user_id AS session_id, conv AS conv_id, id AS tool_use_id, name, summary, k AS call_index, ts_ms AS ts_start, CASE WHEN answered THEN ts_ms + CASE WHEN e % 28 = 0 THEN 800 ELSE 700 END END AS ts_end,
 CAST(CASE WHEN answered THEN CASE WHEN e % 28 = 0 THEN 5 ELSE e % 400 END END AS BIGINT) AS result_chars, CAST(CASE WHEN answered THEN CASE WHEN e % 28 = 0 THEN 1 ELSE 0 END END AS BIGINT) AS repeated_results, CAST(0 AS BIGINT) AS repeated_uses FROM asked""",
    "trace_arrivals": f"WITH {_BASE}, {_TOOLS}, {_NAMED} SELECT 's' || user_id AS session_id, conv AS conv_id, CAST(born AS BIGINT) AS born, source, label, CASE source WHEN 'assistantOutput' THEN 'exact-api-usage' ELSE 'estimated-from-chars' END AS basis, count(*) AS n, CAST(sum(tokens) AS BIGINT) AS tokens FROM named GROUP BY user_id, conv, born, source, label",
    "trace_turns": rf"""WITH {_BASE}, u AS (SELECT c.conv_id, c.turn, least(c.turn, i.n) AS first_call, i.n, substr(regexp_replace(substr(c.text, 1, 200), '\s+', ' ', 'g'), 1, 110) AS snippet FROM conversations c JOIN ids i ON i.user_id = c.conv_id WHERE c.role = 'user')
 SELECT 's' || conv_id AS session_id, '' AS conv_id, CAST(row_number() OVER w - 1 AS BIGINT) AS turn_index, first_call, CAST(coalesce(lead(first_call) OVER w - 1, greatest(0, n - 1)) AS BIGINT) AS last_call, 'user' AS kind, snippet FROM u WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""",
    "trace_causes": f"""WITH {_BASE}, {_TOOLS}, {_NAMED} SELECT 's' || n.user_id AS session_id, n.conv AS conv_id, v.k AS call_index, n.source, n.name AS label, count(*) AS arrivals, CAST(sum(n.tokens) AS BIGINT) AS tokens, CAST(25 * sum(n.tokens) AS BIGINT) AS cost20,
 CASE n.source WHEN 'assistantOutput' THEN 'exact-api-usage' ELSE 'estimated-from-chars' END AS basis FROM named n JOIN every v ON v.user_id = n.user_id AND v.conv = n.conv AND v.k = n.born GROUP BY n.user_id, n.conv, v.k, n.source, n.name""",
    "trace_basis": f"""WITH {_BASE}, {_ARRIVALS}, s AS (SELECT user_id, sum(CASE WHEN source = 'assistantOutput' THEN tokens ELSE 0 END) AS x, sum(CASE WHEN source = 'assistantOutput' THEN 0 ELSE tokens END) AS y FROM arrivals WHERE conv = '' GROUP BY user_id)
 SELECT 's' || i.user_id AS session_id, CAST(coalesce(x, 0) AS BIGINT) AS exact, CAST(coalesce(y, 0) AS BIGINT) AS estimated, round(CASE WHEN coalesce(x + y, 0) = 0 THEN 0.0::DOUBLE ELSE x::DOUBLE / (x + y)::DOUBLE END, 6) AS exact_share FROM ids i LEFT JOIN s ON s.user_id = i.user_id""",
    "trace_forest": f"""WITH {_BASE}, c AS (SELECT DISTINCT a.user_id, a.e, a.conv, r.k, f.at AS fork_at FROM agents a JOIN root r ON r.user_id = a.user_id AND r.e = a.e LEFT JOIN forks f ON f.conv = a.conv WHERE a.conv NOT LIKE 'x%')
 SELECT 's' || user_id AS session_id, conv AS agent_id, CASE left(conv, 1) WHEN 'h' THEN 'g' || e WHEN 'o' THEN NULL ELSE '' END AS parent_agent, CAST(CASE left(conv, 1) WHEN 'g' THEN k WHEN 'h' THEN 0 WHEN 'k' THEN fork_at END AS BIGINT) AS spawned_at_call, CASE left(conv, 1) WHEN 'k' THEN 'command' WHEN 'o' THEN NULL ELSE 'tool_use' END AS via,
 CASE left(conv, 1) WHEN 'o' THEN 'no placed conversation holds its tool use none' END AS why, CASE left(conv, 1) WHEN 'g' THEN CASE WHEN e % 40 = 0 THEN 'Explore' ELSE 'helper' END WHEN 'h' THEN 'Explore > deep' WHEN 'k' THEN 'fork' END AS path, CASE left(conv, 1) WHEN 'o' THEN NULL ELSE 'agent' END AS driver FROM c""",
    "trace_epochs": f"WITH {_EPOCHS} SELECT 's' || user_id AS session_id, epoch, start_call, end_call, CAST(rewritten AS BIGINT) AS rewritten, CAST(gap AS BIGINT) AS gap, CAST(23 * rewritten AS BIGINT) AS excess20 FROM epochs",
    "trace_lifetimes": f"""WITH {_EPOCHS}, {_ROOT}, {_ARRIVALS}, a AS (SELECT *, row_number() OVER () AS id FROM arrivals WHERE conv = ''),
 l AS (SELECT a.id, a.user_id, a.source, a.tokens, count(p.epoch) AS writes, coalesce(sum(p.end_call - greatest(p.start_call, a.born)), 0) AS reads FROM a LEFT JOIN epochs p ON p.user_id = a.user_id AND p.end_call >= a.born GROUP BY a.id, a.user_id, a.source, a.tokens)
 SELECT 's' || user_id AS session_id, source, count(*) AS n, CAST(sum(writes) AS BIGINT) AS writes, CAST(sum(reads) AS BIGINT) AS reads, CAST(sum(tokens * (25 * writes + 2 * reads)) AS BIGINT) AS total20 FROM l GROUP BY user_id, source""",
    "trace_coverage": f"""WITH {_BASE}, {_ACTS}, tiers AS (SELECT a.user_id, a.e, a.k, a.activity, CASE WHEN a.activity = 'unclassified' THEN 'none' WHEN r.model = 'purchase' AND r.e % 40 = 0 THEN 'marker' ELSE 'rule' END AS tier FROM acts a JOIN root r ON r.user_id = a.user_id AND r.k = a.k),
 t AS (SELECT p.user_id, p.spend20::DOUBLE AS s, t.tier, t.activity FROM placed p JOIN tiers t ON t.user_id = p.user_id AND t.e = p.e WHERE p.conv NOT LIKE 'k%' UNION ALL SELECT p.user_id, p.spend20::DOUBLE, t.tier, t.activity FROM placed p JOIN forks f ON f.user_id = p.user_id AND f.conv = p.conv JOIN tiers t ON t.user_id = f.user_id AND t.k = f.at)
 SELECT 's' || user_id AS session_id, CAST(sum(s) AS BIGINT) AS total, round(coalesce(sum(s) FILTER (WHERE tier = 'marker'), 0) / sum(s), 6) AS tier_marker, round(coalesce(sum(s) FILTER (WHERE tier = 'rule'), 0) / sum(s), 6) AS tier_rule, 0.0::DOUBLE AS tier_judge, 0.0::DOUBLE AS tier_hand,
 round(coalesce(sum(s) FILTER (WHERE tier = 'none'), 0) / sum(s), 6) AS tier_none, round(coalesce(sum(s) FILTER (WHERE activity = 'unclassified'), 0) / sum(s), 6) AS unclassified, (SELECT round(coalesce(sum(s) FILTER (WHERE activity = 'unclassified'), 0) / sum(s), 6) FROM t) AS corpus_unclassified FROM t GROUP BY user_id""",
    "trace_exports": f"""WITH {_BASE}, {_SPACES}, {_TOOLS}, {_SPANS}, d AS (SELECT unnest(['time', 'tokens']) AS domain) SELECT 's' || c.user_id AS session_id, regexp_extract(s.workspace, '[^/]+$') AS project, d.domain, substr(sha256('tracemill-' || d.domain || chr(10) || 's' || c.user_id), 1, 32) AS trace_id, CAST(c.n AS BIGINT) AS spans,
 CAST(2 * c.n AS BIGINT) AS both, 'http://localhost/trace/' || substr(sha256('tracemill-' || d.domain || chr(10) || 's' || c.user_id), 1, 32) AS url FROM counted c JOIN spaces s ON s.user_id = c.user_id, d WHERE s.user_id IN (SELECT user_id FROM placed)""",
    "trace_selection": f"""WITH {_BASE}, l AS (SELECT user_id, sum(n) AS lines FROM (SELECT user_id, sum(1 + CASE WHEN e % 2 = 0 THEN 1 ELSE 0 END + CASE WHEN e % 30 = 0 OR (e % 34 = 0 AND output > 0) THEN 1 ELSE 0 END + CASE WHEN model <> 'signup' AND e % 4 <> 1 THEN 1 ELSE 0 END + CASE WHEN model <> 'signup' AND e % 28 = 0 THEN 1 ELSE 0 END
 + CASE WHEN e % 11 = 0 THEN 1 ELSE 0 END + CASE WHEN e % 50 = 0 THEN 1 ELSE 0 END + CASE WHEN e % 70 = 0 THEN 1 ELSE 0 END + CASE WHEN e % 97 = 0 THEN 1 ELSE 0 END) AS n FROM root GROUP BY user_id UNION ALL SELECT conv_id, count(*) FROM conversations GROUP BY conv_id) GROUP BY user_id),
 s AS (SELECT user_id, lines, 'proj-' || user_id % 7 AS project, EXISTS (SELECT 1 FROM agents g WHERE g.user_id = l.user_id AND g.conv NOT LIKE 'x%') AS spawned, 'proj-' || user_id % 7 || '/s' || user_id || '.jsonl' AS path FROM l WHERE lines BETWEEN 60 AND 700), r AS (SELECT *, row_number() OVER (PARTITION BY project ORDER BY spawned DESC, path) AS n FROM s)
 SELECT 's' || user_id AS session_id, project, CAST(lines AS BIGINT) AS lines, spawned FROM r WHERE n <= 2 ORDER BY spawned DESC, path LIMIT 9""",
    "trace_sessions": f"WITH {_BASE}, {_LIST} SELECT session_id, project, started_ms, wall_min, calls, spawned_calls, max_depth, tok_eq, spawned_tok_eq, usd, unpriced_tok_eq, models FROM list",
    "trace_ledgers": f"WITH {_BASE}, {_LEDGERS} SELECT 's' || l.user_id AS session_id, l.ledger, l.key, round(l.amount20::DOUBLE, 2) AS amount20, round(CASE WHEN w.whole = 0 THEN 0.0::DOUBLE ELSE l.amount20::DOUBLE / w.whole::DOUBLE END, 6) AS share, l.calls FROM ledgers l JOIN wholes w ON w.user_id = l.user_id",
    "trace_attribution": f"""WITH {_BASE}, {_ARRIVALS}, s AS (SELECT user_id, conv, born, sum(tokens) AS t, count(*) AS n FROM arrivals GROUP BY user_id, conv, born)
 SELECT 's' || v.user_id AS session_id, v.conv AS conv_id, v.k AS call_index, CAST(20 * v.input + 25 * v.cc AS BIGINT) AS exact20, CAST(25 * coalesce(s.t, 0) AS BIGINT) AS caused20, CAST(20 * v.input + 25 * v.cc - 25 * coalesce(s.t, 0) AS BIGINT) AS unattributed20, coalesce(s.n, 0) AS causes
 FROM every v LEFT JOIN s ON s.user_id = v.user_id AND s.conv = v.conv AND s.born = v.k""",
    "trace_strata": f"""WITH {_EPOCHS}, {_ROOT}, {_ARRIVALS}, s AS (SELECT user_id, born, source, sum(tokens) AS t FROM arrivals WHERE conv = '' GROUP BY user_id, born, source),
 m AS (SELECT *, row_number() OVER (PARTITION BY user_id, born ORDER BY t DESC, source) AS n, sum(t) OVER (PARTITION BY user_id, born) AS w FROM s),
 y AS (SELECT user_id, call_index, epoch, cache_creation, sum(cache_creation) OVER (PARTITION BY user_id, epoch ORDER BY call_index ROWS UNBOUNDED PRECEDING) AS y1 FROM marked WHERE cache_creation > 0)
 SELECT 's' || y.user_id AS session_id, y.call_index, y.epoch, CAST(y.y1 - y.cache_creation AS BIGINT) AS y0, CAST(y.y1 AS BIGINT) AS y1, CASE WHEN y.call_index = 0 THEN 'startup' WHEN m.w > 0 THEN m.source ELSE 'unattributed' END AS source,
 round(CASE WHEN y.call_index = 0 THEN 1.0::DOUBLE WHEN m.w > 0 THEN m.t::DOUBLE / m.w::DOUBLE ELSE 0.0::DOUBLE END, 6) AS share FROM y LEFT JOIN m ON m.user_id = y.user_id AND m.born = y.call_index AND m.n = 1""",
    "trace_findings": f"""WITH {_EPOCHS}, {_ROOT}, {_ARRIVALS}, {_OUTPUTS}, {_PRICED}, w AS (SELECT user_id, sum(spend20) AS whole, sum(CASE WHEN usd IS NULL THEN spend20 ELSE 0 END) AS unpriced, sum(CASE WHEN depth > 0 THEN input ELSE 0 END) AS cold, max(depth) AS deep FROM priced GROUP BY user_id),
 big AS (SELECT user_id, born, tokens, row_number() OVER (PARTITION BY user_id ORDER BY tokens DESC, born) AS n FROM arrivals WHERE source = 'toolResult'),
 lived AS (SELECT b.user_id, b.born, b.tokens, count(p.epoch) AS writes, coalesce(sum(p.end_call - greatest(p.start_call, b.born)), 0) AS reads FROM big b LEFT JOIN epochs p ON p.user_id = b.user_id AND p.end_call >= b.born WHERE b.n = 1 GROUP BY b.user_id, b.born, b.tokens),
 f AS (SELECT user_id, CASE WHEN gap >= 300000 THEN 'cache expired' ELSE 'prefix changed' END AS finding, start_call AS at_call, 23 * rewritten AS cost20, 'cost' AS kind FROM epochs WHERE epoch > 0
 UNION ALL SELECT user_id, 'largest tool result', born, tokens * (25 * writes + 2 * reads), 'cost' FROM lived UNION ALL SELECT user_id, 'spawn cold start', NULL, 20 * cold, 'note' FROM w WHERE deep > 0 UNION ALL SELECT user_id, 'startup payload', 0, 20 * input + 25 * cc, 'note' FROM root WHERE k = 0
 UNION ALL SELECT i.user_id, 'reasoning share of output', NULL, 20 * coalesce(t.reasoning, 0), 'always' FROM ids i LEFT JOIN totals t ON t.user_id = i.user_id
 UNION ALL SELECT i.user_id, 'pricing/calibration gap', NULL, coalesce(w.unpriced, 0), CASE WHEN 20 * coalesce(t.uncalibrated, 0) > coalesce(t.total, 0) THEN 'high' ELSE 'always' END FROM ids i LEFT JOIN w ON w.user_id = i.user_id LEFT JOIN totals t ON t.user_id = i.user_id)
 SELECT 's' || f.user_id AS session_id, f.finding, f.at_call, CAST(f.cost20 AS BIGINT) AS cost20, round(CASE WHEN coalesce(w.whole, 0) = 0 THEN 0.0::DOUBLE ELSE f.cost20::DOUBLE / w.whole::DOUBLE END, 6) AS share,
 CASE WHEN f.kind = 'note' THEN 'note' WHEN f.kind = 'high' OR 20 * f.cost20 > coalesce(w.whole, 0) AND coalesce(w.whole, 0) > 0 THEN 'high' WHEN f.kind = 'always' THEN 'note' ELSE 'medium' END AS severity FROM f LEFT JOIN w ON w.user_id = f.user_id""",
    "trace_audits": f"""WITH {_PREDICTED}, {_ROOT}, runs AS (SELECT *, lag(cr) OVER w AS p_cr, lag(cc) OVER w AS p_cc FROM every WINDOW w AS (PARTITION BY user_id, conv ORDER BY k)),
 c AS (SELECT 'tree-holds-every-token' AS identity, FALSE AS v FROM (SELECT DISTINCT user_id FROM placed), range(4) UNION ALL SELECT 'cache-creation-accounted', e % 400 = 0 FROM root WHERE e % 4 = 0 UNION ALL SELECT 'cache-read-recurrence', cr <> p_cr + p_cc FROM runs WHERE cr >= p_cr
 UNION ALL SELECT 'output-snapshot-agrees', e % 34 = 0 FROM root WHERE e % 2 = 0 AND e % 30 <> 0 AND output > 0 UNION ALL SELECT 'residency-predicts-cache-read', cache_read <> expected FROM predicted WHERE predictable),
 r AS (SELECT * FROM (VALUES ('tree-holds-every-token', 0), ('cache-creation-accounted', 0), ('cache-read-recurrence', 50), ('output-snapshot-agrees', 1), ('residency-predicts-cache-read', 300)) AS t(identity, permille)),
 n AS (SELECT r.identity, r.permille, count(c.identity) AS sites, count(*) FILTER (WHERE c.v) AS violations FROM r LEFT JOIN c ON c.identity = r.identity GROUP BY r.identity, r.permille)
 SELECT identity, sites, violations, CAST(permille * sites // 1000 AS BIGINT) AS allowed, violations <= permille * sites // 1000 AS held FROM n""",
    "trace_notes": f"""WITH {_BASE}, l AS (SELECT user_id, count(*) AS calls, CAST(sum(1 + CASE WHEN e % 2 = 0 THEN 1 ELSE 0 END + CASE WHEN e % 30 = 0 OR (e % 34 = 0 AND output > 0) THEN 1 ELSE 0 END) AS BIGINT) AS lines, count(*) FILTER (WHERE model <> 'signup') AS tools, count(*) FILTER (WHERE model <> 'signup' AND e % 4 <> 1) AS answered,
 count(*) FILTER (WHERE model <> 'signup' AND e % 28 = 0) AS again, count(*) FILTER (WHERE e % 97 = 0) AS bad, count(*) FILTER (WHERE e % 70 = 0) AS novel FROM root GROUP BY user_id),
 z AS (SELECT i.user_id, coalesce(calls, 0) AS calls, coalesce(lines, 0) AS lines, coalesce(tools, 0) AS tools, coalesce(answered, 0) AS answered, coalesce(again, 0) AS again, coalesce(bad, 0) AS bad, coalesce(novel, 0) AS novel FROM ids i LEFT JOIN l ON l.user_id = i.user_id),
 h AS (SELECT *, CASE WHEN calls = 0 THEN 0 ELSE (200 * lines + calls) // (2 * calls) END AS x FROM z),
 o AS (SELECT user_id, 'calls' AS about, lines || ' lines of the model make ' || calls || ' calls (' || x // 100 || '.' || lpad(CAST(x % 100 AS VARCHAR), 2, '0') || ' lines a call)' AS note FROM h
 UNION ALL SELECT user_id, 'tools', answered || ' of ' || tools || ' tools have a result; 0 results answer nothing, ' || again || ' answer again, 0 requests repeat an id' FROM h UNION ALL SELECT user_id, 'unparseable', bad || ' lines are no JSON' FROM h WHERE bad > 0 UNION ALL SELECT user_id, 'unknown', 'line types that are not known: novelty=' || novel FROM h WHERE novel > 0
 UNION ALL SELECT user_id, 'unpaired', 'half a spawned agent: ' || CASE e % 20 WHEN 5 THEN 'm' || e || ': meta present, transcript missing' ELSE 'x' || e || ': transcript present, meta missing' END FROM root WHERE model = 'purchase' AND e % 20 IN (5, 15)
 UNION ALL SELECT user_id, 'orphan', 'orphan o' || e || ' (lost): no placed conversation holds its tool use none' FROM root WHERE model = 'purchase' AND e % 20 = 10 UNION ALL SELECT user_id, 'depth', 'g' || e || ' is at depth 1 and claims 2' FROM root WHERE model = 'purchase' AND e % 60 = 0)
 SELECT 's' || user_id AS session_id, about, note FROM o""",
    "trace_synopsis": rf"""WITH {_BASE}, {_ACTS}, s AS (SELECT user_id, activity, sum(spend20) AS v FROM active GROUP BY user_id, activity), t AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY v DESC, activity) AS n FROM s),
 u AS (SELECT conv_id, turn, substr(regexp_replace(substr(text, 1, 200), '\s+', ' ', 'g'), 1, 110) AS snippet FROM conversations WHERE role = 'user'), p AS (SELECT conv_id, snippet, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM u WHERE length(snippet) > 20)
 SELECT 's' || i.user_id AS session_id, coalesce(t.activity, 'unclassified') AS dominant, p.snippet AS opening, coalesce(t.activity, 'unclassified') || ' — ' || coalesce(substr(p.snippet, 1, 100), 'no stated task, agents throughout') AS synopsis FROM ids i LEFT JOIN t ON t.user_id = i.user_id AND t.n = 1 LEFT JOIN p ON p.conv_id = i.user_id AND p.n = 1""",
    "trace_outputs": f"WITH {_BASE}, {_OUTPUTS} "
    + " UNION ALL ".join(
        f"SELECT 's' || user_id AS session_id, '{k}' AS key, {k} AS amount, round({k}::DOUBLE / greatest(total, 1), 6) AS share, CAST({calls} AS BIGINT) AS calls, {models} AS models FROM totals"
        for k, calls, models in (("reasoning", "reasoned_calls", "''"), ("visible", "0", "''"), ("estimator_error", "0", "''"), ("uncalibrated", "unknown_calls", "models"))
    ),
    "trace_corpus": f"""WITH {_BASE}, {_LEDGERS}, c AS (SELECT ledger, key, CAST(sum((amount20 + 10) // 20) AS BIGINT) AS cost FROM ledgers WHERE ledger IN ('activity', 'depth') GROUP BY ledger, key), x AS (SELECT *, round(cost::DOUBLE / sum(cost::DOUBLE) OVER (PARTITION BY ledger), 6) AS share FROM c)
 SELECT ledger, key, cost, share FROM x UNION ALL SELECT 'asked first', q.a, coalesce(x.cost, 0), coalesce(x.share, 0) FROM (VALUES ('review'), ('implementation'), ('exploration'), ('unclassified')) AS q(a) LEFT JOIN x ON x.ledger = 'activity' AND x.key = q.a""",
    "trace_report": f"""WITH {_BASE}, {_LIST}, u AS (SELECT session_id, workspace, calls, tok_eq, CAST(floor(usd * 10000 + 0.5::DOUBLE) AS BIGINT) AS usd4 FROM list)
 SELECT session_id, usd4, calls, tok_eq, row_number() OVER (ORDER BY usd4 DESC, session_id) AS place, CAST(sum(usd4) OVER () AS BIGINT) AS list_usd4, CAST(sum(calls) OVER () AS BIGINT) AS list_calls, CAST(sum(tok_eq) OVER () AS BIGINT) AS list_tok_eq, (SELECT count(DISTINCT workspace) FROM u) AS workspaces FROM u""",
    "trace_disagreements": f"WITH {_BASE} SELECT DISTINCT 's' || user_id AS session_id, conv AS agent_id, CAST(1 AS BIGINT) AS depth, CAST(2 AS BIGINT) AS declared FROM agents WHERE conv LIKE 'g%' AND e % 60 = 0",
    "trace_family": f"""WITH {_BASE}, c AS (SELECT DISTINCT user_id, e, conv FROM placed WHERE conv <> '') SELECT 's' || i.user_id AS session_id, '' AS agent_id, (SELECT count(*) FROM c WHERE c.user_id = i.user_id AND c.conv NOT LIKE 'h%') AS children FROM ids i
 UNION ALL SELECT 's' || user_id, conv, CAST(CASE WHEN conv LIKE 'g%' AND e % 120 = 0 THEN 1 ELSE 0 END AS BIGINT) FROM c""",
    "trace_spans": f"""WITH {_BASE}, {_BELOW}, opened AS (SELECT conv_id, min(turn) AS first FROM conversations WHERE role = 'user' GROUP BY conv_id),
 v AS (SELECT user_id, 'session' AS kind, 1 AS n, sum(output) AS o, sum(input) AS i FROM placed GROUP BY user_id
 UNION ALL SELECT b.user_id, 'turn', (SELECT count(*) FROM conversations c JOIN ids x ON x.user_id = c.conv_id WHERE c.conv_id = b.user_id AND c.role = 'user' AND c.turn < x.n), sum(b.output + b.o), sum(b.input + b.i) FROM below b JOIN opened t ON t.conv_id = b.user_id WHERE b.k >= t.first GROUP BY b.user_id
 UNION ALL SELECT user_id, 'call', count(*), sum(output + o), sum(input + i) FROM below GROUP BY user_id UNION ALL SELECT user_id, 'call', count(*), sum(output), sum(input) FROM placed WHERE conv <> '' GROUP BY user_id UNION ALL SELECT user_id, 'call', 0, output, input FROM placed WHERE conv LIKE 'h%'
 UNION ALL SELECT user_id, 'tool', count(*), 0, 0 FROM root WHERE model <> 'signup' GROUP BY user_id UNION ALL SELECT user_id, 'tool', 0, output, input FROM placed WHERE conv LIKE 'g%' OR conv LIKE 'h%' UNION ALL SELECT user_id, 'tool', 1, output, input FROM placed WHERE conv LIKE 'h%'
 UNION ALL SELECT user_id, 'subagent', count(DISTINCT conv), sum(output), sum(input) FROM placed WHERE conv <> '' GROUP BY user_id UNION ALL SELECT user_id, 'subagent', 0, output, input FROM placed WHERE conv LIKE 'h%'),
 k AS (SELECT user_id, kind, CAST(sum(n) AS BIGINT) AS spans, CAST(sum(o) AS BIGINT) AS output_below, CAST(sum(i) AS BIGINT) AS input_below FROM v GROUP BY user_id, kind)
 SELECT 's' || k.user_id AS session_id, k.kind, k.spans, k.output_below, k.input_below, CAST(sum(k.spans) OVER (PARTITION BY k.user_id) AS BIGINT) AS written, CAST((t.s + 10) // 20 AS BIGINT) AS tok_eq FROM k JOIN (SELECT user_id, sum(spend20) AS s FROM placed GROUP BY user_id) t ON t.user_id = k.user_id WHERE k.spans > 0""",
    "trace_scope": f"""WITH {_BASE}, s AS (SELECT i.user_id, i.user_id % 7 <= 4 AS a, 's' || i.user_id LIKE 's1%' AS b, (SELECT count(DISTINCT g.conv) FROM agents g WHERE g.user_id = i.user_id AND g.conv NOT LIKE 'x%') AS spawns,
 (SELECT count(*) FROM root r WHERE r.user_id = i.user_id AND r.model = 'purchase' AND r.e % 20 IN (5, 15)) AS unpaired FROM ids i),
 n AS (SELECT count(*) AS t, count(*) FILTER (WHERE NOT a) AS x, count(*) FILTER (WHERE a AND NOT b) AS y, count(*) FILTER (WHERE a AND b AND spawns = 0) AS z FROM s)
 SELECT 's' || user_id AS session_id, 'proj-' || user_id % 7 AS project, spawns, unpaired, 'project matches proj-[0-4]$: excluded ' || x || ' of ' || t || '; session begins with s1: excluded ' || y || ' of ' || t - x || '; has spawned work: excluded ' || z || ' of ' || t - x - y AS criteria FROM s, n WHERE a AND b AND spawns > 0""",
}
