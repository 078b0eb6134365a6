"""The registered queries in SQL for another engine, written from what they should mean."""

from __future__ import annotations

_CALLS = """calls AS (SELECT user_id, event_id, event_type AS model, ts, epoch_us(ts) // 1000 AS ts_ms,
 CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS BIGINT) AS call_index, CAST(floor(value * 10) AS BIGINT) AS cache_read,
 event_id % 97 AS cache_creation, event_id % 13 AS input, event_id % 251 AS output,
 20 * (event_id % 13) + 25 * (event_id % 97) + 2 * CAST(floor(value * 10) AS BIGINT) + 20 * (event_id % 251) AS spend20 FROM events)"""
_MARKED = _CALLS + """, lagged AS (SELECT *, lag(cache_read) OVER w AS p_read, lag(cache_creation) OVER w AS p_creation, lag(ts_ms) OVER w AS p_ts FROM calls WINDOW w AS (PARTITION BY user_id ORDER BY call_index)),
 marked AS (SELECT *, CAST(sum(CASE WHEN cache_read < p_read THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY call_index ROWS UNBOUNDED PRECEDING) AS BIGINT) AS epoch FROM lagged)"""
_EPOCHS = _MARKED + """, bounds AS (SELECT user_id, epoch, min(call_index) AS start_call, max(call_index) AS end_call FROM marked GROUP BY user_id, epoch),
 epochs AS (SELECT b.user_id, b.epoch, b.start_call, b.end_call, CASE WHEN b.epoch = 0 THEN 0 ELSE m.cache_creation END AS rewritten, CASE WHEN b.epoch = 0 THEN 0 ELSE m.ts_ms - m.p_ts END AS gap
 FROM bounds b JOIN marked m ON m.user_id = b.user_id AND m.call_index = b.start_call)"""
_PREDICTED = _EPOCHS + """, predicted AS (SELECT m.*, m.call_index > b.start_call AS predictable,
 f.cache_read + coalesce((sum(m.cache_creation) OVER (PARTITION BY m.user_id, m.epoch ORDER BY m.call_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), 0) AS expected
 FROM marked m JOIN bounds b ON b.user_id = m.user_id AND b.epoch = m.epoch JOIN marked f ON f.user_id = m.user_id AND f.call_index = b.start_call)"""
_SEEN = """seen AS (SELECT conv_id, turn, role, text, CAST(coalesce(sum(CASE WHEN role = 'assistant' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS next_call FROM conversations)"""
_TURNS = _SEEN + """, totals AS (SELECT conv_id, count(*) FILTER (WHERE role = 'assistant') AS n FROM conversations GROUP BY conv_id),
 turns AS (SELECT s.conv_id, s.turn, CAST(row_number() OVER w - 1 AS BIGINT) AS turn_index, s.next_call AS first_call,
 CAST(coalesce(lead(s.next_call) OVER w - 1, greatest(0, t.n - 1)) AS BIGINT) AS last_call FROM seen s JOIN totals t ON t.conv_id = s.conv_id WHERE s.role = 'user' WINDOW w AS (PARTITION BY s.conv_id ORDER BY s.turn))"""
_CHANGE = 1_704_067_200_000 + 15 * 86_400_000
_RATED = _CALLS + f""", rated AS (SELECT *, CASE model WHEN 'view' THEN CASE WHEN ts_ms < {_CHANGE} THEN 3.0::DOUBLE ELSE 4.0::DOUBLE END WHEN 'click' THEN 1.0::DOUBLE WHEN 'purchase' THEN 5.0::DOUBLE WHEN 'signup' THEN 2.0::DOUBLE END AS rate FROM calls),
 priced AS (SELECT *, ((20 * input + 25 * cache_creation + 2 * cache_read) * rate + 20 * output * rate * 5) AS usd FROM rated)"""
_PARTS = """nodes AS (SELECT p_partkey AS id, CASE WHEN p_partkey > 0 THEN CASE WHEN (p_partkey // 4) % 50 = 7 THEN -(p_partkey // 4) ELSE p_partkey // 4 END END AS parent, p_brand AS brand, CAST(p_size AS BIGINT) AS own FROM part),
 up AS (SELECT id, id AS ancestor, CAST(0 AS BIGINT) AS distance FROM nodes UNION ALL SELECT u.id, n.parent, u.distance + 1 FROM up u JOIN nodes n ON n.id = u.ancestor JOIN nodes p ON p.id = n.parent)"""
_POINTS = """points AS (SELECT doc_id, CASE WHEN doc_id < 20 THEN 'rare' ELSE lang END AS model, source AS transcript, n_chars AS chars, CAST(len(string_split(text, ' ')) AS BIGINT) AS blocks, n_chars // 3 + 5 * CAST(len(string_split(text, ' ')) AS BIGINT) + doc_id % 11 AS output
 FROM documents)"""
_FIT = _POINTS + """, parity AS (SELECT model, transcript, row_number() OVER (PARTITION BY model ORDER BY transcript) % 2 = 1 AS train FROM (SELECT DISTINCT model, transcript FROM points)),
 both_ AS (SELECT p.*, q.train FROM points p JOIN parity q ON q.model = p.model AND q.transcript = p.transcript),
 m AS (SELECT model, count(*) AS n, count(DISTINCT transcript) AS transcripts, count(*) FILTER (WHERE NOT train) AS test_n,
 sum(chars::DOUBLE * chars) AS cc, sum(blocks::DOUBLE * blocks) AS bb, sum(chars::DOUBLE * blocks) AS cb, sum(chars::DOUBLE * output) AS cy, sum(blocks::DOUBLE * output) AS by_,
 sum(chars::DOUBLE * chars) FILTER (WHERE train) AS tcc, sum(blocks::DOUBLE * blocks) FILTER (WHERE train) AS tbb, sum(chars::DOUBLE * blocks) FILTER (WHERE train) AS tcb, sum(chars::DOUBLE * output) FILTER (WHERE train) AS tcy, sum(blocks::DOUBLE * output) FILTER (WHERE train) AS tby,
 sum(chars::DOUBLE) FILTER (WHERE NOT train) AS ec, sum(blocks::DOUBLE) FILTER (WHERE NOT train) AS eb, sum(output::DOUBLE) FILTER (WHERE NOT train) AS ey FROM both_ GROUP BY model),
 solved AS (SELECT *, (cy * bb - by_ * cb) / (cc * bb - cb * cb) AS a, (by_ * cc - cy * cb) / (cc * bb - cb * cb) AS b, (tcy * tbb - tby * tcb) / (tcc * tbb - tcb * tcb) AS ta, (tby * tcc - tcy * tcb) / (tcc * tbb - tcb * tcb) AS tb FROM m WHERE n >= 32 AND test_n > 0)"""

_SPLIT = _FIT + """, split AS (SELECT p.model, p.output, p.doc_id % 3 = 0 AS reasoned, CAST(floor(p.chars / (1 / s.a) + p.blocks * s.b + 0.5::DOUBLE) AS BIGINT) AS visible FROM points p LEFT JOIN solved s ON s.model = p.model AND s.a > 0)"""

SQL: dict[str, str] = {
    "epochs": f"WITH {_EPOCHS} SELECT user_id, epoch, start_call, end_call, CAST(rewritten AS BIGINT) AS rewritten, CAST(gap AS BIGINT) AS gap FROM epochs",
    "invalidation_excess": f"WITH {_EPOCHS} SELECT user_id, count(*) AS epochs, CAST(sum(rewritten) AS BIGINT) AS rewritten, CAST(sum(rewritten) * 23 AS BIGINT) AS excess20 FROM epochs GROUP BY user_id",
    "conservation": f"WITH {_PREDICTED} SELECT user_id, CAST(sum(cache_read) AS BIGINT) AS actual_read, CAST(sum(expected) AS BIGINT) AS predicted_read, count(*) FILTER (WHERE predictable AND cache_read = expected) AS exact_calls, count(*) FILTER (WHERE predictable) AS predictable_calls FROM predicted GROUP BY user_id",
    "cache_read_recurrence": f"WITH {_MARKED} SELECT user_id, count(*) AS sites, count(*) FILTER (WHERE cache_read = p_read + p_creation) AS exact FROM marked WHERE cache_read >= p_read GROUP BY user_id",
    "request_group_dedup": f"""WITH {_CALLS}, days AS (SELECT *, ts_ms // 86400000 AS day FROM calls), best AS (SELECT *, row_number() OVER (PARTITION BY user_id, day ORDER BY output DESC, call_index) AS r, last_value(output) OVER w AS last_output, first_value(model) OVER w AS first_model FROM days
 WINDOW w AS (PARTITION BY user_id, day ORDER BY call_index ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
 sizes AS (SELECT user_id, day, count(*) AS line_count, count(DISTINCT output) > 1 AS output_varies, CAST(row_number() OVER (PARTITION BY user_id ORDER BY min(call_index)) - 1 AS BIGINT) AS call_index FROM days GROUP BY user_id, day)
 SELECT b.user_id, b.day, b.output, b.input, b.cache_creation, b.cache_read, b.last_output, s.line_count, s.call_index, s.output_varies, b.first_model AS model FROM best b JOIN sizes s ON s.user_id = b.user_id AND s.day = b.day WHERE b.r = 1""",
    "next_call_index": f"WITH {_SEEN} SELECT conv_id, turn, role, next_call FROM seen",
    "turn_extents": f"WITH {_TURNS} SELECT * FROM turns",
    "calls_in_turns": f"WITH {_TURNS} SELECT s.conv_id, s.next_call AS call_index, max(t.turn_index) AS turn_index FROM seen s LEFT JOIN turns t ON t.conv_id = s.conv_id AND t.last_call >= t.first_call AND s.next_call >= t.first_call WHERE s.role = 'assistant' GROUP BY s.conv_id, s.next_call",
    "classify_carry_forward": f"""WITH {_CALLS}, decided AS (SELECT *, CASE WHEN model = 'purchase' THEN 'implementation' WHEN model = 'error' THEN 'verification' WHEN event_id % 5 = 0 THEN 'unclassified' END AS own FROM calls),
 runs AS (SELECT *, count(own) OVER (PARTITION BY user_id ORDER BY call_index ROWS UNBOUNDED PRECEDING) AS run FROM decided)
 SELECT user_id, call_index, coalesce(max(own) OVER (PARTITION BY user_id, run), 'none') AS activity, own IS NULL AND run > 0 AS carried FROM runs""",
    "strata_stack": f"WITH {_MARKED}, s AS (SELECT user_id, call_index, epoch, cache_creation, sum(cache_creation) OVER (PARTITION BY user_id, epoch ORDER BY call_index ROWS UNBOUNDED PRECEDING) AS y1 FROM marked WHERE cache_creation > 0) SELECT user_id, call_index, epoch, CAST(y1 - cache_creation AS BIGINT) AS y0, CAST(y1 AS BIGINT) AS y1 FROM s",
    "report_select": "WITH r AS (SELECT c_custkey, CAST(c_nationkey AS BIGINT) AS c_nationkey, c_custkey % 3 = 0 AS spawned, row_number() OVER (PARTITION BY c_nationkey ORDER BY (c_custkey % 3 = 0) DESC, c_custkey DESC) AS n FROM customer) SELECT c_custkey, c_nationkey, spawned FROM r WHERE n <= 2 ORDER BY spawned DESC, c_custkey DESC LIMIT 24",
    "tool_answers": """WITH o AS (SELECT CASE WHEN o_orderkey % 7 = 0 THEN -1 - o_orderkey ELSE o_orderkey END AS key FROM orders), a AS (SELECT l_orderkey AS key, max(l_partkey * 100000 + l_suppkey) AS last, min(l_partkey * 100000 + l_suppkey) AS slot, count(*) - 1 AS repeats FROM lineitem GROUP BY l_orderkey)
 SELECT o.key, a.last // 100000 AS l_partkey, a.last % 100000 AS l_suppkey, a.slot, a.repeats FROM o LEFT JOIN a ON a.key = o.key""",
    "unmatched_answers": "SELECT l_orderkey AS key, count(*) AS n FROM lineitem WHERE l_orderkey % 7 = 0 OR l_orderkey NOT IN (SELECT o_orderkey FROM orders) GROUP BY l_orderkey",
    "duplicate_answers": "SELECT l_orderkey AS key, count(*) - 1 AS duplicates FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 7 <> 0) GROUP BY l_orderkey HAVING count(*) > 1",
    "command_fork_as_of": f"WITH {_CALLS} SELECT f.user_id, f.event_id, coalesce(max(v.call_index), 0) AS call_index FROM calls f LEFT JOIN calls v ON v.user_id = f.user_id AND v.model = 'view' AND v.ts_ms <= f.ts_ms WHERE f.model = 'purchase' GROUP BY f.user_id, f.event_id",
    "true_cost": f"""WITH {_EPOCHS}, a AS (SELECT user_id, event_id, call_index AS born, event_id % 1000 AS tokens FROM calls WHERE model = 'purchase'),
 l AS (SELECT a.user_id, a.event_id, a.born, a.tokens, count(*) AS writes, sum(e.end_call - greatest(e.start_call, a.born)) AS reads FROM a JOIN epochs e ON e.user_id = a.user_id AND e.end_call >= a.born GROUP BY ALL)
 SELECT user_id, event_id, born, writes, CAST(reads AS BIGINT) AS reads, CAST(tokens * (25 * writes + 2 * reads) AS BIGINT) AS total20, round(CASE WHEN tokens = 0 THEN 0.0::DOUBLE ELSE (25 * writes + 2 * reads) / 20.0::DOUBLE END, 6) AS multiple FROM l""",
    "price_calls": f"""WITH {_RATED} SELECT user_id, round(coalesce(sum(usd), 0.0::DOUBLE) / 20000000.0::DOUBLE, 6) AS usd, CAST(sum(CASE WHEN rate IS NOT NULL THEN spend20 ELSE 0 END) AS BIGINT) AS priced, CAST(sum(CASE WHEN rate IS NULL THEN spend20 ELSE 0 END) AS BIGINT) AS unpriced,
 count(*) FILTER (WHERE rate IS NULL) AS unpriced_calls, count(*) AS calls, coalesce(string_agg(DISTINCT CASE WHEN rate IS NULL THEN model END, ','), '') AS unpriced_models FROM priced GROUP BY user_id""",
    "sidecar_pairing": "SELECT coalesce(p.id, s.s_suppkey) AS id, CASE WHEN p.id IS NULL THEN 'meta present, transcript missing' WHEN s.s_suppkey IS NULL THEN 'transcript present, meta missing' ELSE 'paired' END AS pairing FROM (SELECT CASE WHEN p_partkey % 3 = 0 THEN -1 - p_partkey ELSE p_partkey END AS id FROM part) p FULL OUTER JOIN supplier s ON s.s_suppkey = p.id",
    "cause_attribution": f"""WITH {_CALLS}, a AS (SELECT user_id, CASE WHEN event_id % 3 = 0 THEN -2 ELSE call_index END + ((event_id % 4000 + 2) // 4) % 2 AS call_index, (event_id % 4000 + 2) // 4 AS tokens FROM calls),
 s AS (SELECT user_id, call_index, sum(tokens) AS t, count(*) AS n FROM a GROUP BY user_id, call_index)
 SELECT c.user_id, c.call_index, 20 * c.input + 25 * c.cache_creation AS exact20, CAST(25 * coalesce(s.t, 0) AS BIGINT) AS caused20, CAST(20 * c.input + 25 * c.cache_creation - 25 * coalesce(s.t, 0) AS BIGINT) AS unattributed20, coalesce(s.n, 0) AS causes
 FROM calls c LEFT JOIN s ON s.user_id = c.user_id AND s.call_index = c.call_index""",
    "causes_by_label": "SELECT user_id, event_type AS label, count(*) AS n, CAST(sum((event_id % 4000 + 2) // 4) AS BIGINT) AS tokens, CAST(25 * sum((event_id % 4000 + 2) // 4) AS BIGINT) AS cost20 FROM events GROUP BY user_id, event_type",
    "arrivals_union": f"""WITH {_SEEN}, a AS (SELECT conv_id, CASE WHEN role = 'assistant' THEN next_call + 1 ELSE next_call END AS born, CASE role WHEN 'user' THEN 'userText' WHEN 'system' THEN 'attachment' ELSE 'assistantOutput' END AS source,
 CASE WHEN role = 'assistant' THEN 'exact' ELSE 'estimated' END AS basis, CASE WHEN role = 'assistant' THEN length(text) ELSE (length(text) + 2) // 4 END AS tokens FROM seen)
 SELECT conv_id, born, source, basis, CAST(sum(tokens) AS BIGINT) AS tokens, count(*) AS n FROM a GROUP BY ALL""",
    "arena_basis": "WITH a AS (SELECT conv_id, role = 'assistant' AS e, CASE WHEN role = 'assistant' THEN length(text) ELSE (length(text) + 2) // 4 END AS t FROM conversations), s AS (SELECT conv_id, CAST(sum(CASE WHEN e THEN t ELSE 0 END) AS BIGINT) AS exact, CAST(sum(CASE WHEN e THEN 0 ELSE t END) AS BIGINT) AS estimated FROM a GROUP BY conv_id) SELECT conv_id, exact, estimated, round(CASE WHEN exact + estimated = 0 THEN 0.0::DOUBLE ELSE exact::DOUBLE / (exact + estimated) END, 6) AS exact_share FROM s",
    "ledger_by_model": f"WITH {_CALLS}, s AS (SELECT model AS key, CAST(sum(spend20) AS BIGINT) AS amount, count(*) AS calls, CAST(sum(CASE WHEN event_id % 4 = 0 THEN spend20 ELSE 0 END) AS BIGINT) AS flagged FROM calls GROUP BY model) SELECT key, amount, calls, flagged, round(amount::DOUBLE / (SELECT sum(amount)::DOUBLE FROM s), 6) AS share, round(flagged::DOUBLE / amount, 6) AS flagged_share FROM s",
    "session_ledgers": f"WITH {_CALLS}, s AS (SELECT user_id, model AS key, CAST(sum(spend20) AS BIGINT) AS amount, count(*) AS calls FROM calls GROUP BY user_id, model) SELECT user_id, key, amount, calls, round(amount::DOUBLE / sum(amount::DOUBLE) OVER (PARTITION BY user_id), 6) AS share FROM s",
    "corpus_ledger": f"WITH {_CALLS}, s AS (SELECT user_id, model AS key, CAST(floor(sum(spend20)::DOUBLE / 20 + 0.5::DOUBLE) AS BIGINT) AS cost, count(*) AS calls FROM calls GROUP BY user_id, model), k AS (SELECT key, CAST(sum(cost) AS BIGINT) AS cost, CAST(sum(calls) AS BIGINT) AS calls FROM s GROUP BY key) SELECT key, cost, calls, round(cost::DOUBLE / (SELECT sum(cost)::DOUBLE FROM k), 6) AS share FROM k",
    "tool_ledger": "WITH n AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey) SELECT l.l_returnflag, round(sum(o.o_custkey::DOUBLE / n.n), 2) AS amount, count(*) AS uses FROM lineitem l JOIN n ON n.l_orderkey = l.l_orderkey JOIN orders o ON o.o_orderkey = l.l_orderkey GROUP BY l.l_returnflag",
    "cache_ledger": "\nUNION ALL ".join(
        f"SELECT user_id, '{k}' AS key, CAST(sum({v}) AS BIGINT) AS amount20 FROM events GROUP BY user_id"
        for k, v in (("uncached input", "20 * (event_id % 13)"), ("cache writes", "25 * (event_id % 97)"), ("cache reads", "2 * CAST(floor(value * 10) AS BIGINT)"), ("output", "20 * (event_id % 251)"))
    ),
    "coverage_by_tier": f"""WITH {_CALLS}, t AS (SELECT user_id, spend20::DOUBLE AS s, CASE event_id % 7 WHEN 0 THEN 'marker' WHEN 6 THEN 'none' ELSE 'rule' END AS tier FROM calls)
 SELECT user_id, CAST(sum(s) AS BIGINT) AS total, round(coalesce(sum(s) FILTER (WHERE tier = 'marker'), 0) / sum(s), 6) AS tier_marker, round(coalesce(sum(s) FILTER (WHERE tier = 'rule'), 0) / sum(s), 6) AS tier_rule, 0.0::DOUBLE AS tier_judge, 0.0::DOUBLE AS tier_hand,
 round(coalesce(sum(s) FILTER (WHERE tier = 'none'), 0) / sum(s), 6) AS tier_none, round(coalesce(sum(s) FILTER (WHERE tier = 'none'), 0) / sum(s), 6) AS unclassified FROM t GROUP BY user_id""",
    "corpus_coverage": f"WITH {_CALLS} SELECT round(sum(CASE WHEN event_id % 7 = 6 THEN spend20 ELSE 0 END)::DOUBLE / sum(spend20)::DOUBLE, 6) AS unclassified FROM calls",
    "dominant_source": """WITH s AS (SELECT l_orderkey, l_returnflag, sum(CAST(l_quantity AS BIGINT)) AS q FROM lineitem GROUP BY l_orderkey, l_returnflag), r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY q DESC, l_returnflag) AS n, sum(q) OVER (PARTITION BY l_orderkey) AS w FROM s)
 SELECT l_orderkey, CASE WHEN w > 0 THEN l_returnflag ELSE 'unattributed' END AS source, round(CASE WHEN w > 0 THEN q::DOUBLE / w::DOUBLE ELSE 0.0::DOUBLE END, 6) AS share FROM r WHERE n = 1""",
    "scope_exclusions": """WITH f AS (SELECT c_mktsegment LIKE 'BUILDING%' OR c_mktsegment LIKE 'MACHINERY%' AS a, c_acctbal >= 0 AS b, CAST(c_custkey AS VARCHAR) LIKE '1%' AS c FROM customer)
 SELECT count(*) FILTER (WHERE NOT a) AS segment, count(*) FILTER (WHERE a AND NOT b) AS balance, count(*) FILTER (WHERE a AND b AND NOT c) AS prefix, count(*) FILTER (WHERE a AND b AND c) AS kept FROM f""",
    "findings": f"""WITH {_EPOCHS}, w AS (SELECT user_id, CAST(sum(spend20) AS BIGINT) AS whole, CAST(sum(CASE WHEN event_id % 3 = 0 THEN 20 * output ELSE 0 END) AS BIGINT) AS reasoning, CAST(sum(CASE WHEN model IN ('view', 'click', 'purchase', 'signup') THEN 0 ELSE spend20 END) AS BIGINT) AS unpriced FROM calls GROUP BY user_id),
 f AS (SELECT c.user_id, 'startup' AS finding, CAST(0 AS BIGINT) AS at_call, 20 * c.input + 25 * c.cache_creation AS cost20, w.whole FROM calls c JOIN w ON w.user_id = c.user_id WHERE c.call_index = 0
 UNION ALL SELECT e.user_id, CASE WHEN e.gap >= 300000 THEN 'cache expired' ELSE 'prefix changed' END, e.start_call, CAST(23 * e.rewritten AS BIGINT), w.whole FROM epochs e JOIN w ON w.user_id = e.user_id WHERE e.epoch > 0
 UNION ALL SELECT user_id, 'reasoning share of output', NULL, reasoning, whole FROM w UNION ALL SELECT user_id, 'pricing gap', NULL, unpriced, whole FROM w)
 SELECT user_id, finding, at_call, cost20, CASE WHEN finding = 'startup' OR (at_call IS NULL AND 20 * cost20 <= whole) THEN 'note' WHEN 20 * cost20 > whole THEN 'high' ELSE 'medium' END AS severity, round(CASE WHEN whole = 0 THEN 0.0::DOUBLE ELSE cost20::DOUBLE / whole END, 6) AS share FROM f""",
    "synopsis": f"""WITH {_CALLS}, s AS (SELECT user_id, model, sum(spend20) AS v FROM calls GROUP BY user_id, model), t AS (SELECT user_id, model, v, row_number() OVER (PARTITION BY user_id ORDER BY v DESC, model) AS n, sum(v) OVER (PARTITION BY user_id) AS whole FROM s),
 p AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY CASE model WHEN 'purchase' THEN 0 WHEN 'view' THEN 1 ELSE 2 END, call_index) AS n FROM calls WHERE (model IN ('purchase', 'view') AND output > 20) OR model = 'click')
 SELECT t.user_id, CASE WHEN t.whole > 0 THEN t.model ELSE 'unattributed' END AS dominant, p.event_id AS opening FROM t LEFT JOIN p ON p.user_id = t.user_id AND p.n = 1 WHERE t.n = 1""",
    "tokenizer_fit": f"WITH {_FIT} SELECT model, round(1 / a, 5) AS chars_per_token, round(b, 5) AS tokens_per_block, round((ta * ec + tb * eb - ey) / ey, 5) AS held_out_error, n AS points, transcripts FROM solved WHERE a > 0",
    "output_totals": f"""WITH {_SPLIT} SELECT model, CAST(sum(output) AS BIGINT) AS total, CAST(coalesce(sum(visible), 0) AS BIGINT) AS visible, CAST(coalesce(sum(output - visible) FILTER (WHERE reasoned), 0) AS BIGINT) AS reasoning, CAST(coalesce(sum(output - visible) FILTER (WHERE NOT reasoned), 0) AS BIGINT) AS estimator_error,
 CAST(coalesce(sum(output) FILTER (WHERE visible IS NULL), 0) AS BIGINT) AS uncalibrated, count(*) FILTER (WHERE reasoned AND visible IS NOT NULL) AS calls_with_reasoning, count(*) FILTER (WHERE visible IS NULL) AS uncalibrated_calls, count(*) AS calls, CASE WHEN max(visible) IS NULL THEN model ELSE '' END AS uncalibrated_models FROM split GROUP BY model""",
    "forest_depth": f"WITH RECURSIVE {_PARTS}, d AS (SELECT id, max(distance) AS depth FROM up GROUP BY id) SELECT d.id, d.depth, u.ancestor AS top FROM d JOIN up u ON u.id = d.id AND u.distance = d.depth",
    "forest_orphans": "SELECT p_partkey AS id, 'parent -' || CAST(p_partkey // 4 AS VARCHAR) || ' not found' AS why FROM part WHERE (p_partkey // 4) % 50 = 7",
    "tree_rollup": f"WITH RECURSIVE {_PARTS} SELECT u.ancestor AS root, CAST(sum(n.own) AS BIGINT) AS tokens, CAST(sum(CASE WHEN n.brand = 'Brand#11' THEN n.own ELSE 0 END) AS BIGINT) AS brand_tokens, count(*) AS nodes, max(n.own) AS widest FROM up u JOIN nodes n ON n.id = u.id GROUP BY u.ancestor",
    "tree_ancestors": f"WITH RECURSIVE {_PARTS} SELECT id, ancestor, distance FROM up",
    "token_layout": f"""WITH RECURSIVE {_PARTS}, tops AS (SELECT id, arg_max(ancestor, distance) AS tree FROM up GROUP BY id), steps AS (SELECT u.id, string_agg(lpad(CAST(u.ancestor AS VARCHAR), 20, '0'), '/' ORDER BY u.distance DESC) || '~' AS k FROM up u GROUP BY u.id),
 w AS (SELECT n.id, CASE WHEN n.id IN (SELECT parent FROM nodes WHERE parent IS NOT NULL) THEN n.own ELSE greatest(n.own, 1) END AS w FROM nodes n),
 sub AS (SELECT u.ancestor AS id, sum(w.w) AS width FROM up u JOIN w ON w.id = u.id GROUP BY u.ancestor),
 laid AS (SELECT w.id, sum(w.w) OVER (PARTITION BY t.tree ORDER BY s.k ROWS UNBOUNDED PRECEDING) AS e FROM w JOIN steps s ON s.id = w.id JOIN tops t ON t.id = w.id)
 SELECT l.id, CAST(l.e - sub.width AS BIGINT) AS start, CAST(l.e AS BIGINT) AS "end", CAST(sub.width AS BIGINT) AS width FROM laid l JOIN sub ON sub.id = l.id""",
    "session_list": f"""WITH {_RATED}, d AS (SELECT *, CAST(floor(log10(greatest(event_id, 1)::DOUBLE + 0.5::DOUBLE)) AS BIGINT) % 3 AS depth FROM priced)
 SELECT user_id, min(ts_ms) AS started_ms, (max(ts_ms) - min(ts_ms)) // 60000 AS wall_min, count(*) AS calls, count(*) FILTER (WHERE depth > 0) AS spawned_calls, max(depth) AS max_depth, CAST(sum(spend20) AS BIGINT) AS spend20, CAST(sum(CASE WHEN depth > 0 THEN spend20 ELSE 0 END) AS BIGINT) AS spawned20,
 round(coalesce(sum(usd), 0.0::DOUBLE) / 20000000.0::DOUBLE, 6) AS usd, CAST(sum(CASE WHEN rate IS NULL THEN spend20 ELSE 0 END) AS BIGINT) AS unpriced20 FROM d GROUP BY user_id""",
    "identity_audit": f"""WITH RECURSIVE {_PREDICTED}, {_PARTS}, days AS (SELECT user_id, ts_ms // 86400000 AS day, call_index, output FROM calls),
 last AS (SELECT user_id, day, max(output) AS output, arg_max(output, call_index) AS last_output, count(DISTINCT output) AS n FROM days GROUP BY user_id, day),
 tops AS (SELECT id, arg_max(ancestor, distance) AS top FROM up GROUP BY id), gathered AS (SELECT u.ancestor AS top, sum(n.own) AS g FROM up u JOIN nodes n ON n.id = u.id GROUP BY u.ancestor), flat AS (SELECT t.top, sum(n.own) AS f FROM tops t JOIN nodes n ON n.id = t.id GROUP BY t.top),
 c AS (SELECT 'cache-read-recurrence' AS identity, cache_read <> p_read + p_creation AS v FROM predicted WHERE cache_read >= p_read UNION ALL SELECT 'residency-predicts-cache-read', cache_read <> expected FROM predicted WHERE predictable
 UNION ALL SELECT 'tree-holds-every-token', g.g <> f.f FROM flat f JOIN gathered g ON g.top = f.top UNION ALL SELECT 'cache-creation-accounted', cache_creation > 95 FROM predicted UNION ALL SELECT 'output-snapshot-agrees', output <> last_output FROM last WHERE n > 1),
 r AS (SELECT * FROM (VALUES ('tree-holds-every-token', 0.0::DOUBLE), ('cache-creation-accounted', 0.0::DOUBLE), ('cache-read-recurrence', 0.05::DOUBLE), ('output-snapshot-agrees', 0.001::DOUBLE), ('residency-predicts-cache-read', 0.3::DOUBLE)) AS t(identity, rate)),
 n AS (SELECT r.identity, r.rate, count(c.identity) AS sites, count(*) FILTER (WHERE c.v) AS violations FROM r LEFT JOIN c ON c.identity = r.identity GROUP BY r.identity, r.rate)
 SELECT identity, sites, violations, CAST(floor(rate * sites) AS BIGINT) AS allowed, violations <= CAST(floor(rate * sites) AS BIGINT) AS held FROM n""",
    "derived_ids": "SELECT n_name, substr(sha256('tokens' || chr(10) || n_name), 1, 32) AS trace, substr(sha256('tokens' || chr(10) || n_name || chr(10) || CAST(n_nationkey AS VARCHAR)), 1, 16) AS span FROM nation",
    "parse_stats": "SELECT event_type AS kind, count(*) AS lines, count(*) FILTER (WHERE event_id % 10 = 0) AS unparseable, CAST(sum(CASE WHEN event_id % 10 <> 0 THEN CAST(regexp_extract(props, '[0-9]+') AS BIGINT) END) AS BIGINT) AS total FROM events GROUP BY event_type",
    "tsv_rows": "SELECT doc_id, translate(source, chr(9) || chr(10) || chr(13), '   ') || chr(9) || translate(lang, chr(9) || chr(10) || chr(13), '   ') || chr(9) || translate(text, chr(9) || chr(10) || chr(13), '   ') AS line FROM documents",
    "workspace_leaf": "SELECT page_id, regexp_extract(regexp_replace(url, '[?#].*$', ''), '([^/]+)/*$', 1) AS leaf FROM pages",
    "turn_origins": """SELECT doc_id, CASE doc_id % 8 WHEN 0 THEN 'command' WHEN 1 THEN 'skill' WHEN 4 THEN 'command' WHEN 5 THEN 'agent' WHEN 7 THEN 'user' ELSE 'harness' END AS kind,
 CASE doc_id % 8 WHEN 0 THEN 'next' WHEN 1 THEN source WHEN 2 THEN 'shell command' WHEN 3 THEN 'task notification' WHEN 4 THEN 'clear' WHEN 6 THEN 'shell output' ELSE '' END AS value,
 CASE doc_id % 8 WHEN 0 THEN '/next ' || lang WHEN 1 THEN 'skill: ' || source WHEN 2 THEN '! ls ' || source WHEN 3 THEN '[task notification]' WHEN 4 THEN '/clear' WHEN 5 THEN 'via agent: ' || source WHEN 6 THEN '[shell output]' ELSE source END AS snippet,
 doc_id % 8 = 4 AS control FROM documents""",
    "model_ids": "SELECT user_id, string_agg(DISTINCT m, ', ' ORDER BY m) AS models, count(*) AS n FROM (SELECT user_id, CASE WHEN event_id % 2 = 0 THEN event_type ELSE event_type || '-v2' END AS m FROM events) GROUP BY user_id",
    "lineage_cohorts": "SELECT CASE event_id % 3 WHEN 0 THEN 'main' WHEN 1 THEN 'review' ELSE 'review > guide' END AS path, event_id % 3 AS depth, count(*) AS calls, count(*) FILTER (WHERE event_id % 3 = 0) AS main, count(*) FILTER (WHERE event_id % 3 > 0) AS spawned, count(*) FILTER (WHERE event_id % 3 > 0 AND user_id = 1) AS in_a1review, count(*) FILTER (WHERE event_id % 3 = 2) AS grandchildren FROM events GROUP BY event_id % 3",
    "fan_out": "SELECT user_id, round(count(*)::DOUBLE / count(DISTINCT event_type), 6) AS fan_out FROM events GROUP BY user_id",
    "distinct_projects": r"""WITH p AS (SELECT regexp_replace(url, '[?#].*$', '', 's') AS path FROM pages), l AS (SELECT path, regexp_extract(regexp_replace(path, '[/\\\\]+$', ''), '[^/\\\\]*$') AS leaf FROM p)
 SELECT leaf, count(DISTINCT path) AS projects, count(*) AS sessions FROM l GROUP BY leaf""",
    "corpus_report": f"""WITH {_RATED}, s AS (SELECT user_id, count(*) AS calls, CAST(sum(spend20) AS BIGINT) AS spend20, CAST(floor(round(coalesce(sum(usd), 0.0::DOUBLE) / 20000000.0::DOUBLE, 6) * 1000000 + 0.5) AS BIGINT) AS micro_usd FROM priced GROUP BY user_id)
 SELECT user_id, calls, spend20, micro_usd, row_number() OVER (ORDER BY micro_usd DESC, user_id) AS place, CAST(sum(micro_usd) OVER () AS BIGINT) AS list_micro_usd, CAST(sum(calls) OVER () AS BIGINT) AS list_calls FROM s""",
    "depth_disagreements": f"""WITH RECURSIVE {_PARTS}, d AS (SELECT id, max(distance) AS depth FROM up GROUP BY id), x AS (SELECT id, depth, CAST(CASE WHEN id = 0 THEN 0 ELSE floor(log2(id::DOUBLE + 0.5) / 2) + 1 END AS BIGINT) AS declared FROM d)
 SELECT id, declared, depth FROM x WHERE declared <> depth""",
    "output_ledger": f"""WITH {_SPLIT}, p AS (SELECT model, output AS whole, unnest(['visible', 'reasoning', 'estimator_error', 'uncalibrated']) AS key, unnest([coalesce(visible, 0), CASE WHEN reasoned AND visible IS NOT NULL THEN output - visible ELSE 0 END, CASE WHEN NOT reasoned AND visible IS NOT NULL THEN output - visible ELSE 0 END, CASE WHEN visible IS NULL THEN output ELSE 0 END]) AS v FROM split)
 SELECT model, key, CAST(sum(v) AS BIGINT) AS amount, round(sum(v)::DOUBLE / sum(whole)::DOUBLE, 6) AS share FROM p GROUP BY model, key""",
}
