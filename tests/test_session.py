"""A session of four calls with spawned agents, its expected figures fixed before its text."""

from __future__ import annotations

import json

import pytest

from tracemill.plans import session
from tracemill.sources import transcripts

BASE = "2026-08-01T10:00:{:02d}.000Z"


def assistant(second, request, output, blocks, read=0, creation=0, tiers=None):
    usage = {"input_tokens": 5, "cache_creation_input_tokens": creation, "cache_read_input_tokens": read, "output_tokens": output}
    if tiers is not None:
        usage["cache_creation"] = tiers
    return {"type": "assistant", "uuid": f"u{request}{second}", "timestamp": BASE.format(second), "requestId": request, "message": {"model": "model-a-20250101", "usage": usage, "content": blocks}}


def user(second, content):
    return {"type": "user", "uuid": f"q{second}", "timestamp": BASE.format(second), "cwd": "/home/u/project", "message": {"role": "user", "content": content}}


def use(i, name, **given):
    return {"type": "tool_use", "id": i, "name": name, "input": given}


def result(second, i, text):
    return user(second, [{"type": "tool_result", "tool_use_id": i, "content": text}])


ROOT = [
    user(0, "please review the parser of this project"),
    assistant(1, "r0", 50, [{"type": "text", "text": "ok"}]),
    assistant(2, "r0", 100, [use("s0", "Skill", skill="laws:code")], creation=100),
    assistant(3, "r1", 200, [use("t1", "Read", file_path="src/parser.ts")], read=100, creation=20, tiers={"5m": 20, "1h": 4}),
    result(4, "t1", "x" * 40),
    {"type": "attachment", "timestamp": BASE.format(4), "attachment": {"type": "file", "content": "abc"}},
    assistant(5, "r2", 300, [use("s2", "Skill", skill="code-review"), use("toolu_review", "Agent", prompt="go")], read=124, creation=10),
    assistant(6, "r3", 400, [use("t3", "Edit", file_path="src/parser.ts")], read=50, creation=7),
    {"type": "summary"},
]
AGENTS = {
    "a_review": (
        [assistant(10, "v0", 150, [use("w0", "Write", file_path="src/parser.ts")]), assistant(11, "v1", 250, [use("toolu_guide", "Agent", prompt="guide")])],
        {"agentType": "code-review", "description": "d", "toolUseId": "toolu_review", "spawnDepth": 1},
    ),
    "a_guide": ([assistant(12, "g0", 90, [use("g", "Read", file_path="README.md")])], {"agentType": "guide", "toolUseId": "toolu_guide", "spawnDepth": 1}),
    "a_recap": ([assistant(20, "c0", 120, [use("b", "Bash", command="git log")])], {"agentType": "general", "spawnDepth": 1}),
    "a_lost": ([assistant(21, "l0", 7777, [])], {"agentType": "lost", "toolUseId": "toolu_vanished", "spawnDepth": 1}),
    "a_stray": ([assistant(22, "y0", 8888, [])], {"agentType": "stray", "spawnDepth": 4}),
}


@pytest.fixture(scope="module")
def analysis(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("corpus")
    (root / "proj").mkdir()
    lines = [json.dumps(x) for x in ROOT]
    (root / "proj" / "sess1.jsonl").write_text("\n".join([*lines[:3], "", "{not json", *lines[3:]]))
    sub = root / "proj" / "sess1" / "subagents"
    sub.mkdir(parents=True)
    for name, (rows, meta) in AGENTS.items():
        (sub / f"agent-{name}.jsonl").write_text("\n".join(map(json.dumps, rows)))
        (sub / f"agent-{name}.meta.json").write_text(json.dumps(meta))
    return session.analyze(spark, str(root))


def test_request_groups(analysis):
    rows = analysis.calls.filter("conv_id = ''").orderBy("call_index").collect()
    assert [(r["output"], r["line_count"], r["output_varies"], len(r["blocks"])) for r in rows] == [(100, 2, True, 2), (200, 1, False, 1), (300, 1, False, 2), (400, 1, False, 1)]
    assert [(r["cache_creation"], r["cc_flat"]) for r in rows] == [(100, None), (24, 20), (10, None), (7, None)]


def test_stats_count_what_cannot_be_parsed(analysis):
    kinds = {r["kind"]: r["count"] for r in analysis.records.filter("conv_id = ''").groupBy("kind").count().collect()}
    assert kinds == {"user": 2, "assistant": 5, "attachment": 1, "meta": 1, "unparseable": 1}


def test_forest(analysis):
    rows = {r["agent_id"]: r for r in analysis.forest.collect()}
    assert [h["agent_id"] for h in rows["a_guide"]["lineage"]] == ["a_review", "a_guide"]
    assert (rows["a_review"]["spawned_at_call"], rows["a_review"]["via"]) == (2, "tool_use")
    assert (rows["a_recap"]["spawned_at_call"], rows["a_recap"]["via"]) == (3, "command")
    assert "toolu_vanished" in rows["a_lost"]["why"] and "depth 3" in rows["a_stray"]["why"]


def test_labels(analysis):
    rows = {(r["conv_id"], r["call_index"]): (r["activity"], r["tier"]) for r in analysis.labels.collect()}
    assert [rows["", i] for i in range(4)] == [("orientation", "marker"), ("exploration", "rule"), ("review", "marker"), ("implementation", "rule")]
    assert rows["a_review", 0] == rows["a_guide", 0] == ("review", "marker") and rows["a_recap", 0] == ("implementation", "rule")


def test_tree_holds_every_placed_token(analysis):
    rolled = session.rolled_up(analysis.spans)
    assert rolled.filter("kind = 'session'").first()["all_output"] == 1610
    assert {r["span_id"]: r["all_output"] for r in rolled.filter("kind = 'subagent'").collect()} == {"subagent:a_review": 490, "subagent:a_guide": 90, "subagent:a_recap": 120}
    by_depth = {r["d"]: r["s"] for r in analysis.spans.selectExpr("size(lineage) as d", "output").groupBy("d").agg({"output": "sum"}).withColumnRenamed("sum(output)", "s").collect()}
    assert by_depth == {0: 1000, 1: 520, 2: 90}
    assert analysis.spans.count() == analysis.spans.select("span_id").distinct().count()


def test_arrivals_and_tools(analysis):
    rows = analysis.arrivals.filter("conv_id = ''").collect()
    got = sorted((r["born"], r["source"], r["tokens"]) for r in rows)
    assert (0, "userText", 10) in got and (2, "toolResult", 10) in got and (2, "attachment", 8) in got and (4, "assistantOutput", 400) in got
    tools = {r["tool_use_id"]: r["result_chars"] for r in analysis.tools.filter("conv_id = ''").collect()}
    assert tools == {"s0": None, "t1": 40, "s2": None, "toolu_review": None, "t3": None}


def test_turns(analysis):
    t = analysis.turns.filter("conv_id = ''").first()
    assert (t["first_call"], t["last_call"], t["origin"]["kind"]) == (0, 3, "user")


@pytest.mark.parametrize("value,length", [(None, 0), ("aé😀", 4), ({"a": 1.0, "b": [1, "x"]}, 19), (1e2, 3)])
def test_json_length(value, length):
    assert transcripts.json_length(value) == length


def test_every_text_parses_to_a_record():
    for raw in ('{"type":"assistant"}', "[]", "3", "{", '{"type":"user","message":{"content":[7,{"type":"image"}]}}', '{"type":"zzz"}'):
        assert transcripts.parse_line(raw)["kind"] in {"assistant", "user", "unknown", "unparseable", "meta"}


def test_lines_that_no_column_can_hold(spark):
    """Numbers beyond 64 bits, infinite ones, lone surrogates and deep nesting give records, and the job goes on."""
    usage = '{"type":"assistant","requestId":"r","message":{"usage":{"input_tokens":%s,"cache_creation":{"a":%s,"b":1}}}}'
    lines = [usage % ("1e999", "9" * 30), usage % ("-1e999", "9" * 5000), '{"type":"system","durationMs":1e400}', '{"type":"user","uuid":"\\ud800","message":{"content":"a\\ud83d"}}', "[" * 100_000, '{"type":"user","message":{"content":' + "[" * 900 + "]" * 900 + "}}", '{"type":"attachment","attachment":{"x":1e999},"timestamp":"0001-01-01T00:00:00+14:00"}']
    table = spark.createDataFrame([("s", "", "p", i, x) for i, x in enumerate(lines)], "session_id string, conv_id string, project string, line_no long, value string")
    rows = {r["line_no"]: r for r in transcripts.parse_lines(table).collect()}
    assert len(rows) == 7 and [rows[i]["input"] for i in (0, 1)] == [2**63 - 1, -(2**63)] and rows[0]["cache_creation"] == 2**63 - 1
    assert rows[2]["duration_ms"] == 2**63 - 1 and rows[3]["uuid"] == "\ufffd" and rows[3]["snippet"] == "a\ufffd" and rows[4]["kind"] == "unparseable" and rows[6]["chars"] == 10


def test_report(spark, analysis):
    from tracemill.plans import report

    rates = spark.createDataFrame([("model-a", None, None, 2.0, 10.0)], "model string, valid_from long, valid_to long, in_rate double, out_rate double")
    row = report.session_list(analysis, rates).first()
    # 8 placed calls of 5 input tokens, 141 written, 274 read, 1610 output
    spend = 40 + 1.25 * 141 + 0.1 * 274 + 1610
    assert (row["calls"], row["spawned_calls"], row["max_depth"], row["project"], row["models"]) == (8, 4, 2, "project", "model-a")
    assert row["tok_eq"] == int(spend + 0.5) and row["usd"] == pytest.approx(((spend - 1610) * 2 + 16100) / 1e6, abs=1e-4)
    rows = report.call_rows(analysis)
    for r in report.ledgers(rows).filter("ledger <> 'tool'").groupBy("ledger").agg({"share": "sum"}).collect():
        assert r["sum(share)"] == pytest.approx(1.0)
    assert {r["finding"] for r in report.findings(analysis).collect()} == {"prefix changed", "largest tool result", "spawn cold start", "startup payload"}
    held = {r["identity"]: (r["sites"], r["held"]) for r in report.audits(analysis, session.rolled_up(analysis.spans)).collect()}
    assert held["tree-holds-every-token"] == (4, True) and held["cache-creation-accounted"] == (1, True) and held["output-snapshot-agrees"] == (1, True)
    assert held["cache-read-recurrence"] == (3, True) and held["residency-predicts-cache-read"] == (2, True)
    totals = report.output_totals(analysis).first()
    assert totals["total"] == totals["uncalibrated"] and totals["uncalibrated_models"] == "model-a"
    assert report.attribution(analysis).filter("conv_id = '' and call_index = 0").first()["unattributed"] == pytest.approx(5 + 125 - 12.5)
    assert report.strata(analysis).filter("call_index = 0").first()["source"] == "startup"
    assert report.coverage(rows).first()["unclassified"] == 0.0


def test_findings_of_every_session(spark, analysis):
    from tracemill.plans import report

    schema = "model string, valid_from long, valid_to long, in_rate double, out_rate double"
    for model, cost in (("model-a", 0.0), ("other", 40 + 1.25 * 141 + 0.1 * 274 + 1610)):
        found = {r["finding"]: r for r in report.findings(analysis, spark.createDataFrame([(model, None, None, 2.0, 10.0)], schema)).collect()}
        assert len(found) == 6 and found["reasoning share of output"]["cost"] == 0 and found["reasoning share of output"]["severity"] == "note"
        gap = found["pricing/calibration gap"]
        # Its model has no fit, so the gap is high though all is priced.
        assert gap["cost"] == pytest.approx(cost) and gap["share"] == pytest.approx(float(cost > 0)) and gap["severity"] == "high"
