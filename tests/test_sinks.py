"""Sinks: what is written can be read back."""

from __future__ import annotations

import json
import math
import os
import tempfile

import pytest
from pyspark.sql import functions as F
from test_session import analysis  # noqa: F401

from tracemill.functions.storage import stored
from tracemill.plans import session
from tracemill.sources import sinks


@pytest.fixture(scope="module")
def rolled(analysis):
    return stored(session.rolled_up(analysis.spans), "rolled")


@pytest.fixture(scope="module")
def named(spark, rolled):
    return rolled.select("session_id").distinct().select("session_id", F.lit("proj").alias("project"), F.lit("/x/s.jsonl").alias("path"), F.array(F.lit("first note"), F.lit("second")).alias("notes"))


def spent(u):
    return math.floor(u["input"] + 1.25 * u["cache_creation"] + 0.1 * u["cache_read"] + u["output"] + 0.5)


def test_tree_equals_a_recursive_builder(rolled):
    """Every member of every node, siblings in order, nested as the parents say."""
    rows = [r.asDict(recursive=True) for r in rolled.collect()]
    kids = {}
    for r in rows:
        kids.setdefault(r["parent_id"], []).append(r)

    def node(r):
        mine = sorted(kids.get(r["span_id"], []), key=lambda k: (k["first_ts"] or 0 if k["by_time"] else 0, k["rank"]["group"], k["rank"]["place"], k["span_id"]))
        usage = {u: r[f"all_{u}"] for u in sinks.USAGE}
        line = r["lineage"]
        out = {"id": r["span_id"], "label": r["label"], "kind": r["kind"], "detail": {k: v for k, v in r["detail"].items() if v is not None}, "depth": len(line), "lineage": " > ".join(h["agent_type"] for h in line) or "main", "agentId": line[-1]["agent_id"] if line else None,
               "parentAgentId": line[-2]["agent_id"] if len(line) > 1 else None, "start": r["first_ts"], "end": r["last_ts"], "callFirst": r["call_first"], "callLast": r["call_last"], "usage": usage, "tokEq": spent(usage)}
        return {k: v for k, v in out.items() if v is not None} | {"children": [node(k) for k in mine]}

    whole = json.loads(sinks.tree_json(rolled).first()["tree"])
    assert whole == {"schema": sinks.SCHEMA, "session": "sess1", "tree": node(kids[None][0])}
    tree = whole["tree"]
    assert tree["label"] == "session sess1" and (tree["callFirst"], tree["callLast"]) == (0, 3) and tree["usage"]["output"] == 1610
    calls = tree["children"][0]["children"]
    assert [c["label"] for c in calls] == ["call 0", "call 1", "call 2", "call 3"] and calls[1]["detail"]["model"] == "model-a-20250101" and calls[0]["detail"]["line_count"] == 2
    tools = {t["id"]: t for t in calls[2]["children"]}
    guest = tools["tool:toolu_review"]["children"][0]
    assert guest["label"] == "subagent(code-review): d" and guest["agentId"] == "a_review" and guest["children"][0]["label"] == "code-review call 0"
    assert tools["tool:s2"]["detail"] == {"tool": "Skill", "target": "code-review", "result_chars": 0}
    assert sinks.tree_json(rolled.limit(0)).count() == 0


def attributes(span):
    return {a["key"]: next(iter(a["value"].values())) for a in span["attributes"]}


def test_export_of_both_domains(rolled, named):
    row = sinks.export_requests(rolled, named).first()
    time, tokens = json.loads(row["request"])["resourceSpans"]
    assert [(t["domain"], t["spans"]) for t in row["traces"]] == [("time", rolled.count()), ("tokens", rolled.count())]
    about = attributes(time["resource"])
    assert about["service.name"] == "tracemill-time" and about["session.id"] == "sess1" and about["tracemill.project"] == "proj" and about["tracemill.transcript"] == "/x/s.jsonl" and about["tracemill.notes"] == "2" and about["tracemill.note.1"] == "second" and "tracemill.axis" in about
    assert attributes(tokens["resource"])["service.name"] == "tracemill-tokens" and time["scopeSpans"][0]["scope"] == {"name": "tracemill", "version": sinks.SCHEMA}
    for part, trace in ((time, row["traces"][0]), (tokens, row["traces"][1])):
        sent = part["scopeSpans"][0]["spans"]
        by_id = {s["spanId"]: s for s in sent}
        roots = [s for s in sent if "parentSpanId" not in s]
        assert len(roots) == 1 and {s["traceId"] for s in sent} == {trace["trace_id"]} and len(by_id) == len(sent)
        for s in sent:
            if s is not roots[0]:  # every child lies within its parent
                up = by_id[s["parentSpanId"]]
                assert int(up["startTimeUnixNano"]) <= int(s["startTimeUnixNano"]) <= int(s["endTimeUnixNano"]) <= int(up["endTimeUnixNano"])
        assert all(s["kind"] == 1 and isinstance(v, str) for s in sent for v in attributes(s).values())
    assert row["traces"][0]["trace_id"] != row["traces"][1]["trace_id"]


def test_export_says_what_each_kind_has(rolled, named):
    sent = json.loads(sinks.export_requests(rolled, named).first()["request"])["resourceSpans"][0]["scopeSpans"][0]["spans"]
    of = {}
    for s in sent:
        a = attributes(s)
        of.setdefault(a["tracemill.kind"], []).append(a)
    common = {"span.type", "tracemill.kind", "tracemill.depth", "tracemill.lineage", "tracemill.call_first", "tracemill.call_last", *(f"tracemill.rollup.{k}" for k in ("input_tokens", "output_tokens", "cache_read_tokens", "cache_creation_tokens", "tok_eq"))}
    own = {
        "session": {"tracemill.session_id"}, "turn": {"tracemill.turn.snippet"}, "tool": {"tool_name", "tracemill.tool.target", "tracemill.tool.result_chars"}, "subagent": {"subagent_type", "tracemill.subagent.description"},
        "call": {"model", "gen_ai.request.model", "input_tokens", "output_tokens", "cache_read_tokens", "cache_creation_tokens", "tracemill.tok_eq", "tracemill.line_count", "tracemill.activity", "tracemill.activity.tier", "tracemill.activity.because"},
    }
    for kind, found in of.items():
        for a in found:
            assert set(a) - {"agent_id", "parent_agent_id"} == common | own[kind], kind
            assert a["span.type"] == sinks.SPAN_NAMES[kind] and ("agent_id" in a) == (a["tracemill.depth"] != "0") and ("parent_agent_id" in a) == (a["tracemill.depth"] == "2")
    assert {a["tracemill.tok_eq"] for a in of["call"] if a["tracemill.depth"] == "0"} == {"230", "245", "330", "419"}
    assert set(sinks.GROUPABLE.values()) <= {k for found in of.values() for a in found for k in a} | {"session.id", "tracemill.project"}


def test_tokens_domain_lays_children_end_to_end(rolled):
    """Widths as the recursion over the tree gives them; the session begins when it began."""
    rows = {r["span_id"]: r for r in sinks.placed_in_domains(rolled).filter("domain = 'tokens'").collect()}
    kids = {}
    for r in rows.values():
        kids.setdefault(r["parent_id"], []).append(r)

    def width(r):
        own = spent(r) if r["kind"] == "call" else 0
        return max(1, own + sum(width(k) for k in kids.get(r["span_id"], [])))

    root = kids[None][0]
    assert root["from_ms"] == root["first_ts"]
    for r in rows.values():
        assert r["to_ms"] - r["from_ms"] == width(r)
        at = r["from_ms"]
        for k in sorted(kids.get(r["span_id"], []), key=lambda k: (k["first_ts"] or 0 if k["by_time"] else 0, k["rank"]["group"], k["rank"]["place"])):
            assert k["from_ms"] == at
            at = k["to_ms"]


@pytest.mark.parametrize(
    "body,status",
    [("", "stored"), ("{}", "stored"), ('{"partialSuccess":{"rejectedSpans":"9007199254740993","errorMessage":"no"}}', "rejected"), ('{"partial_success":{"error_message":"slow"}}', "warned"), ("<html>", "stored"), ("[]", "stored"), ('{"partialSuccess":7}', "stored"), ('{"partialSuccess":{"rejectedSpans":null}}', "stored"), ('{"partialSuccess":{"rejectedSpans":"many"}}', "rejected"), ('{"partialSuccess":{"rejectedSpans":0,"errorMessage":"slow"}}', "warned")],
)
def test_collector(body, status):
    said, why = sinks.collector_said(body)
    assert said == status and ("9007199254740993" in why or "9007" not in body)


def test_send_posts_once_however_often_it_is_read(rolled, named, tmp_path):
    requests = sinks.export_requests(rolled, named).withColumn("session_id", F.explode(F.array(F.lit("a"), F.lit("b"))))
    folder = str(tmp_path)

    def post(body):
        with tempfile.NamedTemporaryFile(dir=folder, delete=False):
            pass
        raise RuntimeError("down")

    sent = sinks.send(requests, post)
    assert {(r["session_id"], r["status"], r["reason"]) for r in sent.collect()} == {("a", "failed", "down"), ("b", "failed", "down")}
    assert sent.count() == 2 and sent.filter("status = 'failed'").count() == 2 and len(os.listdir(folder)) == 2


def test_tsv(spark, tmp_path):
    df = spark.createDataFrame([("a\tb\r\nc", '"q"', None)], "x string, y string, z string")
    sinks.write_tsv(df, str(tmp_path / "out"), ["x", "y", "z"])
    text = max((p.read_text() for p in (tmp_path / "out").glob("part-*")), key=len)
    assert text.splitlines()[0] == "x\ty\tz" and len(text.splitlines()) == 2


def test_spans_are_written_once_for_both_domains(rolled, named):
    """No span is multiplied by domain before it is gathered, and what is gathered is not dealt again for the session's card."""
    plan = sinks.export_requests(rolled, named)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and plan.count("collect_list") == 1
