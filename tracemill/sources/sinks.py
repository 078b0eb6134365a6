"""Writing results: TSV, flat and nested span trees, trace-export requests."""

from __future__ import annotations

import json
import re
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.functions import tokens as T
from tracemill.functions.storage import stored
from tracemill.operators import tree

SCHEMA = "tracemill/span-tree@1"
#: Each domain is a service of its own: one places spans by time, the other by tokens.
SERVICES = {"time": "tracemill-time", "tokens": "tracemill-tokens"}


def write_tsv(df: DataFrame, path: str, columns: Sequence[str]) -> None:
    """Rows whose cells hold no tab or line break, under a header; one folder of part files, each with the header."""
    df.select(*[T.tsv_cell(c).alias(c) for c in columns]).write.option("sep", "\t").option("quote", "").option("escapeQuotes", "false").csv(path, header=True)


USAGE = ("input", "cache_creation", "cache_read", "output")
#: Levels of a tree that are joined in one plan before they are stored.
LEVELS_A_PLAN = 4


def own_tokens() -> Column:
    """Token-equivalents that a span spends itself; only calls do."""
    return T.half_up((20 * F.col("input") + 25 * F.col("cache_creation") + 2 * F.col("cache_read") + 20 * F.col("output")) / 20).cast("long")


def _node(spans: DataFrame) -> Column:
    """A span as its tree node without children."""
    usage = F.struct(*[F.col(f"all_{u}").alias(u) for u in USAGE])
    total = T.half_up((20 * F.col("all_input") + 25 * F.col("all_cache_creation") + 2 * F.col("all_cache_read") + 20 * F.col("all_output")) / 20).cast("long")
    return F.struct(
        F.col("span_id").alias("id"), "label", "kind", F.struct("detail.*").alias("detail"), T.depth_of("lineage").alias("depth"), T.lineage_path("lineage").alias("lineage"), T.immediate_agent("lineage").alias("agentId"), T.parent_agent("lineage").alias("parentAgentId"),
        F.col("first_ts").alias("start"), F.col("last_ts").alias("end"), F.col("call_first").alias("callFirst"), F.col("call_last").alias("callLast"), usage.alias("usage"), total.alias("tokEq"),
    )


def tree_json(spans: DataFrame) -> DataFrame:
    """``session_id`` and ``tree``: each session's nested span tree as JSON (spans with rolled-up usage, see ``rolled_up``).

    Trees are put together level by level from the leaves: the finished texts of a
    level's nodes are gathered under their parents, siblings in their order, and each parent
    is written around them.  No session's spans meet in one group; members that are null are left out.
    """
    depth = tree.climb(spans, "span_id", "parent_id", scope=["session_id"]).select("session_id", "span_id", F.col("depth").alias("level"))
    at = F.struct(F.when(F.col("by_time"), F.coalesce("first_ts", F.lit(0))).otherwise(0).alias("t"), F.col("rank").alias("r"), F.col("span_id").alias("i"))
    nodes = stored(spans.join(depth, ["session_id", "span_id"]).select("session_id", "span_id", "parent_id", "level", at.alias("at"), F.to_json(_node(spans)).alias("own")), "tree-nodes")
    deepest = nodes.agg(F.max("level")).first()[0]
    below = None
    for level in range(deepest if deepest is not None else -1, -1, -1):
        here = nodes.filter(F.col("level") == level)
        kids = F.lit("")
        if below is not None:
            here, kids = here.join(below, ["session_id", "span_id"], "left"), F.coalesce("_kids", F.lit(""))
        text = F.concat(F.regexp_replace("own", r"\}$", ""), F.lit(',"children":['), kids, F.lit("]}"))
        written = here.select("session_id", "span_id", "parent_id", "at", text.alias("text"))
        if (deepest - level) % LEVELS_A_PLAN == LEVELS_A_PLAN - 1:
            written = stored(written, "tree-level")
        ordered = F.transform(F.array_sort(F.collect_list(F.struct("at", "text"))), lambda x: x["text"])
        below = written.groupBy("session_id", F.col("parent_id").alias("span_id")).agg(F.array_join(ordered, ",").alias("_kids"))
    if below is None:
        return spans.select("session_id", F.lit("").alias("tree")).limit(0)
    return written.select("session_id", F.concat(F.lit(f'{{"schema":"{SCHEMA}","session":'), F.to_json(F.struct("session_id")).substr(F.lit(15), F.length(F.to_json(F.struct("session_id"))) - 15), F.lit(',"tree":'), "text", F.lit("}")).alias("tree"))


def _attribute(key: str, value: Column, number: bool) -> Column:
    """An export attribute; 64-bit integers travel as text, null values are left out."""
    text, whole = (value, F.lit(None)) if not number else (F.lit(None), value)
    return F.when(value.isNotNull(), F.struct(F.lit(key).alias("key"), F.struct(text.cast("string").alias("stringValue"), whole.cast("string").alias("intValue")).alias("value")))


def _attributes(pairs: Sequence[tuple[str, Column, bool]]) -> Column:
    return F.filter(F.array(*[_attribute(*p) for p in pairs]), lambda a: a.isNotNull())


#: What a span of each kind is called.
SPAN_NAMES = {"session": "tracemill.session", "turn": "interaction", "call": "llm_request", "tool": "tool", "subagent": "tracemill.subagent"}
#: Attributes that traces can be grouped by: dimension and key.
GROUPABLE = {
    "session": "session.id", "project": "tracemill.project", "kind": "tracemill.kind", "depth": "tracemill.depth", "lineage": "tracemill.lineage", "agent": "agent_id", "parent_agent": "parent_agent_id",
    "model": "model", "activity": "tracemill.activity", "tier": "tracemill.activity.tier", "tool": "tool_name", "subagent_type": "subagent_type",
}
UNITS = {"time": "one millisecond is one millisecond of real time", "tokens": "one millisecond is one input-equivalent token"}


def span_attributes() -> list[tuple[str, Column, bool]]:
    """What a span says: of its place and its subtree, of its lineage, and of its own kind."""
    name = F.create_map(*[F.lit(x) for pair in SPAN_NAMES.items() for x in pair])[F.col("kind")]
    spent = T.half_up((20 * F.col("all_input") + 25 * F.col("all_cache_creation") + 2 * F.col("all_cache_read") + 20 * F.col("all_output")) / 20).cast("long")
    d, call = (lambda c: F.col(f"detail.{c}")), F.col("kind") == "call"
    of_call = lambda c: F.when(call, F.col(c))
    return [
        ("span.type", name, False), (GROUPABLE["kind"], F.col("kind"), False), (GROUPABLE["depth"], T.depth_of("lineage"), True), (GROUPABLE["lineage"], T.lineage_path("lineage"), False),
        ("tracemill.rollup.input_tokens", F.col("all_input"), True), ("tracemill.rollup.output_tokens", F.col("all_output"), True), ("tracemill.rollup.cache_read_tokens", F.col("all_cache_read"), True),
        ("tracemill.rollup.cache_creation_tokens", F.col("all_cache_creation"), True), ("tracemill.rollup.tok_eq", spent, True), ("tracemill.call_first", F.col("call_first"), True), ("tracemill.call_last", F.col("call_last"), True),
        (GROUPABLE["agent"], T.immediate_agent("lineage"), False), (GROUPABLE["parent_agent"], T.parent_agent("lineage"), False),
        ("tracemill.session_id", F.when(F.col("kind") == "session", F.col("session_id")), False), ("tracemill.turn.snippet", d("snippet"), False),
        (GROUPABLE["model"], d("model"), False), ("gen_ai.request.model", d("model"), False), ("input_tokens", of_call("input"), True), ("output_tokens", of_call("output"), True), ("cache_read_tokens", of_call("cache_read"), True),
        ("cache_creation_tokens", of_call("cache_creation"), True), ("tracemill.tok_eq", F.when(call, own_tokens()), True), ("tracemill.line_count", d("line_count"), True),
        (GROUPABLE["activity"], d("activity"), False), (GROUPABLE["tier"], d("tier"), False), ("tracemill.activity.because", d("because"), False),
        (GROUPABLE["tool"], d("tool"), False), ("tracemill.tool.target", d("target"), False), ("tracemill.tool.result_chars", d("result_chars"), True),
        (GROUPABLE["subagent_type"], d("agent_type"), False), ("tracemill.subagent.description", d("description"), False),
    ]


def _attribute_text(key: str, value: Column, number: bool) -> Column:
    """An export attribute as JSON, null for a null value."""
    if number:
        return F.concat(F.lit(f'{{"key":"{key}","value":{{"intValue":"'), value.cast("string"), F.lit('"}}'))
    return F.when(value.isNotNull(), F.concat(F.lit(f'{{"key":"{key}","value":'), F.to_json(F.struct(value.cast("string").alias("stringValue"))), F.lit("}")))


def _laid(spans: DataFrame) -> tuple[DataFrame, dict[str, tuple[Column, Column]]]:
    """Spans laid out, and from when to when each lies in both domains."""
    spent = spans.withColumn("own_tokens", own_tokens()).withColumn("_t", F.when(F.col("by_time"), F.coalesce("first_ts", F.lit(0))).otherwise(0))
    laid = tree.token_layout(spent, "span_id", "parent_id", "own_tokens", ["_t", "rank"], ["session_id"]).drop("_t", "own_tokens", "width")
    roots = spans.filter("parent_id is null").select("session_id", F.coalesce("first_ts", F.lit(0)).alias("_anchor"))
    domains = {"time": (F.coalesce("first_ts", F.lit(0)), F.coalesce("last_ts", F.lit(0))), "tokens": (F.col("_anchor") + F.col("start"), F.col("_anchor") + F.col("end"))}
    return laid.join(roots, "session_id"), domains


def placed_in_domains(spans: DataFrame) -> DataFrame:
    """Each span once in each domain with ``from_ms`` and ``to_ms``.

    In time a span lies where it was; in tokens the session begins where it began and every
    token is as wide as a millisecond: children end to end, what a span spends itself after them.
    """
    laid, domains = _laid(spans)
    both = F.array(*[F.struct(F.lit(d).alias("domain"), of.alias("from_ms"), to.alias("to_ms")) for d, (of, to) in domains.items()])
    return laid.withColumn("_d", F.explode(both)).select("*", "_d.*").drop("_d", "_anchor", "start", "end")


def export_requests(spans: DataFrame, sessions: DataFrame) -> DataFrame:
    """``session_id``, ``project``, ``traces`` (domain, trace_id, spans) and ``request``: one OTLP/JSON request for each session with both domains.

    ``spans`` are rolled-up spans, ``sessions`` has ``session_id``, ``project``, ``path`` and ``notes``.  Ids are digests
    of what they name, so a session that has grown replaces its earlier export.  What a span says is
    written once, before spans are gathered by session, and serves both domains.
    """
    nanos = lambda c: (c.cast("decimal(20,0)") * 1_000_000).cast("decimal(26,0)").cast("string")
    name = F.create_map(*[F.lit(x) for pair in SPAN_NAMES.items() for x in pair])[F.col("kind")]
    member = lambda key, value: F.concat(F.lit(f',"{key}":"'), value, F.lit('"'))
    laid, domains = _laid(spans)
    heads = []
    for d, (of, to) in domains.items():
        span_id = lambda c: T.span_id(F.lit(SERVICES[d]), F.col("session_id"), F.col(c))  # noqa: E731, B023
        up = F.when(F.col("parent_id").isNotNull(), member("parentSpanId", span_id("parent_id"))).otherwise("")  # absent at the root
        trace = T.trace_id(F.lit(SERVICES[d]), F.col("session_id"))
        head = F.concat(F.lit('{"traceId":"'), trace, F.lit('"'), member("spanId", span_id("span_id")), up, member("name", name), F.lit(',"kind":1'), member("startTimeUnixNano", nanos(of)), member("endTimeUnixNano", nanos(to)), F.lit(',"attributes":['))
        heads.append(head.alias(d))
    said = F.concat(F.concat_ws(",", *[_attribute_text(*a) for a in span_attributes()]), F.lit("]}"))
    grouped = laid.select("session_id", F.struct("span_id", *heads, said.alias("said")).alias("s")).groupBy("session_id").agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list("s")).alias("spans"))
    noted = F.transform("notes", lambda n, i: F.struct(F.concat(F.lit("tracemill.note."), i.cast("string")).alias("key"), F.struct(n.alias("stringValue"), F.lit(None).cast("string").alias("intValue")).alias("value")))
    traces, parts = [], []
    for d in SERVICES:
        about = _attributes([
            ("service.name", F.lit(SERVICES[d]), False), ("service.version", F.lit(SCHEMA), False), ("tracemill.axis", F.lit(UNITS[d]), False), (GROUPABLE["session"], F.col("session_id"), False), (GROUPABLE["project"], F.col("project"), False),
            ("tracemill.transcript", F.col("path"), False), ("tracemill.notes", F.size("notes"), True),
        ])
        traces.append(F.struct(F.lit(d).alias("domain"), T.trace_id(F.lit(SERVICES[d]), F.col("session_id")).alias("trace_id"), F.col("n").alias("spans")))
        written = F.array_join(F.transform("spans", lambda x: F.concat(x[d], x["said"])), ",")  # noqa: B023
        scope = F.to_json(F.struct(F.lit("tracemill").alias("name"), F.lit(SCHEMA).alias("version")))
        parts.append(F.concat(F.lit('{"resource":'), F.to_json(F.struct(F.concat(about, noted).alias("attributes"))), F.lit(',"scopeSpans":[{"scope":'), scope, F.lit(',"spans":['), written, F.lit("]}]}")))
    request = F.concat(F.lit('{"resourceSpans":['), F.concat_ws(",", *parts), F.lit("]}"))
    return grouped.join(sessions.select("session_id", "project", "path", "notes"), "session_id").select("session_id", "project", F.array(*traces).alias("traces"), request.alias("request"))


def collector_said(body: str) -> tuple[str, str]:
    """(stored, warned or rejected; reason) from a collector's answer of success: a rejection can hide in one.

    Only an object with a partial-success object speaks of rejected spans; any
    other answer, not JSON too, means that all is stored.  No count is none
    rejected; a count that cannot be read is a rejection.
    """
    try:
        said = json.loads(body)
    except (ValueError, RecursionError):
        return "stored", ""
    part = next((said[k] for k in ("partialSuccess", "partial_success") if isinstance(said.get(k), dict)), {}) if isinstance(said, dict) else {}
    count, why = (next((part[k] for k in names if part.get(k) is not None), None) for names in (("rejectedSpans", "rejected_spans"), ("errorMessage", "error_message")))
    why = why if isinstance(why, str) else ""
    digits = "0" if count is None else str(int(count)) if isinstance(count, float) and count.is_integer() else str(count)
    if not re.fullmatch(r"\d+", digits):
        return "rejected", f"cannot read how many spans were rejected: {count}"
    if digits.strip("0"):  # compared as text, so exact at any size
        return "rejected", f"{digits} spans: {why}"
    return ("warned", why) if why else ("stored", "")


def post_json(endpoint: str, body: str, timeout: float = 30.0) -> str:
    """POST and return the answer; what fails names the endpoint and the phase."""
    request = urllib.request.Request(endpoint, body.encode(), {"Content-Type": "application/json"})
    try:
        with urllib.request.urlopen(request, timeout=timeout) as answer:
            return answer.read().decode("utf-8", "replace")
    except urllib.error.HTTPError as e:
        raise RuntimeError(f"{endpoint}: answered {e.code}") from e
    except OSError as e:
        raise RuntimeError(f"{endpoint}: no answer ({e})") from e


def send(requests: DataFrame, post: Callable[[str], str]) -> DataFrame:
    """POST each session's request once, from the task that holds it, and store what became of it.

    Returns ``session_id``, ``status`` (stored, warned, rejected or failed) and ``reason`` as stored: however often
    the result is read, nothing is posted again.  A task that is tried again posts its
    sessions again, which replace what they had stored.
    """

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for r in batch.itertuples(index=False):
                try:
                    status, why = collector_said(post(r.request))
                except Exception as e:  # reported with its session; the others go on
                    status, why = "failed", str(e)
                rows.append((r.session_id, status, why))
            yield pd.DataFrame(rows, columns=["session_id", "status", "reason"])

    return stored(requests.select("session_id", "request").mapInPandas(each, "session_id string, status string, reason string"), "export-outcomes")
