"""Session analysis: records to calls, arrivals, tools, turns, forest, labels, spans and totals."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracemill.functions import tokens as T
from tracemill.functions.storage import measured_joins, stored
from tracemill.operators import joins, rules, sequence, tree
from tracemill.sources import transcripts

CONV = ["session_id", "conv_id"]


def calls_of(records: DataFrame) -> DataFrame:
    """API calls with their usage snapshot, the union of their blocks and, for the audits, the last line's figures."""
    # Dealt by conversation once: groups of lines and the order of calls both lie within one.
    lines = records.filter("kind = 'assistant'").repartition(*CONV)
    usage = ["output", "input", "cache_creation", "cache_read", "cc_flat"]
    more = [
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "blocks"))), lambda x: x["blocks"])).alias("blocks"),
        F.max_by(F.col("input") + F.col("cache_creation") + F.col("cache_read") + F.col("output") == 0, "line_no").alias("last_is_zero"),
    ]
    return sequence.request_groups(lines, CONV, "request_id", "line_no", "output", usage, ["ts_ms", "model"], more)


def _blocks(records: DataFrame, line: str, block: str, *columns: str) -> DataFrame:
    """The blocks ``b`` of a kind in lines of a kind; ``pos`` orders all blocks of a conversation."""
    pos = F.shiftleft(F.col("line_no").cast("long"), 32) + F.col("at")
    some = records.filter((F.col("kind") == line) & F.exists("blocks", lambda b: b["kind"] == block))
    return some.select(*CONV, "line_no", "ts_ms", *columns, F.posexplode("blocks").alias("at", "b")).filter(F.col("b.kind") == block).withColumn("pos", pos)


def uses_of(records: DataFrame, calls: DataFrame) -> DataFrame:
    """Every tool_use block in order with its call."""
    blocks = _blocks(records, "assistant", "tool_use", "request_id").join(calls.select(*CONV, "request_id", "call_index"), [*CONV, "request_id"], "left")
    return blocks.select(*CONV, F.col("b.id").alias("tool_use_id"), F.col("b.name").alias("name"), T.display("b.input").alias("summary"), F.col("b.input").alias("input"), "call_index", F.col("ts_ms").alias("ts_start"), "pos")


def results_of(records: DataFrame) -> DataFrame:
    """Every tool_result block in order."""
    blocks = _blocks(records, "user", "tool_result")
    return blocks.select(*CONV, F.col("b.tool_use_id").alias("tool_use_id"), F.col("b.chars").alias("result_chars"), F.col("ts_ms").alias("ts_end"), "line_no", "pos")


def seen_of(records: DataFrame) -> DataFrame:
    """Lines of users and attachments with ``next_call`` and what is counted of each; the lines of calls only tell where they stand."""
    chars = F.aggregate(F.filter("blocks", lambda b: b["kind"] == "text"), F.lit(0).cast("long"), lambda a, b: a + b["chars"])
    of_user = F.when(F.col("kind") == "user", chars)
    short = records.filter("kind in ('assistant', 'user', 'attachment')").select(*CONV, "line_no", "kind", "ts_ms", "request_id", of_user.alias("text_chars"), "snippet", "is_tool_result", "attachment_type", "chars")
    request = F.when(F.col("kind") == "assistant", F.col("request_id"))
    return sequence.calls_seen(short.repartition(*CONV), CONV, "line_no", request).filter("kind <> 'assistant'").drop("request_id")


def tools_of(uses: DataFrame, results: DataFrame) -> DataFrame:
    """Each requested tool with its result, if one came; later requests and results of an id replace earlier ones and are counted."""
    key = [*CONV, "tool_use_id"]
    one_use = joins.last_wins(uses, key, "pos", ["name", "summary", "call_index", "ts_start"]).withColumnRenamed("repeats", "repeated_uses")
    one_result = joins.last_wins(results, key, "pos", ["result_chars", "ts_end"]).select(*key, "result_chars", "ts_end", F.col("repeats").alias("repeated_results"))
    return joins.answered(one_use, one_result, key)


def unmatched_results(uses: DataFrame, results: DataFrame) -> DataFrame:
    """``unmatched`` results in each conversation: those of tools that nobody requested."""
    return joins.unmatched(results, uses, [*CONV, "tool_use_id"]).groupBy(*CONV).agg(F.count(F.lit(1)).alias("unmatched"))


def arrivals_of(seen: DataFrame, calls: DataFrame, uses: DataFrame, results: DataFrame) -> DataFrame:
    """What entered the context before each call, and how large it is on what basis."""
    cols = [*CONV, "born", "source", "label", "tokens", "basis", "tool_use_id"]
    estimated, none = F.lit("estimated-from-chars"), F.lit("")
    born = seen.filter("is_tool_result").select(*CONV, "line_no", F.col("next_call").alias("born"))
    known = results.alias("r").join(uses.alias("u"), [F.col("r.session_id") == F.col("u.session_id"), F.col("r.conv_id") == F.col("u.conv_id"), F.col("r.tool_use_id") == F.col("u.tool_use_id"), F.col("u.pos") < F.col("r.pos")], "left")
    named = known.groupBy("r.session_id", "r.conv_id", "r.tool_use_id", "r.line_no", "r.pos", "r.result_chars").agg(F.max_by(F.struct("u.name", "u.summary"), "u.pos").alias("use"))
    label = F.trim(F.concat(F.coalesce("use.name", F.lit("?")), F.lit(" "), F.coalesce("use.summary", F.lit(""))))
    from_tools = named.join(born, [*CONV, "line_no"]).select(*CONV, "born", F.lit("toolResult").alias("source"), label.alias("label"), T.estimate_tokens("result_chars").alias("tokens"), estimated.alias("basis"), "tool_use_id")
    texts = seen.filter("kind = 'user' and text_chars > 0")
    from_users = texts.select(*CONV, F.col("next_call").alias("born"), F.lit("userText").alias("source"), T.display("snippet").alias("label"), T.estimate_tokens("text_chars").alias("tokens"), estimated.alias("basis"), none.alias("tool_use_id"))
    attached = seen.filter("kind = 'attachment'").select(*CONV, F.col("next_call").alias("born"), F.lit("attachment").alias("source"), F.col("attachment_type").alias("label"), T.estimate_tokens("chars").alias("tokens"), estimated.alias("basis"), none.alias("tool_use_id"))
    produced = calls.select(*CONV, (F.col("call_index") + 1).alias("born"), F.lit("assistantOutput").alias("source"), F.concat(F.lit("assistant output of call "), F.col("call_index").cast("string")).alias("label"), F.col("output").alias("tokens"), F.lit("exact-api-usage").alias("basis"), none.alias("tool_use_id"))
    out = from_tools.select(*cols)
    for part in (from_users, attached, produced):
        out = out.unionByName(part.select(*cols))
    return out.withColumn("born", F.col("born").cast("long")).withColumn("tokens", F.col("tokens").cast("long"))


def turns_of(seen: DataFrame, calls: DataFrame) -> DataFrame:
    """User turns with their origin and the calls they last for."""
    totals = calls.groupBy(*CONV).agg(F.count(F.lit(1)).alias("_calls"))
    opened = seen.filter("kind = 'user' and not is_tool_result").join(totals, CONV, "left")
    o = rules.turn_origin(F.col("snippet"))
    opened = opened.select(*CONV, "line_no", "ts_ms", F.col("next_call").alias("first_call"), F.coalesce("_calls", F.lit(0)).alias("_calls"), o.alias("origin"))
    return sequence.extents(opened, CONV, "line_no", "first_call", F.col("_calls")).drop("_calls")


def labels_of(calls: DataFrame, forest: DataFrame) -> DataFrame:
    """Activity of every call.  A root call without a sign of its own continues the one before; spawned work has the label of the root call that spawned it."""
    tools = F.filter("blocks", lambda b: b["kind"] == "tool_use")
    root = calls.filter("conv_id = ''").withColumn("_tools", tools)
    # Of sidecars that name one tool use the last agent's counts.
    spawned = forest.filter("parent_agent is not null and tool_use_id <> ''").groupBy("session_id", "tool_use_id").agg(F.max_by("agent_type", "agent_id").alias("agent_type"))
    asked = root.select("session_id", "call_index", F.explode("_tools").alias("t")).select("session_id", "call_index", F.col("t.id").alias("tool_use_id"))
    sent = asked.join(spawned, ["session_id", "tool_use_id"]).groupBy("session_id", "call_index").agg(F.collect_list("agent_type").alias("_agents"))
    root = root.join(sent, ["session_id", "call_index"], "left")
    facts = F.transform("_tools", lambda t: F.struct(t["name"].alias("name"), T.program_text(t["input"]).alias("text")))
    skills = F.transform(F.filter("_tools", lambda t: t["name"] == "Skill"), lambda t: F.lower(t["input"]))
    own = root.withColumn("_a", rules.activity(facts, skills, F.coalesce("_agents", F.array().cast("array<string>"))))
    w = Window.partitionBy("session_id").orderBy("call_index").rowsBetween(Window.unboundedPreceding, 0)
    last = F.last("_a", ignorenulls=True).over(w)
    continued = F.when(last["activity"] == "unclassified", "none").otherwise("rule")
    decided = own.select(
        *CONV, "call_index",
        F.coalesce(last["activity"], F.lit("unclassified")).alias("activity"),
        F.when(F.col("_a").isNotNull(), F.when(F.col("_a.activity") == "unclassified", "none").otherwise(F.col("_a.tier"))).when(last.isNotNull(), continued).otherwise("none").alias("tier"),
        F.when(F.col("_a").isNotNull(), F.col("_a.because")).when(last.isNotNull(), "continues the call before").otherwise("nothing to go by").alias("because"),
    )
    placed = forest.filter("parent_agent is not null").select("session_id", F.col("agent_id").alias("conv_id"), F.col("lineage")[0]["spawned_at_call"].cast("long").alias("_at"), T.lineage_path("lineage").alias("_path"))
    roots = decided.select("session_id", F.col("call_index").cast("long").alias("_at"), "activity", "tier", "because")
    below = calls.select(*CONV, "call_index").join(placed, CONV).join(roots, ["session_id", "_at"], "left")
    inherited = below.select(
        *CONV, "call_index", F.coalesce("activity", F.lit("unclassified")).alias("activity"), F.coalesce("tier", F.lit("none")).alias("tier"),
        F.concat(F.lit("inherited via "), F.col("_path"), F.lit(": "), F.coalesce("because", F.lit("nothing to go by"))).alias("because"),
    )
    return decided.unionByName(inherited)


#: What a span of each kind says of itself; null where it does not apply.
DETAIL = (
    "snippet string, model string, call_ts long, line_count long, activity string, tier string, because string, tool string, target string, result_chars long, agent_type string, description string"
)


def spans_of(calls: DataFrame, tools: DataFrame, turns: DataFrame, forest: DataFrame, labels: DataFrame) -> DataFrame:
    """The session tree as flat spans: session, turn, call, tool and subagent, each under exactly one parent.

    ``call_first`` and ``call_last`` are the calls of its conversation that a span covers, ``detail`` what its kind says of itself.
    Siblings are in order of (``by_time``: the first instant, unless the parent is a turn; ``rank``).
    """
    placed = forest.filter("parent_agent is not null").select("session_id", F.col("agent_id").alias("conv_id"), "agent_type", "description", "parent_agent", "spawned_at_call", "via", "lineage", "tool_use_id")
    main = calls.select("session_id").unionByName(placed.select("session_id")).distinct()
    none = F.array().cast(placed.schema["lineage"].dataType)
    homes = main.select("session_id", F.lit("").alias("conv_id"), none.alias("lineage")).unionByName(placed.select("session_id", "conv_id", "lineage"))
    sizes = calls.groupBy(*CONV).agg(F.count(F.lit(1)).alias("_calls"))
    prefix = F.when(F.col("conv_id") == "", "").otherwise(F.concat(F.col("conv_id"), F.lit(":")))
    head = F.when(F.col("conv_id") == "", F.concat(F.lit("session:"), F.col("session_id"))).otherwise(F.concat(F.lit("subagent:"), F.col("conv_id")))
    named = lambda kind, n: F.concat(F.lit(f"{kind}:"), prefix, n.cast("string"))
    usage = ["input", "cache_creation", "cache_read", "output"]
    nothing = F.lit(0).cast("long")

    def spans(rows: DataFrame, kind: str, span: Column, parent: Column, label: Column, when: tuple[Column, Column], of: tuple[Column, Column], rank: tuple[Column, Column], detail: dict[str, Column], own: bool = False, by_time: Column | None = None) -> DataFrame:
        fields = [c.split() for c in DETAIL.split(", ")]
        said = F.struct(*[detail.get(name, F.lit(None)).cast(of_type).alias(name) for name, of_type in fields])
        return rows.select(
            "session_id", span.alias("span_id"), parent.alias("parent_id"), F.lit(kind).alias("kind"), label.alias("label"), "lineage", *[c.cast("long").alias(n) for c, n in zip((*when, *of), ("ts_start", "ts_end", "call_first", "call_last"))],
            F.struct(rank[0].cast("int").alias("group"), rank[1].cast("string").alias("place")).alias("rank"), (F.lit(True) if by_time is None else by_time).alias("by_time"), said.alias("detail"), *[F.col(c) if own else nothing.alias(c) for c in usage],
        )

    nowhen, place = (F.lit(None), F.lit(None)), lambda n: F.lpad(n.cast("string"), 20, "0")
    about = labels.select(*CONV, F.col("call_index").cast("long").alias("call_index"), "activity", "tier", "because")
    asked = calls.select(*CONV, F.col("call_index").cast("long").alias("call_index"), "ts_ms", "model", "line_count", *usage).join(about, [*CONV, "call_index"], "left")
    mine = joins.within(asked, turns.select(*CONV, "first_call", "last_call", "turn_index"), CONV, "call_index").join(homes, CONV)
    index, in_turn = F.col("call_index"), F.col("turn_index").isNotNull()
    whose = F.when(F.col("conv_id") == "", "").otherwise(F.concat(F.element_at("lineage", -1)["agent_type"], F.lit(" ")))
    call_spans = spans(
        mine, "call", named("call", index), F.when(in_turn, named("turn", F.col("turn_index"))).otherwise(head), F.concat(whose, F.lit("call "), index.cast("string")), (F.col("ts_ms"), F.col("ts_ms") + 1), (index, index),
        (F.lit(1), place(index)), {"model": F.col("model"), "call_ts": F.col("ts_ms"), "line_count": F.col("line_count"), "activity": F.coalesce("activity", F.lit("unclassified")), "tier": F.coalesce("tier", F.lit("none")), "because": F.col("because")}, True, ~in_turn,
    )
    used = mine.filter(in_turn).select(*CONV, "turn_index").distinct()
    number, said = F.col("turn_index"), F.col("origin.snippet")
    turn_spans = spans(
        turns.join(used, [*CONV, "turn_index"]).join(homes, CONV), "turn", named("turn", number), head, F.concat(F.lit("turn "), number.cast("string"), F.lit(": "), said), nowhen, (F.col("first_call"), F.col("last_call")), (F.lit(0), place(number)), {"snippet": said}
    )
    tool = tools.join(homes, CONV)
    tool_spans = spans(
        tool, "tool", named("tool", F.col("tool_use_id")), named("call", index), F.trim(F.concat("name", F.lit(" "), "summary")), (F.col("ts_start"), F.coalesce("ts_end", "ts_start")), (index, index),
        (F.lit(0), place(F.col("slot"))), {"tool": F.col("name"), "target": F.col("summary"), "result_chars": F.coalesce("result_chars", F.lit(0))},
    )
    # A spawn hangs under its tool, else under its call, else (where neither is there) under the conversation.
    up = F.when(F.col("parent_agent") == "", "").otherwise(F.concat(F.col("parent_agent"), F.lit(":")))
    under_tool, under_call = F.concat(F.lit("tool:"), up, F.col("tool_use_id")), F.concat(F.lit("call:"), up, F.col("spawned_at_call").cast("string"))
    above = F.when(F.col("parent_agent") == "", F.concat(F.lit("session:"), F.col("session_id"))).otherwise(F.concat(F.lit("subagent:"), F.col("parent_agent")))
    have = tool_spans.unionByName(call_spans).select("session_id", F.col("span_id").alias("_wanted"), F.lit(True).alias("_there"))
    wanted = F.when(F.col("via") == "tool_use", under_tool).otherwise(under_call)
    grafted = placed.withColumn("_wanted", wanted).join(have, ["session_id", "_wanted"], "left").join(sizes, CONV, "left")
    last = F.greatest(F.lit(0), F.coalesce("_calls", F.lit(0)) - 1)
    agent_spans = spans(
        grafted, "subagent", head, F.when(F.col("_there"), F.col("_wanted")).otherwise(above), F.concat(F.lit("subagent("), F.col("agent_type"), F.lit("): "), F.col("description")), nowhen, (F.lit(0), last),
        (F.lit(2), F.col("conv_id")), {"agent_type": F.col("agent_type"), "description": F.col("description")},
    )
    out = spans(homes.filter("conv_id = ''").join(sizes, CONV, "left"), "session", head, F.lit(None).cast("string"), F.concat(F.lit("session "), F.substring("session_id", 1, 8)), nowhen, (F.lit(0), last), (F.lit(0), F.lit("")), {})
    for part in (turn_spans, call_spans, tool_spans, agent_spans):
        out = out.unionByName(part)
    return out


def rolled_up(spans: DataFrame) -> DataFrame:
    """Spans with the exact usage of all below them, and extents that reach over their children."""
    measures = [(f"all_{c}", "sum", F.col(c)) for c in ("input", "cache_creation", "cache_read", "output")] + [("first_ts", "min", F.col("ts_start")), ("last_ts", "max", F.col("ts_end"))]
    return spans.join(tree.rollup(spans, "span_id", "parent_id", measures, ["session_id"]), ["session_id", "span_id"])


class Analysis:
    """Tables of the corpus ``source``, or of its ``picked`` sessions: each is made when it is first asked for, with those it needs, and stored."""

    def __init__(self, spark: SparkSession, source: str | transcripts.Packed, picked: DataFrame | None = None):
        measured_joins(spark)
        self._spark, self._source, self._paths = spark, source, None
        files = transcripts.discover(spark, source)
        if picked is not None and isinstance(source, transcripts.Packed):
            self._source = source.picked(picked)
            files = self._source.files
        elif picked is not None:
            self._paths = transcripts.picked_paths(files, picked)
            files = files.join(picked.select("project", "session_id"), ["project", "session_id"], "left_semi")
        self._found = files

    def made(self) -> list[DataFrame]:
        """The tables that are stored by now."""
        return [vars(self)[name] for name, f in vars(type(self)).items() if isinstance(f, functools.cached_property) and name in vars(self) and not name.startswith("_")]

    @functools.cached_property
    def files(self) -> DataFrame:
        return stored(self._found, "files")

    @functools.cached_property
    def sessions(self) -> DataFrame:
        return stored(transcripts.sessions_of(self.files), "sessions")

    @functools.cached_property
    def records(self) -> DataFrame:
        return stored(transcripts.parse_lines(transcripts.read_lines(self._spark, self._source, self._paths)), "records", wide=True)

    @functools.cached_property
    def metas(self) -> DataFrame:
        return stored(transcripts.read_spawn_meta(self._spark, self._source, self._paths), "metas")

    @functools.cached_property
    def _seen(self) -> DataFrame:
        return stored(seen_of(self.records), "seen", wide=True)

    @functools.cached_property
    def calls(self) -> DataFrame:
        return stored(calls_of(self.records), "calls", wide=True)

    @functools.cached_property
    def uses(self) -> DataFrame:
        return stored(uses_of(self.records, self.calls), "uses", wide=True)

    @functools.cached_property
    def results(self) -> DataFrame:
        return stored(results_of(self.records), "results", wide=True)

    @functools.cached_property
    def forest(self) -> DataFrame:
        first = self.calls.filter("call_index = 0").select("session_id", F.col("conv_id").alias("agent_id"), F.col("ts_ms").alias("first_ts"))
        known = self.files.filter("conv_id <> '' and half = 'transcript'").select("session_id", F.col("conv_id").alias("agent_id"))
        candidates = stored(self.metas.join(known, ["session_id", "agent_id"], "left_semi").join(first, ["session_id", "agent_id"], "left").fillna(0, ["first_ts"]), "candidates")
        uses = self.uses.select(*CONV, "tool_use_id", F.col("call_index").cast("int").alias("call_index"))
        forest = tree.resolve_spawns(candidates, uses, self.calls.select(*CONV, "call_index", F.col("ts_ms").alias("ts")))
        return stored(forest.join(self.metas.select("session_id", "agent_id", "agent_type", "description", "tool_use_id", "declared_depth"), ["session_id", "agent_id"], "left"), "forest")

    @functools.cached_property
    def tools(self) -> DataFrame:
        return stored(tools_of(self.uses, self.results), "tools", wide=True)

    @functools.cached_property
    def turns(self) -> DataFrame:
        return stored(turns_of(self._seen, self.calls), "turns", wide=True)

    @functools.cached_property
    def arrivals(self) -> DataFrame:
        return stored(arrivals_of(self._seen, self.calls, self.uses, self.results), "arrivals", wide=True)

    @functools.cached_property
    def labels(self) -> DataFrame:
        return stored(labels_of(self.calls, self.forest), "labels", wide=True)

    @functools.cached_property
    def lost_results(self) -> DataFrame:
        return stored(unmatched_results(self.uses, self.results), "lost-results")

    @functools.cached_property
    def spans(self) -> DataFrame:
        return stored(spans_of(self.calls, self.tools, self.turns, self.forest, self.labels), "spans", wide=True)

    @functools.cached_property
    def rolled(self) -> DataFrame:
        return stored(rolled_up(self.spans), "rolled")


def analyze(spark: SparkSession, root: str | transcripts.Packed, picked: DataFrame | None = None) -> Analysis:
    """All tables of the corpus below ``root``, or of its ``picked`` sessions (see ``transcripts.in_scope``); records are parsed once and stored."""
    return Analysis(spark, root, picked)
