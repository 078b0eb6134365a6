"""Registered queries: each operator on the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracemill.functions import tokens as T
from tracemill.operators import audit, fit, joins, ledger, rules, sequence, tree
from tracemill.plans.adapters import calls, part_forest, points, table, turns_of

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

USER, CALL = ["user_id"], "call_index"
#: Rates of the adapted models in USD per million tokens; one model has none and one changes its rate.
RATES = [
    ("view", None, 1_704_067_200_000 + 15 * 86_400_000, 3.0, 15.0),
    ("view", 1_704_067_200_000 + 15 * 86_400_000, None, 4.0, 20.0),
    ("click", None, None, 1.0, 5.0),
    ("purchase", None, None, 5.0, 25.0),
    ("signup", None, None, 2.0, 10.0),
]


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _epochs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    c = sequence.with_epochs(calls(spark, d), USER, CALL)
    return c, sequence.epoch_table(c, USER, CALL, "ts_ms")


def _l(x: F.Column | str) -> F.Column:
    return (F.col(x) if isinstance(x, str) else x).cast("long")


# --- sequences ------------------------------------------------------------


@query
def epochs(spark, d):
    return _epochs(spark, d)[1].select("user_id", *[_l(c).alias(c) for c in ("epoch", "start_call", "end_call", "rewritten", "gap")])


@query
def invalidation_excess(spark, d):
    e = _epochs(spark, d)[1]
    return e.groupBy("user_id").agg(F.count(F.lit(1)).alias("epochs"), F.sum("rewritten").alias("rewritten"), (F.sum("rewritten") * 23).alias("excess20"))


@query
def conservation(spark, d):
    return sequence.conservation(_epochs(spark, d)[0], USER)


@query
def cache_read_recurrence(spark, d):
    c = _epochs(spark, d)[0].filter("previous_read is not null and cache_read >= previous_read")
    exact = F.col("cache_read") == F.col("previous_read") + F.col("previous_creation")
    return c.groupBy("user_id").agg(F.count(F.lit(1)).alias("sites"), F.count_if(exact).alias("exact"))


@query
def request_group_dedup(spark, d):
    c = calls(spark, d).withColumn("day", F.floor(F.col("ts_ms") / 86_400_000).cast("long"))
    g = sequence.request_groups(c, ["user_id"], "day", CALL, "output", ["output", "input", "cache_creation", "cache_read"], ["model"])
    cols = ("user_id", "day", "output", "input", "cache_creation", "cache_read", "last_output", "line_count", "call_index")
    return g.select(*[_l(c).alias(c) for c in cols], "output_varies", "model")


@query
def next_call_index(spark, d):
    return turns_of(spark, d).select("conv_id", "turn", "role", _l("next_call").alias("next_call"))


def _turns(spark, d) -> tuple[DataFrame, DataFrame]:
    rows = turns_of(spark, d)
    total = F.count_if(F.col("role") == "assistant").over(Window.partitionBy("conv_id"))
    opened = rows.withColumn("calls", total).filter("role = 'user'").withColumnRenamed("next_call", "first_call")
    return rows, sequence.extents(opened, ["conv_id"], "turn", "first_call", F.col("calls"))


@query
def turn_extents(spark, d):
    return _turns(spark, d)[1].select("conv_id", "turn", *[_l(c).alias(c) for c in ("turn_index", "first_call", "last_call")])


@query
def calls_in_turns(spark, d):
    rows, turns = _turns(spark, d)
    c = rows.filter("role = 'assistant'").select("conv_id", F.col("next_call").alias("call_index"))
    found = joins.within(c, turns.select("conv_id", "first_call", "last_call", "turn_index"), ["conv_id"], "call_index")
    return found.select("conv_id", _l("call_index").alias("call_index"), _l("turn_index").alias("turn_index"))


@query
def classify_carry_forward(spark, d):
    decided = rules.first_match(
        [(F.col("model") == "purchase", F.lit("implementation")), (F.col("model") == "error", F.lit("verification")), (F.col("event_id") % 5 == 0, F.lit("unclassified"))],
        F.lit(None).cast("string"),
    )
    c = sequence.carry_forward(calls(spark, d).withColumn("activity", decided), USER, CALL, "activity", "none")
    return c.select("user_id", "call_index", "activity", "carried")


@query
def strata_stack(spark, d):
    c = _epochs(spark, d)[0].filter("cache_creation > 0")
    s = sequence.stacked(c, ["user_id", "epoch"], CALL, "cache_creation")
    return s.select("user_id", "call_index", _l("epoch").alias("epoch"), _l("y0").alias("y0"), _l("y1").alias("y1"))


@query
def report_select(spark, d):
    rows = table(spark, d, "customer").select("c_custkey", _l("c_nationkey").alias("c_nationkey"), (F.col("c_custkey") % 3 == 0).alias("spawned"))
    order = [F.desc("spawned"), F.desc("c_custkey")]
    return sequence.capped_selection(rows, "c_nationkey", order, 2, 24)


# --- joins ----------------------------------------------------------------


def _requests(spark, d) -> tuple[DataFrame, DataFrame]:
    # Every seventh order has a key that no line names, so its lines are answers to nothing.
    o = table(spark, d, "orders").select(F.when(F.col("o_orderkey") % 7 == 0, -1 - F.col("o_orderkey")).otherwise(F.col("o_orderkey")).alias("key"), "o_orderpriority")
    a = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("key"), "l_partkey", "l_suppkey", (F.col("l_partkey") * 100_000 + F.col("l_suppkey")).alias("pos"))
    return o, a


@query
def tool_answers(spark, d):
    o, a = _requests(spark, d)
    one = joins.last_wins(a, ["key"], "pos", ["l_partkey", "l_suppkey"])
    return joins.answered(o, one, ["key"]).select("key", "l_partkey", "l_suppkey", "slot", "repeats")


@query
def unmatched_answers(spark, d):
    o, a = _requests(spark, d)
    return joins.unmatched(a, o, ["key"]).groupBy("key").agg(F.count(F.lit(1)).alias("n"))


@query
def duplicate_answers(spark, d):
    o, a = _requests(spark, d)
    return joins.duplicate_answers(a, o, ["key"])


@query
def command_fork_as_of(spark, d):
    c = calls(spark, d)
    views, forks = c.filter("model = 'view'").select("user_id", "ts_ms", "call_index"), c.filter("model = 'purchase'").select("user_id", "event_id", "ts_ms")
    return joins.as_of(forks, views.withColumnRenamed("ts_ms", "at"), USER, "ts_ms", "at", "call_index", 0).select("user_id", "event_id", "call_index")


@query
def true_cost(spark, d):
    c, e = _epochs(spark, d)
    arrivals = c.filter("model = 'purchase'").select("user_id", "event_id", F.col("call_index").alias("born"), (F.col("event_id") % 1000).alias("tokens"))
    lived = joins.lifetimes(arrivals, e, USER, "born", "tokens")
    return lived.select("user_id", "event_id", "born", "writes", "reads", (F.col("tokens") * (25 * F.col("writes") + 2 * F.col("reads"))).alias("total20"), F.round("multiple", 6).alias("multiple"))


def _rated(spark, d) -> DataFrame:
    card = spark.createDataFrame(RATES, "model string, valid_from long, valid_to long, in_rate double, out_rate double")
    return joins.at_rates(calls(spark, d), card, T.canonical_model("model"), "ts_ms")


@query
def price_calls(spark, d):
    side = 20 * F.col("input") + 25 * F.col("cache_creation") + 2 * F.col("cache_read")
    usd = side * F.col("in_rate") + 20 * F.col("output") * F.col("out_rate")  # whole numbers, so that sums are exact
    p = ledger.price_totals(_rated(spark, d), USER, usd, T.spend20())
    return p.select("user_id", T.rounded(F.col("usd") / 20_000_000, 6).alias("usd"), "priced", "unpriced", "unpriced_calls", "calls", "unpriced_models")


@query
def sidecar_pairing(spark, d):
    p = table(spark, d, "part").select(F.when(F.col("p_partkey") % 3 == 0, -1 - F.col("p_partkey")).otherwise(F.col("p_partkey")).alias("id"), F.lit(True).alias("transcript"))
    m = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.lit(True).alias("meta"))
    both = p.join(m, "id", "full_outer")
    why = F.when(F.col("transcript").isNull(), "meta present, transcript missing").when(F.col("meta").isNull(), "transcript present, meta missing").otherwise("paired")
    return both.select("id", why.alias("pairing"))


# --- attribution, ledgers -------------------------------------------------


def _caused(spark, d) -> tuple[DataFrame, DataFrame]:
    c = calls(spark, d)
    # Every third arrival comes before a call that never was, so some calls have no cause.
    at = F.when(F.col("event_id") % 3 == 0, -2).otherwise(F.col("call_index")).alias("call_index")
    a = c.select("user_id", at, F.col("model").alias("label"), T.estimate_tokens(F.col("event_id") % 4000).alias("tokens"))
    return c, a


@query
def cause_attribution(spark, d):
    c, a = _caused(spark, d)
    b = a.withColumn("call_index", F.col("call_index") + F.col("tokens") % 2)
    sums = b.groupBy("user_id", "call_index").agg(F.sum("tokens").alias("t"), F.count(F.lit(1)).alias("n"))
    out = c.join(sums, ["user_id", "call_index"], "left")
    exact = 20 * F.col("input") + 25 * F.col("cache_creation")
    caused = 25 * F.coalesce("t", F.lit(0))
    return out.select("user_id", "call_index", exact.alias("exact20"), caused.alias("caused20"), (exact - caused).alias("unattributed20"), F.coalesce("n", F.lit(0)).alias("causes"))


@query
def causes_by_label(spark, d):
    _, a = _caused(spark, d)
    return a.groupBy("user_id", "label").agg(F.count(F.lit(1)).alias("n"), F.sum("tokens").alias("tokens"), (25 * F.sum("tokens")).alias("cost20"))


@query
def arrivals_union(spark, d):
    rows = turns_of(spark, d)
    born, size = F.col("next_call"), F.length("text")
    parts = [
        rows.filter("role = 'user'").select("conv_id", born.alias("born"), F.lit("userText").alias("source"), T.estimate_tokens(size).alias("tokens"), F.lit("estimated").alias("basis")),
        rows.filter("role = 'system'").select("conv_id", born.alias("born"), F.lit("attachment").alias("source"), T.estimate_tokens(size).alias("tokens"), F.lit("estimated").alias("basis")),
        rows.filter("role = 'assistant'").select("conv_id", (born + 1).alias("born"), F.lit("assistantOutput").alias("source"), size.cast("long").alias("tokens"), F.lit("exact").alias("basis")),
    ]
    out = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return out.groupBy("conv_id", "born", "source", "basis").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("n")).withColumn("born", _l("born"))


@query
def arena_basis(spark, d):
    a = arrivals_union(spark, d)
    of = lambda b: F.sum(F.when(F.col("basis") == b, F.col("tokens")).otherwise(0))
    return a.groupBy("conv_id").agg(of("exact").alias("exact"), of("estimated").alias("estimated"), F.round(ledger.share_of(of("exact"), F.sum("tokens")), 6).alias("exact_share"))


@query
def ledger_by_model(spark, d):
    out = ledger.ledger(calls(spark, d), F.col("model"), T.spend20(), flag=F.col("event_id") % 4 == 0)
    return out.select("key", "amount", "calls", "flagged", F.round("share", 6).alias("share"), F.round("flagged_share", 6).alias("flagged_share"))


@query
def session_ledgers(spark, d):
    out = ledger.ledger(calls(spark, d), F.col("model"), T.spend20(), USER)
    return out.select("user_id", "key", "amount", "calls", F.round("share", 6).alias("share"))


@query
def corpus_ledger(spark, d):
    per = ledger.ledger(calls(spark, d), F.col("model"), T.spend20(), USER).withColumn("cost", T.half_up(F.col("amount") / 20).cast("long"))
    sums = per.groupBy("key").agg(F.sum("cost").alias("cost"), F.sum("calls").alias("calls"))
    return sums.select("key", "cost", "calls", F.round(ledger.share_of(F.col("cost"), F.sum("cost").over(Window.partitionBy(F.lit(0)))), 6).alias("share"))


@query
def tool_ledger(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_returnflag")
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), (F.col("o_custkey") * 1.0).alias("amount"))
    out = ledger.even_split(li.join(o, "l_orderkey"), ["l_orderkey"], "l_returnflag", "amount")
    return out.select("l_returnflag", F.round("amount", 2).alias("amount"), "uses")


@query
def cache_ledger(spark, d):
    sums = calls(spark, d).groupBy("user_id").agg(*T.usage_sums())
    parts = [("uncached input", 20 * F.col("input")), ("cache writes", 25 * F.col("cache_creation")), ("cache reads", 2 * F.col("cache_read")), ("output", 20 * F.col("output"))]
    return ledger.unpivot(sums, USER, parts).select("user_id", "key", _l("amount").alias("amount20"))


def _labelled(spark, d) -> DataFrame:
    tier = F.when(F.col("event_id") % 7 == 0, "marker").when(F.col("event_id") % 7 == 6, "none").otherwise("rule")
    return calls(spark, d).withColumn("tier", tier)


@query
def coverage_by_tier(spark, d):
    out = ledger.coverage(_labelled(spark, d), USER, "tier", ("marker", "rule", "judge", "hand", "none"), T.spend20(), F.col("tier") == "none")
    shares = [c for c in out.columns if c not in ("user_id", "total")]
    return out.select("user_id", "total", *[F.round(c, 6).alias(c) for c in shares])


@query
def corpus_coverage(spark, d):
    out = ledger.coverage(_labelled(spark, d), USER, "tier", ("marker",), T.spend20(), F.col("tier") == "none")
    return ledger.weighted_mean(out, "unclassified", "total", 1.0).select(F.round("mean", 6).alias("unclassified"))


@query
def dominant_source(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_returnflag", _l("l_quantity").alias("q"))
    out = ledger.dominant(li, ["l_orderkey"], "l_returnflag", "q")
    return out.select("l_orderkey", "source", F.round("share", 6).alias("share"))


@query
def scope_exclusions(spark, d):
    rows = table(spark, d, "customer")
    _, counts = ledger.excluded_counts(
        rows, [("segment", F.col("c_mktsegment").rlike("^(BUILDING|MACHINERY)")), ("balance", F.col("c_acctbal") >= 0), ("prefix", F.col("c_custkey").cast("string").startswith("1"))]
    )
    return counts


@query
def findings(spark, d):
    c, e = _epochs(spark, d)
    whole = c.groupBy("user_id").agg(F.sum(T.spend20()).alias("whole"), F.max(F.when(F.col("call_index") == 0, 20 * F.col("input") + 25 * F.col("cache_creation"))).alias("startup"),
                                    F.sum(F.when(F.col("event_id") % 3 == 0, 20 * F.col("output")).otherwise(0)).alias("reasoning"), F.sum(F.when(F.col("model").isin(*{r[0] for r in RATES}), 0).otherwise(T.spend20())).alias("unpriced"))
    start = whole.select("user_id", F.lit("startup").alias("finding"), F.lit(0).cast("long").alias("at_call"), F.col("startup").alias("cost20"), "whole")
    lost = e.filter("epoch > 0").join(whole, "user_id").select(
        "user_id", F.when(F.col("gap") >= 300_000, "cache expired").otherwise("prefix changed").alias("finding"), _l("start_call").alias("at_call"), (23 * F.col("rewritten")).alias("cost20"), "whole"
    )
    both = start.unionByName(lost)
    for name, cost in (("reasoning share of output", "reasoning"), ("pricing gap", "unpriced")):  # of every session, at zero too
        both = both.unionByName(whole.select("user_id", F.lit(name).alias("finding"), F.lit(None).cast("long").alias("at_call"), F.col(cost).alias("cost20"), "whole"))
    small = F.col("at_call").isNull() & (20 * F.col("cost20") <= F.col("whole"))
    high = F.when((F.col("finding") == "startup") | small, "note").when(20 * F.col("cost20") > F.col("whole"), "high").otherwise("medium")
    return both.select("user_id", "finding", "at_call", "cost20", high.alias("severity"), F.round(ledger.share_of(F.col("cost20"), F.col("whole")), 6).alias("share"))


@query
def synopsis(spark, d):
    c = calls(spark, d)
    top = ledger.dominant(c.withColumn("v", T.spend20()), USER, "model", "v").select("user_id", "source")
    rank = F.when((F.col("model") == "purchase") & (F.col("output") > 20), 0).when((F.col("model") == "view") & (F.col("output") > 20), 1).when(F.col("model") == "click", 2)
    opening = c.withColumn("r", rank).filter("r is not null").groupBy("user_id").agg(F.min_by("event_id", F.struct("r", "call_index")).alias("opening"))
    return top.join(opening, "user_id", "left").select("user_id", F.col("source").alias("dominant"), "opening")


# --- fits -----------------------------------------------------------------


@query
def tokenizer_fit(spark, d):
    f = fit.fit_tokenizers(points(spark, d))
    return f.select("model", *[F.round(c, 5).alias(c) for c in ("chars_per_token", "tokens_per_block", "held_out_error")], "points", "transcripts")


def _split(spark, d) -> DataFrame:
    p = points(spark, d)
    return fit.split_output(p.withColumn("reasoned", F.col("doc_id") % 3 == 0), fit.fit_tokenizers(p))


@query
def output_totals(spark, d):
    t = fit.output_totals(_split(spark, d), ["model"])
    return t.select("model", *[_l(c).alias(c) for c in ("total", "visible", "reasoning", "estimator_error", "uncalibrated", "calls_with_reasoning", "uncalibrated_calls", "calls")], "uncalibrated_models")


# --- forests --------------------------------------------------------------


@query
def forest_depth(spark, d):
    return tree.climb(part_forest(spark, d), "id", "parent").select("id", "depth", "top")


@query
def forest_orphans(spark, d):
    return tree.orphans(part_forest(spark, d), "id", "parent").select("id", "why")


@query
def tree_rollup(spark, d):
    n = part_forest(spark, d)
    some = F.when(F.col("brand") == "Brand#11", F.col("own")).otherwise(0)
    out = tree.rollup(n, "id", "parent", [("tokens", "sum", F.col("own")), ("brand_tokens", "sum", some), ("nodes", "sum", F.lit(1)), ("widest", "max", F.col("own"))])
    return out.select(F.col("id").alias("root"), *[_l(c).alias(c) for c in ("tokens", "brand_tokens", "nodes", "widest")])


@query
def tree_ancestors(spark, d):
    """Every node with each node above it."""
    return tree.ancestors(part_forest(spark, d), "id", "parent").select("id", "ancestor", _l("distance").alias("distance"))


@query
def token_layout(spark, d):
    laid = tree.token_layout(part_forest(spark, d), "id", "parent", "own", ["id"])
    return laid.select("id", _l("start").alias("start"), _l("end").alias("end"), _l("width").alias("width"))


@query
def session_list(spark, d):
    """Calls of users as sessions: spawned work by depth of the event's id in a forest, priced."""
    depth = F.floor(F.log10(F.greatest(F.col("event_id"), F.lit(1)).cast("double") + 0.5)).cast("long")
    c = _rated(spark, d).withColumn("depth", depth % 3)
    side = 20 * F.col("input") + 25 * F.col("cache_creation") + 2 * F.col("cache_read")
    usd = side * F.col("in_rate") + 20 * F.col("output") * F.col("out_rate")
    spawned = F.col("depth") > 0
    return c.groupBy("user_id").agg(
        F.min("ts_ms").alias("started_ms"),
        F.floor((F.max("ts_ms") - F.min("ts_ms")) / 60_000).cast("long").alias("wall_min"),
        F.count(F.lit(1)).alias("calls"),
        F.count_if(spawned).alias("spawned_calls"),
        F.max("depth").alias("max_depth"),
        F.sum(T.spend20()).alias("spend20"),
        F.sum(F.when(spawned, T.spend20()).otherwise(0)).alias("spawned20"),
        T.rounded(F.coalesce(F.sum(usd), F.lit(0.0)) / 20_000_000, 6).alias("usd"),
        F.sum(F.when(F.col("in_rate").isNull(), T.spend20()).otherwise(0)).alias("unpriced20"),
    )


# --- audits ---------------------------------------------------------------


@query
def identity_audit(spark, d):
    c = _epochs(spark, d)[0].withColumn("site", F.col("call_index").cast("string"))
    claim = lambda name, rows, left, right: rows.select(F.lit(name).alias("identity"), F.col("user_id").cast("string").alias("session"), "site", _l(left).alias("lhs"), _l(right).alias("rhs"))
    claims = claim("cache-read-recurrence", c.filter("previous_read is not null and cache_read >= previous_read"), F.col("cache_read"), F.col("previous_read") + F.col("previous_creation"))
    claims = claims.unionByName(claim("residency-predicts-cache-read", c.filter("predictable"), F.col("cache_read"), F.col("expected")))
    claims = claims.unionByName(claim("cache-creation-accounted", c, F.greatest(F.lit(0), F.col("cache_creation") - F.lit(95)), F.lit(0)))
    g = request_group_dedup(spark, d).filter("output_varies").withColumn("site", F.col("day").cast("string"))
    claims = claims.unionByName(claim("output-snapshot-agrees", g, F.col("output"), F.col("last_output")))
    # What each tree's root has gathered step by step against the sum of the nodes that find their way to it.
    n = part_forest(spark, d)
    rolled = tree.rollup(n, "id", "parent", [("gathered", "sum", F.col("own"))]).withColumnRenamed("id", "top")
    flat = tree.climb(n, "id", "parent").join(n.select("id", "own"), "id").groupBy("top").agg(F.sum("own").alias("flat"))
    trees = flat.join(rolled, "top").withColumn("user_id", F.col("top")).withColumn("site", F.lit("tokens"))
    claims = claims.unionByName(claim("tree-holds-every-token", trees, F.col("gathered"), F.col("flat")))
    return audit.audits(claims).select("identity", "sites", "violations", "allowed", "held")


# --- scalar functions -----------------------------------------------------


@query
def derived_ids(spark, d):
    n = table(spark, d, "nation")
    return n.select("n_name", T.trace_id(F.lit("tokens"), F.col("n_name")).alias("trace"), T.span_id(F.lit("tokens"), F.col("n_name"), F.col("n_nationkey").cast("string")).alias("span"))


@query
def parse_stats(spark, d):
    raw = F.when(F.col("event_id") % 10 == 0, F.expr("substr(props, 1, length(props) - 1)")).otherwise(F.col("props"))
    parsed = F.try_variant_get(F.try_parse_json(raw), "$.k", "long")
    ok = F.try_parse_json(raw).isNotNull()
    return table(spark, d, "events").groupBy(F.col("event_type").alias("kind")).agg(F.count(F.lit(1)).alias("lines"), F.count_if(~ok).alias("unparseable"), F.sum(parsed).alias("total"))


@query
def tsv_rows(spark, d):
    return table(spark, d, "documents").select("doc_id", T.tsv_row("source", "lang", "text").alias("line"))


@query
def workspace_leaf(spark, d):
    path = F.regexp_replace("url", r"[?#].*$", "")
    return table(spark, d, "pages").select("page_id", T.leaf_name(path).alias("leaf"))


@query
def turn_origins(spark, d):
    k, t = F.col("doc_id") % 8, F.col("text")
    raw = (
        F.when(k == 0, F.concat(F.lit("<command-name>/next</command-name><command-args>"), F.col("lang"), F.lit("</command-args>")))
        .when(k == 1, F.concat(F.lit("Base directory for this skill: /home/u/skills/"), F.col("source"), F.lit(" x")))
        .when(k == 2, F.concat(F.lit("<bash-input>ls "), F.col("source"), F.lit("</bash-input>")))
        .when(k == 3, F.concat(F.lit("<task-notification>"), t))
        .when(k == 4, F.concat(F.lit("<command-name>/clear</command-name>"), t))
        .when(k == 5, F.concat(F.lit("=== Below is a message from an agent x\n  "), F.col("source"), F.lit("\n=== end")))
        .when(k == 6, F.lit("<bash-stdout>done"))
        .otherwise(F.col("source"))
    )
    o = rules.turn_origin(raw)
    return table(spark, d, "documents").select("doc_id", o["kind"].alias("kind"), o["value"].alias("value"), o["snippet"].alias("snippet"), rules.is_session_control(o).alias("control"))


@query
def model_ids(spark, d):
    m = F.concat(F.col("event_type"), F.when(F.col("event_id") % 2 == 0, "-20240501").otherwise("-v2"))
    c = table(spark, d, "events").select("user_id", T.canonical_model(m).alias("model"))
    return c.groupBy("user_id").agg(F.array_join(F.array_sort(F.collect_set("model")), ", ").alias("models"), F.count(F.lit(1)).alias("n"))


@query
def lineage_cohorts(spark, d):
    hop = lambda k: F.struct(F.concat(F.lit("a"), F.col("user_id").cast("string"), F.lit(k)).alias("agent_id"), F.lit(k).alias("agent_type"))
    deep = F.col("event_id") % 3
    line = F.slice(F.array(hop("review"), hop("guide")), F.lit(1), deep.cast("int"))
    c = calls(spark, d).withColumn("lineage", line)
    return c.groupBy(T.lineage_path("lineage").alias("path"), _l(T.depth_of("lineage")).alias("depth")).agg(
        F.count(F.lit(1)).alias("calls"),
        F.count_if(T.is_main("lineage")).alias("main"),
        F.count_if(T.is_spawned("lineage")).alias("spawned"),
        F.count_if(T.in_agent("lineage", "a1review")).alias("in_a1review"),
        F.count_if(T.parent_agent("lineage").isNotNull()).alias("grandchildren"),
    )


@query
def fan_out(spark, d):
    c = calls(spark, d)
    return c.groupBy("user_id").agg(F.round(ledger.share_of(F.count(F.lit(1)), F.count_distinct("model")), 6).alias("fan_out"))


@query
def distinct_projects(spark, d):
    """How many sessions and projects each workspace key has; two projects of one leaf name stay two."""
    path = F.regexp_replace("url", r"[?#].*$", "")
    p = table(spark, d, "pages").select(path.alias("path"), T.leaf_name(path).alias("leaf"))
    return p.groupBy("leaf").agg(F.count_distinct("path").alias("projects"), F.count(F.lit(1)).alias("sessions"))


@query
def corpus_report(spark, d):
    """Sessions by dollars with their place and running totals of the list."""
    s = session_list(spark, d).select("user_id", "calls", "spend20", F.floor(F.col("usd") * 1_000_000 + 0.5).cast("long").alias("micro_usd"))
    totals = s.agg(F.sum("micro_usd").alias("list_micro_usd"), F.sum("calls").alias("list_calls"))
    # Places from the counts of a thousand ranges of dollars, then within each range.
    return ledger.placed_by(s, "micro_usd", "user_id").crossJoin(F.broadcast(totals)).select("user_id", "calls", "spend20", "micro_usd", _l("place").alias("place"), "list_micro_usd", "list_calls")


@query
def depth_disagreements(spark, d):
    """Nodes whose declared depth (the digits of their id in base 4) is not the one they resolve to."""
    n = part_forest(spark, d)
    depth = tree.climb(n, "id", "parent").select("id", "depth")
    declared = F.length(F.conv(F.col("id").cast("string"), 10, 4)).cast("long") - F.when(F.col("id") == 0, 1).otherwise(0)
    both = depth.withColumn("declared", declared)
    return both.filter("declared <> depth").select("id", "declared", "depth")


@query
def output_ledger(spark, d):
    """Each model's output by part with its share; the parts close on the total."""
    t = fit.output_totals(_split(spark, d), ["model"])
    parts = [(k, F.col(k)) for k in ("visible", "reasoning", "estimator_error", "uncalibrated")]
    out = ledger.unpivot(t, ["model", "total"], parts)
    return out.select("model", "key", _l(F.round("amount")).alias("amount"), F.round(ledger.share_of(F.col("amount"), F.col("total")), 6).alias("share"))
