"""Forests: ancestors, rollups, extents, token layout, spawn resolution."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.functions.storage import stored
from tracemill.operators.scan import running_sum


class Circle(ValueError):
    """Chains of parents that go round."""


def _first_jumps(nodes: DataFrame, node: str, parent: str, scope: Sequence[str]) -> DataFrame:
    ids = nodes.select(*scope, F.col(node).alias("_up"))
    return nodes.select(*scope, node, F.col(parent).alias("_up")).filter(F.col("_up").isNotNull()).join(ids.hint("merge"), [*scope, "_up"], "left_semi")


def _jumps(nodes: DataFrame, node: str, parent: str, scope: Sequence[str]) -> Iterator[DataFrame]:
    """Tables (``node``, ``_up``) of the ancestors 1, 2, 4, ... steps above, each stored, until no chain is as long.

    In a forest every length that is met has a node whose chain ends there, so the
    tables shrink from one to the next; where one does not, what is left goes round.
    """
    now, left = _first_jumps(nodes, node, parent, scope), None
    while True:
        now = stored(now, "jumps")
        n = now.count()
        if not n:
            return
        if n == left:
            raise Circle(f"chains of {parent} above {node} go round in a circle")
        left = n
        yield now
        above = now.select(*scope, F.col(node).alias("_up"), F.col("_up").alias("_top"))
        now = _sized(now, n).join(above, [*scope, "_up"]).select(*scope, node, F.col("_top").alias("_up"))


def ancestors(nodes: DataFrame, node: str, parent: str, scope: Sequence[str] = ()) -> DataFrame:
    """``node``, ``ancestor`` and ``distance`` for every node and each node above it, itself included.

    As many rows as there are pairs of a node and an ancestor; sums over subtrees and along
    chains need no such table (``rollup``, ``climb``).  Round k knows all ancestors
    nearer than 2**k.  A parent that is no node ends the chain; a cycle raises ``Circle``.
    """
    found, span = nodes.select(*scope, node, F.col(node).alias("ancestor"), F.lit(0).alias("distance")), 1
    for jumps in _jumps(nodes, node, parent, scope):
        found = stored(found, "ancestors")
        above = found.select(*scope, F.col(node).alias("_up"), "ancestor", (F.col("distance") + span).alias("distance"))
        found = found.unionByName(jumps.join(above, [*scope, "_up"]).select(*scope, node, "ancestor", "distance"))
        span *= 2
    return stored(found, "ancestors")


#: Rows of a round up to which its table is sent to all tasks; larger ones are shuffled, so that what passes through the driver is bounded.
FEW = 20_000


def _sized(rows: DataFrame, n: int) -> DataFrame:
    """``rows``, of which there are ``n``, for a join whose kind depends on that number alone."""
    return F.broadcast(rows) if n <= FEW else rows.hint("merge")


def _placed(nodes: DataFrame, node: str, parent: str, scope: Sequence[str]) -> DataFrame:
    """Add ``_up``: the parent, or null where it is no node."""
    ids = nodes.select(*scope, F.col(node).alias(parent), F.col(node).alias("_up"))
    return nodes.join(ids.hint("merge"), [*scope, parent], "left")


def rollup(nodes: DataFrame, node: str, parent: str, measures: Sequence[tuple[str, str, Column]], scope: Sequence[str] = ()) -> DataFrame:
    """Aggregates over each node's subtree: ``node`` and one column for each measure (name, ``sum``, ``min`` or ``max``, value).

    A condition inside a value makes it a partial rollup of the same pass.  After
    round k a node has received what its descendants nearer than 2**k steps hold; in the next each hands
    its own and all it has received on to the ancestor 2**k steps above.  So a round has
    a row for each node with an ancestor that far up, and the rounds grow with the logarithm of the depth; there is no
    table of nodes and ancestors.  What a node receives is aggregated before the
    shuffle, so a node with very many children is no burden to one task.  Node
    ids are unique within ``scope``; a cycle raises ``Circle``.
    """
    merge = {"sum": F.sum, "min": F.min, "max": F.max}
    sums = [merge[kind](name).alias(name) for name, kind, _ in measures]
    names = [name for name, _, _ in measures]
    held = nodes.select(*scope, node, *[value.alias(name) for name, _, value in measures])
    # What nodes have and what they have received need not be put together between the rounds.
    all_held = held.withColumn("_is", F.lit(True))
    for k, jumps in enumerate(_jumps(nodes, node, parent, scope)):
        if k:
            sent = all_held.drop("_is").join(_sized(jumps, jumps.count()), [*scope, node]).drop(node)
        else:  # parents that are no nodes fall out at the end
            sent = nodes.filter(F.col(parent).isNotNull()).select(*scope, F.col(parent).alias("_up"), *[value.alias(name) for name, _, value in measures])
        got = stored(sent.groupBy(*scope, F.col("_up").alias(node)).agg(*sums), "received")
        all_held = all_held.unionByName(got.withColumn("_is", F.lit(None).cast("boolean")))
    out = all_held.groupBy(*scope, node).agg(*sums, F.max("_is").alias("_is"))
    return out.filter("_is").select(*scope, node, *names)


def climb(nodes: DataFrame, node: str, parent: str, sums: Sequence[tuple[str, Column]] = (), scope: Sequence[str] = (), kept: Sequence[str] = ()) -> DataFrame:
    """``node``, ``top`` (the root above it, or itself), ``depth`` and, for each (name, value), the sum over the node and all above it.

    Pointers double, so the rounds grow with the logarithm of the depth, and a round has a
    row for each node whose chain goes on.  A parent that is no node ends the chain; a cycle raises ``Circle``.
    Columns in ``kept`` stay as they are.
    """
    names = [name for name, _ in sums]
    placed = _placed(nodes.select(*scope, node, parent, *kept, *[value.alias(name) for name, value in sums]), node, parent, scope)
    first = placed.select(*scope, node, *kept, *names, "_up", F.coalesce("_up", node).alias("top"), F.when(F.col("_up").isNull(), 0).otherwise(1).cast("long").alias("depth"))
    state, ended, left = stored(first, "chains"), None, None
    while True:
        going = state.filter("_up is not null")
        n = going.count()
        every = state if ended is None else ended.unionByName(state)
        if not n:
            return every.drop("_up")
        if n == left:
            raise Circle(f"chains of {parent} above {node} go round in a circle")
        left = n
        above = every.select(*scope, F.col(node).alias("_up"), F.col("_up").alias("_next"), F.col("top").alias("_top"), F.col("depth").alias("_depth"), *[F.col(c).alias(f"_{c}") for c in names])
        done = state.filter("_up is null")
        ended = done if ended is None else ended.unionByName(done)
        both = _sized(going, n).join(above, [*scope, "_up"])
        further = both.select(
            *scope, node, *kept, *[(F.col(c) + F.coalesce(f"_{c}", F.lit(0))).alias(c) for c in names], F.col("_next").alias("_up"), F.col("_top").alias("top"), (F.col("depth") + F.col("_depth")).alias("depth")
        )
        state = stored(further, "chains")


def orphans(nodes: DataFrame, node: str, parent: str, scope: Sequence[str] = ()) -> DataFrame:
    """Nodes that name a parent which is no node, with the reason."""
    ids = nodes.select(*scope, F.col(node).alias(parent))
    lost = nodes.filter(F.col(parent).isNotNull()).join(ids, [*scope, parent], "left_anti")
    return lost.withColumn("why", F.concat(F.lit("parent "), F.col(parent).cast("string"), F.lit(" not found")))


def _offsets(placed: DataFrame, node: str, width: str, order: Sequence[Column | str], scope: Sequence[str]) -> DataFrame:
    below = running_sum(placed.filter("_up is not null"), F.col(width), [*order, node], [*scope, "_up"], "offset")
    return below.unionByName(placed.filter("_up is null").withColumn("offset", F.lit(0).cast("long")))


def sibling_offsets(nodes: DataFrame, node: str, parent: str, width: str, order: Sequence[Column | str], scope: Sequence[str] = ()) -> DataFrame:
    """Add ``offset``: the widths of the siblings before each node; 0 for a node without a parent among the nodes."""
    return _offsets(stored(_placed(nodes, node, parent, scope).select(*nodes.columns, "_up"), "siblings"), node, width, order, scope).drop("_up")


def token_layout(nodes: DataFrame, node: str, parent: str, own: str, order: Sequence[Column | str], scope: Sequence[str] = ()) -> DataFrame:
    """Add ``width``, ``start`` and ``end`` of each node on its tree's token axis, which begins at 0.

    A node is as wide as its own tokens and its children's, a leaf at least one; children
    lie end to end in ``order`` (ties by id), the node's own after them.  A node starts
    where the offsets among siblings of itself and of all above it add up to.  With
    ``own`` 1 everywhere ``end`` is the node's number in post-order.  Where ``order`` consists of
    names no other columns travel through the rounds.
    """
    names = all(isinstance(o, str) for o in order)
    short = nodes.select(*dict.fromkeys([*scope, node, parent, own, *order])) if names else nodes
    placed = _placed(short, node, parent, scope)
    inner = placed.filter("_up is not null").select(*scope, F.col("_up").alias(node)).distinct().withColumn("_inner", F.lit(True))
    wide = placed.join(inner.hint("merge"), [*scope, node], "left").withColumn("_w", F.when(F.col("_inner"), F.col(own)).otherwise(F.greatest(F.col(own), F.lit(1))).cast("long")).drop("_inner")
    wide = stored(wide, "wide")
    widths = rollup(wide.select(*scope, node, F.col("_up").alias("_parent"), "_w"), node, "_parent", [("width", "sum", F.col("_w"))], scope)
    sized = stored(wide.drop("_w").join(widths.hint("merge"), [*scope, node]), "sized")
    laid = stored(_offsets(sized, node, "width", order, scope).select(*scope, node, F.col("_up").alias("_parent"), "width", "offset"), "laid")
    starts = climb(laid, node, "_parent", [("start", F.col("offset"))], scope, ["width"]).select(*scope, node, "width", "start")
    return nodes.join(starts.hint("merge"), [*scope, node]).withColumn("end", F.col("start") + F.col("width"))


HOP = "array<struct<agent_id:string,agent_type:string,spawned_at_call:int,via:string>>"


def resolve_spawns(candidates: DataFrame, tool_uses: DataFrame, calls: DataFrame) -> DataFrame:
    """Place each session's spawned conversations in a forest.

    ``candidates`` (``session_id``, ``agent_id``, ``agent_type``, ``tool_use_id`` ('' for a command fork),
    ``declared_depth``, ``first_ts``), ``tool_uses`` (``session_id``, ``conv_id``, ``tool_use_id``,
    ``call_index``), ``calls`` (``session_id``, ``conv_id``, ``call_index``, ``ts``); the root's ``conv_id`` is ''.
    Returns ``session_id``, ``agent_id``, ``parent_agent`` (null: an orphan), ``spawned_at_call``, ``via``, ``why`` and ``lineage``.

    Rounds over all sessions at once.  A round joins the spawns still waiting with
    the tool uses of conversations placed before; where that places none, command
    forks go to the only conversation placed one level above what they claim, at
    its last call begun by then.  Forks of one round do not see each other.  There
    are as many rounds as spawns are nested, and what is left after the last one are orphans.
    """
    columns = ["session_id", "agent_id", "parent_agent", "spawned_at_call", "via", "lineage"]
    hop = F.struct("agent_id", "agent_type", F.col("spawned_at_call").cast("int").alias("spawned_at_call"), "via")
    root = candidates.select("session_id").distinct().select(
        "session_id", F.lit("").alias("agent_id"), F.lit(None).cast("string").alias("parent_agent"), F.lit(None).cast("int").alias("spawned_at_call"), F.lit(None).cast("string").alias("via"), F.expr(f"cast(array() as {HOP})").alias("lineage")
    )
    placed = stored(root.select(*columns), "placed")
    known = candidates.filter("tool_use_id <> ''").select("session_id", "tool_use_id").distinct()
    owners = stored(tool_uses.join(known, ["session_id", "tool_use_id"], "left_semi").select("session_id", "tool_use_id", F.col("conv_id").alias("parent_agent"), F.col("call_index").alias("at")), "owners")

    def under(spawns: DataFrame, via: str) -> DataFrame:
        """Spawns with ``parent_agent`` and ``at``, hung under their parent's lineage."""
        parents = placed.select("session_id", F.col("agent_id").alias("parent_agent"), F.col("lineage").alias("_above"))
        hung = spawns.join(parents, ["session_id", "parent_agent"]).withColumn("spawned_at_call", F.col("at").cast("int")).withColumn("via", F.lit(via))
        return hung.withColumn("lineage", F.concat("_above", F.array(hop)).cast(HOP)).select(*columns)

    def by_tool_use(waiting: DataFrame) -> DataFrame:
        homes = owners.join(placed.select("session_id", F.col("agent_id").alias("parent_agent")), ["session_id", "parent_agent"])
        last = homes.groupBy("session_id", "tool_use_id").agg(F.max_by(F.struct("parent_agent", "at"), F.struct("at", "parent_agent")).alias("home"))
        return under(waiting.join(last, ["session_id", "tool_use_id"]).select("session_id", "agent_id", "agent_type", "home.*"), "tool_use")

    def by_depth(waiting: DataFrame) -> DataFrame:
        only = placed.groupBy("session_id", F.size("lineage").alias("_depth")).agg(F.count(F.lit(1)).alias("_n"), F.min("agent_id").alias("parent_agent")).filter("_n = 1")
        forks = waiting.filter("tool_use_id = ''").withColumn("_depth", F.col("declared_depth") - 1).join(only, ["session_id", "_depth"])
        clock = calls.select("session_id", F.col("conv_id").alias("parent_agent"), "call_index", "ts")
        begun = F.max(F.when(F.col("ts") <= F.col("first_ts"), F.col("call_index")))
        timed = forks.join(clock, ["session_id", "parent_agent"], "left").groupBy("session_id", "agent_id", "agent_type", "parent_agent").agg(F.coalesce(begun, F.lit(0)).alias("at"))
        return under(timed, "command")

    while True:
        waiting = candidates.join(placed.select("session_id", "agent_id"), ["session_id", "agent_id"], "left_anti")
        found = stored(by_tool_use(waiting), "placed-by-tool")
        if found.isEmpty():
            found = stored(by_depth(waiting), "placed-by-depth")
            if found.isEmpty():
                break
        placed = stored(placed.unionByName(found), "placed")
    depths = placed.groupBy("session_id", (F.size("lineage") + 1).alias("declared_depth")).agg(F.count(F.lit(1)).alias("_n"))
    lost = waiting.join(depths, ["session_id", "declared_depth"], "left")
    at_depth = F.concat(F.lit("a command fork needs one conversation at depth "), (F.col("declared_depth") - 1).cast("string"), F.lit(", found "), F.coalesce("_n", F.lit(0)).cast("string"))
    why = F.when(F.col("tool_use_id") == "", at_depth).otherwise(F.concat(F.lit("no placed conversation holds its tool use "), F.col("tool_use_id")))
    orphaned = lost.select("session_id", "agent_id", F.lit(None).cast("string").alias("parent_agent"), F.lit(None).cast("int").alias("spawned_at_call"), F.lit(None).cast("string").alias("via"), F.expr(f"cast(array() as {HOP})").alias("lineage"), why.alias("why"))
    out = placed.filter("agent_id <> ''").withColumn("why", F.lit(None).cast("string")).unionByName(orphaned)
    return out.select("session_id", "agent_id", "parent_agent", "spawned_at_call", "via", "why", "lineage")
