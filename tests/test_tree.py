"""Rollups, chains and layouts of deep, wide and uneven forests; running sums over uneven ranges."""

from __future__ import annotations

import random
import time

import pytest
from pyspark.sql import functions as F

from tracemill.operators import audit, ledger, scan, tree

def measures():
    return [("n", "sum", F.lit(1)), ("total", "sum", F.col("own")), ("least", "min", F.col("own")), ("most", "max", F.col("own")), ("odd", "sum", F.when(F.col("own") % 2 == 1, F.col("own")).otherwise(0))]


def forest(spark, parents, scope=None):
    rows = [(i, p, (7 * i + 3) % 11) for i, p in parents.items()]
    return spark.createDataFrame(rows, "id long, parent long, own long")


def brute(parents):
    kids, roots = {}, []
    for i, p in parents.items():
        (kids.setdefault(p, []) if p in parents else roots).append(i)
    rolled, placed = {}, {}
    for r in roots:
        order, todo = [], [(r, 0)]
        while todo:
            i, depth = todo.pop()
            order.append(i)
            placed[i] = (r, depth)
            todo += [(k, depth + 1) for k in kids.get(i, [])]
        for i in reversed(order):
            own = (7 * i + 3) % 11
            parts = [(1, own, own, own, own if own % 2 else 0)] + [rolled[k] for k in kids.get(i, [])]
            rolled[i] = (sum(p[0] for p in parts), sum(p[1] for p in parts), min(p[2] for p in parts), max(p[3] for p in parts), sum(p[4] for p in parts))
    return rolled, placed


@pytest.mark.parametrize("shape", ["random", "chain", "star", "orphans", "single"])
def test_rollup_and_climb(spark, shape):
    random.seed(5)
    parents = {
        "random": {i: random.randrange(i) if i % 9 else None for i in range(1, 400)} | {0: None},
        "chain": {i: i - 1 if i else None for i in range(10_000)},
        "star": {i: 0 if i else None for i in range(100_000)},
        "orphans": {1: 50, 2: 1, 3: None, 4: 60, 5: 4},
        "single": {7: None},
    }[shape]
    nodes = forest(spark, parents).repartition(4)
    rolled, placed = brute(parents)
    assert {r["id"]: (r["n"], r["total"], r["least"], r["most"], r["odd"]) for r in tree.rollup(nodes, "id", "parent", measures()).collect()} == rolled
    up = tree.climb(nodes, "id", "parent", [("path", F.lit(1).cast("long"))]).collect()
    assert {r["id"]: (r["top"], r["depth"]) for r in up} == placed and all(r["path"] == r["depth"] + 1 for r in up)


def test_forests_within_a_scope(spark):
    nodes = spark.createDataFrame([("a", 1, None, 5), ("a", 2, 1, 7), ("b", 1, 2, 1), ("b", 2, None, 2), ("b", 3, 1, 4)], "s string, id long, parent long, own long")
    got = {(r["s"], r["id"]): r["t"] for r in tree.rollup(nodes, "id", "parent", [("t", "sum", F.col("own"))], ["s"]).collect()}
    assert got == {("a", 1): 12, ("a", 2): 7, ("b", 1): 5, ("b", 2): 7, ("b", 3): 4}
    assert {(r["s"], r["id"]): (r["top"], r["depth"]) for r in tree.climb(nodes, "id", "parent", scope=["s"]).collect()} == {("a", 1): (1, 0), ("a", 2): (1, 1), ("b", 1): (2, 1), ("b", 2): (2, 0), ("b", 3): (2, 2)}
    empty = nodes.limit(0)
    assert tree.rollup(empty, "id", "parent", measures(), ["s"]).count() == tree.climb(empty, "id", "parent").count() == tree.token_layout(empty, "id", "parent", "own", ["id"]).count() == 0


def test_a_circle_is_noticed_early(spark):
    """Two or three nodes in a circle below a wide forest: no node collects as many ancestors as there are rows."""
    for circle in ({4001: 4002, 4002: 4001}, {4001: 4002, 4002: 4003, 4003: 4001, 4004: 4003}):
        nodes = forest(spark, {i: i // 2 if i else None for i in range(4000)} | circle)
        for walk in (lambda n: tree.rollup(n, "id", "parent", measures()), lambda n: tree.climb(n, "id", "parent"), lambda n: tree.ancestors(n, "id", "parent")):
            with pytest.raises(tree.Circle, match="circle"):
                walk(nodes)


@pytest.mark.parametrize("ranges", [1, 7])
def test_layout_of_a_large_tree(spark, monkeypatch, ranges):
    """One tree with a node of very many children: the same layout however many ranges its siblings fall in."""
    random.seed(8)
    parents = {0: None} | {i: 0 if i < 3000 else random.randrange(3000, i) if i % 3 and i > 3000 else random.randrange(1, 3000) for i in range(1, 6000)}
    nodes = forest(spark, parents).repartition(4)
    monkeypatch.setattr(scan, "ROWS_IN_ORDER", 6000 // ranges)
    got = {r["id"]: (r["start"], r["end"], r["width"]) for r in tree.token_layout(nodes, "id", "parent", "own", [F.desc("own")]).collect()}
    kids = {}
    for i, p in parents.items():
        kids.setdefault(p, []).append(i)
    own = {i: (7 * i + 3) % 11 for i in parents}
    width = {}
    for i in sorted(parents, reverse=True):
        width[i] = max(1, own[i] + sum(width[k] for k in kids.get(i, [])))
    expected, todo = {}, [(0, 0)]
    while todo:
        i, at = todo.pop()
        expected[i] = (at, at + width[i], width[i])
        for k in sorted(kids.get(i, []), key=lambda k: (-own[k], k)):
            todo.append((k, at))
            at += width[k]
    assert got == expected


def test_layout_numbers_in_post_order(spark):
    parents = {0: None, 1: 0, 2: 0, 3: 1, 4: 1, 5: 2}
    nodes = forest(spark, parents).withColumn("own", F.lit(1).cast("long"))
    assert {r["id"]: r["end"] for r in tree.token_layout(nodes, "id", "parent", "own", ["id"]).collect()} == {3: 1, 4: 2, 1: 3, 5: 4, 2: 5, 0: 6}


@pytest.mark.parametrize("rows_in_order", [10, 1_000_000])
def test_running_sum(spark, monkeypatch, rows_in_order):
    monkeypatch.setattr(scan, "ROWS_IN_ORDER", rows_in_order)
    rows = [("hot", i, i % 5) for i in range(300)] + [("b", i, 1) for i in range(20)] + [(None, i, 2) for i in range(30)] + [("one", 1, None)]
    random.seed(1)
    random.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, i long, v long").repartition(3)
    got = {(r["k"], r["i"]): r["before"] for r in scan.running_sum(df, F.col("v"), ["i"], ["k"]).collect()}
    assert got == {(k, i): sum(w or 0 for q, j, w in rows if q == k and j < i) for k, i, _ in rows}
    over_all = {(r["k"], r["i"]): r["before"] for r in scan.running_sum(df.filter("k is not null"), F.col("v"), ["k", F.desc("i")]).collect()}
    flat = sorted(((k, -i, v or 0) for k, i, v in rows if k is not None))
    assert over_all == {(k, -i): sum(x[2] for x in flat[:n]) for n, (k, i, _) in enumerate(flat)}


def test_places_of_very_uneven_amounts(spark, monkeypatch):
    """One amount of 10^8 times the rest: no range over a few times its share, and places as if sorted in one piece."""
    monkeypatch.setattr(scan, "ROWS_IN_ORDER", 500)
    rows = [(0, 10**12)] + [(i, 100 + i % 700) for i in range(1, 5000)] + [(9000, None)]
    df = spark.createDataFrame(rows, "id long, v long").repartition(4)
    got = {r["id"]: r["place"] for r in ledger.placed_by(df, "v", "id").collect()}
    ordered = sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))
    assert got == {i: n for n, (i, _) in enumerate(ordered, 1)}
    dealt = df.repartitionByRange(11, F.desc("v"), "id").groupBy(F.spark_partition_id()).count().collect()
    assert max(r["count"] for r in dealt) <= 3 * len(rows) / 11


def test_violations_of_one_hot_identity(spark):
    """Nearly all sites of one identity are violated: the first five and the whole count, ranked in many tasks."""
    claims = spark.range(300_000).select(F.when(F.col("id") % 1000 == 0, "b").otherwise("a").alias("identity"), F.format_string("s%06d", "id").alias("session"), F.lit("x").alias("site"), F.col("id").alias("lhs"), F.lit(7).cast("long").alias("rhs"))
    got = {(r["identity"], r["n"]): (r["session"], r["count"], r["delta"]) for r in audit.violations(claims).collect()}
    assert got[("a", 1)] == ("s000001", 299_699, -6) and got[("a", 5)] == ("s000005", 299_699, -2) and got[("b", 5)] == ("s004000", 300, 3993) and len(got) == 10


def test_rollup_is_quick(spark):
    nodes = forest(spark, {i: i // 4 if i else None for i in range(20_000)})
    nodes.count()
    tree.rollup(nodes, "id", "parent", measures()).count()
    began = time.time()
    tree.rollup(nodes, "id", "parent", measures()).count()
    assert time.time() - began < 30


def test_tables_of_nodes_are_not_broadcast(spark):
    """What passes through the driver does not grow with the nodes: only rounds of few rows are sent to all tasks."""
    nodes = forest(spark, {i: i // 3 if i else None for i in range(50)})
    plan = tree.token_layout(nodes, "id", "parent", "own", ["id"])._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
    big, small = nodes.hint("merge"), tree._sized(nodes, tree.FEW)
    for rows, kind in ((tree._sized(nodes, tree.FEW + 1), "merge"), (small, "broadcast")):
        assert f"strategy={kind}" in (rows._jdf.queryExecution().logical().toString() + rows.join(big, "id")._jdf.queryExecution().analyzed().toString()).lower()
