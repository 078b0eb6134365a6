"""Operators against hand-derived figures, and the registered queries against their SQL."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tracemill.functions import tokens as T
from tracemill.operators import audit, fit, joins, ledger, rules, sequence, tree
from tracemill.plans.queries import QUERIES
from tracemill.plans import corpus, corpus_sql  # noqa: F401  corpus registers its queries
from tracemill.plans.sql import SQL


def calls(spark, rows):
    return spark.createDataFrame([("c", i, cc, cr, i * 1000) for i, (cc, cr) in enumerate(rows)], "conv string, i long, cache_creation long, cache_read long, ts long")


def test_warm_open_predicts_exactly(spark):
    c = sequence.with_epochs(calls(spark, [(1000, 50000), (300, 51000), (400, 51300)]), ["conv"], "i").orderBy("i").collect()
    assert [(r["epoch"], r["expected"], r["delta"]) for r in c] == [(0, 50000, 0), (0, 51000, 0), (0, 51300, 0)]


def test_second_epoch(spark):
    c = sequence.with_epochs(calls(spark, [(1000, 0), (500, 1000), (300, 200), (100, 500)]), ["conv"], "i")
    e = sequence.epoch_table(c, ["conv"], "i", "ts").orderBy("epoch").collect()
    assert [(r["start_call"], r["end_call"], r["rewritten"], r["gap"]) for r in e] == [(0, 1, 0, 0), (2, 3, 300, 1000)]
    rows = c.orderBy("i").collect()
    assert rows[3]["expected"] == 500 and not rows[2]["predictable"]


def test_placeholder_tail_keeps_the_snapshot(spark):
    lines = spark.createDataFrame([("c", "r", 0, 278, 2), ("c", "r", 1, 0, 0)], "conv string, r string, n long, output long, input long")
    g = sequence.request_groups(lines, ["conv"], "r", "n", "output", ["output", "input"]).first()
    assert (g["output"], g["input"], g["last_output"], g["line_count"], g["output_varies"]) == (278, 2, 0, 2, True)


def test_lifetimes_match_the_definition(spark):
    epochs = [(0, 0, 3), (1, 4, 4), (2, 5, 9)]
    e = spark.createDataFrame([("c", *x) for x in epochs], "conv string, epoch long, start_call long, end_call long")
    a = spark.createDataFrame([("c", b, 10) for b in range(12)], "conv string, born long, tokens long")
    for r in joins.lifetimes(a, e, ["conv"], "born", "tokens").collect():
        lives = [(max(s, r["born"]), t) for _, s, t in epochs if t >= r["born"]]
        assert (r["writes"], r["reads"]) == (len(lives), sum(t - s for s, t in lives))
        assert r["total"] == pytest.approx(10 * (1.25 * r["writes"] + 0.1 * r["reads"]))


def test_as_of_takes_the_last_at_or_before_and_the_default(spark):
    left = spark.createDataFrame([("a", 5, "x"), ("a", 1, "y"), ("b", 9, "z"), (None, 3, "n")], "k string, t long, name string")
    right = spark.createDataFrame([("a", 2, 20), ("a", 5, 50), ("a", 5, 51), ("a", 6, 60)], "k string, at long, v long")
    got = {r["name"]: r["v"] for r in joins.as_of(left, right, ["k"], "t", "at", "v", 0).collect()}
    assert got == {"x": 51, "y": 0, "z": 0, "n": 0}


def test_rates_by_instant_and_unknown_models(spark):
    card = spark.createDataFrame([("m", None, 100, 2.0, 10.0), ("m", 100, None, 3.0, 15.0)], "model string, valid_from long, valid_to long, in_rate double, out_rate double")
    items = spark.createDataFrame([("m-20250101", 99), ("m", 100), ("p/m", 5)], "model string, ts long")
    assert {(r["ts"], r["in_rate"]) for r in joins.at_rates(items, card, T.canonical_model("model"), "ts").collect()} == {(99, 2.0), (100, 3.0), (5, None)}


def test_fit_recovers_a_known_tokenizer(spark):
    rows = [("m", f"t{i % 8}", 200 + 37 * i % 4000, 1 + i % 4) for i in range(400)]
    pts = spark.createDataFrame([(*r, round(r[2] / 2.6 + 50 * r[3])) for r in rows] + [("thin", "t0", 10, 1, 5)] * 10, "model string, transcript string, chars long, blocks long, output long")
    got = fit.fit_tokenizers(pts).collect()
    assert len(got) == 1 and got[0]["chars_per_token"] == pytest.approx(2.6, rel=0.01) and got[0]["tokens_per_block"] == pytest.approx(50, rel=0.02) and abs(got[0]["held_out_error"]) < 0.01


def test_token_layout_matches_the_recursion(spark):
    import random

    random.seed(3)
    nodes = {0: (None, 4)} | {i: (random.randrange(i), random.choice([0, 0, 3, 7])) for i in range(1, 40)}
    kids = {i: [k for k, (p, _) in nodes.items() if p == i] for i in nodes}

    def width(i):
        return max(1, nodes[i][1] + sum(map(width, kids[i])))

    expected = {}

    def lay(i, at):
        expected[i] = (at, at + width(i))
        for k in kids[i]:
            lay(k, at)
            at += width(k)

    lay(0, 0)
    n = spark.createDataFrame([(i, p, w) for i, (p, w) in nodes.items()], "id long, parent long, own long")
    assert {r["id"]: (r["start"], r["end"]) for r in tree.token_layout(n, "id", "parent", "own", ["id"]).collect()} == expected


def test_deep_chains_and_cycles(spark):
    n = spark.createDataFrame([(i, i - 1 if i else None) for i in range(200)], "id long, parent long")
    up = tree.ancestors(n, "id", "parent")
    assert sorted((r["id"], r["ancestor"], r["distance"]) for r in up.collect()) == [(i, j, i - j) for i in range(200) for j in range(i + 1)]
    with pytest.raises(ValueError, match="circle"):
        tree.ancestors(spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 1)], "id long, parent long"), "id", "parent")


def test_ambiguous_fork_is_an_orphan(spark):
    c = spark.createDataFrame([("s", a, "t", "", d, 5) for a, d in (("x", 1), ("y", 1), ("z", 2))], "session_id string, agent_id string, agent_type string, tool_use_id string, declared_depth int, first_ts long")
    uses = spark.createDataFrame([], "session_id string, conv_id string, tool_use_id string, call_index int")
    times = spark.createDataFrame([("s", "", 0, 1), ("s", "", 1, 9)], "session_id string, conv_id string, call_index long, ts long")
    rows = {r["agent_id"]: r for r in tree.resolve_spawns(c, uses, times).collect()}
    assert rows["x"]["parent_agent"] == rows["y"]["parent_agent"] == "" and rows["z"]["parent_agent"] is None and "found 2" in rows["z"]["why"]


def test_audit_keeps_identities_without_sites_and_breaks(spark):
    claims = spark.createDataFrame([("cache-creation-accounted", "s", "x", 5, 0)], "identity string, session string, site string, lhs long, rhs long")
    rows = {r["identity"]: (r["sites"], r["held"]) for r in audit.audits(claims).collect()}
    assert rows["cache-creation-accounted"] == (1, False) and rows["tree-holds-every-token"] == (0, True) and len(rows) == 5
    assert audit.violations(claims).first()["delta"] == 5
    with pytest.raises(KeyError):
        audit.rate_of("no such")


def test_empty_and_zero_ledgers(spark):
    none = spark.createDataFrame([], "model string, v long")
    assert ledger.ledger(none, F.col("model"), F.col("v")).count() == 0
    zero = spark.createDataFrame([("m", 0)], "model string, v long")
    assert ledger.ledger(zero, F.col("model"), F.col("v")).first()["share"] == 0.0


@pytest.mark.parametrize(
    "text,kind",
    [("<bash-input>ls</bash-input>", "harness"), ("<bash-stdout>x", "harness"), ("hello", "user"), ("<command-message>x</command-message><command-name>/next</command-name>", "command"), ("[Image: a]", "harness")],
)
def test_turn_origin(spark, text, kind):
    assert spark.range(1).select(rules.turn_origin(F.lit(text))["kind"]).first()[0] == kind


def test_scalars(spark):
    row = spark.range(1).select(
        T.leaf_name(F.lit("C:\\a\\b\\my-project")), T.leaf_name(F.lit("/")), T.tsv_row(F.lit("a\tb\r\n"), F.lit(None)), T.half_up(F.lit(-2.5)), T.utf16_length(F.lit("a😀")),
        T.program_text(F.lit("lit new --d \"run pytest\" <<'EOF'\npytest\nEOF\ngit x")),
    ).first()
    assert tuple(row)[:5] == ("my-project", None, "a b  \t", -2, 3) and "pytest" not in row[5] and "git x" in row[5]


duckdb = pytest.importorskip("duckdb")


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.sql(f"create view {t} as select * from '/root/testdata/sf0.001/{t}.parquet'")
    return con


def rounded(v):
    return round(v, 4) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, oracle, name):
    df = QUERIES[name](spark, "/root/testdata/sf0.001")
    cols = sorted(df.columns)
    got = sorted((tuple(rounded(r[c]) for c in cols) for r in df.collect()), key=repr)
    cursor = oracle.execute(SQL[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == cols
    assert got == sorted((tuple(rounded(r[names.index(c)]) for c in cols) for r in cursor.fetchall()), key=repr)


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL) | set(corpus_sql.SQL)


def test_dollars_beside_a_half_round_as_in_sql(spark):
    """Twentieths of a micro-dollar that stand for a half lie just beside it as doubles; both engines take the double as it is."""
    duckdb = pytest.importorskip("duckdb")
    x = spark.range(10, 4_000_000, 20).select((F.col("id") / 20_000_000).alias("x"))
    got = [r[0] for r in x.select(T.rounded(F.col("x"), 6)).collect()]
    by_text = [r[0] for r in x.select(F.round("x", 6)).collect()]
    con = duckdb.connect()
    expected = [r[0] for r in con.execute("select round(w / 20000000.0::DOUBLE, 6) from range(10, 4000000, 20) t(w) order by w").fetchall()]
    assert got == expected and by_text != expected
