"""The queries over a written transcript corpus against SQL over the tables it was made of."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from tracemill.operators import fit
from tracemill.plans import corpus, corpus_sql, queries, report, session
from tracemill.plans.sql import SQL
from tracemill.sources.writer import pack_files

D = "/root/testdata/sf0.001"


def same(df, sql):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in os.listdir(D):
        con.sql(f"create view {t.removesuffix('.parquet')} as select * from '{D}/{t}'")
    cursor = con.execute(sql)
    names = [c[0] for c in cursor.description]
    cols = sorted(df.columns)
    expected = sorted((tuple(r[names.index(c)] for c in cols) for r in cursor.fetchall()), key=repr)
    assert sorted(names) == cols and expected
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr) == expected


@pytest.mark.parametrize("name", sorted(corpus_sql.SQL))
def test_query_equals_its_sql(spark, name):
    assert same(queries.QUERIES[name](spark, D), corpus_sql.SQL[name])


def test_corpus_is_made_once_for_an_input(spark):
    assert corpus.analysed(spark, D)[0] == corpus.analysed(spark, D)[0]


@pytest.mark.parametrize("name", ["output_totals", "output_ledger"])
def test_a_wrong_split_is_noticed(spark, monkeypatch, name):
    """The rows of output by part depend on what is visible."""
    right = fit.split_output

    def wrong(calls, tokenizers):
        return right(calls, tokenizers).withColumn("visible", F.col("visible") * 0)

    monkeypatch.setattr(fit, "split_output", wrong)
    assert not same(queries.QUERIES[name](spark, D), SQL[name])


def test_a_lost_tool_or_lineage_is_noticed(spark, monkeypatch):
    a = corpus.analysed(spark, D)[1]
    rows = report.call_rows(a).filter("depth < 2")
    monkeypatch.setattr(report, "call_rows", lambda _: rows)
    assert not same(queries.QUERIES["trace_ledgers"](spark, D), corpus_sql.SQL["trace_ledgers"])
    assert not same(queries.QUERIES["trace_sessions"](spark, D), corpus_sql.SQL["trace_sessions"])


def test_notes_come_in_order_for_the_export(spark):
    cards = {r["session_id"]: r for r in report.session_cards(corpus.analysed(spark, D)[1]).collect()}
    assert len(cards) == 20 and all(" calls (" in r["notes"][0] and " tools have a result" in r["notes"][1] for r in cards.values())
    assert any(n.startswith("orphan ") for r in cards.values() for n in r["notes"])


def test_lines_written_after_they_are_put_in_order_are_the_same(spark):
    """Short rows are numbered first and their texts made afterwards; no text passes the shuffle."""
    late = pack_files(*corpus.unwritten(spark, D)).lines
    lines = pack_files(corpus.corpus_lines(spark, D)).lines.select(late.columns)
    assert late.count() == lines.count() > 1000 and late.exceptAll(lines).isEmpty()
    rows, _ = corpus.unwritten(spark, D)
    assert "value" not in rows.columns


def shuffles(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_calls_and_lines_seen_are_dealt_once(spark):
    records = corpus.analysed(spark, D)[1].records
    assert shuffles(session.calls_of(records)) == 1
    assert shuffles(session.seen_of(records)) == 1


def broadcasts(node):
    """Rows of each table that a plan that has run broadcast."""
    kind = node.nodeName().split(" ")[0]
    if kind == "AdaptiveSparkPlan":
        return broadcasts(node.executedPlan())
    if kind.endswith("QueryStage"):
        return broadcasts(node.plan())
    below = [n for i in range(node.children().size()) for n in broadcasts(node.children().apply(i))]
    return [*below, node.metrics().apply("numOutputRows").value()] if kind == "BroadcastExchange" else below


def rows_sent(df):
    df.collect()
    return broadcasts(df._jdf.queryExecution().executedPlan())


def test_labels_are_not_broadcast_because_their_files_are_small(spark):
    """Labels have a row for each call and are packed to a few bytes a row; what is broadcast depends on the rows themselves."""
    packed, done = corpus.analysed(spark, D)
    tables = {name: getattr(done, name) for name in ("calls", "forest", "labels", "tools", "files", "sessions", "records", "spans", "turns")}
    names = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    before, limit = [spark.conf.get(n, None) for n in names], 20_000
    try:
        spark.conf.set(names[0], str(limit))
        spark.conf.set(names[0], "40000")
        spark.conf.unset(names[1])
        a = session.analyze(spark, packed)
        vars(a).update(tables)
        # A row of a key and another column has 24 bytes at least.
        assert a.labels.count() > limit / 24
        for df in (report.call_rows(a), report.ledgers(report.call_rows(a)), report.session_list(a, corpus._rates(spark)), session.spans_of(a.calls, a.tools, a.turns, a.forest, a.labels)):
            assert max(rows_sent(df), default=0) <= limit / 24
    finally:
        for name, value in zip(names, before):
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def test_joins_behind_the_five_ledgers_run_once(spark):
    a = corpus.analysed(spark, D)[1]
    plan = report.ledgers(report.call_rows(a))._jdf.queryExecution().optimizedPlan().toString()
    assert "/call-rows-" in "".join(report.ledgers(report.call_rows(a)).inputFiles()) and "labels-" not in plan and plan.count("Join LeftOuter") == 0
