"""Reading transcripts: both line readers on any line, files in byte ranges, scope by file metadata."""

from __future__ import annotations

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from tracemill.plans import session
from tracemill.sources import transcripts, writer

LINES = "session_id string, conv_id string, project string, line_no long, value string"
TEXTS = ["", "x", "é😀", "a\nb", "tab\t", 'q"uote', " ", "long " * 60, "\x01\x7f", "</x>", "5"]
PLAIN_TIMES = ["2026-08-01T10:00:01.123Z", "2026-08-01T10:00:01Z", "2026-08-01T10:00:01.123456+05:30", "2026-13-01T10:00:01Z", "2026-02-30T10:00:01Z", "0001-01-01T00:00:00Z", "2026-08-01T10:00:01.001Z"]
ODD_TIMES = ["2026-08-01", "20260801T10", "x", "2026-08-01 10:00:00", "2026-08-01T24:00:00Z", "1969-12-31T23:59:59.9995Z"]


class Lines:
    """Random lines near the shapes that are read, with members of any other type in their place."""

    def __init__(self, seed: int, odd: bool):
        self.r, self.odd = random.Random(seed), odd

    def value(self, depth: int = 0) -> object:
        r = self.r
        whole = [0, 1, -7, 123_456_789] + ([10**17, 10**25, 2**63] if self.odd else [])
        real = [1.5, 1e300, -0.0, 2.0, 1e21, 1e-7] if self.odd else [3]
        kinds = [lambda: None, lambda: r.choice([True, False]), lambda: r.choice(whole), lambda: r.choice(real), lambda: r.choice(TEXTS), lambda: r.choice(TEXTS)]
        if depth < 3:
            kinds += [lambda: [self.value(depth + 1) for _ in range(r.randrange(3))], lambda: {r.choice(["a", "type", "text", "é\n"]): self.value(depth + 1) for _ in range(r.randrange(4))}]
        return r.choice(kinds)()

    def some(self, x: object) -> object:
        return x if self.r.random() < 0.8 else self.value()

    def block(self) -> object:
        kind = self.r.choice(["thinking", "text", "tool_use", "tool_result", "image", None, "", 5])
        block = {"type": kind} | {m: self.value() for m in ("thinking", "text", "id", "name", "input", "content", "tool_use_id") if self.r.random() < 0.6}
        if kind == "tool_use" and self.r.random() < 0.7:
            block["input"] = {self.r.choice(["command", "file_path", "pattern", "prompt", "zz"]): self.some(self.r.choice(TEXTS)) for _ in range(3)}
        return self.some(block)

    def line(self) -> str:
        r, some = self.r, self.some
        o: object = {"type": r.choice(["assistant", "user", "attachment", "system", "summary", "novel", None, "", 7]), "uuid": some("u"), "timestamp": r.choice(PLAIN_TIMES + (ODD_TIMES if self.odd else []) + [None, 5, {}]), "cwd": some("/w"), "requestId": some("")}
        usage = {m: some(r.randrange(10**6)) for m in ("input_tokens", "cache_creation_input_tokens", "cache_read_input_tokens", "output_tokens") if r.random() < 0.8}
        if r.random() < 0.6:
            usage["cache_creation"] = some({k: some(r.randrange(999)) for k in "abc" if r.random() < 0.6})
        content = r.choice([[self.block() for _ in range(r.randrange(4))], r.choice(TEXTS)])
        o |= {"message": some({"model": some("m-1"), "id": some("msg"), "usage": some(usage), "content": some(content)}), "toolUseResult": r.choice([self.value(), {"agentId": self.value()}])}
        o |= {"attachment": some({"type": some("f"), "x": self.value()}), "subtype": self.value(), "durationMs": self.value()}
        text = json.dumps(some(o) if r.random() < 0.1 else o, ensure_ascii=self.odd and r.random() < 0.3)
        if r.random() < 0.1:
            text = r.choice([text[:-1], text + " x", text + ' {"a":1}', text + ',{"a":1}', text + "],[1", text + "\r", text + ',"end of line"', text.replace(":", ": "), '{"a":1,"a":2}'])
        return text


ODD = ['NaN', '{"a":NaN}', "[1,2]", '"s"', "5", "null", "true", "{}", "[]", "﻿{}", '{"type":"assistant"}', '{"type":"user","message":{"content":"hi"}}', "[1],[2", '1],["end of line"', "-0",
       '{"type":"user","uuid":"\\ud800"}', "[" * 3000 + "]" * 3000, '{"type":"system","durationMs":5e0}', '{"type":"summary"} ', '{"type":"assistant","message":{"content":[null,[1],5,"x",{"type":"text","text":"\\u00e9"}]}}']


@pytest.mark.parametrize(("odd", "fewest"), [(False, 1000), (True, 100)])
def test_both_readers_agree_on_any_line(spark, odd, fewest):
    """The JVM reader gives what the line parser gives, and reads the most lines itself where they are plain."""
    make = Lines(5, odd)
    lines = [make.line() for _ in range(1500)] + ODD + [" ", ""]
    table = spark.createDataFrame([("s", "", "p", i, x) for i, x in enumerate(lines)], LINES).repartition(4)
    got = {r["line_no"]: r.asDict(recursive=True) for r in transcripts.parse_lines(table).collect()}
    assert got == {i: transcripts.parse_line(x) | {"session_id": "s", "conv_id": "", "project": "p", "line_no": i} for i, x in enumerate(lines) if x.strip()}
    assert transcripts._decoded(table).filter(~F.col("odd")).count() > fewest
    assert transcripts.parse_lines(table.limit(0)).count() == 0


def test_a_large_file_is_read_in_ranges(spark, tmp_path):
    """Line numbers and records of one file of many ranges equal those of the whole text, blank lines and a last line without a break included."""
    (tmp_path / "p" / "s1" / "subagents").mkdir(parents=True)
    make = Lines(9, False)
    lines = [make.line().replace("\r", " ") if i % 17 else ["", " ", "\r", "{bad"][i // 17 % 4] for i in range(6000)]
    (tmp_path / "p" / "s1.jsonl").write_text("\n".join(lines))
    (tmp_path / "p" / "s2.jsonl").write_text("\n".join(lines[:3]) + "\n")
    (tmp_path / "p" / "empty.jsonl").write_text("")
    (tmp_path / "p" / "s1" / "subagents" / "agent-a.jsonl").write_text("\n".join(lines[:5]))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", 200_000)
    try:
        read = transcripts.read_lines(spark, str(tmp_path))
        got = {(r["session_id"], r["conv_id"], r["line_no"]): r["value"] for r in read.collect()}
        whole = {("s1", "", i): x for i, x in enumerate(lines)} | {("s2", "", i): x for i, x in enumerate(lines[:3])} | {("s1", "a", i): x for i, x in enumerate(lines[:5])}
        assert got == whole
        ranges = spark.read.text(f"{tmp_path}/p/s1.jsonl").select(F.spark_partition_id().alias("t")).distinct().count()
        assert ranges > 5, "several tasks"
        records = {r["line_no"]: r.asDict(recursive=True) for r in transcripts.parse_lines(read.filter("session_id = 's1' and conv_id = ''")).collect()}
        assert records == {i: transcripts.parse_line(x) | {"session_id": "s1", "conv_id": "", "project": "p", "line_no": i} for i, x in enumerate(lines) if x.strip()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


@pytest.mark.parametrize("odd", [False, True])
def test_the_reader_in_the_jvm_agrees(spark, odd):
    make = Lines(6, odd)
    lines = [make.line() for _ in range(500)] + ODD
    table = spark.createDataFrame([("s", "", "p", i, x) for i, x in enumerate(lines)], LINES).repartition(4)
    by = [{r["line_no"]: r.asDict(recursive=True) for r in transcripts.parse_lines(table, in_jvm=j).collect()} for j in (False, True)]
    assert by[0] == by[1] and len(by[0]) == sum(bool(x.strip()) for x in lines)


def test_a_packed_corpus_reads_as_its_files_do(spark, tmp_path):
    """Files, lines, sidecars and picked sessions of a packed corpus are those of the same lines written to a file each."""
    rows = [(f"p-{i % 3}/s{i}.jsonl", 10 * k, json.dumps({"type": "user", "uuid": f"{i}-{k}é"})) for i in range(5) for k in range(i % 3 + 1)]
    rows += [("p-1/s1/subagents/agent-a.jsonl", 0, "{}"), ("p-1/s1/subagents/agent-a.meta.json", 0, '{"agentType":"x",'), ("p-1/s1/subagents/agent-a.meta.json", 1, '"spawnDepth":2}'), ("p-2/s2/subagents/agent-b.meta.json", 0, "{}")]
    lines = spark.createDataFrame(rows, "path string, place long, value string").repartition(3)
    root = (tmp_path / "files").as_uri()
    writer.write_files(lines, root)
    packed = writer.pack_files(lines)
    every = lambda df, *cols: sorted(map(tuple, df.select(*cols).collect()), key=repr)
    names = ("project", "session_id", "conv_id", "half", "bytes")
    assert every(transcripts.discover(spark, packed), *names) == every(transcripts.discover(spark, root), *names)
    picked, said = transcripts.in_scope(transcripts.sessions_of(packed.files), has_spawns=True)
    assert [r["session_id"] for r in picked.collect()] == ["s1"] and said == ["has spawned work: excluded 4 of 5"]
    paths = transcripts.picked_paths(transcripts.discover(spark, root), picked)
    for source, files in ((packed, None), (packed.picked(picked), paths)):
        names = ("project", "session_id", "conv_id", "line_no", "value")
        assert every(transcripts.read_lines(spark, source), *names) == every(transcripts.read_lines(spark, root, files), *names)
        assert every(transcripts.read_spawn_meta(spark, source), "*") == every(transcripts.read_spawn_meta(spark, root, files), "*") != []


def test_a_query_makes_only_the_tables_it_needs(spark):
    """Counting the lines of each type waits for no forest and no spans; before, every query waited for all tables and a file for each conversation."""
    lines = spark.createDataFrame([("p/s1.jsonl", i, json.dumps({"type": "user", "message": {"content": "hi"}})) for i in range(3)], "path string, place long, value string")
    a = session.analyze(spark, writer.pack_files(lines))
    assert transcripts.parse_stats(a.records).first()["lines"] == 3 and len(a.made()) == 1
    assert a.turns.count() == 3 and "spans" not in vars(a) and "forest" not in vars(a)


@pytest.fixture
def corpus(tmp_path):
    for i, (project, name) in enumerate([("alpha", "s1"), ("alpha", "s2"), ("beta", "t1"), ("beta", "s9")]):
        (tmp_path / project).mkdir(exist_ok=True)
        path = tmp_path / project / f"{name}.jsonl"
        path.write_text('{"type":"summary"}\n')
        os.utime(path, (1_750_000_000 + 86_400 * i,) * 2)
    sub = tmp_path / "alpha" / "s2" / "subagents"
    sub.mkdir(parents=True)
    for name in ("agent-a.jsonl", "agent-a.meta.json", "agent-b.jsonl", "agent-c.meta.json", "notes.txt"):
        (sub / name).write_text("{}")
    return str(tmp_path)


def test_discovery_pairs_files_without_opening_them(spark, corpus):
    sessions = {r["session_id"]: r for r in transcripts.sessions_of(transcripts.discover(spark, corpus)).collect()}
    assert {k: (r["project"], r["spawns"], r["bytes"]) for k, r in sessions.items()} == {"s1": ("alpha", 0, 19), "s2": ("alpha", 1, 19), "t1": ("beta", 0, 19), "s9": ("beta", 0, 19)}
    assert sessions["s2"]["unpaired"] == ["b: transcript present, meta missing", "c: meta present, transcript missing"] and sessions["s1"]["unpaired"] == []
    assert transcripts.discover(spark, corpus + "/nowhere").count() == 0
    plan = transcripts.discover(spark, corpus)._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan, "only metadata columns are read"


def test_scope_counts_what_each_filter_leaves_out(spark, corpus):
    sessions = transcripts.sessions_of(transcripts.discover(spark, corpus))
    kept, said = transcripts.in_scope(sessions, project="a$", prefix="s", since="2025-06-16", limit=1)
    assert [r["session_id"] for r in kept.collect()] == ["s9"]
    assert said == ["project matches a$: excluded 0 of 4", "session begins with s: excluded 1 of 4", "modified since 2025-06-16: excluded 1 of 3", "the 1 modified last: 1 eligible sessions left out"]
    kept, said = transcripts.in_scope(sessions, has_spawns=True)
    assert [r["session_id"] for r in kept.collect()] == ["s2"] and said == ["has spawned work: excluded 3 of 4"]
    kept, said = transcripts.in_scope(sessions)
    assert kept.count() == 4 and said == []


def test_only_picked_files_are_read(spark, corpus):
    """A file that nobody may read does no harm while it is not picked."""
    files = transcripts.discover(spark, corpus)
    kept, _ = transcripts.in_scope(transcripts.sessions_of(files), project="alpha")
    paths = transcripts.picked_paths(files, kept)
    os.remove(f"{corpus}/beta/t1.jsonl")  # gone since it was listed
    assert [len(paths[k]) for k in ("own", "agents", "metas")] == [2, 2, 2]
    assert {(r["session_id"], r["conv_id"]) for r in transcripts.read_lines(spark, corpus, paths).collect()} == {("s1", ""), ("s2", ""), ("s2", "a"), ("s2", "b")}
    assert transcripts.read_spawn_meta(spark, corpus, paths).count() == 2
    none = {"own": [], "agents": [], "metas": []}
    assert transcripts.read_lines(spark, corpus, none).count() == transcripts.read_spawn_meta(spark, corpus, none).count() == 0


def test_columns_of_lines_are_those_of_their_records():
    """Lines are read into columns; blocks of unread kinds, of a line that fails midway and of none keep their places."""
    make = Lines(11, True)
    for raw in [make.line() for _ in range(800)] + ODD:
        read, record = transcripts.columns_of(raw), transcripts.parse_line(raw)
        assert len(read) == len(transcripts._READ_COLUMNS) and list(record) == transcripts._COLUMNS
        blocks = read[transcripts._BLOCKS]
        assert (blocks is None) == (record["blocks"] is None)
        assert [tuple(b) for b in blocks or []] == [tuple(b.values()) for b in record["blocks"] or []]
        assert {c: v for c, v in zip(transcripts._COLUMNS, read) if c != "blocks"} == {c: v for c, v in record.items() if c != "blocks"}


def test_lengths_are_those_of_compact_json():
    make = Lines(12, False)
    for v in [make.value() for _ in range(2000)] + [True, False, 10**30, {"a": [None, True, {"b": False}]}, {"k\n é": '"\\'}]:
        text = json.dumps(v, ensure_ascii=False, separators=(",", ":"))
        assert transcripts.json_length(v) == (0 if v is None else transcripts.utf16(v if isinstance(v, str) else text))


def test_instants_are_whole_milliseconds_rounded_down():
    from datetime import datetime, timedelta, timezone

    for raw in [t for t in PLAIN_TIMES + ODD_TIMES + ["9999-12-31T23:59:59-23:59", "1969-12-31T23:59:59.0005-05:30"]] * 2:
        try:
            t = datetime.fromisoformat(raw)
            expected = ((t if t.tzinfo else t.replace(tzinfo=timezone.utc)) - datetime(1970, 1, 1, tzinfo=timezone.utc)) // timedelta(milliseconds=1)
        except (ValueError, OverflowError):
            expected = 0
        assert transcripts.instant(raw) == expected
    assert [transcripts.instant(x) for x in (None, 5, {}, [])] == [0, 0, 0, 0]
