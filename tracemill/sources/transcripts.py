"""Reading session transcripts: JSONL files of sessions and of the agents they spawn."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass
from datetime import datetime, timezone
from functools import lru_cache
from itertools import accumulate
from json.encoder import encode_basestring

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracemill.functions.tokens import INPUT_CAP, SNIPPET_LENGTH
from tracemill.operators.ledger import excluded_counts

#: Line types that are known and carry nothing to count.
META_TYPES = frozenset(
    "mode permission-mode last-prompt ai-title bridge-session file-history-snapshot file-history-delta queue-operation pr-link worktree-state"
    " relocated frame-link summary auto-mode date_change agent-name agent-setting".split()
)
#: The members of a tool's input that say what it does, in order.
INPUT_MEMBERS = ("command", "file_path", "pattern", "query", "description", "prompt", "skill")

BLOCK = "struct<kind:string,chars:long,snippet:string,id:string,name:string,input_chars:long,input:string,tool_use_id:string,type:string>"
RECORD = (
    "session_id string, conv_id string, project string, line_no long, kind string, type string, uuid string, ts_ms long, request_id string, model string,"
    f" input long, cache_creation long, cache_read long, output long, cc_flat long, blocks array<{BLOCK}>, agent_id string, is_tool_result boolean,"
    " snippet string, attachment_type string, chars long, subtype string, duration_ms long, cwd string"
)
_COLUMNS = [c.strip().split(" ")[0] for c in re.sub(r"<.*>", "", RECORD).split(",")]


def _arrow_types() -> dict[str, pa.DataType]:
    """The columns of ``RECORD`` as Arrow types."""
    plain = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_()}
    block = pa.struct([(name, plain[of]) for name, of in (f.split(":") for f in BLOCK.removeprefix("struct<").removesuffix(">").split(","))])
    kinds = dict(c.split(" ") for c in re.sub(r"array<.*>", "blocks", RECORD).replace(", ", ",").strip().split(","))
    return {c: pa.list_(block) if of == "blocks" else plain[of] for c, of in kinds.items()}


def corpus_root(explicit: str | None = None, env: Mapping[str, str] = os.environ) -> str:
    """The folder of projects: as given, else under the home folder; without either an error."""
    if explicit:
        return explicit
    home = env.get("HOME") or env.get("USERPROFILE")
    if not home:
        raise ValueError("no corpus root: pass one, or set HOME")
    return f"{home}/.claude/projects"


_EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)


# --- one line -------------------------------------------------------------


def utf16(s: str) -> int:
    return len(s) if s.isascii() else len(s.encode("utf-16-le", "surrogatepass")) // 2


def _number(x: float) -> str:
    if x in (float("inf"), float("-inf")):
        return "null"
    return str(int(x)) if x == int(x) and abs(x) < 1e21 else repr(x)


def json_length(value: object) -> int:
    """Length in UTF-16 units of the compact JSON text; a string counts without quotes, nothing as 0."""
    if value is None:
        return 0
    if isinstance(value, str):
        return utf16(value)

    def text(v: object) -> str:
        if isinstance(v, str):
            return encode_basestring(v)
        if isinstance(v, dict):
            return "{" + ",".join([f"{encode_basestring(k)}:{text(x)}" for k, x in v.items()]) + "}"
        if isinstance(v, list):
            return "[" + ",".join(map(text, v)) + "]"
        if isinstance(v, float):
            return _number(v)
        return "null" if v is None else "true" if v is True else "false" if v is False else str(v)

    return utf16(text(value))


def steps(fields: tuple, columns: Sequence[str]) -> tuple:
    """Fields (column, dotted path, reader) by the object that holds them: its path, and of each field its place among ``columns``, its name there and its reader."""
    found: dict[tuple, list] = {}
    for c, path, read in fields:
        *above, name = path.split(".")
        found.setdefault(tuple(above), []).append((columns.index(c), name, read))
    return tuple((above, tuple(held)) for above, held in found.items())


_NOTHING: dict = {}


def read_members(value: dict, taken: tuple, out: list) -> None:
    """Put what ``steps`` name into ``out``; a reader gets None where a step is no object or has no such member."""
    for above, fields in taken:
        holder = value
        for name in above:
            holder = holder.get(name)
            if type(holder) is not dict:
                holder = _NOTHING
                break
        for at, name, read in fields:
            out[at] = read(holder.get(name))


def text(default: str | None = "", limit: int | None = None) -> Callable[[object], str | None]:
    """Reader of a string; lone surrogates, which no column can hold, are replaced."""

    def read(v: object) -> str | None:
        if not isinstance(v, str):
            return default
        if limit is not None:
            v = v[:limit]
        return v if v.isascii() else v.encode("utf-16-le", "surrogatepass").decode("utf-16-le", "replace")

    return read


_text_or_none = text(None)


def filled(v: object) -> str | None:
    """A string that is not empty."""
    return _text_or_none(v) or None


def optional_whole(v: object) -> int | None:
    """A number as a 64-bit integer, at its bounds if it lies beyond; None for anything else."""
    if isinstance(v, bool) or not isinstance(v, (int, float)):
        return None
    return int(max(-(2**63), min(2**63 - 1, v))) if abs(v) < 2**63 else (2**63 - 1 if v > 0 else -(2**63))


def whole(v: object) -> int:
    return v if type(v) is int and abs(v) < 2**63 else optional_whole(v) or 0


@lru_cache(1024)  # the lines of a call have one instant
def _instant(v: str) -> int:
    try:
        t = datetime.fromisoformat(v)
        past = (t if t.tzinfo else t.replace(tzinfo=timezone.utc)) - _EPOCH
        return past.days * 86_400_000 + past.seconds * 1000 + past.microseconds // 1000
    except (ValueError, OverflowError):
        return 0


def instant(v: object) -> int:
    """Milliseconds since 1970, 0 for what is no time; without a zone it is UTC."""
    return _instant(v) if isinstance(v, str) else 0


_capped = text(limit=INPUT_CAP)


def tool_input(v: object) -> str:
    """The first telling member of a tool's input, else how large the input is."""
    given = v if isinstance(v, dict) else {}
    for m in INPUT_MEMBERS:
        said = given.get(m)
        if said and isinstance(said, str):
            return _capped(said)
    return f"{json_length(given)} chars"


def string_length(v: object) -> int:
    return utf16(v) if isinstance(v, str) else 0


#: What is read of a block of each kind: column, path, reader.
BLOCK_FIELDS: dict[str, tuple] = {
    "thinking": (("chars", "thinking", json_length),),
    "text": (("chars", "text", string_length), ("snippet", "text", text(limit=SNIPPET_LENGTH))),
    "tool_use": (("chars", "input", json_length), ("input", "input", tool_input), ("id", "id", text()), ("name", "name", text("(unnamed)"))),
    "tool_result": (("chars", "content", json_length), ("tool_use_id", "tool_use_id", text())),
}
_BLOCK_COLUMNS = ("kind", "chars", "snippet", "id", "name", "input_chars", "input", "tool_use_id", "type")
_BLOCK_STEPS = {kind: steps(fields, _BLOCK_COLUMNS) for kind, fields in BLOCK_FIELDS.items()}
_BLOCK_TYPE = text("?")


def block_of(raw: object) -> list:
    """The columns of a content block; a kind that is not in the table is ``other`` with its name and size."""
    kind = raw.get("type") if isinstance(raw, dict) else None
    out: list = [None] * 9
    if isinstance(kind, str) and kind in _BLOCK_STEPS:
        out[0] = kind
        read_members(raw, _BLOCK_STEPS[kind], out)
        if kind == "tool_use":
            out[5] = out[1]  # its size as a block is that of its input
        return out
    out[0], out[1], out[8] = "other", json_length(raw), _BLOCK_TYPE(kind) if isinstance(raw, (dict, list)) else "malformed"
    return out


def blocks_of(content: object) -> list[list]:
    return [block_of(b) for b in content] if isinstance(content, list) else []


def said_blocks(content: object) -> list[list]:
    """As ``blocks_of``; plain text is one block."""
    return blocks_of([{"type": "text", "text": content}] if isinstance(content, str) else content)


def tier_sum(tiers: object) -> int | None:
    """The written tokens of all tiers, whatever their names; None without a breakdown."""
    return whole(sum(map(whole, tiers.values()))) if isinstance(tiers, dict) else None


#: What is read of a line of each type, and of every line: column, path, reader.
LINE_FIELDS: dict[str, tuple] = {
    "": (("uuid", "uuid", text()), ("ts_ms", "timestamp", instant), ("cwd", "cwd", filled)),
    "assistant": (
        ("model", "message.model", text("(unknown-model)")), ("request_id", "requestId", filled), ("message_id", "message.id", filled), ("input", "message.usage.input_tokens", whole),
        ("cache_creation", "message.usage.cache_creation", tier_sum), ("cc_flat", "message.usage.cache_creation_input_tokens", whole), ("cache_read", "message.usage.cache_read_input_tokens", whole),
        ("output", "message.usage.output_tokens", whole), ("blocks", "message.content", blocks_of),
    ),
    "user": (("blocks", "message.content", said_blocks), ("agent_id", "toolUseResult.agentId", filled)),
    "attachment": (("attachment_type", "attachment.type", text("?")), ("chars", "attachment", lambda v: json_length(v if isinstance(v, dict) else {}))),
    "system": (("subtype", "subtype", text("?")), ("duration_ms", "durationMs", optional_whole)),
}
#: The columns of a record, and behind them what only stands in for another.
_READ_COLUMNS = (*_COLUMNS, "message_id")
_LINE_STEPS = {kind: steps(LINE_FIELDS[""] + (fields if kind else ()), _READ_COLUMNS) for kind, fields in LINE_FIELDS.items()}
_KIND, _TYPE_AT, _UUID, _REQUEST, _CREATION, _FLAT, _BLOCKS, _IS_RESULT, _SNIPPET = map(
    _READ_COLUMNS.index, ("kind", "type", "uuid", "request_id", "cache_creation", "cc_flat", "blocks", "is_tool_result", "snippet")
)
_TYPE = text("(untyped)")


def _constant(name: str) -> None:
    raise ValueError(name)


#: Made once: a decoder costs more than reading a line of usual length.
_decoder = json.JSONDecoder(parse_constant=_constant)
_read, _scan = _decoder.decode, _decoder.scan_once
_read_long = json.JSONDecoder(parse_constant=_constant, parse_int=float).decode


def decoded(raw: str) -> object:
    """The JSON value of a line; ValueError or RecursionError if there is none."""
    try:
        value, end = _scan(raw, 0)
        if end == len(raw):
            return value
    except (StopIteration, ValueError):
        pass
    try:  # space around the value, or what is wrong with it
        return _read(raw)
    except json.JSONDecodeError:
        raise
    except ValueError:  # a whole number of thousands of digits
        return _read_long(raw)


def columns_of(raw: str) -> list:
    """What ``_READ_COLUMNS`` name of a line, blocks as lists of their columns.  Every text has them; what is not JSON, or nested too deeply to read, is ``unparseable``."""
    try:
        return record_of(decoded(raw))
    except (ValueError, RecursionError):
        out: list = [None] * len(_READ_COLUMNS)
        out[_KIND] = "unparseable"
        return out


def parse_line(raw: str) -> dict:
    """The record of a line by names (see ``columns_of``)."""
    found = dict(zip(_COLUMNS, columns_of(raw)))
    if found["blocks"] is not None:
        found["blocks"] = [dict(zip(_BLOCK_COLUMNS, b)) for b in found["blocks"]]
    return found


def record_of(value: object) -> list:
    out: list = [None] * len(_READ_COLUMNS)
    if not isinstance(value, (dict, list)):
        out[_KIND], out[_TYPE_AT] = "unknown", "(not an object)"
        return out
    held = value if isinstance(value, dict) else _NOTHING
    kind = _TYPE(held.get("type"))
    out[_TYPE_AT], out[_KIND] = kind, kind if kind and kind in LINE_FIELDS else "meta" if kind in META_TYPES else "unknown"
    read_members(held, _LINE_STEPS.get(kind) or _LINE_STEPS[""], out)
    if kind == "assistant":
        out[_REQUEST] = out[_REQUEST] or out[-1] or out[_UUID]
        if out[_CREATION] is None:  # tiers are what is costed; without them the flat figure is
            out[_CREATION], out[_FLAT] = out[_FLAT], None
    elif kind == "user":
        blocks = out[_BLOCKS]
        out[_IS_RESULT] = any([b[0] == "tool_result" for b in blocks])
        out[_SNIPPET] = next((b[2] for b in blocks if b[0] == "text"), "")
    return out


# --- files ----------------------------------------------------------------

_SESSION = r"([^/]+)/([^/]+)\.jsonl$"
_AGENT = r"([^/]+)/([^/]+)/subagents/agent-([^/]+)\.(?:jsonl|meta\.json)$"


def _path_parts(path: Column, agent: bool) -> list[Column]:
    pattern = _AGENT if agent else _SESSION
    part = lambda i: F.regexp_extract(path, pattern, i)
    return [part(1).alias("project"), part(2).alias("session_id"), (part(3) if agent else F.lit("")).alias("conv_id")]


@dataclass(frozen=True)
class Packed:
    """A corpus held as a table of lines in place of a file for each conversation (see ``writer.pack_files``).

    Every file of a folder costs a listing and an opening, which grows past the reading itself where
    files are many and small.  ``lines`` has ``project``, ``session_id``, ``conv_id``, ``half`` (transcript or meta), ``path``, ``line_no``
    (from 0) and ``value``; ``files`` has a row for each file that has lines, as ``discover`` gives it.
    """

    files: DataFrame
    lines: DataFrame

    def picked(self, sessions: DataFrame) -> Packed:
        mine = sessions.select("project", "session_id")
        return Packed(*[t.join(mine, ["project", "session_id"], "left_semi") for t in (self.files, self.lines)])


def path_columns(path: Column) -> list[Column]:
    """``project``, ``session_id``, ``conv_id`` and ``half`` of a path that ends as transcripts and sidecars do."""
    agent = path.rlike(_AGENT)
    parts = [F.when(agent, a).otherwise(own).alias(name) for name, a, own in zip(("project", "session_id", "conv_id"), _path_parts(path, True), _path_parts(path, False))]
    return [*parts, F.when(path.endswith(".meta.json"), "meta").otherwise("transcript").alias("half")]


def _absent(none: Exception) -> bool:
    return "PATH_NOT_FOUND" in str(none)


def _files(spark: SparkSession, glob: str, agent: bool) -> DataFrame:
    path = F.col("_metadata.file_path")
    return spark.read.text(glob, wholetext=True).select(
        *_path_parts(path, agent), path.alias("path"), F.col("_metadata.file_size").alias("bytes"), F.col("_metadata.file_modification_time").alias("mtime"), "value"
    )


def discover(spark: SparkSession, root: str | Packed) -> DataFrame:
    """``project``, ``session_id``, ``conv_id``, ``half`` (transcript or meta), ``path``, ``bytes`` and ``mtime`` of every file below ``root``.

    Only file metadata is read; no file is opened.
    """
    if isinstance(root, Packed):
        return root.files
    out = None
    for glob, agent, half in ((f"{root}/*/*.jsonl", False, "transcript"), (f"{root}/*/*/subagents/agent-*.jsonl", True, "transcript"), (f"{root}/*/*/subagents/agent-*.meta.json", True, "meta")):
        try:
            files = spark.read.format("binaryFile").load(glob)
        except Exception as none:
            if not _absent(none):
                raise
            continue
        part = files.select(*_path_parts(F.col("path"), agent), F.lit(half).alias("half"), "path", F.col("length").alias("bytes"), F.col("modificationTime").alias("mtime"))
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], "project string, session_id string, conv_id string, half string, path string, bytes long, mtime timestamp") if out is None else out


def sessions_of(files: DataFrame) -> DataFrame:
    """A row for each session of ``discover``: ``project``, ``session_id``, ``path``, ``bytes``, ``mtime``, ``spawns`` (agents with both files) and ``unpaired`` (what the others lack)."""
    own = files.filter("half = 'transcript' and conv_id = ''").select("project", "session_id", "path", "bytes", "mtime")
    agents = files.filter("conv_id <> ''")
    halves = paired(agents.filter("half = 'transcript'"), agents.filter("half = 'meta'").withColumnRenamed("conv_id", "agent_id"))
    note = F.concat("agent_id", F.lit(": "), "unpaired")
    known = halves.groupBy("session_id").agg(F.count_if(F.col("unpaired").isNull()).alias("spawns"), F.array_sort(F.collect_list(note)).alias("unpaired"))
    return own.join(known, "session_id", "left").withColumn("spawns", F.coalesce("spawns", F.lit(0).cast("long"))).withColumn("unpaired", F.coalesce("unpaired", F.array().cast("array<string>")))


def in_scope(
    sessions: DataFrame, project: str | None = None, prefix: str | None = None, since: str | None = None, has_spawns: bool = False, limit: int | None = None
) -> tuple[DataFrame, list[str]]:
    """The sessions that pass all filters (newest first where ``limit`` caps them), and what each filter left out, said at zero as well.

    ``project`` is a regular expression searched in the project's name, ``prefix`` begins the
    session's id, ``since`` is a day (UTC). Counts come from one pass over file metadata.
    """
    filters = []
    if project is not None:
        filters.append((f"project matches {project}", F.col("project").rlike(project)))
    if prefix is not None:
        filters.append((f"session begins with {prefix}", F.col("session_id").startswith(prefix)))
    if since is not None:
        filters.append((f"modified since {since}", F.col("mtime") >= F.lit(datetime.fromisoformat(since).replace(tzinfo=timezone.utc))))
    if has_spawns:
        filters.append(("has spawned work", F.col("spawns") > 0))
    kept, counts = excluded_counts(sessions, [(f"f{i}", keep) for i, (_, keep) in enumerate(filters)])
    met = counts.first()
    left = sum(met)
    criteria = []
    for i, (name, _) in enumerate(filters):
        criteria.append(f"{name}: excluded {met[f'f{i}']} of {left}")
        left -= met[f"f{i}"]
    if limit is not None:
        kept = kept.orderBy(F.desc("mtime"), "session_id").limit(limit)
        criteria.append(f"the {limit} modified last: {max(0, left - limit)} eligible sessions left out")
    return kept, criteria


def picked_paths(files: DataFrame, sessions: DataFrame) -> dict[str, list[str]]:
    """Paths of the files of the picked sessions by kind: ``own``, ``agents`` and ``metas``.

    As many as are picked; the file listing of a read holds them on the driver as well.
    """
    mine = files.join(sessions.select("project", "session_id"), ["project", "session_id"], "left_semi")
    kind = F.when(F.col("conv_id") == "", "own").when(F.col("half") == "meta", "metas").otherwise("agents")
    found: dict[str, list[str]] = {"own": [], "agents": [], "metas": []}
    for r in mine.select(kind.alias("kind"), "path").orderBy("path").collect():
        found[r["kind"]].append(r["path"])
    return found


def read_lines(spark: SparkSession, root: str | Packed, paths: dict[str, list[str]] | None = None) -> DataFrame:
    """``project``, ``session_id``, ``conv_id``, ``path``, ``line_no`` (from 0) and ``value`` of every line below ``root``, or of the files in ``paths``.

    Files are split at line breaks into byte ranges, so a file of any size is read by many
    tasks.  A line's number is its place within its range and the number of lines of the
    ranges before it, a running sum of one count a range.
    """
    if isinstance(root, Packed):
        return root.lines.filter("half = 'transcript'").select("project", "session_id", "conv_id", "path", "line_no", "value")
    out = None
    for agent, glob in ((False, f"{root}/*/*.jsonl"), (True, f"{root}/*/*/subagents/agent-*.jsonl")):
        given = None if paths is None else paths["agents" if agent else "own"]
        if given == []:
            continue
        try:
            text = spark.read.option("lineSep", "\n").text(glob if given is None else given)
        except Exception as none:
            if not _absent(none):
                raise
            continue
        path = F.col("_metadata.file_path")
        part = text.select(*_path_parts(path, agent), path.alias("path"), F.col("_metadata.file_block_start").alias("_from"), "value")
        out = part if out is None else out.unionByName(part)
    if out is None:
        return spark.createDataFrame([], "project string, session_id string, conv_id string, path string, line_no long, value string")
    # The lines of a range lie in one task in order, so their numbers there rise with their place.
    rows = out.withColumn("_n", F.monotonically_increasing_id())
    ranges = rows.groupBy("path", "_from").agg(F.count(F.lit(1)).alias("_lines"), F.min("_n").alias("_first"))
    before = F.sum("_lines").over(Window.partitionBy("path").orderBy("_from").rowsBetween(Window.unboundedPreceding, -1))
    starts = ranges.select("path", "_from", "_first", F.coalesce(before, F.lit(0)).alias("_before"))
    line = (F.col("_n") - F.col("_first") + F.col("_before")).alias("line_no")
    return rows.join(starts, ["path", "_from"]).select("project", "session_id", "conv_id", "path", line, "value")


def read_spawn_meta(spark: SparkSession, root: str | Packed, paths: dict[str, list[str]] | None = None) -> DataFrame:
    """Sidecars of spawned agents: what the spawner claimed, with defaults for what is absent or of another type."""
    schema = "session_id string, agent_id string, agent_type string, description string, tool_use_id string, declared_depth int"
    if isinstance(root, Packed):
        text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "value"))), lambda x: x["value"]), "\n")
        files = root.lines.filter("half = 'meta'").groupBy("session_id", "conv_id").agg(text.alias("value"))
    elif paths is not None and not paths["metas"]:
        return spark.createDataFrame([], schema)
    else:
        try:
            files = _files(spark, f"{root}/*/*/subagents/agent-*.meta.json" if paths is None else paths["metas"], True)
        except Exception as none:
            if not _absent(none):
                raise
            return spark.createDataFrame([], schema)
    o = F.try_parse_json("value")
    text = lambda m, default: F.when(F.schema_of_variant(F.try_variant_get(o, f"$.{m}", "variant")) == "STRING", F.try_variant_get(o, f"$.{m}", "string")).otherwise(default)
    return files.select(
        "session_id", F.col("conv_id").alias("agent_id"), text("agentType", "?").alias("agent_type"), text("description", "").alias("description"), text("toolUseId", "").alias("tool_use_id"),
        F.coalesce(F.try_variant_get(o, "$.spawnDepth", "int"), F.lit(1)).alias("declared_depth"),
    )


def paired(transcripts: DataFrame, metas: DataFrame) -> DataFrame:
    """Which halves of each spawned agent exist."""
    t = transcripts.filter("conv_id <> ''").select("session_id", F.col("conv_id").alias("agent_id"), F.lit(True).alias("has_transcript"))
    m = metas.select("session_id", "agent_id", F.lit(True).alias("has_meta"))
    both = t.join(m, ["session_id", "agent_id"], "full_outer")
    why = F.when(F.col("has_meta").isNull(), "transcript present, meta missing").when(F.col("has_transcript").isNull(), "meta present, transcript missing")
    return both.select("session_id", "agent_id", why.alias("unpaired"))


# --- records --------------------------------------------------------------
#
# Lines can also be taken apart as VARIANT values in the JVM.  What the built-in functions read
# differently (floating-point and very long numbers, whose JSON text depends on the
# writer; lone surrogates; dates in rare forms; lines that are no JSON) goes to the
# line parser above, which defines what every record is.

_DAY, _CLOCK, _ZONE = r"\d{4}-\d\d-\d\d", r"([01]\d|2[0-3]):[0-5]\d:[0-5]\d(\.\d{1,6})?", r"(Z|[+-](0\d|1[0-7]):[0-5]\d)"
_INSTANT = f"^{_DAY}T{_CLOCK}{_ZONE}$"
_STRINGS = r'"(?:[^"\\]++|\\.)*+"'
_ODD_NUMBERS = r"[0-9][.eE]|[0-9]{16}|-0"
#: Where no string ends before a colon and no comma, bracket or beginning stands before such a number, there is none outside of strings.
_MAYBE_ODD = r'(?:^|"\s*:|[,\[])\s*(?:-0|-?[0-9]+[.eE]|-?[0-9]{16})'
_SURROGATES = r"\\u[dD][89a-fA-F]"
_END = "end of line"


def _part(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "variant")


def _is(v: Column, kind: str) -> Column:
    return F.coalesce(F.schema_of_variant(v) == kind, F.lit(False))


def _string(v: Column, path: str) -> Column:
    """The string at a path, null for anything else."""
    return F.when(_is(_part(v, path), "STRING"), F.try_variant_get(v, path, "string"))


def _filled(v: Column, path: str) -> Column:
    return F.nullif(_string(v, path), F.lit(""))


def _whole(v: Column, path: str) -> Column:
    return F.when(_is(_part(v, path), "BIGINT"), F.try_variant_get(v, path, "bigint"))


def _object(v: Column, path: str = "$") -> Column:
    return F.try_variant_get(v, path, "map<string,variant>")


def _list(v: Column, path: str = "$") -> Column:
    return F.try_variant_get(v, path, "array<variant>")


def _utf16(s: Column) -> Column:
    return F.when(F.octet_length(s) == F.length(s), F.length(s)).otherwise(F.octet_length(F.encode(s, "UTF-16BE")) / 2).cast("long")


def _json_chars(v: Column) -> Column:
    """As ``json_length``; the order of members does not change the length."""
    return F.when(v.isNull() | _is(v, "VOID"), F.lit(0).cast("long")).when(_is(v, "STRING"), _utf16(F.try_variant_get(v, "$", "string"))).otherwise(_utf16(F.to_json(v)))


def _tool_input(b: Column) -> Column:
    size = F.when(_object(b, "$.input").isNotNull(), _json_chars(_part(b, "$.input"))).otherwise(2)
    said = F.coalesce(*[_filled(b, f"$.input.{m}") for m in INPUT_MEMBERS], F.concat(size.cast("string"), F.lit(" chars")))
    return F.substring(said, 1, INPUT_CAP)


def _block(typed: Column) -> Column:
    """A block from ``b``, its value, and ``kind``, the string that names its type."""
    b, kind = typed["b"], typed["kind"]
    known = F.coalesce(kind.isin(*BLOCK_FIELDS), F.lit(False))
    of = lambda k, x: F.when(kind == k, x)
    text = _string(b, "$.text")
    chars = (
        F.when(~known, _json_chars(b)).when(kind == "thinking", _json_chars(_part(b, "$.thinking"))).when(kind == "text", F.coalesce(_utf16(text), F.lit(0)))
        .when(kind == "tool_use", _json_chars(_part(b, "$.input"))).otherwise(_json_chars(_part(b, "$.content")))
    )
    composite = _object(b).isNotNull() | _list(b).isNotNull()
    return F.struct(
        F.when(known, kind).otherwise("other").alias("kind"), chars.cast("long").alias("chars"), of("text", F.substring(F.coalesce(text, F.lit("")), 1, SNIPPET_LENGTH)).alias("snippet"),
        of("tool_use", F.coalesce(_string(b, "$.id"), F.lit(""))).alias("id"), of("tool_use", F.coalesce(_string(b, "$.name"), F.lit("(unnamed)"))).alias("name"),
        of("tool_use", _json_chars(_part(b, "$.input"))).alias("input_chars"), of("tool_use", _tool_input(b)).alias("input"), of("tool_result", F.coalesce(_string(b, "$.tool_use_id"), F.lit(""))).alias("tool_use_id"),
        F.when(~known, F.when(composite, F.coalesce(kind, F.lit("?"))).otherwise("malformed")).alias("type"),
    )


def _said(text: Column) -> Column:
    """A plain text as the one block it stands for."""
    none = {c: F.lit(None).cast("string").alias(c) for c in ("id", "name", "input", "tool_use_id", "type")}
    return F.array(F.struct(F.lit("text").alias("kind"), _utf16(text).alias("chars"), F.substring(text, 1, SNIPPET_LENGTH).alias("snippet"), none["id"], none["name"], F.lit(None).cast("long").alias("input_chars"), none["input"], none["tool_use_id"], none["type"]))


def _decoded(lines: DataFrame) -> DataFrame:
    """Add ``v``, the line's value, and ``odd`` where the line parser has to read it."""
    # In a list with an end mark behind it a line of several values is told from one of one.
    held = lines.withColumn("_v", F.try_parse_json(F.concat(F.lit("["), "value", F.lit(f'\n,"{_END}"]'))))
    one = (F.try_variant_get("_v", "$[1]", "string") == _END) & F.try_variant_get("_v", "$[2]", "variant").isNull()
    v = held.withColumn("v", F.when(one, F.try_variant_get("_v", "$[0]", "variant"))).drop("_v")
    time = _string(F.col("v"), "$.timestamp")
    bare = F.regexp_replace("value", _STRINGS, "")
    numbers = F.col("value").rlike(_MAYBE_ODD) & bare.rlike(_ODD_NUMBERS)
    surrogates = F.col("value").contains("\\u") & F.col("value").rlike(_SURROGATES)
    odd = F.col("v").isNull() | numbers | surrogates | F.coalesce(~time.rlike(_INSTANT), F.lit(False))
    return v.withColumn("odd", odd)


def _records(lines: DataFrame) -> DataFrame:
    """Records of lines with a value ``v`` that is not odd."""
    v = F.col("v")
    composite = F.col("value").rlike(r"^\s*[{\[]")
    own = lines.withColumn("type", F.when(composite, F.coalesce(_string(v, "$.type"), F.lit("(untyped)"))).otherwise("(not an object)"))
    known = [k for k in LINE_FIELDS if k]
    own = own.withColumn("kind", F.when(~composite, "unknown").when(F.col("type").isin(*known), F.col("type")).when(F.col("type").isin(*META_TYPES), "meta").otherwise("unknown"))
    is_ = lambda k: F.col("kind") == k
    tiers = F.aggregate(F.map_values(_object(v, "$.message.usage.cache_creation")), F.lit(0).cast("long"), lambda a, x: a + F.coalesce(_whole(x, "$"), F.lit(0)))
    flat = F.coalesce(_whole(v, "$.message.usage.cache_creation_input_tokens"), F.lit(0))
    used = lambda name: F.when(is_("assistant"), F.coalesce(_whole(v, f"$.message.usage.{name}"), F.lit(0)))
    none = F.array().cast(f"array<{BLOCK}>")
    typed = F.transform(_list(v, "$.message.content"), lambda b: F.struct(b.alias("b"), _string(b, "$.type").alias("kind")))
    listed = F.coalesce(F.transform(typed, _block).cast(f"array<{BLOCK}>"), none)
    said = _string(v, "$.message.content")
    blocks = F.when(is_("assistant"), listed).when(is_("user"), F.when(said.isNotNull(), _said(said).cast(f"array<{BLOCK}>")).otherwise(listed))
    own = own.withColumn("blocks", blocks)
    uuid = F.coalesce(_string(v, "$.uuid"), F.lit(""))
    ms = F.coalesce(F.unix_millis(F.try_to_timestamp(_string(v, "$.timestamp"))), F.lit(0))
    first_text = F.filter("blocks", lambda b: b["kind"] == "text")
    columns = {
        "uuid": F.when(composite, uuid), "ts_ms": F.when(composite, ms), "request_id": F.when(is_("assistant"), F.coalesce(_filled(v, "$.requestId"), _filled(v, "$.message.id"), uuid)),
        "model": F.when(is_("assistant"), F.coalesce(_string(v, "$.message.model"), F.lit("(unknown-model)"))), "input": used("input_tokens"),
        "cache_creation": F.when(is_("assistant"), F.coalesce(tiers, flat)), "cache_read": used("cache_read_input_tokens"), "output": used("output_tokens"), "cc_flat": F.when(is_("assistant") & tiers.isNotNull(), flat),
        "agent_id": F.when(is_("user"), _filled(v, "$.toolUseResult.agentId")), "is_tool_result": F.when(is_("user"), F.exists("blocks", lambda b: b["kind"] == "tool_result")),
        "snippet": F.when(is_("user"), F.coalesce(F.try_element_at(first_text, F.lit(1))["snippet"], F.lit(""))), "attachment_type": F.when(is_("attachment"), F.coalesce(_string(v, "$.attachment.type"), F.lit("?"))),
        "chars": F.when(is_("attachment"), F.when(_object(v, "$.attachment").isNotNull(), _json_chars(_part(v, "$.attachment"))).otherwise(2)), "subtype": F.when(is_("system"), F.coalesce(_string(v, "$.subtype"), F.lit("?"))),
        "duration_ms": F.when(is_("system"), _whole(v, "$.durationMs")), "cwd": F.when(composite, _filled(v, "$.cwd")),
    }
    return own.select(*[columns.get(c, F.col(c)).alias(c) for c in _COLUMNS])


def parse_lines(lines: DataFrame, in_jvm: bool = False) -> DataFrame:
    """Typed records of lines (``session_id``, ``conv_id``, ``project``, ``line_no``, ``value``); blank lines have none.

    The line parser reads them in batches.  With ``in_jvm`` it reads only odd lines (see above)
    and no others pass through Python, which takes several times as long; the two readers agree on
    every line.
    """

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = _arrow_types()
        block = types["blocks"].value_type
        # Few records at a time: what is gone before the garbage collector looks costs it nothing.
        for batch in (b.slice(at, 1000) for b in batches for at in range(0, b.num_rows, 1000)):
            found = dict(zip(_READ_COLUMNS, zip(*map(columns_of, batch.column("value").to_numpy(zero_copy_only=False)))))
            # Column by column with its type, those of blocks as well: no record becomes an object of its own.
            lists = found["blocks"]
            flat = [b for some in lists if some for b in some]
            parts = [pa.array(c, of.type) for c, of in zip(zip(*flat) if flat else [()] * len(block), block)]
            ends = pa.array([0, *accumulate([len(some) if some else 0 for some in lists])], pa.int32())
            made = {c: batch.column(c) for c in ("session_id", "conv_id", "project", "line_no")}
            made["blocks"] = pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays(parts, fields=list(block)), types["blocks"], mask=pa.array([some is None for some in lists]))
            yield pa.RecordBatch.from_arrays([made[c].cast(of) if c in made else pa.array(found[c], of) for c, of in types.items()], list(types))

    filled = lines.select("session_id", "conv_id", "project", "line_no", "value").filter(F.col("value").rlike(r"(?U)\S"))
    if not in_jvm:
        return filled.mapInArrow(parse, RECORD)
    rows = _decoded(filled)
    plain = _records(rows.filter(~F.col("odd")))
    odd = rows.filter("odd").select("session_id", "conv_id", "project", "line_no", "value").mapInArrow(parse, RECORD)
    return plain.unionByName(odd).select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in odd.schema.fields])


def parse_stats(records: DataFrame) -> DataFrame:
    """Lines of each kind and type."""
    return records.groupBy("session_id", "conv_id", "kind", "type").agg(F.count(F.lit(1)).alias("lines"))
