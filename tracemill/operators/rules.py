"""Ordered rule tables: the first rule that holds decides."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracemill.functions.tokens import TURN_LENGTH, display


def first_match(rules: Sequence[tuple[Column, Column]], otherwise: Column) -> Column:
    out = None
    for condition, value in rules:
        out = F.when(condition, value) if out is None else out.when(condition, value)
    return otherwise if out is None else out.otherwise(otherwise)


def _origin(kind: str, value: Column, snippet: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), value.alias("value"), display(snippet, TURN_LENGTH).alias("snippet"))


#: How harness texts begin, and what they are.
HARNESS_BEFORE_SHELL = ((r"^<local-command-caveat>", "local command caveat"), (r"^<local-command-stdout>", "local command output"))
HARNESS_AFTER_SHELL = (
    (r"^<bash-(?:stdout|stderr)>", "shell output"),
    (r"^<task-notification>", "task notification"),
    (r"^\[Request interrupted by user", "interrupted by user"),
    (r"^\[Image: ", "pasted image"),
    (r"^This session is being continued from a previous conversation", "resumed after compaction"),
)
#: Commands that steer a session and do not ask for work.
SESSION_CONTROL = ("clear", "compact", "model", "context", "rewind", "resume")


def turn_origin(text: Column) -> Column:
    """(kind, value, snippet) of a user-channel text: user, command, skill, agent or harness."""
    trim = lambda c: F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
    skill = F.element_at(F.split(F.regexp_extract(text, r"^Base directory for this skill:\s*(\S+)", 1), "/skills/"), -1)
    name = F.when(text.rlike(r"<command-name>/?[^<]*</command-name>"), trim(F.regexp_extract(text, r"<command-name>/?([^<]*)</command-name>", 1))).otherwise("?")
    args = trim(F.regexp_extract(text, r"<command-args>([^<]*)</command-args>", 1))
    relayed = trim(F.element_at(F.split(F.regexp_extract(text, r"(?s)^=== Below is a message from an agent[^\n]*\n(.*)", 1), "\n=== "), 1))
    shell = display(trim(F.regexp_extract(text, r"(?s)^<bash-input>(.*?)</bash-input>", 1)), TURN_LENGTH)
    harness = lambda what: _origin("harness", F.lit(what), F.lit(f"[{what}]"))
    return first_match(
        [
            (text.rlike(r"^Base directory for this skill:\s*\S+"), _origin("skill", skill, F.concat(F.lit("skill: "), skill))),
            (text.rlike(r"^<command-(?:name|message)>"), _origin("command", name, F.concat(F.lit("/"), name, F.when(args != "", F.concat(F.lit(" "), args)).otherwise("")))),
            (text.rlike(r"^=== Below is a message from an agent[^\n]*\n"), _origin("agent", F.lit(""), F.concat(F.lit("via agent: "), relayed))),
            *[(text.rlike(p), harness(what)) for p, what in HARNESS_BEFORE_SHELL],
            (text.rlike(r"(?s)^<bash-input>.*?</bash-input>"), _origin("harness", F.lit("shell command"), F.concat(F.lit("! "), shell))),
            *[(text.rlike(p), harness(what)) for p, what in HARNESS_AFTER_SHELL],
        ],
        _origin("user", F.lit(""), text),
    )


def is_session_control(origin: Column) -> Column:
    return (origin["kind"] == "command") & origin["value"].isin(*SESSION_CONTROL)


#: Paths that are nobody's project.
SCRATCH = r"/tmp/|/private/tmp/|scratchpad|/var/folders/"
#: The classification cascade in order: activity, tier, what is looked at, pattern, reason.
ACTIVITY_RULES = (
    ("review", "marker", "skill", r"code-?review|address-pr|security-review", "a skill that reviews was loaded"),
    ("process", "marker", "skill", r"groom-backlog|ticket|next\b|schedule|loop", "a skill for planning work was loaded"),
    ("scm", "marker", "skill", r"organize-commits|commit", "a skill that commits was loaded"),
    ("exploration", "marker", "agent", r"(?i)^explore$", "an explorer was sent out"),
    ("design", "marker", "agent", r"(?i)^plan$", "a planner was sent out"),
    ("orientation", "marker", "skill", r"", "some other skill was loaded"),
    ("implementation", "rule", "edit", r"^(Edit|Write|NotebookEdit)$", "project files were changed"),
    ("exploration", "rule", "text", SCRATCH, "a script outside the project was run"),
    ("verification", "rule", "text", r"\b(pytest|jest|vitest|go test|cargo test|npm test|bun test|tsc|ruff|eslint|mypy)\b", "the work was tested or linted"),
    ("scm", "rule", "text", r"(^|[;&|\s])(git|gh)\s", "version control was used"),
    ("process", "rule", "text", r"(^|[;&|\s])lit\s", "the issue tracker was used"),
    ("design", "rule", "tool", r"^AskUserQuestion$", "the user was asked to decide"),
    ("exploration", "rule", "tool", r"^(Read|Grep|Glob|WebFetch|WebSearch|Agent)$", "something was looked up"),
    ("exploration", "rule", "text", r"(^|[;&|\s])(grep|rg|find|cat|sed|awk|ls)\s", "something was looked up"),
    ("unclassified", "rule", "tool", r"", "only tools without a rule were used"),
)


def activity(tools: Column, skills: Column, agents: Column) -> Column:
    """(activity, tier, because) of a call, null where no rule holds.

    ``tools`` is an array of (name, text) with the program text of each tool's
    input, ``skills`` and ``agents`` the names of skills loaded and agent types spawned.
    """
    looks = {
        "skill": lambda p: F.exists(skills, lambda s: s.rlike(p)),
        "agent": lambda p: F.exists(agents, lambda a: a.rlike(p)),
        "tool": lambda p: F.exists(tools, lambda t: t["name"].rlike(p)),
        "text": lambda p: F.exists(tools, lambda t: t["text"].rlike(p)),
        "edit": lambda p: F.exists(tools, lambda t: t["name"].rlike(p) & ~t["text"].rlike(SCRATCH)),
    }
    rules = [
        (looks[kind](pattern), F.struct(F.lit(a).alias("activity"), F.lit(tier).alias("tier"), F.lit(why).alias("because")))
        for a, tier, kind, pattern, why in ACTIVITY_RULES
    ]
    return first_match(rules, F.lit(None).cast("struct<activity:string,tier:string,because:string>"))
