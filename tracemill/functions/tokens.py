"""Column functions: token costs, sizes, names, display text and derived ids."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What a cached token costs when written and when read, in input tokens.
WRITE, READ = 1.25, 0.1
#: Lengths of displayed text.
SUMMARY_LENGTH, TURN_LENGTH, SNIPPET_LENGTH, INPUT_CAP = 90, 110, 200, 4000

_COMPONENTS = ("input", "cache_creation", "cache_read", "output")


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def input_equivalents(inp: Column | str, creation: Column | str, read: Column | str) -> Column:
    """Input tokens that the input side of a usage is worth."""
    return _c(inp).cast("double") + F.lit(WRITE) * _c(creation) + F.lit(READ) * _c(read)


def spend(inp: Column | str, creation: Column | str, read: Column | str, output: Column | str) -> Column:
    return input_equivalents(inp, creation, read) + _c(output)


def spend20(prefix: str = "") -> Column:
    """Twenty times the spend, an exact integer."""
    i, c, r, o = (F.col(prefix + n) for n in _COMPONENTS)
    return 20 * i + 25 * c + 2 * r + 20 * o


def usage_sums(when: Column | None = None, suffix: str = "") -> list[Column]:
    """Sums of the four components, of all rows or of those where ``when`` holds."""
    one = (lambda c: F.when(when, F.col(c)).otherwise(0)) if when is not None else F.col
    return [F.coalesce(F.sum(one(c)), F.lit(0)).cast("long").alias(c + suffix) for c in _COMPONENTS]


def half_up(x: Column) -> Column:
    """Round to an integer, halves toward plus infinity (also below zero)."""
    return F.floor(x + F.lit(0.5))


def rounded(x: Column, digits: int) -> Column:
    """Round a double to ``digits`` places as SQL engines do: scaled, to the nearest whole number (halves away from zero), scaled back.

    ``round(x, digits)`` of Spark goes by the decimal text of ``x`` and differs where the scaled double lies just beside a half.
    """
    return F.round(x * F.lit(float(10**digits))) / F.lit(float(10**digits))


def estimate_tokens(chars: Column | str) -> Column:
    return F.floor((_c(chars) + 2) / 4).cast("long")


def sized(tokens: Column, basis: str) -> Column:
    """A size never travels without the basis it rests on."""
    return F.struct(tokens.cast("long").alias("tokens"), F.lit(basis).alias("basis"))


def canonical_model(model: Column | str) -> Column:
    """A model id without its date suffix."""
    return F.regexp_replace(_c(model), r"-\d{8}$", "")


def utf16_length(text: Column | str) -> Column:
    """Length in UTF-16 units, which transcripts' writers count."""
    return (F.octet_length(F.encode(_c(text), "UTF-16BE")) / 2).cast("long")


def display(text: Column | str, n: int = SUMMARY_LENGTH) -> Column:
    return F.substring(F.regexp_replace(_c(text), r"(?U)\s+", " "), 1, n)


def first_filled(*texts: Column) -> Column:
    """The first text that is neither null nor empty."""
    return F.coalesce(*(F.when(t != "", t) for t in texts))


def program_text(text: Column | str) -> Column:
    """A command without here-document bodies and quoted runs, in lower case."""
    t = F.regexp_replace(_c(text), r"(?ms)<<-?'?(\w+)'?.*?^\s*\1", " ")
    return F.lower(F.regexp_replace(F.regexp_replace(t, r"'[^']*'", " "), r'"[^"]*"', " "))


def leaf_name(path: Column | str) -> Column:
    """Last part of a POSIX or Windows path; null if there is none."""
    parts = F.filter(F.split(_c(path), r"[/\\]+"), lambda p: p != "")
    return F.try_element_at(parts, F.lit(-1))


def hex_id(parts: Sequence[Column], size: int) -> Column:
    """``size`` bytes of a digest of the parts, in hexadecimal: the same parts give the same id on every export."""
    return F.substring(F.sha2(F.concat_ws("\n", *parts), 256), 1, 2 * size)


def trace_id(*parts: Column) -> Column:
    return hex_id(parts, 16)


def span_id(*parts: Column) -> Column:
    return hex_id(parts, 8)


def trace_url(base: str, trace: Column) -> Column:
    return F.concat(F.lit(base.rstrip("/") + "/trace/"), trace)


def span_url(base: str, trace: Column, span: Column) -> Column:
    return F.concat(trace_url(base, trace), F.lit("?uiFind="), span)


def tsv_cell(text: Column | str) -> Column:
    """A cell that cannot break its row."""
    return F.regexp_replace(F.coalesce(_c(text).cast("string"), F.lit("")), r"[\t\r\n]", " ")


def tsv_row(*columns: Column | str) -> Column:
    return F.concat_ws("\t", *(tsv_cell(c) for c in columns))


# --- lineages: arrays of hops from the root; the root's is empty ----------


def depth_of(lineage: Column | str) -> Column:
    return F.size(_c(lineage))


def immediate_agent(lineage: Column | str) -> Column:
    return F.try_element_at(_c(lineage), F.lit(-1))["agent_id"]


def parent_agent(lineage: Column | str) -> Column:
    return F.try_element_at(_c(lineage), F.lit(-2))["agent_id"]


def lineage_path(lineage: Column | str) -> Column:
    path = F.array_join(F.transform(_c(lineage), lambda h: h["agent_type"]), " > ")
    return F.when(depth_of(lineage) == 0, F.lit("main")).otherwise(path)


def driver_of(lineage: Column | str) -> Column:
    """Who speaks in a conversation: a human at the root, an agent below it."""
    return F.when(depth_of(lineage) == 0, "human").otherwise("agent")


def is_main(lineage: Column | str) -> Column:
    return depth_of(lineage) == 0


def is_spawned(lineage: Column | str) -> Column:
    return depth_of(lineage) > 0


def at_depth(lineage: Column | str, n: int) -> Column:
    return depth_of(lineage) == n


def in_agent(lineage: Column | str, agent: str) -> Column:
    return F.exists(_c(lineage), lambda h: h["agent_id"] == agent)


def path_of(lineage: Column | str) -> Column:
    """The agents of a lineage as one text, which tells lineages of a session apart and can be joined on."""
    return F.array_join(F.transform(_c(lineage), lambda h: h["agent_id"]), "\n")


def parent_path(lineage: Column | str) -> Column:
    """``path_of`` the lineage one hop shorter; null at the root."""
    line = _c(lineage)
    return F.when(F.size(line) > 0, path_of(F.slice(line, 1, F.greatest(F.size(line) - 1, F.lit(0)))))


def is_child_of(child: Column | str, parent: Column | str) -> Column:
    """Whether ``child`` extends ``parent`` by exactly one hop."""
    return (F.size(_c(child)) == F.size(_c(parent)) + 1) & parent_path(child).eqNullSafe(path_of(parent))
