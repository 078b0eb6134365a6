"""Divergence of sources: how the terms of one source differ from those of another of its language.

Every source gives each kept term of its language a smoothed probability that
depends on the term's count alone.  A sum over all kept terms of a function of
two such probabilities is therefore a sum over distinct pairs of counts, each
taken as often as it occurs.  Tasks tally, for each two sources of a language,
how many terms have which two counts; terms that one or both lack follow from
the sources' own count histograms and the size of the vocabulary.  The function
is then worked out once for each pair of counts.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracemill.llm.common import written

#: A task hands its counts on when it holds this many terms of sources (bounded memory; results do not depend on it).
FLUSH_TERMS = 300_000
#: Rows of counts that a task tallies at a time, and the pairs it sorts at a time.
TALLY_ROWS, TALLY_PAIRS = 50_000, 2_000_000
#: Probabilities are whole numbers of this.
SCALE = 1_000_000_000
#: Parts that the terms of one group are ranked in before they meet.
RANK_PARTS = 64

#: ASCII letters lower-cased, bytes above ASCII as they are, every other byte a blank.
_TERMS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 0x80 else 32 for b in range(256))


def terms_of(text: str) -> list[bytes]:
    return text.encode().translate(_TERMS).split()


def term_counts(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """``lang``, ``source``, ``term``, ``n`` (occurrences) and ``df`` (rows that have it); nulls are read as ''."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        met: dict[tuple[str, str], tuple[Counter[bytes], Counter[bytes]]] = {}
        held = 0

        def handed() -> Iterator[pd.DataFrame]:
            for (lang, source), (n, df) in met.items():
                if n:
                    yield pd.DataFrame({"lang": lang, "source": source, "term": b"\n".join(n).decode().split("\n"), "n": [*n.values()], "df": [*map(df.__getitem__, n)]})
            met.clear()

        for batch in batches:
            for lang, source, text in zip(batch["lang"], batch["source"], batch["text"]):
                words = terms_of(text)
                n, df = met.setdefault((lang, source), (Counter(), Counter()))
                held -= len(n)
                n.update(words)
                df.update(set(words))
                held += len(n)
                if held > FLUSH_TERMS:
                    yield from handed()
                    held = 0
        yield from handed()

    rows = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(name) for c, name in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))])
    found = rows.mapInPandas(count, "lang string, source string, term string, n long, df long")
    # Dealt by language and term, as what follows needs it.
    return found.repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))


def kept_terms(counts: DataFrame, min_docs: int) -> DataFrame:
    """``lang``, ``source``, ``term``, ``n`` and ``lang_n`` of terms in at least ``min_docs`` documents of their language."""
    w = Window.partitionBy("lang", "term")
    return counts.select("lang", "source", "term", "n", F.sum("n").over(w).alias("lang_n"), F.sum("df").over(w).alias("lang_df")).filter(F.col("lang_df") >= min_docs).drop("lang_df")


def tallies(block: pd.DataFrame) -> Iterator[pd.DataFrame]:
    """Tallies of (lang, a, b, c, d): terms of a language with count c in source a and d in the later source b.

    ``block`` is in order of lang, term and source, and holds whole terms.
    """
    lang, langs = pd.factorize(block["lang"])
    source, sources = pd.factorize(block["source"], sort=True)
    n = block["n"].to_numpy(np.int64)
    fresh = np.ones(len(block), bool)
    fresh[1:] = (lang[1:] != lang[:-1]) | (block["term"].to_numpy()[1:] != block["term"].to_numpy()[:-1])
    group = np.cumsum(fresh) - 1
    group_end = np.append(np.flatnonzero(fresh)[1:], len(block))[group]
    after = group_end - np.arange(len(block)) - 1  # later rows of the same term
    upto = np.cumsum(after)
    at = 0
    while at < len(block):
        stop = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + TALLY_PAIRS, "right")))
        left = np.repeat(np.arange(at, stop), after[at:stop])
        if len(left):
            begins = np.cumsum(after[at:stop]) - after[at:stop]
            right = left + 1 + np.arange(len(left)) - np.repeat(begins, after[at:stop])
            pairs = pd.DataFrame({"lang": lang[left], "a": source[left], "b": source[right], "c": n[left], "d": n[right]})
            found = pairs.groupby(["lang", "a", "b", "c", "d"], sort=False).size().reset_index(name="m")
            yield found.assign(lang=langs.take(found["lang"]), a=sources.take(found["a"]), b=sources.take(found["b"]))
        at = stop


def joint_counts(kept: DataFrame) -> DataFrame:
    """``lang``, ``a``, ``b``, ``c``, ``d`` and ``m``: how many terms have count ``c`` in source ``a`` and ``d`` in the later source ``b``, both over 0."""

    def tally(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []

        def whole(rest: bool) -> Iterator[pd.DataFrame]:
            rows = pd.concat(held, ignore_index=True)
            held.clear()
            if not rest:  # the last term may go on in the next batch
                same = (rows["lang"] == rows["lang"].iloc[-1]) & (rows["term"] == rows["term"].iloc[-1])
                held.append(rows[same])
                rows = rows[~same]
            if len(rows):
                yield from tallies(rows)

        for batch in batches:
            for at in range(0, len(batch), TALLY_ROWS):
                held.append(batch.iloc[at : at + TALLY_ROWS])
                if sum(map(len, held)) >= TALLY_ROWS:
                    yield from whole(False)
        if held:
            yield from whole(True)

    rows = kept.select("lang", "term", "source", "n").repartition("lang", "term").sortWithinPartitions("lang", "term", "source")
    found = rows.mapInPandas(tally, "lang string, a string, b string, c long, d long, m long")
    return found.groupBy("lang", "a", "b", "c", "d").agg(F.sum("m").alias("m"))


def probability(count: str, total: str) -> Column:
    """1 + floor(SCALE * (count + 1) / (total + vocabulary)), exact; counts whose product has no room in 64 bits take decimals."""
    return F.expr(
        f"1 + case when {count} < {2**63 // SCALE - 1} then ({SCALE}L * ({count} + 1)) div ({total} + vocabulary)"
        f" else (cast({SCALE} as decimal(38,0)) * ({count} + 1)) div cast({total} + vocabulary as decimal(38,0)) end"
    )


def divergence(p: str, q: str) -> Column:
    """floor((p - q)^2 / q); the square has at most nineteen digits."""
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div {q}")


def pair_values(groups: DataFrame, sizes: DataFrame, kept: DataFrame) -> DataFrame:
    """``lang``, ``source``, ``item`` and ``value`` for every two sources of a language.

    ``groups`` has ``lang``, ``source`` and ``total`` (occurrences of kept terms), ``sizes`` ``lang`` and ``vocabulary`` (kept terms).
    """
    keys = ["lang", "a", "b"]
    first = groups.select("lang", F.col("source").alias("a"), F.col("total").alias("total_a"))
    second = groups.select("lang", F.col("source").alias("b"), F.col("total").alias("total_b"))
    # Half as many rows as are asked for; each has the values both ways.
    pairs = written(first.join(second, "lang").filter("a < b").join(sizes, "lang"), "source-pairs")
    joint = written(joint_counts(kept), "joint-counts")
    own = written(kept.groupBy("lang", "source", F.col("n").alias("c")).agg(F.count(F.lit(1)).alias("m")), "count-histograms")
    cell = lambda rows, c, d, m: rows.select(*keys, F.expr(c).cast("long").alias("c"), F.expr(d).cast("long").alias("d"), F.expr(m).cast("long").alias("m"))
    # Terms that one source or both lack: all terms begin as (0, 0), what a source has moves to its count, what both have goes out.
    of_a = joint.groupBy(*keys, "c").agg(F.sum("m").alias("m"))
    of_b = joint.groupBy(*keys, "d").agg(F.sum("m").alias("m"))
    of_both = of_a.groupBy(*keys).agg(F.sum("m").alias("m"))
    left = pairs.select(*keys).join(own.withColumnRenamed("source", "a"), ["lang", "a"])
    right = pairs.select(*keys).join(own.withColumnRenamed("source", "b"), ["lang", "b"])
    cells = cell(pairs, "0", "0", "vocabulary")
    for rows, c, d, m in ((left, "c", "0", "m"), (left, "0", "0", "-m"), (right, "0", "c", "m"), (right, "0", "0", "-m"), (of_a, "c", "0", "-m"), (of_b, "0", "d", "-m"), (of_both, "0", "0", "m")):
        cells = cells.unionByName(cell(rows, c, d, m))
    lacking = cells.groupBy(*keys, "c", "d").agg(F.sum("m").alias("m")).filter("m <> 0")
    every = joint.select(*keys, "c", "d", "m").unionByName(lacking)
    known = every.join(F.broadcast(pairs) if pairs.count() <= 100_000 else pairs, keys)
    valued = known.select(*keys, F.col("m").cast("decimal(20,0)").alias("m"), probability("c", "total_a").alias("p"), probability("d", "total_b").alias("q"))
    sums = valued.groupBy(*keys).agg(F.sum(F.col("m") * divergence("p", "q")).alias("ab"), F.sum(F.col("m") * divergence("q", "p")).alias("ba"))
    both = pairs.select(*keys).join(sums, keys, "left")
    ways = F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item"), F.col("ab").alias("value")), F.struct(F.col("b").alias("source"), F.col("a").alias("item"), F.col("ba").alias("value")))
    return both.select("lang", F.explode(ways).alias("w")).select("lang", "w.source", "w.item", F.coalesce("w.value", F.lit(0)).cast("long").alias("value"))


def term_values(groups: DataFrame, sizes: DataFrame, kept: DataFrame, top: int) -> DataFrame:
    """The ``top`` terms that each source has more often than its language, with value and rank."""
    own = ["lang", "source"]
    known = kept.join(groups, own).join(sizes, "lang")
    p = known.select(*own, F.col("term").alias("item"), probability("n", "total").alias("p"), probability("lang_n", "lang_total").alias("q")).filter("p > q")
    valued = p.select(*own, "item", divergence("p", "q").alias("value"))
    order = [F.desc("value"), "item"]
    # First within parts of a group, so that no task orders all its terms.
    part = F.pmod(F.xxhash64("item"), F.lit(RANK_PARTS))
    first = valued.withColumn("_part", part).withColumn("_r", F.row_number().over(Window.partitionBy(*own, "_part").orderBy(*order))).filter(F.col("_r") <= top)
    return first.select(*own, "item", "value", F.row_number().over(Window.partitionBy(*own).orderBy(*order)).alias("rank")).filter(F.col("rank") <= top)


def audit_sources(docs: DataFrame, min_docs: int = 3, top: int = 200, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """``lang``, ``source``, ``part``, ``item``, ``value`` and ``rank``: what sets each source of a language apart.

    Part ``pair`` has a row for each other source of the language, with the sum of
    (p - q)^2 / q over the language's kept terms (0 if it has none); part ``term`` the
    ``top`` terms with p above the language's own q.  Ranks from 1 within source and part, largest
    value first, ties to the smaller item in UTF-8.  Kept are terms that occur in ``min_docs`` rows of the language.
    A null text, lang or source is read as '' (a language or source like any other), repeated rows count each for itself, a language
    of one source has no pairs, an empty table gives no rows.  Only the three named columns are read.
    """
    kept = written(kept_terms(term_counts(docs, lang_col, source_col, text_col), min_docs), "kept-terms")
    every = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(name) for c, name in ((lang_col, "lang"), (source_col, "source"))]).distinct()
    sums = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = written(every.join(sums, ["lang", "source"], "left").fillna(0, ["total"]), "source-totals")
    distinct = kept.groupBy("lang", "term").agg(F.max("lang_n").alias("n")).groupBy("lang").agg(F.count(F.lit(1)).alias("vocabulary"), F.sum("n").alias("lang_total"))
    sizes = written(groups.select("lang").distinct().join(distinct, "lang", "left").fillna(0, ["vocabulary", "lang_total"]), "language-totals")
    pairs = pair_values(groups, sizes.select("lang", "vocabulary"), kept)
    ranked = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))
    terms = term_values(groups, sizes, kept, top)
    cols = lambda rows, part: rows.select("lang", "source", F.lit(part).alias("part"), "item", F.col("value").cast("long").alias("value"), F.col("rank").cast("int").alias("rank"))
    return cols(ranked, "pair").unionByName(cols(terms, "term"))
