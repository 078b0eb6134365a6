"""Benchmark decontamination with a distributed positional inverted index.

The index holds postings ``(document row, term, position, context)`` of the
rarest terms of each test window, stored in the shared folder.  A window's
candidates are its rarest term's postings shifted by the term's offset; they
are intersected with the shifted lists of the next rarest term, and what is
left is matched word by word against the stored context: in order (exact
phrase) or within a few words in any order (proximity).  Neighbouring windows
share terms, so lists are shifted to the item's start and a match grows from
the rarest term to both sides.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.llm.common import bounded_batches, written

#: Words are runs of anything but ASCII characters that are no letter or digit, after lower-casing A-Z.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Test windows that are matched in one go; more are taken in blocks of items.
BLOCK_WINDOWS = 100_000
#: Terms of a window whose postings are stored and intersected.
ANCHORS = 2

_upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: The same words in UTF-8, where the bytes of other characters are all above 0x7F.
_word = re.compile(rb"[0-9a-z\x80-\xff]+")


def word_bytes(text: str | None) -> list[bytes]:
    """The words of a text, in UTF-8."""
    return _word.findall(text.encode().lower()) if text else []


def words_of(text: str | None) -> list[str]:
    return [w.decode() for w in word_bytes(text)]


def words_column(text: Column) -> Column:
    """The same words with Spark functions."""
    parts = F.split(F.translate(F.coalesce(text, F.lit("")), _upper, _upper.lower()), GAP)
    return F.filter(parts, lambda w: w != "")


def term_counts(docs: DataFrame, text_col: str, terms: set[str]) -> dict[str, int]:
    """Occurrences over all documents of the given terms (at most one block's vocabulary)."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(frozenset(t.encode() for t in terms))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: Counter[bytes] = Counter()
        wanted = shared.value.__contains__
        for batch in batches:
            for text in batch["text"].tolist():
                found.update(filter(wanted, word_bytes(text)))
        if found:
            yield pd.DataFrame({"term": [t.decode() for t in found], "n": [*found.values()]})

    counted = docs.select(F.col(text_col).alias("text")).mapInPandas(count, "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))
    return {r["term"]: r["n"] for r in counted.collect()}


def anchored(items: list[tuple[str, list[str]]], counts: dict[str, int], n: int) -> list[tuple]:
    """(item, its words, term, offset, rank of the list, only list, its windows' starts) for the rarest terms of each window."""
    rows: dict[tuple, tuple] = {}
    for item, words in items:
        for at in range(max(1, len(words) - n + 1)):
            window = words[at : at + n]
            if not all(w in counts for w in window):
                continue  # some word is in no document
            first = {w: i for i, w in reversed([*enumerate(window)])}
            rarest = sorted(first, key=lambda w: (counts[w], w))[:ANCHORS]
            for nth, w in enumerate(rarest):
                rows.setdefault((item, at + first[w], nth, len(rarest)), (item, words, w, at + first[w], nth, len(rarest) == 1, []))[-1].append(at)
    return [*rows.values()]


def context_radius(n: int, slop: int = 0) -> int:
    """Words to either side that a posting's context needs."""
    return n - 1 + slop


def build_index(docs: DataFrame, rarest: set[str], others: set[str], radius: int, text_col: str = "text") -> DataFrame:
    """Store the postings of some terms: ``row_id``, ``doc_id``, ``n_words``, ``radius`` and ``postings`` of each document.

    A posting is (term, position, context, place in the context).  The context
    (words up to ``radius`` before and after) is kept for the ``rarest`` terms, so a
    match needs no second look at the document.
    """
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(({t.encode() for t in rarest}, {t.encode() for t in rarest | others}))

    def post(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with_context, wanted = shared.value
        for batch in batches:
            sizes, lists = [], []
            for text in batch["text"].tolist():
                words = word_bytes(text)
                sizes.append(len(words))
                lists.append(
                    [
                        (w.decode(), i, [x.decode() for x in words[max(0, i - radius) : i + radius + 1]] if w in with_context else None, min(i, radius))
                        for i, w in enumerate(words)
                        if w in wanted
                    ]
                )
            yield pd.DataFrame({"row_id": batch["row_id"], "doc_id": batch["doc_id"], "n_words": sizes, "radius": radius, "postings": lists})

    schema = f"row_id long, doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_words long, radius int, postings array<struct<term:string,pos:int,context:array<string>,place:int>>"
    if "row_id" not in docs.columns:
        docs = docs.withColumn("row_id", F.monotonically_increasing_id())
    return written(docs.select("row_id", "doc_id", F.col(text_col).alias("text")).mapInPandas(post, schema), "positional-index")


def _run(same: Column, length: Column) -> Column:
    """How many leading entries are true."""
    first_false = F.array_position(same, False)
    return F.when(first_false > 0, first_false - 1).otherwise(length)


def item_matches(index: DataFrame, lists: list[tuple], n: int, slop: int = 0) -> DataFrame:
    """``row_id``, ``item_id``, ``start``, ``length`` and ``exact`` of each match of the items' windows.

    Exact matches are runs of at least ``n`` item words in order (all of a
    shorter item).  With ``slop`` > 0, places where a rarest term has its
    window's words in any order, within the window's length plus ``slop`` to
    either side, are returned too, with ``exact`` false.  An index whose contexts
    are shorter than that raises an error.
    """
    kind = "item_id string, words array<string>, term string, offset int, nth int, alone boolean, starts array<int>"
    # One block of items: at most BLOCK_WINDOWS windows.
    wanted = index.sparkSession.createDataFrame(lists, kind)
    terms = wanted.select("item_id", "term", "offset", "nth", "alone", "starts")
    words = wanted.groupBy("item_id").agg(F.first("words").alias("words"))
    postings = index.select("row_id", "radius", F.explode("postings").alias("p")).select("row_id", "radius", "p.*")
    shifted = postings.join(F.broadcast(terms), "term").withColumn("shift", F.col("pos") - F.col("offset"))
    rarest = shifted.filter("nth = 0")
    key = ["row_id", "item_id", "shift"]
    both = rarest.join(shifted.filter("nth > 0").select(*key).distinct(), key, "left_semi")
    met = both.filter("not alone").unionByName(rarest.filter("alone"))
    left, right = F.least("place", "offset"), F.least(F.size("context") - F.col("place") - 1, F.size("words") - F.col("offset") - 1)
    before = F.zip_with(
        F.reverse(F.slice("context", F.col("place") - left + 1, left)), F.reverse(F.slice("words", F.col("offset") - left + 1, left)), lambda a, b: a == b
    )
    after = F.zip_with(F.slice("context", F.col("place") + 2, right), F.slice("words", F.col("offset") + 2, right), lambda a, b: a == b)
    matched = (
        met.join(F.broadcast(words), "item_id")
        .withColumn("l", _run(before, left))
        .withColumn("r", _run(after, right))
        .withColumn("length", (F.col("l") + F.col("r") + 1).cast("int"))
        .filter(F.col("length") >= F.least(F.size("words"), F.lit(n)))
        .select("row_id", "item_id", (F.col("pos") - F.col("l")).cast("int").alias("start"), "length", F.lit(True).alias("exact"))
    )
    if not slop:
        return matched
    reach = F.least(F.size("words"), F.lit(n)) - 1 + slop
    around = F.slice("context", F.greatest(F.col("place") - reach, F.lit(0)) + 1, F.least("place", reach) + reach + 1)
    # An item's windows that share the term are tested one by one.
    there = F.exists("starts", lambda at: F.size(F.array_except(F.slice("words", at + 1, n), around)) == 0)
    near = (
        rarest.join(F.broadcast(words), "item_id")
        .filter(F.when(F.col("radius") < reach, F.raise_error(F.lit("the index's contexts are shorter than context_radius(n, slop)")).cast("boolean")).otherwise(there))
        .select("row_id", "item_id", F.col("pos").alias("start"), F.lit(1).alias("length"), F.lit(False).alias("exact"))
    )
    return matched.unionByName(near)


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    n: int = 10,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    slop: int = 0,
) -> DataFrame:
    """Benchmark windows found in whole documents.

    A window is ``n`` consecutive words of an item; an item of fewer words is
    one window.  Returns for each document row: ``doc_id``, ``n_words``,
    ``n_hit`` (words inside any occurrence), ``n_items``, ``items_sha256`` (of the item
    ids, sorted as strings and comma-joined) and ``contaminated``.  Null or empty texts
    have no words and are clean; a null item id counts as ''; items without
    words match nothing; repeated rows get a row each; an empty benchmark leaves
    all documents clean.  Only the named columns are read.

    With ``slop`` > 0 there are also ``n_near`` (places of a window's rarest term that
    have the window's words in any order, see ``item_matches``; exact matches are such
    places too), ``n_near_items`` and ``near_items_sha256``; the other columns stay exact.
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    items = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item_id"), F.col(item_text_col).alias("text"))
    total = items.select(F.sum(F.greatest(F.size(words_column(F.col("text"))) - (n - 1), F.lit(1)))).first()[0] or 0
    blocks = max(1, -(-total // BLOCK_WINDOWS))
    if blocks > 1:  # row ids must agree between the blocks' indexes
        docs = written(docs.withColumn("row_id", F.monotonically_increasing_id()), "documents")
    sizes, matches = None, None
    for k in range(blocks):
        part = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).distinct().collect()
        # Items may share an id, so a number tells them apart.
        known = [(f"{i}:{r['item_id']}", words) for i, r in enumerate(part) if (words := words_of(r["text"]))]
        counts = term_counts(docs, "text", {t for _, words in known for t in words}) if known else {}
        lists = anchored(known, counts, n)
        index = build_index(docs, {r[2] for r in lists if r[4] == 0}, {r[2] for r in lists if r[4]}, context_radius(n, slop))
        found = item_matches(index, lists, n, slop).withColumn("item_id", F.regexp_replace("item_id", r"^\d+:", ""))
        sizes = index.select("row_id", "doc_id", "n_words") if sizes is None else sizes
        matches = found if matches is None else matches.unionByName(found)
    exact = matches.filter("exact")
    places = exact.select("row_id", "start", "length").distinct()
    hit = places.groupBy("row_id").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list(F.sequence("start", F.col("start") + F.col("length") - 1))))).cast("long").alias("n_hit")
    )
    out = sizes.join(hit, "row_id", "left").join(_items(exact, "n_items", "items"), "row_id", "left")
    columns = [
        "doc_id",
        "n_words",
        F.coalesce("n_hit", F.lit(0)).alias("n_hit"),
        F.coalesce("n_items", F.lit(0)).alias("n_items"),
        F.sha2(F.coalesce("items", F.lit("")), 256).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    ]
    if slop:
        near = matches.filter("not exact")
        n_near = near.select("row_id", "start").distinct().groupBy("row_id").agg(F.count(F.lit(1)).alias("n_near"))
        out = out.join(n_near, "row_id", "left").join(_items(near, "n_near_items", "near_items"), "row_id", "left")
        columns += [
            F.coalesce("n_near", F.lit(0)).alias("n_near"),
            F.coalesce("n_near_items", F.lit(0)).alias("n_near_items"),
            F.sha2(F.coalesce("near_items", F.lit("")), 256).alias("near_items_sha256"),
        ]
    return out.select(*columns)


def _items(matches: DataFrame, count: str, ids: str) -> DataFrame:
    """Each row's items: how many, and their sorted ids."""
    return matches.select("row_id", "item_id").distinct().groupBy("row_id").agg(
        F.count(F.lit(1)).alias(count), F.array_join(F.array_sort(F.collect_list("item_id")), ",").alias(ids)
    )
