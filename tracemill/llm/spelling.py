"""Spelling variants: near words by wildcard groups, without pairs.

Two words are near if they differ by one inserted, deleted or replaced code
point.  Every word is listed under its wildcard forms, one for each position
(what stands before it, what stands after it), and under its deletions (itself
without one code point).  Words that share a wildcard form differ there and
nowhere else, so the group's size and its two best words tell each member how
many others it has and which is the best of them.  A deletion that is itself a
word makes the two near: the word stands in the same group as the longer words
it is a deletion of.  What the groups say is combined by word, so no pair is
ever written down.  A group holds at most one word for each letter of the
alphabet and place, however many words there are.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracemill.llm.common import written

#: A task hands its counts on when it holds this many words (bounded memory; results do not depend on it).
FLUSH_WORDS = 400_000
#: Stands for any one code point; no word contains it.
WILD = "\u0000"

#: Latin-1 bytes of A-Z, a-z and U+00C0 to U+00FF, the first lower-cased; every other byte is a blank.
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 0xC0 else 32 for b in range(256))


def runs_of(text: str) -> list[bytes]:
    """Maximal runs of letters in Latin-1; what has no place in Latin-1 becomes a question mark, which ends a run."""
    return text.encode("latin-1", "replace").translate(_LETTERS).split()


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slips: int = 0, min_length: int = 5, min_count: int = 3) -> DataFrame:
    """``word`` and ``n``: the letter runs of all whole texts with how often they occur, lower-cased in A-Z only.

    With ``slips`` > 0 a run loses the code point h % length where h, the crc32 of
    ``<id>:<run>``, is divisible by it: made-up misspellings at a known rate.
    Words of fewer than ``min_length`` code points or ``min_count`` occurrences are
    left out.  Null and empty texts have no words, a null id is written as '',
    repeated rows count each for itself, an empty table gives no rows.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        met: Counter[bytes] = Counter()

        def handed() -> pd.DataFrame:
            out = pd.DataFrame({"word": [w.decode("latin-1") for w in met], "n": list(met.values())})
            met.clear()
            return out

        for batch in batches:
            for id_, text in zip(batch["id"], batch["text"]):
                runs = Counter(runs_of(text))
                begun = zlib.crc32(f"{id_}:".encode())
                for run, n in runs.items():
                    if slips:
                        h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), begun)
                        if h % slips == 0:
                            at = h % len(run)
                            run = run[:at] + run[at + 1 :]
                    if len(run) >= min_length:
                        met[run] += n
                if len(met) > FLUSH_WORDS:
                    yield handed()
        if met:
            yield handed()

    rows = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    found = rows.mapInPandas(count, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count)


def near_words(words: DataFrame) -> DataFrame:
    """``word``, ``n``, ``n_near`` (how many words are near) and ``best`` (``n``, ``word`` of the most frequent of them, ties to the smallest in code-point order; null if none).

    ``words`` has distinct ``word`` and ``n``.  One shuffle by group and one by word.
    """
    size = F.length("word")
    without = lambda put: F.transform(F.sequence(F.lit(1), size), lambda i: F.concat(F.substring("word", F.lit(1), i - 1), F.lit(put), F.substring("word", i + 1, size)))
    entry = F.struct((-F.col("n")).alias("r"), F.col("word").alias("w"))  # least first: most frequent, then smallest
    keys = F.when(size > 0, F.concat(F.array("word"), without(WILD), F.array_distinct(without("")))).otherwise(F.array("word"))
    listed = words.select("word", "n", F.explode(keys).alias("key")).select(
        "word", "n", "key", (F.col("key") == F.col("word")).alias("itself"), F.col("key").contains(WILD).alias("wild")
    )
    group = Window.partitionBy("key")
    other = F.when(~F.col("itself"), entry)
    first = listed.select("*", F.count(other).over(group).alias("size"), F.min(other).over(group).alias("first"), F.max(F.when(F.col("itself"), F.col("n"))).over(group).alias("own"))
    second = first.filter(F.col("itself") | (F.col("wild") & (F.col("size") > 1)) | F.col("own").isNotNull())
    second = second.withColumn("second", F.min(F.when(other != F.col("first"), other)).over(group))
    gap = ~F.col("wild")
    told = second.select(
        "word", "n",
        F.when(F.col("itself"), F.col("size")).when(gap, F.lit(1)).otherwise(F.col("size") - 1).alias("near"),
        F.when(F.col("itself"), F.col("first")).when(gap, F.struct((-F.col("own")).alias("r"), F.col("key").alias("w"))).when(F.col("first") != entry, F.col("first")).otherwise(F.col("second")).alias("best"),
    )
    return told.groupBy("word", "n").agg(F.sum("near").alias("n_near"), F.min("best").alias("best")).withColumn("best", F.when(F.col("best").isNotNull(), F.struct((-F.col("best.r")).alias("n"), F.col("best.w").alias("word"))))


def with_roots(forms: DataFrame) -> DataFrame:
    """Add ``root``: the last word met when ``form`` is followed from word to word; the word itself where it has none.

    Each form is more frequent than its word by a factor, so chains are short and
    have no circle; doubling takes the logarithm of their length in rounds, each stored.
    """
    now = written(forms.filter("form is not null").select("word", F.col("form").alias("root")), "forms")
    while True:
        further = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        jumped = written(now.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        now = jumped.select("word", "root")
        if jumped.filter("moved").isEmpty():
            break
    return forms.join(now, "word", "left").withColumn("root", F.coalesce("root", "word"))


def variant_groups(words: DataFrame, ratio: int = 2) -> DataFrame:
    """``word``, ``n``, ``form``, ``root``, ``n_near`` and ``form_n`` for distinct ``words`` (``word``, ``n``).

    A word's ``form`` is its most frequent near word, if that is at least ``ratio``
    (2 or more) times as frequent; else ``form`` and ``form_n`` are null.  Words without a
    near word have ``n_near`` 0 and are their own root; an empty table gives no rows.
    """
    chosen = F.col("best.n") >= ratio * F.col("n")
    forms = written(near_words(words).select("word", "n", "n_near", F.when(chosen, F.col("best.word")).alias("form"), F.when(chosen, F.col("best.n")).alias("form_n")), "near-words")
    return with_roots(forms).select("word", "n", "form", "root", "n_near", "form_n")
