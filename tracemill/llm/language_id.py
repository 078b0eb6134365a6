"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.llm.common import crc_mod

#: N-gram lengths and hash buckets.
ORDERS, BUCKETS = (1, 2, 3), 1 << 15
#: Labelled documents that training reads at most, chosen by hash of the id.
TRAIN_DOCUMENTS = 20_000
#: Characters handled at once.
STREAM_CHARS = 1_000_000
SMOOTHING = 0.5

_fold: np.ndarray | None = None


def folded() -> np.ndarray:
    """For each code point its lower-case letter, or 0 for anything but a letter."""
    global _fold
    if _fold is None:
        table = np.zeros(0x110000, np.uint32)
        for c in range(0x110000):
            ch = chr(c)
            if ch.isalpha():
                low = ch.lower()
                table[c] = ord(low) if len(low) == 1 else c
        _fold = table
    return _fold


def streams(texts: list[str | None]) -> Iterator[tuple[list[int], str, np.ndarray]]:
    """Texts joined by blanks, a bounded number of characters at a time (a longer text comes alone)."""
    at = 0
    while at < len(texts):
        held, size = [], 0
        while at < len(texts) and (not held or size + len(texts[at] or "") < STREAM_CHARS):
            held.append(at)
            size += len(texts[at] or "") + 1
            at += 1
        yield held, " ".join(texts[i] or "" for i in held) + " ", np.cumsum([len(texts[i] or "") + 1 for i in held])


def ngrams(stream: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(place, bucket) of the n-grams of each order; those without a letter at the first place are left out.

    Words are separated by one mark whatever stood between them, and an n-gram
    may begin or end with the mark.
    """
    letters = folded()[np.frombuffer(stream.encode("utf-32-le"), "<u4")].astype(np.uint64)
    # Runs of other characters count as one mark.
    keep = np.ones(len(letters), bool)
    keep[1:] = (letters[1:] > 0) | (letters[:-1] > 0)
    place, letters = np.flatnonzero(keep), letters[keep]
    h = np.zeros(len(letters), np.uint64)
    for n in range(1, max(ORDERS) + 1):
        m = len(letters) - n + 1
        if m <= 0:
            return
        h = (h[:m] ^ letters[n - 1 :]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(32)
        if n in ORDERS:
            has = letters[:m] > 0 if n == 1 else (letters[:m] > 0) | (letters[1 : m + 1] > 0)
            yield place[:m][has], ((h[has] * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - 15)).astype(np.int64)


def train(labelled: DataFrame, most: int = TRAIN_DOCUMENTS) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages, log priors and the log-probability matrix (bucket, language).

    ``labelled`` has ``text`` and ``lang``.  Counts per language and bucket are summed
    by Spark; the sums (languages times buckets) are all that reaches the driver.
    ``most`` bounds the documents read; they are chosen by hash of their text.
    """
    rows = labelled.filter("lang is not null and text is not null")
    total = rows.count()
    if total > most:
        rows = rows.filter(F.pmod(F.xxhash64("text", "lang"), F.lit(1_000_000)) < int(1_000_000 * most / total))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}
        docs: dict[str, int] = {}
        for batch in batches:
            for lang, part in batch.groupby("lang"):
                texts = part["text"].tolist()
                docs[lang] = docs.get(lang, 0) + len(texts)
                mine = sums.setdefault(lang, np.zeros(BUCKETS, np.int64))
                for _, stream, _ in streams(texts):
                    for _, bucket in ngrams(stream):
                        mine += np.bincount(bucket, minlength=BUCKETS)
        for lang, mine in sums.items():
            at = np.flatnonzero(mine)
            if len(at):
                yield pd.DataFrame({"lang": lang, "bucket": at, "n": mine[at]})
            yield pd.DataFrame({"lang": [lang], "bucket": [-1], "n": [docs[lang]]})

    summed = rows.select("lang", "text").mapInPandas(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(summed["lang"].unique())
    counts, docs = np.full((BUCKETS, len(langs)), SMOOTHING), np.zeros(len(langs))
    for j, lang in enumerate(langs):
        mine = summed[summed["lang"] == lang]
        seen = mine[mine["bucket"] >= 0]
        counts[seen["bucket"].to_numpy(), j] += seen["n"].to_numpy()
        docs[j] = mine.loc[mine["bucket"] < 0, "n"].sum()
    return langs, np.log(docs / max(1, docs.sum())) if len(langs) else docs, np.log(counts / counts.sum(axis=0)) if len(langs) else counts


def scored(texts: list[str | None], langs: list[str], priors: np.ndarray, matrix: np.ndarray) -> tuple[list[str], np.ndarray]:
    """Most probable language and its posterior probability for each text."""
    names, scores = ["und"] * len(texts), np.zeros(len(texts))
    if not langs:
        return names, scores
    for held, stream, ends in streams(texts):
        sums = np.tile(priors, (len(held), 1))
        letters = np.zeros(len(held), np.int64)
        for k, (place, bucket) in enumerate(ngrams(stream)):
            owner = np.searchsorted(ends, place, "right")
            cuts = np.searchsorted(owner, np.arange(len(held) + 1))
            some = np.flatnonzero(np.diff(cuts))
            if k == 0:
                letters = np.diff(cuts)
            if len(some):
                sums[some] += np.add.reduceat(matrix[bucket], cuts[:-1][some], axis=0)
        best = sums.argmax(axis=1)
        p = 1 / np.exp(sums - sums.max(axis=1, keepdims=True)).sum(axis=1)
        for i, b, s, n in zip(held, best.tolist(), p.tolist(), letters.tolist()):
            if n:
                names[i], scores[i] = langs[b], s
    return names, scores


def identify(docs: DataFrame, labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = TRAIN_DOCUMENTS) -> DataFrame:
    """``doc_id``, ``lang_pred`` and ``score`` of every row, from a model trained on ``labelled`` (``text``, ``lang``).

    A text that is null or has no letter is ``und`` with score 0, and so is every text if
    nothing is labelled.  Ids are only passed through; repeated rows score
    alike; ties go to the language first in the alphabet.
    """
    model = docs.sparkSession.sparkContext.broadcast(train(labelled, most))

    @F.pandas_udf("lang_pred string, score double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            names, scores = scored(texts.tolist(), *model.value)
            yield pd.DataFrame({"lang_pred": names, "score": scores})

    return docs.select(F.col(id_col).alias("doc_id"), predict(F.col(text_col)).alias("p")).select("doc_id", "p.*")


def held_out_identify(docs: DataFrame) -> DataFrame:
    """Predictions for all documents from those whose crc32(doc_id) mod 3 is not 1, with ``held_out``."""
    held_out = crc_mod("doc_id", 3) == 1
    found = identify(docs, docs.filter(~held_out).select("text", "lang"))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
