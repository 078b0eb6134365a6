"""Toxicity: non-negative positive-unlabelled learning on hashed words and word beginnings."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.llm.common import crc_mod, written
from tracemill.llm.decontamination import word_bytes

BUCKETS = 1 << 18
#: Confirmed toxic and unlabelled documents that training reads at most, chosen by hash of the id.
MOST_POSITIVE, MOST_UNLABELLED = 4_000, 16_000
#: Only features whose share differs between confirmed and unlabelled by so many standard errors carry weight, and at most so many.
LEAST_Z, MOST_FEATURES = 4.0, 5_000
#: Lengths of the word beginnings that are features beside the word.
BEGINNINGS = (4, 5, 6)
STEPS, RATE, L2 = 400, 0.05, 1e-5
#: A worker's word buckets are emptied at this many (bounded memory; results do not depend on it).
LEXICON_ENTRIES = 500_000

_buckets: dict[bytes, tuple[int, ...]] = {}


def word_features(word: bytes) -> tuple[int, ...]:
    """Buckets of a word and of its beginnings."""
    parts = {word, *(word[:n] + b"-" for n in BEGINNINGS if len(word) >= n)}
    return tuple({xxhash.xxh64_intdigest(x) % BUCKETS for x in parts})


def text_features(text: str | None) -> list[int]:
    """Buckets of a text's distinct lower-cased words, once for each word that has them."""
    words = set(word_bytes(text))
    if len(_buckets) > LEXICON_ENTRIES:
        _buckets.clear()
    for w in words:
        if w not in _buckets:
            _buckets[w] = word_features(w)
    return [b for w in words for b in _buckets[w]]


class Linear:
    """Sums of word weights over a text's distinct words."""

    def __init__(self, weights: dict[int, float], bias: float):
        self.weights, self.bias = weights, bias
        self.words: dict[bytes, float] = {}

    def raw(self, text: str | None) -> float:
        words = set(word_bytes(text))
        if len(self.words) > LEXICON_ENTRIES:
            self.words.clear()
        get = self.weights.get
        for w in words:
            if w not in self.words:
                self.words[w] = math.fsum(get(b, 0.0) for b in word_features(w))
        return math.fsum(map(self.words.__getitem__, words))  # exact, so a set's order does not matter

    def scores(self, texts: list[str | None]) -> np.ndarray:
        raw = np.array([self.raw(t) for t in texts]) + self.bias
        return 1 / (1 + np.exp(-np.clip(raw, -35, 35)))


class Sparse:
    """Rows of columns with value 1; repeated columns add up."""

    def __init__(self, rows: list[np.ndarray]):
        self.n = len(rows)
        self.columns = np.concatenate(rows) if rows else np.zeros(0, np.int64)
        self.row = np.repeat(np.arange(self.n), [len(r) for r in rows])

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, w[self.columns], self.n)

    def back(self, v: np.ndarray, size: int) -> np.ndarray:
        return np.bincount(self.columns, v[self.row], size)


def fit_nnpu(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float) -> Linear:
    """Minimise the non-negative estimate of the logistic risk.

    With class prior p the negatives' risk is that of the unlabelled less p times
    that of the positives taken for negatives.  Where the estimate falls under
    zero, the step goes up that part's gradient instead, so that the positives
    are not fitted at the unlabelled's cost.  Without positives all scores are
    the prior.
    """
    prior = min(max(prior, 1e-4), 0.99)
    bias = float(np.log(prior / (1 - prior)))
    if not positive or not unlabelled:
        return Linear({}, bias)
    used = np.unique(np.concatenate([*positive, *unlabelled]))
    size = len(used)
    p, u = (Sparse([np.searchsorted(used, r) for r in rows]) for rows in (positive, unlabelled))
    theta, m, v = np.zeros(size + 1), np.zeros(size + 1), np.zeros(size + 1)
    theta[-1] = bias
    for step in range(1, STEPS + 1):
        sp = 1 / (1 + np.exp(-(p.dot(theta[:-1]) + theta[-1])))
        su = 1 / (1 + np.exp(-(u.dot(theta[:-1]) + theta[-1])))
        negative = -np.log1p(-np.minimum(su, 1 - 1e-12)).mean() + prior * np.log1p(-np.minimum(sp, 1 - 1e-12)).mean()
        g_pos, g_pos_as_neg, g_unl = prior * (sp - 1) / p.n, prior * sp / p.n, su / u.n
        if negative >= 0:
            gp, gu = g_pos - g_pos_as_neg, g_unl
        else:
            gp, gu = g_pos_as_neg, -g_unl
        grad = np.append(p.back(gp, size) + u.back(gu, size) + L2 * theta[:-1], gp.sum() + gu.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        theta -= RATE / (1 + 0.01 * step) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Linear(dict(zip(used.tolist(), theta[:-1].tolist())), float(theta[-1]))


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", most_positive: int = MOST_POSITIVE, most_unlabelled: int = MOST_UNLABELLED) -> Linear:
    """Fit on confirmed toxic documents and unlabelled text.

    The class prior is the share of toxic among the given labels.  Both samples
    are bounded; their ids (bounded likewise) are broadcast to read the texts.
    """
    known = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).alias("y"))
    n, toxic = known.agg(F.count(F.lit(1)), F.sum((F.col("y") == 1).cast("long"))).first()
    toxic = toxic or 0
    part = lambda most, of: F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1_000_000 * min(1, most / max(1, of)))
    confirmed = known.filter("y = 1").filter(part(most_positive, toxic)).select("doc_id", F.lit(True).alias("confirmed"))
    rows = docs.filter("doc_id is not null").select("doc_id", "text")
    share = part(most_unlabelled, rows.count())

    # What is not in the bounded list of confirmed ids is unlabelled, whatever its label says.
    read = rows.join(F.broadcast(confirmed), "doc_id", "left").filter(F.col("confirmed") | share)
    sample = written(read.select("doc_id", F.coalesce("confirmed", F.lit(False)).alias("confirmed"), share.alias("mixture"), "text"), "toxicity-sample")
    every = F.pandas_udf(lambda texts: pd.Series([sorted(set(text_features(t))) for t in texts.tolist()]), "array<int>")
    sure = F.col("confirmed").cast("long")
    drawn = F.col("mixture").cast("long")
    n_sure, n_rest = sample.agg(F.sum(sure), F.sum(drawn)).first()
    if not n_sure or not n_rest:
        return fit_nnpu([], [], toxic / n if n else 0.01)
    # The unlabelled side is a random share of all texts, confirmed ones among them: the mixture that the risk estimate assumes.
    a, b = F.col("p") / n_sure, F.col("u") / n_rest
    z = (a - b) / F.sqrt(F.greatest(b * (1 - b), F.lit(1.0 / n_rest)) * (1.0 / n_sure + 1.0 / n_rest))
    counted = sample.select("confirmed", "mixture", F.explode(every("text")).alias("bucket")).groupBy("bucket").agg(F.sum(sure).alias("p"), F.sum(drawn).alias("u"))
    best = counted.filter("p + u > 2").withColumn("z", z).filter(F.abs("z") >= LEAST_Z).orderBy(F.desc(F.abs("z")), "bucket").limit(MOST_FEATURES)
    chosen = frozenset(r["bucket"] for r in best.select("bucket").collect())
    kept = F.pandas_udf(lambda texts: pd.Series([[b for b in text_features(t) if b in chosen] for t in texts.tolist()]), "array<int>")
    got = sample.select("doc_id", "confirmed", "mixture", kept("text").alias("b")).toPandas().sort_values("doc_id", kind="stable")
    lists = [np.asarray(b, np.int64) for b in got["b"]]
    return fit_nnpu([b for b, s in zip(lists, got["confirmed"]) if s], [b for b, s in zip(lists, got["mixture"]) if s], toxic / n)


def score_toxicity(docs: DataFrame, model: Linear, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and ``score`` of every row.

    Null and empty texts have no words and score as the bias alone; repeated
    rows score alike; ids are only passed through.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(shared.value.scores(texts.tolist()))

    return docs.select(F.col(id_col).alias("doc_id"), predict(F.col(text_col)).alias("score"))


def held_out_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Scores of all documents by a model whose labels come from those with crc32(doc_id) mod 5 not 0."""
    held_out = crc_mod("doc_id", 5) == 0
    model = train(docs.filter(~held_out), labels.filter(~held_out))
    found = score_toxicity(docs, model)
    return found.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
