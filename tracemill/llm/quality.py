"""Quality scores: histogram gradient-boosted trees over document statistics."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.llm.common import bounded_batches, crc_mod

#: Labelled documents that training reads at most, chosen by hash of the id.
TRAIN_DOCUMENTS = 20_000
ROUNDS, DEPTH, BINS, RATE, L2, LEAST_WEIGHT = 80, 4, 64, 0.2, 1.0, 5.0

FEATURES = (
    "log_bytes", "log_words", "word_length", "word_length_spread", "upper", "digits", "blanks", "commas_stops", "symbols", "bars", "exclamations",
    "non_ascii", "distinct_words", "top_word", "repeated_next", "log_lines", "repeated_lines", "line_length", "one_letter_words", "top_byte", "entropy",
    "distinct_bytes", "capital_starts", "shortest_cover",
)


def _mask(chars: bytes) -> np.ndarray:
    m = np.zeros(256)
    m[list(chars)] = 1
    return m


_upper, _digits, _blanks = _mask(bytes(range(65, 91))), _mask(b"0123456789"), _mask(b" \t\n\r\x0b\x0c")
_stops, _bars, _bangs = _mask(b".,"), _mask(b"|"), _mask(b"!")
_symbols = _mask(bytes(c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in ".,|!"))
_high = _mask(bytes(range(128, 256)))


def statistics(text: str | None) -> list[float]:
    """The features of a text; an empty one has all zeros."""
    data = text.encode() if text else b""
    words = data.split()
    if not words:
        return [0.0] * len(FEATURES)
    n, m = len(data), len(words)
    hist = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    share = hist / n
    some = share[share > 0]
    sizes = np.fromiter(map(len, words), np.int64, m)
    counts = Counter(words)
    lines = data.split(b"\n")
    top = counts.most_common(10)
    return [
        float(np.log1p(n)), float(np.log1p(m)), float(sizes.mean()), float(sizes.std()), float(share @ _upper), float(share @ _digits),
        float(share @ _blanks), float(share @ _stops), float(share @ _symbols), float(share @ _bars), float(share @ _bangs), float(share @ _high),
        len(counts) / m, top[0][1] / m, sum(map(eq, words, words[1:])) / m, float(np.log1p(len(lines))), 1 - len(set(lines)) / len(lines),
        n / len(lines), float((sizes == 1).mean()), float(share.max()), float(-(some * np.log2(some)).sum()), float(len(some)),
        sum(w[:1].isupper() for w in words) / m, sum(c for _, c in top) / m,
    ]


def feature_matrix(texts: list[str | None]) -> np.ndarray:
    return np.array([statistics(t) for t in texts], np.float64).reshape(-1, len(FEATURES))


class Trees:
    """Complete binary trees in flat arrays; a node's children are 2i + 1 and 2i + 2."""

    def __init__(self, base: float, feature: np.ndarray, cut: np.ndarray, value: np.ndarray):
        self.base, self.feature, self.cut, self.value = base, feature, cut, value

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, cut, value in zip(self.feature, self.cut, self.value):
            node = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            out += value[node - (2**DEPTH - 1)]
        return out

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x), -35, 35)))


def fit_trees(x: np.ndarray, y: np.ndarray) -> Trees:
    """Logistic boosting with second-order gains on quantile bins.

    Without both labels the model is a constant (0.5 without any row).
    """
    n, d = x.shape
    positive = float(y.mean()) if n else 0.5
    empty = np.zeros((0, 2**DEPTH - 1))
    if not n or positive in (0.0, 1.0):
        p = min(max((positive * n + 1) / (n + 2), 0.01), 0.99) if n else 0.5
        return Trees(float(np.log(p / (1 - p))), empty.astype(np.int64), empty, np.zeros((0, 2**DEPTH)))
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(d)]
    binned = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], axis=1)
    base = float(np.log(positive / (1 - positive)))
    raw = np.full(n, base)
    features, cuts, values = [], [], []
    for _ in range(ROUNDS):
        p = 1 / (1 + np.exp(-raw))
        g, h = p - y, np.maximum(p * (1 - p), 1e-6)
        feature, cut = np.zeros(2**DEPTH - 1, np.int64), np.full(2**DEPTH - 1, np.inf)
        node = np.zeros(n, np.int64)
        for level in range(DEPTH):
            width, first = 2**level, 2**level - 1
            at = node - first
            gs = np.stack([np.bincount(at * BINS + binned[:, j], g, width * BINS).reshape(width, BINS) for j in range(d)], axis=1)
            hs = np.stack([np.bincount(at * BINS + binned[:, j], h, width * BINS).reshape(width, BINS) for j in range(d)], axis=1)
            gl, hl = gs.cumsum(axis=2), hs.cumsum(axis=2)
            gt, ht = gl[:, :, -1:], hl[:, :, -1:]
            gain = gl**2 / (hl + L2) + (gt - gl) ** 2 / (ht - hl + L2) - gt**2 / (ht + L2)
            gain[(hl < LEAST_WEIGHT) | (ht - hl < LEAST_WEIGHT)] = 0
            for k in range(width):
                j, b = divmod(int(gain[k].argmax()), BINS)
                if gain[k, j, b] > 1e-9 and b < len(edges[j]):
                    feature[first + k], cut[first + k] = j, edges[j][b]
            node = 2 * node + 1 + (x[np.arange(n), feature[node]] > cut[node])
        leaf = node - (2**DEPTH - 1)
        value = -RATE * np.bincount(leaf, g, 2**DEPTH) / (np.bincount(leaf, h, 2**DEPTH) + L2)
        raw += value[leaf]
        features.append(feature)
        cuts.append(cut)
        values.append(value)
    return Trees(base, np.array(features), np.array(cuts), np.array(values))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, most: int) -> DataFrame:
    """``text`` and ``y`` of at most about ``most`` labelled documents, chosen by hash of the id.

    The chosen labels are bounded by ``most`` rows of an id and a number, hence broadcast.
    """
    bounded_batches(docs.sparkSession)
    known = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).alias("y"))
    total = known.count()
    if total > most:
        known = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1_000_000 * most / total))
    return docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").select("text", F.col("y").cast("double").alias("y"))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = TRAIN_DOCUMENTS) -> Trees:
    """Fit on the features of a bounded sample; only features and labels reach the driver."""

    def featured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"x": [*feature_matrix(batch["text"].tolist())], "y": batch["y"]})

    got = labelled_sample(docs, labels, label, most).mapInPandas(featured, "x array<double>, y double").toPandas()
    x = np.stack(got["x"].tolist()) if len(got) else np.zeros((0, len(FEATURES)))
    order = np.lexsort((*x.T, got["y"].to_numpy()))  # the model must not depend on the rows' order
    return fit_trees(x[order], got["y"].to_numpy()[order])


def score_quality(docs: DataFrame, model: Trees, id_col: str = "doc_id", text_col: str = "text", keep: bool = False) -> DataFrame:
    """``doc_id`` and ``score`` of every row (with ``keep``, all columns and ``score``).

    Null and empty texts have all features zero and get a score like any other;
    repeated rows score alike; ids are only passed through.
    """
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(shared.value.scores(feature_matrix(texts.tolist())))

    if keep:
        return docs.withColumn("score", predict(F.col(text_col)))
    return docs.select(F.col(id_col).alias("doc_id"), predict(F.col(text_col)).alias("score"))


def held_out_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Scores of all documents by a model of those whose crc32(doc_id) mod 3 is not 1."""
    held_out = crc_mod("doc_id", 3) == 1
    model = train(docs, labels.filter(~held_out))
    found = score_quality(docs, model)
    return found.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
