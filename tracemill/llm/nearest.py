"""Nearest vectors by collision counting over single-projection sorted arrays.

Largest inner product becomes least distance by one further coordinate (vectors
scaled to the largest norm, queries to unit length).  A block holds vectors of
like norms, so one very long vector does not press the others together.  In each
block every projection keeps its sorted values.  A query opens a window around its own
value in each of them; a vector collides once for every window it lies in.  A
first narrow round verifies the vectors with most collisions and so bounds the
distance of the k-th nearest; the windows then widen (virtual rehashing) to the
width at which a vector at that distance would pass the collision threshold with
the chosen confidence, and every vector that passes is verified exactly.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PROJECTIONS = 128
#: Half the first window's width, for distances from 0 to 2.
FIRST_WIDTH = 0.5
#: Vectors verified after the first round.
FIRST_VERIFIED = 64
#: Share of the projections in which a vector must collide, and standard deviations of safety under it.
THRESHOLD, SAFETY = 0.55, 1.5
#: Norms of a block differ by a factor of at most 2 ** (1 / SCALES_PER_DOUBLING).
SCALES_PER_DOUBLING = 2
#: Vectors and queries in a block: what one task holds.
BLOCK_VECTORS, BLOCK_QUERIES = 8192, 2048

_normal = NormalDist()


def usable(v: Column) -> Column:
    """Neither null, empty nor zero, all components finite."""
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return v.isNotNull() & (F.size(v) > 0) & ~F.coalesce(bad, F.lit(True)) & F.exists(v, lambda x: x != 0)


def scale_of(v: Column) -> Column:
    """Number of the range of norms that a vector is in; a double's exponents allow some 4,300 of them."""
    squares = F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x)
    # Norms of 1, give or take rounding, lie inside a range; where squares leave a double's range the largest component will do.
    by_norm = F.floor(SCALES_PER_DOUBLING / 2 * F.log2(squares) + 0.25)
    return F.when(squares.between(1e-280, 1e300), by_norm).otherwise(F.floor(SCALES_PER_DOUBLING * F.log2(F.array_max(F.transform(v, F.abs)))))


def unit(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each vector's direction, its largest component and its norm in multiples of that (no overflow)."""
    largest = np.abs(vectors).max(axis=1, keepdims=True)
    part = vectors / largest
    norms = np.linalg.norm(part, axis=1, keepdims=True)
    return part / norms, largest, norms


def width_at(distance: np.ndarray) -> np.ndarray:
    """Half-width at which a vector so far away passes the threshold with the confidence of SAFETY."""
    p = THRESHOLD
    for _ in range(20):
        p = THRESHOLD + SAFETY * math.sqrt(p * (1 - p) / PROJECTIONS)
    return distance * _normal.inv_cdf((1 + p) / 2)


class Block:
    """Sorted arrays of one block of vectors."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.vectors = ids, vectors
        directions, largest, norms = unit(vectors)
        sizes = largest / largest.max() * norms
        self.scaled = scaled = directions * (sizes / sizes.max())
        rest = np.sqrt(np.maximum(0, 1 - (scaled**2).sum(axis=1)))
        self.axes = np.random.default_rng(7).standard_normal((vectors.shape[1] + 1, PROJECTIONS))
        values = np.hstack([scaled, rest[:, None]]) @ self.axes
        order = np.argsort(values, axis=0, kind="stable").T
        self.sorted = np.sort(values, axis=0).T.copy()
        # A vector's place in each sorted array: it lies in a window if its place does.
        self.places = np.empty(order.shape, np.uint16)
        np.put_along_axis(self.places, order, np.arange(len(ids), dtype=np.uint16)[None, :], axis=1)
        self.shifted, self.inside = np.empty_like(self.places), np.empty(self.places.shape, bool)

    def spans(self, at: np.ndarray, width: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        lo = np.stack([np.searchsorted(s, at[:, j] - width, "left") for j, s in enumerate(self.sorted)], axis=1)
        hi = np.stack([np.searchsorted(s, at[:, j] + width, "right") for j, s in enumerate(self.sorted)], axis=1)
        return lo, hi

    def collisions(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """In how many windows [lo, hi) of the sorted arrays each vector lies."""
        np.subtract(self.places, lo.astype(np.uint16)[:, None], out=self.shifted)
        np.less(self.shifted, (hi - lo).astype(np.uint16)[:, None], out=self.inside)
        return np.add.reduce(self.inside.view(np.uint8), axis=0, dtype=np.uint8)

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        n = len(self.ids)
        directions = unit(queries)[0]
        at = directions @ self.axes[:-1]
        lo, hi = self.spans(at, np.full(len(queries), FIRST_WIDTH))
        some = min(n, FIRST_VERIFIED)
        bounds, first = np.full(len(queries), 2.0), []
        for i in range(len(queries)):
            count = self.collisions(lo[i], hi[i])
            best = np.argpartition(count, n - some)[n - some :] if some < n else np.arange(n)
            best = best[self.ids[best] != query_ids[i]]
            first.append(best)
            cosines = np.sort(self.scaled[best] @ directions[i])
            if len(cosines) >= k:
                bounds[i] = math.sqrt(max(0.0, 2 - 2 * cosines[-k]))
        lo, hi = self.spans(at, np.maximum(width_at(bounds), FIRST_WIDTH))
        need = math.ceil(THRESHOLD * PROJECTIONS)
        for i in range(len(queries)):
            passed = self.collisions(lo[i], hi[i]) >= need
            # The first round's best stay in, so there are never fewer than k.
            passed[first[i]] = True
            found = np.flatnonzero(passed & (self.ids != query_ids[i]))
            scores = self.vectors[found] @ queries[i]
            if len(found) > k:
                top = np.flatnonzero(scores >= np.partition(scores, len(found) - k)[len(found) - k])
                found, scores = found[top], scores[top]
            best = np.lexsort((self.ids[found], -scores))[:k]
            yield int(query_ids[i]), self.ids[found][best], scores[best]


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The ``k`` rows of largest inner product for each query row, searched among all other rows.

    ``is_query`` is a condition on ``vec_id``.  Returns ``query_id``, ``rank`` (from 1), ``vec_id`` and
    ``score`` (double, of the original vectors), nearest first, ties to the smaller id.  Vectors that are null, zero or hold null
    or non-finite components take no part, nor do null ids; of rows that share
    an id the least vector counts; vectors of another length than most take no
    part; with fewer than ``k`` others all are returned.  Approximate: a vector
    as near as the k-th found of its block is missed with a chance of about one in fifteen, nearer ones
    with less.  Vectors and queries meet in blocks of bounded size; a block's vectors have norms of one range.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v")).filter(F.col("vec_id").isNotNull() & usable(F.col("v")))
    rows = rows.groupBy("vec_id").agg(F.min("v").alias("v"))
    counted = rows.groupBy(F.size("v").alias("d"), scale_of(F.col("v")).alias("scale")).agg(F.count(F.lit(1)).alias("n"), F.sum(is_query.cast("long")).alias("q"))
    sizes = counted.groupBy("d").agg(F.sum("n").alias("n"), F.sum("q").alias("q"), F.sort_array(F.collect_list(F.struct("scale", "n"))).alias("scales"))
    most = sizes.orderBy(F.desc("n"), "d").first()
    spark, schema = vectors.sparkSession, "query_id long, vec_id long, score double"
    if most is None or not most["q"]:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = rows.filter(F.size("v") == most["d"])
    # Each range of norms is dealt into blocks by hash; the ranges are no more than a double's exponents allow, hence broadcast.
    dealt, v_blocks = [], 0
    for scale, n in most["scales"]:
        dealt.append((scale, v_blocks, -(-n // BLOCK_VECTORS)))
        v_blocks += dealt[-1][2]
    ranges = F.broadcast(spark.createDataFrame(dealt, "scale long, first long, parts long"))
    q_blocks = -(-most["q"] // BLOCK_QUERIES)
    key = F.xxhash64("vec_id")
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    placed = rows.withColumn("scale", scale_of(F.col("v"))).join(ranges, "scale")
    blocks = placed.select((F.col("first") + F.pmod(key, F.col("parts"))).alias("vb"), every(q_blocks).alias("qb"), "vec_id", "v")
    asked = rows.filter(is_query).select(every(v_blocks).alias("vb"), F.pmod(key, F.lit(q_blocks)).alias("qb"), F.col("vec_id").alias("query_id"), F.col("v").alias("q"))

    def search(_, block: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if block.empty or queries.empty:
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        held = Block(block["vec_id"].to_numpy(), np.stack(block["v"].tolist()))
        out = [(np.full(len(ids), q), ids, s) for q, ids, s in held.search(queries["query_id"].to_numpy(), np.stack(queries["q"].tolist()), k)]
        q, ids, s = map(np.concatenate, zip(*out))
        return pd.DataFrame({"query_id": q, "vec_id": ids, "score": s})

    tasks = v_blocks * q_blocks
    met = blocks.repartition(tasks, "vb", "qb").groupBy("vb", "qb").cogroup(asked.repartition(tasks, "vb", "qb").groupBy("vb", "qb")).applyInPandas(search, schema)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return met.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
