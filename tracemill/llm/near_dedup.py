"""Near-duplicate groups: banded MinHash with sequential Bayesian verification.

Documents with one and the same shingle set form a class, which one of them
stands for.  Bands of the classes' signatures give candidate buckets.  In each
bucket the most central member (the one with the fullest buckets) is paired
with the others first; once those links have joined classes into components,
only pairs across components are left to look at, and of those only pairs with
a rare shingle in common, so a group of thousands of near copies costs one star
and not all its pairs.  Candidate pairs are compared
one batch of signature rows at a time and dropped as soon as the posterior
probability of enough similarity falls under the chosen miss probability.
Survivors are verified on their full shingle sets.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.llm.common import bounded_batches, hot_join, row_key, written
from tracemill.llm.components import connected_components

#: A pair at the threshold shares no band with probability (1 - 0.85 ** 5) ** 25 < 5e-7.
BANDS, ROWS = 25, 5
HASHES = 128
#: Signature rows compared at a time, and the probability of dropping a true pair that is put up with.
BATCH, MISS = 16, 1e-6
#: A worker's word hashes are emptied at this many (bounded memory; results do not depend on it).
LEXICON_ENTRIES = 300_000
#: Rows of a shingle that one task pairs.
SHINGLE_ROWS = 1000

_rng = np.random.default_rng(20240301)
_multipliers = _rng.integers(1, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_mix = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]
_words: dict[bytes, int] = {}


def shingle_sets(texts: list[str | None], size: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's word shingles."""
    split = [t.encode().lower().split() if t else [] for t in texts]
    if len(_words) > LEXICON_ENTRIES:
        _words.clear()
    for w in set().union(*split):
        if w not in _words:
            _words[w] = xxhash.xxh64_intdigest(w)
    flat = np.fromiter((x for ws in split for x in map(_words.__getitem__, ws)), np.uint64)
    found, at = [], 0
    for ws in split:
        h = flat[at : at + len(ws)]
        at += len(ws)
        k = min(size, len(ws))
        if not k:
            found.append(np.zeros(0, np.uint64))
            continue
        s = np.full(len(h) - k + 1, k, np.uint64)
        for j in range(k):
            s = (s ^ h[j : len(h) - k + 1 + j]) * _mix[j % 3]
            s ^= s >> np.uint64(29)
        s = (s ^ (s >> np.uint64(31))) * _mix[3]
        s = (s ^ (s >> np.uint64(27))) * _mix[4]
        found.append(np.unique(s ^ (s >> np.uint64(31))))
    return found


def signature(shingles: np.ndarray) -> np.ndarray:
    """The leading 32 bits of each hash's least value."""
    least = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 2048):
        part = shingles[at : at + 2048]
        np.minimum(least, (part[None, :] * _multipliers[:, None]).min(axis=1), out=least)
    return (least >> np.uint64(32)).astype(np.uint32)


def fewest_matches(threshold: float, miss: float = MISS) -> list[tuple[int, int]]:
    """(rows compared, fewest equal rows that keep a pair).

    With a uniform prior the similarity after m equal rows of n follows
    Beta(m + 1, n - m + 1); its tail above t is the chance that a binomial of
    n + 1 draws at t is at most m.
    """
    table = []
    for n in range(BATCH, HASHES + 1, BATCH):
        tail, m = 0.0, -1
        while tail < miss:
            m += 1
            tail += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        table.append((n, m))
    return table


def signatures(docs: DataFrame, size: int, id_col: str, text_col: str) -> DataFrame:
    """``doc_id``, ``row_id``, ``n``, ``set_key`` (128-bit digest of the shingle set) and ``sig`` of each row."""
    bounded_batches(docs.sparkSession)

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = batch["text"].tolist()
            ns, keys, sigs = [], [], []
            for at in range(0, len(texts), 64):
                for s in shingle_sets(texts[at : at + 64], size):
                    ns.append(len(s))
                    keys.append(hashlib.blake2b(s.tobytes(), digest_size=16).hexdigest())
                    sigs.append(signature(s).tobytes() if len(s) else None)
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "row_id": batch["row_id"], "n": ns, "set_key": keys, "sig": sigs})
        _words.clear()

    rows = docs.select(F.col(id_col).alias("doc_id"), row_key(id_col, text_col).alias("row_id"), F.col(text_col).alias("text"))
    return rows.mapInPandas(sign, "doc_id long, row_id binary, n long, set_key string, sig binary")


def band_members(classes: DataFrame) -> DataFrame:
    """``bucket``, ``node`` and ``score`` of classes that share a bucket with another class."""

    @F.pandas_udf("array<long>")
    def keys(sigs: pd.Series) -> pd.Series:
        m = np.frombuffer(b"".join(sigs), np.uint32).reshape(-1, HASHES).astype(np.uint64)
        h = np.zeros((len(m), BANDS), np.uint64) + np.arange(1, BANDS + 1, dtype=np.uint64)
        grid = m[:, : BANDS * ROWS].reshape(-1, BANDS, ROWS)
        for j in range(ROWS):
            h = (h ^ grid[:, :, j]) * _mix[0]
            h ^= h >> np.uint64(32)
        h = h * _mix[3]
        return pd.Series([*(h ^ (h >> np.uint64(29))).view(np.int64)])

    banded = classes.select("node", F.explode(keys("sig")).alias("bucket"))
    full = written(banded.groupBy("bucket").agg(F.count(F.lit(1)).alias("members")).filter("members > 1"), "full-buckets")
    members = written(hot_join(banded, full, ["bucket"], "members"), "bucket-members")
    central = members.groupBy("node").agg(F.sum("members").alias("score"))
    return members.join(central, "node").select("bucket", "node", "score")


def similar_pairs(pairs: DataFrame, classes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (``a``, ``b``) whose sets have 100 * intersection >= percent * union."""
    table = fewest_matches(percent / 100)

    @F.pandas_udf("boolean")
    def likely(left: pd.Series, right: pd.Series) -> pd.Series:
        x = np.frombuffer(b"".join(left), np.uint32).reshape(-1, HASHES)
        y = np.frombuffer(b"".join(right), np.uint32).reshape(-1, HASHES)
        alive = np.arange(len(x))
        equal = np.zeros(len(x), np.int64)
        for n, fewest in table:
            part = slice(n - BATCH, n)
            equal[alive] += (x[alive, part] == y[alive, part]).sum(axis=1)
            alive = alive[equal[alive] >= fewest]
        kept = np.zeros(len(x), bool)
        kept[alive] = True
        return pd.Series(kept)

    # A hub's pairs are narrow on one side; an uneven partition of them is split by the adaptive join.
    sig = classes.select("node", "sig", "n")
    left = sig.select(F.col("node").alias("a"), F.col("sig").alias("sig_a"), F.col("n").alias("n_a"))
    right = sig.select(F.col("node").alias("b"), F.col("sig").alias("sig_b"), F.col("n").alias("n_b"))
    sized = pairs.join(left, "a").join(right, "b").filter(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))
    survivors = sized.filter(likely("sig_a", "sig_b")).select("a", "b", "n_a", "n_b")
    both = survivors.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("s_a")), "a").join(
        sets.select(F.col("node").alias("b"), F.col("shingles").alias("s_b")), "b"
    )
    shared = F.size(F.array_intersect("s_a", "s_b"))
    return both.withColumn("shared", shared).filter(100 * F.col("shared") >= percent * (F.col("n_a") + F.col("n_b") - F.col("shared"))).select("a", "b")


def crossing_pairs(nodes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs of nodes with different labels that may be similar enough, by prefix filtering.

    Of two sets that similar, the rarest shingles (as many as may be missing,
    and one) have one in common, and from the first of these on enough of both
    is left.  A near copy with more changes than the threshold allows has no such
    shingle with another, and so no pair, though it shares buckets with its
    whole group.
    """
    listed = nodes.join(sets, "node").select("node", "label", F.size("shingles").alias("n"), F.explode("shingles").alias("shingle"))
    known = written(listed.groupBy("shingle").agg(F.count(F.lit(1)).alias("df")), "shingle-counts")
    ranked = hot_join(listed, known, ["shingle"], "df").groupBy("node", "label", "n").agg(F.array_sort(F.collect_list(F.struct("df", "shingle"))).alias("s"))
    may_miss = F.col("n") - F.floor((F.col("n") * percent + 99) / 100) + 1
    prefixes = ranked.select("node", "label", "n", F.posexplode(F.slice("s", F.lit(1), may_miss.cast("int"))).alias("at", "p")).filter("p.df > 1")
    # A shingle of many rows is paired block by block.
    blocks = F.ceil(F.col("p.df") / SHINGLE_ROWS)
    prefixes = prefixes.select("node", "label", "n", (F.col("n") - F.col("at")).alias("rest"), "p.shingle", F.pmod(F.xxhash64("node"), blocks).alias("own"), F.sequence(F.lit(0).cast("long"), blocks - 1).alias("every"))
    prefixes = written(prefixes, "prefixes")
    # Of a shingle's labels the largest is not paired with itself, so what is tried and thrown away is no more than what has to be tried.
    labels = prefixes.groupBy("shingle", "label").agg(F.count(F.lit(1)).alias("c"))
    mixed = labels.groupBy("shingle").agg(F.max_by("label", F.struct("c", "label")).alias("largest"), F.count(F.lit(1)).alias("labels"), F.sum("c").alias("df")).filter("labels > 1")
    prefixes = written(hot_join(prefixes, written(mixed.select("shingle", "largest", "df"), "mixed-shingles"), ["shingle"], "df").drop("df"), "mixed-prefixes")
    x = prefixes.filter("label <> largest").select("shingle", F.col("own").alias("block_a"), F.explode("every").alias("block_b"), F.col("node").alias("a"), F.col("label").alias("label_a"), F.col("n").alias("size_a"), F.col("rest").alias("rest_a"))
    y = prefixes.select("shingle", F.explode("every").alias("block_a"), F.col("own").alias("block_b"), F.col("node").alias("b"), F.col("label").alias("label_b"), F.col("n").alias("size_b"), F.col("rest").alias("rest_b"), (F.col("label") == F.col("largest")).alias("main"))
    # From the first common shingle on, no more can be common than either has left.
    fits = (100 + percent) * F.least("rest_a", "rest_b") >= percent * (F.col("size_a") + F.col("size_b"))
    return x.join(y, ["shingle", "block_a", "block_b"]).filter((F.col("main") | (F.col("a") < F.col("b"))) & (F.col("label_a") != F.col("label_b")) & fits).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def shared_ids(linked: DataFrame, classes: DataFrame) -> DataFrame:
    """Edges (``a``, ``b``) that hold together the classes of rows with one and the same id."""
    several = linked.groupBy("doc_id").agg(F.min("set_key").alias("lo"), F.max("set_key").alias("hi")).filter("doc_id is not null and lo <> hi").select("doc_id")
    owned = written(linked.join(several, "doc_id").select("doc_id", "set_key").distinct().join(classes.select("set_key", "node"), "set_key").select("doc_id", "node"), "shared-ids")
    least = owned.groupBy("doc_id").agg(F.min("node").alias("a"))
    return owned.join(least, "doc_id").select("a", F.col("node").alias("b")).filter("a <> b")


def row_groups(docs: DataFrame, size: int, percent: int, id_col: str = "doc_id", text_col: str = "text", by_id: bool = False) -> DataFrame:
    """``doc_id``, ``row_id`` (see ``row_key``), ``n`` and ``part`` of each input row; rows linked directly or through others have one ``part``.

    ``part`` is null for rows without shingles.  With ``by_id`` it is null for rows
    without an id as well, and rows that share an id are in one part.
    """
    signed = written(signatures(docs, size, id_col, text_col).withColumn("row", F.monotonically_increasing_id()), "signatures")
    takes_part = (F.col("n") > 0) & F.col("doc_id").isNotNull() if by_id else F.col("n") > 0
    linked = signed.filter(takes_part)
    # A class is numbered by the first of its rows and stands for all of them.
    one = F.min(F.struct("row", "row_id")).alias("one")
    classes = linked.groupBy("set_key").agg(one, F.min("n").alias("n"), F.first("sig").alias("sig"), F.count(F.lit(1)).alias("met"))
    classes = written(classes.select("set_key", F.col("one.row").alias("node"), F.col("one.row_id").alias("row_id"), "n", "sig", "met"), "classes")
    members = written(band_members(classes), "scored-members")
    nodes = members.select("node").distinct()

    @F.pandas_udf("array<long>")
    def shingles(texts: pd.Series) -> pd.Series:
        return pd.Series([s.view(np.int64) for s in shingle_sets(texts.tolist(), size)])

    # Rows with one row_id are alike, so whichever of them is met has the class's text.
    wanted = classes.select("node", "row_id").join(nodes, "node")
    texts = docs.select(row_key(id_col, text_col).alias("row_id"), F.col(text_col).alias("text")).join(wanted, "row_id")
    sets = written(texts.groupBy("node").agg(F.max("text").alias("text")).select("node", shingles("text").alias("shingles")), "shingle-sets")

    # A large group of near copies shares its buckets, so these are joined as hot keys.
    leaders = members.groupBy("bucket").agg(F.min_by("node", F.struct(-F.col("score"), F.col("node"))).alias("leader"), F.count(F.lit(1)).alias("met"))
    stars = hot_join(members, written(leaders, "leaders"), ["bucket"], "met").filter("node <> leader").select(F.least("node", "leader").alias("a"), F.greatest("node", "leader").alias("b")).distinct()
    stars = written(stars, "star-pairs")
    links = similar_pairs(stars, classes, sets, percent)
    first = written(links.unionByName(shared_ids(linked, classes)) if by_id else links, "star-links")
    parts = written(connected_components(first), "star-components")
    labelled = members.join(parts, "node", "left").select("bucket", "node", F.coalesce("root", "node").alias("label"))
    split = labelled.groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count(F.lit(1)).alias("met")).filter("lo <> hi").select("bucket", "met")
    open_ = hot_join(labelled, written(split, "split-buckets"), ["bucket"], "met").select("node", "label").distinct()
    across = crossing_pairs(written(open_, "open-nodes"), sets, percent).join(stars, ["a", "b"], "left_anti")
    second = written(similar_pairs(across, classes, sets, percent), "cross-links")
    # What is left to join are the components of the stars, so only their roots are looked at again.
    left = second.join(parts.select(F.col("node").alias("a"), F.col("root").alias("root_a")), "a", "left")
    left = left.join(parts.select(F.col("node").alias("b"), F.col("root").alias("root_b")), "b", "left")
    joined = connected_components(left.select(F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b")))
    joined = written(joined.select("node", F.col("root").alias("last")), "joined-components")
    # A node of cross links alone is its own root.
    nodes = parts.unionByName(joined.join(parts, "node", "left_anti").select("node", F.col("node").alias("root")))
    roots = nodes.join(joined.withColumnRenamed("node", "root"), "root", "left").select("node", F.coalesce("last", "root").alias("root"))
    # Every class finds its component once, and its rows find their class.
    found = written(classes.join(roots, "node", "left").select("set_key", "met", F.coalesce("root", "node").alias("part")), "class-components")
    out = hot_join(linked, found, ["set_key"], "met").select("doc_id", "row_id", "n", "part")
    return out.unionByName(signed.filter(~takes_part).select("doc_id", "row_id", "n", F.lit(None).cast("long").alias("part")))


def near_groups(docs: DataFrame, size: int = 3, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Components of documents linked by the Jaccard similarity of their word shingles.

    Returns a row for each input row: ``doc_id``, ``n_shingles``, ``component_id`` (the
    smallest id reachable, its own included) and ``kept`` (``doc_id = component_id``).
    A text of fewer than ``size`` words is one shingle; null texts and texts
    without words have none and link with nothing; a row with a null id is kept
    by itself with a null ``component_id``; rows that share an id are linked with
    each other whatever their texts; an empty table gives no rows.  Only the two named columns are read.
    """
    rows = written(row_groups(docs, size, percent, id_col, text_col, by_id=True), "row-groups")
    linked = rows.filter("part is not null")
    least = linked.groupBy("part").agg(F.min("doc_id").alias("component_id"), F.count(F.lit(1)).alias("met"))
    out = hot_join(linked, written(least, "least-ids"), ["part"], "met").select("doc_id", "n", "component_id")
    # A row without shingles belongs to the document of its id, if that has others.
    alone = rows.filter("part is null").select("doc_id", "n")
    of_id = linked.join(alone.filter("doc_id is not null").select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", "part").distinct().join(least.select("part", "component_id"), "part").select("doc_id", "component_id").distinct()
    alone = alone.join(of_id, "doc_id", "left").select("doc_id", "n", F.coalesce("component_id", "doc_id").alias("component_id"))
    return out.unionByName(alone).select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def one_of_each(docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group of near copies: that of the smallest id (null last), of several the one of the least text digest.

    Every row is compared for itself, whatever its id: rows with a null id like any
    other, and of rows alike in id and text one stays.  Rows without a word stay all.  All columns are kept; where
    repeated rows differ in another column the least of them stays.
    """
    rows = written(row_groups(docs, size, percent, id_col, text_col).filter("part is not null").select("doc_id", "row_id", "part"), "row-groups")
    best = rows.groupBy("part").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row_id")).alias("b")).select("b.row_id")
    each = written(rows.groupBy("row_id").agg(F.count(F.lit(1)).alias("rows")).join(best.withColumn("stays", F.lit(True)), "row_id", "left"), "row-decisions")
    keyed = docs.withColumn("_near_row", row_key(id_col, text_col))
    named = lambda rows: rows.select(F.col("row_id").alias("_near_row"))
    repeated = named(each.filter("stays and rows > 1"))
    left = keyed.join(named(each.filter("stays is null or rows > 1")), "_near_row", "left_anti").select(*docs.columns)
    if repeated.isEmpty():
        return left
    whole = F.struct(*docs.columns)
    return left.unionByName(keyed.join(repeated, "_near_row").groupBy("_near_row").agg(F.min(whole).alias("r")).select("r.*"))
