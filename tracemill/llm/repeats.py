"""Byte strings that occur more than once: a sparse suffix sort with hash-compared suffixes.

Prefix polynomial hashes give the hash of any byte range in constant time.
Every ``length``-byte window is dealt by its least ``gram``-byte hash, so equal
windows meet; neighbouring windows of one least gram form a run, and only runs
whose gram recurs are looked at further.  Runs alike as a whole repeat as a
whole.  Where runs of one gram differ, the suffixes that begin in them are
sorted: by their leading bytes, and where these are equal by a merge sort whose
comparisons find the common extension of two suffixes by binary search over
the prefix hashes.  In that order equal windows are neighbours.  Every pair of
neighbours is compared byte for byte; where a hash has misled, the suffixes
in question are sorted by their bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.llm.common import bounded_batches, hot_join, row_key, written

#: Windows that one task sorts together, about; a gram with more of them is counted window by window instead.
SORTED_TOGETHER = 200_000
#: Bytes hashed at once; windows of a longer text are taken in slices of this many.
SLICE = 1 << 19

_rng = np.random.default_rng(20240229)
_code = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The base's powers 0..n-1 and their inverses, modulo 2**64."""
    if len(_powers[0]) < n:
        for i, b in enumerate((_BASE, _INVERSE)):
            steps = np.full(n, b, np.uint64)
            steps[0] = 1
            _powers[i] = np.cumprod(steps, dtype=np.uint64)
    return _powers[0][:n], _powers[1][:n]


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    p = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_code[data] * powers(len(data))[0], dtype=np.uint64, out=p[1:])
    return p


def window_hashes(p: np.ndarray, size: int) -> np.ndarray:
    """The hash of every ``size``-byte range."""
    n = len(p) - size
    return (p[size:] - p[:n]) * powers(n)[1]


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def sliding(op: np.ufunc, a: np.ndarray, w: int) -> np.ndarray:
    size = 1
    while size * 2 <= w:
        a = op(a[:-size], a[size:])
        size *= 2
    return op(a[: len(a) - (w - size)], a[w - size :]) if size < w else a


def slices(texts: list[bytes], length: int) -> Iterator[list[tuple[int, int, bytes]]]:
    """Lists of (text, offset, bytes) that are hashed together."""
    held, size = [], 0
    for i, data in enumerate(texts):
        for at in range(0, max(0, len(data) - length + 1), SLICE):
            part = data[at : at + SLICE + length - 1]
            held.append((i, at, part))
            size += len(part)
            if size >= SLICE:
                yield held
                held, size = [], 0
    if held:
        yield held


def runs_of(parts: list[tuple[int, int, bytes]], length: int, gram: int) -> tuple[dict, list[tuple[int, int, int]]]:
    """Runs and ranges of windows that repeat within a run.

    A run has its text, start, number of windows, least gram hash, and two hashes of all its bytes (``context``, ``check``).
    """
    whole = b"".join(x for _, _, x in parts)
    data = np.frombuffer(whole, np.uint8)
    sizes = np.array([len(x) for _, _, x in parts])
    begins = np.cumsum(sizes) - sizes
    w = length - gram + 1
    p = prefix_hashes(data)
    g = mixed(window_hashes(p, gram))
    least = sliding(np.minimum, g, w)
    n = len(least)
    valid = np.ones(n, bool)
    changes = np.empty(n, bool)
    changes[0] = True
    np.not_equal(least[1:], least[:-1], out=changes[1:])
    for b, size in zip(begins.tolist(), sizes.tolist()):
        changes[b] = True
        valid[b + size - length + 1 : b + size] = False
    first = np.flatnonzero(changes & valid)
    breaks = np.append(np.flatnonzero(changes | ~valid), n)
    after = breaks[np.searchsorted(breaks, first, "right")]
    inverse = powers(len(p))[1]
    context = mixed((p[after - 1 + length] - p[first]) * inverse[first])
    digest = xxhash.xxh3_64_intdigest
    check = np.array([digest(whole[x:y]) for x, y in zip(first.tolist(), (after - 1 + length).tolist())], np.uint64)
    which = np.searchsorted(begins, first, "right") - 1
    texts = np.array([i for i, _, _ in parts])[which]
    shift = np.array([at for _, at, _ in parts])[which] - begins[which]
    # A run can repeat a window within itself only if its least gram occurs in it twice.
    pad = np.zeros(w - 1, np.uint64)
    chosen = np.flatnonzero(g == sliding(np.maximum, np.concatenate([pad, least, pad]), w))
    order = np.lexsort((chosen, g[chosen]))
    at = chosen[order]
    twice = (g[at[1:]] == g[at[:-1]]) & (at[1:] - at[:-1] <= w)
    recurs = np.isin(least[first], g[at[1:][twice]])
    within = []
    for k in np.flatnonzero(recurs).tolist():
        a, b = int(first[k]), int(after[k])
        again = recurring_windows([whole[a : b - 1 + length]], np.array([b - a]), np.zeros(1, np.int64), length)[0]
        for s, e in stretches(again):
            within.append((int(texts[k]), a + s + int(shift[k]), e - s))
    found = {"text": texts, "start": first + shift, "n": after - first}
    return found | {"least": least[first].view(np.int64), "context": context.view(np.int64), "check": check.view(np.int64)}, within


def stretches(mask: np.ndarray) -> list[tuple[int, int]]:
    """Half-open ranges of true values."""
    edges = np.flatnonzero(np.diff(np.concatenate([[False], mask, [False]])))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist()))


# --- suffix sort ----------------------------------------------------------


class Suffixes:
    """Suffixes of joined texts, compared on their first ``length`` bytes."""

    def __init__(self, data: np.ndarray, length: int):
        self.data, self.length = data, length
        self.p = prefix_hashes(data)
        self.inverse = powers(len(self.p))[1]

    def hashes(self, at: np.ndarray, size: np.ndarray | int) -> np.ndarray:
        return (self.p[at + size] - self.p[at]) * self.inverse[at]

    def common(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Bytes that suffixes ``x`` and ``y`` share at their beginning (``length`` at most), by binary search over the hashes."""
        low = np.where(self.hashes(x, self.length) == self.hashes(y, self.length), self.length, 0)
        open_ = np.flatnonzero(low == 0)
        x, y = x[open_], y[open_]
        lo, hi = np.zeros(len(x), np.int64), np.full(len(x), self.length, np.int64)
        while (hi - lo > 1).any():  # lo bytes are alike, hi bytes are not
            mid = (lo + hi) >> 1
            alike = self.hashes(x, mid) == self.hashes(y, mid)
            lo, hi = np.where(alike, mid, lo), np.where(alike, hi, mid)
        low[open_] = lo
        return low

    def less(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        m = self.common(x, y)
        end = np.minimum(m, self.length - 1)
        return (m < self.length) & (self.data[x + end] < self.data[y + end])

    def merge_sort(self, at: np.ndarray, groups: np.ndarray) -> np.ndarray:
        """``at`` with each group (equal neighbouring numbers) sorted; all merges of a round are made together."""
        begins = np.flatnonzero(np.diff(groups, prepend=groups[:1] - 1))
        sizes = np.diff(np.append(begins, len(at)))
        begin, size = np.repeat(begins, sizes), np.repeat(sizes, sizes)
        place = np.arange(len(at)) - begin
        at, width = at.copy(), 1
        while width < sizes.max(initial=1):
            left = place // width % 2 == 0
            block = place // (2 * width) * (2 * width)
            middle = np.minimum(block + width, size)
            # Where each suffix goes in the other half: before its equals if it comes from the left.
            lo = begin + np.where(left, middle, block)
            hi = begin + np.where(left, np.minimum(block + 2 * width, size), middle)
            first = lo.copy()
            while True:
                todo = np.flatnonzero(lo < hi)
                if not len(todo):
                    break
                mid = (lo[todo] + hi[todo]) >> 1
                here = left[todo]
                x = np.where(here, at[mid], at[todo])
                y = np.where(here, at[todo], at[mid])
                smaller = self.less(x, y)
                right = np.where(here, smaller, ~smaller)  # the other one stands before this one
                lo[todo] = np.where(right, mid + 1, lo[todo])
                hi[todo] = np.where(right, hi[todo], mid)
            own = place - np.where(left, block, middle)
            moved = np.empty_like(at)
            moved[begin + block + own + (lo - first)] = at
            at, width = moved, 2 * width
        return at

    def equal_to_next(self, at: np.ndarray, groups: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The order and which suffix equals the next one, by bytes; groups that are out of order are sorted by bytes."""
        windows = np.lib.stride_tricks.sliding_window_view(self.data, self.length)
        equal = np.zeros(len(at), bool)
        pairs = np.flatnonzero(groups[1:] == groups[:-1])
        bad = []
        for k in range(0, len(pairs), 8192):
            i = pairs[k : k + 8192]
            x, y = windows[at[i]], windows[at[i + 1]]
            differs = x != y
            any_, where = differs.any(axis=1), differs.argmax(axis=1)
            row = np.arange(len(i))
            equal[i] = ~any_
            bad.append(groups[i[any_ & (x[row, where] > y[row, where])]])
        for g in np.unique(np.concatenate(bad)) if bad else []:
            lo, hi = np.searchsorted(groups, [g, g + 1])
            at[lo:hi] = sorted(at[lo:hi].tolist(), key=lambda s: windows[s].tobytes())
            equal[lo : hi - 1] = [windows[s].tobytes() == windows[t].tobytes() for s, t in zip(at[lo : hi - 1], at[lo + 1 : hi])]
        return at, equal


def recurring_windows(contexts: list[bytes], counts: np.ndarray, groups: np.ndarray, length: int) -> list[np.ndarray]:
    """For each context which of its windows (as many as ``counts`` says) equal another one of the same group."""
    data = np.frombuffer(b"".join(contexts), np.uint8)
    sizes = np.array([len(c) for c in contexts])
    begins = np.cumsum(sizes) - sizes
    ends = np.cumsum(counts)
    which = np.repeat(np.arange(len(contexts)), counts)
    start = begins[which] + np.arange(ends[-1]) - (ends - counts)[which]
    lead = np.zeros(len(start), np.uint64)
    for i in range(min(8, length)):
        lead = (lead << np.uint64(8)) | data[start + i]
    group = groups[which]
    order = np.lexsort((lead, group))
    new = np.ones(len(order), bool)
    new[1:] = (group[order[1:]] != group[order[:-1]]) | (lead[order[1:]] != lead[order[:-1]])
    tied = np.cumsum(new)
    many = np.bincount(tied)[tied] > 1  # a suffix with leading bytes of its own has no equal
    order, tied = order[many], tied[many]
    recurs = np.zeros(len(start), bool)
    if len(order):
        index = np.full(len(data), -1, np.int64)
        index[start] = np.arange(len(start))
        s = Suffixes(data, length)
        at, equal = s.equal_to_next(s.merge_sort(start[order], tied), tied)
        recurs[index[at[equal]]] = True
        recurs[index[at[1:][equal[:-1]]]] = True
    return np.split(recurs, ends[:-1])


def _utf8(text: str | None) -> bytes:
    return text.encode() if text else b""


def repeated_spans(docs: DataFrame, length: int = 400, gram: int | None = None) -> DataFrame:
    """``row_id`` and ``spans`` (sorted, disjoint [start, end) byte ranges) of rows with repeated bytes.

    ``docs`` has ``row_id`` (binary) and ``text``; rows with equal ids are copies of each other.
    A byte is in a span if a ``length``-byte string over it also starts anywhere else.
    Runs of exact copies meet in aggregates that combine before the shuffle, told
    apart by 128 bits; where runs of one gram differ, one run stands for all copies of a context.
    """
    bounded_batches(docs.sparkSession)
    gram = gram or length // 2

    def runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids = batch["row_id"].to_numpy()
            for parts in slices([_utf8(t) for t in batch["text"].tolist()], length):
                found, within = runs_of(parts, length, gram)
                yield pd.DataFrame({"row_id": ids[found.pop("text")], **found})
                if within:
                    t, s, n = map(np.array, zip(*within))
                    empty = pd.array([None] * len(t), "Int64")
                    yield pd.DataFrame({"row_id": ids[t], "start": s, "n": n, "least": empty, "context": empty, "check": empty})

    found = written(docs.mapInPandas(runs, "row_id binary, start int, n int, least long, context long, check long"), "runs")
    own = found.filter(F.col("least").isNull()).select("row_id", "start", "n")
    runs_only = found.filter(F.col("least").isNotNull())
    whole = F.struct("context", "check")
    grams = (
        runs_only.groupBy("least")
        .agg(F.count(F.lit(1)).alias("met"), F.min(whole).alias("lo"), F.max(whole).alias("hi"))
        .filter("met > 1")
        .select("least", "met", (F.col("lo") == F.col("hi")).alias("alike"))
    )
    met = written(hot_join(runs_only, written(grams, "grams"), ["least"], "met").drop("met"), "met-runs")
    alike = met.filter("alike").select("row_id", "start", "n")
    differ = met.filter(~F.col("alike"))
    key = ["least", "context", "check"]
    contexts = differ.groupBy(*key).agg(F.count(F.lit(1)).alias("copies"), F.min(F.struct("row_id", "start", "n")).alias("one"))
    contexts = written(contexts.select(*key, "copies", "one.*"), "contexts")
    copied = hot_join(differ, contexts.filter("copies > 1").select(*key, "copies"), key, "copies").select("row_id", "start", "n")

    # Contexts of one gram are sorted together, however few; of a gram with very many windows each window is a row of its own.
    sizes = contexts.groupBy("least").agg(F.count(F.lit(1)).alias("met"), F.sum("n").alias("windows"))
    sizes = written(sizes, "gram-sizes")
    lists = (
        hot_join(contexts, sizes, ["least"], "met")
        .groupBy("row_id")
        .agg(F.collect_list(F.struct("start", "n", "least", (F.col("copies") == 1).alias("single"), (F.col("windows") > SORTED_TOGETHER).alias("many"))).alias("runs"))
    )

    columns = ["row_id", "least", "start", "n", "single", "bytes"]

    def fetch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            held, size = [], 0
            for row_id, text, listed in zip(batch["row_id"].tolist(), batch["text"].tolist(), batch["runs"].tolist()):
                data = _utf8(text)
                for r in listed:
                    s, n = r["start"], r["n"]
                    one = (row_id, r["least"], s, n, r["single"], data[s : s + n - 1 + length])
                    if r["many"]:
                        yield each_window(one)
                        continue
                    held.append(one)
                    size += len(one[-1])
                    if size > SLICE:
                        yield together(held)
                        held, size = [], 0
            if held:
                yield together(held)

    def together(rows: list[tuple]) -> pd.DataFrame:
        empty = pd.array([None] * len(rows), "Int64")
        return pd.DataFrame(rows, columns=columns).assign(h1=empty, h2=empty)

    def each_window(run: tuple) -> pd.DataFrame:
        row_id, least, start, _, single, data = run
        h = mixed(window_hashes(prefix_hashes(np.frombuffer(data, np.uint8)), length))
        h, at = np.unique(h, return_index=True)
        second = [xxhash.xxh3_64_intdigest(data[a : a + length]) for a in at.tolist()]
        out = pd.DataFrame({"least": least, "start": at + start, "n": 1, "single": single, "bytes": None, "h1": h.view(np.int64), "h2": np.array(second, np.uint64).view(np.int64)})
        return out.assign(row_id=[row_id] * len(out))[[*columns, "h1", "h2"]]

    # Of rows alike in id and text one is fetched.
    fetched = docs.join(lists, "row_id").dropDuplicates(["row_id"]).mapInPandas(fetch, "row_id binary, least long, start int, n int, single boolean, bytes binary, h1 long, h2 long")
    fetched = written(fetched, "suffixes")

    # Few large grams aside, a bucket holds about SORTED_TOGETHER windows, and at most that many of one gram.
    load = fetched.filter("h1 is null").agg(F.sum("n")).first()[0] or 0
    buckets = max(1, -(-load // SORTED_TOGETHER))

    def sort(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        groups = np.unique(pdf["least"].to_numpy(), return_inverse=True)[1]
        masks = recurring_windows(pdf["bytes"].tolist(), pdf["n"].to_numpy(), groups, length)
        out = []
        for row_id, start, single, mask in zip(pdf["row_id"].tolist(), pdf["start"].tolist(), pdf["single"].tolist(), masks):
            if single:
                out += [(row_id, start + a, b - a) for a, b in stretches(mask)]
        return pd.DataFrame(out, columns=["row_id", "start", "n"])

    dealt = fetched.filter("h1 is null").select("row_id", "least", "start", "n", "single", "bytes", F.pmod(F.xxhash64("least"), F.lit(buckets)).alias("bucket"))
    in_order = dealt.groupBy("bucket").applyInPandas(sort, "row_id binary, start int, n int")
    each = fetched.filter("h1 is not null").select("row_id", "least", "start", "single", "h1", "h2")
    again = written(each.groupBy("least", "h1", "h2").agg(F.count(F.lit(1)).alias("met")).filter("met > 1"), "again")
    singles = hot_join(each.filter("single"), again, ["least", "h1", "h2"], "met").select("row_id", "start", F.lit(1).alias("n"))
    covered = own.unionByName(alike).unionByName(copied).unionByName(in_order).unionByName(singles)

    @F.pandas_udf("array<struct<start:int,end:int>>")
    def joined(starts: pd.Series, counts: pd.Series) -> pd.Series:
        out = []
        for s, n in zip(starts.tolist(), counts.tolist()):
            a, b = np.asarray(s, np.int64), np.asarray(s, np.int64) + np.asarray(n, np.int64) - 1 + length
            o = np.argsort(a, kind="stable")
            a, b = a[o], np.maximum.accumulate(b[o])
            new = np.flatnonzero(np.concatenate([[True], a[1:] > b[:-1]]))
            ends = b[np.append(new[1:], len(a)) - 1]
            out.append([{"start": x, "end": y} for x, y in zip(a[new].tolist(), ends.tolist())])
        return pd.Series(out)

    return covered.groupBy("row_id").agg(F.collect_list("start").alias("s"), F.collect_list("n").alias("c")).select("row_id", joined("s", "c").alias("spans"))


def cut(text: str | None, spans: list | None) -> bytes:
    """What is left of the text's bytes without the spans."""
    data = _utf8(text)
    if spans is None:
        return data
    kept, at = [], 0
    for s in spans:
        kept.append(data[at : s["start"]])
        at = s["end"]
    return b"".join([*kept, data[at:]])


def repeats(docs: DataFrame, length: int = 400, gram: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """What removing all repeated ``length``-byte strings does to each whole text (UTF-8).

    Returns a row for each input row: ``doc_id``, ``n_bytes``, ``n_removed``, ``n_spans``
    and ``kept_sha256``.  A null text is empty; texts shorter than ``length`` stay
    whole; a repeated row is a copy, so all its windows repeat; overlapping
    occurrences in one text count; an empty table gives no rows.  Only the two
    named columns are read.
    """
    rows = docs.select(row_key(id_col, text_col).alias("row_id"), F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    spans = repeated_spans(rows.select("row_id", "text"), length, gram)

    @F.pandas_udf("n_removed long, n_spans long, kept_sha256 string")
    def digest(texts: pd.Series, lists: pd.Series) -> pd.DataFrame:
        out = []
        for t, s in zip(texts.tolist(), lists.tolist()):
            kept = cut(t, s)
            out.append((len(_utf8(t)) - len(kept), 0 if s is None else len(s), hashlib.sha256(kept).hexdigest()))
        return pd.DataFrame(out, columns=["n_removed", "n_spans", "kept_sha256"])

    return (
        rows.join(spans, "row_id", "left")
        .select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"), digest("text", "spans").alias("d"))
        .select("doc_id", "n_bytes", "d.*")
    )


def without_repeats(
    docs: DataFrame, length: int = 400, gram: int | None = None, least_words: int = 0, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``docs`` with repeated bytes taken out of the text; a character that is cut in two goes too.

    A repeated span of fewer than ``least_words`` words stays.  Null texts stay
    null, an emptied text becomes empty, rows keep all their columns.
    """
    spans = repeated_spans(docs.select(row_key(id_col, text_col).alias("row_id"), F.col(text_col).alias("text")), length, gram)
    spans = spans.select(F.col("row_id").alias("_repeats_row"), F.col("spans").alias("_repeats_spans"))

    @F.pandas_udf("string")
    def rest(texts: pd.Series, lists: pd.Series) -> pd.Series:
        out = []
        for t, found in zip(texts.tolist(), lists.tolist()):
            if found is not None and least_words:
                data = _utf8(t)
                found = [s for s in found if len(data[s["start"] : s["end"]].split()) >= least_words]
            out.append(t if found is None or not len(found) else cut(t, found).decode("utf-8", "ignore"))
        return pd.Series(out)

    rows = docs.withColumn("_repeats_row", row_key(id_col, text_col)).join(spans, "_repeats_row", "left")
    return rows.withColumn(text_col, rest(text_col, "_repeats_spans")).select(*docs.columns)
