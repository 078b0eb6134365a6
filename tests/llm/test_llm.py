"""The training-data operators against brute force on a small fixture with awkward rows."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracemill.llm import common, components, decontamination, language_id, licenses, near_dedup, nearest, packing, quality, repeats, token_counts, toxicity
from tracemill.llm.common import hot_join
from tracemill.llm.registry import SQL, tokenizer_file

random.seed(11)
SYLLABLES = ["ka", "lo", "mi", "ten", "ra", "su", "vo", "né", "ü", "shi"]


def word():
    return "".join(random.choice(SYLLABLES) for _ in range(random.randint(1, 4)))


def prose(n):
    return " ".join(word() for _ in range(n)).capitalize() + "."


PASSAGE = prose(120)
LONG = prose(200)
#: doc_id, text: nulls, empties, exact and near copies, repeated rows, a very long text, one without letters.
ROWS = [
    (0, None), (1, ""), (2, "   \n\t "), (3, "ok"), (4, "Two words"), (5, "123 456 !!!"),
    (6, LONG), (7, LONG), (8, LONG.replace(LONG.split()[50], "changed", 1)), (9, prose(90) + "\n" + PASSAGE + "\n" + prose(40)), (10, PASSAGE[:600] + " " + prose(30)),
    (11, "la " * 400), (12, prose(6000)), (13, "It's they'll <|endoftext|> x  y\n\n z 'rent"), (13, "It's they'll <|endoftext|> x  y\n\n z 'rent"), (None, prose(30)), (14, "É" * 300),
    *[(20 + i, prose(random.randint(20, 150))) for i in range(12)],
]


@pytest.fixture(scope="module")
def docs(spark):
    """With further columns whose names clash with those the operators make."""
    schema = "doc_id long, text string, n_tokens string, score string, row_id string, spans string, n string, node string, length string, start string"
    return spark.createDataFrame([(i, t, *["x"] * 8) for i, t in ROWS], schema).repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def as_rows(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)


def test_token_counts(docs, empty):
    from tokenizers import Tokenizer

    path = tokenizer_file("byte_bpe_50k.json")
    lib = Tokenizer.from_file(path)
    n = lambda t: len(lib.encode(t or "", add_special_tokens=False))
    expected = sorted(((i, len((t or "").encode()), n(t), n(t) > 1024) for i, t in ROWS), key=repr)
    assert as_rows(token_counts.count_tokens(docs, path), "doc_id", "n_bytes", "n_tokens", "over_limit") == expected
    assert token_counts.count_tokens(empty, path).count() == 0


def test_transducer_chunks_compose():
    """Any text, cut anywhere: composed chunk maps give the library's counts."""
    from tokenizers import Tokenizer

    path = tokenizer_file("byte_bpe_50k.json")
    counter, lib = token_counts.TokenCounter(path, token_counts.character_classes()), Tokenizer.from_file(path)
    signs = [*"aZstmdrvel'  \n\t'!?1٣éñ　 😀漢\x1c\x85", "'re", "'ll", "<|endoftext|>", "  "]
    texts = ["".join(random.choice(signs) for _ in range(random.randint(0, 60))) for _ in range(3000)] + ["a" * 3000 + " " * 3000]
    assert counter.count(texts).tolist() == [len(e) for e in lib.encode_batch(texts, add_special_tokens=False)]


def test_packing(docs, empty):
    from tokenizers import Tokenizer

    path, capacity = tokenizer_file("word_bpe_49k.json"), 256
    lib = Tokenizer.from_file(path)
    rows = packing.pack_documents(docs, path, capacity=capacity).collect()
    ids = Counter((i, zlib.crc32(np.array([*lib.encode(t or "", add_special_tokens=False).ids, 1], "<u4").tobytes()[:4 * capacity])) for i, t in ROWS)
    assert Counter((r["doc_id"], r["ids_crc32"]) for r in rows if r["start"] == 0) == ids
    assert sum(r["length"] for r in rows) == sum(len(lib.encode(t or "", add_special_tokens=False)) + 1 for _, t in ROWS)
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert sorted(by_sequence) == [*range(len(by_sequence))]
    for pieces in by_sequence.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= capacity
    assert packing.pack_documents(empty, path).count() == 0


def test_packing_ids_are_the_librarys_with_special_strings(spark):
    """Every piece's checksum: special strings as written, in upper case, adjacent and cut short."""
    from tokenizers import Tokenizer

    path, capacity = tokenizer_file("word_bpe_49k.json"), 8
    lib, r = Tokenizer.from_file(path), random.Random(3)
    signs = ["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|StartOfText|>", "<|endoftext", "|>", "<|", " ", "  ", "\n", ".", ",", "'re", "'S", "É", "ß", "word", "Word,", "a.b", "12", "e\u0301", "😀", "\u212a"]
    texts = ["".join(r.choice(signs) for _ in range(r.randint(1, 14))) for _ in range(3000)] + ["<|ENDOFTEXT|>", "<|endoftext|><|endoftext|>"]
    expected = []
    for i, t in enumerate(texts):
        ids = np.array([*lib.encode(t, add_special_tokens=False).ids, 1], "<u4").tobytes()
        expected += [(i, s, zlib.crc32(ids[4 * s : 4 * (s + capacity)])) for s in range(0, len(ids) // 4, capacity)]
    rows = packing.token_pieces(spark.createDataFrame([*enumerate(texts)], "doc_id long, text string"), path, 1, capacity)
    assert as_rows(rows, "doc_id", "start", "ids_crc32") == sorted(expected, key=repr)


def test_patterns_hold_every_piece_with_little_padding():
    histogram = {n: random.randint(0, 50) for n in range(1, 513)}
    patterns = packing.packing_patterns({n: c for n, c in histogram.items() if c}, 512)
    held = Counter()
    for lengths, count in patterns:
        assert sum(lengths) <= 512
        for n in lengths:
            held[n] += count
    assert held == Counter({n: c for n, c in histogram.items() if c})
    used, packs = sum(n * c for n, c in histogram.items()), sum(c for _, c in patterns)
    assert used / (512 * packs) > 0.97


def test_decontamination(spark, docs, empty):
    words = PASSAGE.split()
    items = [(1, " ".join(words[10:40])), (2, "ok"), (3, None), (None, " ".join(LONG.split()[5:17])), (5, ""), (6, " ".join(words[10:40])), (7, "nowhere to be found at all in any of these texts here")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    windows = {}
    for i, t in items:
        ws = decontamination.words_of(t)
        for s in range(max(1, len(ws) - 9) if ws else 0):
            windows.setdefault(tuple(ws[s : s + 10]), set()).add("" if i is None else str(i))
    expected = []
    for i, t in ROWS:
        ws, hit, found = decontamination.words_of(t), set(), set()
        for n in {len(k) for k in windows}:
            for s in range(len(ws) - n + 1):
                if (k := windows.get(tuple(ws[s : s + n]))) is not None:
                    hit.update(range(s, s + n))
                    found |= k
        expected.append((i, len(ws), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    cols = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert as_rows(decontamination.contamination(docs, bench), *cols) == sorted(expected, key=repr)
    assert decontamination.contamination(empty, bench).count() == 0
    assert decontamination.contamination(docs, bench.limit(0)).filter("contaminated").count() == 0


def test_decontamination_in_blocks(spark, docs, monkeypatch):
    bench = spark.createDataFrame([(1, " ".join(PASSAGE.split()[10:40])), (2, "ok"), (4, LONG)], "item_id long, text string")
    cols = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256")
    whole = as_rows(decontamination.contamination(docs, bench), *cols)
    monkeypatch.setattr(decontamination, "BLOCK_WINDOWS", 100)
    assert as_rows(decontamination.contamination(docs, bench), *cols) == whole


def test_proximity_matches(spark):
    rows = spark.createDataFrame([(1, "x delta alpha y beta gamma z"), (2, "alpha beta gamma delta"), (3, "alpha beta")], "doc_id long, text string")
    items = [("i", "alpha beta gamma delta".split())]
    lists = decontamination.anchored(items, decontamination.term_counts(rows, "text", {*"alpha beta gamma delta".split()}), 10)
    index = decontamination.build_index(rows, {r[2] for r in lists if r[4] == 0}, {r[2] for r in lists if r[4]}, 12)
    ids = {r["row_id"]: r["doc_id"] for r in index.collect()}
    found = {(ids[r["row_id"]], r["exact"]) for r in decontamination.item_matches(index, lists, 10, slop=3).collect()}
    assert (2, True) in found and (1, False) in found and not any(d == 3 for d, _ in found)


def test_proximity_of_every_window(spark):
    """An item of 30 words: texts with one window's words backwards, for each window, and one with a word missing."""
    item = [f"w{i:02d}" for i in range(30)]
    texts = [(s, " ".join(["x"] * 5 + item[s : s + 10][::-1] + ["y"] * 5)) for s in range(21)]
    texts += [(100, " ".join(item)), (101, " ".join(item[4:13][::-1])), (102, None)]
    rows, bench = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame([("i", " ".join(item))], "item_id string, text string")
    got = {r["doc_id"]: r for r in decontamination.contamination(rows, bench, slop=3).collect()}
    assert all(got[s]["n_near"] > 0 and got[s]["n_near_items"] == 1 and not got[s]["contaminated"] for s in range(21))
    assert got[100]["contaminated"] and got[100]["n_near"] > 0 and got[101]["n_near"] == got[102]["n_near"] == 0
    assert "n_near" not in decontamination.contamination(rows, bench).columns
    lists = decontamination.anchored([("i", item)], decontamination.term_counts(rows, "text", {*item}), 10)
    short = decontamination.build_index(rows, {r[2] for r in lists if r[4] == 0}, {r[2] for r in lists if r[4]}, 9)
    with pytest.raises(Exception, match="context_radius"):
        decontamination.item_matches(short, lists, 10, slop=3).collect()


def test_repeats(docs, empty):
    length = 400
    data = [(i, (t or "").encode()) for i, t in ROWS]
    starts = Counter(b[s : s + length] for _, b in data for s in range(len(b) - length + 1))
    expected = []
    for i, b in data:
        gone = np.zeros(len(b), bool)
        for s in range(len(b) - length + 1):
            if starts[b[s : s + length]] > 1:
                gone[s : s + length] = True
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        expected.append((i, len(b), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()))
    cols = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert as_rows(repeats.repeats(docs), *cols) == sorted(expected, key=repr)
    assert repeats.repeats(empty).count() == 0
    left = {r["doc_id"]: r for r in repeats.without_repeats(docs).collect()}
    assert left[6]["text"] == "" and left[6]["spans"] == "x" and left[25]["text"] == dict(ROWS)[25]


def brute_windows(contexts, counts, groups, length):
    seen = Counter((g, c[i : i + length]) for c, n, g in zip(contexts, counts, groups) for i in range(n))
    return [[seen[g, c[i : i + length]] > 1 for i in range(n)] for c, n, g in zip(contexts, counts, groups)]


@pytest.mark.parametrize("hashes", ["good", "all alike", "few"])
def test_suffix_sort_finds_equal_windows_whatever_the_hashes(hashes, monkeypatch):
    """With hashes that collide always or often the bytes decide."""
    if hashes != "good":
        monkeypatch.setattr(repeats, "_code", np.full(256, 0 if hashes == "all alike" else 1, np.uint64))
    r = random.Random(5)
    for length in (3, 9, 20):
        for _ in range(20):
            base = "".join(r.choice("ab c") for _ in range(60)).encode()
            contexts = []
            for _ in range(r.randint(1, 8)):
                c = bytearray(base[r.randint(0, 20) :])
                for _ in range(r.randint(0, 3)):
                    c[r.randrange(len(c))] = r.choice(b"abz")
                contexts.append(bytes(c))
            counts = np.array([len(c) - length + 1 for c in contexts])
            groups = np.array([r.randint(0, 1) for _ in contexts])
            found = repeats.recurring_windows(contexts, counts, groups, length)
            assert [f.tolist() for f in found] == brute_windows(contexts, counts, groups, length)


def without_passages(texts, length, words):
    """Brute force of the cutting stage: every window is looked up in a count of all windows."""
    data = {i: (t or "").encode() for i, t in texts.items()}
    seen = Counter(b[k : k + length] for b in data.values() for k in range(len(b) - length + 1))
    out = {}
    for i, b in data.items():
        mask = np.zeros(len(b), bool)
        for k in range(len(b) - length + 1):
            if seen[b[k : k + length]] > 1:
                mask[k : k + length] = True
        kept = np.ones(len(b), bool)
        for x, y in repeats.stretches(mask):
            kept[x:y] = len(b[x:y].split()) < words
        left = bytes(np.frombuffer(b, np.uint8)[kept]).decode("utf-8", "ignore")
        if kept.all() or left.strip(" "):
            out[i] = texts[i] if kept.all() else left
    return out


def test_pipeline_stages_judge_rows_by_id_and_text(spark, tmp_path):
    """Null ids, rows that share an id, repeated rows and an empty table in the cutting and the dropping stage."""
    import corpus_pipeline as p

    item = prose(14)
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(None, prose(20) + " " + item), (5, prose(25)), (5, item + prose(5)), (6, PASSAGE), (7, PASSAGE), (None, None), (8, ""), (9, prose(9)), (9, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = p.drop_contaminated(spark, docs, str(tmp_path))
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter([None, 5, 6, 7, 8, 9, 9]) and kept.columns == list(p.COLUMNS)
    left = p.cut_repeats(spark, docs, str(tmp_path)).collect()
    assert Counter(r["doc_id"] for r in left) == Counter([None, None, 5, 5, 8, 9, 9])
    # Every text survives near-dedup in one row, and with it in the corpus.
    once = p.keep_one_of_group(spark, docs.unionByName(docs), str(tmp_path))
    assert Counter(r["text"] for r in once.collect() if r["text"]) == Counter({t for i, t in rows if t})
    assert Counter(r["doc_id"] for r in p.cut_repeats(spark, once, str(tmp_path)).collect() if r["text"]) == Counter([None, 5, 5, 6, 9])
    assert p.keep_one_of_group(spark, docs.limit(0), str(tmp_path)).count() == 0
    assert p.drop_contaminated(spark, docs.limit(0), str(tmp_path)).count() == p.cut_repeats(spark, docs.limit(0), str(tmp_path)).count() == 0


@pytest.mark.parametrize("spread", [0, 3])
def test_hot_join_is_an_inner_join(spark, spread, monkeypatch):
    monkeypatch.setattr(common, "HOT_ROWS", 100)
    rows = spark.createDataFrame([(1, i) for i in range(400)] + [(k, k) for k in range(2, 40)] + [(None, 0)], "k long, v long")
    keys = rows.groupBy("k").agg(F.count(F.lit(1)).alias("met")).filter("k is null or k < 30").withColumn("name", F.col("k") * 2)
    got = hot_join(rows, keys, ["k"], "met", spread).select("k", "v", "name", "met").collect()
    assert sorted(map(tuple, got)) == sorted([(1, i, 2, 400) for i in range(400)] + [(k, k, 2 * k, 1) for k in range(2, 30)])


def test_common_extensions():
    s = repeats.Suffixes(np.frombuffer(b"abcabcabdabcabc", np.uint8), 6)
    assert s.common(np.array([0, 0, 3, 1]), np.array([3, 9, 6, 4])).tolist() == [5, 6, 2, 4]
    assert s.less(np.array([0, 3, 0]), np.array([3, 0, 9])).tolist() == [True, False, False]


def test_repeats_of_crowded_grams(docs, monkeypatch):
    """A gram with more windows than are sorted together is counted window by window, with one result."""
    cols = ("doc_id", "n_removed", "n_spans", "kept_sha256")
    whole = as_rows(repeats.repeats(docs), *cols)
    monkeypatch.setattr(repeats, "SORTED_TOGETHER", 40)
    assert as_rows(repeats.repeats(docs), *cols) == whole


def test_short_repeated_spans_stay_where_words_are_asked_for(spark):
    shared = prose(30)
    docs = spark.createDataFrame([(1, prose(20) + " " + shared), (2, shared + prose(20)), (3, PASSAGE), (4, PASSAGE + " end")], "doc_id long, text string")
    left = {r["doc_id"]: r["text"] for r in repeats.without_repeats(docs, 100, least_words=51).collect()}
    assert shared in left[1] and shared in left[2]
    assert left[3] == "" and left[4] == " end"


def test_repeats_do_not_depend_on_slices(docs, monkeypatch):
    cols = ("doc_id", "n_removed", "kept_sha256")
    whole = as_rows(repeats.repeats(docs), *cols)
    monkeypatch.setattr(repeats, "SLICE", 500)
    texts = [(t or "").encode() for _, t in ROWS]
    assert sum(len(p) for p in repeats.slices(texts, 400)) > 40
    assert as_rows(repeats.repeats(docs), *cols) == whole


@pytest.mark.parametrize("hot_rows", [1000, 2])
def test_near_groups(docs, empty, hot_rows, monkeypatch):
    monkeypatch.setattr(common, "HOT_ROWS", hot_rows)

    def shingles(t):
        ws = (t or "").encode().lower().split()
        return frozenset(tuple(ws[k : k + 3]) for k in range(max(1, len(ws) - 2))) if ws else frozenset()

    sets = {}
    for i, t in ROWS:
        if i is not None:
            sets[i] = shingles(t)
    root = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                    root[a] = root[b] = min(root[a], root[b])
    expected = [(i, len(shingles(t)), root.get(i), i is None or root[i] == i) for i, t in ROWS]
    assert as_rows(near_dedup.near_groups(docs), "doc_id", "n_shingles", "component_id", "kept") == sorted(expected, key=repr)
    assert near_dedup.near_groups(empty).count() == 0


@pytest.mark.parametrize("hot_rows", [1000, 2])
def test_near_groups_lose_no_link_in_a_chain(spark, hot_rows, monkeypatch):
    """Each text shares enough with the next only; the ends share little, so one star is not enough."""
    monkeypatch.setattr(common, "HOT_ROWS", hot_rows)
    words = [word() + str(i) for i in range(400)]
    texts = [(i, " ".join(words[6 * i : 6 * i + 120])) for i in range(30)]
    groups = near_dedup.near_groups(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    assert {r["component_id"] for r in groups} == {0}


@pytest.mark.parametrize("hot_rows", [1000, 1])
def test_near_groups_of_rows_that_share_an_id(spark, hot_rows, monkeypatch):
    """An id with two texts links what is near to either, whichever row stands for a class."""
    monkeypatch.setattr(common, "HOT_ROWS", hot_rows)
    a, b = [word() + str(i) for i in range(80)], [word() + str(i) for i in range(80)]
    near = lambda t: " ".join([*t[:79], "changed"])
    rows = [(5, " ".join(a)), (5, " ".join(b)), (9, near(a)), (10, near(b)), (11, prose(40)), (5, None), (12, None), (None, near(b))]
    got = near_dedup.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter((r["doc_id"], r["component_id"], r["kept"]) for r in got) == Counter([(5, 5, True)] * 3 + [(9, 5, False), (10, 5, False), (11, 11, True), (12, 12, True), (None, None, True)])


def test_near_groups_with_an_unlinked_member(spark):
    """Copies of one label that share their rare shingles with a text of another group: the link across is found."""
    base = [word() + str(i) for i in range(100)]
    rows = [(i, " ".join([*base[:95], *(f"v{i}x{k}" for k in range(5))])) for i in range(1, 30)]
    rows += [(50, " ".join(base[:80])), (51, " ".join([*base[:82], "other"]))]
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    sets = {i: {tuple(t.split()[k : k + 3]) for k in range(len(t.split()) - 2)} for i, t in rows}
    root = {i: i for i in sets}
    for _ in sets:
        for x in sets:
            for y in sets:
                if 100 * len(sets[x] & sets[y]) >= 85 * len(sets[x] | sets[y]):
                    root[x] = root[y] = min(root[x], root[y])
    assert got == root


def test_one_of_each_keeps_every_text_once(spark):
    p, q, r = prose(60), prose(60), prose(60)
    rows = [(6, p, "a"), (6, p, "b"), (None, q, "c"), (None, q, "d"), (8, r, "e"), (10, r.replace(r.split()[30], "changed", 1), "f"), (None, r, "g"), (11, "", "h"), (11, "", "i"), (None, None, "j")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row_id string").repartition(3)
    left = near_dedup.one_of_each(docs).collect()
    assert Counter((x["doc_id"], x["text"]) for x in left) == Counter([(6, p), (None, q), (8, r), (11, ""), (11, ""), (None, None)])
    assert {x["row_id"] for x in left} >= {"a", "c", "e"} and left[0].__fields__ == docs.columns
    assert near_dedup.one_of_each(docs.limit(0)).count() == 0


def test_bayes_table_is_monotone():
    table = near_dedup.fewest_matches(0.85)
    assert [n for n, _ in table] == [*range(16, 129, 16)] and all(a <= b for (_, a), (_, b) in zip(table, table[1:])) and table[-1][1] < 0.85 * 128


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 50), (50, 75), (200, 200)]
    got = {r["node"]: r["root"] for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in range(41)} == {0} and {got[i] for i in (50, 75, 100)} == {50} and 200 not in got
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_nearest(spark):
    rng = np.random.default_rng(5)
    v = rng.standard_normal((1500, 24)) * rng.uniform(0.5, 2, (1500, 1))
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(2000, None), (2020, [0.0] * 24), (2040, [float("nan")] * 24), (2060, [1.0, None] * 12), (None, [1.0] * 24), (2080, [1.0]), (2100, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("rank", F.lit("x"))
    got = {}
    for r in nearest.nearest(df, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"], r["rank"]))
    assert set(got) == {*range(0, 1500, 20)}
    met = 0
    for q, found in got.items():
        scores = v @ v[q]
        scores[q] = -np.inf
        assert [x[2] for x in found] == [*range(1, 21)] and q not in {x[0] for x in found}
        assert all(abs(s - scores[i]) < 1e-9 for i, s, _ in found) and [s for _, s, _ in found] == sorted((s for _, s, _ in found), reverse=True)
        met += len({x[0] for x in found} & {*np.argsort(-scores)[:20].tolist()})
    assert met >= 0.9 * 20 * len(got)
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 1.0]), (2, [1.0, 1.0])], "vec_id long, embedding array<double>")
    assert as_rows(nearest.nearest(few, F.col("vec_id") == 0), "query_id", "rank", "vec_id", "score") == [(0, 1, 1, 1.0), (0, 2, 2, 1.0)]
    assert nearest.nearest(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


@pytest.mark.parametrize("norms", ["one very long", "lognormal", "alike"])
def test_nearest_with_uneven_norms_over_several_blocks(spark, norms, monkeypatch):
    monkeypatch.setattr(nearest, "BLOCK_VECTORS", 400)
    monkeypatch.setattr(nearest, "BLOCK_QUERIES", 30)
    rng = np.random.default_rng(8)
    v = rng.standard_normal((1200, 24))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    if norms == "lognormal":
        v *= rng.lognormal(0, 1, (1200, 1))
    elif norms == "one very long":
        v[17] *= 100
    v[1101], v[1102] = v[40] * 3, v[40] * 3  # ties at the top
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    got = {}
    for r in nearest.nearest(df, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    assert set(got) == {*range(0, 1200, 20)} and all(len(set(f)) == 20 for f in got.values())
    shares = []
    for q, found in got.items():
        scores = v @ v[q]
        scores[q] = -np.inf
        shares.append(len({*found} & {*np.argsort(-scores)[:20].tolist()}) / 20)
    assert np.mean(shares) >= 0.95 and min(shares) >= 0.7
    assert [i for i in got[40] if i > 1100 and i < 1103] == [1101, 1102]


def test_language_id(spark, docs, empty):
    a, b = ["lo", "ka", "mi"], ["ü", "né", "vo"]
    make = lambda s: " ".join("".join(random.choice(s) for _ in range(3)) for _ in range(30))
    train = spark.createDataFrame([(make(a), "aa") for _ in range(30)] + [(make(b), "bb") for _ in range(30)] + [(None, "aa"), ("x", None)], "text string, lang string")
    test = spark.createDataFrame([(1, make(a)), (2, make(b)), (3, None), (4, ""), (5, "12 !?"), (6, make(a).upper())], "doc_id long, text string")
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language_id.identify(test, train).collect()}
    assert [got[i][0] for i in range(1, 7)] == ["aa", "bb", "und", "und", "und", "aa"] and all(0 <= s <= 1 for _, s in got.values())
    assert {r["lang_pred"] for r in language_id.identify(docs, train.limit(0)).collect()} == {"und"}
    assert language_id.identify(empty, train).count() == 0


def test_quality(spark, docs, empty):
    rows = [(i, prose(60), 1) if i % 2 else (i, "buy now " * 40, 0) for i in range(300)]
    df = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(None, "x"), (900, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (7, None)], "doc_id long, quality int")
    got = {r["doc_id"]: r for r in quality.held_out_quality(df, labels).collect()}
    assert all(got[i]["predicted"] == y for i, _, y in rows) and len(got) == 302 and 0 <= got[900]["score"] <= 1
    assert got[5]["held_out"] == (zlib.crc32(b"5") % 3 == 1)
    assert quality.held_out_quality(docs, labels.limit(0)).count() == len(ROWS)
    assert quality.held_out_quality(empty, labels).count() == 0


def test_toxicity(spark, docs, empty):
    rows = [(i, prose(40) + (" vile rotten" if i % 5 == 0 else ""), int(i % 5 == 0)) for i in range(600)]
    df = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(None, "x"), (900, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows if i % 3], "doc_id long, toxic int")
    got = {r["doc_id"]: r["predicted"] for r in toxicity.held_out_toxicity(df, labels).collect()}
    wrong = sum(got[i] != y for i, _, y in rows)
    assert wrong <= 6 and len(got) == 602
    assert toxicity.held_out_toxicity(docs, labels.limit(0)).filter("predicted = 1").count() == 0
    assert toxicity.held_out_toxicity(empty, labels).count() == 0


def test_licenses(spark, docs, empty):
    apache = dict(licenses.TEMPLATES)["Apache-2.0-notice"]
    changed = apache.replace("except in compliance with", "unless you follow")
    rows = [(1, prose(50) + "\n" + changed + "\n" + prose(20)), (2, "É. Released under the MIT License. " + prose(10) + " Released under the MIT License."), (3, None), (4, "License"), (5, prose(40))]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("coverage", F.lit("x"))
    got = {(r["doc_id"], r["license_id"]): r for r in licenses.scan_licenses(df).collect()}
    assert 0.8 < got[1, "Apache-2.0-notice"]["coverage"] < 1 and len(got[2, "MIT-line"]["spans"]) == 2
    span = got[2, "MIT-line"]["spans"][0]
    assert rows[1][1].encode()[span["start"] : span["end"]] == b"Released under the MIT License"
    assert not any(d in (3, 4, 5) for d, _ in got)
    assert licenses.scan_licenses(docs).count() == 0 and licenses.scan_licenses(empty).count() == 0


def test_licenses_at_the_top_close_by_and_with_a_word_lost():
    scanner, templates = licenses.Scanner([*licenses.TEMPLATES, ("short", "All Rights Reserved")]), dict(licenses.TEMPLATES)
    spans = lambda text, name: [s for n, _, found in scanner.scan([text])[0] if n == name for s in found]
    grant = templates["MIT-grant"].replace("is hereby", "hereby")
    assert spans(grant, "MIT-grant")[0]["start"] == 0 and 0.9 < spans(grant, "MIT-grant")[0]["coverage"] < 1
    header = templates["Apache-2.0-notice"].split(" ", 3)[3]
    assert len(spans(header + " " + prose(20), "Apache-2.0-notice")) == 1
    lines = "\n".join(f"{w}: Released under the MIT License." for w in ["foo", "bar", "baz", "qux"])
    found = spans(lines, "MIT-line")
    assert [lines[s["start"] : s["end"]] for s in found] == ["Released under the MIT License"] * 4
    back_to_back = "Released under the MIT License. " * 5
    assert len(spans(back_to_back, "MIT-line")) == 5
    for text in ("Released under MIT License", "Released under the new MIT License", "Released, under: a the b MIT c License"):
        assert len(spans(prose(30) + " " + text + " " + prose(30), "MIT-line")) == 1
    assert len(spans("x all y rights z reserved", "short")) == 1 and not spans("all reserved", "short")
    better = " ".join(templates["MIT-grant"].split()[:36]) + " " + templates["MIT-grant"]
    assert max(s["coverage"] for s in spans(better, "MIT-grant")) == 1


def test_pipeline_quality_and_packing_with_awkward_rows(spark, tmp_path):
    """Nulls in every column, repeated rows, ids that share labels, labels without documents and empty tables."""
    import corpus_pipeline as p

    rng = random.Random(2)
    rows = [(i, prose(rng.randint(30, 80)) if i % 2 else "!!! $$$ " * rng.randint(5, 40), "en", "s", 1) for i in range(60)]
    rows += [(None, rows[1][1], None, None, None), rows[1], rows[1], (100, None, "en", "s", 0), (101, "", "en", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    labels = [(i, i % 2) for i in range(60)] + [(1, 1), (1, None), (None, 1), (999, 0)]
    schema = "doc_id long, quality int"
    spark.createDataFrame(labels, schema).write.parquet(f"{tmp_path}/labels.parquet")
    kept = p.keep_quality(spark, docs, str(tmp_path))
    got = Counter((r["doc_id"], r["text"]) for r in kept.collect())
    assert kept.columns == list(p.COLUMNS)
    assert {d for d, _ in got if d is not None and d < 60} == set(range(1, 60, 2)) and got[1, rows[1][1]] == 3 and got[None, rows[1][1]] == 1
    # Null and empty texts are alike to the classifier.
    assert ((100, None) in got) == ((101, "") in got)
    assert p.keep_quality(spark, docs.limit(0), str(tmp_path)).count() == 0
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/none/labels.parquet")
    assert p.keep_quality(spark, docs, f"{tmp_path}/none").columns == list(p.COLUMNS)
    pieces = as_rows(p.pack(spark, docs, str(tmp_path)), "doc_id", "start", "length", "doc_tokens")
    assert Counter(i for i, at, *_ in pieces if at == 0) == Counter(r[0] for r in rows)
    assert sum(n for *_, n, _ in pieces) == sum(n for _, at, _, n in pieces if at == 0)
    assert (100, 0, 1, 1) in pieces and (101, 0, 1, 1) in pieces and p.pack(spark, docs.limit(0), str(tmp_path)).count() == 0


def test_repeats_of_thousands_of_rows_and_a_variant(spark):
    rng = random.Random(9)
    text = "".join(rng.choice("abcdefgh ") for _ in range(1200))
    variant = text[:600] + "#" + text[601:]
    rows = [(i % 500, text) for i in range(3000)] + [(7000, variant), (None, None)]
    got = as_rows(repeats.repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(6)), "doc_id", "n_bytes", "n_removed", "n_spans")
    assert Counter(got) == Counter([*((i % 500, 1200, 1200, 1) for i in range(3000)), (7000, 1200, 1199, 2), (None, 0, 0, 0)])


def test_decontamination_of_repetitive_texts(spark):
    """One word over and over, in the items as in the texts."""
    items = [(1, "la " * 50), (2, "la la lo " * 20), (3, "la la la")]
    texts = [(1, "la " * 3000), (2, "la la lo " * 500), (3, "la " * 9 + "x " + "la " * 10), (4, "LA, la; " * 5), (5, "lo " * 40), (6, "la la"), (6, "la la")]
    windows = {}
    for i, t in items:
        ws = t.split()
        for k in range(max(1, len(ws) - 9)):
            windows.setdefault(tuple(ws[k : k + 10]), set()).add(i)
    want = []
    for i, t in texts:
        ws, hit, found = decontamination.words_of(t), set(), set()
        for n in (3, 10):
            for k in range(len(ws) - n + 1):
                if (of := windows.get(tuple(w for w in ws[k : k + n]))) is not None:
                    hit.update(range(k, k + n))
                    found |= of
        want.append((i, len(ws), len(hit), len(found)))
    docs, bench = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert as_rows(decontamination.contamination(docs, bench), "doc_id", "n_words", "n_hit", "n_items") == sorted(want, key=repr)


def plain_align(template, text):
    """Score, matched words of the best local alignments (every one of best score) in the whole table, without a band."""
    rows = [[{(0, 0)} for _ in range(len(text) + 1)] for _ in range(len(template) + 1)]
    best = {(0, 0)}
    for i, w in enumerate(template):
        for j, x in enumerate(text):
            cells = {(s + (2 if w == x else -1), m + (w == x)) for s, m in rows[i][j]} | {(s - 1, m) for s, m in rows[i][j + 1] | rows[i + 1][j]} | {(0, 0)}
            top = max(s for s, _ in cells)
            rows[i + 1][j + 1] = {c for c in cells if c[0] == top} if top > 0 else {(0, 0)}
            best |= rows[i + 1][j + 1] if top >= max(best)[0] else set()
            best = {c for c in best if c[0] == max(best)[0]}
    return best


def test_alignment_is_the_best_one():
    rng = np.random.default_rng(4)
    for _ in range(150):
        template, text = rng.integers(0, 6, rng.integers(1, 7)), rng.integers(0, 6, rng.integers(1, 7))
        # Short enough for the band to hold the whole table.
        matched, start, end = (int(x[0]) for x in licenses.align(template.astype(np.int32), text.astype(np.int32), np.array([0]), np.array([0]), np.array([len(text)])))
        best = plain_align(template, text)
        assert matched in {m for _, m in best}
        if matched:
            assert matched in {m for _, m in plain_align(template, text[start:end])} and plain_align(template, text[start:end]) <= best
    many = [np.array(x) for x in zip(*[(s, lo, 30) for s in range(-5, 30) for lo in range(0, 30, 7)])]
    template, text = rng.integers(0, 6, 12).astype(np.int32), rng.integers(0, 6, 30).astype(np.int32)
    together = np.stack(licenses.align(template, text, *many))
    alone = np.concatenate([np.stack(licenses.align(template, text, *(x[i : i + 1] for x in many))) for i in range(len(many[0]))], axis=1)
    assert (together == alone).all()
    for least in (3, 8, 12):
        bounded = np.stack(licenses.align(template, text, *many, least))
        assert (bounded[:, together[0] >= least] == together[:, together[0] >= least]).all()


def test_licenses_found_are_those_of_an_exhaustive_alignment():
    """Every template against every diagonal of texts that hold changed, shuffled and cut copies."""
    rng = random.Random(6)
    templates = [("a", prose(12)), ("b", prose(30)), ("c", prose(4)), ("d", "la la la lo la la")]
    scanner, texts = licenses.Scanner(templates), [None, "", "la " * 40]
    for _ in range(60):
        words = rng.choice(templates)[1].rstrip(".").split()
        for _ in range(rng.randint(0, len(words) // 2)):
            i = rng.randrange(len(words))
            words[i : i + 1] = rng.choice([[], [words[i], "x"], ["y"]]) or []
            words = words or ["z"]
        if rng.random() < 0.2:
            rng.shuffle(words)
        texts.append(" ".join([prose(rng.randint(0, 9)), *words, prose(rng.randint(0, 9))]))
    got = scanner.scan(texts)
    assert got == [scanner.scan([t])[0] for t in texts]
    for text, found in zip(texts, got):
        words = licenses.word_hashes(licenses._word.findall((text or "").encode().lower()))
        want = set()
        for name, template in templates:
            t = licenses.word_hashes(licenses._word.findall(template.encode().lower()))
            ids = {int(w): i for i, w in enumerate(np.unique(np.concatenate([t, words])))}
            t, x = (np.array([ids[int(w)] for w in a], np.int32) for a in (t, words))
            shifts = np.arange(-len(t), len(x) + 1)
            if len(x) and licenses.align(t, x, shifts, np.zeros_like(shifts), np.full_like(shifts, len(x)))[0].max() >= licenses.LEAST_COVERAGE * len(t):
                want.add(name)
        assert {n for n, _, _ in found} == want
        for _, best, spans in found:
            assert best == max(s["coverage"] for s in spans)
            assert all(a["end"] <= b["start"] for a, b in zip(spans, spans[1:]))


def test_full_license_texts_repeated_rows_and_ties(spark):
    mit, bsd = dict(licenses.TEMPLATES)["MIT"], dict(licenses.TEMPLATES)["BSD-3-Clause"]
    rows = [(1, prose(20) + "\nCopyright (c) 2001 N. N.\n" + mit + "\n" + prose(20)), (1, mit), (1, mit), (None, bsd.replace("copyright holder", "University")), (2, bsd[:300])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("license_id", F.lit("x")).withColumn("spans", F.lit("x"))
    found = licenses.scan_licenses(df).collect()
    assert sorted(r["coverage"] for r in found if r["license_id"] == "MIT") == [1.0, 1.0, 1.0]
    of_null = {r["license_id"]: r["coverage"] for r in found if r["doc_id"] is None}
    assert 0.9 < of_null["BSD-3-Clause"] < 1 and "MIT" not in of_null
    assert {r["license_id"] for r in found if r["doc_id"] == 2} == {"BSD-3-Clause-conditions"}
    # Two templates of the same words are both found.
    alike = licenses.scan_licenses(df, [("one", mit), ("two", mit), ("none", "...")])
    assert as_rows(alike, "doc_id", "license_id") == sorted([(1, n) for n in ("one", "two")] * 3, key=repr)


def test_pipeline_stages(spark):
    import corpus_pipeline as p

    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    n = docs.count()
    good = p.keep_quality(spark, docs, d)
    assert good.columns == docs.columns and 0.5 * n < good.count() <= n
    kept = p.keep_one_of_group(spark, docs, d)
    groups = {r["doc_id"]: r["component_id"] for r in near_dedup.near_groups(docs, size=5, percent=80).collect()}
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(groups.values()))
    cut = {r["doc_id"]: r for r in p.cut_repeats(spark, docs, d).collect()}
    assert {i: r["text"] for i, r in cut.items()} == without_passages({r["doc_id"]: r["text"] for r in docs.collect()}, p.PASSAGE_BYTES, p.PASSAGE_WORDS)
    clean = {r["doc_id"] for r in p.drop_contaminated(spark, docs, d).collect()}
    found = decontamination.contamination(docs, spark.read.parquet(f"{d}/benchmark.parquet"))
    assert clean == {r["doc_id"] for r in found.filter("not contaminated").collect()}
    assert [name for name, _ in p.STAGES] == ["quality", "near_dedup", "repeats", "decontamination", "packing"]
    assert p.run(spark, d).count() > 0


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    from tracemill.llm.registry import QUERIES

    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"create view {t} as select * from '{d}/{t}.parquet'")
    df = QUERIES[name](spark, d)
    cols = sorted(df.columns)
    cursor = con.execute(SQL[name])
    names = [c[0] for c in cursor.description]
    assert as_rows(df, *cols) == sorted((tuple(r[names.index(c)] for c in cols) for r in cursor.fetchall()), key=repr)
