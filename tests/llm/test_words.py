"""Spelling variants, byte-pair encoding and source divergence against brute force and the library."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracemill.llm import bpe, divergence, spelling, token_counts
from tracemill.llm.registry import tokenizer_file

RNG = random.Random(7)
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
BASES = ["marten", "martens", "murten", "été", "ÉTUDE", "étude", "straße", "colour", "color", "colours", "banana", "bananas", "banan", "x÷y×z", "Ökonom"]


def slip(w):
    i = RNG.randrange(len(w))
    return RNG.choice([w[:i] + w[i + 1 :], w[:i] + RNG.choice("abé") + w[i + 1 :], w[:i] + RNG.choice("abé") + w[i:]])


def prose(n):
    return " ".join(w if RNG.random() < 0.6 else slip(w) for w in RNG.choices(BASES, k=n)) + RNG.choice([".", "!!'s", " 漢字 1x2 "])


TEXTS = [None, "", "  \n ", "Банан банан", "aaaaaa " * 5 + "aaaaa " * 3 + "aaaaaaa " * 9, *[prose(RNG.randint(1, 60)) for _ in range(40)], prose(4000)]
ROWS = [(i, t, ("en", "de", None)[i % 3], ("s0", "s1", None, "s2", "s0")[i % 5]) for i, t in enumerate(TEXTS)]
ROWS += [ROWS[9], ROWS[9], (None, prose(30), "en", "s1"), (77, None, "xx", "s9"), (78, "once only", "yy", "s1"), (79, "", "yy", "s2")]


@pytest.fixture(scope="module")
def docs(spark):
    """With further columns whose names clash with those the operators make."""
    schema = "doc_id long, text string, lang string, source string, word string, n string, term string, item string, ids string, key string, total string, m string, c string"
    return spark.createDataFrame([(*r, *["x"] * 9) for r in ROWS], schema).repartition(3)


def brute_words(rows, slips, min_length=5, min_count=3):
    met = Counter()
    for i, t, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if slips and h % slips == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            met[w] += 1
    return {w: n for w, n in met.items() if len(w) >= min_length and n >= min_count}


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_groups(words, ratio=2):
    rows = {}
    for w, n in words.items():
        others = [x for x in words if near(w, x)]
        best = min(others, key=lambda x: (-words[x], x), default=None)
        form = best if best is not None and words[best] >= ratio * n else None
        rows[w] = (n, form, len(others), words[form] if form is not None else None)

    def root(w):
        while rows[w][1] is not None:
            w = rows[w][1]
        return w

    return {(w, n, form, root(w), k, m) for w, (n, form, k, m) in rows.items()}


@pytest.mark.parametrize("slips", [0, 5, 97])
def test_word_counts(docs, slips):
    found = {(r.word, r.n) for r in spelling.word_counts(docs, slips=slips).collect()}
    assert found == set(brute_words(ROWS, slips).items()) and found


def test_variant_groups(docs):
    words = brute_words(ROWS, 5)
    found = spelling.variant_groups(spelling.word_counts(docs, slips=5)).collect()
    assert {tuple(r) for r in found} == brute_groups(words)
    assert len(found) == len(words) and any(r.form for r in found)
    assert any(r.root not in (r.form, r.word) for r in found), "a chain of two forms"


def test_variant_groups_awkward_words(spark):
    """Words of one or no letter, ties, runs of one letter, letters of several bytes."""
    words = {"": 3, "a": 8, "b": 8, "ab": 2, "aa": 1, "aaa": 4, "éa": 4, "é": 9, "😀": 1, "😀a": 2, "ba": 2, "zzzz": 1}
    found = spelling.variant_groups(spark.createDataFrame([*words.items()], "word string, n long")).collect()
    assert {tuple(r) for r in found} == brute_groups(words)


def test_variant_groups_random(spark):
    words = {"".join(RNG.choices("abc", k=RNG.randint(1, 6))): RNG.randint(1, 40) for _ in range(300)}
    found = spelling.variant_groups(spark.createDataFrame([*words.items()], "word string, n long"), ratio=2).collect()
    assert {tuple(r) for r in found} == brute_groups(words)


def test_words_of_nothing(docs):
    nothing = docs.limit(0)
    assert spelling.variant_groups(spelling.word_counts(nothing, slips=97)).count() == 0
    assert divergence.audit_sources(nothing).count() == 0
    assert bpe.encode_texts(nothing, tokenizer_file("byte_bpe_50k.json")).count() == 0


def test_bpe_rows(docs):
    from tokenizers import Tokenizer

    path = tokenizer_file("byte_bpe_50k.json")
    lib = Tokenizer.from_file(path)
    ids = [(i, lib.encode(t or "", add_special_tokens=False).ids) for i, t, *_ in ROWS]
    expected = sorted(((i, len(x), x, lib.decode(x, skip_special_tokens=False)) for i, x in ids), key=repr)
    for rows in (bpe.decode_ids(bpe.encode_texts(docs, path), path), bpe.encode_texts(docs, path, decoded=True)):
        assert sorted(((r.doc_id, r.n_tokens, np.frombuffer(r.ids, "<u4").tolist(), r.decoded) for r in rows.collect()), key=repr) == expected


def test_bpe_any_text():
    """Texts of the signs that pre-tokenizers treat specially; ids that begin and end within a code point."""
    from tokenizers import Tokenizer

    path = tokenizer_file("byte_bpe_50k.json")
    lib = Tokenizer.from_file(path)
    encoder, decoder = bpe.BoundaryEncoder(path, bpe.kinds_of(token_counts.character_classes())), bpe.TokenBytes(path)
    signs = [*"aZstmdrvelqjxz'  \n\t'!?#1٣9éñ 　😀漢字\x1c\x85 ", "'re", "'ll", "'s", "!!'s", "<|endoftext|>", "<|endof", "  ", "\r\n", "==="]
    texts = ["".join(RNG.choices(signs, k=RNG.randint(0, 60))) for _ in range(5000)] + ["a" * 3000 + " " * 3000, "qj" * 500, ""]
    got, ref = encoder.encode(texts), lib.encode_batch(texts, add_special_tokens=False)
    assert all(np.frombuffer(g, "<u4").tolist() == r.ids for g, r in zip(got, ref))
    assert [*map(decoder.decode, got)] == texts
    odd = [[RNG.randrange(50257) for _ in range(12)] for _ in range(500)]
    assert [decoder.decode(np.array(x, "<u4").tobytes()) for x in odd] == [lib.decode(x, skip_special_tokens=False) for x in odd]
    assert decoder.decode(np.array([60_000], "<u4").tobytes()) == ""


def test_bpe_cuts_are_forced():
    """No token holds a pair at which a fragment ends, and long words are cut as well."""
    path = tokenizer_file("byte_bpe_50k.json")
    encoder = bpe.BoundaryEncoder(path, bpe.kinds_of(token_counts.character_classes()))
    fragments, begins = encoder.fragments(["One fqjx two", "", "x"])
    assert "".join(fragments) == "One fqjx twox" and begins.tolist()[-1] == len(fragments)
    assert len(fragments) > 4, "a pair of letters that no token has cuts a word"


def brute_audit(rows, min_docs=3, top=200):
    rows = [(i, *("" if x is None else x for x in r)) for i, *r in rows]
    groups = sorted({(lang, source) for _, _, lang, source in rows})
    out = set()
    for lang in {g for g, _ in groups}:
        count, df = {}, Counter()
        for _, text, g, source in rows:
            if g == lang:
                words = Counter(w.translate(LOWER) for w in re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", text))
                df.update(words.keys())
                for w, n in words.items():
                    count[source, w] = count.get((source, w), 0) + n
        kept = [w for w in df if df[w] >= min_docs]
        sources = [s for g, s in groups if g == lang]
        of = {s: {w: count.get((s, w), 0) for w in kept} for s in sources}
        of[None] = {w: sum(of[s][w] for s in sources) for w in kept}
        p = {s: {w: 1 + Fraction(10**9 * (c + 1), sum(x.values()) + len(kept)).__floor__() for w, c in x.items()} for s, x in of.items()}
        f = lambda a, b: (a - b) ** 2 // b
        for s in sources:
            pair = sorted(((t, sum(f(p[s][w], p[t][w]) for w in kept)) for t in sources if t != s), key=lambda x: (-x[1], x[0].encode()))
            term = sorted(((w, f(p[s][w], p[None][w])) for w in kept if of[s][w] and p[s][w] > p[None][w]), key=lambda x: (-x[1], x[0].encode()))[:top]
            out |= {(lang, s, part, item, v, i) for part, found in (("pair", pair), ("term", term)) for i, (item, v) in enumerate(found, 1)}
    return out


@pytest.mark.parametrize(("min_docs", "top"), [(3, 200), (1, 5), (10_000, 5)])
def test_audit_sources(docs, min_docs, top):
    found = divergence.audit_sources(docs, min_docs, top).collect()
    assert {tuple(r) for r in found} == brute_audit(ROWS, min_docs, top)
    assert len(found) == len(set(found))


def test_audit_small_blocks(docs, monkeypatch):
    """Terms that go on in the next block are tallied once."""
    kept = divergence.kept_terms(divergence.term_counts(docs), 1)
    rows = kept.orderBy("lang", "term", "source").select("lang", "term", "source", "n").toPandas()
    whole = {tuple(r)[:5]: r[5] for t in divergence.tallies(rows) for r in t.itertuples(index=False)}
    monkeypatch.setattr(divergence, "TALLY_PAIRS", 3)
    parts = Counter()
    for t in divergence.tallies(rows):
        for r in t.itertuples(index=False):
            parts[tuple(r)[:5]] += r[5]
    assert whole == dict(parts) and whole


def test_probability_of_large_counts(spark):
    rows = spark.createDataFrame([(3 * 10**12, 10**13, 10**7)], "c long, total long, vocabulary long")
    assert rows.select(divergence.probability("c", "total")).first()[0] == 1 + 10**9 * (3 * 10**12 + 1) // (10**13 + 10**7)
    assert rows.select(F.lit(10**9 + 1).cast("long").alias("p"), F.lit(1).cast("long").alias("q")).select(divergence.divergence("p", "q")).first()[0] == 10**18


def test_runs_of_signs_behind_letters_are_learnt_once():
    """Ids equal the library's, and a word with signs behind it takes the word's ids; before, each such word went through the whole tokenizer."""
    from tokenizers import Tokenizer

    from tracemill.llm import packing

    path = tokenizer_file("word_bpe_49k.json")
    encoder, library = packing.WordEncoder(path), Tokenizer.from_file(path)
    words = ["Haus", "\u00e9t\u00e9", "wor\u0301d", "a1", "don't", "x's", "\u03a3\u03a3", "\u4e2d", ""]
    tails = ["###", ".&&&", ",!!", "'", "'s", ".'s", "...", "-", "-x", "<=>", "<\u0338", ").", "$1", "\u0301.", "\u2026.", "[unk]", "<|endoftext|>", "<|ENDOFTEXT|>"]
    texts = [f"{w}{t} {w} {t}" for w in words for t in tails]
    got = encoder.encode(texts)
    assert got == [np.array(library.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    calls = []
    encoder.tokenizer = type("Counting", (), {"encode_batch": lambda _, block, **k: calls.extend(block) or library.encode_batch(block, **k)})()
    encoder.encode(["garten### garten.&&& garten,!!"])
    assert calls == []
