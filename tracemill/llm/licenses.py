"""License scans: winnowed fingerprints and rare words pick candidates, banded alignment reports matches."""

from __future__ import annotations

import math
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.llm.decontamination import _word
from tracemill.llm.license_texts import FULL_TEXTS

#: Words in a fingerprinted gram, and grams of which winnowing keeps the least: runs of GRAM + WINDOW - 1 shared words are always seen.
#: Finds without such a run are seen by single words (``Scanner.rare``).
GRAM, WINDOW = 3, 2
#: Words that an alignment may drift from its diagonal, and the share of a template's words that make a match.
BAND, LEAST_COVERAGE = 6, 0.7
#: Words of all templates that one pass holds; more templates are scanned in several passes.
PASS_WORDS = 200_000
#: Words of texts that are scanned together, and cells that are compared at once; a longer text is scanned by itself.
SCAN_WORDS, SCAN_CELLS = 200_000, 4_000_000
LEXICON_ENTRIES = 500_000

#: Notices as their publishers word them, and full texts.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("Apache-2.0-line", "Licensed under the Apache License, Version 2.0."),
    ("MIT-line", "Released under the MIT License."),
    ("CC-BY-NC-4.0-line", "Licensed under CC BY-NC 4.0."),
    ("GPL-3.0-line", "This work is licensed under the GNU General Public License, version 3."),
    (
        "Apache-2.0-notice",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy'
        " of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ),
    (
        "MIT-grant",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to'
        " deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or"
        " sell copies of the Software",
    ),
    (
        "BSD-3-Clause-conditions",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    ),
    (
        "GPL-3.0-notice",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free"
        " Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    ("CC-BY-SA-4.0-line", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    *FULL_TEXTS,
)

_hashes: dict[bytes, int] = {}


def word_hashes(words: list[bytes]) -> np.ndarray:
    if len(_hashes) > LEXICON_ENTRIES:
        _hashes.clear()
    for w in set(words):
        if w not in _hashes:
            _hashes[w] = xxhash.xxh64_intdigest(w)
    return np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))


def fingerprints(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, hash) of the winnowed grams; fewer words than a gram are one gram."""
    n = len(words) - GRAM + 1
    if not len(words):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = np.zeros(max(n, 1), np.uint64)
    for j in range(min(GRAM, len(words))):
        h = (h ^ words[j : j + len(h)]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(32)
    if len(h) < WINDOW:
        return np.arange(len(h)), h
    windows = np.lib.stride_tricks.sliding_window_view(h, WINDOW)
    place = np.unique(np.arange(len(windows)) + WINDOW - 1 - windows[:, ::-1].argmin(axis=1))  # the last least one
    return place, h[place]


#: One number holds a cell's score, matched words and start (counted down), in this order.
_ONE, _HIT = 1 << 42, 1 << 21
MOST_WORDS = (1 << 20) - 2 * BAND - 1


def align(template: np.ndarray, text: np.ndarray, shift: np.ndarray, low: np.ndarray, high: np.ndarray, least: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best local alignment of each (shift, low, high): within BAND of the diagonal ``shift`` and the text's words [low, high).

    Returns matched words and the text's words [start, end).  A match scores 2, a difference or a gap -1; of equal
    scores the alignment that ends first in the template counts.  Where fewer than ``least`` of the template's words
    occur in the band, there is no such alignment and all three are 0.  All alignments go through the template together.
    """
    n, size = len(template), 2 * BAND + 1
    out = np.zeros((3, len(shift)), np.int64)
    step = max(1, SCAN_CELLS // (n * size))
    for at in range(0, len(shift), step):
        place = shift[at : at + step, None] - BAND + np.arange(n + size - 1)
        valid = (place >= low[at : at + step, None]) & (place < high[at : at + step, None])
        words = np.where(valid, text[np.clip(place, 0, len(text) - 1)], -1)
        same = np.lib.stride_tricks.sliding_window_view(words, size, axis=1) == template[:, None]
        some = np.flatnonzero(same.any(axis=2).sum(axis=1) >= least)
        if len(some):
            out[:, at + some] = _aligned(same[some], valid[some]) + np.array([[0], [1], [1]]) * (shift[at + some] - BAND)
    return out[0], out[1], out[2]


def _aligned(same: np.ndarray, valid: np.ndarray) -> np.ndarray:
    """Matched words, start and end, in columns of the band, for cells (alignment, template word, column in the band)."""
    many, n, size = same.shape
    steps = np.arange(size) * _ONE
    gain = np.where(same, 2 * _ONE + _HIT, -_ONE)
    before = np.full((many, size + 1), -(1 << 60))  # nothing stands right of the band
    before[:, :size] = _HIT - 1 - np.arange(size)
    best, end = np.zeros(many, np.int64), np.zeros(many, np.int64)
    rows = np.arange(many)
    for i in range(n):
        inside = valid[:, i : i + size]
        cell = np.maximum(before[:, :size] + gain[:, i], before[:, 1:] - _ONE)
        cell[~inside] = -(1 << 60)
        cell = np.maximum.accumulate(cell + steps, axis=1) - steps  # gaps along the text
        before[:, :size] = np.where(inside & (cell >= _ONE), cell, _HIT - 2 - i - np.arange(size))
        top = before[:, :size].argmax(axis=1)
        value = before[rows, top]
        better = value // _ONE > best // _ONE
        best[better], end[better] = value[better], (top + i + 1)[better]
    return np.stack([best // _HIT % _HIT, np.where(best > 0, _HIT - 1 - best % _HIT, 0), end])


class Postings:
    """(template, place) of each hash, in arrays sorted by hash."""

    def __init__(self, rows: list[tuple[int, int, int]]):
        hashes, template, place = np.array(sorted(rows), np.uint64).reshape(-1, 3).T
        self.keys, self.first = np.unique(hashes, return_index=True)
        self.first = np.append(self.first, len(hashes))
        self.template, self.place = template.astype(np.int64), place.astype(np.int64)

    def hits(self, places: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """Columns of template, diagonal and word of the text."""
        if not len(self.keys) or not len(hashes):
            return np.zeros((3, 0), np.int64)
        at = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
        met = np.flatnonzero(self.keys[at] == hashes)
        first, n = self.first[at[met]], np.diff(self.first)[at[met]]
        rows = np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())
        where = np.repeat(places[met], n)
        return np.stack([self.template[rows], where - self.place[rows], where])


class Scanner:
    def __init__(self, templates: list[tuple[str, str]]):
        self.names = [n for n, _ in templates]
        texts = [_word.findall(t.encode().lower()) for _, t in templates]
        hashes = [word_hashes(t) for t in texts]
        if any(len(t) > MOST_WORDS for t in texts):
            raise ValueError(f"a template has over {MOST_WORDS} words")
        self.vocabulary = np.unique(np.concatenate([np.zeros(0, np.uint64), *hashes]))
        self.words = [np.searchsorted(self.vocabulary, h).astype(np.int32) for h in hashes]
        self.least = [math.ceil(LEAST_COVERAGE * len(words)) for words in self.words]
        self.grams = Postings([(int(h), k, int(place)) for k, words in enumerate(hashes) for place, h in zip(*fingerprints(words))])
        # A find misses len - least of its template's words at most, so it has one of any len - least + 1 of them.
        used = Counter(w for words in texts for w in set(words))
        rare = []
        for k, words in enumerate(texts):
            order = sorted(range(len(words)), key=lambda i: (used[words[i]], -len(words[i]), i))
            rare += [(int(hashes[k][place]), k, place) for place in order[: len(words) - self.least[k] + 1]]
        self.rare = Postings(rare)

    def spans(self, k: int, text: np.ndarray, shift: np.ndarray, place: np.ndarray, low: np.ndarray, high: np.ndarray) -> list[tuple[int, int, int]]:
        """(start, end, matched words) of one template's finds, which do not overlap; better ones go first.

        A hit is a diagonal, a word and the bounds of its text.  Hits outside the finds are aligned
        again over the words between, until no find is left.
        """
        template, least = self.words[k], self.least[k]
        held = np.zeros(len(self.vocabulary) + 1, bool)
        held[template] = True
        ours = np.concatenate([[0], held[text].cumsum()])
        low, high = np.maximum(low, shift - BAND), np.minimum(high, shift + len(template) + BAND)
        # Far from enough words of the template there is nothing to align.
        left = np.stack([shift, place, low, high, *np.full((5, len(shift)), -1)])[:, ours[high] - ours[low] >= least]
        taken: list[tuple[int, int, int]] = []
        while left.shape[1]:
            starts, ends = np.array([(0, 0), *((a, b) for a, b, _ in taken), (len(text), len(text))]).T
            nth = np.searchsorted(starts[:-1], left[1], "right")
            out = left[1] >= ends[nth - 1]
            left, nth = left[:, out], nth[out]
            # Rows 4 and 5 are the bounds of the last alignment, 6 to 8 what it found.
            bounds = np.stack([np.maximum(left[2], ends[nth - 1]), np.minimum(left[3], starts[nth])])
            changed = (bounds != left[4:6]).any(axis=0)
            left[4:6], left[6:9, changed] = bounds, 0
            new = np.flatnonzero(changed & (ours[bounds[1]] - ours[bounds[0]] >= least))
            if len(new):
                asked, back = np.unique(np.stack([left[0, new], *bounds[:, new]]), axis=1, return_inverse=True)
                left[6:9, new] = np.stack(align(template, text, *asked, least))[:, back.ravel()]
            finds = left[6:9, left[6] >= least]
            if not finds.shape[1]:
                break
            for matched, start, end in sorted({(-m, a, b) for m, a, b in finds.T.tolist()}):
                nth_find = bisect_right(taken, (start, math.inf))
                if (not nth_find or taken[nth_find - 1][1] <= start) and (nth_find == len(taken) or end <= taken[nth_find][0]):
                    taken.insert(nth_find, (start, end, -matched))
        return taken

    def scan(self, texts: list[str | None]) -> list[list[tuple[str, float, list[dict]]]]:
        """(license, best coverage, spans in bytes) of the templates found in each text."""
        out, group, size = [], [], 0
        for text in texts:
            data = (text or "").encode().lower()
            found = _word.findall(data)
            if group and size + len(found) > SCAN_WORDS:
                out += self.scan_together(group)
                group, size = [], 0
            group.append((data, word_hashes(found)))
            size += len(found)
        return out + self.scan_together(group)

    def scan_together(self, group: list[tuple[bytes, np.ndarray]]) -> list[list[tuple[str, float, list[dict]]]]:
        """The words of all texts lie in one array; no alignment leaves its text."""
        out: list[list[tuple[str, float, list[dict]]]] = [[] for _ in group]
        first = np.concatenate([[0], np.cumsum([len(h) for _, h in group], dtype=np.int64)])
        if not first[-1] or not len(self.vocabulary):
            return out
        hashes = np.concatenate([h for _, h in group])
        grams = [fingerprints(h) for _, h in group]
        hits = np.concatenate(
            [
                self.grams.hits(np.concatenate([p + f for (p, _), f in zip(grams, first)]), np.concatenate([h for _, h in grams])),
                self.rare.hits(np.arange(len(hashes)), hashes),
            ],
            axis=1,
        )
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        text = np.where(self.vocabulary[at] == hashes, at, len(self.vocabulary)).astype(np.int32)
        owner = np.searchsorted(first, hits[2], "right") - 1
        bounds: dict[int, list[tuple[int, int]]] = {}
        for k in np.unique(hits[0]).tolist():
            of = hits[0] == k
            listed: dict[int, list[dict]] = {}
            for start, end, matched in self.spans(k, text, hits[1, of], hits[2, of], first[owner[of]], first[owner[of] + 1]):
                i = int(np.searchsorted(first, start, "right")) - 1
                if i not in bounds:
                    bounds[i] = [m.span() for m in _word.finditer(group[i][0])]
                a, b = bounds[i][start - first[i]][0], bounds[i][end - 1 - first[i]][1]
                listed.setdefault(i, []).append({"start": a, "end": b, "coverage": matched / len(self.words[k])})
            for i, spans in listed.items():
                out[i].append((self.names[k], max(s["coverage"] for s in spans), spans))
        return out


def scanned(text: Column, templates: list[tuple[str, str]]) -> Column:
    @F.pandas_udf("array<struct<license_id:string,coverage:double,spans:array<struct<start:int,end:int,coverage:double>>>>")
    def scan(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scanner = Scanner(templates)
        for texts in batches:
            yield pd.Series([[dict(zip(("license_id", "coverage", "spans"), f)) for f in found] for found in scanner.scan(texts.tolist())])

    return scan(text)


def scan_licenses(docs: DataFrame, templates: list[tuple[str, str]] = [*TEMPLATES], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``license_id``, ``coverage`` and ``spans`` (byte ranges with their coverage) of each template found in a whole text.

    Coverage is the share of the template's words that the alignment matches in
    order; overlapping finds of one template count once, the better one.  Null and empty texts have none, a repeated row
    reports its finds again, null ids are passed through, templates without words
    match nothing.  Templates are scanned in passes of at most PASS_WORDS words, so what is sent to
    the executors is bounded; a narrow job otherwise.
    """
    passes: list[list[tuple[str, str]]] = [[]]
    size = 0
    for t in templates:
        n = len(_word.findall(t[1].encode().lower()))
        if passes[-1] and size + n > PASS_WORDS:
            passes.append([])
            size = 0
        passes[-1].append(t)
        size += n
    out = None
    for part in passes:
        found = docs.select(F.col(id_col).alias("doc_id"), F.explode(scanned(F.col(text_col), part)).alias("f")).select("doc_id", "f.*")
        out = found if out is None else out.unionByName(found)
    return out
