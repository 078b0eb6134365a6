"""Byte-pair encoding by forced boundaries, and decoding.

A pair of bytes that stands side by side inside no token of the vocabulary can
never be merged over, so a text may be cut there whatever stands around it.
These cuts are read off a table of 256 x 256 pairs for a whole stream of texts
at once.  The fragments between them are encoded each for itself and the ids
joined in order; a worker keeps a lexicon of fragments it has met.

A cut must not move the places where the pre-tokenizer cuts either.  Its rules
read from left to right and look ahead over white space only, so it begins anew
at every such pair but three kinds, which are therefore left whole: white
space before something else (a blank belongs to what follows), an apostrophe
before a letter and a sign before an apostrophe (contractions).
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.llm.packing import _byte_level
from tracemill.llm.token_counts import CLASSES, character_classes

#: A worker's lexicon is emptied at this many fragments (bounded memory; results do not depend on it).
LEXICON_ENTRIES = 200_000
#: Longer fragments are encoded each time they come.
LEXICON_CHARS = 64
#: Characters cut up at a time.
STREAM_CHARS = 500_000
#: Rows that a worker answers at a time.
BATCH_ROWS = 512

LETTER, DIGIT, WHITE, QUOTE, SIGN = range(5)


def kinds_of(classes: np.ndarray) -> np.ndarray:
    """The five kinds that matter here, from the transducer's character classes."""
    kind = {"digit": DIGIT, "space": WHITE, "white": WHITE, "quote": QUOTE, "punct": SIGN, "end": SIGN}
    return np.array([kind.get(c, LETTER) for c in CLASSES], np.uint8)[classes]


def pairs_inside(tokens: list[bytes]) -> np.ndarray:
    """Which byte may follow which inside a token."""
    inside = np.zeros((256, 256), bool)
    for t in tokens:
        b = np.frombuffer(t, np.uint8)
        inside[b[:-1], b[1:]] = True
    return inside


class BoundaryEncoder:
    """A worker's table of cuts and lexicon for one vocabulary of byte-level pairs."""

    def __init__(self, tokenizer_path: str, kinds: np.ndarray):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        byte = {c: b for b, c in _byte_level().items()}
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        tokens = [bytes(byte[c] for c in t) for t in self.tokenizer.get_vocab(with_added_tokens=False) if t not in special]
        self.special = re.compile("(" + "|".join(re.escape(s) for s in sorted(special, key=len, reverse=True)) + ")") if special else None

        points = np.arange(0x110000, dtype=np.uint32)
        first = np.select([points < 0x80, points < 0x800, points < 0x10000], [points, 0xC0 | points >> 6, 0xE0 | points >> 12], 0xF0 | points >> 18)
        last = np.where(points < 0x80, points, 0x80 | points & 0x3F)
        # For each code point its row (as the left one) and column (as the right one) in the table of cuts.
        self.left, self.right = ((x * 5 + kinds).astype(np.int32) for x in (last, first))
        anew = np.ones((5, 5), bool)
        anew[WHITE, [LETTER, DIGIT, QUOTE, SIGN]] = False
        anew[QUOTE, LETTER] = False
        anew[[SIGN, QUOTE], QUOTE] = False
        never = ~pairs_inside(tokens)
        self.cut = (never[:, None, :, None] & anew[None, :, None, :]).reshape(-1)
        self.lexicon: dict[str, bytes] = {}

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        found: list[bytes] = []
        at = 0
        while at < len(texts):
            upto, chars = at, 0
            while upto < len(texts) and (upto == at or chars + len(texts[upto]) <= STREAM_CHARS):
                chars += len(texts[upto])
                upto += 1
            found += self._encode_stream(texts[at:upto])
            at = upto
        return found

    def fragments(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """All fragments of the texts in order, and where each text's begin (with the end after the last)."""
        stream = "".join(texts)
        starts = np.cumsum([0, *map(len, texts)])
        points = np.frombuffer(stream.encode("utf-32-le"), np.uint32)
        cuts = np.zeros(len(points) + 1, bool)
        if len(points):
            cuts[1:-1] = self.cut[self.left[points[:-1]] * np.int32(1280) + self.right[points[1:]]]
        if self.special is not None:
            for i, t in enumerate(texts):
                for m in self.special.finditer(t):
                    a, b = starts[i] + m.start(), starts[i] + m.end()
                    cuts[a:b] = False
                    cuts[[a, b]] = True
        cuts[starts] = True
        places = np.flatnonzero(cuts)
        at = places.tolist()
        return [stream[a:b] for a, b in zip(at, at[1:])], np.searchsorted(places, starts)

    def _encode_stream(self, texts: list[str]) -> list[bytes]:
        fragments, begins = self.fragments(texts)
        if len(self.lexicon) > LEXICON_ENTRIES:
            self.lexicon.clear()
        missing = [w for w in set(fragments) if w not in self.lexicon]
        for at in range(0, len(missing), 20_000):
            block = missing[at : at + 20_000]
            for w, e in zip(block, self.tokenizer.encode_batch_fast(block, add_special_tokens=False)):
                self.lexicon[w] = np.array(e.ids, "<u4").tobytes()
        ids = [*map(self.lexicon.__getitem__, fragments)]
        for w in missing:
            if len(w) > LEXICON_CHARS:
                del self.lexicon[w]
        bounds = begins.tolist()
        return [b"".join(ids[a:b]) for a, b in zip(bounds, bounds[1:])]


class TokenBytes:
    """The bytes that each id stands for."""

    def __init__(self, tokenizer_path: str):
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(tokenizer_path)
        byte = {c: b for b, c in _byte_level().items()}
        vocab = tokenizer.get_vocab(with_added_tokens=True)
        self.bytes = [b""] * (max(vocab.values()) + 1)
        for t, i in vocab.items():
            self.bytes[i] = bytes(byte[c] for c in t) if all(c in byte for c in t) else t.encode()

    def decode(self, ids: bytes) -> str:
        numbers = np.frombuffer(ids, "<u4")
        known = numbers if not len(numbers) or numbers.max() < len(self.bytes) else numbers[numbers < len(self.bytes)]
        return b"".join(map(self.bytes.__getitem__, known.tolist())).decode("utf-8", "replace")


_encoders: dict[str, BoundaryEncoder] = {}
_decoders: dict[str, TokenBytes] = {}


def _worker(kept: dict, tokenizer_path: str, make: Callable[[], object]) -> object:
    if tokenizer_path not in kept:
        kept[tokenizer_path] = make()
    return kept[tokenizer_path]


def encode_texts(docs: DataFrame, tokenizer_path: str, decoded: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``n_tokens`` and ``ids`` (binary: little-endian unsigned 32-bit ids) of every whole text.

    With ``decoded`` also what ``decode_ids`` makes of the ids, in the same pass.
    The ids are those that the ``tokenizers`` library gives without begin, end or
    added special tokens; special strings inside a text are one id each.  A row for
    each input row: a null text counts as empty (no ids), a null id stays null,
    repeated rows stay repeated, an empty table gives no rows.  Only the two named
    columns are read, so further columns of any name do not matter.  A narrow
    job without a shuffle; memory is bounded by ``STREAM_CHARS`` and the longest text.
    """
    shared = docs.sparkSession.sparkContext.broadcast(kinds_of(character_classes()))

    @F.pandas_udf("ids binary, decoded string" if decoded else "ids binary")
    def encoded(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        encoder = _worker(_encoders, tokenizer_path, lambda: BoundaryEncoder(tokenizer_path, shared.value))
        decoder = _worker(_decoders, tokenizer_path, lambda: TokenBytes(tokenizer_path)) if decoded else None
        for texts in batches:
            for at in range(0, len(texts), BATCH_ROWS):
                ids = encoder.encode(texts.iloc[at : at + BATCH_ROWS].tolist())
                yield pd.DataFrame({"ids": ids} | ({"decoded": [*map(decoder.decode, ids)]} if decoder else {}), dtype=object)

    rows = docs.select(F.col(id_col).alias("doc_id"), encoded(F.coalesce(F.col(text_col), F.lit(""))).alias("e"))
    return rows.select("doc_id", (F.octet_length("e.ids") / 4).cast("long").alias("n_tokens"), "e.*")


def decode_ids(encoded: DataFrame, tokenizer_path: str, ids_col: str = "ids") -> DataFrame:
    """Add ``decoded``, the text of the ids in ``ids_col`` (null ids: null; an id outside the vocabulary adds nothing)."""

    @F.pandas_udf("string")
    def text_of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        decoder = _worker(_decoders, tokenizer_path, lambda: TokenBytes(tokenizer_path))
        for rows in batches:
            yield pd.Series([None if r is None else decoder.decode(r) for r in rows], dtype=object)

    return encoded.withColumn("decoded", text_of(F.col(ids_col)))
