"""Packing token sequences: shortest-pack-first over the length histogram.

Documents become pieces of at most ``capacity`` tokens.  Only the histogram of
piece lengths (at most ``capacity`` numbers) reaches the driver.  Lengths are
placed longest first; each goes to the open packing pattern with the most room
left, and the pattern's count is split or updated, so the work depends on the
number of distinct lengths, not of documents.  The finished patterns state
which ranks of each length go where; they join back to the pieces by rank.
"""

from __future__ import annotations

import os
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from struct import pack

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracemill.llm.common import bounded_batches, written

#: A worker's lexicon is pruned when it holds this many entries (bounded memory; results do not depend on it).
LEXICON_ENTRIES = 400_000
#: Rows of one length that one task ranks, about.
RANKED_ROWS = 100_000


# --- tokens ---------------------------------------------------------------


def _byte_level() -> dict[int, str]:
    """The printable character that byte-level vocabularies write for each byte."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


_byte_characters = _byte_level()
#: Signs that never belong to the letters before them (an apostrophe can).
_SIGNS = b'!"#$%&()*+,-./:;<=>?@[\\]^_`{|}~'


class WordEncoder:
    """Ids of whole texts from a lexicon of blank-separated parts.

    Valid for vocabularies that lower-case, whose pre-tokens never span a blank
    and keep letters apart from a run of ASCII signs other than apostrophes; blanks give no ids.
    """

    def __init__(self, tokenizer_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        self.model = self.tokenizer.model
        self.lexicon: dict[bytes, bytes] = {}
        self.again: set[bytes] = set()
        self.batches = 0
        # Special strings are met as written, before anything is lower-cased. A key with a blank in front is no part of a text.
        special = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.special = re.compile(b"(" + b"|".join(re.escape(s.encode()) for s in special) + b")") if special else None
        self.special_ids = {b" " + s.encode(): np.array([i], "<u4").tobytes() for s, i in special.items()}
        self.lookalikes = [(s, s.title() if s.title() != s else s.upper()) for s in special]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        parts = [self.parts((t or "").encode()) for t in texts]
        every = set().union(*parts)
        if len(self.lexicon) > LEXICON_ENTRIES:
            # Words met again since they were learnt stay; a sample of the batches tells which.
            self.lexicon = {w: self.lexicon[w] for w in self.again} if len(self.again) < LEXICON_ENTRIES // 2 else {}
            self.again = set()
        self.lexicon[b""] = b""
        self.lexicon.update(self.special_ids)
        if self.batches % 8 == 0:
            self.again.update(every - every.difference(self.lexicon))
        self.batches += 1
        self._learn(every)
        get = self.lexicon.__getitem__
        return [b"".join(map(get, p)) for p in parts]

    def parts(self, text: bytes) -> list[bytes]:
        """Blank-separated parts, and special strings with a blank in front."""
        if self.special is not None and self.special.search(text):
            split = self.special.split(text)
            return [p for i, s in enumerate(split) for p in ([b" " + s] if i % 2 else self.plain_parts(s))]
        return self.plain_parts(text)

    @staticmethod
    def plain_parts(text: bytes) -> list[bytes]:
        # Lower-casing ASCII first only makes more parts alike; the vocabulary's normaliser does the rest.
        return text.lower().replace(b"\n", b" ").replace(b"\t", b" ").split(b" ")

    def unspecial(self, w: str) -> str:
        """What lower-casing made look like a special string is written so that the library takes it as text."""
        for s, other in self.lookalikes:
            w = w.replace(s, other)
        return w

    def _learn(self, parts: set[bytes]) -> None:
        lexicon, tokenize = self.lexicon, self.model.tokenize
        missing = parts.difference(lexicon)
        if not missing:
            return
        # A run of signs behind a letter is a pre-token of its own.
        ended = {w: (base, w[len(base) :]) for w in missing if w[-1] in _SIGNS and (base := w.rstrip(_SIGNS))[-1:].isalpha()}
        odd = []
        for raw in missing.difference(ended).union(*ended.values()).difference(lexicon):
            w = raw.decode()
            # A lower-case Latin word is one pre-token that the normaliser leaves alone: straight to the model.
            plain = raw.isalpha() if raw.isascii() else w.isalpha() and max(w) < "\u0250" and w.islower() and w == w.lower()
            if plain and len(w) < 100:
                ids = [t.id for t in tokenize(w if raw.isascii() else raw.decode("latin-1").translate(_byte_characters))]
                lexicon[raw] = pack(f"<{len(ids)}I", *ids)
            else:
                odd.append(w)
        for at in range(0, len(odd), 5_000):
            block = odd[at : at + 5_000]
            for w, e in zip(block, self.tokenizer.encode_batch([*map(self.unspecial, block)], add_special_tokens=False)):
                ids = e.ids
                lexicon[w.encode()] = pack(f"<{len(ids)}I", *ids)
        for w, (base, signs) in ended.items():
            lexicon[w] = lexicon[base] + lexicon[signs]


_encoders: dict[str, WordEncoder] = {}


def token_pieces(docs: DataFrame, tokenizer_path: str, end_id: int, capacity: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Cut each document's ids (with ``end_id`` after them) into pieces of at most ``capacity``."""
    bounded_batches(docs.sparkSession)
    schema = "start array<long>, length array<long>, crc array<long>, doc_tokens long"

    @F.pandas_udf(schema)
    def cut(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        encoder = _encoders.get(tokenizer_path)
        if encoder is None:
            encoder = _encoders[tokenizer_path] = WordEncoder(tokenizer_path)
        last = np.array([end_id], "<u4").tobytes()
        for texts in batches:
            rows = []
            values = texts.tolist()
            for at in range(0, len(values), 64):
                for ids in encoder.encode(values[at : at + 64]):
                    ids += last
                    n = len(ids) // 4
                    starts = range(0, n, capacity)
                    rows.append(
                        ([*starts], [min(capacity, n - s) for s in starts], [zlib.crc32(ids[4 * s : 4 * (s + capacity)]) for s in starts], n)
                    )
            yield pd.DataFrame(rows, columns=["start", "length", "crc", "doc_tokens"])

    return (
        docs.select(F.col(id_col).alias("doc_id"), cut(F.coalesce(F.col(text_col), F.lit(""))).alias("c"))
        .select("doc_id", "c.doc_tokens", F.explode(F.arrays_zip("c.start", "c.length", "c.crc")).alias("p"))
        .select("doc_id", "p.start", "p.length", F.col("p.crc").alias("ids_crc32"), "doc_tokens")
    )


# --- patterns -------------------------------------------------------------


def packing_patterns(histogram: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns of lengths, and how many packs follow each.

    ``histogram`` maps a length (1 to ``capacity``) to a number of pieces.  Every
    piece is placed once.  Each step either finishes a length or uses up one
    pattern's packs, so patterns number at most a few for each distinct length,
    however many pieces there are.
    """
    by_room: dict[int, list[list]] = defaultdict(list)  # room left -> [pattern, count]
    done: list[tuple[tuple[int, ...], int]] = []

    def keep(pattern: tuple[int, ...], room: int, count: int) -> None:
        if room:
            by_room[room].append([pattern, count])
        else:
            done.append((pattern, count))

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            room = max((r for r, packs in by_room.items() if packs and r >= length), default=0)
            if not room:
                keep((length,), capacity - length, left)
                break
            pattern, count = by_room[room].pop()
            used = min(count, left)
            if count > used:
                by_room[room].append([pattern, count - used])
            keep((*pattern, length), room - length, used)
            left -= used
    return done + [(tuple(p), n) for packs in by_room.values() for p, n in packs]


def pattern_slots(patterns: list[tuple[tuple[int, ...], int]]) -> list[tuple]:
    """(length, first rank, pieces of the length in a pack, packs, first pack, offsets) for each pattern and length."""
    rank: dict[int, int] = defaultdict(int)
    slots, pack = [], 0
    for pattern, count in patterns:
        offsets: dict[int, list[int]] = defaultdict(list)
        at = 0
        for length in pattern:
            offsets[length].append(at)
            at += length
        for length, places in offsets.items():
            slots.append((length, rank[length], len(places), count, pack, places))
            rank[length] += len(places) * count
        pack += count
    return slots


def ranked_within(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Add ``rank`` (from 0, gapless) within ``key``, however many rows one key holds.

    Rows of a key are dealt by hash into groups of about ``RANKED_ROWS``; the
    groups' sizes, counted first, give each group its first rank.
    """
    groups = max(1, -(-df.count() // RANKED_ROWS) * 4)
    dealt = df.withColumn("_g", F.pmod(F.xxhash64(*order), F.lit(groups)).cast("int"))
    before = Window.partitionBy(key).orderBy("_g").rowsBetween(Window.unboundedPreceding, -1)
    firsts = dealt.groupBy(key, "_g").agg(F.count(F.lit(1)).alias("_n")).select(key, "_g", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    within = Window.partitionBy(key, "_g").orderBy(*order)
    return (
        dealt.withColumn("_r", F.row_number().over(within) - 1)
        .join(firsts, [key, "_g"])
        .withColumn("rank", F.col("_first") + F.col("_r"))
        .drop("_g", "_r", "_first")
    )


def pack_pieces(pieces: DataFrame, capacity: int, order: list[str]) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces with a ``length`` from 1 to ``capacity``.

    ``order`` names columns that tell pieces apart; rows alike in all of them are
    interchangeable.  ``pieces`` should be stored, as it is read three times.
    """
    spark = pieces.sparkSession
    # At most ``capacity`` rows come here.
    histogram = {int(r["length"]): int(r["n"]) for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    slots = pattern_slots(packing_patterns(histogram, capacity))
    plan = spark.createDataFrame(slots, "_length long, _rank long, _m long, _packs long, _pack long, _offsets array<long>")
    place = F.col("rank") - F.col("_rank")
    return (
        ranked_within(pieces, "length", order)
        # The plan's size follows from ``capacity``, not from the pieces (see packing_patterns).
        .join(F.broadcast(plan), (F.col("length") == F.col("_length")) & (place >= 0) & (place < F.col("_m") * F.col("_packs")))
        .withColumn("sequence_id", F.col("_pack") + F.floor(place / F.col("_m")))
        .withColumn("offset", F.element_at("_offsets", (F.pmod(place, F.col("_m")) + 1).cast("int")))
        .drop("rank", "_length", "_rank", "_m", "_packs", "_pack", "_offsets")
    )


def pack_documents(docs: DataFrame, tokenizer_path: str, end_id: int = 1, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pack whole documents into sequences of at most ``capacity`` tokens.

    A document is its ids followed by ``end_id``, cut every ``capacity`` ids; each
    id lies in exactly one piece.  Returns a row for each piece: ``doc_id``,
    ``start``, ``length``, ``ids_crc32``, ``doc_tokens``, ``sequence_id`` (gapless from 0)
    and ``offset`` (gapless from 0 within a sequence).  A null or empty text is
    the one id ``end_id``; repeated rows are packed each for itself, a null id
    stays null, an empty table gives no rows.  Only the two named columns are read.
    """
    pieces = written(token_pieces(docs, tokenizer_path, end_id, capacity, id_col, text_col), "pieces")
    packed = pack_pieces(pieces, capacity, ["doc_id", "start", "ids_crc32", "doc_tokens"])
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
