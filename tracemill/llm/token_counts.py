"""Token counts with a compiled pre-token transducer and composed chunk state maps.

The split of a text into pre-tokens is a regular language, so it is compiled
once into a deterministic transducer over character classes.  A transition is
annotated with what it emits: whether a pre-token ends before the character
just read, or before the one ahead of it (white space needs one character of
delay).  A text stream is cut into chunks of equal length.  All chunks advance
in lockstep from every entry state, which gives each chunk's state map; the
maps compose by a parallel prefix scan to each chunk's true entry state; a
second lockstep pass then reads the emissions.

What a closing transition emits in tokens depends on the whole pre-token: the
merge rules of a byte-pair vocabulary have no transducer of useful size.  The
count is taken from a lexicon of pre-tokens that each worker compiles lazily
with the ``tokenizers`` library, so it equals the library's by construction.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A worker's lexicon is emptied when it holds this many pre-tokens (bounded memory; results do not depend on it).
LEXICON_ENTRIES = 400_000
#: Characters handled at once, and in one chunk of the lockstep.
STREAM_CHARS = 1_500_000
CHUNK = 512

STATES = ("start", "letters", "digits", "punct", "space1", "other1", "space2", "other2", "quote", "quote_r", "quote_v", "quote_l", "suffix")
CLASSES = ("letter", "stmd", "r", "v", "e", "l", "digit", "space", "white", "quote", "punct", "end")
BEFORE, DELAYED = 1, 2


def compile_transducer() -> tuple[np.ndarray, np.ndarray]:
    """Next state and emission for each state and class."""
    s = {n: i for i, n in enumerate(STATES)}
    letters = {"letter", "stmd", "r", "v", "e", "l"}

    def opened(c: str) -> str:
        """The state after a character that begins a pre-token."""
        if c in letters:
            return "letters"
        return {"digit": "digits", "space": "space1", "white": "other1", "quote": "quote", "punct": "punct", "end": "start"}[c]

    def step(state: str, c: str) -> tuple[str, int]:
        if state in ("quote_r", "quote_v", "quote_l"):
            if c == {"quote_r": "e", "quote_v": "e", "quote_l": "l"}[state]:
                return "suffix", 0
            # Not a contraction: the quote stands alone and the letter began a run.
            after, emits = step("letters", c)
            return after, emits | DELAYED
        if c == "end":
            return "start", BEFORE
        if state in ("start", "suffix"):
            return opened(c), BEFORE
        if state == "letters":
            return ("letters", 0) if c in letters else (opened(c), BEFORE)
        if state == "digits":
            return ("digits", 0) if c == "digit" else (opened(c), BEFORE)
        if state == "punct":
            return ("punct", 0) if c in ("punct", "quote") else (opened(c), BEFORE)
        if state == "quote":
            if c in ("punct", "quote"):
                return "punct", 0
            follows = {"stmd": "suffix", "r": "quote_r", "v": "quote_v", "l": "quote_l"}
            return (follows[c], 0) if c in follows else (opened(c), BEFORE)
        # White space: a run's last blank joins what follows; any other last character stands alone.
        if c in ("space", "white"):
            return ("space2" if c == "space" else "other2"), 0
        cut = DELAYED if state in ("space2", "other2") else 0
        if state in ("space1", "space2"):
            return ("punct" if c == "quote" else opened(c)), cut
        return opened(c), cut | BEFORE

    nxt = np.zeros((len(STATES), len(CLASSES)), np.int64)
    out = np.zeros((len(STATES), len(CLASSES)), np.uint8)
    for a in STATES:
        for j, c in enumerate(CLASSES):
            b, out[s[a], j] = step(a, c)
            nxt[s[a], j] = s[b]
    return nxt, out


def character_classes() -> np.ndarray:
    """The class of every code point, as the library's own regular expressions see it."""
    from tokenizers import Regex, pre_tokenizers

    c = {n: i for i, n in enumerate(CLASSES)}
    points = np.concatenate([np.arange(0xD800), np.arange(0xE000, 0x110000)])
    every = points.astype("<u4").tobytes().decode("utf-32-le")
    found = np.full(0x110000, c["punct"], np.uint8)
    for pattern, name in ((r"\p{L}+", "letter"), (r"\p{N}+", "digit"), (r"\s+", "white")):
        kept = pre_tokenizers.Split(Regex(pattern), "removed", invert=True).pre_tokenize_str(every)
        for _, (a, b) in kept:
            found[points[a:b]] = c[name]
    for letter in "stmd":
        found[ord(letter)] = c["stmd"]
    for letter in "rvel":
        found[ord(letter)] = c[letter]
    found[ord(" ")], found[ord("'")] = c["space"], c["quote"]
    return found


def chunk_maps(classes: np.ndarray, nxt: np.ndarray) -> np.ndarray:
    """For each chunk (a row of ``classes``) the exit state of every entry state."""
    k, length = classes.shape
    n, m = nxt.shape
    flat = (nxt * m).ravel()
    now = np.tile(np.arange(n, dtype=np.int64) * m, (k, 1))
    by_step = np.ascontiguousarray(classes.T).astype(np.int64)
    for t in range(length):
        now = flat.take(now + by_step[t][:, None])
        if now.shape[1] > 1 and t % 8 == 7 and (now == now[:, :1]).all():
            now = now[:, :1]  # every entry state has met: one column stands for all
    return np.broadcast_to(now // m, (k, n))


def compose_prefixes(maps: np.ndarray) -> np.ndarray:
    """Inclusive parallel prefix scan: row k becomes the map of chunks 0..k in order."""
    acc = np.array(maps)
    d = 1
    while d < len(acc):
        acc[d:] = np.take_along_axis(acc[d:], acc[:-d], axis=1)
        d *= 2
    return acc


def pretoken_starts(classes: np.ndarray, nxt: np.ndarray, out: np.ndarray) -> np.ndarray:
    """Positions at which a pre-token (or an end mark) begins."""
    n = len(classes)
    end = CLASSES.index("end")
    k = -(-n // CHUNK)
    padded = np.full(k * CHUNK, end, np.uint8)
    padded[:n] = classes
    grid = padded.reshape(k, CHUNK)
    entry = np.zeros(k, np.int64)
    if k > 1:
        entry[1:] = compose_prefixes(chunk_maps(grid, nxt))[:-1, 0]
    m = nxt.shape[1]
    both = ((nxt * m) * 4 + out).ravel()
    now = entry * m
    by_step = np.ascontiguousarray(grid.T).astype(np.int64)
    emitted = np.empty((CHUNK, k), np.uint8)
    for t in range(CHUNK):
        got = both.take(now + by_step[t])
        emitted[t] = got & 3
        now = got >> 2
    emits = np.ascontiguousarray(emitted.T).ravel()[:n]
    begins = (emits & BEFORE) > 0
    begins[:-1] |= (emits[1:] & DELAYED) > 0
    return np.flatnonzero(begins)


class TokenCounter:
    """A worker's compiled transducer and lexicon."""

    def __init__(self, tokenizer_path: str, classes: np.ndarray):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        self.specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.classes = classes
        self.nxt, self.out = compile_transducer()
        self.lexicon: dict[str, int] = {}

    def segments(self, text: str) -> tuple[list[str], int]:
        """The parts between special strings, and the number of those strings."""
        parts, n = [text], 0
        for s in self.specials:
            if s in text:
                parts = [q for p in parts for q in p.split(s)]
        n = len(parts) - 1
        return parts, n

    def count(self, texts: list[str]) -> np.ndarray:
        """Tokens of each text."""
        counts = np.zeros(len(texts), np.int64)
        batch: list[tuple[int, str]] = []
        size = 0
        for i, text in enumerate(texts):
            if not text:
                continue
            parts, special = self.segments(text)
            counts[i] += special
            for p in parts:
                batch.append((i, p))
                size += len(p) + 1
            if size >= STREAM_CHARS:
                self._add(batch, counts)
                batch, size = [], 0
        if batch:
            self._add(batch, counts)
        return counts

    def _add(self, batch: list[tuple[int, str]], counts: np.ndarray) -> None:
        stream = "\0".join(p for _, p in batch) + "\0"
        ends = np.cumsum([len(p) + 1 for _, p in batch]) - 1
        points = np.frombuffer(stream.encode("utf-32-le"), "<u4")
        classes = self.classes[points]
        classes[ends] = CLASSES.index("end")
        starts = pretoken_starts(classes, self.nxt, self.out)
        cuts = starts.tolist()
        cuts.append(len(stream))
        words = [stream[a:b] for a, b in zip(cuts, cuts[1:])]
        is_end = classes[starts] == CLASSES.index("end")
        for i in np.flatnonzero(is_end).tolist():
            words[i] = ""
        if len(self.lexicon) > LEXICON_ENTRIES:
            self.lexicon.clear()
        self.lexicon[""] = 0
        missing = [w for w in set(words) if w not in self.lexicon]
        for at in range(0, len(missing), 20_000):
            block = missing[at : at + 20_000]
            for w, e in zip(block, self.tokenizer.encode_batch(block, add_special_tokens=False)):
                self.lexicon[w] = len(e)
        emitted = np.fromiter(map(self.lexicon.__getitem__, words), np.int64, len(words))
        run = np.concatenate([[0], np.cumsum(emitted)])
        upto = run[np.searchsorted(starts, ends)]
        np.add.at(counts, [i for i, _ in batch], np.diff(upto, prepend=0))


_counters: dict[str, TokenCounter] = {}


def count_tokens(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024) -> DataFrame:
    """Token count of every whole text.

    Returns id, ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit``
    (``n_tokens > limit``), a row for each input row.  A null text counts as
    empty (0 and 0), a null id stays null, repeated rows stay repeated, an empty
    table gives no rows.  Only the two named columns are read, so further
    columns of any name do not matter.  The special strings of the vocabulary
    count as one token each inside a text, as the library has it.  A narrow
    job: no shuffle, and memory bounded by ``STREAM_CHARS`` and the longest text.
    """
    shared = docs.sparkSession.sparkContext.broadcast(character_classes())

    @F.pandas_udf("long")
    def tokens(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counter = _counters.get(tokenizer_path)
        if counter is None:
            counter = _counters[tokenizer_path] = TokenCounter(tokenizer_path, shared.value)
        for texts in batches:
            yield pd.Series(counter.count(texts.tolist()))

    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(
        F.col(id_col), F.octet_length(text).cast("long").alias("n_bytes"), tokens(text).alias("n_tokens")
    ).withColumn("over_limit", F.col("n_tokens") > limit)
