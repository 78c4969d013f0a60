"""Byte-level BPE encoding and decoding with a rank queue of hierarchical bitmaps.

A text is cut into pre-tokens, and the bytes of each are merged on its own: of
all neighbouring parts whose joined bytes have a rank, the lowest rank merges
first, the leftmost of equal ones.  The parts are a doubly linked list.  Each
rank has a bucket of the list positions where it can merge; a bitmap of two
levels says which buckets hold any, and finding the first set bit of each level
gives the next rank.  A merge changes only the pairs beside it; the entries that
it makes untrue stay in their buckets and are skipped when they come up.  So a
pre-token of n bytes takes at most about 3 n entries, however long it is.

Distinct pre-tokens are remembered, up to a bound, as texts repeat them; a Python
worker keeps them from task to task.

Pre-tokens are cut by the regex library, whose Unicode version may be newer than
that of tiktoken.  Characters that only the newer one calls letters or numbers
are asked of tiktoken and taken out of these classes.
"""

from __future__ import annotations

import array
import base64
import functools
import heapq
import re
import unicodedata
from collections.abc import Callable, Iterator

import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendloom.llm.common import slices


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: a base64 token and its rank in each line."""
    with open(path, "rb") as lines:
        pairs = (line.split() for line in lines if line.strip())
        return {base64.b64decode(token): int(rank) for token, rank in pairs}


@functools.lru_cache(1)
def later_characters() -> str:
    """Letters and numbers of the regex library that tiktoken does not know as such.

    Only characters that Python's own tables do not know yet are in doubt.
    """
    every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    doubtful = [c for c in regex.findall(r"[\p{L}\p{N}]", every) if unicodedata.category(c) == "Cn"]
    ranks = {bytes([b]): b for b in range(256)}
    for c in doubtful:
        for first in "a1":
            ranks.setdefault((first + c).encode(), len(ranks))
    probe = tiktoken.Encoding("probe", pat_str=r"\p{L}+|\p{N}+|[^\p{L}\p{N}]+", mergeable_ranks=ranks, special_tokens={})
    return "".join(c for c in doubtful if all(len(probe.encode_ordinary(first + c)) > 1 for first in "a1"))


def _ranges(characters: str) -> str:
    """Sorted characters as ranges of a character class."""
    found: list[list[str]] = []
    for c in characters:
        if found and ord(found[-1][1]) + 1 == ord(c):
            found[-1][1] = c
        else:
            found.append([c, c])
    return "".join(f"{a}-{b}" for a, b in found)


class BytePairCoder:
    """Ids of texts and texts of ids by the ranks of a vocabulary file."""

    def __init__(self, path: str, pattern: str, most_words: int = 800_000) -> None:
        self.ranks = read_ranks(path)
        missing = [b for b in range(256) if bytes([b]) not in self.ranks]
        if missing:
            raise ValueError(f"bytes without a rank: {missing}")
        self._single = [self.ranks[bytes([b])] for b in range(256)]
        self.tokens = {rank: token for token, rank in self.ranks.items()}
        self._plain = regex.compile(pattern).findall
        later = later_characters()
        self._late = re.compile(f"[{later[0]}-\U0010ffff]").search, re.compile(f"[{_ranges(later)}]").search
        known = [(c, f"[{c}--[{_ranges(later)}]]") for c in (r"\p{L}", r"\p{N}")]
        self._careful = regex.compile(functools.reduce(lambda p, c: p.replace(*c), known, pattern), regex.V1).findall
        #: Two levels of bitmaps of this many bits cover all ranks.
        self._width = max(1, -(-max(self.tokens).bit_length() // 2))
        self._known = _Remembered(self._word, most_words)

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit numbers."""
        return b"".join(map(self._known.__getitem__, self._split(text)))

    def _split(self, text: str) -> list[str]:
        # The first search is the faster one, and few texts pass it.
        if not text.isascii() and all(late(text) for late in self._late):
            return self._careful(text)
        return self._plain(text)

    def decode(self, ids: bytes) -> bytes:
        numbers = array.array("I", ids)
        return b"".join(map(self.tokens.__getitem__, numbers))

    def _word(self, word: str) -> bytes:
        piece = word.encode()
        rank = self.ranks.get(piece)
        return array.array("I", self.merge(piece) if rank is None else [rank]).tobytes()

    def merge(self, piece: bytes) -> list[int]:
        """The ids of one pre-token by merging its bytes."""
        rank_of, n, width = self.ranks.get, len(piece), self._width
        low, push, pop = (1 << width) - 1, heapq.heappush, heapq.heappop
        # A part starts at its position and ends where the next one starts.
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        tokens = [self._single[b] for b in piece]
        # The rank at which a part merges with the next one; entries of any other rank are stale.
        ranks = [rank_of(piece[i : i + 2], -1) for i in range(n - 1)]
        ranks.append(-1)
        buckets: dict[int, list[int]] = {}
        for at, rank in enumerate(ranks):
            if rank >= 0:
                if rank in buckets:
                    buckets[rank].append(at)
                else:
                    buckets[rank] = [at]
        bits, top = [0] * (1 << width), 0
        for rank in buckets:
            bits[rank >> width] |= 1 << (rank & low)
            top |= 1 << (rank >> width)
        while top:
            high = (top & -top).bit_length() - 1
            held = bits[high]
            rank = high << width | (held & -held).bit_length() - 1
            bucket = buckets[rank]
            at = pop(bucket)
            if not bucket:
                del buckets[rank]
                bits[high] = held = held & (held - 1)
                if not held:
                    top &= top - 1
            if ranks[at] != rank:
                continue
            middle = after[at]
            end = after[at] = after[middle]
            tokens[at], ranks[middle] = rank, -1
            if end < n:
                before[end] = at
                ranks[at] = joined = rank_of(piece[at : after[end]], -1)
                if joined in buckets:
                    push(buckets[joined], at)
                elif joined >= 0:
                    buckets[joined] = [at]
                    bits[joined >> width] |= 1 << (joined & low)
                    top |= 1 << (joined >> width)
            else:
                ranks[at] = -1
            if at:
                first = before[at]
                ranks[first] = joined = rank_of(piece[first:end], -1)
                if joined in buckets:
                    push(buckets[joined], first)
                elif joined >= 0:
                    buckets[joined] = [first]
                    bits[joined >> width] |= 1 << (joined & low)
                    top |= 1 << (joined >> width)
        found, at = [], 0
        while at < n:
            found.append(tokens[at])
            at = after[at]
        return found


class _Remembered(dict):
    """Results of short keys; forgotten when there are many."""

    def __init__(self, work: Callable[[str], bytes], most: int) -> None:
        self._work, self._most = work, most

    def __missing__(self, key: str) -> bytes:
        found = self._work(key)
        if len(key) <= 64:
            if len(self) >= self._most:
                self.clear()
            self[key] = found
        return found


@functools.lru_cache(1)
def _coder(path: str, pattern: str) -> BytePairCoder:
    return BytePairCoder(path, pattern)


def encode(df: DataFrame, path: str, pattern: str, *, text_col: str = "text", to: str = "ids") -> DataFrame:
    """Add the ids of each text as a binary column of little-endian unsigned 32-bit numbers.

    ``path`` is a rank file that every executor can read, ``pattern`` the pattern
    of its pre-tokens.  No special tokens: their names in a text are plain text.
    A null or empty text has no ids.  Each row is encoded for itself, so repeated
    rows and ties need no rule; a column named ``to`` is replaced.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = _coder(path, pattern).encode
        for batch in batches:
            for part in slices(batch, text_col):
                found = [code(t or "") for t in part.column(text_col).to_pylist()]
                yield _with(part, to, pa.array(found, pa.binary()))

    return df.mapInArrow(run, df.withColumn(to, F.lit(b"")).schema)


def decode(df: DataFrame, path: str, pattern: str, *, ids_col: str = "ids", to: str = "decoded") -> DataFrame:
    """Add the bytes that the ids stand for; null ids give no bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        text_of = _coder(path, pattern).decode
        for batch in batches:
            for part in slices(batch, ids_col):
                found = [text_of(b or b"") for b in part.column(ids_col).to_pylist()]
                yield _with(part, to, pa.array(found, pa.binary()))

    return df.mapInArrow(run, df.withColumn(to, F.lit(b"")).schema)


def _with(batch: pa.RecordBatch, name: str, column: pa.Array) -> pa.RecordBatch:
    at = batch.schema.get_field_index(name)
    if at >= 0:
        return batch.set_column(at, name, column)
    return batch.append_column(name, column)
