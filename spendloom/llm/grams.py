"""Hashes of k-grams over numpy arrays of units (bytes or hashed words).

A window is k consecutive units of one document.  Its anchor is the leftmost
smallest of its q-grams, which depends on nothing but the window's own units, so
equal windows have their anchors at the same place.  Consecutive windows with
one anchor form a piece; all windows of a document fall into few pieces.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache
from typing import NamedTuple

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
#: Longer texts are hashed in parts of so many units.
PART = 1 << 19


def mix(x: np.ndarray) -> np.ndarray:
    """A permutation of 64-bit numbers that spreads their bits."""
    x = np.asarray(x).astype(np.uint64)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * _BASE)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


@cache
def _kept_powers(base: np.uint64) -> np.ndarray:
    return _all_powers(base, 2 * PART)


def _all_powers(base: np.uint64, n: int) -> np.ndarray:
    found = np.full(n, base, np.uint64)
    found[:1] = 1
    return np.cumprod(found, dtype=np.uint64)


def _powers(base: np.uint64, n: int) -> np.ndarray:
    kept = _kept_powers(base)
    return kept[:n] if n <= len(kept) else _all_powers(base, n)


class Prefix:
    """Polynomial prefix hashes; ``of`` gives the hashes of spans."""

    def __init__(self, units: np.ndarray) -> None:
        n = len(units)
        self._sums = np.zeros(n + 1, np.uint64)
        np.cumsum(units * _powers(_BASE, n), out=self._sums[1:])
        self._back = _powers(_INVERSE, n + 1)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self._sums[end] - self._sums[start]) * self._back[start]

    def starting(self, start: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
        """The hashes of spans from ``start`` by their lengths."""
        sums, back = self._sums[start], self._back[start]
        return lambda length: (self._sums[start + length] - sums) * back

    def all(self, length: int) -> np.ndarray:
        """The hashes of all spans of ``length`` units, in order."""
        found = self._sums[length:] - self._sums[: len(self._sums) - length]
        found *= self._back[: len(found)]
        return found


def byte_units(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Units of all texts and the number of units of each text."""
    return _BYTES[np.frombuffer(b"".join(texts), np.uint8)], np.array([len(t) for t in texts], np.int64)


def word_units(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The hashed words (runs without ASCII white space) of all texts, and how many each text has."""
    data = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
    edge = np.flatnonzero(np.diff(~_SPACE[data], prepend=False).astype(bool))
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    lengths = ends - starts
    inside = np.repeat(starts - np.cumsum(lengths) + lengths, lengths) + np.arange(lengths.sum())
    place = inside - np.repeat(starts, lengths)
    values = _BYTES[data[inside]] * _powers(_BASE, int(lengths.max()))[place]
    words = mix(np.add.reduceat(values, np.cumsum(lengths) - lengths) + lengths.astype(np.uint64))
    ends_of_texts = np.cumsum([len(t) + 1 for t in texts])
    return words, np.diff(np.searchsorted(starts, ends_of_texts), prepend=0)


class Pieces(NamedTuple):
    """Pieces of one batch of texts: text number, first window (place in the batch's units), number of
    windows, units of the first window before its anchor, hash of the anchor, and hash of all units."""

    text: np.ndarray
    first: np.ndarray
    windows: np.ndarray
    left: np.ndarray
    key: np.ndarray
    whole: np.ndarray


def _parts(counts: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of window places, cut only between texts or every ``PART`` units of a text's own.

    So the pieces of a text are the same whatever texts come with it.
    """
    at = end = 0
    for n in counts.tolist():
        if end > at and end - at + n > PART:
            yield at, end
            at = end
        end += n
        while end - at > PART:
            yield at, at + PART
            at += PART
    if end > at:
        yield at, end


def pieces(units: np.ndarray, counts: np.ndarray, k: int, q: int) -> Pieces:
    text_of = np.repeat(np.arange(len(counts), dtype=np.int32), counts)
    found = []
    for at, end in _parts(counts):
        part = units[at : end + k - 1]
        own = text_of[at : end + k - 1]
        if len(part) < k:
            continue
        prefix = Prefix(part)
        n = len(part)
        grams = mix(prefix.all(q))
        anchor = _leftmost_minimum(grams, k - q + 1)
        inside = own[: n - k + 1] == own[k - 1 :]
        new = np.ones(n - k + 2, bool)
        new[1:-1] = (anchor[1:] != anchor[:-1]) | (inside[1:] != inside[:-1])
        edges = np.flatnonzero(new)
        some = inside[edges[:-1]]
        first, windows = edges[:-1][some], np.diff(edges)[some]
        left = anchor[first] - first
        whole = mix(prefix.of(first, first + windows + k - 1) + mix(left * 65536 + windows))
        found.append((own[first], first + at, windows, left, grams[anchor[first]], whole))
    if not found:
        found = [(np.zeros(0, np.int64),) * 4 + (np.zeros(0, np.uint64),) * 2]
    return Pieces(*map(np.concatenate, zip(*found)))


def _leftmost_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """The place of the leftmost minimum of each window of ``width`` values.

    The minima of windows of 1, 2, 4, ... values are made of two windows of half
    the size, the last of two that overlap; of equal ones the left one counts.
    Places are kept as distances from the start of the window, in few bits.
    """
    kind = np.min_scalar_type(width)
    least, ahead, have = values, np.zeros(len(values), kind), 1
    while have < width:
        step = min(have, width - have)
        later = -(least[step:] < least[:-step]).astype(kind)  # all bits or none
        left, right = ahead[:-step], ahead[step:] + kind.type(step)
        ahead = left ^ ((left ^ right) & later)
        least = np.minimum(least[step:], least[:-step])
        have += step
    return np.arange(len(ahead)) + ahead


def spread(first: np.ndarray, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All windows of pieces, and the piece of each."""
    piece = np.repeat(np.arange(len(first)), windows)
    step = np.arange(len(piece)) - np.repeat(np.cumsum(windows) - windows, windows)
    return first[piece] + step, piece


def covered(spans: list[tuple[np.ndarray, np.ndarray]], n: int) -> np.ndarray:
    """Which of n units lie in a span [start, end)."""
    steps = np.zeros(n + 1, np.int64)
    for start, end in spans:
        if len(start):
            steps += np.bincount(start, minlength=n + 1) - np.bincount(end, minlength=n + 1)
    return np.cumsum(steps[:-1]) > 0
