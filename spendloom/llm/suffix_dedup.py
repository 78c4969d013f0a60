"""Repeated byte strings by hash-compared suffix sorting.

Which strings can be repeated is found from the pieces of all documents (see
``grams`` and ``repeats``).  Pieces repeated as a whole are settled.  Around the
ends of a repeat, pieces with one anchor differ; one of each kind is sent, as
bytes, to the bucket of its anchor.  There the suffixes from each anchor on are
sorted by a mergesort, and the reversed texts before it by another; only pieces
of one anchor are compared, as equal windows have equal anchors.  Two suffixes
are compared by the longest extension they have in common, which a binary search
over prefix polynomial hashes finds in a logarithmic number of steps, and by the
byte after it.  The extensions of neighbours in the sorted orders are verified
byte by byte.  A window that starts l bytes before an anchor is repeated if
another one has the same l bytes before and the same bytes after its anchor,
which is read off the two orders.

An anchor with more than ``MOST_KINDS`` kinds of pieces (a passage in very many
documents, each time with another text around it) is not gathered: the windows
of its pieces meet by their own hash, spread over all buckets.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from spendloom.llm import repeats
from spendloom.llm.debruijn_dedup import result_table
from spendloom.llm.grams import Prefix, byte_units, covered, mix, pieces, spread
from spendloom.llm.repeats import NO_ID, OPEN, SETTLED, Answers

LENGTH, STEP, MOST_KINDS = 400, 80, 1000
#: Suffix sorts per bucket of hashes, as their pieces come with their bytes.
SORTS = 4
_STEP_MIX = np.uint64(0xD6E8FEB86659FD93)
_PIECE = "bucket int, id binary, whole binary, key binary, shape binary, data binary"
_RESULT = (
    "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start long, length long>>"
)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, most_kinds: int = MOST_KINDS) -> DataFrame:
    """Bytes of each document covered by ``length``-byte strings that also start elsewhere.

    Texts are UTF-8 bytes, null ones empty; strings lie in one document; the
    other place may be in the same document and overlap.  All strings are judged
    on the input.  Repeated rows are places of their own, so they remove each
    other; a null id stays null in the result.

    Returns doc_id, n_bytes, n_removed, n_spans, kept_sha256 (of the remaining
    bytes) and spans: the maximal removed runs as byte places.
    """
    q = max(1, length - STEP)
    parts = repeats.parts_for(docs, text_col)
    rows = repeats.rows_of(docs, id_col, text_col)
    found = repeats.piece_rows(rows, byte_units, length, q, parts)
    told = repeats.keep_table(repeats.answers(found, repeats.decide_pieces(False, most_kinds), parts), "pieces")
    texts = repeats.text_rows(rows, parts)

    def open_pieces(texts: pa.Table, told: pa.Table) -> pa.Table:
        """Rows for the suffix sort (with data) and rows of single windows (with shape empty)."""
        answers, out, windows = Answers(told), [], []
        for ids, own in repeats.texts_of(texts, answers.told):
            data = np.frombuffer(b"".join(own), np.uint8)
            units, counts = byte_units(own)
            found = pieces(units, counts, length, q)
            owner = ids[found.text]
            code = answers.code(owner, found.whole)
            sort = np.flatnonzero(code & OPEN)
            bucket = (found.key[sort] >> np.uint64(32)).astype(np.int64) % (SORTS * parts)
            for to, at in repeats.cut(bucket, sort):
                place, _ = spread(found.first[at], found.windows[at] + length - 1)
                shape = np.stack([found.windows[at], found.left[at]], axis=1).astype("<i4")
                out.append((to, owner[at], found.whole[at], found.key[at], shape, data[place]))
            single = np.flatnonzero(code & (2 * OPEN))
            if len(single):
                first, piece = spread(found.first[single], found.windows[single])
                key = mix(Prefix(units).of(first, first + length))
                bucket = (key >> np.uint64(40)).astype(np.int64) % parts
                windows += repeats.cut(bucket, owner[single][piece], key)
        nothing = np.zeros(0, np.uint8)
        rows = [*repeats.together(out), *((*row, nothing, nothing, nothing) for row in repeats.together(windows))]
        return pa.Table.from_batches([repeats.packed(["bucket", "id", "whole", "key", "shape", "data"], rows)])

    opened = repeats.keep_table(repeats.with_answers(texts, told, open_pieces, _PIECE), "opened")
    sorted_ = repeats.answers(opened.filter("octet_length(shape) > 0"), lambda table: decide_suffixes(table, length), parts)
    single = opened.filter("octet_length(shape) = 0").selectExpr("bucket", "whole AS key", "id")
    single = repeats.answers(single, repeats.decide_windows(False), parts)
    windows = repeats.keep_table(sorted_.union(single), "windows")

    def finish(texts: pa.Table, told: pa.Table) -> pa.Table:
        answers, out = Answers(told), []
        for ids, own in repeats.texts_of(texts, answers.untold):
            for doc_id, text in zip(ids.tolist(), own):
                out.append((None if doc_id == NO_ID else doc_id, len(text), 0, 0, hashlib.sha256(text).hexdigest(), []))
        for ids, own in repeats.texts_of(texts, answers.told):
            units, counts = byte_units(own)
            found = pieces(units, counts, length, q)
            code = answers.code(ids[found.text], found.whole)
            whole = np.flatnonzero(code & SETTLED)
            sort = np.flatnonzero(code & OPEN)
            named, piece = spread(found.first[sort], found.windows[sort])
            before = found.left[sort][piece] - (named - found.first[sort][piece])
            named = named[answers.code(ids[found.text[sort]][piece], window_name(found.whole[sort][piece], before)) > 0]
            single = np.flatnonzero(code & (2 * OPEN))
            met, piece = spread(found.first[single], found.windows[single])
            if len(met):
                met = met[answers.code(ids[found.text[single]][piece], mix(Prefix(units).of(met, met + length))) > 0]
            gone = covered(
                [
                    (found.first[whole], found.first[whole] + found.windows[whole] + length - 1),
                    (named, named + length),
                    (met, met + length),
                ],
                len(units),
            )
            at = 0
            for doc_id, text, n in zip(ids.tolist(), own, counts.tolist()):
                mask = gone[at : at + n]
                at += n
                kept = np.frombuffer(text, np.uint8)[~mask].tobytes()
                edges = np.flatnonzero(np.diff(mask.astype(np.int8), prepend=0, append=0)).tolist()
                spans = [{"start": a, "length": b - a} for a, b in zip(edges[::2], edges[1::2])]
                sha = hashlib.sha256(kept).hexdigest()
                out.append((None if doc_id == NO_ID else doc_id, n, int(mask.sum()), len(spans), sha, spans))
        return result_table(out, _ARROW)

    return repeats.with_answers(texts, told.union(windows), finish, _RESULT)


_ARROW = pa.schema(
    [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())]
    + [("spans", pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())])))]
)


def window_name(whole: np.ndarray, before: np.ndarray) -> np.ndarray:
    """A window named by its piece and the number of bytes before the anchor."""
    return mix(whole + before.astype(np.uint64) * _STEP_MIX)


def decide_suffixes(table: pa.Table, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The repeated windows of the pieces of a bucket, by the two suffix orders."""
    ids, whole = repeats.unpacked(table, "id", "<i8"), repeats.unpacked(table, "whole", "<u8")
    key = repeats.unpacked(table, "key", "<u8")
    shape = repeats.unpacked(table, "shape", "<i4").reshape(-1, 2).astype(np.int64)
    data = repeats.unpacked(table, "data", np.uint8)
    windows, left = shape[:, 0], shape[:, 1]
    size = windows + length - 1
    anchor = np.cumsum(size) - size + left
    right_order, right_common = suffix_order(data, anchor, size - left, key)
    left_order, left_common = suffix_order(data[::-1], len(data) - anchor, left, key)
    found = []
    for before in range(int(left.max(initial=-1)) + 1):
        inside = (before <= left) & (before > left - windows)
        if inside.sum() < 2:
            continue
        right = _classes(right_order, right_common, length - before)
        kind = right * (len(size) + 1) + _classes(left_order, left_common, before)
        _, at, times = np.unique(kind[inside], return_inverse=True, return_counts=True)
        hit = np.flatnonzero(inside)[times[at] > 1]
        found.append((ids[hit], window_name(whole[hit], np.full(len(hit), before))))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    ids, values = map(np.concatenate, zip(*found))
    return ids, values, np.full(len(ids), SETTLED)


def _classes(order: np.ndarray, common: np.ndarray, depth: int) -> np.ndarray:
    """Numbers that are equal for suffixes with equal first ``depth`` bytes."""
    found = np.empty(len(order), np.int64)
    found[order] = np.cumsum(np.append(True, common < depth)[: len(order)])
    return found


def suffix_order(data: np.ndarray, start: np.ndarray, size: np.ndarray, group: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The sorted order of the suffixes data[start:start + size], and the lengths that neighbours in it share.

    With ``group``, the suffixes of a group stand together, each group sorted by
    itself; neighbours of two groups share -1.

    Bottom-up mergesort of all groups at once; in a round, each suffix of a group
    that is longer than a run finds its place in the run beside its own by binary
    search.  Equal suffixes keep their order.
    """
    prefix = Prefix(mix(np.arange(1, 257))[data])

    def common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        low, high = np.zeros(len(a), np.int64), np.minimum(size[a], size[b])
        of_a, of_b = prefix.starting(start[a]), prefix.starting(start[b])
        while (low < high).any():
            middle = (low + high + 1) // 2
            same = of_a(middle) == of_b(middle)
            low, high = np.where(same, middle, low), np.where(same, high, middle - 1)
        return low

    def below(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether a comes before b; of equal ones, the one with the smaller number."""
        same = common(a, b)
        a_ends, b_ends = same == size[a], same == size[b]
        last = len(data) - 1
        differ = data[np.minimum(start[a] + same, last)] < data[np.minimum(start[b] + same, last)]
        return np.where(a_ends & b_ends, a < b, np.where(a_ends, True, np.where(b_ends, False, differ)))

    n = len(start)
    group = np.zeros(n, np.uint64) if group is None else group
    order = np.argsort(group, kind="stable")
    edges = np.flatnonzero(np.append(np.append(n > 0, group[order[1:]] != group[order[:-1]]), n > 0))
    lengths = np.diff(edges)
    base, stop = np.repeat(edges[:-1], lengths), np.repeat(edges[1:], lengths)
    width = 1
    while True:
        place = np.flatnonzero(stop - base > width)
        if not len(place):
            break
        own = place - (place - base[place]) % (2 * width)
        in_left = place - own < width
        begin = np.where(in_left, np.minimum(own + width, stop[place]), own)
        low, high = begin.copy(), np.where(in_left, np.minimum(own + 2 * width, stop[place]), own + width)
        while True:
            open_ = np.flatnonzero(low < high)
            if not len(open_):
                break
            middle = (low[open_] + high[open_]) // 2
            lower = below(order[middle], order[place[open_]])
            low[open_] = np.where(lower, middle + 1, low[open_])
            high[open_] = np.where(lower, high[open_], middle)
        rank = place - np.where(in_left, own, own + width) + low - begin
        merged = order.copy()
        merged[own + rank] = order[place]
        order, width = merged, 2 * width
    if n < 2:
        return order, np.zeros(0, np.int64)
    found = np.full(n - 1, -1)
    one = np.flatnonzero(base[1:] == base[:-1])
    a, b = order[one], order[one + 1]
    found[one] = _verified(data, start[a], start[b], common(a, b))
    return order, found


def _verified(data: np.ndarray, a: np.ndarray, b: np.ndarray, common: np.ndarray) -> np.ndarray:
    """``common``, cut to the first byte that really differs."""
    found = common.copy()
    for at in range(0, len(a), 4096):
        some = slice(at, at + 4096)
        x, pair = spread(a[some], common[some])
        y, _ = spread(b[some], common[some])
        wrong = np.flatnonzero(data[x] != data[y])
        if len(wrong):
            np.minimum.at(found, at + pair[wrong], x[wrong] - a[some][pair[wrong]])
    return found
