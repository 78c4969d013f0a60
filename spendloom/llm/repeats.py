"""Repeated windows of all documents, found by two exchanges of packed hashes.

1. Every document is cut into pieces (see ``grams``).  The pieces' hashes go to
   buckets by their anchor.  Equal pieces settle all their windows at once; a
   bucket's answer says which pieces are settled and which must be opened
   because another piece has the same anchor.  One piece of each kind is opened.
2. The windows of opened pieces meet by their own hash.

Texts are read for each exchange and once more to build the result; packed
texts are shuffled, by document, for the last two, where only documents that
have answers are cut into pieces again.  All exchanges carry numpy arrays in
binary columns.  Numbers of buckets and groups grow with the bytes of
the table, so a task's share stays the same.  A hash that very many documents
share is sent once per batch and document and answered in one bucket.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendloom.llm.common import as_bytes, shuffle_partitions, slices
from spendloom.llm.grams import mix, pieces
from spendloom.session import write_shared

#: Stands for a null id: larger than any other.
NO_ID = np.iinfo(np.int64).max
SETTLED, OPEN = 1, 2
_SLICE = 1 << 19  # bytes of text hashed at once
_TEXTS = 8 << 20  # bytes of text packed at once
_HELD = 1 << 19  # entries a map task holds before it sends them
_SHARE = 16 << 20  # bytes of text per bucket and per group


def parts_for(docs: DataFrame, text_col: str) -> int:
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    return max(shuffle_partitions(docs.sparkSession), -(-size // _SHARE))


def rows_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(int(NO_ID))).alias("id"), F.col(text_col).alias("text"))


def group_of(ids: np.ndarray, groups: int) -> np.ndarray:
    return (mix(ids.view(np.uint64)) >> np.uint64(33)).astype(np.int64) % groups


def tag(ids: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Ids and hashes in one number, by which a document finds its answers."""
    return mix(ids.view(np.uint64) + np.uint64(1)) ^ values


# --- packed rows -------------------------------------------------------------


def cut(part: np.ndarray, *arrays: np.ndarray) -> Iterator[tuple]:
    """For each part number in order: the number and its slices of the arrays."""
    short = len(part) and part.max() < 1 << 16  # sorted by counting
    order = np.argsort(part.astype(np.uint16) if short else part, kind="stable")
    part, arrays = part[order], [a[order] for a in arrays]
    edges = np.flatnonzero(np.diff(part, prepend=-1, append=-1)) if len(part) else []
    for start, end in zip(edges[:-1], edges[1:]):
        yield (int(part[start]), *[a[start:end] for a in arrays])


def packed(names: list[str], rows: list[tuple]) -> pa.RecordBatch:
    """Rows of a part number and arrays as a batch: an int and binary columns."""
    columns = list(zip(*rows)) or [[] for _ in names]
    arrays = [pa.array(columns[0], pa.int32())]
    arrays += [pa.array([a.tobytes() for a in c], pa.binary()) for c in columns[1:]]
    return pa.RecordBatch.from_arrays(arrays, names)


def unpacked(table: pa.Table, name: str, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(table.column(name).to_pylist()), kind)


def piece_rows(rows: DataFrame, units: Callable, k: int, q: int, buckets: int) -> DataFrame:
    """bucket and packed key, whole, id of all pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, many = [], 0
        for batch in batches:
            for part in slices(batch, "text", _SLICE):
                found = pieces(*units(as_bytes(part.column("text"))), k, q)
                ids = part.column("id").to_numpy()[found.text]
                bucket = (found.key >> np.uint64(32)).astype(np.int64) % buckets
                held.append((bucket, found.key.astype("<u4"), found.whole, ids))
                many += len(ids)
                if many >= _HELD:
                    yield packed(["bucket", "key", "whole", "id"], list(cut(*map(np.concatenate, zip(*held)))))
                    held, many = [], 0
        if many:
            yield packed(["bucket", "key", "whole", "id"], list(cut(*map(np.concatenate, zip(*held)))))

    return rows.mapInArrow(run, "bucket int, key binary, whole binary, id binary")


def answers(found: DataFrame, decide: Callable, groups: int) -> DataFrame:
    """The answers of all buckets by group of documents: packed tags, codes and the ids told.

    ``decide`` gets a bucket's table and returns ids, hashes and codes.
    """

    def run(table: pa.Table) -> pa.Table:
        ids, values, codes = decide(table)
        rows = cut(group_of(ids, groups), tag(ids, values), codes.astype(np.uint8), ids)
        rows = [(part, tags, codes, np.unique(own)) for part, tags, codes, own in rows]
        return pa.Table.from_batches([packed(["part", "tags", "codes", "ids"], rows)])

    return found.groupBy("bucket").applyInArrow(run, "part int, tags binary, codes binary, ids binary")


def decide_pieces(later: bool, most: int) -> Callable:
    """Which pieces are settled and which are opened.

    later: only windows that a smaller id has count; otherwise any second
    occurrence does.  Pieces of anchors with more than ``most`` kinds of pieces
    are opened with twice the code.
    """

    def decide(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        key, whole, ids = unpacked(table, "key", "<u4"), unpacked(table, "whole", "<u8"), unpacked(table, "id", "<i8")
        order = np.lexsort((ids, whole, key))
        key, whole, ids = key[order], whole[order], ids[order]
        new_key = np.diff(key, prepend=key[:1] + np.uint32(1)) != 0
        new = new_key | (np.diff(whole, prepend=whole[:1]) != 0)
        kind = np.cumsum(new) - 1  # of equal pieces
        anchor = np.cumsum(new_key) - 1
        first = np.flatnonzero(new)
        kinds = np.bincount(anchor[first], minlength=anchor[-1] + 1)[anchor]
        if later:
            settled = ids > ids[first][kind]
            starts = np.flatnonzero(new_key)
            differ = np.minimum.reduceat(ids, starts) != np.maximum.reduceat(ids, starts)
            opened = new & (kinds > 1) & differ[anchor]
        else:
            settled = np.bincount(kind)[kind] > 1
            opened = new & (kinds > 1)
        codes = settled * SETTLED + opened * np.where(kinds > most, 2 * OPEN, OPEN)
        told = codes > 0
        return ids[told], whole[told], codes[told]

    return decide


def decide_windows(later: bool) -> Callable:
    def decide(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        key, ids = unpacked(table, "key", "<u8"), unpacked(table, "id", "<i8")
        order = np.lexsort((ids, key))
        key, ids = key[order], ids[order]
        new = np.diff(key, prepend=key[:1] + np.uint64(1)) != 0
        kind = np.cumsum(new) - 1
        told = ids > ids[np.flatnonzero(new)][kind] if later else np.bincount(kind)[kind] > 1
        return ids[told], key[told], np.full(told.sum(), SETTLED)

    return decide


def text_rows(rows: DataFrame, groups: int) -> DataFrame:
    """part and packed id, size, data (compressed) of all texts, by group of documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            for part in slices(batch, "text", _TEXTS):
                texts, ids = as_bytes(part.column("text")), part.column("id").to_numpy()
                found = []
                for group, at in cut(group_of(ids, groups), np.arange(len(ids))):
                    own = [texts[i] for i in at]
                    data = np.frombuffer(pack(b"".join(own)), np.uint8)
                    found.append((group, ids[at], np.array([len(t) for t in own], "<i8"), data))
                yield packed(["part", "id", "size", "data"], found)

    return rows.mapInArrow(run, "part int, id binary, size binary, data binary")


def texts_of(table: pa.Table, wanted: Callable) -> Iterator[tuple[np.ndarray, list[bytes]]]:
    """Ids and texts of a group where ``wanted`` of the ids is true, about ``_SLICE`` bytes at a time."""
    ids, texts, many = [], [], 0
    unpack = zstandard.ZstdDecompressor()
    for row in table.to_pylist():
        sizes, own = np.frombuffer(row["size"], "<i8"), np.frombuffer(row["id"], "<i8")
        some = np.flatnonzero(wanted(own))
        if not len(some):
            continue
        total = int(sizes.sum())
        data = unpack.decompress(row["data"], max_output_size=total) if total else b""
        start = np.cumsum(sizes) - sizes
        for doc_id, at, size in zip(own[some].tolist(), start[some].tolist(), sizes[some].tolist()):
            ids.append(doc_id)
            texts.append(data[at : at + size])
            many += size
            if many >= _SLICE:
                yield np.array(ids, np.int64), texts
                ids, texts, many = [], [], 0
    if ids:
        yield np.array(ids, np.int64), texts


def together(rows: list[tuple]) -> Iterator[tuple]:
    """Rows of a part number and arrays, with those of one number joined."""
    by_part: dict[int, list[tuple]] = {}
    for part, *arrays in rows:
        by_part.setdefault(part, []).append(arrays)
    for part, found in sorted(by_part.items()):
        yield (part, *map(np.concatenate, zip(*found)))


class Answers:
    """The answers for a group of documents."""

    def __init__(self, table: pa.Table) -> None:
        tags, codes = unpacked(table, "tags", "<u8"), unpacked(table, "codes", "u1")
        order = np.argsort(tags, kind="stable")
        self._tags, starts = np.unique(tags[order], return_index=True)
        self._codes = np.bitwise_or.reduceat(codes[order], starts) if len(tags) else codes
        self._ids = np.unique(unpacked(table, "ids", "<i8"))

    def told(self, ids: np.ndarray) -> np.ndarray:
        """Which documents have any answer."""
        return np.isin(ids, self._ids)

    def untold(self, ids: np.ndarray) -> np.ndarray:
        return ~self.told(ids)

    def code(self, ids: np.ndarray, values: np.ndarray) -> np.ndarray:
        """The codes told for these documents and hashes; 0 for none."""
        if not len(self._tags):
            return np.zeros(len(ids), np.uint8)
        asked = tag(ids, values)
        at = np.minimum(np.searchsorted(self._tags, asked), len(self._tags) - 1)
        return np.where(self._tags[at] == asked, self._codes[at], 0)


def with_answers(texts: DataFrame, told: DataFrame, run: Callable, schema: str) -> DataFrame:
    """``run`` of each group's texts and answers."""
    return texts.groupBy("part").cogroup(told.groupBy("part")).applyInArrow(run, schema)


def keep_table(df: DataFrame, label: str) -> DataFrame:
    return write_shared(df, label)
