"""SimHash near-duplicates by tiled exact comparison.

A document's fingerprint has a bit for each bit of the shingle hashes that is
set in over half of them.  Distinct fingerprints are sorted into cells by the
population counts of their four 16-bit quarters.  Two fingerprints whose counts
differ by more than the radius in sum differ in more bits than the radius, so a
cell meets only the cells around it (65 of them for a radius of 3, counting
each pair once), and all other tile pairs are skipped.  Cells are cut into
tiles of at most about ``TILE`` fingerprints; a pair of tiles is compared
completely with exclusive-or and bit counts.

There are at most 17^4 cells, so their sizes may be broadcast.  A tile pair
gives no list of close pairs but the links of a spanning forest, at most one
for each of its fingerprints: a group of near copies costs one link per member
and tile, and components lose nothing.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendloom.llm.common import as_bytes, components, slices
from spendloom.session import write_shared

RADIUS, WORDS, SEED, TILE = 3, 3, 42, 1024


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, words: int = WORDS) -> DataFrame:
    """One row per document: its fingerprint and its component.

    Fingerprints link at ``radius`` or fewer differing bits; component_id is
    the smallest doc_id reachable.  Null, empty and blank texts have the
    fingerprint zero and link like any other.  A null id never names a
    component that has another id.  Repeated rows each give a row; an empty
    table gives an empty result.

    Returns doc_id, fingerprint (long), component_id.
    """
    prints = write_shared(fingerprints(docs, id_col, text_col, words), "fingerprints")
    distinct = write_shared(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("least_id")), "distinct")
    roots = components(close_links(distinct.select("fingerprint"), radius))
    linked = distinct.join(roots.withColumnRenamed("node", "fingerprint"), "fingerprint", "left")
    linked = linked.withColumn("root", F.coalesce("root", "fingerprint"))
    named = linked.groupBy("root").agg(F.min("least_id").alias("component_id"))
    named = linked.join(named, "root").select("fingerprint", "component_id")
    return prints.join(named, "fingerprint").select("doc_id", "fingerprint", "component_id")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, one of each component: its smallest id.

    A null id is larger than any other.  Rows with equal or null ids are told
    apart by their texts, so each component keeps exactly one row.
    """
    prints = write_shared(fingerprints(docs, id_col, text_col, who=who(id_col, text_col)), "fingerprints")
    distinct = prints.groupBy("fingerprint").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "who")).alias("first"))
    distinct = write_shared(distinct, "distinct")
    roots = components(close_links(distinct.select("fingerprint"))).withColumnRenamed("node", "fingerprint")
    linked = distinct.join(roots, "fingerprint", "left").withColumn("root", F.coalesce("root", "fingerprint"))
    stay = linked.groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.who").alias("_stay"))
    return keep_rows(docs, stay, id_col, text_col)


def who(id_col: str, text_col: str) -> Column:
    """The identity of a row: a digest of its id and its text; a null text is empty."""
    known = F.coalesce(F.col(id_col).cast("long").cast("string"), F.lit("none"))
    return F.sha2(F.concat(known, F.lit(" "), F.coalesce(F.col(text_col), F.lit(""))), 256)


def keep_rows(docs: DataFrame, stay: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row of ``docs`` for each identity in ``stay`` (column _stay)."""
    rows = docs.withColumn("_who", who(id_col, text_col))
    return rows.join(stay, F.col("_who") == F.col("_stay"), "left_semi").dropDuplicates(["_who"]).drop("_who")


def fingerprints(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, who: Column | None = None
) -> DataFrame:
    """doc_id and fingerprint (long) of each row, over the whole text, and the text ``who`` if given.

    Words are runs without ASCII white space, A-Z lower-cased.  A shingle is
    ``words`` of them joined by a space, repeats included; a shorter text is
    one shingle, a text without words has the fingerprint zero.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                prints = [fingerprint(b, words) for b in as_bytes(part.column("text"))]
                prints = np.array(prints, np.uint64).view(np.int64)
                columns = {c: part.column(c) for c in kept} | {"fingerprint": pa.array(prints)}
                yield pa.RecordBatch.from_pydict(columns)

    extra = [] if who is None else [who.alias("who")]
    kept = ["doc_id", "who"][: 1 + len(extra)]
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *extra)
    return rows.mapInArrow(run, rows.select(*kept, F.lit(0).cast("long").alias("fingerprint")).schema)


def fingerprint(text: bytes, words: int = WORDS) -> int:
    parts = text.lower().split()
    if not parts:
        return 0
    joined = b" ".join(parts)
    if len(parts) <= words:
        return xxhash.xxh64_intdigest(joined, SEED)
    lengths = np.fromiter(map(len, parts), np.int64, len(parts))
    starts = np.cumsum(lengths + 1) - lengths - 1
    ends = (starts + lengths)[words - 1 :].tolist()
    digest = xxhash.xxh64_digest
    hashes = b"".join([digest(joined[s:e], SEED) for s, e in zip(starts.tolist(), ends)])
    hashes = np.frombuffer(hashes, np.uint8).reshape(-1, 8)
    bits = np.unpackbits(hashes, axis=1)
    whole = len(bits) // 255 * 255  # counts of up to 255 fit a byte
    ones = bits[:whole].reshape(-1, 255, 64).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
    ones += bits[whole:].sum(axis=0, dtype=np.uint8)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def _quarters(fingerprint: str) -> list[Column]:
    return [F.bit_count(F.shiftright(fingerprint, 16 * i).bitwiseAND(F.lit(0xFFFF))) for i in range(4)]


def _neighbours(radius: int) -> list[tuple[int, ...]]:
    """Steps to the cells within the radius, one of each pair of opposite steps."""
    steps = itertools.product(range(-radius, radius + 1), repeat=4)
    return [s for s in steps if sum(map(abs, s)) <= radius and s >= (0, 0, 0, 0)]


def close_links(prints: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """Links (a, b) that connect every two of the distinct ``prints`` within the radius."""
    quarters = _quarters("fingerprint")
    cells = prints.select("fingerprint", F.array(*quarters).alias("cell"))
    sizes = write_shared(cells.groupBy("cell").agg(F.count("*").alias("size")), "cells")  # at most 17^4 rows
    cut = F.pmod(F.xxhash64("fingerprint"), F.ceil(F.col("size") / tile)).cast("int")
    tiles = (
        cells.join(F.broadcast(sizes), "cell")
        .groupBy("cell", cut.alias("cut"))
        .agg(F.collect_list("fingerprint").alias("prints"))
    )
    tiles = write_shared(tiles, "tiles")
    steps = F.array(*[F.array(*map(F.lit, s)) for s in _neighbours(radius)])
    step = F.explode(F.transform(steps, lambda s: F.zip_with("cell", s, lambda x, y: x + y)))
    left = tiles.select(F.col("cell").alias("own"), F.col("cut").alias("left_cut"), F.col("prints").alias("left"), step.alias("cell"))
    left = left.join(F.broadcast(sizes.select("cell")), "cell", "left_semi")
    pairs = left.join(tiles, "cell").filter((F.col("own") != F.col("cell")) | (F.col("left_cut") <= F.col("cut")))
    return pairs.select("left", "prints").mapInArrow(_compare(radius), "a long, b long").distinct()


def _compare(radius: int):
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            left, right = batch.column("left"), batch.column("prints")
            # Unsigned, as bits of negative numbers are not counted as they are stored.
            lv, lo = left.values.to_numpy().view(np.uint64), left.offsets.to_numpy()
            rv, ro = right.values.to_numpy().view(np.uint64), right.offsets.to_numpy()
            for i in range(batch.num_rows):
                found.append(_tile_links(lv[lo[i] : lo[i + 1]], rv[ro[i] : ro[i + 1]], radius))
            a, b = (np.concatenate(found, axis=1) if found else np.zeros((2, 0), np.uint64)).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return compare


def _tile_links(left: np.ndarray, right: np.ndarray, radius: int) -> np.ndarray:
    """Links of a spanning forest of the close pairs of two tiles."""
    a, b, strip = [], [], max(1, (1 << 20) // len(right))
    for at in range(0, len(left), strip):
        i, j = np.nonzero(np.bitwise_count(left[at : at + strip, None] ^ right[None, :]) <= radius)
        a.append(left[at : at + strip][i])
        b.append(right[j])
    a, b = np.concatenate(a), np.concatenate(b)
    other = a != b
    if not other.any():
        return np.zeros((2, 0), np.uint64)
    nodes, at = np.unique(np.concatenate([a[other], b[other]]), return_inverse=True)
    a, b = at.reshape(2, -1)
    label = np.arange(len(nodes))
    while True:
        least, before = np.minimum(label[a], label[b]), label
        label = label.copy()
        np.minimum.at(label, a, least)
        np.minimum.at(label, b, least)
        label = label[label]
        if np.array_equal(label, before):
            break
    moved = label != np.arange(len(nodes))
    return np.stack([nodes[moved], nodes[label[moved]]])
