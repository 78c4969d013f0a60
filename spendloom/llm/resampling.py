"""Importance resampling towards a target distribution by bit-sliced aggregation.

Words are hashed into buckets.  A bucket's gain says how much more often it
occurs in the target texts than in the corpus.  A document's weight is the mean
gain of its words: its bucket counts are written as bit planes (plane k holds
bit k of every bucket's count), the gains as planes of their two's complement,
and the sum of count times gain is the sum over pairs of planes of
2^(j+k) * popcount(count plane k AND gain plane j), where the highest gain plane
counts negative.  All sums are whole numbers, so weights are exact.  Gumbel noise
from a keyed digest of the id turns the ranking of weights into a draw without
replacement.

The words of a text are read once: its bucket counts are written as a sparse row
(at most one entry a bucket), from which both the totals and the weights come.
What leaves for the driver is one count per bucket.
"""

from __future__ import annotations

import hashlib
import itertools
import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendloom.llm.common import as_bytes, slices
from spendloom.session import write_shared

BUCKETS, SCALE, LEAST_WORDS, PERCENT, SEED = 10_000, 1000, 20, 10, "2024"

#: Digits, lower-cased letters and all bytes of letters beyond ASCII stay, the rest separates words.
_WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)
_COUNTED = "doc_id long, nth long, n_words long, n_features long, buckets binary, counts binary"


def resample(
    docs: DataFrame,
    target: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    target_col: str = "text",
    buckets: int = BUCKETS,
    ngrams: int = 1,
    least_words: int = LEAST_WORDS,
    percent: int = PERCENT,
    seed: str = SEED,
) -> DataFrame:
    """Weight and score of every document, and the rank of those that are drawn.

    A word is a run of digits, ASCII letters and characters beyond ASCII, with
    A-Z lower-cased; a feature is a run of 1 to ``ngrams`` words joined by a
    space.  Of the documents with ``least_words`` words, ``percent`` in a hundred
    are drawn (rounded down): those of the highest scores, ties by smaller id.

    Null and empty texts have no feature and the weight 0.  A null id is noted
    as an empty one and ranks after all others at a tie.  Repeated rows each
    give a row and are drawn each for itself, at equal ids in no set order.
    Without documents there are no rows; without target texts all of them weigh
    by their rareness in the corpus.

    Returns doc_id, n_features, weight, score, rank (null if not drawn).
    """
    if buckets > 1 << 16:
        raise ValueError("at most 65536 buckets")
    counted = write_shared(bucket_counts(docs, id_col, text_col, buckets, ngrams), "bucket-counts")
    wanted = bucket_counts(target.withColumn("_none", F.lit(None).cast("long")), "_none", target_col, buckets, ngrams)
    gains = bucket_gains(bucket_totals(counted, buckets), bucket_totals(wanted, buckets))
    scored = weigh(counted, gains, seed)
    return draw(scored, F.col("n_words") >= least_words, percent).drop("n_words", "nth")


def bucket_counts(docs: DataFrame, id_col: str, text_col: str, buckets: int = BUCKETS, ngrams: int = 1) -> DataFrame:
    """The words of each text as sparse bucket counts (16-bit buckets, 32-bit counts)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket_of = _Buckets(buckets)
        nth = itertools.count()
        for batch in batches:
            for part in slices(batch, "text"):
                out = ([], [], [], [], [])
                for text in as_bytes(part.column("text")):
                    words = text.translate(_WORD_BYTES).split()
                    seen = Counter(words)
                    for n in range(2, ngrams + 1):
                        seen.update(map(b" ".join, zip(*(words[i:] for i in range(n)))))
                    where = np.fromiter(map(bucket_of.__getitem__, seen), np.uint16, len(seen))
                    times = np.bincount(where, np.fromiter(seen.values(), np.int64, len(seen)))
                    where = np.flatnonzero(times)
                    times = times[where]
                    row = next(nth), len(words), int(times.sum()), where.astype("<u2").tobytes(), times.astype("<u4").tobytes()
                    for column, value in zip(out, row):
                        column.append(value)
                types = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), *[pa.array(c, t) for c, t in zip(out, types)]],
                    ["doc_id", "nth", "n_words", "n_features", "buckets", "counts"],
                )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, _COUNTED)


class _Buckets(dict):
    """Buckets of the features seen; forgotten when there are many."""

    def __init__(self, buckets: int, most: int = 500_000) -> None:
        self._buckets, self._most = buckets, most

    def __missing__(self, feature: bytes) -> int:
        if len(self) >= self._most:
            self.clear()
        found = zlib.crc32(feature) % self._buckets
        if len(feature) < 64:
            self[feature] = found
        return found


def bucket_totals(counted: DataFrame, buckets: int = BUCKETS) -> list[int]:
    """How often each bucket occurs in all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            where, times, _ = _entries(batch)
            total += np.bincount(where, times, buckets).astype(np.int64)  # below 2^53 in a batch
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], ["bucket", "n"])

    sums = counted.select("buckets", "counts").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    found = [0] * buckets
    for row in sums.collect():  # one row a bucket
        found[row["bucket"]] = row["n"]
    return found


def _entries(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets and counts of all rows one after another, and the number of entries of each row."""
    columns = [batch.column("buckets").to_pylist(), batch.column("counts").to_pylist()]
    where, times = (np.frombuffer(b"".join(c), t).astype(np.int64) for c, t in zip(columns, ("<u2", "<u4")))
    return where, times, np.array([len(b) // 2 for b in columns[0]], np.int64)


def bucket_gains(corpus: list[int], target: list[int]) -> list[int]:
    """Gain of each bucket: 1000 times the logarithm of its smoothed share in the target over that in the corpus."""
    n, s, t = float(len(corpus)), float(sum(corpus)), float(sum(target))
    return [math.floor(SCALE * math.log((b + 1.0) * (s + n) / ((a + 1.0) * (t + n)))) for a, b in zip(corpus, target)]


class GainPlanes:
    """The gains as bit planes of their two's complement."""

    def __init__(self, gains: list[int]) -> None:
        g = np.array(gains, np.int64)
        self.words = -(-len(g) // 64)
        width = int(max(g.max(initial=0), -1 - g.min(initial=0))).bit_length() + 1
        bits = np.zeros((width, 64 * self.words), bool)
        for j in range(width):
            bits[j, : len(g)] = g >> j & 1
        self.planes = _packed(bits)
        self.worth = [1 << j for j in range(width - 1)] + [-(1 << (width - 1))]

    def sums(self, where: np.ndarray, times: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Sum of count times gain for each of ``len(sizes)`` documents."""
        row = np.repeat(np.arange(len(sizes)), sizes)
        found = np.zeros(len(sizes), np.int64)
        for k in range(int(times.max(initial=0)).bit_length()):
            held = np.flatnonzero(times >> k & 1)
            rows, at = np.unique(row[held], return_inverse=True)
            bits = np.zeros((len(rows), 64 * self.words), bool)
            bits[at, where[held]] = True
            plane = _packed(bits)
            for worth, gain in zip(self.worth, self.planes):
                found[rows] += np.bitwise_count(plane & gain).sum(axis=1, dtype=np.int64) * (worth << k)
        return found


def _packed(bits: np.ndarray) -> np.ndarray:
    return np.packbits(bits, axis=1).view(np.uint64)


def weigh(counted: DataFrame, gains: list[int], seed: str = SEED, most: int = 256) -> DataFrame:
    """doc_id, n_words, n_features, weight and score of each row of bucket counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes = GainPlanes(gains)
        for batch in batches:
            for at in range(0, batch.num_rows, most):
                part = batch.slice(at, most)
                n = part.column("n_features").to_numpy()
                weights = planes.sums(*_entries(part)) // np.maximum(n, 1)
                noise = [_noise(seed, d) for d in part.column("doc_id").to_pylist()]
                columns = {c: part.column(c) for c in ("doc_id", "nth", "n_words", "n_features")}
                columns |= {"weight": pa.array(weights), "score": pa.array(weights + np.array(noise, np.int64))}
                yield pa.RecordBatch.from_pydict(columns)

    return counted.mapInArrow(run, "doc_id long, nth long, n_words long, n_features long, weight long, score long")


def _noise(seed: str, doc_id: int | None) -> int:
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return math.floor(-SCALE * math.log(-math.log((int(digest[:8], 16) + 0.5) / 2.0**32)))


def draw(scored: DataFrame, eligible: Column, percent: int = PERCENT) -> DataFrame:
    """Add ``rank`` from 1 to the best ``percent`` in a hundred of the eligible rows.

    The rows are sorted by ranges over all tasks and numbered inside their range;
    the ranges' sizes, one row a range, give the numbers before each.
    """
    order = [F.col("_out"), F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("nth")]
    # A null condition is not eligible.
    rows = scored.withColumn("_out", ~F.coalesce(eligible, F.lit(False)))
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    # The lower 33 bits of this id count the rows of a task.
    at = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    rows = write_shared(rows.withColumn("_range", F.spark_partition_id()).withColumn("_at", at), "ranges")
    # One row a task of the sort.
    sizes = rows.groupBy("_range").agg(F.count("*"), F.count_if(~F.col("_out"))).orderBy("_range").collect()
    drawn = sum(chosen for _, _, chosen in sizes) * percent // 100
    before = list(itertools.accumulate((n for _, n, _ in sizes), initial=0))
    before = rows.sparkSession.createDataFrame([(r, b) for (r, _, _), b in zip(sizes, before)], "_range int, _before long")
    rank = F.col("_before") + F.col("_at") + 1
    rows = rows.join(F.broadcast(before), "_range")
    rows = rows.withColumn("rank", F.when(~F.col("_out") & (rank <= drawn), rank))
    return rows.drop("_out", "_range", "_at", "_before")
