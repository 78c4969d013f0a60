"""Helpers shared by the operators: shared tables, Arrow columns, components."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spendloom.session import write_shared


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def as_bytes(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a text column; null gives the empty text."""
    return [b or b"" for b in column.cast(pa.binary()).to_pylist()]


def slices(batch: pa.RecordBatch, column: str, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that a piece has about ``most`` bytes of ``column``, or one row."""
    ends = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False).cumsum()
    start = before = 0
    while start < batch.num_rows:
        end = max(start + 1, int(ends.searchsorted(before + most, side="right")))
        yield batch.slice(start, end - start)
        start, before = end, ends[end - 1]


def components(links: DataFrame) -> DataFrame:
    """Connected components of ``links`` (long columns a, b) as rows (node, root).

    root is the smallest node of the component and gives no row itself.  Large-star and small-star
    rounds: each is two grouped minima and two plain joins, so a node with very
    many links is pre-aggregated and split like any skewed join key.  The rounds
    end when the table no longer changes; each is written to the shared folder.
    No links give no rows.
    """
    stars = write_shared(_ordered(links), "links")
    state = _state(stars)
    for _ in itertools.count():
        both = stars.union(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = _ordered(large)
        small = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = large.join(small, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        stars = write_shared(_ordered(moved.union(small.select("a", F.col("m").alias("b")))), "links")
        before, state = state, _state(stars)
        if state == before:
            return stars.select(F.col("a").alias("node"), F.col("b").alias("root"))


def _ordered(links: DataFrame) -> DataFrame:
    """Distinct links from the larger to the smaller node."""
    larger, smaller = F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    return links.filter("a <> b").select(larger, smaller).distinct()


def _state(links: DataFrame) -> tuple:
    """Row count and an order-free checksum."""
    mix = F.xxhash64("a", "b")
    return tuple(links.agg(F.count("*"), F.sum(F.shiftright(mix, 20)), F.bit_xor(mix)).first())
