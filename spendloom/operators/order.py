"""Row order: ids for rows that have none, and slices of consecutive rows."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import accumulate

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spendloom.session import write_shared


def add_txn_id(df: DataFrame, *, column: str = "txn_id", order_by: Sequence[str] = ()) -> DataFrame:
    """Number the rows in reading order, or in the order of the given columns.

    Rows read from files are ordered by file, block and place in the file, which
    do not depend on how the input is split into tasks.  Other tables are
    numbered as they come; the numbers are written once, so every later step
    reads the same ids.
    """
    keys = [F.col(c) for c in order_by]
    if not keys:
        try:
            place = [F.col(f"_metadata.{c}") for c in ("file_path", "file_block_start", "row_index")]
            df.select(*place).schema
            keys = place
        except AnalysisException:
            pass
    if keys:
        parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        columns = df.columns
        df = df.select("*", *[k.alias(f"_at{i}") for i, k in enumerate(keys)])
        at = [f"_at{i}" for i in range(len(keys))]
        df = df.repartitionByRange(parts, *at).sortWithinPartitions(*at).select(*columns)
    return write_shared(df.withColumn(column, F.monotonically_increasing_id()), "numbered")


def add_chunk(
    df: DataFrame,
    *,
    chunk_size: int | Column,
    order_by: str = "txn_id",
    scope: Sequence[str] = (),
    column: str = "chunk_id",
    parts: int | None = None,
    numbered: bool = False,
) -> DataFrame:
    """Number slices of ``chunk_size`` consecutive rows in ``order_by`` order, in each scope.

    A prefix sum over ranges: rows are dealt by range of scope and order,
    sorted and numbered inside their range, and written.  A row's position in
    its scope is its place in the range plus the scope's rows of earlier ranges.
    Only the counts of the ranges are summed up, so no task sorts a whole table
    or a whole scope, and any cut points give the same numbers.  ``parts`` is
    the number of ranges (default: the session's shuffle partitions).

    ``numbered``: ``order_by`` already counts the rows of each scope from 0
    without a gap, as the positions in a payload do, so it is the position.
    """
    if numbered:
        return df.withColumn(column, F.floor(F.col(order_by) / chunk_size).cast("long"))
    spark = df.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(parts, *scope, order_by).sortWithinPartitions(*scope, order_by)
    # The upper bits of these ids are the range, the lower 33 count its rows.
    placed = write_shared(ranged.withColumn("_at", F.monotonically_increasing_id()), "ranges")
    placed = placed.withColumn("_part", F.shiftright("_at", 33))
    counts = placed.groupBy(*scope, "_part").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    if scope:
        earlier = Window.partitionBy(*scope).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
        shift = F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first")
        shifts = counts.select(*scope, "_part", shift.alias("_shift"))
    else:
        # One row per range, whatever the size of the table.
        rows = sorted(counts.select("_part", "_n", "_first").collect())
        before = accumulate((r._n for r in rows), initial=0)
        pairs = [(r._part, n - r._first) for r, n in zip(rows, before)]
        shifts = F.broadcast(spark.createDataFrame(pairs, "_part long, _shift long"))
    chunk = F.floor((F.col("_at") + F.col("_shift")) / chunk_size).cast("long")
    return placed.join(shifts, [*scope, "_part"]).select(*df.columns, chunk.alias(column))
