"""Exact top-k inner products, block at a time.

Vectors are term weights of a document: a block holds the documents of one
range of ids as a forward index (a matrix) with the largest and smallest weight
of each term.  For a query, the sum over its terms of the best product with
these extremes bounds every score in the block.  Each query takes its blocks
from the highest bound down, in rounds; it ends when the bounds of the blocks
that are left are below its k-th best score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spendloom.llm.common import shuffle_partitions
from spendloom.session import write_shared

BLOCK, TILE = 1024, 256


def weights(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 1024) -> DataFrame:
    """vec_id and the integer weights floor(scale * x) of each usable vector.

    Null vectors and vectors with null or non-finite components are left out, as
    are rows without an id.
    """
    vector = F.col(vector_col)
    infinite = F.lit(float("inf"))
    usable = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < infinite))
    kept = rows.filter(F.col(id_col).isNotNull() & vector.isNotNull() & usable)
    whole = F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long"))
    return kept.select(F.col(id_col).cast("long").alias("vec_id"), whole.alias("weights"))


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, block: int = BLOCK) -> DataFrame:
    """The k best rows of ``vectors`` for each of ``queries`` (both: vec_id, weights).

    Scores are inner products of integers; a missing term counts as 0.  Ties go
    to the smaller vec_id; rows with the query's own id are no candidates, and
    of repeated query ids one counts.  Fewer than k candidates give all of them;
    an empty table gives an empty result.

    Returns query_id, rank (from 1), vec_id, score.
    """
    blocks = write_shared(_blocks(vectors, block), "blocks")
    queries = queries.groupBy(F.col("vec_id").alias("query_id")).agg(F.min("weights").alias("query"))
    queries = write_shared(queries, "queries")
    bounds = write_shared(_bounds(queries, blocks), "bounds")
    last = bounds.agg(F.max("turn")).first()[0] or 0
    best, done, step = None, 0, 1
    while done < last:
        pairs = bounds.filter((F.col("turn") > done) & (F.col("turn") <= done + step))
        if best is not None:
            # Ties may still win by their id, so only bounds below the k-th score end a query.
            kth = best.filter(F.col("rank") == k).select("query_id", F.col("score").alias("kth"))
            pairs = pairs.join(kth, "query_id", "left").filter("kth IS NULL OR bound >= kth").drop("kth")
        found = _scores(pairs, queries, blocks, k)
        found = found if best is None else found.union(best.select("query_id", "vec_id", "score"))
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        best = write_shared(found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k), "best")
        done, step = done + step, step * 4
    if best is None:
        best = queries.select("query_id", F.col("query_id").alias("vec_id"), F.lit(0).alias("score"), F.lit(1).alias("rank")).limit(0)
    return best.select("query_id", "rank", "vec_id", F.col("score").cast("long").alias("score"))


def _matrix(lists: pa.ListArray, width: int = 0) -> np.ndarray:
    """The lists as rows of a matrix, filled up with zeros."""
    lengths = lists.value_lengths().to_numpy(zero_copy_only=False)
    width = max(width, int(lengths.max(initial=0)))
    values = lists.flatten().to_numpy()
    found = np.zeros((len(lists), width), np.int64)
    found[np.arange(width)[None, :] < lengths[:, None]] = values
    return found


def _blocks(vectors: DataFrame, block: int) -> DataFrame:
    """Ranges of ids as blocks: ids, width, the flat matrix, and the extremes of each term."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for batch in batches:
            held.append(pa.RecordBatch.from_arrays(batch.columns, ["vec_id", "weights"]))
            while sum(b.num_rows for b in held) >= block:
                rows = pa.concat_batches(held)
                yield one(rows.slice(0, block))
                held = [rows.slice(block)]
        rows = pa.concat_batches(held) if held else None
        if rows is not None and rows.num_rows:
            yield one(rows)

    def one(rows: pa.RecordBatch) -> pa.RecordBatch:
        matrix = _matrix(rows.column("weights"))
        columns = [rows.column("vec_id").to_pylist(), matrix.ravel(), matrix.max(axis=0), matrix.min(axis=0)]
        kind = pa.list_(pa.int64())
        arrays = [pa.array([c], kind) for c in columns]
        return pa.RecordBatch.from_arrays(arrays, ["ids", "matrix", "high", "low"])

    parts = shuffle_partitions(vectors.sparkSession)
    ordered = vectors.repartitionByRange(parts, "vec_id").sortWithinPartitions("vec_id")
    found = ordered.mapInArrow(cut, "ids array<long>, matrix array<long>, high array<long>, low array<long>")
    return found.withColumn("block", F.monotonically_increasing_id())


def _bounds(queries: DataFrame, blocks: DataFrame) -> DataFrame:
    """query_id, block, bound and turn: the blocks of each query by falling bound.

    The query set meets the block summaries in tiles: ``TILE`` queries with
    ``TILE`` summaries of two rows of weights each.
    """
    many = max(1, -(-blocks.count() // TILE))
    shares = max(1, -(-queries.count() // TILE))
    share = F.pmod(F.xxhash64("query_id"), F.lit(shares))
    tiles = queries.groupBy(share.alias("share")).agg(F.collect_list(F.struct("query_id", "query")).alias("queries"))
    tiles = tiles.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(many - 1))))
    group = F.pmod(F.xxhash64("block"), F.lit(many)).cast("int")
    sums = blocks.groupBy(group.alias("group")).agg(F.collect_list(F.struct("block", "high", "low")).alias("blocks"))

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ours, theirs = batch.column("queries")[i].values, batch.column("blocks")[i].values
                query = _matrix(ours.field("query"))
                high = _matrix(theirs.field("high"), query.shape[1])
                low = _matrix(theirs.field("low"), query.shape[1])
                query = np.pad(query, ((0, 0), (0, high.shape[1] - query.shape[1])))
                found = _product(np.maximum(query, 0), high) + _product(np.minimum(query, 0), low)
                n, m = found.shape
                ids = np.repeat(ours.field("query_id").to_numpy(), m)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids), pa.array(np.tile(theirs.field("block").to_numpy(), n)), pa.array(found.ravel())],
                    ["query_id", "block", "bound"],
                )

    found = tiles.join(sums, "group").select("queries", "blocks").mapInArrow(bound, "query_id long, block long, bound long")
    order = Window.partitionBy("query_id").orderBy(F.desc("bound"), "block")
    return found.withColumn("turn", F.row_number().over(order))


def _scores(pairs: DataFrame, queries: DataFrame, blocks: DataFrame, k: int) -> DataFrame:
    """The k best rows of each block for each query paired with it."""
    share = F.pmod(F.xxhash64("query_id"), F.lit(max(1, -(-queries.count() // TILE))))
    asked = pairs.join(queries, "query_id").groupBy("block", share.alias("share"))
    asked = asked.agg(F.collect_list(F.struct("query_id", "query")).alias("queries"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ours = batch.column("queries")[i].values
                ids = batch.column("ids")[i].values.to_numpy()
                matrix = batch.column("matrix")[i].values.to_numpy().reshape(len(ids), -1)
                query = _matrix(ours.field("query"), matrix.shape[1])
                matrix = np.pad(matrix, ((0, 0), (0, query.shape[1] - matrix.shape[1])))
                product = _product(query, matrix)
                for query_id, row in zip(ours.field("query_id").to_pylist(), product):
                    others = np.flatnonzero(ids != query_id)
                    best = others[np.lexsort((ids[others], -row[others]))[:k]]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(best), query_id)), pa.array(ids[best]), pa.array(row[best])],
                        ["query_id", "vec_id", "score"],
                    )

    rows = asked.join(blocks.select("block", "ids", "matrix"), "block").select("queries", "ids", "matrix")
    return rows.mapInArrow(score, "query_id long, vec_id long, score long")


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a times b transposed, in whole numbers; by way of floats where these are exact."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if most < 2.0**53:
        return (a.astype(float) @ b.T.astype(float)).astype(np.int64)
    return a @ b.T
