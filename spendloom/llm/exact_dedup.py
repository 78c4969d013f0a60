"""Exact duplicates by a tree merge of sorted digest runs.

Every partition sorts the digests of its own texts and keeps one entry per
digest.  The partitions are numbered in base ``fan_in``; in round i each of
them cuts its run by the i-th digit of the digests and exchanges the pieces
with the partitions that differ from it in that digit only.  A receiver merges
the ``fan_in`` runs it gets and keeps one entry per text.  A round doubles the
covered distance (``fan_in`` 2) or quadruples it (4), as in a binomial tree,
but all partitions work in all rounds and the result stays spread out, so no
task ever holds more than its share.

Copies shrink to one entry per partition before anything is shuffled and to
one entry per ``fan_in`` runs in each round, so a text that makes up a third of
all rows is never gathered.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spendloom.llm.common import as_bytes, shuffle_partitions, slices
from spendloom.session import write_shared

_ENTRY = "node int, key long, digest binary, n_bytes long, keep_id long, keep_row long, copies long"


def exact_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest", fan_in: int = 4
) -> DataFrame:
    """One row per document: which document of its equal texts stays.

    Texts are equal if identical after lower-casing A-Z; a null text is empty.
    ``keep`` is 'largest' or 'smallest' (of the ids; a null id loses against any
    other).  Rows repeated with their id count each, and one of them stays.

    Returns doc_id, digest (SHA-256), keep_id, group_size, kept.
    An empty table gives an empty result.
    """
    if keep not in ("largest", "smallest"):
        raise ValueError(f"keep: {keep}")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    digests = rows.mapInArrow(_digests, "doc_id long, key long, digest binary, n_bytes long")
    digests = write_shared(digests.withColumn("row", F.monotonically_increasing_id()), "digests")
    merged = merge_runs(digests, keep, fan_in, shuffle_partitions(docs.sparkSession))
    groups = merged.filter("copies > 1").select("key", "digest", "keep_id", "keep_row", "copies")
    found = digests.join(groups, ["key", "digest"], "left")
    alone = F.col("copies").isNull()
    return found.select(
        "doc_id",
        "digest",
        F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("copies", F.lit(1)).alias("group_size"),
        (alone | (F.col("row") == F.col("keep_row"))).alias("kept"),
    )


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    The texts are shuffled once, for the join with the ids that stay.
    """
    found = exact_duplicates(docs, id_col, text_col, keep)
    stay = found.filter("kept").select(F.col("doc_id").alias("_stay_id"), F.col("digest").alias("_stay_digest"))
    marked = docs.withColumn("_digest", digest_column(F.col(text_col)))
    same = F.col(id_col).cast("long").eqNullSafe(F.col("_stay_id")) & (F.col("_digest") == F.col("_stay_digest"))
    first = Window.partitionBy(F.col(id_col).cast("long"), "_digest").orderBy(F.lit(0))
    return (
        marked.join(stay, same, "left_semi")
        .withColumn("_nth", F.row_number().over(first))
        .filter("_nth = 1")
        .drop("_digest", "_nth")
    )


def digest_column(text: Column) -> Column:
    """The digest of ``_digest`` as an expression."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.unhex(F.sha2(F.translate(F.coalesce(text, F.lit("")), upper, upper.lower()), 256))


def _digest(text: bytes) -> bytes:
    return hashlib.sha256(text.lower()).digest()


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in itertools.chain.from_iterable(slices(b, "text") for b in batches):
        texts = as_bytes(batch.column("text"))
        digests = [_digest(b) for b in texts]
        keys = np.frombuffer(b"".join(digests), ">i8").reshape(-1, 4)[:, 0].astype("int64") if digests else []
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                pa.array(keys, pa.int64()),
                pa.array(digests, pa.binary()),
                pa.array([len(b) for b in texts], pa.int64()),
            ],
            ["doc_id", "key", "digest", "n_bytes"],
        )


def merge_runs(digests: DataFrame, keep: str, fan_in: int, at_least: int) -> DataFrame:
    """One entry per digest: the kept id and row, and the number of copies."""
    rounds = 1
    while fan_in**rounds < at_least:
        rounds += 1
    nodes = fan_in**rounds
    runs = digests.select(
        F.pmod(F.spark_partition_id(), F.lit(nodes)).alias("node"), "key", "digest", "n_bytes",
        F.col("doc_id").alias("keep_id"), F.col("row").alias("keep_row"), F.lit(1).cast("long").alias("copies"),
    )
    runs = runs.sortWithinPartitions("key", "digest").mapInArrow(_merger(keep), _ENTRY)
    for i in range(rounds):
        place = fan_in**i
        here = F.floor(F.col("node") / place) % fan_in
        # The leading bits of the key decide, so a partition ends with one range of digests.
        there = F.pmod(F.shiftright("key", 40), F.lit(nodes)).cast("long")
        there = F.floor(there / place) % fan_in
        runs = runs.withColumn("node", (F.col("node") + (there - here) * place).cast("int"))
        runs = runs.repartitionById(nodes, F.col("node")).sortWithinPartitions("key", "digest")
        runs = runs.mapInArrow(_merger(keep), _ENTRY)
    return runs


def _merger(keep: str):
    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Merge the sorted runs of this partition: equal entries become one.

        Entries are equal if the whole digest and the length of the text are,
        not only the key they are sorted by.
        """
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            batch = pa.RecordBatch.from_arrays(batch.columns, batch.schema.names)  # without "not null"
            merged = _merge_equal(batch if held is None else pa.concat_batches([held, batch]), keep)
            if merged.num_rows > 1:
                yield merged.slice(0, merged.num_rows - 1)
            held = merged.slice(merged.num_rows - 1)
        if held is not None:
            yield held

    return merge


def _merge_equal(batch: pa.RecordBatch, keep: str) -> pa.RecordBatch:
    digests = np.frombuffer(b"".join(batch.column("digest").to_pylist()), "V32")
    sizes = batch.column("n_bytes").to_numpy()
    new = np.ones(len(digests), bool)
    new[1:] = (digests[1:] != digests[:-1]) | (sizes[1:] != sizes[:-1])
    starts = np.flatnonzero(new)
    ids = batch.column("keep_id")
    known = ids.is_valid().to_numpy(zero_copy_only=False)
    rows = batch.column("keep_row").to_numpy()
    group = np.cumsum(new) - 1
    value = ids.fill_null(0).to_numpy()
    # Best entry of each group: known ids first, then the id, then the row.
    order = np.lexsort((-rows, value if keep == "largest" else -value, known, group))
    best = order[np.append(np.flatnonzero(np.diff(group[order])), len(order) - 1)]
    copies = np.add.reduceat(batch.column("copies").to_numpy(), starts)
    taken = batch.take(pa.array(best))
    columns = [pa.array(copies, pa.int64()) if n == "copies" else taken.column(n) for n in taken.schema.names]
    return pa.RecordBatch.from_arrays(columns, taken.schema.names)
