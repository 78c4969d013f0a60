"""Best-fit packing of token sequences by exact complements.

Only the lengths matter to a plan, and there are at most ``capacity`` of them.
The pieces are counted by length in Spark; the plan is made from these counts
alone and says for each kind of sequence which lengths it holds and how many
sequences of the kind there are.  Then each piece finds its place by its rank
among the pieces of its length.  The plan's size does not depend on the data:
every step uses up a length or is one of a bounded number of splits.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spendloom.llm.bpe import byte_pairs
from spendloom.llm.common import slices
from spendloom.session import write_shared

CAPACITY = 2048


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pack all documents into sequences of at most ``capacity`` tokens.

    A document is the ids of its text by the byte-level BPE file ``tokenizer``
    and then id 0, so a null or empty text has one token.  A longer document is
    cut into pieces of ``capacity``; only its first piece may be shorter.
    Repeated rows are packed each for itself.

    Returns doc_id, piece, start, length, ids_crc32, sequence_id, offset.
    """
    return place(write_shared(pieces(docs, tokenizer, capacity, id_col, text_col), "pieces"), capacity)


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length and ids_crc32 of every piece of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = byte_pairs(tokenizer).encode
        for batch in batches:
            for part in slices(batch, "text"):
                out = ([], [], [], [], [])
                for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist()):
                    ids = encode(text or "") + b"\0\0\0\0"
                    n = len(ids) // 4
                    start = 0
                    for nth, end in enumerate(range((n - 1) % capacity + 1, n + 1, capacity)):
                        crc = zlib.crc32(ids[4 * start : 4 * end])
                        for column, value in zip(out, (doc_id, nth, start, end - start, crc)):
                            column.append(value)
                        start = end
                types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                arrays = [pa.array(c, t) for c, t in zip(out, types)]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "piece", "start", "length", "ids_crc32"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def place(found: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add sequence_id and offset to ``found``, which has a length from 1 to capacity."""
    spark = found.sparkSession
    counts = {r["length"]: r["count"] for r in found.groupBy("length").count().collect()}  # at most capacity rows
    plan = spark.createDataFrame(_slots(plan_sequences(counts, capacity)), _SLOT)
    # Ranks within a length: hot lengths are cut into shares, so that no task numbers more than one share.
    share = max(256, -(-sum(counts.values()) // 8192))
    shares = spark.createDataFrame([(n, -(-c // share)) for n, c in counts.items()], "length long, shares long")
    keyed = found.join(F.broadcast(shares), "length").withColumn(
        "share", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.col("shares"))
    )
    sizes = keyed.groupBy("length", "share").count()  # at most 8192 + capacity rows
    before = Window.partitionBy("length").orderBy("share").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("length", "share", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    # A length is cut where the plan changes, and a piece looks its slot up among the cuts of its length.
    cuts = plan.groupBy("length").agg(F.sort_array(F.collect_list(F.struct(*[c for c in plan.columns if c != "length"]))).alias("slots"))
    nth = Window.partitionBy("length", "share").orderBy("doc_id", "piece", "start")
    ranked = keyed.withColumn("rank", F.row_number().over(nth) - 1)
    ranked = ranked.join(F.broadcast(sizes), ["length", "share"]).withColumn("rank", F.col("rank") + F.col("before"))
    slot = F.element_at(F.filter("slots", lambda s: s["first_rank"] <= F.col("rank")), -1)
    return (
        ranked.join(F.broadcast(cuts), "length")
        .withColumn("slot", slot)
        .select(
            "doc_id", "piece", "start", "length", "ids_crc32",
            (F.col("slot.sequence") + F.col("rank") - F.col("slot.first_rank")).alias("sequence_id"),
            F.col("slot.offset").alias("offset"),
        )
    )


_SLOT = "length long, first_rank long, sequence long, offset long"


def _slots(plan: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int]]:
    """Ranks of each length, in the order of the plan, with their first sequence and offset."""
    rows, used, sequence = [], {}, 0
    for lengths, times in plan:
        offset = 0
        for n in lengths:
            rows.append((n, used.get(n, 0), sequence, offset))
            used[n] = used.get(n, 0) + times
            offset += n
        sequence += times
    return rows


Plan = list[tuple[tuple[int, ...], int]]


def plan_sequences(counts: dict[int, int], capacity: int = CAPACITY) -> Plan:
    """Kinds of sequences (lengths, number of sequences) that hold all counted lengths.

    First exact complements: from the longest length down, its gap is filled by
    one, two or three lengths that sum to it, looked up in an index of sums; as
    many sequences are made at once as the counts allow.  What is left is packed
    best-fit, longest first, into the open sequences with the least room.  Where
    lengths are plenty that can end with more sequences than best-fit alone, as
    it uses up the short lengths early; then the plan of best-fit alone is taken.
    """
    counts = {n: c for n, c in counts.items() if c}
    filled, left = _fill_exactly(counts, capacity)
    return min((filled + _best_fit(left, capacity), _best_fit(counts, capacity)), key=lambda plan: sum(n for _, n in plan))


def _fill_exactly(counts: dict[int, int], capacity: int) -> tuple[Plan, dict[int, int]]:
    """Sequences without room, and the counts that are left."""
    sums, plan = _Sums(counts, capacity), []
    left = sums.left
    for n in sorted(counts, reverse=True):
        while left[n]:
            filling = sums.complement(capacity - n, n)
            if filling is None:
                break
            kind = (n, *filling)
            times = min(left[x] // kind.count(x) for x in set(kind))
            for x in kind:
                left[x] -= times
            plan.append((kind, times))
    return plan, {n: c for n, c in left.items() if c}


class _Sums:
    """Which one, two or three of the lengths that are left sum to a gap.

    The pairs are sorted by their sum; pairs whose lengths are used up are passed
    for good.  Three lengths are one length and a pair for the rest.
    """

    def __init__(self, counts: dict[int, int], capacity: int) -> None:
        self.left = dict(counts)
        lengths = np.array(sorted(counts), np.int64)
        y, x = (lengths[k] for k in np.triu_indices(len(lengths)))
        fits = x + y <= capacity
        x, y = x[fits], y[fits]
        order = np.lexsort([-x, x + y])
        self._x, self._y = x[order], y[order]
        ends = np.searchsorted(self._x + self._y, np.arange(capacity + 2)).tolist()
        self._next, self._end = ends[:-1], ends[1:]
        self._lengths = lengths[::-1].tolist()

    def complement(self, gap: int, first: int) -> tuple[int, ...] | None:
        """The fewest lengths that sum to the gap beside ``first``, the longest of them first."""
        if gap == 0:
            return ()
        if self._free(gap, first):
            return (gap,)
        if pair := self._pair(gap, first):
            return pair
        for x in self._lengths:
            if x < gap - 1 and self._free(x, first) and (pair := self._pair(gap - x, first, x)):
                return (x, *pair)
        return None

    def _free(self, x: int, *taken: int) -> bool:
        return self.left.get(x, 0) > taken.count(x)

    def _pair(self, total: int, *taken: int) -> tuple[int, int] | None:
        left, at, end = self.left, self._next[total], self._end[total]
        while at < end and not (left[int(self._x[at])] and left[int(self._y[at])]):
            at += 1
        self._next[total] = at
        for k in range(at, end):
            x, y = int(self._x[k]), int(self._y[k])
            if self._free(x, *taken) and self._free(y, x, *taken):
                return x, y
        return None


def _best_fit(left: dict[int, int], capacity: int) -> Plan:
    """Best-fit decreasing over counted lengths; open sequences of a kind are handled at once."""
    open_by_room: dict[int, list[tuple[tuple[int, ...], int]]] = {capacity: []}
    for n in sorted(left, reverse=True):
        count = left[n]
        while count:
            rooms = [r for r, kinds in open_by_room.items() if r >= n and kinds]
            if rooms:
                room = min(rooms)
                kind, times = open_by_room[room].pop()
                used = min(count, times)
                if times > used:
                    open_by_room[room].append((kind, times - used))
                each = 1
            else:
                kind, room, each = (), capacity, capacity // n
                if count < each:
                    each = count
                used = count // each
            open_by_room.setdefault(room - n * each, []).append((kind + (n,) * each, used))
            count -= used * each
    return [entry for kinds in open_by_room.values() for entry in kinds if entry[1]]
