"""Replies of earlier runs as an append-only table, bucketed by request.

A run appends its replies and rewrites nothing.  Entries of a request share a
bucket, so looking requests up and finding the newest reply of each need no
exchange of the log.  ``compact`` leaves one entry per request.

The log is a folder.  Each compaction writes a new generation into it, which
counts once its files are complete, so a compaction that fails or is run again
leaves the log as it was.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "request string, kind string, key string, reply string, seq long"
_GENERATION = re.compile(r"generation=(\d+)-buckets=(\d+)$")


class ReplyLog:
    """The log in ``folder``; ``buckets`` counts when its first generation is made.

    A bucket is read by one task, so there should be as many as let one fit
    there; a compaction may choose another number.  Appending and compacting at
    the same time is not supported.
    """

    def __init__(self, spark: SparkSession, folder: str, *, buckets: int = 64) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._files = self._path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if not self._generations():
            self._write(spark.createDataFrame([], SCHEMA), 0, buckets)

    def table(self) -> DataFrame:
        """All entries: ``kind, key, reply, seq``."""
        return self._log().drop("request")

    def append(self, replies: DataFrame, *, seq: int | Column | None = None) -> None:
        """Add the new replies (``kind, key, reply, cached``) of a run.

        Failed requests, analyses and replies from a cache are left out.  ``seq``
        tells old from new, by default the time in microseconds; appending the
        same replies again changes nothing but their age.
        """
        age = F.unix_micros(F.current_timestamp()) if seq is None else F.lit(seq)
        fresh = replies.filter(~F.col("cached") & F.col("reply").isNotNull() & (F.col("kind") != "analysis"))
        generation = self._generations()[-1]
        rows = fresh.select(_request(), "kind", "key", "reply", age.cast("long").alias("seq"))
        # One file per bucket and run, not one per bucket and task.
        rows.repartition(generation[1], "request").write.insertInto(self._register(*generation))

    def hits(self, asked: DataFrame) -> DataFrame:
        """Requests with a stored reply, as ``kind, key, reply``: the newest that is not empty."""
        stored = _newest(self._log()).select("request", "reply")
        return asked.select(_request(), "kind", "key").join(stored, "request").select("kind", "key", "reply")

    def misses(self, asked: DataFrame) -> DataFrame:
        """Requests without a stored reply."""
        stored = self._log().filter(F.col("reply") != "").select("request")
        return asked.withColumn("_request", _request()).join(stored, F.col("_request") == F.col("request"), "left_anti").drop("_request")

    def compact(self, *, buckets: int | None = None) -> None:
        """One entry per request, the newest with a reply, bucket by bucket.

        The generation before the new one stays for readers that have begun.
        """
        *older, (number, before) = self._generations()
        self._write(_newest(self._log()), number + 1, buckets or before)
        for generation in older:
            self.spark.sql(f"DROP TABLE IF EXISTS {self._name(*generation)}")
            self._files.delete(self._path(self._place(*generation)), True)

    def _log(self) -> DataFrame:
        return self.spark.table(self._register(*self._generations()[-1]))

    def _generations(self) -> list[tuple[int, int]]:
        """Number and buckets of the complete generations, oldest first."""
        root = self._path(self.folder)
        found = self._files.listStatus(root) if self._files.exists(root) else []
        names = [(_GENERATION.search(f.getPath().toString()), f.getPath()) for f in found]
        complete = [m for m, path in names if m and self._files.exists(self._path(path, "_complete"))]
        return sorted((int(m[1]), int(m[2])) for m in complete)

    def _place(self, number: int, buckets: int) -> str:
        return f"{self.folder}/generation={number}-buckets={buckets}"

    def _name(self, number: int, buckets: int) -> str:
        return "reply_log_" + hashlib.md5(self._place(number, buckets).encode()).hexdigest()

    def _register(self, number: int, buckets: int) -> str:
        name = self._name(number, buckets)
        self.spark.sql(
            f"CREATE TABLE IF NOT EXISTS {name} ({SCHEMA}) USING parquet "
            f"CLUSTERED BY (request) INTO {buckets} BUCKETS LOCATION '{self._place(number, buckets)}'"
        )
        return name

    def _write(self, rows: DataFrame, number: int, buckets: int) -> None:
        name, place = self._name(number, buckets), self._path(self._place(number, buckets))
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self._files.delete(place, True)  # left by an attempt that failed
        self._files.mkdirs(place)
        rows.write.insertInto(self._register(number, buckets))
        self._files.create(self._path(place, "_complete")).close()


def _request() -> Column:
    """Kind and key as one column: a join by both would lose the buckets where the kind is a constant."""
    return F.concat("kind", F.lit("|"), "key").alias("request")


def _newest(log: DataFrame) -> DataFrame:
    """One entry per request: the newest with a reply."""
    entry = F.max(F.struct("seq", "reply", "kind", "key")).alias("_entry")
    best = log.filter(F.col("reply") != "").groupBy("request").agg(entry)
    return best.select("request", *[f"_entry.{c}" for c in ("kind", "key", "reply", "seq")])
