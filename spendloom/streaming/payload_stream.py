"""Cleaning a stream of payloads.

A payload is one request.  Reading and trimming need only the payload itself
and run on the stream; duplicates and outliers are judged within a payload and
run per micro-batch.  As no step looks beyond a payload, the result does not
depend on how payloads fall into micro-batches.  The only thing that is carried
from batch to batch are the running totals of usage: each batch writes those of
the batch before plus its own, so no history is read, and a batch that is run
again overwrites what it wrote and counts once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.errors import AnalysisException

from spendloom.config import CleanConfig
from spendloom.plans import payload_configs
from spendloom.session import temporary_tables


def clean_payloads(payloads: DataFrame, config: CleanConfig = CleanConfig()) -> DataFrame:
    """The batch form: every payload of a table cleaned on its own."""
    return payload_configs.clean_payloads(payloads, config).rows


def clean_stream(
    payloads: DataFrame,
    out_dir: str,
    checkpoint_dir: str,
    config: CleanConfig = CleanConfig(),
    *,
    available_now: bool = True,
) -> StreamingQuery:
    """Start cleaning a stream with ``payload_id`` and ``body``.

    A payload's own ``config`` overrides ``config``.  Writes ``rows``,
    ``rejects``, ``usage`` and ``insights`` (both per payload) and the running
    ``totals`` below ``out_dir``, one folder per micro-batch.  A micro-batch that
    is run again overwrites its own folder.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        clean_batch(batch, batch_id, out_dir, config)

    writer = payloads.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint_dir)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def clean_batch(batch: DataFrame, batch_id: int, out_dir: str, config: CleanConfig = CleanConfig()) -> None:
    """One micro-batch of :func:`clean_stream`."""
    spark = batch.sparkSession

    def save(df: DataFrame, table: str) -> DataFrame:
        path = f"{out_dir}/{table}/batch_id={batch_id}"
        df.write.mode("overwrite").parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    with temporary_tables(spark):
        result = payload_configs.clean_payloads(batch, config)
        rows = save(result.rows, "rows")
        save(result.rejects, "rejects")
        usage = save(result.usage.withColumn("ts", F.current_timestamp()), "usage")
        save(payload_configs.payload_insights(rows, usage.drop("ts")), "insights")
        own = usage_totals(usage.withColumn("batch_id", F.lit(batch_id)))
        both = own.unionByName(_totals_before(spark, out_dir, batch_id)) if batch_id else own
        save(both.agg(*[F.sum(c).alias(c) for c in own.columns]).withColumn("ai_cost", F.round("ai_cost", 2)), "totals")


def _totals_before(spark: SparkSession, out_dir: str, batch_id: int) -> DataFrame:
    """The totals that the batch before wrote; from the usage of all earlier batches if it wrote none."""
    try:
        return spark.read.parquet(f"{out_dir}/totals/batch_id={batch_id - 1}")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
    return usage_totals(spark.read.parquet(f"{out_dir}/usage").filter(F.col("batch_id") < batch_id))


def running_totals(spark: SparkSession, out_dir: str) -> DataFrame:
    """The totals after the last batch; there is one row of totals per batch."""
    totals = spark.read.parquet(f"{out_dir}/totals")
    names = [c for c in totals.columns if c != "batch_id"]
    return totals.agg(*[F.max_by(c, "batch_id").alias(c) for c in names])


def usage_totals(usage: DataFrame) -> DataFrame:
    """Totals over all payloads of the written ``usage``."""
    return usage.agg(
        F.count_distinct("batch_id").alias("batches"),
        F.count(F.lit(1)).alias("payloads"),
        F.coalesce(F.sum("rows_processed"), F.lit(0)).alias("rows_processed"),
        F.coalesce(F.sum("ai_requests"), F.lit(0)).alias("ai_requests"),
        F.coalesce(F.round(F.sum("ai_cost"), 2), F.lit(0.0)).alias("ai_cost"),
    )
