"""Requests and cost, counted from tables instead of running counters.

A request log has one row per request: ``run_id, kind, key, cached, ts``, where
``kind`` is vendor, category or analysis.  Money is summed in whole cents.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendloom.functions import fixed


def request_cents(kind: Column) -> Column:
    price = F.lit(0)
    for name, cents in fixed.REQUEST_CENTS.items():
        price = F.when(kind == name, cents).otherwise(price)
    return price


def run_usage(
    rows_in: DataFrame,
    rows_kept: DataFrame,
    options,
    confidence: Column | None = None,
    *,
    scope: Sequence[str] = (),
    hits: DataFrame | None = None,
) -> DataFrame:
    """What a run costs when each row asks for each enabled step: one row, or one per scope.

    ``rows_in`` is the input, ``rows_kept`` what duplicate removal left.  A
    category request counts only if its confidence passed the gate.  ``options``
    are those of the run (see ``plans.cleaning.Options``), ``hits`` what
    :func:`count_hits` gives.
    """
    if confidence is None:
        confidence = F.lit(fixed.KEYWORD_CONFIDENCE)
    cents = fixed.REQUEST_CENTS
    requests, cost = F.lit(0).cast("long"), F.lit(0).cast("long")
    for name, kind in (("ai_vendor_enabled", "vendor"), ("ai_category_enabled", "category"), ("ai_analysis_enabled", "analysis")):
        on = options.step(name)
        if on is False:
            continue
        asks = F.lit(True) if on is True else on
        if kind == "category":
            asks = asks & (confidence >= options.value("ai_confidence_threshold"))
        count = F.count_if(asks)
        requests, cost = requests + count, cost + count * cents[kind]
    scope = list(scope)
    found = rows_kept.groupBy(*scope).agg(requests.alias("ai_requests"), (cost / 100).alias("ai_cost"))
    size = F.count(F.lit(1))
    chunked, chunk = options.value("chunked"), options.value("chunk_size")
    if chunked is False:
        chunks = []
    elif chunked is True:
        chunks = [F.ceil(size / chunk).alias("chunks_processed")]
    else:
        chunks = [F.max(F.when(chunked, chunk)).alias("_chunk")]
    processed = rows_in.groupBy(*scope).agg(size.alias("rows_processed"), *chunks)
    if "_chunk" in processed.columns:
        many = F.coalesce(F.ceil(F.col("rows_processed") / F.col("_chunk")), F.lit(1))
        processed = processed.withColumn("chunks_processed", many).drop("_chunk")
    none = F.lit(0).cast("long").alias("cache_hits")
    if scope:
        report = processed.join(found, scope, "left")
        report = report.select("*", none) if hits is None else report.join(hits, scope, "left")
        report = report.na.fill(0, ["ai_requests", "ai_cost", "cache_hits"])
    else:
        hits = found.select(none) if hits is None else hits
        one_row = [(processed, c) for c in processed.columns] + [(hits, "cache_hits")]
        report = found.select("*", *[table.select(c).scalar().alias(c) for table, c in one_row])
    report = report.withColumn("cleaner_version", F.lit(fixed.REPORT_VERSION))
    order = [*scope, "cleaner_version", "rows_processed", "ai_requests", "ai_cost", "cache_hits"]
    return report.select(*order, *[c for c in report.columns if c == "chunks_processed"])


def count_hits(asked: Sequence[tuple[DataFrame, DataFrame]], scope: Sequence[str] = ()) -> DataFrame:
    """Rows answered without a request of their own, one row or one per scope.

    ``asked`` has for each kind the rows' keys (scope, ``key``) and the replies
    to them.  A row is a hit if its reply was stored before the run, or another
    row of its scope asked for it.
    """
    scope = list(scope)
    each = [
        keys.join(replies.filter("reply IS NOT NULL").select("key", "cached"), "key").select(
            *scope, F.concat(F.lit(f"{i}|"), "key").alias("key"), "cached"
        )
        for i, (keys, replies) in enumerate(asked)
    ]
    fresh = F.count_distinct(F.when(~F.col("cached"), F.col("key")))
    return reduce(DataFrame.unionByName, each).groupBy(*scope).agg((F.count(F.lit(1)) - fresh).alias("cache_hits"))


def client_usage(log: DataFrame) -> DataFrame:
    """Requests that were really made, their cost, and the cost of one."""
    made = ~F.col("cached")
    requests = F.count_if(made)
    cost = F.coalesce(F.sum(F.when(made, request_cents(F.col("kind")))), F.lit(0)) / 100
    return log.agg(
        requests.alias("request_count"),
        cost.alias("total_cost"),
        (cost / F.greatest(requests, F.lit(1))).alias("average_cost_per_request"),
    )


def hit_rate(log: DataFrame, *, caching: bool = True) -> DataFrame:
    """The true share of cached answers, and the capped estimate from cache size."""
    requests = F.count_if(~F.col("cached"))
    if not caching:
        estimate = F.lit(0.0)
    else:
        entries = F.count_distinct(F.when(F.col("kind") != "analysis", F.col("key")))
        estimate = F.least(
            F.lit(fixed.HIT_RATE_CEILING), entries / F.greatest(requests, F.lit(1))
        )
    rows = F.count(F.lit(1))
    return log.agg(
        estimate.alias("cache_hit_rate"),
        F.coalesce(F.count_if("cached") / F.when(rows > 0, rows), F.lit(0.0)).alias("true_hit_rate"),
    )


def service_rollup(log: DataFrame) -> DataFrame:
    """Totals over all runs in the log, per request and per hour."""
    requests = F.count_distinct("run_id")
    cost = F.coalesce(F.sum(request_cents(F.col("kind"))), F.lit(0)) / 100
    seconds = F.timestamp_diff("MICROSECOND", F.min("ts"), F.max("ts")) / 1_000_000
    hours = F.greatest(F.coalesce(seconds, F.lit(0.0)) / 3600, F.lit(1.0))
    return log.agg(
        requests.alias("total_requests"),
        F.count(F.lit(1)).alias("total_ai_calls"),
        cost.alias("total_cost"),
        (cost / F.greatest(requests, F.lit(1))).alias("average_cost_per_request"),
        (requests / hours).alias("requests_per_hour"),
    )


def usage_by_run(log: DataFrame) -> DataFrame:
    """Requests, cost and hits of each run; every request is counted once."""
    return log.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("ai_requests"),
        (F.sum(request_cents(F.col("kind"))) / 100).alias("ai_cost"),
        F.count_if("cached").alias("cache_hits"),
    )
