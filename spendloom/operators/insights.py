"""Summaries of a cleaned table."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spendloom.operators.insight_buffers import HLL_LOG, around_median
from spendloom.operators.quality import completeness
from spendloom.session import write_shared


def exact_median(
    df: DataFrame, column: str = "amount", *, max_values: int = 1_000_000, around: Sequence | None = None
):
    """The interpolated median, or None without values.

    The built-in exact median keeps all distinct values of the table in one
    buffer.  Here a sketch tells two values that it is between (``around``, if
    they are known already); the values below are only counted, those between
    are counted one by one.  Ranges of values are narrowed further until at most
    ``max_values`` remain around the middle.  If the median is not between, all
    values are counted.
    """
    if max_values < 2:
        raise ValueError("max_values must be at least 2, as two values can be around the middle")
    if around is None:
        around = df.agg(around_median(column)).first()[0] or ()
    values, v = df.select(F.col(column).alias("v")).filter(F.col("v").isNotNull()), F.col("v")
    side = F.when(v < around[0], -1).when(v > around[1], 1).otherwise(0) if around else F.lit(0)
    counts = write_shared(
        values.groupBy(side.alias("side"), F.when(side == 0, v).alias("v")).agg(F.count(F.lit(1)).alias("n")),
        "value-counts",
    )
    sides = {r[0]: r[1:] for r in counts.groupBy("side").agg(F.sum("n"), F.count(F.lit(1))).collect()}  # at most 3 rows
    total = sum(n for n, _ in sides.values())
    if not total:
        return None
    middle = ((total - 1) // 2, total // 2)
    below = sides.get(-1, (0, 0))[0]
    inside, distinct = sides.get(0, (0, 0))
    if not below <= middle[0] <= middle[1] < below + inside:
        return exact_median(df, column, max_values=max_values, around=())
    counts, pieces = counts.filter("side = 0"), 64
    while distinct > max_values:
        shares = [k / pieces for k in range(1, pieces)]
        cuts = sorted(set(counts.agg(F.percentile_approx("v", shares)).first()[0]))
        bounds = F.lit(cuts)
        segment = F.size(F.filter(bounds, lambda c: c < F.col("v")))
        weights = dict(
            counts.groupBy(segment.alias("s")).agg(F.sum("n")).collect()  # at most 64 rows
        )
        start, chosen = below, []
        for s in range(len(cuts) + 1):
            end = start + weights.get(s, 0)
            if any(start <= rank < end for rank in middle):
                chosen.append((s, start))
            start = end
        first, last = chosen[0][0], chosen[-1][0]
        below = chosen[0][1]
        if first > 0:
            counts = counts.filter(F.col("v") > cuts[first - 1])
        if last < len(cuts):
            counts = counts.filter(F.col("v") <= cuts[last])
        distinct = counts.count()
    # A bounded number of values is left.
    until = F.sum("n").over(Window.orderBy("v").rowsBetween(Window.unboundedPreceding, 0)) + below
    ranked = counts.select("v", "n", until.alias("end"))
    hit = reduce(
        lambda a, b: a | b,
        [(F.col("end") > rank) & (F.col("end") - F.col("n") <= rank) for rank in middle],
    )
    return ranked.filter(hit).agg(F.avg("v")).first()[0]


def amount_summary(df: DataFrame, *, approximate_median: bool = False) -> DataFrame:
    """One row: count, total, mean, median, extremes and sample deviation."""
    columns = [F.count(F.lit(1)).alias("total_rows"), *_plain_amounts()]
    if approximate_median:
        return df.agg(*columns, F.percentile_approx("amount", 0.5).alias("median_amount"))
    return _with_median(df, columns)


def _with_median(df: DataFrame, columns: list[Column]) -> DataFrame:
    """The aggregates and the exact median, in two passes over ``df``."""
    found = write_shared(df.agg(*columns, around_median("amount").alias("_around")), "summary")
    median = exact_median(df, around=found.first()["_around"] or ())
    return found.withColumn("median_amount", F.lit(median).cast("double")).drop("_around")


def _plain_amounts() -> list[Column]:
    return [
        F.sum("amount").alias("total_amount"),
        F.avg("amount").alias("average_amount"),
        F.min("amount").alias("min_amount"),
        F.max("amount").alias("max_amount"),
        F.stddev_samp("amount").alias("std_amount"),
    ]


def top_vendors(df: DataFrame, n: int = 10) -> DataFrame:
    """The most frequent merchants; ties go by name."""
    return (
        df.filter(F.col("merchant").isNotNull())
        .groupBy("merchant")
        .agg(F.count(F.lit(1)).alias("n_rows"))
        .orderBy(F.desc("n_rows"), "merchant")
        .limit(n)
    )


def unique_vendors(df: DataFrame, *, approximate: bool = False) -> DataFrame:
    """The number of merchants; ``approximate`` needs no shuffle of the names and is within 3 %."""
    if approximate:
        return df.agg(F.hll_sketch_estimate(F.hll_sketch_agg("merchant", HLL_LOG)).alias("unique_vendors"))
    return df.agg(F.count_distinct("merchant").alias("unique_vendors"))


def category_breakdown(df: DataFrame) -> DataFrame:
    return (
        df.filter(F.col("category").isNotNull())
        .groupBy("category")
        .agg(F.count(F.lit(1)).alias("n_rows"))
    )


def outlier_summary(df: DataFrame) -> DataFrame:
    return df.agg(*_outlier_columns())


def _outlier_columns() -> list[Column]:
    flagged, rows = F.count_if("is_outlier"), F.count(F.lit(1))
    return [
        flagged.alias("outlier_count"),
        (flagged / F.when(rows > 0, rows) * 100).alias("outlier_percentage"),
    ]


def insights(
    df: DataFrame, counters: DataFrame | None = None, *, scope: Sequence[str] = (), n_vendors: int = 10,
    small_scopes: bool = False,
) -> DataFrame:
    """Everything known about a cleaned table as ``(section, name, value)`` rows.

    With a ``scope``, the same for each scope, led by the scope's columns.
    ``df`` is read several times, so pass a written table.  ``counters`` is a
    table of run counters, one row or one per scope; they replace summary values
    of that name.  The long form keeps categories, whose number is not bounded,
    out of a single row.  ``small_scopes``: each scope was one row once, as a
    payload was, so its rows go to one task and every count is made there.
    """
    scope = list(scope)
    if scope and small_scopes:
        df = df.repartition(*scope)
    if scope:
        summary = _scope_summary(df, scope)
    else:
        columns = [F.count(F.lit(1)).alias("total_rows")]
        if "amount" in df.columns:
            columns += _plain_amounts()
        if "merchant" in df.columns:
            columns.append(F.count_distinct("merchant").alias("unique_vendors"))
        if "is_outlier" in df.columns:
            columns += _outlier_columns()
        columns.append(completeness(df).alias("data_quality_score"))
        summary = _with_median(df, columns) if "amount" in df.columns else df.agg(*columns)
    if counters is not None and scope:
        # A request of which no row is left has an empty summary.
        summary = counters.select(*scope).join(summary, scope, "left").na.fill(0, ["total_rows", "data_quality_score"])
    if counters is not None and "is_outlier" in df.columns:
        summary = summary.withColumn("outliers_flagged", F.col("outlier_count"))
    # An empty table has a count and a score, nothing else.
    always = (*scope, "total_rows", "data_quality_score")
    summary = summary.select(
        *[F.col(c) if c in always else F.when(F.col("total_rows") > 0, F.col(c)).alias(c) for c in summary.columns]
    )
    parts = [_long(summary, scope)]
    if "merchant" in df.columns:
        top = top_vendors(df, n_vendors) if not scope else _top_by_scope(df, scope, n_vendors)
        parts.append(_section(top, "top_vendors", "merchant", scope))
    if "category" in df.columns:
        counts = category_breakdown(df) if not scope else _counts(df, "category", scope)
        parts.append(_section(counts, "category_breakdown", "category", scope))
    if counters is not None:
        names = [c for c in counters.columns if c not in scope]
        replaced = (F.col("section") == "summary") & F.col("name").isin(names)
        parts = [p.filter(~replaced) for p in parts]
        parts.append(_long(counters, scope))
    return reduce(DataFrame.unionByName, parts).filter(F.col("value").isNotNull())


def _scope_summary(df: DataFrame, scope: list[str]) -> DataFrame:
    """One row of summary values per scope.

    Values are counted first, so a scope that repeats a value has it once; the
    median of a scope is read off its running counts.
    """
    columns = [F.count(F.lit(1)).alias("total_rows")]
    if "is_outlier" in df.columns:
        columns += _outlier_columns()
    if "amount" in df.columns:
        columns += [c for c in _plain_amounts()]
    summary = df.groupBy(*scope).agg(*columns, completeness(df).alias("data_quality_score"))
    if "merchant" in df.columns:
        vendors = _counts(df, "merchant", scope).groupBy(*scope).agg(F.count(F.lit(1)).alias("unique_vendors"))
        summary = summary.join(vendors, scope, "left").na.fill(0, ["unique_vendors"])
    if "amount" in df.columns:
        counts = df.filter("amount IS NOT NULL").groupBy(*scope, "amount").agg(F.count(F.lit(1)).alias("n"))
        upto = Window.partitionBy(*scope).orderBy("amount")
        counts = counts.withColumn("end", F.sum("n").over(upto)).withColumn("all", F.sum("n").over(Window.partitionBy(*scope)))
        low, high = F.floor((F.col("all") - 1) / 2), F.floor(F.col("all") / 2)
        begin = F.col("end") - F.col("n")
        hit = ((begin <= low) & (F.col("end") > low)) | ((begin <= high) & (F.col("end") > high))
        medians = counts.filter(hit).groupBy(*scope).agg(F.avg("amount").alias("median_amount"))
        summary = summary.join(medians, scope, "left")
    return summary


def _counts(df: DataFrame, column: str, scope: list[str]) -> DataFrame:
    return df.filter(F.col(column).isNotNull()).groupBy(*scope, column).agg(F.count(F.lit(1)).alias("n_rows"))


def _top_by_scope(df: DataFrame, scope: list[str], n: int) -> DataFrame:
    order = Window.partitionBy(*scope).orderBy(F.desc("n_rows"), "merchant")
    return _counts(df, "merchant", scope).withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= n)


def _long(rows: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    names = [c for c in rows.columns if c not in scope]
    values = rows.select(*scope, *[F.col(c).cast("double").alias(c) for c in names])
    return values.unpivot(list(scope), names, "name", "value").select(
        *scope, F.lit("summary").alias("section"), "name", "value"
    )


def _section(counts: DataFrame, section: str, name: str, scope: Sequence[str] = ()) -> DataFrame:
    return counts.select(
        *scope,
        F.lit(section).alias("section"),
        F.col(name).alias("name"),
        F.col("n_rows").cast("double").alias("value"),
    )
