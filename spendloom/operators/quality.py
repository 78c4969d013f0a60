"""Completeness of the main columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

CHECKED = ("merchant", "amount", "category")


def _present(df: DataFrame, column: str) -> Column:
    """Number of values that are neither null nor NaN."""
    there = F.col(column).isNotNull()
    if isinstance(df.schema[column].dataType, (T.DoubleType, T.FloatType)):
        there = there & ~F.isnan(column)
    return F.count_if(there)


def completeness(df: DataFrame) -> Column:
    """Aggregate: mean share of present values over the checked columns, 0 if empty."""
    checked = [c for c in CHECKED if c in df.columns]
    if not checked:
        return F.lit(0.0)
    rows = F.count(F.lit(1))
    shares = [_present(df, c) / F.when(rows > 0, rows) for c in checked]
    return F.coalesce(reduce(Column.__add__, shares) / len(checked), F.lit(0.0))


def quality_score(df: DataFrame) -> DataFrame:
    return df.agg(completeness(df).alias("data_quality_score"))


def column_completeness(df: DataFrame) -> DataFrame:
    """One row per checked column with its share of present values."""
    checked = [c for c in CHECKED if c in df.columns]
    rows = F.count(F.lit(1))
    shares = df.agg(
        *[F.coalesce(_present(df, c) / F.when(rows > 0, rows), F.lit(0.0)).alias(c) for c in checked]
    )
    return shares.unpivot([], checked, "column_name", "share")
