"""Row-local cleaning: trim, parse money, fill blanks, complete the columns."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spendloom.functions import fixed
from spendloom.functions.text import money, strip


def trim_texts(
    df: DataFrame, *, stringify_nulls: bool | Column = False, skip: Sequence[str] = ()
) -> DataFrame:
    """Trim every text column and the texts of maps.  Nulls stay null unless ``stringify_nulls``."""

    def trimmed(text: Column) -> Column:
        text = strip(text)
        if stringify_nulls is False:
            return text
        return F.coalesce(text, F.when(F.lit(stringify_nulls) if stringify_nulls is True else stringify_nulls, F.lit("None")))

    columns = {}
    for f in df.schema.fields:
        if f.name in skip:
            continue
        if isinstance(f.dataType, T.StringType):
            columns[f.name] = trimmed(F.col(f.name))
        elif isinstance(f.dataType, T.MapType) and isinstance(f.dataType.valueType, T.StringType):
            columns[f.name] = F.transform_values(f.name, lambda _, v: trimmed(v))
    return df.withColumns(columns) if columns else df


def drop_empty_rows(
    df: DataFrame, *, order_by: str = "txn_id", scope: Sequence[str] = (), skip: Sequence[str] = ()
) -> DataFrame:
    """Drop rows in which every column but the order key, scope and ``skip`` is null.

    A map counts as null if all its values are.
    """
    there = [
        F.exists(F.map_values(f.name), lambda v: v.isNotNull()) if isinstance(f.dataType, T.MapType) else F.col(f.name).isNotNull()
        for f in df.schema.fields
        if f.name != order_by and f.name not in scope and f.name not in skip
    ]
    return df.filter(reduce(Column.__or__, [F.coalesce(t, F.lit(False)) for t in there])) if there else df


def parse_amount(df: DataFrame) -> DataFrame:
    """Turn ``amount`` into a double that is never null."""
    if "amount" not in df.columns:
        return df
    return df.withColumn("amount", money(F.col("amount"), df.schema["amount"].dataType))


def fill_blanks(df: DataFrame) -> DataFrame:
    """Fill null categories and descriptions, where those columns exist."""
    defaults = {"category": fixed.OTHER_CATEGORY, "description": fixed.NO_DESCRIPTION}
    present = {c: v for c, v in defaults.items() if c in df.columns}
    return df.na.fill(present) if present else df


def complete_columns(df: DataFrame) -> DataFrame:
    """Make sure ``merchant`` and a numeric ``amount`` exist."""
    for column in ("merchant", "amount"):
        if column not in df.columns:
            df = df.withColumn(column, F.lit(""))
    return parse_amount(df)
