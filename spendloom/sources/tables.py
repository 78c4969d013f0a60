"""Transaction tables in and out.  Any Spark format will do."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_transactions(
    spark: SparkSession, path: str, *, format: str = "parquet", schema=None, **options
) -> DataFrame:
    """Known columns first, further ones in alphabetical order after them."""
    reader = spark.read.format(format).options(**options)
    df = (reader.schema(schema) if schema is not None else reader).load(path)
    return canonical_columns(df)


def canonical_columns(df: DataFrame) -> DataFrame:
    if "merchant" not in df.columns:
        raise ValueError("a transaction table needs a 'merchant' column")
    known = ["txn_id", "merchant", "amount", "description", "memo", "category"]
    first = [c for c in known if c in df.columns]
    return df.select(*first, *sorted(c for c in df.columns if c not in known))


def stack(tables: Sequence[DataFrame]) -> DataFrame:
    """Tables under each other, by column name; missing columns are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def within_row_limit(df: DataFrame, max_rows: int = 100_000) -> bool:
    """Whether a batch is small enough to be admitted; reads no more than needed."""
    return df.select(F.lit(1)).limit(max_rows + 1).count() <= max_rows


def as_json_rows(df: DataFrame) -> DataFrame:
    """Each row as one JSON object, nulls included."""
    return df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("json"))


def write_result(rows: DataFrame, insights: DataFrame, path: str, *, format: str = "parquet") -> None:
    """Cleaned rows and insights as two tables below ``path``."""
    rows.write.mode("overwrite").format(format).save(f"{path}/rows")
    insights.write.mode("overwrite").format(format).save(f"{path}/insights")
