"""Amount outliers by z-score."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def flag_outliers(
    df: DataFrame,
    *,
    threshold: float | Column = 3.0,
    scope: Sequence[str] = (),
    stats_from: DataFrame | None = None,
    small_scopes: bool = False,
) -> DataFrame:
    """Add ``is_outlier``: further than ``threshold`` deviations from the mean.

    The deviation is that of the whole population, so among ten rows or fewer
    nothing is further than three.  ``stats_from`` names a cheaper table with
    the same amounts, such as the survivors of duplicate removal.

    Mean and deviation are aggregated first and come back as a scalar, or per
    scope as a join; a window would move a whole scope into one task.
    ``small_scopes``: each scope was one row once, as a payload was, so it fits
    a task, and a window over ``df`` saves the join.
    """
    if "amount" not in df.columns:
        return df
    source = df if stats_from is None else stats_from
    mean, deviation = F.avg("amount"), F.stddev_pop("amount")
    if not scope:
        stats = source.agg(F.struct(mean.alias("mean"), deviation.alias("std"))).scalar()
        return df.withColumn("is_outlier", _is_far(stats["mean"], stats["std"], threshold))
    if small_scopes:
        whole = Window.partitionBy(*scope)
        flag = _is_far(F.col("_mean"), F.col("_std"), threshold)
        df = df.drop("is_outlier").withColumns({"_mean": mean.over(whole), "_std": deviation.over(whole)})
        return df.withColumn("is_outlier", flag).drop("_mean", "_std")
    stats = source.groupBy(*scope).agg(mean.alias("_mean"), deviation.alias("_std"))
    flag = _is_far(F.col("_mean"), F.col("_std"), threshold)
    return (
        df.join(stats, list(scope), "left")
        .select(*[F.col(c) for c in df.columns if c != "is_outlier"], flag.alias("is_outlier"))
    )


def _is_far(mean: Column, std: Column, threshold: float | Column) -> Column:
    # Spark sorts NaN above every number, so it is excluded by name.
    usable = (std > 0) & ~F.isnan(std)
    far = F.abs((F.col("amount") - mean) / std) > threshold
    return F.coalesce(F.when(usable, far), F.lit(False))
