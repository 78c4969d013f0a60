"""Spend categories behind a confidence gate, and analysis of a transaction."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendloom.functions import fixed
from spendloom.functions.rules import keyword_analysis, keyword_category


def keyword_suggestion(merchant: Column) -> tuple[Column, Column]:
    return keyword_category(merchant), F.lit(fixed.KEYWORD_CONFIDENCE)


def categorise(
    df: DataFrame,
    suggest: Callable[[Column], tuple[Column, Column]] = keyword_suggestion,
    *,
    threshold: float | Column = 0.7,
) -> DataFrame:
    """Take the suggested category if its confidence reaches ``threshold``.

    Otherwise the old category stays.  The column is added where it is missing.
    """
    if not {"merchant", "amount"} <= set(df.columns):
        return df
    category, confidence = suggest(F.coalesce("merchant", F.lit("None")))
    return gate_category(df, category, confidence, threshold=threshold)


def gate_category(
    df: DataFrame, category: Column, confidence: Column, *, threshold: float | Column = 0.7
) -> DataFrame:
    old = F.col("category") if "category" in df.columns else F.lit(None).cast("string")
    return df.withColumn("category", F.when(confidence >= threshold, category).otherwise(old))


def enrich_description(
    df: DataFrame, analyse: Callable[[Column], Column] = keyword_analysis
) -> DataFrame:
    """Append the business impact to the description; add impact and risk."""
    if not {"merchant", "description"} <= set(df.columns):
        return df
    return apply_analysis(df, analyse(F.coalesce("merchant", F.lit("None"))))


def apply_analysis(df: DataFrame, analysis: Column) -> DataFrame:
    impact = analysis["business_impact"]
    return df.withColumns(
        {
            "description": F.concat_ws(" | ", "description", impact),
            "business_impact": impact,
            "risk_level": analysis["risk_level"],
        }
    )


def off_list_categories(df: DataFrame) -> DataFrame:
    """Rows whose category is none of the nominal ones."""
    return df.filter(~F.col("category").isin(fixed.CATEGORIES))
