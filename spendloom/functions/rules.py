"""Keyword rules as column expressions: the first rule that matches wins."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from spendloom.functions import fixed


def first_match(text: Column, rules: list, default: str) -> Column:
    """Name of the first rule with a keyword inside ``text``, ignoring case."""
    lowered = F.lower(text)
    result = None
    for keywords, name in rules:
        hit = F.lit(False)
        for keyword in keywords:
            hit = hit | lowered.contains(keyword)
        result = F.when(hit, name) if result is None else result.when(hit, name)
    return F.lit(default) if result is None else result.otherwise(default)


def keyword_vendor(merchant: Column) -> Column:
    return first_match(merchant, fixed.VENDOR_RULES, fixed.UNKNOWN_VENDOR)


def keyword_category(merchant: Column) -> Column:
    return first_match(merchant, fixed.CATEGORY_RULES, fixed.OTHER_CATEGORY)


def keyword_analysis(merchant: Column) -> Column:
    """The record of a full analysis, made from the keyword rules."""
    return F.struct(
        keyword_vendor(merchant).alias("vendor"),
        keyword_category(merchant).alias("category"),
        F.lit(fixed.KEYWORD_CONFIDENCE).alias("confidence"),
        F.lit(fixed.KEYWORD_IMPACT).alias("business_impact"),
        F.lit(fixed.LOW_RISK).alias("risk_level"),
    )
