"""Request texts for a model and the keys under which replies are stored."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from spendloom.functions import fixed


def _text(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def _dollars() -> Column:
    return F.concat(F.lit("$"), F.format_number(F.coalesce("amount", F.lit(0.0)), 2))


def vendor_prompt() -> Column:
    return F.concat(
        F.lit("Name the company behind this purchase. Answer with its usual name only.\nMerchant: "),
        _text("merchant"),
        F.lit("\nDescription: "),
        _text("description"),
        F.lit("\nMemo: "),
        _text("memo"),
    )


def category_prompt() -> Column:
    return F.concat(
        F.lit(
            "Choose the spend category of this purchase from: "
            + "; ".join(fixed.CATEGORIES)
            + '.\nAnswer as {"category": text, "confidence": number from 0 to 1}.\nMerchant: '
        ),
        _text("merchant"),
        F.lit("\nDescription: "),
        _text("description"),
        F.lit("\nAmount: "),
        _dollars(),
        F.lit("\nMemo: "),
        _text("memo"),
    )


def analysis_prompt() -> Column:
    return F.concat(
        F.lit(
            "Assess this purchase. Answer as an object with the texts vendor, category, "
            "business_impact, risk_level (High, Medium or Low) and recommendation, and the "
            "number confidence from 0 to 1.\nMerchant: "
        ),
        _text("merchant"),
        F.lit("\nDescription: "),
        _text("description"),
        F.lit("\nAmount: "),
        _dollars(),
        F.lit("\nMemo: "),
        _text("memo"),
    )


PROMPTS = {"vendor": vendor_prompt, "category": category_prompt, "analysis": analysis_prompt}


def request_key(kind: str) -> Column:
    """Hash of what a request depends on.  Amounts count to the cent."""
    parts = [F.lit(kind), _text("merchant"), _text("description")]
    if kind != "vendor":
        cents = F.col("amount").try_cast("decimal(38,2)").cast("string")
        parts.append(F.coalesce(cents, _text("amount")))
    return F.md5(F.concat_ws("|", *parts, _text("memo")))
