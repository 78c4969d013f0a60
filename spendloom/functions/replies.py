"""Reading the reply of a model: the JSON object inside a text, with defaults."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from spendloom.functions import fixed
from spendloom.functions.text import NUMBER, strip
from spendloom.functions.variants import fields_of, let, strict_json, text_of


def vendor_reply(reply: Column) -> Column:
    """The trimmed reply; a request that failed gives the unknown vendor."""
    return F.coalesce(strip(reply), F.lit(fixed.UNKNOWN_VENDOR))


def category_reply(reply: Column) -> Column:
    """``struct(category, confidence)`` of a reply text."""
    return _record(reply, {"category": fixed.OTHER_CATEGORY})


def analysis_reply(reply: Column) -> Column:
    """The full analysis record of a reply text."""
    return _record(
        reply,
        {
            "vendor": fixed.UNKNOWN_VENDOR,
            "category": fixed.OTHER_CATEGORY,
            "business_impact": fixed.DEFAULT_IMPACT,
            "risk_level": fixed.LOW_RISK,
            "recommendation": "",
        },
    )


def _record(reply: Column, defaults: dict[str, str]) -> Column:
    """Absent fields get their default.

    A reply without a JSON object, or with a confidence that is no number, is
    replaced as a whole: all defaults, confidence 0.
    """
    # From the first opening to the last closing brace.
    found = F.nullif(F.regexp_extract(reply, r"(?s)\{.*\}", 0), F.lit(""))
    nothing = F.struct(
        *[F.lit(v).alias(k) for k, v in defaults.items()], F.lit(0.0).alias("confidence")
    )

    def read(fields: Column) -> Column:
        confidence = _confidence(fields)
        values = [
            F.when(F.map_contains_key(fields, k), text_of(fields[k])).otherwise(v).alias(k)
            for k, v in defaults.items()
        ]
        return F.when(confidence.isNotNull(), F.struct(*values, confidence.alias("confidence")))

    return F.coalesce(let(fields_of(strict_json(found)), read), nothing)


def _confidence(fields: Column) -> Column:
    """The number, 0 where the field is absent, null where it is no number."""
    value = fields["confidence"]
    text = text_of(value)
    number = (
        F.when(F.schema_of_variant(value) == "BOOLEAN", F.try_variant_get(value, "$", "double"))
        .when(text.rlike(NUMBER), text.try_cast("double"))
    )
    return F.when(F.map_contains_key(fields, "confidence"), number).when(
        fields.isNotNull(), F.lit(0.0)
    )
