"""Text and money expressions, all evaluated inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spendloom.functions.fixed import WHITE_SPACE

# Digits with an optional point, sign and exponent.  Needed because a cast
# alone also accepts '1f', '0x1p3' and 'Infinity'.
NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def strip(text: Column) -> Column:
    """Remove white space of any kind, not only blanks, from both ends."""
    return F.btrim(text, F.lit(WHITE_SPACE))


def money(value: Column, data_type: T.DataType) -> Column:
    """A double that is never null: bad, missing or infinite amounts become 0."""
    if isinstance(data_type, T.NumericType):
        number = value.cast("double")
    else:
        plain = F.translate(value.cast("string"), "$,", "")
        number = F.when(plain.rlike(NUMBER), plain.try_cast("double"))
    return F.when(is_finite(number), number).otherwise(F.lit(0.0))


def is_finite(number: Column) -> Column:
    """False for null, NaN and both infinities."""
    return F.coalesce(F.abs(number) < F.lit(float("inf")), F.lit(False))


def compare_name(merchant: Column) -> Column:
    """The form in which two merchants are compared; a null reads 'none'."""
    return F.lower(F.coalesce(merchant, F.lit("None")))
