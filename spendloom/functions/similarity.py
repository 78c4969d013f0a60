"""Ratcliff/Obershelp similarity, the one measure Spark has no expression for."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def similarity(first: Column | str, second: Column | str) -> Column:
    """``2 * matched / total`` of two lower-cased texts, in the given order.

    The measure is not symmetric, so pass the earlier row first.  A pair that
    occurs again in the same task is looked up, not computed again.
    """
    return _udf()(first, second)


def _udf():
    # Everything the workers need is inside, so they need not have this package.
    from difflib import SequenceMatcher

    seen: dict[tuple[str, str], float] = {}

    def ratio(first: str, second: str) -> float:
        if first == second:
            return 1.0
        pair = (first, second)
        # A name inside the other is matched as a whole; from 200 letters on, frequent ones do not count.
        if len(second) < 200 and (first in second or second in first):
            return 2.0 * min(len(first), len(second)) / (len(first) + len(second))
        if len(first) + len(second) > 400:  # only short names are remembered
            return SequenceMatcher(None, first, second).ratio()
        if pair not in seen:
            if len(seen) >= 50_000:
                seen.clear()
            seen[pair] = SequenceMatcher(None, first, second).ratio()
        return seen[pair]

    def ratios(first: pd.Series, second: pd.Series) -> pd.Series:
        return pd.Series([ratio(a, b) for a, b in zip(first, second)], dtype="float64")

    # Spark would otherwise copy the call into a filter on it and run it twice.
    return F.pandas_udf(ratios, T.DoubleType()).asNondeterministic()
