"""Ratcliff-Obershelp similarity, for which SQL has no counterpart."""
from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, functions as F, types as T


@F.pandas_udf(T.DoubleType())
def _ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    from difflib import SequenceMatcher

    return pd.Series([None if x is None or y is None else SequenceMatcher(None, x.casefold(), y.casefold()).ratio() for x, y in zip(a, b)], dtype="float64")


def fuzzy_ratio(a: Column, b: Column) -> Column:
    return _ratio(a, b)


def may_reach(a: Column, b: Column, threshold: float) -> Column:
    """Whether the lengths alone allow the ratio: a cheap filter before fuzzy_ratio."""
    return 2 * F.least(F.length(a), F.length(b)) >= threshold * (F.length(a) + F.length(b))
