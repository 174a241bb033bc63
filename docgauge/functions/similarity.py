"""Sequence similarity that built-in functions cannot express: one vectorised UDF around the standard library."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


@F.pandas_udf(DoubleType())
def _ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)], dtype="float64")


def sequence_ratio(a: Column, b: Column) -> Column:
    """Ratcliff-Obershelp ratio of two strings, with the library's junk rule for long texts; null for a null side."""
    return _ratio(a, b)
