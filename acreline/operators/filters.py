"""Row and column filters."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def filter_codes(df: DataFrame, column: str, values: Sequence, keep: bool = True) -> DataFrame:
    """Keep or drop listed codes. Dropping keeps NULL codes."""
    listed = F.col(column).isin(*values)
    return df.filter(listed if keep else (~listed | F.col(column).isNull()))


def filter_years(df: DataFrame, lo: int, hi: int, year: str = "tax_yr") -> DataFrame:
    return df.filter(F.col(year).between(lo, hi))


def drop_null(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.na.drop(subset=list(cols))


def drop_like(df: DataFrame, regex: str) -> DataFrame:
    return df.drop(*[c for c in df.columns if re.search(regex, c)])


def filter_rlike(df: DataFrame, column: str, regex: str) -> DataFrame:
    return df.filter(F.col(column).rlike(regex))
