"""Sorting, stacking and key-set comparison."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sort(df: DataFrame, *cols) -> DataFrame:
    return df.orderBy(*cols)


def stack(dfs: Sequence[DataFrame]) -> DataFrame:
    """Rows of all frames; columns that a frame lacks are NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)


def split_by(df: DataFrame, column: str, values: Sequence) -> dict:
    """One filtered frame per value; they share the parent plan."""
    return {v: df.filter(F.col(column) == v) for v in values}


def distinct_rows(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.select(*cols).distinct()


def missing_keys(expected: DataFrame, df: DataFrame, on: Sequence[str]) -> DataFrame:
    """Expected keys that are absent."""
    return expected.select(*on).distinct().join(df, list(on), "left_anti")


def overlap(a: DataFrame, b: DataFrame, on: str) -> DataFrame:
    """Sizes of two key sets and of their intersection, as one row."""
    sides = (a.select(on, F.lit(1).alias("a"), F.lit(0).alias("b"))
             .unionAll(b.select(on, F.lit(0).alias("a"), F.lit(1).alias("b"))))
    keys = sides.groupBy(on).agg(F.max("a").alias("a"), F.max("b").alias("b"))
    both = F.sum(F.col("a") * F.col("b"))
    return keys.agg(F.sum("a").alias("n_left"), F.sum("b").alias("n_right"),
                    both.alias("n_both"),
                    F.round(F.try_divide(100 * both, F.sum("a")), 1).alias("pct_left"))
