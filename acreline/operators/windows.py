"""Window operators over an entity's ordered rows.

A panel has one row per entity and year, so a window group is bounded by the
number of years. The carry and running operators also take a `chunk` expression
(see `acreline.operators.running`) for logs whose groups have no bound.
Row selectors use `row_number` with a total order and a filter on it; Spark
limits each group before the shuffle, so large groups do not travel.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from acreline.functions.cleaning import ColumnLike, col
from acreline.operators.aggregates import with_group
from acreline.operators.running import running


def _by(keys: str | Sequence[str], order) -> Window:
    keys = [keys] if isinstance(keys, str) else list(keys)
    order = [order] if isinstance(order, (str, Column)) else list(order)
    return Window.partitionBy(*keys).orderBy(*order)


def _keys(keys) -> list[str]:
    return [keys] if isinstance(keys, str) else list(keys)


# -- neighbours --------------------------------------------------------------

def lags(df: DataFrame, keys, order, cols: Sequence[str], ns: Sequence[int]) -> DataFrame:
    """Add `<col>_lag<n>` for each n; a negative n is a lead with 0 past the end."""
    w = _by(keys, order)
    out = {}
    for c in cols:
        for n in ns:
            if n > 0:
                out[f"{c}_lag{n}"] = F.lag(c, n).over(w)
            else:
                out[f"{c}_lead{-n}"] = F.lead(c, -n, 0).over(w)
    return df.withColumns(out)


def dlog(df: DataFrame, keys, order, value: str, out: str = "dlog") -> DataFrame:
    """Log change to the previous row; NULL unless both values are positive."""
    w = _by(keys, order)
    now, before = F.col(value).cast("double"), F.lag(F.col(value).cast("double")).over(w)
    return df.withColumn(out, F.when((now > 0) & (before > 0), F.ln(now) - F.ln(before)))


def growth(value: ColumnLike, before: ColumnLike) -> Column:
    return F.try_divide(col(value).cast("double"), col(before).cast("double")) - 1


def yoy(df: DataFrame, keys, order, value: str, out: str = "yoy") -> DataFrame:
    """Growth to the previous row."""
    return df.withColumn(out, growth(value, F.lag(value).over(_by(keys, order))))


def matched_lag(df: DataFrame, keys, year: str, value: str) -> DataFrame:
    """Rows whose previous row is exactly one year earlier, with its value."""
    w = _by(keys, year)
    lagged = df.withColumns({f"{value}_lag": F.lag(value).over(w),
                             "_gap": F.col(year) - F.lag(year).over(w)})
    return lagged.filter("_gap = 1").drop("_gap")


# -- carries and running values ----------------------------------------------

def locf(df: DataFrame, keys, order, cols: Sequence[str], chunk: Column | None = None) -> DataFrame:
    """Carry the last known value forward."""
    return running(df, _keys(keys), order, {c: ("last", c) for c in cols}, chunk)


def fill_both(df: DataFrame, keys, order, cols: Sequence[str]) -> DataFrame:
    """Carry forward, then backward into the leading gap."""
    w = _by(keys, order)
    back = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ahead = w.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    return df.withColumns({
        c: F.coalesce(F.last(c, ignorenulls=True).over(back),
                      F.first(c, ignorenulls=True).over(ahead)) for c in cols})


def rolling_sum(df: DataFrame, keys, order, spec: Mapping[str, tuple[str, int]]) -> DataFrame:
    """`spec` = {out: (column, k)}: sum over up to k rows ending here."""
    w = _by(keys, order)
    return df.withColumns({out: F.sum(c).over(w.rowsBetween(1 - k, 0))
                           for out, (c, k) in spec.items()})


def rolling_mean(df: DataFrame, keys, order, spec: Mapping[str, tuple[str, int]]) -> DataFrame:
    """Mean over exactly k rows; NULL before k rows exist, NULL values skipped."""
    w = _by(keys, order)
    out = {}
    for name, (c, k) in spec.items():
        frame = w.rowsBetween(1 - k, 0)
        out[name] = F.when(F.count(F.lit(1)).over(frame) >= k, F.avg(c).over(frame))
    return df.withColumns(out)


def years_since(df: DataFrame, keys, year: str, flag: str, out: str = "years_since",
                chunk: Column | None = None) -> DataFrame:
    """Years since the flag was last 1; NULL before the first time."""
    seen = running(df, _keys(keys), year,
                   {"_last": ("last", F.when(F.col(flag) == 1, F.col(year)))}, chunk)
    return seen.withColumn(out, F.col(year) - F.col("_last")).drop("_last")


def cum_sum(df: DataFrame, keys, order, value: ColumnLike, out: str = "cum",
            chunk: Column | None = None) -> DataFrame:
    return running(df, _keys(keys), order, {out: ("sum", value)}, chunk)


def cum_prod(df: DataFrame, keys, order, value: ColumnLike, out: str = "cum",
             chunk: Column | None = None) -> DataFrame:
    """Running product; NULL from the first NULL factor on."""
    scanned = running(df, _keys(keys), order,
                      {out: ("product", value),
                       "_null": ("max", col(value).isNull().cast("int"))}, chunk)
    return scanned.withColumn(out, F.when(F.col("_null") == 0, F.col(out))).drop("_null")


def lagged_sum(df: DataFrame, keys, order, value: str, lags_: Sequence[int] = (2, 3, 4, 5),
               at: Column | None = None, out: str = "lagged_sum") -> DataFrame:
    """Sum of the listed lags, NULL if one is missing, kept at the rows `at`."""
    w = _by(keys, order)
    total = None
    for n in lags_:
        part = F.lag(value, n).over(w)
        total = part if total is None else total + part
    summed = df.withColumn(out, total)
    return summed if at is None else summed.filter(at)


# -- row selection -----------------------------------------------------------

def top_n(df: DataFrame, keys, order, n: int) -> DataFrame:
    """First n rows per group by `order`, which must be total."""
    return (df.withColumn("_rank", F.row_number().over(_by(keys, order)))
            .filter(F.col("_rank") <= n).drop("_rank"))


def first_row(df: DataFrame, keys, order) -> DataFrame:
    return top_n(df, keys, order, 1)


def last_row(df: DataFrame, keys, order: Sequence[str]) -> DataFrame:
    """Last row per group; NULLs sort first, so a known value wins."""
    order = [order] if isinstance(order, str) else order
    return top_n(df, keys, [F.desc(c) for c in order], 1)


def latest(df: DataFrame, keys, order: Sequence[str]) -> DataFrame:
    """Latest row per key by `order` (the version column first, then tie-breaks)."""
    return last_row(df, keys, order)


def rows_at_min(df: DataFrame, keys, c: str) -> DataFrame:
    """Rows that hold their group's minimum; ties stay."""
    return (with_group(df, keys, {"_min": F.min(c)})
            .filter(F.col(c) == F.col("_min")).drop("_min"))


def rank_in(c: ColumnLike, order: Sequence[str]) -> Column:
    """1-based position of a label in a list; NULL if absent."""
    at = F.array_position(F.array(*[F.lit(x) for x in order]), col(c))
    return F.when(at > 0, at.cast("int"))
