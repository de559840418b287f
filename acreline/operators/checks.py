"""Data-quality checks. Each returns the offending rows.

No check starts a job. With `strict=True` the returned frame has no rows, or fails the action that
runs it; `guarded` lets checks ride along with the write of the data they are about.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from acreline.functions.cleaning import null_sum
from acreline.operators.aggregates import median_by
from acreline.operators.windows import growth


def _report(bad: DataFrame, strict: bool, message: str) -> DataFrame:
    if not strict:
        return bad
    error = F.raise_error(F.lit(message)).cast("boolean")
    # One row is enough, and no filter is moved below a limit, where other rows would meet it.
    first = F.col(f"`{bad.columns[0]}`")
    return bad.limit(1).filter(F.when(first.isNull() | first.isNotNull(), error))


def guarded(df: DataFrame, checks: Mapping[str, DataFrame]) -> DataFrame:
    """`df`, whose evaluation fails with a check's name if that check has an offending row.

    Each check is asked for one row, within the action that writes or reads `df`. An empty `df` asks none.
    """
    out = df
    for name, bad in checks.items():
        found = bad.limit(1).agg(F.count(F.lit(1))).scalar()
        out = out.filter(F.when(found > 0, F.raise_error(F.lit(name)).cast("boolean")).otherwise(F.lit(True)))
    return out


def check_tie(a: DataFrame, b: DataFrame, on: Sequence[str], left: str, right: str,
              tol: float = 1000, strict: bool = False) -> DataFrame:
    """Totals that differ by the tolerance or more."""
    joined = a.join(b, list(on), "inner").withColumn("gap", F.col(left) - F.col(right))
    return _report(joined.filter(F.abs("gap") >= tol), strict, "totals do not tie")


def check_range(df: DataFrame, column: str, base: Column | str, lo: float, hi: float,
                strict: bool = False) -> DataFrame:
    """Values outside [lo, hi] times a positive base."""
    ratio = F.try_divide(F.col(column), F.col(base) if isinstance(base, str) else base)
    base_col = F.col(base) if isinstance(base, str) else base
    return _report(df.filter((base_col > 0) & ((ratio < lo) | (ratio > hi))),
                   strict, f"{column} is out of range")


def check_reported_pct(df: DataFrame, pct: str = "pct_change", check: str = "pct_change_chk",
                       tol: float = 0.005, strict: bool = False) -> DataFrame:
    return _report(df.filter(F.abs(F.col(pct) - F.col(check)) > tol), strict,
                   "reported and recomputed growth differ")


def check_unique(df: DataFrame, keys: Sequence[str], strict: bool = False) -> DataFrame:
    bad = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return _report(bad, strict, f"duplicate keys on {list(keys)}")


def check_swing(df: DataFrame, keys: Sequence[str], year: str, count: str,
                tol: float = 0.10, strict: bool = False) -> DataFrame:
    """Group-years whose size moved by more than the tolerance."""
    w = Window.partitionBy(*keys).orderBy(year)
    moved = df.withColumn("n_chg", growth(count, F.lag(count).over(w)))
    return _report(moved.filter(F.abs("n_chg") > tol), strict, "group sizes swing")


def check_mapped(df: DataFrame, table: DataFrame, column: str, strict: bool = False) -> DataFrame:
    """Distinct codes that the mapping does not know."""
    bad = df.select(column).distinct().join(table, column, "left_anti")
    return _report(bad, strict, f"unmapped codes in {column}")


def check_live(df: DataFrame, cols: Sequence[str], years: Sequence[int],
               year: str = "tax_yr", strict: bool = False) -> DataFrame:
    """Columns with no value at all in the given years; one pass over the data."""
    counts = df.filter(F.col(year).isin(*years)).agg(
        *[F.sum((F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))).cast("int"))
          .alias(c) for c in cols])
    long = counts.unpivot([], list(cols), "column", "n")
    bad = long.filter(F.coalesce("n", F.lit(0)) == 0).select("column")
    return _report(bad, strict, "columns without values in the forecast years")


def check_routing(df: DataFrame, scope: str = "nonspecialty", source: str = "rate_source",
                  spec: str = "spec_area", strict: bool = False) -> DataFrame:
    """Specialty entities that carry a geographic rate."""
    bad = df.filter((F.col(spec) > 0) & (F.col(source) == "geo_report"))
    if scope == "all":
        bad = bad.filter(F.lit(False))
    return _report(bad, strict, "specialty entities hold a geographic rate")


def check_year_cover(df: DataFrame, years: Sequence[int], year: str = "tax_yr",
                     strict: bool = False) -> DataFrame:
    """Expected years that do not have exactly one row."""
    found = df.groupBy(year).agg(F.count(F.lit(1)).alias("n"))
    spine = df.sparkSession.createDataFrame([(int(y),) for y in years], f"{year} int")
    counted = spine.join(found, year, "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return _report(counted.filter("n <> 1"), strict, "driver years are not covered once")


def check_code_table(table: DataFrame, lookup: DataFrame, code: str = "code",
                     label: str = "label", strict: bool = False) -> DataFrame:
    """Codes held by several labels, and codes the lookup does not list."""
    shared = (table.groupBy(code).agg(F.count_distinct(label).alias("n"))
              .filter("n > 1").select(code, F.lit("in several groups").alias("problem")))
    absent = (table.select(code).distinct().join(lookup, code, "left_anti")
              .select(code, F.lit("not in lookup").alias("problem")))
    return _report(shared.unionByName(absent), strict, "code table is inconsistent")


def check_median_range(df: DataFrame, column: str, lo: float = 5, hi: float = 25,
                       keys: Sequence[str] = (), strict: bool = False) -> DataFrame:
    medians = median_by(df, list(keys), column)
    return _report(medians.filter(~F.col("median").between(lo, hi)), strict,
                   f"median of {column} is out of range")


def check_base_values(df: DataFrame, entity: str, land: str, impr: str, total: str,
                      year: str = "tax_yr", start: int = 2027) -> DataFrame:
    """Entities by usable base before `start`: split, total only or none."""
    past = F.col(year) < start
    state = df.groupBy(entity).agg(
        F.count(F.when(past, null_sum(land, impr))).alias("n_split"),
        F.count(F.when(past & (F.col(total) > 0), F.col(total))).alias("n_total"))
    label = (F.when(F.col("n_split") > 0, "split").when(F.col("n_total") > 0, "total_only")
             .otherwise("none"))
    return state.groupBy(label.alias("base")).agg(F.count(F.lit(1)).alias("n_entities"))

