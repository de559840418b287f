"""Market, macro and construction series: periods to tax years.

A series has one row per period and submarket, so after the first aggregate these
tables are small and their windows run over a bounded number of periods.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from acreline.functions.cleaning import (ColumnLike, col, parse_period, slug,
                                         to_num)
from acreline.functions.codes import MACRO_PREDICTORS, REALIZATION_RATE
from acreline.operators.aggregates import pivot_wide, sum0
from acreline.operators.windows import growth, lagged_sum, lags, rolling_mean

SCENARIOS = ("baseline", "optimistic", "pessimistic")


def annualize(df: DataFrame, keys: Sequence[str], year: str, period: str,
              stock: Sequence[str], flow: Sequence[str], n: int = 4) -> DataFrame:
    """Quarters (n=4) or months (n=12) to tax years.

    Stocks are the first period's value. Flows are the sum of the n periods that
    end with the first period of the year, only when all n are present.
    """
    tax_yr = F.when(F.col(period) == 1, F.col(year)).otherwise(F.col(year) + 1)
    first = F.col(period) == 1
    aggs = [F.max(F.when(first, F.col(c))).alias(c) for c in stock]
    full = F.count(F.lit(1)) == n
    aggs += [F.when(full, sum0(c)).alias(c) for c in flow]
    # A year without its first period has no row; its flow belongs to no snapshot.
    return (df.withColumn("tax_yr", tax_yr).groupBy(*keys, "tax_yr")
            .agg(*aggs, F.max(first.cast("int")).alias("_has_first"))
            .filter("_has_first = 1").drop("_has_first"))


def rename_series(df: DataFrame, var_map: Mapping[str, str], period: str = "Period",
                  geography: str = "Geography Name", strip: str = "") -> DataFrame:
    """Quarterly market export: year, quarter, submarket and renamed numbers."""
    start = parse_period(f"`{period}`")
    present = [c for c in var_map if c in df.columns]
    if not present:
        raise ValueError("none of the expected columns is present")
    place = F.col(f"`{geography}`")
    return (df.withColumn("_start", start).filter(F.col("_start").isNotNull())
            .select(F.year("_start").alias("year"), F.quarter("_start").alias("qtr"),
                    (F.regexp_replace(place, strip, "") if strip else place).alias("submarket"),
                    *[to_num(f"`{c}`").alias(var_map[c]) for c in present]))


def waterfall(cols: Sequence[ColumnLike], labels: Sequence[str]) -> tuple[Column, Column]:
    """First known value and the label of where it came from."""
    label = None
    for c, name in zip(cols, labels):
        known = col(c).isNotNull()
        label = F.when(known, name) if label is None else label.when(known, name)
    return F.coalesce(*[col(c) for c in cols]), label


def december_snapshot(df: DataFrame, cols: Sequence[str], date: str = "date",
                      keys: Sequence[str] = (), spans: Sequence[int] = (6, 12),
                      year_lags: Sequence[int] = (), delta: bool = False) -> DataFrame:
    """Rolling monthly means taken in December for the next tax year.

    `year_lags` adds the values of earlier tax years and `delta` the change to
    the tax year before.
    """
    spec = {f"{c}_lag{k}": (c, k) for c in cols for k in spans}
    rolled = rolling_mean(df, list(keys), date, spec)
    out = rolled.filter(F.month(date) == 12).select(
        *keys, (F.year(date) + 1).alias("tax_yr"), *spec)
    w = Window.partitionBy(*keys).orderBy("tax_yr")
    more = {f"{c}_y{n}": F.lag(c, n).over(w) for c in spec for n in year_lags}
    if delta:
        more |= {f"{c}_delta": F.col(c) - F.lag(c).over(w) for c in spec}
    return out.withColumns(more)


def macro_panel(levels: DataFrame, deltas: DataFrame, names: Sequence[str],
                keep: Sequence[str] | None = MACRO_PREDICTORS, prefix: str = "econ") -> DataFrame:
    """One wide row per year from long level and growth blocks.

    Both blocks have `var`, `tax_yr` and a value (`lvl` / `delta`); `names` lists
    the variables' slugs, so no pass over the data is needed to find the columns.
    Level columns get two lags and growth columns one; `keep=None` keeps all.
    """
    def block(df, value, suffix):
        named = df.withColumn("_name", F.concat(F.lit(f"{prefix}_"), slug("var"),
                                                F.lit(f"_{suffix}")))
        return pivot_wide(named, "tax_yr", "_name", value,
                          [f"{prefix}_{s}_{suffix}" for s in names])

    wide = block(levels, "lvl", "lvl").join(block(deltas, "delta", "yoy"), "tax_yr", "left")
    lagged = lags(wide, [], "tax_yr", [c for c in wide.columns if c.endswith("_lvl")], (1, 2))
    lagged = lags(lagged, [], "tax_yr", [c for c in wide.columns if c.endswith("_yoy")], (1,))
    if keep is None:
        return lagged
    return lagged.select("tax_yr", *[c for c in keep if c in lagged.columns])


def scenario_value(df: DataFrame, scenario: str | None = None,
                   scenarios: Sequence[str] = SCENARIOS, value: str = "value") -> DataFrame:
    """Scenario columns to a `scenario` column, filtered to one if asked."""
    ids = [c for c in df.columns if c not in scenarios]
    long = df.unpivot(ids, list(scenarios), "scenario", value)
    return long if scenario is None else long.filter(F.col("scenario") == scenario)


def complete_scenarios(q: DataFrame) -> DataFrame:
    """Actual quarters have no scenario levels: both take the baseline.

    A quarter is a forecast when its pessimistic level is present.
    """
    forecast = F.col("pessimistic").isNotNull()
    return q.withColumns({
        "optimistic": F.when(forecast, F.col("optimistic")).otherwise(F.col("baseline")),
        "pessimistic": F.coalesce("pessimistic", "baseline")})


def construction_features(q: DataFrame, scenario: str | None = None) -> DataFrame:
    """Annual construction level, six-quarter-lagged sum, growth and lags.

    `q` has `yr`, `qn` and one column per scenario; the result has one row per
    scenario and year.
    """
    values = scenario_value(complete_scenarios(q), scenario)
    lag6 = (lagged_sum(values, "scenario", ["yr", "qn"], "value", at=F.col("qn") == 1)
            .filter(F.col("lagged_sum").isNotNull())
            .select("scenario", F.col("yr").alias("tax_yr"),
                    F.col("lagged_sum").alias("con_sales_lag6q_4q")))
    annual = (values.groupBy("scenario", F.col("yr").alias("tax_yr"))
              .agg(sum0("value").alias("con_sales_lvl"), F.count(F.lit(1)).alias("n"))
              .filter("n = 4").drop("n"))
    con = annual.join(lag6, ["scenario", "tax_yr"], "full_outer")
    w = Window.partitionBy("scenario").orderBy("tax_yr")
    con = con.withColumns({
        "con_sales_yoy": growth("con_sales_lvl", F.lag("con_sales_lvl").over(w)),
        "con_sales_lag6q_yoy": growth("con_sales_lag6q_4q", F.lag("con_sales_lag6q_4q").over(w)),
        "con_sales_lvl_lag1": F.lag("con_sales_lvl", 1).over(w),
        "con_sales_lvl_lag2": F.lag("con_sales_lvl", 2).over(w)})
    return con.withColumn("con_sales_yoy_lag1", F.lag("con_sales_yoy").over(w))


def index_growth(df: DataFrame, group: str, year: str, period: str, value: str,
                 how: str = "mean", from_year: int | None = None) -> DataFrame:
    """First-period level per year and its growth, per group."""
    first = df.filter(F.col(period) == 1)
    if from_year is not None:
        first = first.filter(F.col(year) >= from_year)
    level = F.avg(value) if how == "mean" else sum0(value)
    by_year = first.groupBy(group, year).agg(level.alias("lvl"))
    w = Window.partitionBy(group).orderBy(year)
    return by_year.withColumn("gyy", growth("lvl", F.lag("lvl").over(w)))


def new_construction(q: DataFrame, certified: Mapping[int, float],
                     rate: float = REALIZATION_RATE, unit: float = 1e6) -> DataFrame:
    """New-construction value per scenario and tax year.

    Lagged sums give growth multiples that re-level the last certified year;
    certified years are kept as they are.
    """
    base_year = max(certified)
    values = scenario_value(complete_scenarios(q))
    raw = (lagged_sum(values, "scenario", ["yr", "qn"], "value", at=F.col("qn") == 1)
           .filter(F.col("lagged_sum").isNotNull())
           .select("scenario", F.col("yr").alias("tax_yr"),
                   (F.col("lagged_sum") * rate * unit).alias("raw")))
    w = Window.partitionBy("scenario").orderBy("tax_yr")
    to_here = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    factor = (raw.filter(F.col("tax_yr") >= base_year)
              .withColumn("mult", F.when(F.col("tax_yr") > base_year,
                                         F.try_divide("raw", F.lag("raw").over(w)))
                          .otherwise(F.lit(1.0)))
              .withColumn("broken", F.max(F.col("mult").isNull().cast("int")).over(to_here))
              .withColumn("factor", F.when(F.col("broken") == 0,
                                           F.product("mult").over(to_here))))
    forecast = factor.filter(F.col("tax_yr") > base_year).select(
        "scenario", "tax_yr", (F.lit(float(certified[base_year])) * F.col("factor")).alias("value"))
    spark = q.sparkSession
    known = spark.createDataFrame(
        [(s, y, float(v)) for s in SCENARIOS for y, v in certified.items()],
        "scenario string, tax_yr int, value double")
    return known.unionByName(forecast)
