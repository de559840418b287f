"""Matched growth, chained series, stocks and scenario reports.

Everything after the first aggregate has one row per group and year. Recursions
over years are written as running products and sums, which give the same numbers
as the loop without one.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from acreline.functions.cleaning import coalesce_present, null_sum
from acreline.operators.aggregates import pivot_wide, share
from acreline.operators.sets import stack
from acreline.operators.windows import growth, matched_lag

KEY, YEAR = "parcel_id", "tax_yr"


def matched_growth(df: DataFrame, entity: str, year: str, value: str,
                   keys: Sequence[str] = ()) -> DataFrame:
    """Growth of entities with a positive value in a year and in the year before.

    `df` has one row per entity and year. Entities that enter or leave do not
    move the rate.
    """
    pairs = matched_lag(df.filter(F.col(value) > 0), entity, year, value)
    sums = pairs.groupBy(*keys, year).agg(
        F.sum(value).alias("num"), F.sum(f"{value}_lag").alias("den"),
        F.count(F.lit(1)).alias("n_matched"))
    return sums.withColumn("gyy", growth("num", "den"))


def chain_back(growth_: DataFrame, anchor: DataFrame, keys: Sequence[str], year: str = YEAR,
               g: str = "gyy", value: str = "av", anchor_year: str = "anchor_yr") -> DataFrame:
    """Series before an anchor year: the anchor over the product of later growth.

    A missing rate or year leaves all earlier years NULL.
    """
    rows = (growth_.select(*keys, year, g).join(anchor, list(keys), "inner")
            .filter(F.col(year) <= F.col(anchor_year)))
    w = Window.partitionBy(*keys).orderBy(F.desc(year))
    later = w.rowsBetween(Window.unboundedPreceding, -1)
    factor = F.when(F.col(g) != -1, 1 + F.col(g).cast("double"))
    known = F.count(factor).over(later)
    gap = F.col(anchor_year) - F.col(year)
    chained = F.col(value).cast("double") / F.product(factor).over(later)
    return rows.withColumn("_known", known).withColumn("_chained", chained).select(
        *keys, year,
        F.when(gap == 0, F.col(value).cast("double"))
        .when(F.col("_known") == gap, F.col("_chained")).alias(value))


def certified_split(anchors: DataFrame, appraised: DataFrame) -> DataFrame:
    """Real base by track at appraised shares; personal property as its own track."""
    tracks = appraised.join(anchors, YEAR, "left").select(
        YEAR, "track", (F.col("cert_real") * F.col("share")).alias("cert_av"))
    personal = anchors.select(YEAR, F.lit("pp").alias("track"),
                              F.col("pp_av").cast("double").alias("cert_av"))
    return tracks.unionByName(personal)


def split_by_share(raw: DataFrame, anchor: DataFrame, year: str, group: str, value: str,
                   anchor_value: str, out: str = "av") -> DataFrame:
    """Spread a yearly anchor over groups by their raw shares."""
    return (share(raw, year, value, small_groups=True).join(anchor, year, "inner")
            .select(year, group, (F.col("share") * F.col(anchor_value).cast("double")).alias(out)))


def cagr(first: Column, last: Column, n: int) -> Column:
    return F.pow(last.cast("double") / first.cast("double"), F.lit(1.0 / n)) - 1


def cagr_backcast(anchors: DataFrame, keys: Sequence[str], value: str, first: int, last: int,
                  lo: int, year: str = YEAR) -> DataFrame:
    """Years lo..first-1 from the value at `first` and the growth first..last."""
    at = lambda y: F.max(F.when(F.col(year) == y, F.col(value).cast("double")))
    ends = anchors.groupBy(*keys).agg(at(first).alias("_first"), at(last).alias("_last"))
    rate = cagr(F.col("_first"), F.col("_last"), last - first)
    return (ends.withColumn("_rate", rate)
            .withColumn(year, F.explode(F.sequence(F.lit(lo), F.lit(first - 1))))
            .select(*keys, year, (F.col("_first") / F.pow(1 + F.col("_rate"),
                                                          F.lit(first) - F.col(year))).alias(value)))


def driver_growth(drivers: DataFrame, driver: str, years: Sequence[int], fallback: float,
                  elasticity: float = 1.0, keys: Sequence[str] = ("scenario",),
                  year: str = YEAR) -> DataFrame:
    """Elasticity times driver growth; the fall-back unless all years are covered."""
    mean = (drivers.filter(F.col(driver).isNotNull()).groupBy(*keys, year)
            .agg(F.avg(driver).alias("v")))
    w = Window.partitionBy(*keys).orderBy(year)
    grown = (mean.withColumn("g", growth("v", F.lag("v").over(w)))
             .filter(F.col(year).isin(*years) & F.col("g").isNotNull()))
    spine = F.array(*[F.lit(int(y)) for y in years])
    wanted = drivers.select(*keys).distinct().withColumn(year, F.explode(spine))
    covered = grown.groupBy(*keys).agg((F.count(F.lit(1)) >= len(years)).alias("_all"))
    return (wanted.join(grown.select(*keys, year, "g"), [*keys, year], "left")
            .join(covered, list(keys), "left")
            .select(*keys, year, F.when(F.col("_all"), F.lit(float(elasticity)) * F.col("g"))
                    .otherwise(F.lit(float(fallback))).alias("gyy")))


def compound(base: DataFrame, rates: DataFrame, keys: Sequence[str], base_year: int,
             last_year: int, value: str = "cert_av", scenario: str = "scenario",
             year: str = YEAR, g: str = "gyy") -> DataFrame:
    """Base values compounded forward per scenario; a missing rate is 0."""
    # One row per key and scenario with its yearly factors, so rates are read once.
    rate_in = lambda y: F.coalesce(F.max(F.when(F.col(year) == y, F.col(g))), F.lit(0.0))
    path = F.array(F.struct(F.lit(base_year).alias(year), F.lit(1.0).alias("_step")),
                   *[F.struct(F.lit(y).alias(year), (1 + rate_in(y)).alias("_step"))
                     for y in range(base_year + 1, last_year + 1)])
    grid = (rates.groupBy(*keys, scenario).agg(path.alias("_path")).join(base, list(keys), "inner")
            .select(*keys, scenario, value, F.inline("_path")))
    w = (Window.partitionBy(*keys, scenario).orderBy(year)
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return grid.select(*keys, scenario, year,
                       (F.col(value).cast("double") * F.product("_step").over(w)).alias(value))


def stock_flow(df: DataFrame, keys: Sequence[str], flow: str, g: str, year: str = YEAR,
               out: str = "stock") -> DataFrame:
    """Stock that grows each year and takes in a flow: S = S_before (1 + g) + flow.

    Closed form: with P the running product of 1 + g, S = P * sum(flow / P). A
    factor of 0 empties the stock, so each such year starts a new segment.
    """
    factor = 1 + F.coalesce(F.col(g).cast("double"), F.lit(0.0))
    inflow = F.coalesce(F.col(flow).cast("double"), F.lit(0.0))
    order = Window.partitionBy(*keys).orderBy(year)
    to_here = (Window.unboundedPreceding, Window.currentRow)
    tagged = df.withColumns({"_factor": factor, "_flow": inflow})
    tagged = tagged.withColumn("_segment", F.sum((F.col("_factor") == 0).cast("int"))
                               .over(order.rowsBetween(*to_here)))
    within = Window.partitionBy(*keys, "_segment").orderBy(year)
    step = F.when(F.row_number().over(within) == 1, F.lit(1.0)).otherwise(F.col("_factor"))
    tagged = tagged.withColumn("_step", step)
    tagged = tagged.withColumn("_p", F.product("_step").over(within.rowsBetween(*to_here)))
    stock = F.col("_p") * F.sum(F.col("_flow") / F.col("_p")).over(within.rowsBetween(*to_here))
    return tagged.withColumn(out, stock).drop("_factor", "_flow", "_segment", "_step", "_p")


def series(parts: Sequence[DataFrame], group: str = "group", year: str = YEAR,
           value: str = "av") -> DataFrame:
    """Stacked history and forecast with growth per group; one row per group-year."""
    w = Window.partitionBy(group).orderBy(year)
    long = stack(parts)
    return long.withColumn("yoy", growth(value, F.lag(value).over(w)))


def series_wide(long: DataFrame, groups: Sequence[str], group: str = "group", year: str = YEAR,
                value: str = "av") -> DataFrame:
    return pivot_wide(long, year, group, value, groups)


def row_value(df: DataFrame) -> Column:
    """Land plus improvements: observed, then filled, then predicted, then totals."""
    land = coalesce_present(df, ["appr_land_val", "appr_land_val_filled", "pred_appr_land_val"])
    impr = coalesce_present(df, ["appr_imps_val", "appr_imps_val_filled", "pred_appr_imps_val"])
    return F.coalesce(null_sum(land, impr),
                      coalesce_present(df, ["pred_total_assessed"]),
                      coalesce_present(df, ["total_assessed"]))


def scenario_summary(df: DataFrame, value: str, scenarios: Sequence[str] = (
        "baseline", "optimistic", "pessimistic"), year: str = YEAR) -> DataFrame:
    """Total per year and scenario, with differences to the baseline."""
    wide = pivot_wide(df, year, "scenario", value, scenarios)
    diffs = {f"diff_{s}_vs_baseline": F.col(s) - F.col("baseline")
             for s in scenarios if s != "baseline"}
    return wide.withColumns(diffs)


def trajectory(df: DataFrame, by: Sequence[str], entity: str, value: str,
               year: str = YEAR) -> DataFrame:
    """Value, entities, missing values and growth per year, with the year's share."""
    sums = df.groupBy(*by, year).agg(
        F.coalesce(F.sum(value), F.lit(0)).alias("total"),
        F.count_distinct(entity).alias("n_entities"),
        F.sum(F.col(value).isNull().cast("int")).alias("n_missing"))
    w = Window.partitionBy(*by).orderBy(year)
    grown = sums.withColumn("yoy_pct", 100 * growth("total", F.lag("total").over(w)))
    return share(grown, year, "total", "year_share", small_groups=True)


def grand_total(tracks: DataFrame, certified: Mapping[int, float], year: str = YEAR,
                value: str = "total") -> DataFrame:
    """Sum of all tracks per year, growth, and the gap to the certified total."""
    total = tracks.groupBy(year).agg(F.sum(value).alias("grand"))
    cert = F.lit(None).cast("double")
    for y, v in certified.items():
        cert = F.when(F.col(year) == y, F.lit(float(v))).otherwise(cert)
    # One row per year.
    w = Window.orderBy(year)
    return total.withColumns({"yoy": growth("grand", F.lag("grand").over(w)),
                              "gap": F.col("grand").cast("double") - cert})
