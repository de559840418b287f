"""Rate routing and forecasts.

The sequential forecast is a recursion over a handful of years. Instead of a join
per year on a growing lineage, each entity's years are folded into one wide row
with a single shuffle; the years are then steps of column expressions and model
transforms on that row, and the result is exploded back. Growth-only paths have
closed forms over windows.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from acreline.functions import codes
from acreline.functions.cleaning import clamp, log_pos, null_sum, to_int
from acreline.functions.labels import code_label, first_match
from acreline.operators.aggregates import median_by, sum0, weighted_mean
from acreline.operators.joins import lookup_join
from acreline.operators.windows import dlog, first_row, growth

KEY, YEAR = "parcel_id", "tax_yr"
Scorer = Callable[[DataFrame, str], DataFrame]


@dataclass(frozen=True)
class ForecastOptions:
    """Policies of the sequential forecast.

    `track` picks the published rates: "com" routes specialty and geographic
    rates, "res" takes the residential area rate.
    """

    track: str = "com"                   # or "res"
    geo_scope: str = "nonspecialty"      # or "all"
    specialty_policy: str = "model"      # or "hold", "prior"
    land_only_gate: bool = True
    cap: float | None | str = "track"    # commercial changes are capped; or a number, or None

    @property
    def max_change(self) -> float | None:
        if self.cap == "track":
            return codes.MAX_LOG_CHANGE if self.track == "com" else None
        return self.cap


# -- published rates ---------------------------------------------------------

def _one_rate(rates: DataFrame, keys: Sequence[str], out: str) -> DataFrame:
    """One log rate per key; repeated keys keep the first file's."""
    usable = rates.filter((F.col("pct_change") > -1) & F.col(keys[0]).isNotNull())
    return first_row(usable, list(keys), ["source_file", "pct_change"]).select(
        *keys, F.log1p("pct_change").alias(out))


def rate_paths(rates: DataFrame, key: str, out: str, year: str = YEAR) -> DataFrame:
    """(key, out): an area's published log rates as an array of (year, rate), by year."""
    return (_one_rate(rates, [key, year], "rate").groupBy(key)
            .agg(F.array_sort(F.collect_list(F.struct(F.col(year).alias("year"), "rate"))).alias(out)))


def rate_in(path: str, year: Column) -> Column:
    """The rate of the year itself."""
    return F.get(F.filter(path, lambda x: x["year"] == year), F.lit(0))["rate"]


def rate_before(path: str, year: Column) -> Column:
    """The rate of the latest year before."""
    earlier = F.filter(path, lambda x: x["year"] < year)
    return F.get(earlier, F.size(earlier) - 1)["rate"]


def route_rates(df: DataFrame, rates: DataFrame, options: ForecastOptions = ForecastOptions(),
                last_year: int | None = None, year: str = YEAR) -> DataFrame:
    """Add `dlog_actual` and `rate_source` from published rates.

    Specialty rates come first; geographic ones apply to the others only, unless
    the scope is "all". Specialty entities without a rate follow the policy. A
    report for assessment year A moves tax year A to A + 1. Every area's rates are one array
    over the years, looked up by area; the panel is not dealt by area or year.
    """
    if options.specialty_policy not in ("model", "hold", "prior"):
        raise ValueError(f"unknown specialty policy {options.specialty_policy!r}")
    population = (rates.filter(F.col("basis") == "population")
                  .withColumn(year, F.col("assessment_yr") + 1))
    spec = population.filter(F.col("report_kind") == "specialty")
    geo = population.filter((F.col("report_kind") == "geo") & (F.col("prop_type") == "com"))
    out = lookup_join(df.withColumn("_area", to_int("area")), rate_paths(spec, "spec_area", "_spec", year), "spec_area")
    out = lookup_join(out, rate_paths(geo.withColumnRenamed("area", "_area"), "_area", "_geo", year), "_area")
    is_spec = F.coalesce(F.col("spec_area") > 0, F.lit(False))
    geo_ok = F.lit(True) if options.geo_scope == "all" else ~is_spec
    rules = [(rate_in("_spec", F.col(year)), "specialty_report"),
             (F.when(geo_ok, rate_in("_geo", F.col(year))), "geo_report")]
    if options.specialty_policy == "hold":
        rules.append((F.when(is_spec, F.lit(0.0)), "specialty_hold_flat"))
    elif options.specialty_policy == "prior":
        rules.append((F.when(is_spec & (F.lit(True) if last_year is None else F.col(year) <= last_year),
                             rate_before("_spec", F.col(year))), "specialty_prior_year"))
    return out.select(
        *df.columns, F.coalesce(*[r for r, _ in rules]).alias("dlog_actual"),
        first_match([(r.isNotNull(), s) for r, s in rules]).alias("rate_source"))


def area_anchor(df: DataFrame, rates: DataFrame, year: str = YEAR) -> DataFrame:
    """Residential area rate (population basis) as a log change."""
    res = (rates.filter((F.col("prop_type") == "res") & (F.col("basis") == "population"))
           .withColumn(year, F.col("assessment_yr") + 1).withColumnRenamed("area", "_area"))
    paths = rate_paths(res, "_area", "_path", year)
    return (lookup_join(df.withColumn("_area", to_int("area")), paths, "_area")
            .select(*df.columns, rate_in("_path", F.col(year)).alias("dlog_actual")))


def rate_coverage(df: DataFrame, prior_value: str, year: str = YEAR) -> DataFrame:
    """Entities and prior value per year, specialty flag and rate source."""
    return df.groupBy(
        year, F.coalesce(F.col("spec_area") > 0, F.lit(False)).alias("is_specialty"),
        F.coalesce("rate_source", F.lit("model")).alias("rate_source")).agg(
        F.count(F.lit(1)).alias("n_entities"), sum0(prior_value).alias("prior_value"))


# -- gates and fall-backs ----------------------------------------------------

def land_only_gate(history: DataFrame, last_obs: int, key: str = KEY,
                   year: str = YEAR) -> DataFrame:
    """Entities that hold land and never held improvements up to `last_obs`."""
    flags = history.filter(F.col(year) <= last_obs).groupBy(key).agg(
        F.max(F.col("appr_imps_val")).alias("_imps"), F.max(F.col("appr_land_val")).alias("_land"))
    return flags.filter((F.col("_land") > 0) & (F.coalesce("_imps", F.lit(0)) <= 0)).select(key)


def cap_dlog(c: str | Column, cap: float | None = codes.MAX_LOG_CHANGE) -> Column:
    value = F.col(c) if isinstance(c, str) else c
    return value if cap is None else clamp(value, -cap, cap)


def ratio_fallback(history: DataFrame, key: str = KEY) -> DataFrame:
    """Median improvement-to-land ratio per entity, and the median of those.

    An entity's ratios are one per year, so its median is taken in one group; the
    global one spans all entities and is taken by ranges.
    """
    ratio = F.col("appr_imps_val").cast("double") / F.col("appr_land_val").cast("double")
    usable = history.filter((F.col("appr_land_val") > 0) & F.col("appr_imps_val").isNotNull())
    own = median_by(usable.withColumn("_ratio", ratio), key, "_ratio", "ratio", large=False)
    overall = median_by(own, [], "ratio", "global_ratio").scalar()
    return (history.select(key).distinct().join(own, key, "left")
            .select(key, F.coalesce("ratio", overall).alias("ratio")))


# -- sequential forecast -----------------------------------------------------

def forecast_sequential(panel: DataFrame, years: Sequence[int], scorers: Mapping[str, Scorer],
                        rates: DataFrame | None = None,
                        options: ForecastOptions = ForecastOptions(),
                        features: Sequence[str] = (), land_col: str = "appr_land_val",
                        imps_col: str = "appr_imps_val", keys: Sequence[str] = (KEY,),
                        scenario: str | None = None) -> DataFrame:
    """Forecast land and improvements year by year for consecutive `years`.

    `panel` holds the history and the future rows (see `extend_panel`), with
    parcel_id, tax_yr, appr_land_val, appr_imps_val, area, spec_area and the
    scorers' features. `scorers` may have land_delta, land_level, impr_delta and
    impr_level: functions (frame, name) -> frame with the prediction in `name`.
    A scorer sees the features of the year and lags 1 and 2 of log_land and log_imps,
    which are predictions of the years before. A published rate goes before the delta
    model, the delta model before the level model. `keys` name one path: with several
    scenarios in the panel they are parcel_id and scenario, and each scenario has its
    own history rows. With `scenario` only the future rows differ by that column and all paths of an
    entity start from one history (see `extend_panel`). The result has one row per path and year,
    with the method of each part.
    """
    years = sorted(int(y) for y in years)
    if years != list(range(years[0], years[-1] + 1)):
        raise ValueError("forecast years must be consecutive")
    last_obs = years[0] - 1
    rows = panel.filter(F.col(YEAR) <= years[-1])
    if rates is not None and options.track == "res":
        rows = area_anchor(rows, rates).withColumn(
            "rate_source", F.when(F.col("dlog_actual").isNotNull(), "area_report"))
    elif rates is not None:
        rows = route_rates(rows, rates, options, years[-1])
    else:
        rows = rows.withColumns({"dlog_actual": F.lit(None).cast("double"),
                                 "rate_source": F.lit(None).cast("string")})

    # One row per entity: state at the last observed years, features by year.
    past = F.col(YEAR) <= last_obs

    def log_at(c, y):
        return F.max(F.when(F.col(YEAR) == y, log_pos(c)))

    carried = ["dlog_actual", "rate_source", *features]
    aggs = [
        log_at(land_col, last_obs).alias("_land1"),
        log_at(land_col, last_obs - 1).alias("_land2"),
        log_at(imps_col, last_obs).alias("_imps1"),
        log_at(imps_col, last_obs - 1).alias("_imps2"),
        F.max(F.when(past, F.col(imps_col))).alias("_max_imps"),
        F.max(F.when(past, F.col(land_col))).alias("_max_land")]
    by_year = [F.max(F.when(F.col(YEAR) == y, F.struct(*carried))).alias(f"_y{y}") for y in years]
    has_impr = "impr_delta" in scorers or "impr_level" in scorers
    use_ratio = not has_impr and "land_delta" in scorers
    if use_ratio:
        usable = past & (F.col(land_col) > 0) & F.col(imps_col).isNotNull()
        aggs.append(F.percentile(F.when(usable, F.col(imps_col).cast("double") / F.col(land_col).cast("double")),
                                 F.lit(0.5)).alias("_ratio"))
    if scenario is None:
        wide = rows.groupBy(*keys).agg(*aggs, *by_year)
    else:
        # The future of an entity is its years and scenarios; the rows of one scenario become one path.
        ahead = F.collect_list(F.when(~past, F.struct(F.col(scenario).alias("_s"), F.col(YEAR).alias("_y"),
                                                      F.struct(*carried).alias("_at"))))
        wide = rows.groupBy(*keys).agg(*aggs, ahead.alias("_ahead"))
        wide = wide.withColumn(scenario, F.explode(F.array_distinct(F.transform("_ahead", lambda r: r["_s"]))))
        here = lambda y: F.filter("_ahead", lambda r: r["_s"].eqNullSafe(F.col(scenario)) & (r["_y"] == y))
        wide = wide.withColumns({f"_y{y}": F.get(here(y), F.lit(0))["_at"] for y in years}).drop("_ahead")
        keys = [*keys, scenario]
    land_only = (F.col("_max_land") > 0) & (F.coalesce("_max_imps", F.lit(0)) <= 0)
    wide = wide.withColumn("_gated", F.coalesce(land_only, F.lit(False))
                           if options.land_only_gate else F.lit(False))
    if use_ratio:
        # Every path has its own median in the fold; paths without one take the median of those.
        overall = median_by(wide, [], "_ratio", "global_ratio").scalar()
        wide = wide.withColumn("ratio", F.coalesce("_ratio", overall)).drop("_ratio")

    null = F.lit(None).cast("double")
    for y in years:
        at = F.col(f"_y{y}")
        wide = wide.withColumns(
            {YEAR: F.lit(y), "log_land_lag1": F.col("_land1"), "log_land_lag2": F.col("_land2"),
             "log_imps_lag1": F.col("_imps1"), "log_imps_lag2": F.col("_imps2")} | {c: at[c] for c in carried})
        for name in ("land_delta", "land_level", "impr_delta", "impr_level"):
            wide = (scorers[name](wide, f"_{name}") if name in scorers
                    else wide.withColumn(f"_{name}", null))
        open_ = lambda c: F.when(~F.col("_gated"), c)

        def steps(lag, part):
            return [(F.col(lag) + F.col("dlog_actual"), "actual"),
                    (F.col(lag) + cap_dlog(f"_{part}_delta", options.max_change), "delta")]

        land = steps("_land1", "land") + [(F.col("_land_level"), "level")]
        imps = steps("_imps1", "impr") + [(open_(F.col("_impr_level")), "level")]
        if use_ratio:
            imps.append((open_(F.col("_land") + log_pos("ratio")), "ratio"))
        for out, ways in (("_land", land), ("_imps", imps)):
            wide = wide.withColumns({
                out: F.when(at.isNotNull(), F.coalesce(*[c for c, _ in ways])),
                f"{out}_method": first_match([(c.isNotNull(), m) for c, m in ways])})
        # A ratio of 0 has no logarithm; its improvements are 0 all the same.
        none = F.lit(False)
        if use_ratio:
            none = F.col("_land").isNotNull() & F.col("_imps").isNull() & F.coalesce(F.col("ratio") == 0, none)
        imps_val = F.when(F.col("_gated") | none, F.lit(0.0)).otherwise(F.exp("_imps"))
        wide = wide.withColumn(f"_out{y}", F.when(at.isNotNull(), F.struct(
            F.lit(y).alias(YEAR), F.col("_land").alias("pred_log_land"),
            F.col("_imps").alias("pred_log_imps"),
            F.exp("_land").alias("pred_appr_land_val"), imps_val.alias("pred_appr_imps_val"),
            (F.exp("_land") + imps_val).alias("pred_total_assessed"),
            F.coalesce("rate_source", F.lit("model")).alias("rate_source"),
            F.col("_land_method").alias("land_method"),
            F.when(F.col("_gated"), "land_only").when(none, "ratio").otherwise(F.col("_imps_method"))
            .alias("impr_method"))))
        wide = wide.withColumns({"_land2": F.col("_land1"), "_land1": F.col("_land"),
                                 "_imps2": F.col("_imps1"), "_imps1": F.col("_imps")}).drop(f"_y{y}")
    outs = F.filter(F.array(*[F.col(f"_out{y}") for y in years]), lambda s: s.isNotNull())
    return wide.select(*keys, F.inline(outs))


# -- residual group ----------------------------------------------------------

def group_growth(df: DataFrame, group: str, value: str, year: str = YEAR) -> DataFrame:
    """Value by group and year with the year before and the log change."""
    totals = df.filter(F.col(value) > 0).groupBy(group, year).agg(F.sum(value).alias("av"))
    w = Window.partitionBy(group).orderBy(year)
    lagged = totals.withColumn("av_lag", F.lag("av").over(w))
    return dlog(lagged, group, year, "av").filter(F.col("dlog").isNotNull())


def residual_rate(rates: DataFrame, method: str = "com_weighted",
                  weights: Mapping[str, float] | None = None, proxy: str | None = None,
                  cap: float = 0.15, group: str = "subgroup", year: str = YEAR) -> DataFrame:
    """One log rate per year for what no group covers, capped.

    Methods: value-weighted, a fixed blend (renormalised over the groups that are
    present), the rate of one group, or flat.
    """
    if method == "com_weighted":
        out = rates.groupBy(year).agg(weighted_mean(F.col("dlog"), F.col("av_lag").cast("double"))
                                      .alias("dlog_other"))
        basis = "value_weighted_com"
    elif method == "blend":
        if not weights:
            raise ValueError("blend needs weights")
        w = first_match([(F.col(group) == g, float(x)) for g, x in weights.items()],
                        F.lit(None).cast("double"))
        weighted = rates.withColumn("_w", w).filter(F.col("_w").isNotNull())
        out = weighted.groupBy(year).agg(
            (F.sum(F.col("dlog") * F.col("_w")) / F.sum("_w")).alias("dlog_other"))
        basis = "fixed_blend"
    elif method == "proxy":
        if not proxy:
            raise ValueError("proxy needs a group")
        out = rates.filter(F.col(group) == proxy).groupBy(year).agg(
            F.max("dlog").alias("dlog_other"))
        basis = f"proxy_{proxy}"
    elif method == "flat":
        out = rates.select(year).distinct().withColumn("dlog_other", F.lit(0.0))
        basis = "flat"
    else:
        raise ValueError(f"unknown method {method!r}")
    hot = F.coalesce(F.abs("dlog_other") > cap, F.lit(False))
    return out.select(
        year, clamp("dlog_other", -cap, cap).alias("dlog_other"),
        F.when(hot, F.lit(f"{basis}_capped")).otherwise(F.lit(basis)).alias("basis"))


def residual_forecast(df: DataFrame, rate: DataFrame, start: int,
                      published: DataFrame | None = None, geo_scope: str = "nonspecialty",
                      key: str = KEY, year: str = YEAR) -> DataFrame:
    """Grow the last known values of residual entities by published or residual rates.

    Land and improvements are grown apart where either is known, otherwise the
    total is. Years without a rate hold flat. Growth accumulates in logs, so the
    path is one running sum.
    """
    def maybe(c):
        return F.col(c).cast("double") if c in df.columns else F.lit(None).cast("double")

    w = Window.partitionBy(key).orderBy(year)
    to_here = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = df if "spec_area" in df.columns else df.withColumn("spec_area", F.lit(None).cast("int"))
    total = F.coalesce(null_sum(maybe("appr_land_val"), maybe("appr_imps_val")),
                       F.when(maybe("total_assessed") > 0, maybe("total_assessed")),
                       F.exp(maybe("log_total_assessed")))
    out = out.withColumns({"_land": maybe("appr_land_val"), "_imps": maybe("appr_imps_val"),
                           "_total": total})
    future = F.col(year) >= start
    null = F.lit(None).cast("double")
    if published is not None and "area" in df.columns:
        geo = published.filter((F.col("report_kind") == "geo") & (F.col("prop_type") == "com")
                               & (F.col("basis") == "population"))
        geo = (geo.withColumn(year, F.col("assessment_yr") + 1)
               .withColumn("_area", to_int("area")))
        out = lookup_join(out.withColumn("_area", to_int("area")), rate_paths(geo, "_area", "_path", year), "_area")
        out = out.withColumn("_geo", rate_in("_path", F.col(year)))
        if geo_scope != "all":
            is_spec = F.coalesce(F.col("spec_area") > 0, F.lit(False))
            out = out.withColumn("_geo", F.when(~is_spec, F.col("_geo")))
    else:
        out = out.withColumn("_geo", null)
    out = lookup_join(out, rate.select(year, "dlog_other", "basis"), year)
    step = F.when(future, F.coalesce("_geo", "dlog_other", F.lit(0.0))).otherwise(F.lit(0.0))
    source = (F.when(F.col("_geo").isNotNull(), "geo_report")
              .when(future & F.col("dlog_other").isNotNull(), F.col("basis"))
              .when(future, "flat_fallback"))
    out = out.withColumns({"_step": step, "co_rate_source": source})
    base = lambda c: F.last(c, ignorenulls=True).over(to_here)
    out = out.withColumns({"_base_land": base("_land"), "_base_imps": base("_imps"),
                           "_base_total": base("_total"), "_grow": F.exp(
                               F.sum("_step").over(to_here))})
    split = F.col("_base_land").isNotNull() | F.col("_base_imps").isNotNull()

    def grown(now, start_value):
        return F.when(future & F.col(start_value).isNotNull(),
                      F.col(start_value) * F.col("_grow")).otherwise(F.col(now))

    out = out.withColumns({"pred_appr_land_val": grown("_land", "_base_land"),
                           "pred_appr_imps_val": grown("_imps", "_base_imps")})
    out = out.withColumn("pred_total_assessed", F.when(
        split, null_sum("pred_appr_land_val", "pred_appr_imps_val"))
        .otherwise(grown("_total", "_base_total")))
    return out.select(*df.columns, "co_rate_source", "pred_appr_land_val",
                      "pred_appr_imps_val", "pred_total_assessed")


# -- aggregate forecast ------------------------------------------------------

def allocate(df: DataFrame, weights: Mapping[str, float], value: str,
             group: str = "forecast_group") -> DataFrame:
    """Spread each row's value over groups by weight."""
    table = F.array(*[F.struct(F.lit(g).alias(group), F.lit(float(w)).alias("_w"))
                      for g, w in weights.items()])
    return (df.select("*", F.inline(table))
            .withColumn(value, F.col(value).cast("double") * F.col("_w")).drop("_w"))


def forecast_groups(df: DataFrame, value: str = "av") -> DataFrame:
    """Base value per forecast group: specialty, use code, blended rest.

    `df`: spec_area, spec_name, present_use and a value per account.
    """
    specialty = F.coalesce(F.col("spec_area") != 0, F.lit(False))
    group = F.when(specialty, code_label("spec_name", codes.GROUP_BY_SPECIALTY, default="Other")
                   ).otherwise(code_label("present_use", codes.GROUP_BY_USE))
    source = F.when(specialty, "spec_area").otherwise("present_use")
    sums = (df.select(group.alias("forecast_group"), source.alias("source"), value)
            .groupBy("forecast_group", "source")
            .agg(sum0(value).cast("double").alias("base"), F.count(F.lit(1)).alias("n_parcels")))
    known = sums.filter(F.col("forecast_group").isNotNull())
    rest = allocate(sums.filter(F.col("forecast_group").isNull()).drop("forecast_group"),
                    codes.GROUP_BLEND, "base").withColumns(
        {"source": F.lit("blended"), "n_parcels": F.lit(0).cast("long")})
    return known.unionByName(rest).groupBy("forecast_group").agg(
        F.sum("base").alias("base"), F.sum("n_parcels").alias("n_parcels"))


def aggregate_forecast(groups: DataFrame, rates: DataFrame, base_year: int, last_year: int,
                       rate_year: str = "from", adjust: float = 0.01,
                       fallback: str = "Retail") -> DataFrame:
    """Total by year under three scenarios from group bases and growth series.

    `rates`: rate_group, year, gyy. With `rate_year="from"` the growth of a year
    moves that year to the next one; with "to" it moves the year before to it.
    The scenarios add and subtract `adjust` from the total's growth.
    """
    shift = 1 if rate_year == "from" else 0
    horizon = range(base_year + 1, last_year + shift + 1)
    # One row per series with its rates in year order; the base year has factor 1.
    paths = rates.groupBy("rate_group").agg(F.array(
        F.struct(F.lit(base_year).alias("tax_year"), F.lit(1.0).alias("_step")),
        *[F.struct(F.lit(y).alias("tax_year"),
                   (1 + F.max(F.when(F.col("year") == y - shift, F.col("gyy")))).alias("_step"))
          for y in horizon]).alias("_path"))
    mapped = groups.withColumn("rate_group", code_label(
        "forecast_group", codes.GROUP_RATE_SOURCE, default=fallback))
    steps = mapped.join(paths, "rate_group", "left").select(
        "forecast_group", "base", F.inline("_path"))
    w = (Window.partitionBy("forecast_group").orderBy("tax_year")
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    path = steps.withColumns({"_unknown": F.max(F.col("_step").isNull().cast("int")).over(w),
                              "_factor": F.product("_step").over(w)})
    path = path.withColumn("av", F.when(F.col("_unknown") == 0,
                                        F.col("base") * F.col("_factor")))
    # A group without a rate makes the total unknown, not smaller.
    total = path.groupBy("tax_year").agg(
        F.when(F.count("av") == F.count(F.lit(1)), F.sum("av")).alias("baseline"))
    # The total has one row per year of the horizon.
    order = Window.orderBy("tax_year")
    total = total.withColumn("_g", growth("baseline", F.lag("baseline").over(order)))
    run = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    start = F.first("baseline").over(run)

    def scenario(delta):
        factor = F.when(F.col("tax_year") == base_year, F.lit(1.0)).otherwise(
            1 + F.col("_g") + delta)
        return start * F.product(factor).over(run)

    return total.select("tax_year", "baseline", scenario(adjust).alias("optimistic"),
                        scenario(-adjust).alias("pessimistic"))
