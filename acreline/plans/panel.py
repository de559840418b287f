"""Panel assembly: value history, change log, permits, exemptions, inspections.

Every feature step folds the panel to its entities, aggregates its sources to them by year, and
joins on the entity (`fold`). The windows that follow run over one entity's years.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from acreline.functions import codes
from acreline.functions.cleaning import (coalesce_present, coerce_like, digits_to_num, entity_key,
                                         is_in, log1p_pos, log_pos, null_sum,
                                         null_tokens, to_int, yn_flag)
from acreline.operators.filters import filter_codes, filter_years
from acreline.operators.joins import attach_drivers, expand_snapshot
from acreline.operators.sets import stack
from acreline.operators.windows import latest, locf, rolling_mean, rolling_sum, years_since
from acreline.plans import fold

KEY, YEAR = "parcel_id", "tax_yr"


def value_history(raw: DataFrame, lo: int = 2001, hi: int = 2026,
                  levy_codes: Sequence[str] = codes.LEVY_CODES) -> DataFrame:
    """Taxable, unexcepted rows; the latest change per parcel and tax year."""
    kept = filter_codes(raw, "levy_code", levy_codes).filter(
        (F.col("tax_status") == "T") & F.col("tax_val_reason").isNull())
    kept = filter_years(kept, lo, hi).withColumn(KEY, entity_key("major", "minor"))
    others = [c for c in kept.columns if c not in (KEY, YEAR, "change_date")]
    return latest(kept, [KEY, YEAR], ["change_date", *others])


def change_log(header: DataFrame, detail: DataFrame, attrs: Sequence[str]) -> DataFrame:
    """Detail rows of tracked attributes with their event header, last update each.

    `header`: parcel_id, event_id and event columns. `detail`: parcel_id, event_id,
    component_id, attribute, attribute_value, update_date, updated_by.
    """
    name = F.lower(F.regexp_replace(F.trim("attribute"), r"\s+", "_"))
    tracked = (detail.withColumn("attribute", name).filter(F.col("attribute").isin(*attrs))
               .withColumn("attribute_value", null_tokens("attribute_value")))
    # Detail rows are reduced before the join, so headers meet one row per key.
    last = latest(tracked, [KEY, "event_id", "component_id", "attribute"],
                  ["update_date", "attribute_value", "updated_by"])
    return last.join(header, [KEY, "event_id"], "left")


def build_panel(snapshot: DataFrame, values: DataFrame, changes: DataFrame | None,
                lo: int, hi: int, attrs: Mapping[str, str] = codes.CHANGE_ATTRIBUTES,
                carry: str = "until_next") -> DataFrame:
    """Entity-by-year grid with values, baseline facets, changes and logs.

    `values` has one row per entity and year. Values and changes are aggregated to the entity by
    year and meet the snapshot there; the years are made last.
    """
    if carry not in ("until_next", "point"):
        raise ValueError(f"carry must be 'until_next' or 'point', not {carry!r}")
    attrs = {a: c for a, c in attrs.items() if a != "area"}
    facets = [c for c in ("area", *attrs.values(), *codes.DISTANCE_COLUMNS) if c in snapshot.columns]
    types, years = dict(snapshot.dtypes), range(lo, hi + 1)
    attrs = {a: c for a, c in attrs.items() if c in types}
    amounts = ("appr_land_val", "appr_imps_val")
    # Dealt by entity alone, so that the joins and windows below find their rows in place.
    panel = snapshot.select(KEY, *facets).repartition(KEY).distinct()
    panel = panel.join(fold.annual(values, years, {c: fold.greatest(F.col(c)) for c in amounts}), KEY, "left")
    news = []
    if changes is not None and attrs:
        # What was changed before the first year still holds in it.
        when = F.year("update_date")
        dated = changes.withColumn("eff_yr", F.greatest(when, F.lit(lo)) if carry == "until_next" else when)
        panel = panel.join(fold.last_changes(dated, years, attrs, ("update_date", "attribute_value")), KEY, "left")
        news = [f"_changes_{c}" for c in attrs.values()]
    spine = F.array(*[F.struct(F.lit(y).alias(YEAR), *[F.get(c, F.lit(i)).alias(c) for c in (*amounts, *news)])
                      for i, y in enumerate(years)])
    panel = panel.select(KEY, *facets, F.inline(spine))
    history = (Window.partitionBy(KEY).orderBy(YEAR)
               .rowsBetween(Window.unboundedPreceding, Window.currentRow))

    def updated(c: str) -> Column:
        change = F.col(f"_changes_{c}")
        new = coerce_like(change["_value"], types[c])
        if carry == "until_next":
            return F.coalesce(F.last(new, ignorenulls=True).over(history), F.col(c))
        return F.last(F.when(change.isNotNull(), new).otherwise(F.col(c)), ignorenulls=True).over(history)

    if news:
        panel = panel.withColumns({c: updated(c) for c in attrs.values()}).drop(*news)
    positive = lambda c: F.when(F.col(c) > 0, F.col(c))
    panel = panel.select(KEY, YEAR, *facets, *amounts).withColumn("total_assessed", null_sum(*amounts))
    panel = panel.withColumns({c: positive(c) for c in (*amounts, "total_assessed")})
    return panel.withColumns({f"log_{c}": log_pos(c) for c in (*amounts, "total_assessed")})


def permit_features(panel: DataFrame, permits: DataFrame, lines: DataFrame,
                    dates: Sequence[str], years: Sequence[int], year_offset: int = 0) -> DataFrame:
    """Annual permit totals, 1/3/5-year sums and years since new construction.

    `permits`: parcel_id, record_number, date columns by priority, valuation,
    units_added. `lines`: record_number, sqft. `years` are the consecutive years of the panel.
    """
    sqft = (lines.groupBy("record_number").agg(F.sum("sqft").alias("sqft_total"))
            .withColumn("sqft_total", F.nullif(F.col("sqft_total"), F.lit(0))))
    dated = permits.withColumn(YEAR, F.year(coalesce_present(permits, dates)) + year_offset)
    dated = dated.filter(F.col(KEY).isNotNull() & F.col(YEAR).isNotNull())
    annual = fold.annual(dated.join(sqft, "record_number", "left"), years, {
        "permits_cnt": fold.times(), "permits_val_sum": fold.total(F.col("valuation")),
        "permits_sqft_sum": fold.total(F.col("sqft_total")), "units_added_sum": fold.total(F.col("units_added"))})
    out = fold.attach(panel, [annual], years, dict.fromkeys(
        ("permits_cnt", "permits_val_sum", "permits_sqft_sum", "units_added_sum"), 0))
    out = out.withColumn("any_newconst_permit", (F.col("permits_cnt") > 0).cast("int"))
    out = rolling_sum(out, KEY, YEAR, {
        "permits_last_1yr": ("permits_cnt", 1), "permits_last_3yr": ("permits_cnt", 3),
        "permits_last_5yr": ("permits_cnt", 5), "val_last_3yr": ("permits_val_sum", 3),
        "val_last_5yr": ("permits_val_sum", 5), "sqft_last_3yr": ("permits_sqft_sum", 3),
        "units_last_3yr": ("units_added_sum", 3)})
    out = years_since(out, KEY, YEAR, "any_newconst_permit", "years_since_newconst")
    before = F.col("any_newconst") if "any_newconst" in panel.columns else F.lit(None).cast("int")
    return out.withColumns({
        "any_newconst": F.greatest(before, F.col("any_newconst_permit")),
        "years_since_newconst": F.coalesce("years_since_newconst", F.lit(0)),
        "log_val_last_3yr": F.log1p(F.col("val_last_3yr").cast("double")),
        "log_sqft_last_3yr": F.log1p(F.col("sqft_last_3yr").cast("double"))})


def assessor_permit_features(panel: DataFrame, permits: DataFrame,
                             detail: DataFrame, years: Sequence[int]) -> DataFrame:
    """Permit features with item values, open and new flags, percent complete.

    `permits`: parcel_id, permit_nbr, issue_date, permit_type, permit_status,
    permit_val, pcnt_complete. `detail`: permit_nbr, permit_item, item_value.
    `years` are the consecutive years of the panel.
    """
    items = detail.select("permit_nbr", to_int("permit_item").alias("item"),
                          digits_to_num("item_value").alias("num"))
    # A pivot would deal the lines twice, by permit and item first.
    wide = items.filter(F.col("num").isNotNull()).groupBy("permit_nbr").agg(
        *[F.sum(F.when(F.col("item") == k, F.col("num"))).alias(v) for k, v in codes.PERMIT_ITEMS.items()])
    kind, status = F.upper(F.trim("permit_type")), F.upper(F.trim("permit_status"))
    used = F.when(F.col("permit_val") > 0, F.col("permit_val")).otherwise(F.col("owner_val"))
    dated = (permits.withColumn(YEAR, F.year("issue_date"))
             .filter(F.col(KEY).isNotNull() & F.col(YEAR).isNotNull()).join(wide, "permit_nbr", "left"))
    annual = fold.annual(dated, years, {
        "kcap_cnt": fold.times(), "kcap_val_sum": fold.total(used),
        "kcap_sqft_sum": fold.total(F.col("permit_sqft")), "kcap_units_sum": fold.total(F.col("permit_units")),
        "kcap_pct_max": fold.greatest(F.col("pcnt_complete")),
        "kcap_open_sum": fold.total((~status.rlike(codes.CLOSED_PERMIT)).cast("int")),
        "kcap_new_flag": fold.greatest(F.coalesce(kind.rlike(codes.NEW_PERMIT), F.lit(False)).cast("int"))})
    out = fold.attach(panel, [annual], years, dict.fromkeys(
        ("kcap_cnt", "kcap_val_sum", "kcap_sqft_sum", "kcap_units_sum", "kcap_open_sum", "kcap_new_flag"), 0))
    out = rolling_sum(out, KEY, YEAR, {
        "kcap_permits_1yr": ("kcap_cnt", 1), "kcap_permits_3yr": ("kcap_cnt", 3),
        "kcap_permits_5yr": ("kcap_cnt", 5), "kcap_val_3yr": ("kcap_val_sum", 3),
        "kcap_val_5yr": ("kcap_val_sum", 5), "kcap_sqft_3yr": ("kcap_sqft_sum", 3),
        "kcap_units_3yr": ("kcap_units_sum", 3)})
    out = locf(out.withColumn("kcap_pct_complete_max", F.col("kcap_pct_max")), KEY, YEAR,
               ["kcap_pct_complete_max"])
    out = years_since(out, KEY, YEAR, "kcap_new_flag", "kcap_years_since_permit")
    before = F.col("any_newconst") if "any_newconst" in panel.columns else F.lit(None).cast("int")
    return out.withColumns({
        "log_kcap_val_3yr": log1p_pos("kcap_val_3yr"),
        "log_kcap_sqft_3yr": log1p_pos("kcap_sqft_3yr"),
        "any_newconst": F.greatest(before, F.col("kcap_new_flag"))})


def exemption_features(panel: DataFrame, applications: DataFrame, exemptions: DataFrame,
                       lo: int, hi: int) -> DataFrame:
    """Approved applications, active exemptions and values that roll off.

    `applications`: parcel_id, approved, approved_date, received_date, est_cost.
    `exemptions`: parcel_id, first_bill_yr, last_bill_yr, home_imp_val. An exemption counts in
    all years of its interval, which is not expanded for that.
    """
    years = range(lo, hi + 1)
    approved = is_in(F.upper(F.trim("approved")), ("Y", "1", "T"))
    when_ = F.year(F.coalesce("approved_date", "received_date"))
    apps = fold.annual(applications.filter(approved), years, {
        "hi_app_cnt": fold.times(), "hi_est_cost": fold.total(F.col("est_cost"))}, when_)
    valid = exemptions.filter(F.col("first_bill_yr").isNotNull()
                              & (F.col("last_bill_yr") >= F.col("first_bill_yr"))
                              & (F.col("home_imp_val") > 0))
    first, last, value = (F.col(c) for c in ("first_bill_yr", "last_bill_yr", "home_imp_val"))
    # One aggregate: the years in which an exemption is active, and the one after its last.
    active = lambda y: (first <= y) & (last >= y)
    exempt = valid.filter(F.col(KEY).isNotNull()).groupBy(KEY).agg(
        F.array(*[F.sum(F.when(active(y), value)) for y in years]).alias("hi_exempt_val_active"),
        F.array(*[F.max(active(y).cast("int")) for y in years]).alias("hi_exempt_active"),
        F.array(*[F.sum(F.when(last + 1 == y, value)) for y in years]).alias("hi_rolloff_cur_val"),
        F.max(F.lit(1)).alias("hi_ever"))
    out = fold.attach(panel, [apps, exempt], years, dict.fromkeys(
        ("hi_app_cnt", "hi_est_cost", "hi_exempt_active", "hi_exempt_val_active", "hi_rolloff_cur_val", "hi_ever"), 0))
    out = rolling_sum(out, KEY, YEAR, {"hi_app_cnt_3yr": ("hi_app_cnt", 3),
                                       "hi_est_cost_3yr": ("hi_est_cost", 3)})
    w = Window.partitionBy(KEY).orderBy(YEAR)
    zero = F.lit(0).cast(dict(out.dtypes)["hi_rolloff_cur_val"])
    return out.withColumns({
        "hi_rolloff_next_val": F.coalesce(F.lead("hi_rolloff_cur_val").over(w), zero),
        "log_hi_est_cost_3yr": log1p_pos("hi_est_cost_3yr"),
        "log_hi_exempt_val_active": log1p_pos("hi_exempt_val_active")})


def inspection_features(panel: DataFrame, violations: DataFrame, matches: DataFrame,
                        year_offset: int = 1, carry: bool = True) -> DataFrame:
    """Violations to inspections to entity-year scores.

    `violations`: inspection_id, estab_id, inspection_date, score, violation_type,
    result, closed, grade. `matches`: estab_id, parcel_id (from `two_pass_match`).
    Establishments are summed up by year before they move to their entity.
    """
    one = matches.filter(F.col(KEY).isNotNull()).groupBy("estab_id").agg(F.min(KEY).alias(KEY))
    has = lambda c, word: F.coalesce(F.lower(F.col(c)).contains(word), F.lit(False))
    inspections = violations.groupBy("inspection_id").agg(
        F.min("estab_id").alias("estab_id"), F.min(F.year("inspection_date")).alias("insp_yr"),
        F.max("score").alias("score"),
        F.max(has("violation_type", "red").cast("int")).alias("red"),
        F.max(has("result", "unsat").cast("int")).alias("unsat"),
        F.max(yn_flag("closed", ("TRUE", "YES", "Y", "1"))).alias("closed"),
        F.avg("grade").alias("grade"))
    means = {"hlth_score_mean": "score", "hlth_red_share": "red", "hlth_unsat_share": "unsat",
             "hlth_grade_mean": "grade"}
    per_estab = (inspections.join(one, "estab_id", "inner")
                 .groupBy("estab_id", KEY, (F.col("insp_yr") + year_offset).alias(YEAR)).agg(
                     F.count(F.lit(1)).alias("_n"), F.max("score").alias("_max"), F.sum("closed").alias("_closed"),
                     *[x for c in means.values() for x in (F.sum(c).alias(f"_{c}"), F.count(c).alias(f"_n_{c}"))]))
    # Dealt by entity: all that follows stays in place.
    annual = per_estab.repartition(KEY).groupBy(KEY, YEAR).agg(
        F.count(F.lit(1)).alias("hlth_n_estab"), F.sum("_n").alias("hlth_n_insp"),
        F.max("_max").alias("hlth_score_max"), F.sum("_closed").alias("hlth_closed_n"),
        *[F.try_divide(F.sum(f"_{c}"), F.sum(f"_n_{c}")).alias(name) for name, c in means.items()])
    annual = rolling_mean(annual, KEY, YEAR, {"hlth_score_mean_3yr": ("hlth_score_mean", 3)})
    annual = annual.withColumn("hlth_has_data", F.lit(1))
    cols = [c for c in annual.columns if c not in (KEY, YEAR)]
    folded = fold.fold(panel.drop(*cols)).join(fold.by_year(annual, "_annual", cols), KEY, "left")
    out = fold.unfold(folded, lambda r: {c: F.try_element_at(F.col("_annual"), r[YEAR])[c] for c in cols})
    return locf(out, KEY, YEAR, cols) if carry else out


def dedup_tracks(residential: DataFrame, commercial: DataFrame) -> DataFrame:
    """Drop small multi-family rows whose complex is in the commercial track.

    All rows are joined on their own complex. An anti join on a key that is NULL
    for the other rows would send those to one task.
    """
    majors = commercial.select(F.substring(KEY, 1, 6).alias("_major")).distinct()
    marked = residential.withColumn("_major", F.substring(KEY, 1, 6)).join(
        majors.withColumn("_shared", F.lit(True)), "_major", "left")
    twice = F.col("_shared") & (F.col("is_small_mf") == 1)
    return marked.filter(~F.coalesce(twice, F.lit(False))).drop("_major", "_shared")


def unify_tracks(residential_panel: DataFrame, snapshots: Mapping[str, DataFrame],
                 values: DataFrame, years: Sequence[int],
                 drivers: DataFrame | None = None) -> DataFrame:
    """Stack the residential panel with expanded commercial and condo snapshots.

    `snapshots` maps a property type letter to its snapshot. A snapshot may be far smaller than `values`, which
    are therefore reduced to its entities and years before they are sorted for the join.
    """
    names = {"R": "Residential", "C": "Commercial", "D": "Condo"}
    parts = [residential_panel.withColumns({"prop_type": F.lit("R"),
                                            "prop_class": F.lit(names["R"])})]
    for letter, snap in snapshots.items():
        wide = expand_snapshot(snap.drop("prop_type", "prop_class"), years)
        own = values.filter(F.col(YEAR).isin(*years)).join(wide.select(KEY, YEAR), [KEY, YEAR], "left_semi")
        part = wide.join(own, [KEY, YEAR], "left")
        parts.append(part.withColumns({"prop_type": F.lit(letter),
                                       "prop_class": F.lit(names[letter])}))
    panel = stack(parts)
    return panel if drivers is None else attach_drivers(panel, drivers)

