"""One row per entity from building, unit and feature records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from acreline.functions import codes
from acreline.functions.cleaning import (age_at, is_in, log_pos, safe_ratio, score,
                                         to_int, to_num, yn_flag)
from acreline.functions.labels import (case_label, code_label, eligibility_flags,
                                       range_label, unit_flags)
from acreline.operators.aggregates import collapse, sum_by_bucket, weighted_mean
from acreline.operators.joins import prefix_join
from acreline.operators.windows import first_row


def residential_snapshot(parcels: DataFrame, buildings: DataFrame) -> DataFrame:
    """Parcels with primary-building attributes, total living area and flags.

    `parcels`: parcel_id, minor, prop_type, tax_stat, tax_val_reason, pcnt_complete,
    hbu_as_if_vacant, appr_imps_val, traffic_noise, power_lines, other_nuisances.
    `buildings`: parcel_id, bldg_nbr, bldg_grade, condition, heat_system, yr_built,
    stories, sq_ft_tot_living, nbr_living_units.
    """
    # Buildings that share the lowest number are all primary; one row is kept per
    # parcel, by a total order, so that a parcel is never repeated.
    primary = first_row(buildings.filter(F.col("bldg_nbr").isNotNull()), "parcel_id",
                        ["bldg_nbr", "yr_built", "sq_ft_tot_living", "bldg_grade",
                         "condition", "heat_system", "stories"])
    primary = primary.select(
        "parcel_id", to_int("bldg_grade").alias("avg_bldg_grade"),
        to_int("condition").alias("condition_primary"),
        to_int("heat_system").alias("heat_system_primary"),
        to_int("yr_built").alias("yr_built_primary"),
        to_num("stories").alias("stories_primary"))
    totals = collapse(
        buildings.select("parcel_id", to_num("sq_ft_tot_living").alias("area"),
                         to_num("nbr_living_units").alias("units")),
        "parcel_id", {"total_living_sqft": ("sum", "area"), "max_living_units": ("max", "units")})

    master = (F.col("prop_type") == "K") & (F.trim("minor") == "0000")
    kept = parcels.filter(~F.coalesce(master, F.lit(False))
                          & ~is_in("prop_type", codes.NON_MODELLED_TYPES))
    joined = kept.join(primary, "parcel_id", "left").join(totals, "parcel_id", "left")
    flagged = eligibility_flags(
        joined, pcnt_complete="pcnt_complete", grade="avg_bldg_grade",
        tax_status="tax_stat", tax_reason="tax_val_reason", best_use="hbu_as_if_vacant",
        living_area="total_living_sqft", improvements="appr_imps_val",
        living_units="max_living_units")
    nuisance = score([to_int("traffic_noise"), yn_flag("power_lines"),
                      yn_flag("other_nuisances")])
    return flagged.withColumns({
        "nuisance_score": nuisance,
        "hbu_as_if_vacant_desc": code_label(to_int("hbu_as_if_vacant"),
                                            codes.HIGHEST_BEST_USE_LABELS),
    }).drop("max_living_units")


def commercial_snapshot(buildings: DataFrame, sections: DataFrame, features: DataFrame,
                        ref_year: int) -> DataFrame:
    """Buildings, sections and features collapsed to one row per parcel."""
    b = buildings.withColumns({
        "age": age_at("yr_built", ref_year), "eff_age": age_at("eff_yr", ref_year),
        "sprinkler": yn_flag("sprinklers", ("Y",)), "elevator": yn_flag("elevators", ("Y",))})
    bldg = collapse(b, "parcel_id", {
        "n_comm_bldgs": ("count", None),
        "total_gross_sqft": ("sum", "bldg_gross_sqft"),
        "total_net_sqft": ("sum", "bldg_net_sqft"),
        "max_nbr_stories": ("max", "nbr_stories"),
        "avg_bldg_quality": ("mean", "bldg_quality"),
        "max_bldg_quality": ("max", "bldg_quality"),
        "predominant_use": ("first", "predominant_use", ["bldg_nbr", "predominant_use"]),
        "constr_class": ("first", "constr_class", ["bldg_nbr", "constr_class"]),
        "yr_built_first_comm": ("min", "yr_built"), "yr_built_last_comm": ("max", "yr_built"),
        "eff_yr_comm": ("max", "eff_yr"), "avg_age_comm": ("mean", "age"),
        "min_eff_age_comm": ("min", "eff_age"), "has_sprinklers": ("max", "sprinkler"),
        "has_elevators": ("max", "elevator"), "pcnt_complete_comm": ("mean", "pcnt_complete")})

    s = sections.withColumn("use_bucket", range_label("section_use", codes.USE_BUCKETS, "unknown"))
    uses = ("office", "retail", "industrial", "institutional", "parking")
    by_use = [F.coalesce(F.sum(F.when(F.col("use_bucket") == u, F.col("gross_sqft"))),
                         F.lit(0)).alias(f"{u}_sqft") for u in uses]
    sect = s.groupBy("parcel_id").agg(
        F.count(F.lit(1)).alias("n_sections"),
        (F.count_distinct("section_use")
         + F.max(F.col("section_use").isNull().cast("int"))).alias("n_distinct_uses"),
        F.coalesce(F.sum("gross_sqft"), F.lit(0)).alias("sect_gross_sqft"),
        F.coalesce(F.sum("net_sqft"), F.lit(0)).alias("sect_net_sqft"),
        *by_use, weighted_mean("story_height", "gross_sqft").alias("avg_story_height"))

    feat = sum_by_bucket(features, "parcel_id", "feature_type", "gross_sqft", {
        751: "parking_garage_sqft", 760: "surface_parking_sqft",
        761: "canopy_sqft", 763: "other_feature_sqft"})
    every = features.groupBy("parcel_id").agg(
        F.coalesce(F.sum("gross_sqft"), F.lit(0)).alias("total_feature_sqft"))

    out = (bldg.join(sect, "parcel_id", "left").join(feat, "parcel_id", "left")
           .join(every, "parcel_id", "left"))
    optional = [c for c in sect.columns + feat.columns + every.columns if c != "parcel_id"]
    out = out.na.fill(0, subset=optional)
    mix = {f"{u}_pct": safe_ratio(f"{u}_sqft", "sect_gross_sqft", on_zero=0.0)
           for u in ("office", "retail", "industrial", "parking")}
    return out.withColumns(mix | {
        "total_parking_sqft": (F.col("parking_garage_sqft") + F.col("surface_parking_sqft")
                               + F.col("canopy_sqft")),
        "net_to_gross_ratio": safe_ratio("total_net_sqft", "total_gross_sqft"),
        "predominant_use_desc": code_label("predominant_use", codes.PREDOMINANT_USE_LABELS,
                                           other_prefix="Use_"),
        "prop_class_comm": range_label("predominant_use", codes.USE_CLASSES, "Other Commercial"),
        "size_tier": range_label("total_gross_sqft", codes.BUILDING_SIZE_TIERS),
        "log_gross_sqft": F.when(F.col("total_gross_sqft") == 0, F.lit(0.0))
                           .otherwise(log_pos("total_gross_sqft")),
        "prop_type": F.lit("C")})


def condo_snapshot(units: DataFrame | None, complexes: DataFrame,
                   commercial: DataFrame | None = None) -> DataFrame:
    """Units with the attributes of their complex; timeshares are left out.

    Without a unit table each complex stands for one unit. A unit whose complex
    also occurs in `commercial` is marked.
    """
    if units is None:
        null = lambda t: F.lit(None).cast(t)
        units = complexes.select(
            F.concat("major", F.lit("0000")).alias("parcel_id"),
            F.col("avg_unit_size").alias("unit_sqft"), null("int").alias("unit_floor"))
    joined = prefix_join(units.withColumn("major", F.substring("parcel_id", 1, 6)),
                         complexes.withColumnRenamed("major", "_major"),
                         parent_key="_major")
    joined = joined.filter((F.col("complex_type") != 3) | F.col("complex_type").isNull())
    if commercial is None:
        marked = joined.withColumn("in_comm_bldg", F.lit(False))
    else:
        majors = (commercial.select(F.substring("parcel_id", 1, 6).alias("major")).distinct()
                  .withColumn("in_comm_bldg", F.lit(True)))
        marked = joined.join(majors, "major", "left").na.fill(False, subset=["in_comm_bldg"])
    return unit_flags(marked).withColumns({
        "condo_segment": case_label("complex_type", codes.CONDO_SEGMENTS, "Other Condo"),
        "prop_type": F.lit("D"), "prop_class": F.lit("Condo"), "model_condo": F.lit(1)})
