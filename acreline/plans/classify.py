"""Owner flags, subgroup assignment and the tiered classification."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from acreline.functions import codes
from acreline.functions.cleaning import entity_flags, is_in
from acreline.functions.labels import (classify_keywords, classify_use,
                                       classify_zoning, first_match)
from acreline.operators.aggregates import accuracy, dominant, vote
from acreline.operators.sets import stack
from acreline.operators.windows import first_row, rank_in

KEY = "parcel_id"


def owner_flags(accounts: DataFrame, entities: DataFrame | None = None,
                key: str = KEY, name: str = "taxpayer_name") -> DataFrame:
    """Owner flags per entity; entities without an account get 0."""
    flags = accounts.select(key, *[c.alias(n) for n, c in entity_flags(name).items()])
    lookup = flags.groupBy(key).agg(
        *[F.coalesce(F.max(c), F.lit(0)).alias(c) for c in ("is_llc", "is_entity")])
    if entities is None:
        return lookup
    return (entities.drop("is_llc", "is_entity").join(lookup, key, "left")
            .na.fill(0, subset=["is_llc", "is_entity"]))


def assign_subgroup(df: DataFrame, specialty: str = "spec_area_name", use: str = "present_use",
                    specialties: Mapping[str, Sequence[str]] = codes.SUBGROUP_SPECIALTIES,
                    uses: Mapping[str, Sequence[int]] = codes.SUBGROUP_USES,
                    excluded: Sequence[int] = codes.VACANT_USES + codes.PARKING_USES,
                    interleaved: bool = False, out: str = "com_subgroup") -> DataFrame:
    """Subgroup by specialty name, then by use code unless it is excluded.

    `interleaved=True` lets an earlier subgroup's use code win over a later
    subgroup's specialty name.
    """
    by_name = {k: F.col(specialty).isin(*v) for k, v in specialties.items()}
    open_use = ~is_in(use, excluded)
    by_use = {k: F.col(use).isin(*v) & open_use for k, v in uses.items()}
    if interleaved:
        rules = [(rule[k], k) for k in specialties for rule in (by_name, by_use)]
    else:
        rules = [(c, k) for k, c in by_name.items()] + [(c, k) for k, c in by_use.items()]
    return df.withColumn(out, first_match(rules, "other"))


def classify_waterfall(parcels: DataFrame, sections: DataFrame | None = None,
                       buildings: DataFrame | None = None,
                       texts: Sequence[DataFrame] = (), max_tier: int = 3,
                       uses: Mapping[str, Sequence[int]] = codes.SUBGROUP_USES) -> DataFrame:
    """Subgroup, tier and evidence per parcel.

    Tiers: use code, dominant section use, use of the largest building, keyword
    vote over texts, zoning of vacant land. Vacant parcels can only be set by the
    last tier and parking is held. Tiers above `max_tier` are not applied.
    `parcels`: parcel_id, present_use, current_zoning, property_name. `sections`:
    parcel_id, section_use, gross_sqft. `buildings`: parcel_id, predominant_use,
    bldg_gross_sqft. `texts`: frames of parcel_id, src, txt.
    """
    out = parcels.withColumns({
        "is_vacant": is_in("present_use", codes.VACANT_USES),
        "is_parking": is_in("present_use", codes.PARKING_USES)})
    tiers = [("1_present_use",
              first_match([(F.col("present_use").isin(*v), k) for k, v in uses.items()]),
              F.concat(F.lit("PresentUse="), F.col("present_use").cast("string")))]

    if sections is not None and max_tier >= 2:
        known = (sections.withColumn("_sg2", classify_use("section_use"))
                 .filter(F.col("_sg2").isNotNull() & (F.col("gross_sqft") > 0)))
        top = dominant(known, KEY, "_sg2", "gross_sqft").withColumnRenamed("share", "_share")
        out = out.join(top, KEY, "left")
        tiers.append(("2_section_use", F.col("_sg2"),
                      F.concat(F.lit("SectionUse share="),
                               F.format_string("%.2f", F.round("_share", 2)))))
    if buildings is not None and max_tier >= 3:
        largest = first_row(buildings, KEY, [F.desc_nulls_last("bldg_gross_sqft"),
                                             F.col("predominant_use")])
        out = out.join(largest.select(KEY, F.col("predominant_use").alias("_use3")), KEY, "left")
        tiers.append(("3_predominant_use", classify_use("_use3"),
                      F.concat(F.lit("PredominantUse="), F.col("_use3").cast("string"))))
    if max_tier >= 4:
        named = parcels.select(KEY, F.lit("PropertyName").alias("src"),
                               F.col("property_name").alias("txt"))
        rows = stack([*texts, named]).withColumn("_sg4", classify_keywords("txt"))
        votes = vote(rows.filter(F.col("_sg4").isNotNull()), KEY, "_sg4",
                     rank_in("src", codes.TEXT_SOURCES))
        out = out.join(votes.select(KEY, "_sg4", F.col("n").alias("_votes")), KEY, "left")
        tiers.append(("4_keyword", F.col("_sg4"),
                      F.concat(F.lit("keyword n="), F.col("_votes").cast("string"))))

    built = [(found.isNotNull() & ~F.col("is_vacant"), name, found, why)
             for name, found, why in tiers]
    if max_tier >= 5:
        # Zoning looks only at vacant parcels that no earlier tier has matched.
        unmatched = F.lit(True)
        for _, found, _ in tiers:
            unmatched = unmatched & found.isNull()
        zone = classify_zoning("current_zoning")
        built.append((F.col("is_vacant") & unmatched & zone.isNotNull(), "5_zoning", zone,
                      F.concat(F.lit("Zoning="), F.col("current_zoning"))))
    parking = F.col("is_parking")
    subgroup = first_match([(parking, F.lit(None).cast("string"))]
                           + [(c, found) for c, _, found, _ in built])
    tier = first_match([(parking, "parking_hold")] + [(c, name) for c, name, _, _ in built])
    evidence = first_match([(parking, "PresentUse parking")] + [(c, why) for c, _, _, why in built])
    return out.select(*parcels.columns, "is_vacant", "is_parking",
                      subgroup.alias("subgroup"), tier.alias("class_tier"),
                      evidence.alias("class_evidence"))


def validate_classifier(known: DataFrame, predicted: DataFrame, truth: str = "truth",
                        pred: str = "subgroup", tier: str = "class_tier") -> DataFrame:
    """Accuracy and coverage on labelled entities, overall and per tier."""
    both = known.filter(F.col(truth).isNotNull()).select(KEY, truth).join(
        predicted.select(KEY, pred, tier), KEY, "inner")
    overall = accuracy(both, truth, pred).withColumn(tier, F.lit("all"))
    return overall.unionByName(accuracy(both.filter(F.col(pred).isNotNull()), truth, pred, tier))


def class_audit(classified: DataFrame, tier: str = "class_tier",
                label: str = "subgroup") -> DataFrame:
    return classified.groupBy(F.coalesce(F.col(tier), F.lit("unmatched")).alias(tier), label).agg(
        F.count(F.lit(1)).alias("n_entities"))
