"""Ordered case rules: labels, tiers, use classes and eligibility flags."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from acreline.functions import codes
from acreline.functions.cleaning import (ColumnLike, col, is_in,
                                         log_pos, normalize_text, squish, to_int,
                                         to_num)


def first_match(rules: Sequence[tuple[Column, object]], default=None) -> Column:
    """Value of the first rule whose condition holds."""
    out = None
    for condition, value in rules:
        value = value if isinstance(value, Column) else F.lit(value)
        out = F.when(condition, value) if out is None else out.when(condition, value)
    default = default if isinstance(default, Column) else F.lit(default)
    return default if out is None else out.otherwise(default)


def code_label(c: ColumnLike, table: Mapping[int, str], other_prefix: str | None = None,
               default: str | None = None) -> Column:
    """Label of a code; unlisted codes become `other_prefix` + code."""
    code = col(c)
    rules = [(code == k, v) for k, v in table.items()]
    if other_prefix is not None:
        rules.append((code.isNotNull(),
                      F.concat(F.lit(other_prefix), code.cast("string"))))
    return first_match(rules, default)


def range_label(c: ColumnLike, ranges: Sequence[tuple], default: str | None = None) -> Column:
    """Label of the first half-open range that holds the value."""
    value = col(c)

    def inside(lo, hi):
        if lo is None:
            return value < hi
        return value >= lo if hi is None else (value >= lo) & (value < hi)

    return first_match([(inside(lo, hi), label) for lo, hi, label in ranges], default)


def case_label(c: ColumnLike, rules, default: str | None = None) -> Column:
    """Labels from a code table (dict) or from ranges (sequence)."""
    if isinstance(rules, Mapping):
        return code_label(c, rules, default=default)
    return range_label(c, rules, default)


def classify_use(c: ColumnLike) -> Column:
    """Subgroup of a building-section use code: named sets, then ranges."""
    code = col(c)
    rules = [(code.isin(*members), label) for members, label in codes.SECTION_USE_SETS]
    rules += [((code >= lo) & (code < hi), label)
              for lo, hi, label in codes.SECTION_USE_RANGES]
    return first_match(rules)


def classify_zoning(c: ColumnLike) -> Column:
    zone = F.upper(squish(c))
    return first_match([(zone.rlike(p), label) for p, label in codes.ZONING_PREFIXES])


def classify_keywords(c: ColumnLike, patterns=codes.KEYWORDS,
                      noise: str = codes.KEYWORD_NOISE) -> Column:
    text = normalize_text(c, noise)
    return first_match([(text.rlike(p), label) for label, p in patterns])


def eligibility_flags(df: DataFrame, *, pcnt_complete: str | None = None,
                      grade: str | None = None, tax_status: str | None = None,
                      tax_reason: str | None = None, best_use: str | None = None,
                      living_area: str | None = None, improvements: str | None = None,
                      living_units: str | None = None) -> DataFrame:
    """Exclusion and eligibility flags as 0/1 ints.

    A part that is not named adds a flag of 0, so the output schema is fixed.
    `model_flag` drops incomplete, exempt and non-residential rows,
    `train_flag` drops land-only rows too, and every row gets a forecast.
    """
    no = F.lit(False)

    def flag(condition: Column | None) -> Column:
        return F.coalesce(condition, no).cast("int") if condition is not None else F.lit(0)

    done = to_num(pcnt_complete) if pcnt_complete else None
    incomplete = (done > 0) & (done < 100) if done is not None else None
    exempt = tax_status and (F.col(tax_status) != "T")
    reason = tax_reason and is_in(tax_reason, codes.EXEMPT_REASONS)
    non_sfr = best_use and (to_num(best_use) >= 6)
    empty = [F.coalesce(F.col(c), F.lit(0)) == 0
             for c in (living_area, improvements) if c]
    land_only = empty[0] & empty[-1] if empty else None
    units = to_num(living_units) if living_units else None
    small = (units >= 2) & (units <= 4) if units is not None else None
    model = F.lit(True)
    for part in (incomplete, exempt, reason, non_sfr):
        if part is not None:
            model = model & ~F.coalesce(part, no)
    land_flag = F.coalesce(land_only, no) if land_only is not None else no
    return df.withColumns({
        "is_incomplete_bldg": flag(incomplete),
        "is_exceptional_grade": flag(to_int(grade) == 20 if grade else None),
        "bldg_grade_capped": (F.when(to_int(grade).isNotNull(),
                                     F.least(to_int(grade), F.lit(13)))
                              if grade else F.lit(None).cast("int")),
        "is_non_sfr_hbu": flag(non_sfr),
        "is_small_mf": flag(small),
        "is_land_only": flag(land_only),
        "model_flag": model.cast("int"),
        "train_flag": (model & ~land_flag).cast("int"),
        "forecast_flag": F.lit(1),
    })


def unit_flags(df: DataFrame) -> DataFrame:
    """Size, floor, view and amenity features of a condo unit."""
    positive = lambda c: F.when(F.col(c) > 0, F.col(c))
    size = F.coalesce(positive("unit_sqft"), positive("avg_unit_size")).cast("double")
    stories = F.col("nbr_stories_cplx")
    as_flag = lambda cond: F.coalesce(cond, F.lit(False)).cast("int")
    return df.withColumns({
        "effective_unit_sqft": size,
        "unit_size_tier": range_label(size, codes.UNIT_SIZE_TIERS),
        "log_unit_sqft_eff": log_pos(size),
        "log_nbr_units": log_pos("nbr_units"),
        "is_penthouse": F.when(stories > 0, (F.col("unit_floor") == stories).cast("int")),
        "is_highrise": as_flag(stories >= 8),
        "is_large_complex": as_flag(F.col("nbr_units") >= 50),
        "complex_has_view": as_flag(F.col("pcnt_with_view") > 0),
        "amenity_score": (F.col("has_elevators").cast("int")
                          + F.col("has_security").cast("int")
                          + F.col("has_fireplace").cast("int")
                          + (F.col("laundry_type") >= 1).cast("int")),
        "appeal_location_score": (F.col("project_appeal")
                                  + F.col("project_location")).cast("double"),
    })
