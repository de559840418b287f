"""Column expressions that clean extract values.

All of them are built from Spark functions, so they stay in generated code.
Casts are `try_cast`: a value that does not parse becomes NULL, and NaN or an
infinity read from text becomes NULL as well.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from acreline.functions import codes

ColumnLike = Column | str


def col(c: ColumnLike) -> Column:
    return F.col(c) if isinstance(c, str) else c


def squish(c: ColumnLike) -> Column:
    return F.trim(F.regexp_replace(col(c), r"\s+", " "))


def finite(c: ColumnLike) -> Column:
    """NaN and infinities to NULL."""
    value = col(c)
    bad = F.isnan(value) | (F.abs(value) == F.lit(float("inf")))
    return F.when(~bad, value)


# -- keys --------------------------------------------------------------------

def pad_left(c: ColumnLike, width: int, fill: str = "0") -> Column:
    """Left pad that keeps longer text whole (`lpad` would cut it)."""
    text = F.trim(col(c).cast("string"))
    return F.when(F.length(text) >= width, text).otherwise(
        F.lpad(text, width, fill))


def entity_key(major: ColumnLike, minor: ColumnLike, sep: str = "") -> Column:
    return F.concat(pad_left(major, 6), F.lit(sep), pad_left(minor, 4))


def normalize_key(c: ColumnLike, sep: str = "-") -> Column:
    return F.replace(col(c), F.lit(sep), F.lit(""))


def restore_key(c: ColumnLike, sep: str = "-") -> Column:
    return F.regexp_replace(col(c), r"^([0-9]{6})([0-9]{4})$", f"$1{sep}$2")


# -- numbers -----------------------------------------------------------------

def to_num(c: ColumnLike) -> Column:
    return finite(F.trim(col(c).cast("string")).try_cast("double"))


def to_int(c: ColumnLike) -> Column:
    """Text to int through double, because "7.0" does not cast to int."""
    return to_num(c).try_cast("int")


def parse_money(c: ColumnLike) -> Column:
    """"$ (1,200)" and "-$1,200" are negative."""
    text = col(c)
    magnitude = F.regexp_replace(text, r"[^0-9.]", "").try_cast("double")
    return F.when(text.rlike(r"[-(]"), -magnitude).otherwise(magnitude)


def digits_to_num(c: ColumnLike) -> Column:
    return F.regexp_replace(col(c), r"[^0-9.\-]", "").try_cast("double")


def log_pos(c: ColumnLike) -> Column:
    value = col(c).cast("double")
    return F.when(value > 0, F.ln(value))


def log1p_pos(c: ColumnLike) -> Column:
    value = col(c).cast("double")
    return F.log1p(F.when(value < 0, F.lit(0.0)).otherwise(value))


def safe_ratio(n: ColumnLike, d: ColumnLike, on_zero: float | None = None) -> Column:
    """n / d; a zero or negative denominator gives `on_zero`."""
    top, bottom = col(n).cast("double"), col(d).cast("double")
    return (F.when(bottom > 0, top / bottom)
            .when(bottom <= 0, F.lit(on_zero).cast("double")))


def clamp(c: ColumnLike, lo=None, hi=None) -> Column:
    """Bound a value; NULL stays NULL (`least`/`greatest` would skip it)."""
    value = bounded = col(c)
    if hi is not None:
        bounded = F.least(bounded, F.lit(hi))
    if lo is not None:
        bounded = F.greatest(bounded, F.lit(lo))
    return F.when(value.isNotNull(), bounded)


def null_sum(a: ColumnLike, b: ColumnLike) -> Column:
    """a + b, NULL only when both are NULL."""
    left, right = col(a), col(b)
    return F.coalesce(left + right, left, right)


def score(cols: Sequence[ColumnLike], null_as_zero: bool = True) -> Column:
    parts = [F.coalesce(col(c), F.lit(0)) if null_as_zero else col(c) for c in cols]
    return reduce(add, parts)


def age_at(year: ColumnLike, ref: int) -> Column:
    """Age at `ref`, never below 0; year 0 means unknown."""
    built = col(year)
    return F.when(built != 0, F.greatest(F.lit(ref) - built, F.lit(0)))


# -- flags -------------------------------------------------------------------

def is_in(c: ColumnLike, values: Sequence) -> Column:
    """Membership that is False, not NULL, for NULL."""
    return F.coalesce(col(c).isin(*values), F.lit(False))


def yn_flag(c: ColumnLike, yes: Sequence[str] = ("Y", "1", "YES")) -> Column:
    return is_in(F.upper(F.trim(col(c).cast("string"))), yes).cast("int")


def coerce_bool(c: ColumnLike) -> Column:
    return is_in(F.upper(F.trim(col(c).cast("string"))), ("Y", "YES", "TRUE", "1"))


def coerce_like(c: ColumnLike, dtype: str) -> Column:
    """Change-log text to the type of the column it will overwrite."""
    if dtype == "boolean":
        return coerce_bool(c)
    if dtype == "string":
        return col(c).cast("string")
    number = to_num(c)
    return number if dtype == "double" else number.try_cast(dtype)


def entity_flags(name: ColumnLike) -> dict[str, Column]:
    """`is_llc` and `is_entity` (0/1) from an owner name."""
    upper = F.upper(col(name))

    def any_of(patterns):
        return reduce(lambda x, y: x | y, [upper.rlike(p) for p in patterns])

    llc = any_of(codes.LLC_PATTERNS)
    return {"is_llc": llc.cast("int"),
            "is_entity": (llc | any_of(codes.ENTITY_PATTERNS)).cast("int")}


# -- text --------------------------------------------------------------------

def null_tokens(c: ColumnLike, tokens: Sequence[str] = ("", "(unknown)")) -> Column:
    text = squish(c)
    return F.when(~text.isin(*tokens), text)


def slug(c: ColumnLike) -> Column:
    lowered = F.regexp_replace(F.lower(col(c)), r"[^a-z0-9]+", "_")
    return F.regexp_replace(lowered, r"^_+|_+$", "")


def slug_name(name: str) -> str:
    """The same rule for a column name, with CamelCase split first."""
    split = re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "_", name)
    return re.sub(r"[^a-z0-9]+", "_", split.lower()).strip("_")


def normalize_text(c: ColumnLike, noise: str = codes.KEYWORD_NOISE) -> Column:
    # Other characters go before upper case, which could turn them into letters;
    # dotless i and long s are the two that have one plain capital.
    text = F.upper(F.regexp_replace(col(c), "[^A-Za-z0-9&\u0131\u017f]+", " "))
    return squish(F.regexp_replace(text, noise, " "))


def zip5(c: ColumnLike) -> Column:
    digits = F.regexp_replace(col(c).cast("string"), r"[^0-9]", "")
    return F.when(F.length(digits) >= 5, F.substring(digits, 1, 5))


def _string_map(table: Mapping[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])


def normalize_address(c: ColumnLike,
                      table: Mapping[str, str] = codes.STREET_ABBREVIATIONS) -> Column:
    text = F.regexp_replace(F.upper(F.trim(col(c))), codes.UNIT_SUFFIX, "")
    words = F.split(squish(F.regexp_replace(text, r"[^A-Z0-9 ]", " ")), " ")
    short = _string_map(table)
    return F.array_join(
        F.transform(words, lambda w: F.coalesce(F.try_element_at(short, w), w)), " ")


def address_core_key(c: ColumnLike,
                     table: Mapping[str, str] = codes.STREET_ABBREVIATIONS) -> Column:
    """House number and street words without type and direction words."""
    words = F.split(col(c), " ")
    rest = F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0)))
    generic = F.array(*[F.lit(w) for w in sorted(set(table.values()))])
    core = F.filter(rest, lambda w: ~F.array_contains(generic, w))
    kept = F.when(F.size(core) == 0, rest).otherwise(core)
    return F.when(
        F.size(words) >= 2,
        F.concat_ws(" ", F.element_at(words, 1), F.array_join(kept, " ")))


# -- dates -------------------------------------------------------------------

def parse_date(c: ColumnLike,
               formats: Sequence[str] = ("MM/dd/yyyy", "yyyy-MM-dd")) -> Column:
    text = F.trim(col(c).cast("string"))
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)).cast("date") for f in formats])


def parse_period(c: ColumnLike) -> Column:
    """First day of "2026 Q1", "2026Q1 EST" or "2026M03"; QTD rows give NULL."""
    text = F.trim(F.regexp_replace(F.trim(col(c)), r"\s*EST$", ""))
    quarter, month = r"^(\d{4})\s?Q([1-4])$", r"^(\d{4})M(0[1-9]|1[0-2])$"

    def part(pattern, group):
        return F.regexp_extract(text, pattern, group).cast("int")

    return (F.when(text.rlike(quarter),
                   F.make_date(part(quarter, 1), part(quarter, 2) * 3 - 2, F.lit(1)))
            .when(text.rlike(month),
                  F.make_date(part(month, 1), part(month, 2), F.lit(1))))


# -- column sets -------------------------------------------------------------

def coalesce_present(df: DataFrame, cols: Sequence[str]) -> Column:
    """Coalesce by priority over the columns that exist; NULL if none does."""
    present = [F.col(c) for c in cols if c in df.columns]
    return F.coalesce(*present) if present else F.lit(None).cast("double")


def repair_suffixed(df: DataFrame) -> DataFrame:
    """Fold the join twins `a.x` / `a.y` back into `a`."""
    bases = sorted({c[:-2] for c in df.columns if c.endswith((".x", ".y"))})
    out = {}
    for base in bases:
        twins = [c for c in (base, f"{base}.y", f"{base}.x") if c in df.columns]
        out[base] = F.coalesce(*[F.col(f"`{c}`") for c in twins])
    drop = [c for c in df.columns if c.endswith((".x", ".y"))]
    kept = [F.col(f"`{c}`") for c in df.columns if c not in drop and c not in out]
    return df.select(*kept, *[v.alias(k) for k, v in out.items()])


def type_features(df: DataFrame, *, ints: Sequence[str] = (),
                  doubles: Sequence[str] = (), flags: Sequence[str] = (),
                  equals_one: Sequence[str] = (),
                  positive: Mapping[str, str] | None = None,
                  rename: Mapping[str, str] | None = None) -> DataFrame:
    """Type the optional snapshot columns that are present.

    `positive` maps a code column to a 0/1 flag that says the code is above 0.
    """
    out = {c: to_int(c) for c in ints if c in df.columns}
    out |= {c: to_num(c) for c in doubles if c in df.columns}
    out |= {c: yn_flag(c) for c in flags if c in df.columns}
    out |= {c: (to_int(c) == 1).cast("int") for c in equals_one if c in df.columns}
    out |= {flag: F.coalesce(to_int(c) > 0, F.lit(False)).cast("int")
            for c, flag in (positive or {}).items() if c in df.columns}
    return df.withColumns(out).withColumnsRenamed(dict(rename or {}))
