"""Joins between entity tables, panels, lookups and year-keyed drivers.

None of these forces a broadcast: the planner broadcasts a side when its size is
known to be below `spark.sql.autoBroadcastJoinThreshold`, and adaptive execution
does so, or splits a skewed partition, once it has measured the shuffle. Years
and other literal lists are exploded in place, so no join is a cross join.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from acreline.functions.cleaning import coerce_like
from acreline.operators.filters import drop_like


def _as_list(on: str | Sequence[str]) -> list[str]:
    return [on] if isinstance(on, str) else list(on)


def _tagged(df: DataFrame, on: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Right side with its value columns renamed and a match marker."""
    return df.select(*on, *[F.col(c).alias(f"_new_{c}") for c in cols],
                     F.lit(True).alias("_matched"))


def _replace(df: DataFrame, upd: DataFrame, on, cols, rule) -> DataFrame:
    on, cols = _as_list(on), _as_list(cols)
    names = df.columns + [c for c in cols if c not in df.columns]
    joined = df.join(_tagged(upd, on, cols), on, "left")

    def value(c):
        if c not in cols:
            return F.col(c)
        old = F.col(c) if c in df.columns else F.lit(None)
        return rule(old, F.col(f"_new_{c}")).alias(c)

    return joined.select(*[value(c) for c in names])


# -- lookups -----------------------------------------------------------------

def decode(df: DataFrame, lookup: DataFrame, column: str, lu_type: int,
           suffix: str = "_desc", *, type_col: str = "lu_type",
           item_col: str = "lu_item", desc_col: str = "lu_description") -> DataFrame:
    """Add the description of one coded column."""
    table = lookup.filter(F.col(type_col) == lu_type).select(
        F.col(item_col).cast("string").alias(column),
        F.col(desc_col).alias(column + suffix))
    return df.withColumn(column, F.col(column).cast("string")).join(table, column, "left")


def decode_many(df: DataFrame, lookup: DataFrame, types: Mapping[str, int],
                suffix: str = "_desc", **names) -> DataFrame:
    for column, lu_type in types.items():
        df = decode(df, lookup, column, lu_type, suffix, **names)
    return df


# -- keyed joins -------------------------------------------------------------

def left_join_unique(left: DataFrame, right: DataFrame, on, validate: bool = True) -> DataFrame:
    """Left join that refuses a right side with repeated keys.

    The check is part of the plan and fails the action that runs it: keys are counted where the join
    has brought them together anyway. NULL keys never match and are not counted.
    """
    on = _as_list(on)
    if validate:
        times = F.count(F.lit(1)).over(Window.partitionBy(*on))
        error = F.raise_error(F.lit(f"right side has repeated keys on {on}")).cast("boolean")
        right = (right.dropna(subset=on).withColumn("_times", times)
                 .filter(F.when(F.col("_times") > 1, error).otherwise(F.lit(True))).drop("_times"))
    return left.join(right, on, "left")


def update_join(df: DataFrame, upd: DataFrame, on, cols) -> DataFrame:
    """Overwrite `cols` where the key matches, also with NULL."""
    return _replace(df, upd, on, cols,
                    lambda old, new: F.when(F.col("_matched"), new).otherwise(old))


def fill_join(df: DataFrame, src: DataFrame, on, cols) -> DataFrame:
    """Set `cols` only where they are still NULL."""
    return _replace(df, src, on, cols, lambda old, new: F.coalesce(old, new))


def overlay_join(df: DataFrame, src: DataFrame, on, cols) -> DataFrame:
    """Let the source win wherever it is not NULL."""
    return _replace(df, src, on, cols, lambda old, new: F.coalesce(new, old))


def semi(df: DataFrame, keys: DataFrame, on) -> DataFrame:
    return df.join(keys, on, "left_semi")


def anti(df: DataFrame, keys: DataFrame, on) -> DataFrame:
    return df.join(keys, on, "left_anti")


def inner_join(left: DataFrame, right: DataFrame, on) -> DataFrame:
    return left.join(right, on, "inner")


def outer_join(left: DataFrame, right: DataFrame, on) -> DataFrame:
    return left.join(right, on, "full_outer")


def many_join(left: DataFrame, right: DataFrame, on, how: str = "left") -> DataFrame:
    """Many-to-many equi-join, such as detail rows with repeated headers."""
    return left.join(right, on, how)


def prefix_join(units: DataFrame, parents: DataFrame, n: int = 6,
                key: str = "parcel_id", parent_key: str = "major") -> DataFrame:
    """Give each unit the attributes of the parent with its key prefix."""
    tagged = units.withColumn("_prefix", F.substring(key, 1, n))
    right = parents.withColumnRenamed(parent_key, "_prefix")
    return tagged.join(right, "_prefix", "left").drop("_prefix")


def two_pass_match(left: DataFrame, right: DataFrame, keys: Sequence[str],
                   entity: str = "parcel_id") -> DataFrame:
    """Match on the first key, then on looser ones.

    A key that leads to more than one entity is not used in its pass. Adds
    `entity` and the pass number.
    """
    found, passes = [], []
    for i, key in enumerate(keys, 1):
        # min = max says one entity without a distinct shuffle.
        clear = (right.filter(F.col(key).isNotNull()).groupBy(key)
                 .agg(F.min(entity).alias(f"_pass{i}"), F.max(entity).alias("_hi"))
                 .filter(F.col(f"_pass{i}") == F.col("_hi")).drop("_hi"))
        left = left.join(clear, key, "left")
        found.append(F.col(f"_pass{i}"))
        passes.append(F.when(F.col(f"_pass{i}").isNotNull(), F.lit(i)))
    return (left.withColumns({entity: F.coalesce(*found), "match_pass": F.coalesce(*passes)})
            .drop(*[f"_pass{i}" for i in range(1, len(keys) + 1)]))


# -- years -------------------------------------------------------------------

def cross_grid(entities: DataFrame, key: str, lo: int, hi: int,
               year: str = "tax_yr") -> DataFrame:
    """One row per distinct entity and year in [lo, hi]."""
    years = F.sequence(F.lit(lo), F.lit(hi))
    return entities.select(key).distinct().withColumn(year, F.explode(years))


def expand_snapshot(snap: DataFrame, years: Sequence[int], year: str = "tax_yr") -> DataFrame:
    """Repeat a snapshot over a list of years."""
    spine = F.array(*[F.lit(int(y)) for y in years])
    return snap.drop(year).withColumn(year, F.explode(spine))


def expand_interval(df: DataFrame, start: str, end: str, lo: int, hi: int,
                    year: str = "tax_yr") -> DataFrame:
    """One row per year of [start, end] clamped to [lo, hi].

    Empty intervals are filtered first: `sequence` would count downwards.
    """
    first = F.greatest(F.col(start), F.lit(lo))
    last = F.least(F.col(end), F.lit(hi))
    valid = df.filter((F.col(end) >= F.col(start)) & (F.col(end) >= lo) & (F.col(start) <= hi))
    return valid.withColumn(year, F.explode(F.sequence(first, last)))


def attach_drivers(panel: DataFrame, drivers: DataFrame, prefix: str | None = None,
                   on: str = "tax_yr") -> DataFrame:
    """Join a year-keyed driver table after dropping stale driver columns.

    A year holds a large share of a panel, so the panel is not dealt by it: see `lookup_join`.
    """
    if prefix:
        panel = drop_like(panel, f"^{prefix}")
    panel = panel.drop(*[c for c in drivers.columns if c != on])
    return lookup_join(panel, drivers, on)


#: Rows up to which a lookup table is sent to every task.
LOOKUP_ROWS = 100_000


def lookup_join(df: DataFrame, table: DataFrame, on: str | Sequence[str], spread: Sequence[str] = (),
                most_rows: int = LOOKUP_ROWS, salts: int = 64) -> DataFrame:
    """Left join with a table of few keys, each of which may stand in a large share of `df`.

    The table is measured by reading it, and sent to every task if it has at most `most_rows` rows:
    `df` stays where it is. A larger one is repeated under `salts` numbers, and the rows of a key are
    spread over these by a hash of `spread` (all columns by default), so that no key fills one task.
    """
    on = _as_list(on)
    rows = table.limit(most_rows + 1).collect()
    if len(rows) <= most_rows:
        local = df.sparkSession.createDataFrame(rows, table.schema)
        return df.join(F.broadcast(local), on, "left")
    spread = list(spread) or [c for c, t in df.dtypes if not t.startswith("map")]
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*spread), F.lit(salts)))
    numbers = F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))
    return salted.join(table.withColumn("_salt", F.explode(numbers)), [*on, "_salt"], "left").drop("_salt")


def lag_join(df: DataFrame, prev: DataFrame, on: str, cols: Sequence[str],
             n: int = 1, year: str = "tax_yr", suffix: str = "_lag") -> DataFrame:
    """Bring the values of `n` years before onto each row."""
    shifted = prev.select(on, (F.col(year) + n).alias(year),
                          *[F.col(c).alias(f"{c}{suffix}{n}") for c in cols])
    return df.join(shifted, [on, year], "left")


def pair_years(df: DataFrame, entity: str, year: str, value: str,
               years: Sequence[int] | None = None) -> DataFrame:
    """Rows with a positive value in both a year and the year before."""
    positive = df.filter(F.col(value) > 0).select(entity, year, value)
    current = positive.withColumnRenamed(value, "av1")
    if years is not None:
        current = current.filter(F.col(year).isin(*years))
    before = positive.select(entity, (F.col(year) + 1).alias(year), F.col(value).alias("av0"))
    return current.join(before, [entity, year], "inner")


def apply_changes(panel: DataFrame, changes: DataFrame, attrs: Mapping[str, str], *,
                  key: str = "parcel_id", year: str = "tax_yr",
                  change_year: str = "eff_yr", attribute: str = "attribute",
                  value: str = "attribute_value", order: Sequence[str] = ("update_date",),
                  carry: str = "until_next") -> DataFrame:
    """Write the last change per (entity, year, attribute) onto the panel.

    Changes with equal `order` are decided by value. `attrs` maps an attribute to the
    panel column it overwrites. With
    `carry="until_next"` a change holds until the next one; with "point" it holds
    in its own year only and the copied baseline returns after it. All attributes
    go through one aggregate, one join and one window per entity's years.
    """
    if carry not in ("until_next", "point"):
        raise ValueError(f"carry must be 'until_next' or 'point', not {carry!r}")
    types = dict(panel.dtypes)
    attrs = {a: c for a, c in attrs.items() if c in types}
    aggs = []
    for a, c in attrs.items():
        hit = F.col(attribute) == a
        at = F.when(hit, F.struct(*order, F.col(value).alias("_value")))
        aggs += [F.max_by(F.col(value), at).alias(f"_new_{c}"),
                 F.max(hit).alias(f"_has_{c}")]
    wide = (changes.filter(F.col(attribute).isin(*attrs))
            .groupBy(F.col(key), F.col(change_year).cast(types[year]).alias(year))
            .agg(*aggs))
    joined = panel.join(wide, [key, year], "left")
    history = (Window.partitionBy(key).orderBy(year)
               .rowsBetween(Window.unboundedPreceding, Window.currentRow))

    def updated(c: str) -> Column:
        new = F.when(F.col(f"_has_{c}"), coerce_like(f"_new_{c}", types[c]))
        if carry == "until_next":
            return F.coalesce(F.last(new, ignorenulls=True).over(history), F.col(c))
        here = F.when(F.col(f"_has_{c}"), new).otherwise(F.col(c))
        return F.last(here, ignorenulls=True).over(history)

    targets = set(attrs.values())
    return joined.select(*[updated(c).alias(c) if c in targets else F.col(c)
                           for c in panel.columns])
