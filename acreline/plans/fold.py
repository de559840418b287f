"""Entity folds: one row per entity with its years in an array of structs.

A panel that meets several yearly sources would be shuffled on (entity, year) for each join and on the
entity for each window. Here it is folded once to a row per entity; every source is aggregated
straight to the entity, one array per measure with an element for each year, combined on the map
side; both meet on the entity alone, and the rows come out again still dealt by entity, so the
windows that follow need no shuffle either. A row holds one entity's years, never more.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY, YEAR = "parcel_id", "tax_yr"
_ROWS = "_rows"

Measure = Callable[[Column], Column]


def total(value: Column) -> Measure:
    return lambda here: F.sum(F.when(here, value))


def times(value: Column | None = None) -> Measure:
    """Rows of the year, or those with a value."""
    return lambda here: F.count(F.when(here, F.lit(1) if value is None else value))


def greatest(value: Column) -> Measure:
    return lambda here: F.max(F.when(here, value))


def annual(source: DataFrame, years: Sequence[int], measures: Mapping[str, Measure],
           year: Column | str = YEAR, key: str = KEY, whole: Mapping[str, Column] | None = None) -> DataFrame:
    """(key, one array per measure): element i is the measure over the rows of years[i].

    `year` is the row's year, or a function of a year that tells whether the row counts in it, so
    an interval counts in all of its years without being expanded. `whole` are further aggregates over
    all years. Fixed-size buffers are combined before the one shuffle, on the key.
    """
    within = year if callable(year) and not isinstance(year, Column) else (
        lambda y: (F.col(year) if isinstance(year, str) else year) == y)
    arrays = [F.array(*[measure(within(y)) for y in years]).alias(name) for name, measure in measures.items()]
    return source.filter(F.col(key).isNotNull()).groupBy(key).agg(
        *arrays, *[c.alias(name) for name, c in (whole or {}).items()])


def by_year(rows: DataFrame, name: str, cols: Sequence[str], year: str = YEAR, key: str = KEY) -> DataFrame:
    """(key, name): rows that are one per entity and year as a map from the year to a struct of `cols`.

    For sources whose rows are not those of known years. Rows already dealt by entity stay where they are.
    """
    entry = F.struct(F.col(year), F.struct(*cols))
    return rows.groupBy(key).agg(F.map_from_entries(F.collect_list(entry)).alias(name))


def fold(panel: DataFrame, key: str = KEY, year: str = YEAR) -> DataFrame:
    """(key, rows): a panel's rows of one entity in one array, by year."""
    cols = [year, *[c for c in panel.columns if c not in (key, year)]]
    return panel.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*cols)),
                                               lambda a, b: F.when(a[year] < b[year], -1).when(a[year] > b[year], 1)
                                               .otherwise(0)).alias(_ROWS))


def unfold(folded: DataFrame, values: Callable[[Column], Mapping[str, Column]] | None = None, key: str = KEY,
           keep: Sequence[str] = ()) -> DataFrame:
    """A row per year again; `values` gives further columns from a year's struct and the entity's columns.

    Arrays are looked up inside the fold, so they are not copied into every row.
    """
    cols = [f.name for f in folded.schema[_ROWS].dataType.elementType.fields]

    def row(r: Column) -> Column:
        new = values(r) if values else {}
        return F.struct(*[r[c].alias(c) for c in cols if c not in new], *[v.alias(c) for c, v in new.items()])

    return folded.select(key, *keep, F.inline(F.transform(_ROWS, row)))


def at_year(array: str, r: Column, years: Sequence[int], year: str = YEAR) -> Column:
    """The element of the row's year; NULL in other years."""
    return F.get(F.col(array), r[year] - years[0])


def attach(panel: DataFrame, sources: Sequence[DataFrame], years: Sequence[int], fill: Mapping[str, object] | None = None,
           key: str = KEY, year: str = YEAR) -> DataFrame:
    """The panel with the arrays of `annual` sources as yearly columns, other columns per entity.

    Columns of these names are replaced. `fill` gives values in place of NULL. The panel has one row
    per entity and year; years without an element have NULL.
    """
    fill = dict(fill or {})
    arrays, whole = [], []
    for s in sources:
        for f in s.schema.fields:
            if f.name != key:
                (arrays if f.dataType.typeName() == "array" else whole).append(f)
    names = {f.name for f in arrays + whole}
    folded = fold(panel.drop(*names), key, year)
    for s in sources:
        folded = folded.join(s, key, "left")

    def filled(name: str, kind, value: Column) -> Column:
        return F.coalesce(value, F.lit(fill[name]).cast(kind)) if name in fill else value

    def values(r: Column) -> dict[str, Column]:
        return ({f.name: filled(f.name, f.dataType.elementType, at_year(f.name, r, years, year)) for f in arrays}
                | {f.name: filled(f.name, f.dataType, F.col(f.name)) for f in whole})

    return unfold(folded, values, key)


def last_changes(changes: DataFrame, years: Sequence[int], attrs: Mapping[str, str], order: Sequence[str],
                 year: str = "eff_yr", attribute: str = "attribute", value: str = "attribute_value",
                 key: str = KEY) -> DataFrame:
    """(key, _changes_<column>): by year the last change of each attribute, as a struct, or NULL.

    Changes with equal `order` are decided by value.
    """
    def last(a: str) -> Measure:
        return lambda here: F.max(F.when(here & (F.col(attribute) == a), F.struct(*order, F.col(value).alias("_value"))))

    return annual(changes.filter(F.col(attribute).isin(*attrs)), years,
                  {f"_changes_{c}": last(a) for a, c in attrs.items()}, year, key)
