"""Running totals and carries over ordered groups of any length.

A window with only `partitionBy(keys)` puts a whole group into one task. That is
fine for a panel, where a group is one entity's years. For logs and text lines a
single key can hold a third of all rows, so `running` also takes a `chunk`: an
expression that does not fall as `order` rises (line number / 10,000, a day, a
year). Rows are scanned per (keys, chunk), the chunk totals are scanned per key,
and the carry is joined back. No task sees more than a chunk or the list of
chunk totals, and the result is the same.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from acreline.functions.cleaning import ColumnLike, col

_AGG = {
    "sum": F.sum, "max": F.max, "min": F.min, "product": F.product,
    "last": lambda c: F.last(c, ignorenulls=True),
    "first": lambda c: F.first(c, ignorenulls=True),
}


def _combine(fn: str, carry: Column, here: Column) -> Column:
    if fn == "sum":
        return F.coalesce(carry + here, carry, here)
    if fn == "product":
        return F.coalesce(carry * here, carry, here)
    if fn == "max":
        return F.greatest(carry, here)
    if fn == "min":
        return F.least(carry, here)
    return F.coalesce(here, carry) if fn == "last" else F.coalesce(carry, here)


def running(df: DataFrame, keys: Sequence[str], order: str | Sequence[str],
            specs: Mapping[str, tuple[str, ColumnLike]],
            chunk: Column | None = None) -> DataFrame:
    """Add `specs` = {out: (fn, column)} scanned over rows up to the current one.

    `fn` is sum, product, max, min, last or first; NULLs are skipped. `order`
    must be total within a group.
    """
    order = [order] if isinstance(order, str) else list(order)
    to_here = (Window.unboundedPreceding, Window.currentRow)
    if chunk is None:
        w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(*to_here)
        return df.withColumns({o: _AGG[fn](col(c)).over(w) for o, (fn, c) in specs.items()})

    chunked = df.withColumn("_chunk", chunk)
    within = Window.partitionBy(*keys, "_chunk").orderBy(*order).rowsBetween(*to_here)
    local = chunked.withColumns(
        {f"_here_{o}": _AGG[fn](col(c)).over(within) for o, (fn, c) in specs.items()})

    def total(fn, c):
        # Order matters for first/last only: take the value at the extreme order.
        if fn in ("first", "last"):
            at = F.when(col(c).isNotNull(), F.struct(*order))
            return (F.max_by if fn == "last" else F.min_by)(col(c), at)
        return _AGG[fn](col(c))

    totals = chunked.groupBy(*keys, "_chunk").agg(
        *[total(fn, c).alias(f"_total_{o}") for o, (fn, c) in specs.items()])
    before = (Window.partitionBy(*keys).orderBy("_chunk")
              .rowsBetween(Window.unboundedPreceding, -1))
    carry = totals.select(
        *[F.col(k).alias(f"_key_{k}") for k in keys],
        F.col("_chunk").alias("_key_chunk"),
        *[_AGG[fn](F.col(f"_total_{o}")).over(before).alias(f"_carry_{o}")
          for o, (fn, _) in specs.items()])
    match = F.col("_chunk").eqNullSafe(F.col("_key_chunk"))
    for k in keys:
        match = match & F.col(k).eqNullSafe(F.col(f"_key_{k}"))
    out = {o: _combine(fn, F.col(f"_carry_{o}"), F.col(f"_here_{o}"))
           for o, (fn, _) in specs.items()}
    return (local.join(carry, match, "left")
            .select(*[F.col(c) for c in df.columns if c not in out],
                    *[v.alias(o) for o, v in out.items()]))
