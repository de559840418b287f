"""Grouped summaries.

Every summary combines on the map side before it shuffles, so a group that holds
a large share of the rows costs one partial row per task. Group totals are joined
back to rows (an equi-join that adaptive execution can split) instead of being
computed in a window, which would bring a whole group to one task.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from acreline.functions.cleaning import ColumnLike, col
from acreline.functions.codes import MAPE_FLOOR, RATE_NAME_PATTERN


def _keys(keys: str | Sequence[str]) -> list[str]:
    return [keys] if isinstance(keys, str) else list(keys)


def with_group(df: DataFrame, keys, aggs: Mapping[str, Column]) -> DataFrame:
    """Add group aggregates to every row; NULL keys form a group."""
    keys = _keys(keys)
    named = [c.alias(name) for name, c in aggs.items()]
    if not keys:
        return df.withColumns({name: df.agg(c).scalar() for name, c in aggs.items()})
    totals = df.groupBy(*keys).agg(*named)
    totals = totals.withColumnsRenamed({k: f"_group_{k}" for k in keys})
    match = None
    for k in keys:
        same = F.col(k).eqNullSafe(F.col(f"_group_{k}"))
        match = same if match is None else match & same
    return df.join(totals, match).drop(*[f"_group_{k}" for k in keys])


# -- column forms ------------------------------------------------------------

def sum0(c: ColumnLike) -> Column:
    """Sum that is 0, not NULL, over nothing."""
    return F.coalesce(F.sum(col(c)), F.lit(0))


def weighted_mean(x: ColumnLike, w: ColumnLike) -> Column:
    """Mean of `x` by `w` over rows with `x`; a missing weight there gives NULL."""
    value, weight = col(x), col(w)
    has = value.isNotNull()
    total = F.try_divide(F.sum(F.when(has, value * weight)), F.sum(F.when(has, weight)))
    return F.when(F.max((has & weight.isNull()).cast("int")) == 0, total)


def n_distinct(c: ColumnLike) -> Column:
    """Distinct count in which NULL is one value."""
    value = col(c)
    return F.count_distinct(value) + F.max(F.when(value.isNull(), 1).otherwise(0))


# -- collapse ----------------------------------------------------------------

def collapse(df: DataFrame, keys, spec: Mapping[str, tuple]) -> DataFrame:
    """Collapse rows to `keys` by `spec` = {out: (fn, column[, order columns])}.

    `fn` is count, sum, mean, min, max, n_distinct or first. `first` takes the
    value at the smallest `order`.
    """
    forms = {
        "count": lambda c, o: F.count(F.lit(1)),
        "sum": lambda c, o: sum0(c),
        "mean": lambda c, o: F.avg(c),
        "min": lambda c, o: F.min(c),
        "max": lambda c, o: F.max(c),
        "n_distinct": lambda c, o: n_distinct(c),
        "first": lambda c, o: F.min_by(c, F.struct(*o)),
    }
    aggs = []
    for out, (fn, column, *order) in spec.items():
        aggs.append(forms[fn](column, order[0] if order else None).alias(out))
    return df.groupBy(*_keys(keys)).agg(*aggs)


def sum_by_bucket(df: DataFrame, keys, bucket: str, value: str,
                  buckets: Mapping[object, str]) -> DataFrame:
    """One summed column per listed bucket; 0 where a group has no such row."""
    return df.groupBy(*_keys(keys)).agg(
        *[sum0(F.when(F.col(bucket) == b, F.col(value))).alias(out)
          for b, out in buckets.items()])


def pivot_wide(df: DataFrame, keys, name: str, value: str, names: Sequence,
               fill=None) -> DataFrame:
    """Long to wide by sum over a known list of names."""
    wide = df.groupBy(*_keys(keys)).pivot(name, list(names)).agg(F.sum(value))
    cols = [str(n) for n in names]
    return wide if fill is None else wide.na.fill(fill, subset=cols)


def unpivot(df: DataFrame, ids, cols: Sequence[str], name: str = "name",
            value: str = "value") -> DataFrame:
    return df.unpivot(_keys(ids), list(cols), name, value)


# -- most frequent, middle, heaviest -----------------------------------------

def mode_of(df: DataFrame, keys, c: str, order: Sequence[str]) -> DataFrame:
    """Most frequent value per group; of equals, the one seen first by `order`."""
    keys = _keys(keys)
    counts = (df.filter(F.col(c).isNotNull()).groupBy(*keys, c)
              .agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(*order)).alias("seen")))
    best = F.min(F.struct((-F.col("n")).alias("neg"), "seen", F.col(c).alias("value")))
    return counts.groupBy(*keys).agg(best.alias("best")).select(
        *keys, F.col("best.value").alias(c), (-F.col("best.neg")).alias("n"))


def median_by(df: DataFrame, keys, c: str, out: str = "median", large: bool = True,
              accuracy: int = 10_000, slack: float = 3, ways: int = 32) -> DataFrame:
    """Exact interpolated median per group.

    With `large=False` this is `percentile`, which holds a group's distinct
    values in one task: right for groups that are small by construction, such as
    the years of one entity. Otherwise a quantile sketch, whose rank error is at
    most 1 / `accuracy`, gives each group a bracket around its median, cut into `ways` ranges. A
    second pass counts the values by range, and the values themselves only inside the bracket. The
    ranges' counts say which of them holds the median, and only its values are ranked: no task
    ranks a whole bracket. A median outside its bracket, which the sketch rules out, is an error.
    The plan is the same for every size.
    """
    keys = _keys(keys)
    if not large:
        return df.groupBy(*keys).agg(F.expr(f"percentile(`{c}`, 0.5)").alias(out))
    values = df.filter(F.col(c).isNotNull()).select(*keys, F.col(c).cast("double").alias("_v"))
    shares = [min(max(0.5 + slack / accuracy * (2 * i / ways - 1), 0.0), 1.0) for i in range(ways + 1)]
    sketch = F.percentile_approx("_v", shares, F.lit(accuracy)).alias("_cuts")
    cuts = values.groupBy(*keys).agg(sketch)
    placed = _with_keys(values, cuts, keys) if keys else values.withColumn("_cuts", cuts.scalar())
    low, high = F.get("_cuts", F.lit(0)), F.get("_cuts", F.lit(ways))
    # Range 0 lies below the first cut, the last one above the last; what is inside falls between two cuts.
    last = ways + 2
    inside = F.size(F.filter("_cuts", lambda x: x <= F.col("_v")))
    side = F.when(F.col("_v") < low, 0).when(F.col("_v") > high, last).otherwise(inside)
    # One row for all values below, one for all above, and one per value inside.
    counts = (placed.withColumn("_range", side)
              .withColumn("_v", F.when(F.col("_range").between(1, last - 1), F.col("_v")))
              .groupBy(*keys, "_range", "_v").agg(F.count(F.lit(1)).alias("_here")))
    sizes = counts.groupBy(*keys, "_range").agg(F.sum("_here").alias("_size"))
    # A few ranges per group.
    group = Window.partitionBy(*keys)
    sizes = sizes.withColumns({"_n": F.sum("_size").over(group),
                               "_before": F.sum("_size").over(group.orderBy("_range")) - F.col("_size")})
    lower, upper = F.floor((F.col("_n") + 1) / 2), F.ceil((F.col("_n") + 1) / 2)
    held = sizes.filter((F.col("_before") < upper) & (F.col("_before") + F.col("_size") >= lower))
    held = held.withColumn("_before", F.when(F.col("_range").isin(0, last), F.raise_error(
        F.lit("the median lies outside its bracket; raise slack"))).otherwise(F.col("_before")))
    upto = F.sum("_here").over(Window.partitionBy(*keys, "_range").orderBy("_v").rowsBetween(
        Window.unboundedPreceding, Window.currentRow))
    ranked = _with_keys(counts, held, [*keys, "_range"]).withColumn("_upto", F.col("_before") + upto)
    start = F.col("_upto") - F.col("_here")

    def holds(rank):
        return (start < rank) & (rank <= F.col("_upto"))

    return ranked.groupBy(*keys).agg(
        ((F.max(F.when(holds(lower), F.col("_v")))
          + F.max(F.when(holds(upper), F.col("_v")))) / 2).alias(out))


def _with_keys(df: DataFrame, groups: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows with their group's columns; NULL keys form a group."""
    renamed = groups.withColumnsRenamed({k: f"_of_{k}" for k in keys})
    match = F.lit(True)
    for k in keys:
        match = match & F.col(k).eqNullSafe(F.col(f"_of_{k}"))
    return df.join(renamed, match).drop(*[f"_of_{k}" for k in keys])


def medians(df: DataFrame, cols: Sequence[str], accuracy: int = 10_000, slack: float = 3,
            most: int = 100_000) -> dict[str, float | None]:
    """Exact interpolated medians of many columns at once; None where a column has no value.

    One aggregate brackets all of them by a sketch. A second one counts what lies below and on the
    ends of each bracket and brings the values between them, of which there are few. A column so
    long that these would be more than `most` first has its bracket narrowed by a sketch of the
    inside, one that was missed gets a wider one: each such round is one more aggregate for all
    columns that are still open. Rows are never unpivoted.
    """
    value = {c: F.col(f"`{c}`").cast("double") for c in cols}
    found: dict[str, float | None] = {}

    def around(share: float, width: float) -> list[float]:
        return [min(max(share - width, 0.0), 1.0), min(max(share + width, 0.0), 1.0)]

    def aggregate(aggs: Mapping[str, Column]) -> dict:
        return df.agg(*[a.alias(f"m{i}") for i, a in enumerate(aggs.values())]).first().asDict(True)

    open_ = {c: F.struct(F.count(v).alias("n"), F.percentile_approx(
        v, around(0.5, slack / accuracy), F.lit(accuracy)).alias("ends")) for c, v in value.items()}
    rows = dict(zip(open_, aggregate(open_).values())) if open_ else {}
    state = {c: (r["n"], *r["ends"]) for c, r in rows.items() if r["n"]}
    found |= {c: None for c, r in rows.items() if not r["n"]}
    # How many values a bracket may hold, by what the sketch promises.
    expected = {c: 2 * (slack + 1) / accuracy * n for c, (n, _, _) in state.items()}
    widen, room = slack, 1000 // accuracy + 1
    while state:
        aggs = {}
        for c, (n, low, high) in state.items():
            v = value[c]
            within = F.when((v > low) & (v < high), v)
            inner = (F.collect_list(within) if expected[c] <= most
                     else F.percentile_approx(within, [i / 1000 for i in range(1001)], F.lit(accuracy)))
            aggs[c] = F.struct(F.count_if(v < low).alias("below"), F.count_if(v == low).alias("low"),
                               F.count(within).alias("inside"), F.count_if(v == high).alias("high"), inner.alias("values"))
        again = {}
        for (c, (n, low, high)), r in zip(state.items(), aggregate(aggs).values()):
            ranks = ((n + 1) // 2, n // 2 + 1)
            start, end = r["below"] + r["low"], r["below"] + r["low"] + r["inside"]
            last = end + (r["high"] if high > low else 0)
            if ranks[0] <= r["below"] or ranks[1] > last:  # missed: everything but the far ends
                widen = 10 * max(widen, 1)
                share = min(widen / accuracy, 0.5)
                ends = df.agg(F.percentile_approx(value[c], around(0.5, share), F.lit(accuracy))).first()[0]
                again[c], expected[c] = (n, *ends), 2 * share * n
                continue
            def at(rank):
                if rank <= start:
                    return low
                return sorted(r["values"])[rank - start - 1] if rank <= end else high
            if expected[c] <= most or not any(start < k <= end for k in ranks):
                found[c] = (at(ranks[0]) + at(ranks[1])) / 2
                continue
            # Narrow by the inside's own quantiles, with room for the sketch's error on either side.
            first, final = (int((k - start) / r["inside"] * 1000) for k in ranks)
            ends = (r["values"][first - room] if first >= room else low,
                    r["values"][final + 1 + room] if final + 1 + room <= 1000 else high)
            again[c] = (n, *ends)
            # A bracket that does not shrink is brought whole.
            expected[c] = r["inside"] * (2 * room + 2) / 1000 if ends != (low, high) else 0
        state = again
    return {c: found[c] for c in cols}


def dominant(df: DataFrame, keys, cat: str, weight: str, min_share: float = 0.5) -> DataFrame:
    """Category with the largest weight per group if its share is large enough."""
    keys = _keys(keys)
    sums = df.groupBy(*keys, cat).agg(F.sum(weight).alias("w"))
    best = F.min(F.struct((-F.col("w")).alias("neg"), F.col(cat).alias("cat")))
    top = sums.groupBy(*keys).agg(best.alias("best"), F.sum("w").alias("total"))
    share = -F.col("best.neg") / F.col("total")
    return (top.select(*keys, F.col("best.cat").alias(cat),
                       share.cast("double").alias("share"))
            .filter(F.col("share") >= min_share))


def vote(df: DataFrame, keys, cat: str, rank: ColumnLike) -> DataFrame:
    """Category with most rows per group; ties go to the best source rank."""
    keys = _keys(keys)
    votes = df.groupBy(*keys, cat).agg(
        F.count(F.lit(1)).alias("n"), F.min(col(rank)).alias("best_rank"))
    best = F.min(F.struct((-F.col("n")).alias("neg"), "best_rank", F.col(cat).alias("cat")))
    return votes.groupBy(*keys).agg(best.alias("best")).select(
        *keys, F.col("best.cat").alias(cat), (-F.col("best.neg")).alias("n"),
        F.col("best.best_rank").alias("best_rank"))


# -- flags and shares --------------------------------------------------------

def ever(df: DataFrame, keys, flags: Mapping[str, Column]) -> DataFrame:
    """0/1 flags that say whether any row of a group meets a condition."""
    return df.groupBy(*_keys(keys)).agg(
        *[F.coalesce(F.bool_or(c), F.lit(False)).cast("int").alias(n)
          for n, c in flags.items()])


def share(df: DataFrame, keys, value: str, out: str = "share",
          small_groups: bool = False) -> DataFrame:
    """Each row's share of its group total.

    `small_groups` says that a group is small by construction, such as the tracks
    of one year; then one window does it.
    """
    if small_groups:
        whole = F.sum(value).over(Window.partitionBy(*_keys(keys)))
        return df.withColumn(out, _ratio(F.col(value), whole))
    joined = with_group(df, keys, {"_total": F.sum(value)})
    return joined.withColumn(out, _ratio(F.col(value), F.col("_total"))).drop("_total")


def total_spec_by_name(cols: Sequence[str]) -> dict[str, str]:
    """Preset: columns named like rates or prices are averaged, others summed."""
    return {c: "mean" if re.search(RATE_NAME_PATTERN, c) else "sum" for c in cols}


def with_total(df: DataFrame, keys, member: str, spec: Mapping[str, object],
               label: str = "CITY_WIDE") -> DataFrame:
    """Append one row per group over all members.

    `spec` gives "mean", "sum" or ("weighted", weight column) per value column.
    """
    keys = _keys(keys)
    aggs = []
    for c, how in spec.items():
        if how == "mean":
            agg = F.avg(c)
        elif how == "sum":
            agg = sum0(c)
        else:
            agg = weighted_mean(c, how[1])
        aggs.append(agg.cast(dict(df.dtypes)[c]).alias(c))
    total = df.groupBy(*keys).agg(*aggs).withColumn(member, F.lit(label))
    return df.unionByName(total, allowMissingColumns=True)


# -- profiles and metrics ----------------------------------------------------

def profile(df: DataFrame, keys, cols: Sequence[str], entity: str) -> DataFrame:
    """Rows, distinct entities and NULLs per column."""
    return df.groupBy(*_keys(keys)).agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct(entity).alias("n_entities"),
        *[F.sum(F.col(c).isNull().cast("int")).alias(f"{c}_nulls") for c in cols])


def value_counts(df: DataFrame, *cols: str) -> DataFrame:
    return df.groupBy(*cols).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), *cols)


def confusion(df: DataFrame, truth: str, pred: str) -> DataFrame:
    """Truth by prediction counts; an absent prediction is its own column value."""
    return df.groupBy(truth, pred).agg(F.count(F.lit(1)).alias("n"))


def accuracy(df: DataFrame, truth: str, pred: str, tier: str | None = None) -> DataFrame:
    """Accuracy of the predicted rows and coverage, overall or per tier."""
    hit = F.when(F.col(pred).isNotNull(), (F.col(pred) == F.col(truth)).cast("double"))
    return df.groupBy(*([tier] if tier else [])).agg(
        F.count(F.lit(1)).alias("n"), F.count(pred).alias("n_predicted"),
        F.avg(hit).alias("accuracy"),
        F.avg(F.col(pred).isNotNull().cast("double")).alias("coverage"))


def error_metrics(df: DataFrame, actual_log: str, pred_log: str, by=(),
                  floor: float = MAPE_FLOOR) -> DataFrame:
    """RMSE and MAE in logs and levels, floored MAPE, WAPE."""
    gap_log = F.col(actual_log) - F.col(pred_log)
    actual, pred = F.exp(actual_log), F.exp(pred_log)
    gap = F.abs(actual - pred)
    return df.groupBy(*_keys(by)).agg(
        F.sqrt(F.avg(gap_log * gap_log)).alias("rmse_log"),
        F.avg(F.abs(gap_log)).alias("mae_log"),
        F.sqrt(F.avg(gap * gap)).alias("rmse"), F.avg(gap).alias("mae"),
        F.avg(gap / F.greatest(actual, F.lit(float(floor)))).alias("mape"),
        F.try_divide(F.sum(gap), F.sum(actual)).alias("wape"))


def group_totals(sources: Mapping[str, DataFrame], group: str, value: str) -> DataFrame:
    """Value and row count per group, labelled by source and stacked."""
    parts = [df.groupBy(group).agg(sum0(value).alias("value"),
                                   F.count(F.lit(1)).alias("n"))
             .withColumn("source", F.lit(name)) for name, df in sources.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def ownership_share(df: DataFrame, by, flag: str = "is_llc", value: str = "total_av") -> DataFrame:
    """Entities and value held by flagged owners, with percentages."""
    held = F.sum(F.col(value) * F.col(flag))
    return df.groupBy(*_keys(by)).agg(
        F.count(F.lit(1)).alias("n_entities"), F.sum(flag).alias("n_flagged"),
        F.round(100 * F.avg(flag), 2).alias("pct_flagged"),
        F.sum(value).alias("total_value"), held.alias("flagged_value"),
        F.round(100 * _ratio(held, F.sum(value)), 2).alias("pct_value_flagged"))


def _ratio(n: Column, d: Column) -> Column:
    return F.try_divide(n.cast("double"), d.cast("double"))


def method_counts(df: DataFrame, methods: Mapping[str, str], year: str = "tax_yr") -> DataFrame:
    """Rows per year and method; `methods` maps a label to its method column."""
    parts = None
    for label, c in methods.items():
        part = df.groupBy(year, F.coalesce(F.col(c), F.lit("none")).alias("method")).agg(
            F.count(F.lit(1)).alias("n")).withColumn("part", F.lit(label))
        parts = part if parts is None else parts.unionByName(part)
    return parts


def annual_mean(df: DataFrame, values: Sequence[str], year: str, order: str,
                label: str | None = None, label_value: str | None = None) -> DataFrame:
    """Mean of the available periods per year, with the first usable label."""
    aggs = [F.avg(c).alias(c) for c in values]
    if label:
        known = F.col(label_value or values[0]).isNotNull()
        aggs += [F.min_by(F.col(label), F.when(known, F.col(order))).alias(label),
                 F.sum(known.cast("int")).alias("n_periods")]
    return df.groupBy(year).agg(*aggs)

