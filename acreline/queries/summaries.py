"""Queries for the aggregate and window operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from acreline.operators import aggregates as ag
from acreline.operators import windows as wn
from acreline.queries.base import GRID_SQL, PANEL_SQL, Tables, dbl, grid, money, panel, query

_K, _Y = "parcel_id", "tax_yr"


# -- aggregates --------------------------------------------------------------

@query("E01", """
SELECT l_orderkey, COUNT(*) AS n_lines, CAST(COALESCE(SUM(CAST(CASE WHEN l_returnflag = 'A' THEN l_quantity END AS DECIMAL(18,2))), 0) AS DOUBLE) AS qty_a,
       MIN(l_linenumber) AS lo, MAX(CASE WHEN l_returnflag = 'R' THEN l_linenumber END) AS hi,
       AVG(CASE WHEN l_returnflag = 'N' THEN l_linenumber END) AS mean_n,
       arg_min(l_suppkey, (l_linenumber, l_partkey, l_suppkey)) AS first_supp FROM lineitem GROUP BY 1""")
def collapse_rows(t: Tables):
    flag = F.col("l_returnflag")
    rows = t.lineitem.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        F.when(flag == "A", money("l_quantity")).alias("qa"),
        F.when(flag == "R", F.col("l_linenumber")).alias("r"),
        F.when(flag == "N", F.col("l_linenumber")).alias("n"))
    return ag.collapse(rows, "l_orderkey", {
        "n_lines": ("count", None), "qty_a": ("sum", "qa"), "lo": ("min", "l_linenumber"),
        "hi": ("max", "r"), "mean_n": ("mean", "n"),
        "first_supp": ("first", "l_suppkey", ["l_linenumber", "l_partkey", "l_suppkey"]),
    }).withColumn("qty_a", F.col("qty_a").cast("double"))


@query("E02", """
SELECT l_suppkey, CAST(COALESCE(SUM(CASE WHEN l_returnflag = 'A' THEN x END), 0) AS DOUBLE) AS a_qty,
       CAST(COALESCE(SUM(CASE WHEN l_returnflag = 'R' THEN x END), 0) AS DOUBLE) AS r_qty
FROM (SELECT l_suppkey, l_returnflag, CAST(l_quantity AS DECIMAL(18,2)) AS x FROM lineitem) GROUP BY 1""")
def sum_by_bucket(t: Tables):
    rows = t.lineitem.select("l_suppkey", "l_returnflag", money("l_quantity").alias("x"))
    sums = ag.sum_by_bucket(rows, "l_suppkey", "l_returnflag", "x", {"A": "a_qty", "R": "r_qty"})
    return sums.select("l_suppkey", dbl("a_qty", "a_qty"), dbl("r_qty", "r_qty"))


@query("E03", """
SELECT l_suppkey, CASE WHEN bad = 0 THEN round(CAST(n AS DOUBLE) / CAST(d AS DOUBLE), 6) END AS price
FROM (SELECT l_suppkey, SUM(x * q) AS n, SUM(CASE WHEN x IS NOT NULL THEN q END) AS d,
             MAX(CASE WHEN x IS NOT NULL AND q IS NULL THEN 1 ELSE 0 END) AS bad
  FROM (SELECT l_suppkey, CASE WHEN l_linenumber < 7 THEN CAST(l_extendedprice AS DECIMAL(12,2)) END AS x,
               CASE WHEN l_partkey <> 7 THEN CAST(l_quantity AS DECIMAL(8,2)) END AS q FROM lineitem) GROUP BY 1)""")
def weighted_mean_price(t: Tables):
    rows = t.lineitem.select(
        "l_suppkey",
        F.when(F.col("l_linenumber") < 7, F.col("l_extendedprice").cast("decimal(12,2)")).alias("x"),
        F.when(F.col("l_partkey") != 7, F.col("l_quantity").cast("decimal(8,2)")).alias("q"))
    return rows.groupBy("l_suppkey").agg(dbl(ag.weighted_mean("x", "q"), "price", 6))


@query("E04", """
SELECT l_suppkey, COUNT(DISTINCT u) + MAX(CASE WHEN u IS NULL THEN 1 ELSE 0 END) AS n_uses
FROM (SELECT l_suppkey, CASE WHEN l_linenumber > 1 THEN l_partkey % 9 END AS u FROM lineitem) GROUP BY 1""")
def distinct_with_null(t: Tables):
    rows = t.lineitem.select("l_suppkey", F.when(F.col("l_linenumber") > 1, F.col("l_partkey") % 9).alias("u"))
    return rows.groupBy("l_suppkey").agg(ag.n_distinct("u").alias("n_uses"))


_PRIORITIES = ("1-URGENT", "2-HIGH", "5-LOW")


@query("E05", """
SELECT CAST(year(o_orderdate) AS INT) AS yr, """ + ", ".join(
    f"CAST(COALESCE(SUM(CASE WHEN o_orderpriority = '{p}' THEN CAST(o_totalprice AS DECIMAL(18,2)) END), 0) AS DOUBLE) AS \"{p}\""
    for p in _PRIORITIES) + " FROM orders GROUP BY 1")
def pivot_wide(t: Tables):
    rows = t.orders.select(F.year("o_orderdate").alias("yr"), "o_orderpriority",
                           money("o_totalprice").alias("x"))
    wide = ag.pivot_wide(rows, "yr", "o_orderpriority", "x", _PRIORITIES, fill=0)
    return wide.select("yr", *[dbl(F.col(f"`{p}`"), p) for p in _PRIORITIES])


@query("E06", """
SELECT c_custkey, 'c_acctbal' AS name, c_acctbal AS value FROM customer
UNION ALL SELECT c_custkey, 'nation', CAST(c_nationkey AS DOUBLE) FROM customer""")
def unpivot_columns(t: Tables):
    rows = t.customer.select("c_custkey", "c_acctbal", F.col("c_nationkey").cast("double").alias("nation"))
    return ag.unpivot(rows, "c_custkey", ["c_acctbal", "nation"])


@query("E07", """
SELECT user_id, event_type, n FROM (
  SELECT user_id, event_type, n, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, seen) AS rn
  FROM (SELECT user_id, event_type, COUNT(*) AS n, MIN(event_id) AS seen FROM events GROUP BY 1, 2)) WHERE rn = 1""")
def mode_of_type(t: Tables):
    return ag.mode_of(t.events, "user_id", "event_type", ["event_id"])


@query("E08", """
SELECT event_type, median(value) AS median FROM events GROUP BY 1
UNION ALL SELECT 'all', median(value) FROM events""")
def median_by_type(t: Tables):
    every = ag.median_by(t.events, [], "value").select(F.lit("all").alias("event_type"), "median")
    return ag.median_by(t.events, "event_type", "value").unionByName(every)


@query("E08", f"WITH {PANEL_SQL} SELECT parcel_id, median(CAST(v AS DOUBLE)) AS median FROM panel GROUP BY 1")
def median_of_years(t: Tables):
    p = panel(t).select(_K, dbl("v", "v"))
    return ag.median_by(p, _K, "v", large=False)


@query("E09", """
SELECT l_orderkey, CAST(MAX(CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END) AS INT) AS ever_land,
       CAST(MAX(CASE WHEN l_returnflag <> 'A' AND l_quantity > 45 THEN 1 ELSE 0 END) AS INT) AS ever_big
FROM lineitem GROUP BY 1""")
def ever_flags(t: Tables):
    return ag.ever(t.lineitem, "l_orderkey", {
        "ever_land": F.col("l_returnflag") == "A",
        "ever_big": (F.col("l_returnflag") != "A") & (F.col("l_quantity") > 45)})


@query("E10", f"""
WITH {PANEL_SQL}, s AS (SELECT tax_yr, c_mktsegment, SUM(v) AS v FROM panel JOIN customer ON c_custkey = parcel_id GROUP BY 1, 2)
SELECT tax_yr, c_mktsegment, CAST(v AS DOUBLE) / CAST(SUM(v) OVER (PARTITION BY tax_yr) AS DOUBLE) AS share FROM s""")
def segment_share(t: Tables):
    return ag.share(_segments(t), _Y, "v", small_groups=True).select(_Y, "c_mktsegment", "share")


@query("E10", """
SELECT event_id, value / total AS share FROM events JOIN (SELECT event_type, CAST(SUM(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS total FROM events GROUP BY 1) USING (event_type)""")
def event_share(t: Tables):
    e = t.events.select("event_id", "event_type", money("value").alias("x"))
    return ag.share(e, "event_type", "x").select("event_id", "share")


def _segments(t: Tables):
    joined = panel(t).join(t.customer.select(F.col("c_custkey").alias(_K), "c_mktsegment"), _K)
    return joined.groupBy(_Y, "c_mktsegment").agg(F.sum("v").alias("v"))


@query("E11", f"""
WITH {PANEL_SQL}, s AS (
  SELECT tax_yr, CAST(n_regionkey AS VARCHAR) AS submarket, CAST(SUM(v) AS DOUBLE) AS volume,
         round(AVG(CAST(v AS DOUBLE)), 4) AS avg_rent, COUNT(*) AS units
  FROM panel JOIN customer ON c_custkey = parcel_id JOIN nation ON n_nationkey = c_nationkey GROUP BY 1, 2)
SELECT tax_yr, submarket, volume, avg_rent, avg_rent AS weighted_rent, units FROM s
UNION ALL SELECT tax_yr, 'CITY_WIDE', round(SUM(volume), 2), round(AVG(avg_rent), 6),
       round(SUM(avg_rent * units) / SUM(units), 6), CAST(SUM(units) AS BIGINT) FROM s GROUP BY 1""")
def city_wide_total(t: Tables):
    places = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("c_custkey").alias(_K), F.col("n_regionkey").cast("string").alias("submarket"))
    rents = panel(t).join(places, _K).groupBy(_Y, "submarket").agg(
        dbl(F.sum("v"), "volume"), dbl(F.avg(F.col("v").cast("double")), "avg_rent", 4),
        F.count(F.lit(1)).alias("units")).withColumn("weighted_rent", F.col("avg_rent"))
    spec = ag.total_spec_by_name(["volume", "avg_rent", "units"])
    total = ag.with_total(rents, _Y, "submarket", spec | {"weighted_rent": ("weighted", "units")})
    city = F.col("submarket") == "CITY_WIDE"
    tidy = {c: F.when(city, F.round(c, n)).otherwise(F.col(c))
            for c, n in (("volume", 2), ("avg_rent", 6), ("weighted_rent", 6))}
    return total.withColumns(tidy)


@query("E12", f"""
WITH {PANEL_SQL}, {GRID_SQL} SELECT tax_yr, COUNT(*) AS n_rows, COUNT(DISTINCT parcel_id) AS n_entities,
       CAST(SUM(CASE WHEN v IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS v_nulls FROM grid GROUP BY 1""")
def coverage_profile(t: Tables):
    return ag.profile(grid(t), _Y, ["v"], _K)


@query("E13", "SELECT event_type, COUNT(*) AS n FROM events GROUP BY 1")
def value_counts(t: Tables):
    return ag.value_counts(t.events, "event_type")


_PRED = "CASE WHEN n_chars > 900 THEN 1 WHEN n_chars > 200 THEN 0 END"


def _labelled(t: Tables):
    return t.labels.join(t.documents.select("doc_id", "lang", F.expr(_PRED).alias("pred")), "doc_id")


@query("E14", f"SELECT quality, {_PRED} AS pred, COUNT(*) AS n FROM labels JOIN documents USING (doc_id) GROUP BY 1, 2")
def confusion_counts(t: Tables):
    return ag.confusion(_labelled(t), "quality", "pred")


@query("E14", f"""
SELECT lang, COUNT(*) AS n, COUNT(p) AS n_predicted, round(AVG(CASE WHEN p IS NOT NULL THEN CAST(p = quality AS INT) END), 9) AS accuracy,
       round(AVG(CASE WHEN p IS NOT NULL THEN 1.0 ELSE 0.0 END), 9) AS coverage
FROM (SELECT lang, quality, {_PRED} AS p FROM labels JOIN documents USING (doc_id)) GROUP BY 1""")
def accuracy_by_language(t: Tables):
    return ag.accuracy(_labelled(t), "quality", "pred", "lang").select(
        "lang", "n", "n_predicted", dbl("accuracy", "accuracy", 9), dbl("coverage", "coverage", 9))


_ERR_SQL = """rows AS (SELECT l_returnflag, ln(l_extendedprice) AS a, ln(l_quantity * p_retailprice) AS p
  FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_extendedprice > 0)"""


@query("E15", f"""
WITH {_ERR_SQL} SELECT l_returnflag, round(sqrt(AVG((a - p) ** 2)), 6) AS rmse_log, round(AVG(abs(a - p)), 6) AS mae_log,
       round(sqrt(AVG((exp(a) - exp(p)) ** 2)), 3) AS rmse, round(AVG(abs(exp(a) - exp(p))), 3) AS mae,
       round(AVG(abs(exp(a) - exp(p)) / greatest(exp(a), 20000)), 6) AS mape,
       round(SUM(abs(exp(a) - exp(p))) / SUM(exp(a)), 6) AS wape FROM rows GROUP BY 1""")
def error_metrics(t: Tables):
    rows = t.lineitem.filter("l_extendedprice > 0").join(
        t.part.select(F.col("p_partkey").alias("l_partkey"), "p_retailprice"), "l_partkey").select(
        "l_returnflag", F.ln("l_extendedprice").alias("a"),
        F.ln(F.col("l_quantity") * F.col("p_retailprice")).alias("p"))
    m = ag.error_metrics(rows, "a", "p", ["l_returnflag"])
    return m.select("l_returnflag", *[dbl(n, n, d) for n, d in (
        ("rmse_log", 6), ("mae_log", 6), ("rmse", 3), ("mae", 3), ("mape", 6), ("wape", 6))])


@query("E16", """
SELECT o_orderpriority AS grp, CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS value, COUNT(*) AS n, 'open' AS source
FROM orders WHERE o_orderstatus = 'O' GROUP BY 1
UNION ALL SELECT o_orderpriority, CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE), COUNT(*), 'filled'
FROM orders WHERE o_orderstatus = 'F' GROUP BY 1
UNION ALL SELECT o_orderpriority, CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE), COUNT(*), 'partial'
FROM orders WHERE o_orderstatus NOT IN ('O', 'F') GROUP BY 1""")
def group_totals(t: Tables):
    status = F.col("o_orderstatus")
    side = lambda kept: t.orders.filter(kept).select(F.col("o_orderpriority").alias("grp"), money("o_totalprice").alias("x"))
    out = ag.group_totals({"open": side(status == "O"), "filled": side(status == "F"),
                           "partial": side(~status.isin("O", "F"))}, "grp", "x")
    return out.withColumn("value", F.col("value").cast("double"))


@query("E17", """
SELECT c_nationkey, COUNT(*) AS n_entities, CAST(SUM(f) AS BIGINT) AS n_flagged, round(100 * AVG(f), 2) AS pct_flagged,
       CAST(SUM(b) AS DOUBLE) AS total_value, CAST(SUM(b * f) AS DOUBLE) AS flagged_value,
       round(100 * (CAST(SUM(b * f) AS DOUBLE) / CAST(SUM(b) AS DOUBLE)), 2) AS pct_value_flagged
FROM (SELECT c_nationkey, CAST(c_custkey % 3 = 0 AS INT) AS f, CAST(c_acctbal AS DECIMAL(18,2)) AS b FROM customer) GROUP BY 1""")
def ownership_share(t: Tables):
    rows = t.customer.select("c_nationkey", (F.col("c_custkey") % 3 == 0).cast("int").alias("is_llc"),
                             money("c_acctbal").alias("total_av"))
    out = ag.ownership_share(rows, "c_nationkey")
    return out.withColumns({c: F.col(c).cast("double") for c in ("total_value", "flagged_value")})


@query("E18", """
SELECT yr, m AS method, COUNT(*) AS n, part FROM (
  SELECT CAST(year(o_orderdate) AS INT) AS yr, o_orderpriority AS m, 'land' AS part FROM orders
  UNION ALL SELECT CAST(year(o_orderdate) AS INT), CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus ELSE 'none' END, 'impr' FROM orders)
GROUP BY 1, 2, 4""")
def method_counts(t: Tables):
    rows = t.orders.select(F.year("o_orderdate").alias("yr"), F.col("o_orderpriority").alias("land_method"),
                           F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderstatus")).alias("impr_method"))
    return ag.method_counts(rows, {"land": "land_method", "impr": "impr_method"}, "yr")


@query("E19", """
WITH q AS (SELECT CAST(year(o_orderdate) AS INT) AS yr, CAST(quarter(o_orderdate) AS INT) AS qtr, COUNT(*) AS n FROM orders GROUP BY 1, 2),
x AS (SELECT yr, qtr, CASE WHEN qtr > 1 THEN n END AS n, 'Q' || qtr AS label FROM q)
SELECT yr, AVG(n) AS n, arg_min(label, qtr) FILTER (n IS NOT NULL) AS label, COUNT(n) AS n_periods FROM x GROUP BY 1""")
def annual_mean(t: Tables):
    q = t.orders.groupBy(F.year("o_orderdate").alias("yr"), F.quarter("o_orderdate").alias("qtr")).agg(
        F.count(F.lit(1)).alias("n"))
    rows = q.select("yr", "qtr", F.when(F.col("qtr") > 1, F.col("n")).alias("n"),
                    F.concat(F.lit("Q"), "qtr").alias("label"))
    return ag.annual_mean(rows, ["n"], "yr", "qtr", "label")


# -- windows -----------------------------------------------------------------

_W = "OVER (PARTITION BY parcel_id ORDER BY tax_yr)"
_PV = f"WITH {PANEL_SQL}, p AS (SELECT parcel_id, tax_yr, CAST(v AS DOUBLE) AS v FROM panel)"
_GV = f"WITH {PANEL_SQL}, {GRID_SQL}, g AS (SELECT parcel_id, tax_yr, CAST(v AS DOUBLE) AS v FROM grid)"


def _pv(t: Tables):
    return panel(t).select(_K, _Y, dbl("v", "v"))


def _gv(t: Tables):
    return grid(t).select(_K, _Y, dbl("v", "v"))


@query("F01", f"""{_PV} SELECT parcel_id, tax_yr, v, lag(v, 1) {_W} AS v_lag1, lag(v, 2) {_W} AS v_lag2,
  lead(v, 1, 0) {_W} AS v_lead1 FROM p""")
def lags_and_leads(t: Tables):
    return wn.lags(_pv(t), _K, _Y, ["v"], [1, 2, -1])


@query("F02", f"{_PV} SELECT parcel_id, tax_yr, round(ln(v) - ln(lag(v) {_W}), 9) AS dlog FROM p")
def log_delta(t: Tables):
    return wn.dlog(_pv(t), _K, _Y, "v").select(_K, _Y, dbl("dlog", "dlog", 9))


@query("F03", f"{_PV} SELECT parcel_id, tax_yr, v, v / lag(v) {_W} - 1 AS yoy FROM p")
def growth_to_previous(t: Tables):
    return wn.yoy(_pv(t), _K, _Y, "v")


@query("F04", f"""{_PV} SELECT parcel_id, tax_yr, v, v_lag FROM (
  SELECT *, lag(v) {_W} AS v_lag, lag(tax_yr) {_W} AS y FROM p) WHERE tax_yr - y = 1""")
def matched_lag(t: Tables):
    return wn.matched_lag(_pv(t), _K, _Y, "v")


@query("F05", f"""{_GV} SELECT parcel_id, tax_yr, last_value(v IGNORE NULLS)
  OVER (PARTITION BY parcel_id ORDER BY tax_yr ROWS UNBOUNDED PRECEDING) AS v FROM g""")
def carry_forward(t: Tables):
    return wn.locf(_gv(t), _K, _Y, ["v"])


@query("F05", """SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS)
  OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS last_purchase FROM events""")
def carry_forward_in_log(t: Tables):
    e = t.events.select("event_id", "user_id", "ts",
                        F.when(F.col("event_type") == "purchase", F.col("value")).alias("last_purchase"))
    return wn.locf(e, "user_id", ["ts", "event_id"], ["last_purchase"],
                   chunk=F.to_date("ts")).select("event_id", "last_purchase")


@query("F06", f"""{_GV} SELECT parcel_id, tax_yr, COALESCE(
  last_value(v IGNORE NULLS) OVER (PARTITION BY parcel_id ORDER BY tax_yr ROWS UNBOUNDED PRECEDING),
  first_value(v IGNORE NULLS) OVER (PARTITION BY parcel_id ORDER BY tax_yr ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS v FROM g""")
def carry_both_ways(t: Tables):
    return wn.fill_both(_gv(t), _K, _Y, ["v"])


@query("F07", f"""WITH {PANEL_SQL}, {GRID_SQL} SELECT parcel_id, tax_yr,
  CAST(SUM(v) OVER (PARTITION BY parcel_id ORDER BY tax_yr ROWS 2 PRECEDING) AS DOUBLE) AS v3,
  CAST(SUM(v) OVER (PARTITION BY parcel_id ORDER BY tax_yr ROWS 4 PRECEDING) AS DOUBLE) AS v5 FROM grid""")
def rolling_sums(t: Tables):
    out = wn.rolling_sum(grid(t), _K, _Y, {"v3": ("v", 3), "v5": ("v", 5)})
    return out.select(_K, _Y, dbl("v3", "v3"), dbl("v5", "v5"))


@query("F08", f"""{_GV} SELECT parcel_id, tax_yr, CASE WHEN COUNT(*) OVER w >= 3 THEN round(AVG(v) OVER w, 4) END AS v3
  FROM g WINDOW w AS (PARTITION BY parcel_id ORDER BY tax_yr ROWS 2 PRECEDING)""")
def rolling_means(t: Tables):
    return wn.rolling_mean(_gv(t), _K, _Y, {"v3": ("v", 3)}).select(_K, _Y, dbl("v3", "v3", 4))


@query("F09", f"""{_GV} SELECT parcel_id, tax_yr, CAST(tax_yr - last_value(CASE WHEN v > 300000 THEN tax_yr END IGNORE NULLS)
  OVER (PARTITION BY parcel_id ORDER BY tax_yr ROWS UNBOUNDED PRECEDING) AS INT) AS since FROM g""")
def years_since_event(t: Tables):
    flagged = _gv(t).withColumn("flag", (F.col("v") > 300000).cast("int"))
    return wn.years_since(flagged, _K, _Y, "flag", "since").select(_K, _Y, "since")


@query("F10", """SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (
  PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1""")
def latest_row(t: Tables):
    return wn.latest(t.events, ["user_id", "event_type"], ["ts", "event_id"]).select(
        "user_id", "event_id", "value")


@query("F11", """SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (
  PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1""")
def last_row(t: Tables):
    return wn.last_row(t.events, "user_id", ["ts", "event_id"]).select("user_id", "event_id", "event_type")


@query("F12", """SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (
  PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events) WHERE rn = 1""")
def first_row(t: Tables):
    return wn.first_row(t.events, "user_id", ["ts", "event_id"]).select("user_id", "event_id", "event_type")


@query("F13", """SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (
  PARTITION BY user_id ORDER BY value DESC, event_id) AS rn FROM events) WHERE rn <= 5""")
def top_n_per_group(t: Tables):
    return wn.top_n(t.events, "user_id", [F.desc("value"), "event_id"], 5).select(
        "user_id", "event_id", "value")


_USES_SQL = "uses AS (SELECT l_orderkey, l_suppkey, p_type, CAST(l_quantity AS DECIMAL(18,2)) AS q FROM lineitem JOIN part ON l_partkey = p_partkey)"


def _uses(t: Tables):
    part = t.part.select(F.col("p_partkey").alias("l_partkey"), "p_type", "p_size")
    return t.lineitem.join(part, "l_partkey").select(
        "l_orderkey", "l_suppkey", "p_type", "p_size", money("l_quantity").alias("q"))


@query("F14", f"""
WITH {_USES_SQL}, s AS (SELECT l_orderkey, p_type, SUM(q) AS w FROM uses GROUP BY 1, 2),
r AS (SELECT *, CAST(w AS DOUBLE) / CAST(SUM(w) OVER (PARTITION BY l_orderkey) AS DOUBLE) AS share,
      row_number() OVER (PARTITION BY l_orderkey ORDER BY w DESC, p_type) AS rn FROM s)
SELECT l_orderkey, p_type, round(share, 6) AS share FROM r WHERE rn = 1 AND share >= 0.5""")
def dominant_use(t: Tables):
    return ag.dominant(_uses(t), "l_orderkey", "p_type", "q").select(
        "l_orderkey", "p_type", dbl("share", "share", 6))


_SOURCES = ["LARGE", "SMALL", "PROMO", "ECONOMY", "MEDIUM", "STANDARD"]
_RANK = "CASE p_type " + " ".join(f"WHEN '{s}' THEN {i}" for i, s in enumerate(_SOURCES, 1)) + " END"


@query("F15", f"""
WITH v AS (SELECT l_orderkey, p_size % 4 AS cat, COUNT(*) AS n, MIN({_RANK}) AS best
           FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)
SELECT l_orderkey, cat, n, CAST(best AS INT) AS best_rank FROM (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY n DESC, best, cat) AS rn FROM v) WHERE rn = 1""")
def category_vote(t: Tables):
    rows = _uses(t).select("l_orderkey", (F.col("p_size") % 4).alias("cat"), "p_type")
    return ag.vote(rows, "l_orderkey", "cat", wn.rank_in("p_type", _SOURCES))


@query("F16", f"""WITH {PANEL_SQL}, {GRID_SQL} SELECT parcel_id, tax_yr, CAST(SUM(v)
  OVER (PARTITION BY parcel_id ORDER BY tax_yr ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS cum FROM grid""")
def running_sum(t: Tables):
    return wn.cum_sum(grid(t), _K, _Y, "v").select(_K, _Y, dbl("cum", "cum"))


@query("F16", """SELECT event_id, CAST(SUM(CAST(value AS DECIMAL(18,2))) OVER (PARTITION BY user_id
  ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS cum FROM events""")
def running_sum_in_log(t: Tables):
    e = t.events.select("event_id", "user_id", "ts", money("value").alias("x"))
    return wn.cum_sum(e, "user_id", ["ts", "event_id"], "x", chunk=F.to_date("ts")).select(
        "event_id", dbl("cum", "cum"))


@query("F17", f"""{_GV}, f AS (SELECT parcel_id, tax_yr, CASE WHEN tax_yr < 1997 OR v IS NOT NULL THEN 1 + COALESCE(v, 0) / 1000000 END AS f FROM g)
SELECT parcel_id, tax_yr, CASE WHEN MAX(CASE WHEN f IS NULL THEN 1 ELSE 0 END) OVER w = 0 THEN round(product(f) OVER w, 9) END AS cum
FROM f WINDOW w AS (PARTITION BY parcel_id ORDER BY tax_yr ROWS UNBOUNDED PRECEDING)""")
def running_product(t: Tables):
    factor = F.when((F.col(_Y) < 1997) | F.col("v").isNotNull(),
                    1 + F.coalesce(F.col("v"), F.lit(0.0)) / 1000000)
    out = wn.cum_prod(_gv(t).withColumn("f", factor), _K, _Y, "f")
    return out.select(_K, _Y, dbl("cum", "cum", 9))


@query("F18", """SELECT l_orderkey, l_linenumber, l_partkey FROM (SELECT *, MIN(l_linenumber) OVER (
  PARTITION BY l_orderkey) AS m FROM lineitem) WHERE l_linenumber = m""")
def rows_at_minimum(t: Tables):
    return wn.rows_at_min(t.lineitem, "l_orderkey", "l_linenumber").select(
        "l_orderkey", "l_linenumber", "l_partkey")


QUARTERS_SQL = """q AS (SELECT o_orderpriority AS sub, CAST(year(o_orderdate) AS INT) AS yr, CAST(quarter(o_orderdate) AS INT) AS qn,
  SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS x, COUNT(*) AS n FROM orders GROUP BY 1, 2, 3)"""


def quarters(t: Tables):
    return t.orders.groupBy(F.col("o_orderpriority").alias("sub"), F.year("o_orderdate").alias("yr"),
                            F.quarter("o_orderdate").alias("qn")).agg(
        F.sum(money("o_totalprice")).alias("x"), F.count(F.lit(1)).alias("n"))


@query("F19", f"""WITH {QUARTERS_SQL} SELECT sub, yr, CAST(s AS DOUBLE) AS lagged_sum FROM (
  SELECT sub, yr, qn, lag(x, 2) OVER w + lag(x, 3) OVER w + lag(x, 4) OVER w + lag(x, 5) OVER w AS s
  FROM q WINDOW w AS (PARTITION BY sub ORDER BY yr, qn)) WHERE qn = 1""")
def lagged_quarter_sum(t: Tables):
    out = wn.lagged_sum(quarters(t), "sub", ["yr", "qn"], "x", at=F.col("qn") == 1)
    return out.select("sub", "yr", dbl("lagged_sum", "lagged_sum"))


@query("F20", "SELECT p_partkey, CAST(list_position(['LARGE', 'SMALL', 'PROMO'], p_type) AS INT) AS rank FROM part")
def rank_in_list(t: Tables):
    return t.part.select("p_partkey", wn.rank_in("p_type", ["LARGE", "SMALL", "PROMO"]).alias("rank"))
