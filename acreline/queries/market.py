"""Queries for market and construction series and for the checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from acreline.functions import codes
from acreline.operators import checks as ck
from acreline.operators import series as se
from acreline.queries.base import (PANEL_SQL, PARTS_SQL, Tables, dbl, money, panel, parts,
                                   query)
from acreline.queries.summaries import QUARTERS_SQL, quarters
from acreline.sources.tables import code_table


@query("H01", f"""
WITH {QUARTERS_SQL}, x AS (SELECT *, CASE WHEN qn = 1 THEN yr ELSE yr + 1 END AS tax_yr FROM q WHERE NOT (yr = 1998 AND qn = 3 AND sub = '5-LOW'))
SELECT sub, CAST(tax_yr AS INT) AS tax_yr, MAX(CASE WHEN qn = 1 THEN n END) AS n,
       CAST(CASE WHEN COUNT(*) = 4 THEN SUM(x) END AS DOUBLE) AS x
FROM x GROUP BY 1, 2 HAVING MAX(CASE WHEN qn = 1 THEN 1 ELSE 0 END) = 1""")
def annualize_quarters(t: Tables):
    q = quarters(t).filter("NOT (yr = 1998 AND qn = 3 AND sub = '5-LOW')")
    out = se.annualize(q, ["sub"], "yr", "qn", ["n"], ["x"], 4)
    return out.withColumn("x", F.col("x").cast("double"))


_MONTHS_SQL = """m AS (SELECT o_orderpriority AS sub, CAST(year(o_orderdate) AS INT) AS yr, CAST(month(o_orderdate) AS INT) AS mn,
  SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS x, COUNT(*) AS n FROM orders GROUP BY 1, 2, 3)"""


def _months(t: Tables):
    return t.orders.groupBy(F.col("o_orderpriority").alias("sub"), F.year("o_orderdate").alias("yr"),
                            F.month("o_orderdate").alias("mn")).agg(
        F.sum(money("o_totalprice")).alias("x"), F.count(F.lit(1)).alias("n"))


@query("H02", f"""
WITH {_MONTHS_SQL}, x AS (SELECT *, CASE WHEN mn = 1 THEN yr ELSE yr + 1 END AS tax_yr FROM m)
SELECT sub, CAST(tax_yr AS INT) AS tax_yr, MAX(CASE WHEN mn = 1 THEN n END) AS n,
       CAST(CASE WHEN COUNT(*) = 12 THEN SUM(x) END AS DOUBLE) AS x
FROM x GROUP BY 1, 2 HAVING MAX(CASE WHEN mn = 1 THEN 1 ELSE 0 END) = 1""")
def annualize_months(t: Tables):
    out = se.annualize(_months(t), ["sub"], "yr", "mn", ["n"], ["x"], 12)
    return out.withColumn("x", F.col("x").cast("double"))


@query("H03", f"""
WITH {QUARTERS_SQL} SELECT yr AS year, qn AS qtr, sub AS submarket, CAST(n AS DOUBLE) AS cs_deals,
  CASE WHEN n % 3 = 0 THEN NULL ELSE CAST(n * 2 AS DOUBLE) END AS cs_units FROM q WHERE qn < 4""")
def renamed_series(t: Tables):
    q = quarters(t)
    raw = q.select(
        F.concat(F.col("yr"), F.lit(" Q"), F.col("qn"), F.when(F.col("qn") == 4, " QTD").otherwise("")).alias("Period"),
        F.concat(F.lit("City - "), "sub").alias("Geography Name"), F.col("n").cast("string").alias("Deals"),
        F.when(F.col("n") % 3 == 0, "n/a").otherwise((F.col("n") * 2).cast("string")).alias("Units"))
    return se.rename_series(raw, {"Deals": "cs_deals", "Units": "cs_units", "Rent": "cs_rent"},
                            strip="^City - ")


@query("H04", f"""
WITH {QUARTERS_SQL}, x AS (SELECT sub, yr, qn, CASE WHEN n % 3 = 0 THEN n END AS a, CASE WHEN n % 2 = 0 THEN n * 10 END AS b,
                                  CASE WHEN n % 5 > 0 THEN n * 100 END AS c FROM q)
SELECT sub, yr, qn, COALESCE(a, b, c) AS value, CASE WHEN a IS NOT NULL THEN 'CITY' WHEN b IS NOT NULL THEN 'METRO'
       WHEN c IS NOT NULL THEN 'US' END AS geo FROM x""")
def geography_waterfall(t: Tables):
    n = F.col("n")
    cols = [F.when(n % 3 == 0, n), F.when(n % 2 == 0, n * 10), F.when(n % 5 > 0, n * 100)]
    value, label = se.waterfall(cols, ["CITY", "METRO", "US"])
    return quarters(t).select("sub", "yr", "qn", value.alias("value"), label.alias("geo"))


@query("H05", f"""
WITH {_MONTHS_SQL}, r AS (SELECT sub, yr, mn, CASE WHEN COUNT(*) OVER w6 >= 6 THEN AVG(n) OVER w6 END AS n_lag6,
    CASE WHEN COUNT(*) OVER w12 >= 12 THEN AVG(n) OVER w12 END AS n_lag12 FROM m
  WINDOW w6 AS (PARTITION BY sub ORDER BY yr, mn ROWS 5 PRECEDING), w12 AS (PARTITION BY sub ORDER BY yr, mn ROWS 11 PRECEDING))
SELECT sub, CAST(yr + 1 AS INT) AS tax_yr, round(n_lag6, 9) AS n_lag6, round(n_lag12, 9) AS n_lag12, round(lag(n_lag6) OVER o, 9) AS n_lag6_y1,
  round(n_lag12 - lag(n_lag12) OVER o, 8) AS n_lag12_delta FROM r WHERE mn = 12 WINDOW o AS (PARTITION BY sub ORDER BY yr)""")
def december_snapshot(t: Tables):
    m = _months(t).withColumn("date", F.make_date("yr", "mn", F.lit(1)))
    out = se.december_snapshot(m, ["n"], keys=["sub"], year_lags=[1], delta=True)
    return out.select("sub", "tax_yr", *[dbl(c, c, 8 if "delta" in c else 9) for c in (
        "n_lag6", "n_lag12", "n_lag6_y1", "n_lag12_delta")])


_MACRO = {"1-URGENT": "1_urgent", "2-HIGH": "2_high", "3-MEDIUM": "3_medium", "4-NOT SPECIFIED": "4_not_specified",
          "5-LOW": "5_low"}


@query("H06", f"""
WITH {QUARTERS_SQL}, a AS (SELECT yr AS tax_yr, sub, SUM(n) AS n FROM q GROUP BY 1, 2),
w AS (SELECT tax_yr, {", ".join(f"CAST(SUM(CASE WHEN sub = '{k}' THEN n END) AS DOUBLE) AS n_{v}" for k, v in _MACRO.items())} FROM a GROUP BY 1)
SELECT tax_yr, {", ".join(f"lag(n_{v}, 1) OVER o AS econ_{v}_lvl_lag1" for v in _MACRO.values())}, lag(n_5_low, 2) OVER o AS econ_5_low_lvl_lag2,
       lag(n_1_urgent * 2, 1) OVER o AS econ_1_urgent_yoy_lag1 FROM w WINDOW o AS (ORDER BY tax_yr)""")
def macro_panel(t: Tables):
    a = quarters(t).groupBy(F.col("yr").alias("tax_yr"), F.col("sub").alias("var")).agg(
        F.sum("n").cast("double").alias("lvl"))
    deltas = a.select("tax_yr", "var", (F.col("lvl") * 2).alias("delta"))
    return se.macro_panel(a, deltas, list(_MACRO.values()), keep=[
        *[f"econ_{v}_lvl_lag1" for v in _MACRO.values()], "econ_5_low_lvl_lag2", "econ_1_urgent_yoy_lag1", "econ_absent"])


# Quarterly construction series: all orders by quarter; scenario levels from 2000 on.
_CON_SQL = """c AS (SELECT CAST(year(o_orderdate) AS INT) AS yr, CAST(quarter(o_orderdate) AS INT) AS qn,
  CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) / 1000000 AS baseline FROM orders GROUP BY 1, 2),
s AS (SELECT yr, qn, 'baseline' AS scenario, baseline AS v FROM c
  UNION ALL SELECT yr, qn, 'optimistic', CASE WHEN yr >= 2000 THEN baseline * 1.02 ELSE baseline END FROM c
  UNION ALL SELECT yr, qn, 'pessimistic', CASE WHEN yr >= 2000 THEN baseline * 0.98 ELSE baseline END FROM c)"""


def _construction(t: Tables):
    q = t.orders.groupBy(F.year("o_orderdate").alias("yr"), F.quarter("o_orderdate").alias("qn")).agg(
        (F.sum(money("o_totalprice")).cast("double") / 1000000).alias("baseline"))
    forecast = F.col("yr") >= 2000
    return q.withColumns({"optimistic": F.when(forecast, F.col("baseline") * 1.02).otherwise(F.lit(1.0)),
                          "pessimistic": F.when(forecast, F.col("baseline") * 0.98)})


@query("H07", f"""
WITH {_CON_SQL}, l AS (SELECT scenario, yr, qn, lag(v, 2) OVER w + lag(v, 3) OVER w + lag(v, 4) OVER w + lag(v, 5) OVER w AS s6
    FROM s WINDOW w AS (PARTITION BY scenario ORDER BY yr, qn)),
a AS (SELECT scenario, yr, SUM(v) AS lvl FROM s GROUP BY 1, 2 HAVING COUNT(*) = 4),
j AS (SELECT COALESCE(a.scenario, b.scenario) AS scenario, COALESCE(a.yr, b.yr) AS tax_yr, lvl, s6
  FROM a FULL JOIN (SELECT * FROM l WHERE qn = 1 AND s6 IS NOT NULL) b ON a.scenario = b.scenario AND a.yr = b.yr),
g AS (SELECT *, lvl / lag(lvl) OVER o - 1 AS yoy, s6 / lag(s6) OVER o - 1 AS s6yoy, lag(lvl, 1) OVER o AS l1, lag(lvl, 2) OVER o AS l2
  FROM j WINDOW o AS (PARTITION BY scenario ORDER BY tax_yr))
SELECT scenario, tax_yr, round(lvl, 6) AS con_sales_lvl, round(s6, 6) AS con_sales_lag6q_4q, round(yoy, 9) AS con_sales_yoy,
  round(s6yoy, 9) AS con_sales_lag6q_yoy, round(l1, 6) AS con_sales_lvl_lag1, round(l2, 6) AS con_sales_lvl_lag2,
  round(lag(yoy) OVER (PARTITION BY scenario ORDER BY tax_yr), 9) AS con_sales_yoy_lag1 FROM g""")
def construction_features(t: Tables):
    out = se.construction_features(_construction(t))
    return out.select("scenario", "tax_yr", *[
        dbl(c, c, 9 if "yoy" in c else 6) for c in out.columns if c not in ("scenario", "tax_yr")])


@query("H08", f"""
WITH {_MONTHS_SQL}, q AS (SELECT sub, yr, AVG(CAST(x AS DOUBLE)) AS lvl FROM m WHERE mn = 1 AND yr >= 1996 GROUP BY 1, 2)
SELECT sub, yr, round(lvl, 4) AS lvl, round(lvl / lag(lvl) OVER (PARTITION BY sub ORDER BY yr) - 1, 9) AS gyy FROM q""")
def index_growth(t: Tables):
    m = _months(t).withColumn("x", F.col("x").cast("double"))
    out = se.index_growth(m, "sub", "yr", "mn", "x", from_year=1996)
    return out.select("sub", "yr", dbl("lvl", "lvl", 4), dbl("gyy", "gyy", 9))


@query("H09", f"WITH {_CON_SQL} SELECT yr, qn, scenario, round(v, 6) AS value FROM s")
def scenario_values(t: Tables):
    out = se.scenario_value(se.complete_scenarios(_construction(t)))
    return out.select("yr", "qn", "scenario", dbl("value", "value", 6))


@query("J25", f"""
WITH {_CON_SQL}, l AS (SELECT scenario, yr, qn, (lag(v, 2) OVER w + lag(v, 3) OVER w + lag(v, 4) OVER w + lag(v, 5) OVER w) * {codes.REALIZATION_RATE} * 1e6 AS raw
    FROM s WINDOW w AS (PARTITION BY scenario ORDER BY yr, qn)),
r AS (SELECT scenario, yr, raw FROM l WHERE qn = 1 AND raw IS NOT NULL AND yr >= 1998),
f AS (SELECT scenario, yr, raw, first_value(raw) OVER (PARTITION BY scenario ORDER BY yr) AS raw0 FROM r)
SELECT scenario, CAST(yr AS INT) AS tax_yr, round(4511865685 * raw / raw0, 0) AS value FROM f WHERE yr > 1998
UNION ALL SELECT s, y, v FROM (VALUES ('baseline'), ('optimistic'), ('pessimistic')) a(s)
CROSS JOIN (VALUES (1997, 3975729781::DOUBLE), (1998, 4511865685::DOUBLE)) b(y, v)""")
def new_construction(t: Tables):
    # Certified values of the last two years; the multiples telescope in the SQL.
    out = se.new_construction(_construction(t), {1997: 3975729781, 1998: 4511865685})
    return out.select("scenario", "tax_yr", dbl("value", "value", 0))


# -- checks ------------------------------------------------------------------

_SUMS = "SELECT tax_yr, SUM(v) AS total FROM panel GROUP BY 1"


@query("K01", f"""
WITH {PANEL_SQL}, a AS ({_SUMS}) SELECT tax_yr, CAST(total AS DOUBLE) AS total, CAST(total + 5000 AS DOUBLE) AS other,
  CAST(-5000 AS DOUBLE) AS gap FROM a WHERE tax_yr % 2 = 0""")
def check_tie(t: Tables):
    a = panel(t).groupBy("tax_yr").agg(F.sum("v").alias("total"))
    b = a.select("tax_yr", (F.col("total") + F.when(F.col("tax_yr") % 2 == 0, 5000).otherwise(10)).alias("other"))
    bad = ck.check_tie(a, b, ["tax_yr"], "total", "other")
    return bad.select("tax_yr", dbl("total", "total"), dbl("other", "other"), dbl("gap", "gap"))


@query("K02", """
SELECT o_orderkey, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey
WHERE c_acctbal > 0 AND (o_totalprice / (c_acctbal * 40) < 0.5 OR o_totalprice / (c_acctbal * 40) > 2)""")
def check_range(t: Tables):
    rows = t.orders.join(t.customer.select(F.col("c_custkey").alias("o_custkey"),
                                           (F.col("c_acctbal") * 40).alias("base")), "o_custkey")
    return ck.check_range(rows, "o_totalprice", "base", 0.5, 2).select("o_orderkey", "o_totalprice")


@query("K03", """
SELECT o_orderkey, p AS pct_change, k AS pct_change_chk FROM (SELECT o_orderkey, (o_orderkey % 21 - 10) / 1000.0::DOUBLE AS p,
  (o_custkey % 13 - 6) / 1000.0::DOUBLE AS k FROM orders) WHERE abs(p - k) > 0.0055""")
def check_reported_pct(t: Tables):
    rows = t.orders.select("o_orderkey", ((F.col("o_orderkey") % 21 - 10) / 1000.0).alias("pct_change"),
                           ((F.col("o_custkey") % 13 - 6) / 1000.0).alias("pct_change_chk"))
    return ck.check_reported_pct(rows, tol=0.0055)


@query("K04", "SELECT l_orderkey, l_linenumber, COUNT(*) AS n FROM lineitem GROUP BY 1, 2 HAVING COUNT(*) > 1")
def check_unique(t: Tables):
    return ck.check_unique(t.lineitem, ["l_orderkey", "l_linenumber"])


@query("K05", f"""
WITH {PANEL_SQL}, c AS (SELECT c_nationkey, tax_yr, COUNT(*) AS n FROM panel JOIN customer ON c_custkey = parcel_id GROUP BY 1, 2),
g AS (SELECT *, CAST(n AS DOUBLE) / lag(n) OVER (PARTITION BY c_nationkey ORDER BY tax_yr) - 1 AS n_chg FROM c)
SELECT * FROM g WHERE abs(n_chg) > 0.10""")
def check_swing(t: Tables):
    sizes = panel(t).join(t.customer.select(F.col("c_custkey").alias("parcel_id"), "c_nationkey"),
                          "parcel_id").groupBy("c_nationkey", "tax_yr").agg(F.count(F.lit(1)).alias("n"))
    return ck.check_swing(sizes, ["c_nationkey"], "tax_yr", "n")


@query("K06", "SELECT DISTINCT p_size AS code FROM part WHERE p_size NOT IN (10, 11, 16, 17, 18, 49)")
def check_mapped(t: Tables):
    table = code_table(t.spark, {"apt": (10, 11, 16, 17, 18, 49)})
    return ck.check_mapped(t.part.select(F.col("p_size").alias("code")), table, "code")


@query("K07", """
SELECT c AS "column" FROM (SELECT COUNT(CASE WHEN o_orderdate < '2000-01-01' THEN 1 END) AS early, COUNT(*) AS live
  FROM orders WHERE year(o_orderdate) IN (2000, 2001)) CROSS JOIN (VALUES ('early'), ('live')) v(c)
WHERE (c = 'early' AND early = 0) OR (c = 'live' AND live = 0)""")
def check_live(t: Tables):
    y = F.year("o_orderdate")
    rows = t.orders.select(y.alias("tax_yr"), F.when(y < 2000, F.col("o_totalprice")).alias("early"),
                           F.col("o_totalprice").alias("live"))
    return ck.check_live(rows, ["early", "live"], [2000, 2001])


@query("K08", """
SELECT c_custkey, CAST(c_nationkey AS INT) AS spec_area, 'geo_report' AS rate_source FROM customer
WHERE c_nationkey > 0 AND c_custkey % 4 = 0""")
def check_routing(t: Tables):
    rows = t.customer.select("c_custkey", F.col("c_nationkey").alias("spec_area"),
                             F.when(F.col("c_custkey") % 4 == 0, "geo_report").otherwise("model").alias("rate_source"))
    return ck.check_routing(rows)


@query("K09", """
SELECT CAST(y AS INT) AS tax_yr, COALESCE(n, 0) AS n FROM (SELECT unnest(range(1999, 2004)) AS y)
LEFT JOIN (SELECT year(o_orderdate) AS yr, COUNT(DISTINCT o_orderpriority) AS n FROM orders WHERE o_orderpriority = '5-LOW'
  OR year(o_orderdate) = 2000 GROUP BY 1) ON yr = y WHERE COALESCE(n, 0) <> 1""")
def check_year_cover(t: Tables):
    y = F.year("o_orderdate")
    rows = t.orders.filter((F.col("o_orderpriority") == "5-LOW") | (y == 2000)).select(
        y.alias("tax_yr"), "o_orderpriority").distinct()
    return ck.check_year_cover(rows, range(1999, 2004))


@query("K10", """
WITH codes AS (SELECT DISTINCT p_size AS code, CASE WHEN p_partkey % 7 = 0 AND p_size < 5 THEN 'b' ELSE 'a' END AS label FROM part)
SELECT code, 'in several groups' AS problem FROM codes GROUP BY 1 HAVING COUNT(DISTINCT label) > 1
UNION ALL SELECT DISTINCT code, 'not in lookup' FROM codes WHERE code NOT IN (SELECT n_nationkey FROM nation)""")
def check_code_table(t: Tables):
    label = F.when((F.col("p_partkey") % 7 == 0) & (F.col("p_size") < 5), "b").otherwise("a")
    table = t.part.select(F.col("p_size").alias("code"), label.alias("label"))
    return ck.check_code_table(table, t.nation.select(F.col("n_nationkey").alias("code")))


@query("K11", f"""
WITH {PANEL_SQL} SELECT tax_yr, round(median(ln(CAST(v AS DOUBLE))), 9) AS median FROM panel GROUP BY 1
HAVING NOT (median(ln(CAST(v AS DOUBLE))) BETWEEN 12.75 AND 25)""")
def check_median_range(t: Tables):
    logs = panel(t).select("tax_yr", F.ln(F.col("v").cast("double")).alias("log_v"))
    return ck.check_median_range(logs, "log_v", 12.75, 25, ["tax_yr"]).select(
        "tax_yr", dbl("median", "median", 9))


@query("K12", f"""
WITH {PARTS_SQL}, x AS (SELECT parcel_id, tax_yr, CASE WHEN parcel_id % 3 > 0 THEN appr_land_val END AS l,
    CASE WHEN parcel_id % 3 > 0 THEN appr_imps_val END AS i, CASE WHEN parcel_id % 2 = 0 THEN appr_imps_val END AS tot FROM parts),
s AS (SELECT parcel_id, COUNT(CASE WHEN tax_yr < 2000 AND (l IS NOT NULL OR i IS NOT NULL) THEN 1 END) AS a,
             COUNT(CASE WHEN tax_yr < 2000 AND tot > 0 THEN 1 END) AS b FROM x GROUP BY 1)
SELECT CASE WHEN a > 0 THEN 'split' WHEN b > 0 THEN 'total_only' ELSE 'none' END AS base, COUNT(*) AS n_entities FROM s GROUP BY 1""")
def check_base_values(t: Tables):
    known = F.col("parcel_id") % 3 > 0
    rows = parts(t).select("parcel_id", "tax_yr", F.when(known, F.col("appr_land_val")).alias("l"),
                           F.when(known, F.col("appr_imps_val")).alias("i"),
                           F.when(F.col("parcel_id") % 2 == 0, F.col("appr_imps_val")).alias("tot"))
    return ck.check_base_values(rows, "parcel_id", "l", "i", "tot", start=2000)
