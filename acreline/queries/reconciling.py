"""Queries for matched growth, chained series, stocks and scenario reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from acreline.plans import reconcile as rc
from acreline.queries.base import PANEL_SQL, Tables, dbl, panel, query

_K, _Y = "parcel_id", "tax_yr"
_SCENARIOS = (("baseline", 1.0), ("optimistic", 1.02), ("pessimistic", 0.98))

MATCHED_SQL = """matched AS (
  SELECT c_mktsegment, a.tax_yr, SUM(a.v) AS num, SUM(b.v) AS den, COUNT(*) AS n_matched,
         CAST(SUM(a.v) AS DOUBLE) / CAST(SUM(b.v) AS DOUBLE) - 1 AS gyy
  FROM panel a JOIN panel b ON b.parcel_id = a.parcel_id AND b.tax_yr = a.tax_yr - 1
  JOIN customer ON c_custkey = a.parcel_id GROUP BY 1, 2)"""


def with_segment(t: Tables):
    segment = t.customer.select(F.col("c_custkey").alias(_K), "c_mktsegment", "c_nationkey")
    return panel(t).join(segment, _K)


def matched(t: Tables):
    return rc.matched_growth(with_segment(t), _K, _Y, "v", ["c_mktsegment"])


@query("J26", f"""
WITH {PANEL_SQL}, {MATCHED_SQL} SELECT c_mktsegment, tax_yr, CAST(num AS DOUBLE) AS num, CAST(den AS DOUBLE) AS den, n_matched, gyy FROM matched""")
def matched_growth(t: Tables):
    return matched(t).select("c_mktsegment", _Y, dbl("num", "num"), dbl("den", "den"), "n_matched", "gyy")


_ANCHOR = "anchor AS (SELECT c_mktsegment, CAST(2000 AS INT) AS anchor_yr, CAST(SUM(v) AS DOUBLE) AS av FROM panel JOIN customer ON c_custkey = parcel_id WHERE tax_yr = 2000 GROUP BY 1)"


def _anchor(t: Tables):
    return with_segment(t).filter("tax_yr = 2000").groupBy("c_mktsegment").agg(
        F.lit(2000).alias("anchor_yr"), dbl(F.sum("v"), "av"))


@query("J26 J27", f"""
WITH RECURSIVE {PANEL_SQL}, {MATCHED_SQL}, {_ANCHOR}, back AS (
  SELECT c_mktsegment, anchor_yr AS tax_yr, av FROM anchor
  UNION ALL SELECT b.c_mktsegment, b.tax_yr - 1, b.av / (1 + m.gyy) FROM back b
  JOIN matched m ON m.c_mktsegment = b.c_mktsegment AND m.tax_yr = b.tax_yr WHERE b.tax_yr > 1996)
SELECT c_mktsegment, tax_yr, round(av, 2) AS av FROM back""")
def matched_growth_index(t: Tables):
    out = rc.chain_back(matched(t), _anchor(t), ["c_mktsegment"])
    return out.select("c_mktsegment", _Y, dbl("av", "av", 2))


@query("J27", f"""
WITH RECURSIVE {PANEL_SQL}, {MATCHED_SQL}, {_ANCHOR},
g AS (SELECT c_mktsegment, tax_yr, CASE WHEN tax_yr = 1998 AND c_mktsegment = 'BUILDING' THEN NULL ELSE gyy END AS gyy FROM matched),
back AS (SELECT c_mktsegment, anchor_yr AS tax_yr, av FROM anchor
  UNION ALL SELECT b.c_mktsegment, b.tax_yr - 1, b.av / (1 + g.gyy) FROM back b JOIN g ON g.c_mktsegment = b.c_mktsegment AND g.tax_yr = b.tax_yr WHERE b.tax_yr > 1996)
SELECT c_mktsegment, tax_yr, round(av, 2) AS av FROM back""")
def chain_back_with_gap(t: Tables):
    gap = (F.col(_Y) == 1998) & (F.col("c_mktsegment") == "BUILDING")
    g = matched(t).withColumn("gyy", F.when(~gap, F.col("gyy")))
    return rc.chain_back(g, _anchor(t), ["c_mktsegment"]).select("c_mktsegment", _Y, dbl("av", "av", 2))


_SEG_SQL = "seg AS (SELECT tax_yr, c_mktsegment AS track, SUM(v) AS v FROM panel JOIN customer ON c_custkey = parcel_id GROUP BY 1, 2)"


def _segments(t: Tables):
    return with_segment(t).groupBy(_Y, F.col("c_mktsegment").alias("track")).agg(F.sum("v").alias("v"))


@query("J28", f"""
WITH {PANEL_SQL}, {_SEG_SQL}, tot AS (SELECT tax_yr, CAST(SUM(v) AS DOUBLE) AS s FROM seg GROUP BY 1)
SELECT tax_yr, track, round(s * 0.9 * (CAST(v AS DOUBLE) / s), 2) AS cert_av FROM seg JOIN tot USING (tax_yr)
UNION ALL SELECT tax_yr, 'pp', round(s * 0.1, 2) FROM tot""")
def certified_split(t: Tables):
    from acreline.operators.aggregates import share
    seg = _segments(t)
    total = F.sum("v").cast("double")
    anchors = seg.groupBy(_Y).agg((total * 0.9).alias("cert_real"), (total * 0.1).alias("pp_av"))
    out = rc.certified_split(anchors, share(seg, _Y, "v", small_groups=True))
    return out.select(_Y, "track", dbl("cert_av", "cert_av", 2))


@query("J28", f"""
WITH {PANEL_SQL}, {_SEG_SQL}, a AS (SELECT tax_yr, COUNT(*) * 1e6 AS anchor FROM panel GROUP BY 1)
SELECT tax_yr, track, round(CAST(v AS DOUBLE) / CAST(SUM(v) OVER (PARTITION BY tax_yr) AS DOUBLE) * anchor, 4) AS av FROM seg JOIN a USING (tax_yr)""")
def split_by_share(t: Tables):
    anchor = panel(t).groupBy(_Y).agg((F.count(F.lit(1)) * 1e6).alias("anchor"))
    out = rc.split_by_share(_segments(t), anchor, _Y, "track", "v", "anchor")
    return out.select(_Y, "track", dbl("av", "av", 4))


@query("J29", f"""
WITH {PANEL_SQL}, {_SEG_SQL}, e AS (SELECT track, CAST(MAX(CASE WHEN tax_yr = 1997 THEN v END) AS DOUBLE) AS a, CAST(MAX(CASE WHEN tax_yr = 2001 THEN v END) AS DOUBLE) AS b FROM seg GROUP BY 1)
SELECT track, CAST(y AS INT) AS tax_yr, round(a / pow(pow(b / a, 0.25), 1997 - y), 2) AS v FROM e CROSS JOIN (SELECT unnest(range(1990, 1997)) AS y)""")
def growth_backcast(t: Tables):
    out = rc.cagr_backcast(_segments(t), ["track"], "v", 1997, 2001, 1990)
    return out.select("track", _Y, dbl("v", "v", 2))


@query("J30", f"""
WITH {PANEL_SQL}, d AS (SELECT tax_yr, CAST(SUM(v) AS DOUBLE) AS v FROM panel GROUP BY 1),
s AS (SELECT scenario, tax_yr, v FROM d CROSS JOIN (VALUES ('baseline'), ('short')) x(scenario) WHERE NOT (scenario = 'short' AND tax_yr = 1999)),
g AS (SELECT scenario, tax_yr, v / lag(v) OVER (PARTITION BY scenario ORDER BY tax_yr) - 1 AS g FROM s),
c AS (SELECT scenario, COUNT(*) AS n FROM g WHERE tax_yr BETWEEN 1997 AND 2001 AND g IS NOT NULL GROUP BY 1)
SELECT w.scenario, CAST(y AS INT) AS tax_yr, round(CASE WHEN n >= 5 THEN 0.8 * g ELSE 0.03 END, 9) AS gyy
FROM (SELECT DISTINCT scenario FROM s) w CROSS JOIN (SELECT unnest(range(1997, 2002)) AS y) LEFT JOIN g ON g.scenario = w.scenario AND g.tax_yr = y
LEFT JOIN c ON c.scenario = w.scenario""")
def driver_growth(t: Tables):
    d = panel(t).groupBy(_Y).agg(dbl(F.sum("v"), "v"))
    both = d.withColumn("scenario", F.explode(F.array(F.lit("baseline"), F.lit("short"))))
    both = both.filter("NOT (scenario = 'short' AND tax_yr = 1999)")
    out = rc.driver_growth(both, "v", range(1997, 2002), 0.03, 0.8)
    return out.select("scenario", _Y, dbl("gyy", "gyy", 9))


_RATES_SQL = """rates AS (SELECT c_mktsegment, x.s AS scenario, tax_yr + 6 AS tax_yr, gyy * x.m AS gyy FROM matched
  CROSS JOIN (VALUES ('baseline', 1.0), ('optimistic', 1.02), ('pessimistic', 0.98)) x(s, m) WHERE NOT (tax_yr = 1999 AND c_mktsegment = 'FURNITURE'))"""


def _rates(t: Tables):
    scenarios = F.array(*[F.struct(F.lit(s).alias("scenario"), F.lit(m).alias("m")) for s, m in _SCENARIOS])
    known = matched(t).filter("NOT (tax_yr = 1999 AND c_mktsegment = 'FURNITURE')")
    return known.select("c_mktsegment", (F.col(_Y) + 6).alias(_Y), "gyy", F.inline(scenarios)).withColumn(
        "gyy", F.col("gyy") * F.col("m")).drop("m")


_COMPOUND_SQL = """fc AS (
  SELECT a.c_mktsegment, s.scenario, CAST(2001 AS INT) AS tax_yr, a.av AS cert_av FROM anchor a JOIN (SELECT DISTINCT c_mktsegment, scenario FROM rates) s USING (c_mktsegment)
  UNION ALL SELECT f.c_mktsegment, f.scenario, f.tax_yr + 1, f.cert_av * (1 + COALESCE(r.gyy, 0)) FROM fc f
  LEFT JOIN rates r ON r.c_mktsegment = f.c_mktsegment AND r.scenario = f.scenario AND r.tax_yr = f.tax_yr + 1 WHERE f.tax_yr < 2006)"""


def _compounded(t: Tables):
    base = _anchor(t).select("c_mktsegment", F.col("av").alias("cert_av"))
    return rc.compound(base, _rates(t), ["c_mktsegment"], 2001, 2006)


@query("J31", f"""
WITH RECURSIVE {PANEL_SQL}, {MATCHED_SQL}, {_ANCHOR}, {_RATES_SQL}, {_COMPOUND_SQL}
SELECT c_mktsegment, scenario, tax_yr, round(cert_av, 2) AS cert_av FROM fc""")
def compounded_forecast(t: Tables):
    return _compounded(t).select("c_mktsegment", "scenario", _Y, dbl("cert_av", "cert_av", 2))


@query("J32", f"""
WITH RECURSIVE {PANEL_SQL}, {MATCHED_SQL}, x AS (SELECT c_mktsegment, tax_yr, CAST(n_matched AS DOUBLE) AS flow,
    CASE WHEN tax_yr = 1998 AND c_mktsegment = 'BUILDING' THEN -1 WHEN tax_yr = 1999 AND c_mktsegment = 'MACHINERY' THEN NULL ELSE gyy END AS g FROM matched),
s AS (SELECT c_mktsegment, tax_yr, flow AS stock FROM x WHERE tax_yr = 1996
  UNION ALL SELECT x.c_mktsegment, x.tax_yr, s.stock * (1 + COALESCE(x.g, 0)) + x.flow FROM s JOIN x ON x.c_mktsegment = s.c_mktsegment AND x.tax_yr = s.tax_yr + 1)
SELECT c_mktsegment, tax_yr, round(stock, 6) AS stock FROM s""")
def stock_and_flow(t: Tables):
    at = lambda y, s: (F.col(_Y) == y) & (F.col("c_mktsegment") == s)
    g = F.when(at(1998, "BUILDING"), -1.0).when(~at(1999, "MACHINERY"), F.col("gyy"))
    rows = matched(t).select("c_mktsegment", _Y, F.col("n_matched").cast("double").alias("flow"), g.alias("g"))
    return rc.stock_flow(rows, ["c_mktsegment"], "flow", "g").select(
        "c_mktsegment", _Y, dbl("stock", "stock", 6))


#: One column each in the wide series.
_WIDE = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")


@query("J33", f"""
WITH RECURSIVE {PANEL_SQL}, {_SEG_SQL}, {MATCHED_SQL}, {_ANCHOR}, {_RATES_SQL}, {_COMPOUND_SQL},
l AS (SELECT track AS "group", tax_yr, CAST(v AS DOUBLE) AS av, 'certified' AS basis FROM seg WHERE tax_yr < 2001
  UNION ALL SELECT c_mktsegment, tax_yr, cert_av, 'forecast' FROM fc WHERE scenario = 'baseline')
SELECT "group", tax_yr, round(av, 2) AS av, basis, round(av / lag(av) OVER (PARTITION BY "group" ORDER BY tax_yr) - 1, 9) AS yoy FROM l""")
def value_series(t: Tables):
    return _series(t).select("group", _Y, dbl("av", "av", 2), "basis", dbl("yoy", "yoy", 9))


def _series(t: Tables):
    history = _segments(t).filter("tax_yr < 2001").select(
        F.col("track").alias("group"), _Y, dbl("v", "av"), F.lit("certified").alias("basis"))
    forecast = _compounded(t).filter("scenario = 'baseline'").select(
        F.col("c_mktsegment").alias("group"), _Y, F.col("cert_av").alias("av"), F.lit("forecast").alias("basis"))
    return rc.series([history, forecast])


@query("J33", f"""
WITH RECURSIVE {PANEL_SQL}, {_SEG_SQL}, {MATCHED_SQL}, {_ANCHOR}, {_RATES_SQL}, {_COMPOUND_SQL},
l AS (SELECT track AS g, tax_yr, CAST(v AS DOUBLE) AS av FROM seg WHERE tax_yr < 2001 UNION ALL SELECT c_mktsegment, tax_yr, cert_av FROM fc WHERE scenario = 'baseline')
SELECT tax_yr, {", ".join(f"round(SUM(CASE WHEN g = '{g}' THEN av END), 2) AS {g.lower()}" for g in _WIDE)} FROM l GROUP BY 1""")
def value_series_wide(t: Tables):
    return rc.series_wide(_series(t), _WIDE).select(_Y, *[dbl(g, g.lower(), 2) for g in _WIDE])


@query("J34", f"""
WITH RECURSIVE {PANEL_SQL}, {MATCHED_SQL}, {_ANCHOR}, {_RATES_SQL}, {_COMPOUND_SQL},
w AS (SELECT tax_yr, {", ".join(f"SUM(CASE WHEN scenario = '{s}' THEN cert_av END) AS {s}" for s, _ in _SCENARIOS)} FROM fc GROUP BY 1)
SELECT tax_yr, round(baseline, 1) AS baseline, round(optimistic, 1) AS optimistic, round(pessimistic, 1) AS pessimistic,
  round(optimistic - baseline, 1) AS diff_optimistic_vs_baseline, round(pessimistic - baseline, 1) AS diff_pessimistic_vs_baseline FROM w""")
def scenario_summary(t: Tables):
    out = rc.scenario_summary(_compounded(t), "cert_av")
    return out.select(_Y, *[dbl(c, c, 1) for c in out.columns if c != _Y])


@query("J35", f"""
WITH {PANEL_SQL}, g AS (SELECT c.c_mktsegment, y.tax_yr, p.parcel_id IS NOT NULL AS has, c.c_custkey AS parcel_id, p.v FROM customer c
    JOIN (SELECT DISTINCT o_custkey FROM orders) o ON o.o_custkey = c.c_custkey CROSS JOIN (SELECT DISTINCT tax_yr FROM panel) y
    LEFT JOIN panel p ON p.parcel_id = c.c_custkey AND p.tax_yr = y.tax_yr),
s AS (SELECT c_mktsegment, tax_yr, COALESCE(SUM(v), 0) AS total, COUNT(DISTINCT parcel_id) AS n_entities, CAST(SUM(CASE WHEN v IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_missing FROM g GROUP BY 1, 2)
SELECT c_mktsegment, tax_yr, CAST(total AS DOUBLE) AS total, n_entities, n_missing,
  round(100 * (CAST(total AS DOUBLE) / CAST(lag(total) OVER (PARTITION BY c_mktsegment ORDER BY tax_yr) AS DOUBLE) - 1), 6) AS yoy_pct,
  round(CAST(total AS DOUBLE) / CAST(SUM(total) OVER (PARTITION BY tax_yr) AS DOUBLE), 9) AS year_share FROM s""")
def trajectory(t: Tables):
    from acreline.queries.base import grid
    segment = t.customer.select(F.col("c_custkey").alias(_K), "c_mktsegment")
    out = rc.trajectory(grid(t).join(segment, _K), ["c_mktsegment"], _K, "v")
    return out.select("c_mktsegment", _Y, dbl("total", "total"), "n_entities", "n_missing",
                      dbl("yoy_pct", "yoy_pct", 6), dbl("year_share", "year_share", 9))


@query("J35 B17", f"""
WITH {PANEL_SQL}, g AS (SELECT tax_yr, CAST(SUM(v) AS DOUBLE) AS grand FROM panel GROUP BY 1)
SELECT tax_yr, round(grand, 2) AS grand, round(grand / lag(grand) OVER (ORDER BY tax_yr) - 1, 9) AS yoy, round(CASE WHEN tax_yr = 2000 THEN grand - 500000000 END, 2) AS gap FROM g""")
def grand_total(t: Tables):
    rows = with_segment(t).select(_K, _Y, "c_mktsegment", F.when(F.col(_Y) < 1998, F.col("v")).alias("appr_land_val"),
                                  F.when(F.col(_Y) >= 1998, F.col("v")).alias("pred_total_assessed"))
    valued = rows.withColumn("value", rc.row_value(rows))
    out = rc.grand_total(rc.trajectory(valued, ["c_mktsegment"], _K, "value"), {2000: 500000000})
    return out.select(_Y, dbl("grand", "grand", 2), dbl("yoy", "yoy", 9), dbl("gap", "gap", 2))
