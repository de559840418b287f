"""Queries for snapshots, panel assembly and classification."""

from __future__ import annotations

from pyspark.sql import functions as F

from acreline.functions import codes
from acreline.operators.joins import cross_grid

from acreline.plans import classify as cl
from acreline.plans import panel as pl
from acreline.plans import snapshots as sn
from acreline.queries.base import (PANEL_SQL, PARTS_SQL, YEARS_SQL, Tables, dbl, money, panel,
                                   parts, query, sql_codes, sql_groups, sql_list, sql_ranges)
from acreline.queries.cleaning import KEYWORD_SQL, NORMAL_SQL, TEXT_EXPR, _USE118, _ZONE, _ZONING
from acreline.queries.joining import _CHANGES_SQL, _HIST

_text = lambda c: c.cast("string")


# -- snapshots ---------------------------------------------------------------

_RES_SQL = f"""
par AS (SELECT o_orderkey AS parcel_id, CASE o_orderkey % 9 WHEN 0 THEN 'K' WHEN 1 THEN 'M' WHEN 2 THEN NULL ELSE 'R' END AS prop_type,
    CASE WHEN o_orderkey % 18 = 0 THEN '0000' ELSE '0010' END AS minor, CASE WHEN o_orderstatus = 'P' THEN 'X' WHEN o_orderstatus = 'F' THEN 'T' END AS tax_stat,
    CASE WHEN o_orderkey % 7 = 0 THEN 'HP' END AS tax_val_reason, o_orderkey % 120 AS pct, o_orderkey % 8 AS hbu,
    o_orderkey % 3 AS noise, CASE WHEN o_orderkey % 4 = 0 THEN 'Y' ELSE 'N' END AS pw FROM orders),
b AS (SELECT l_orderkey AS parcel_id, l_linenumber AS nbr, l_partkey % 22 AS grade, l_suppkey % 5 AS cond,
    1900 + l_partkey % 120 AS yr, CAST(l_quantity AS INT) AS sq, l_partkey % 6 AS units FROM lineitem),
pri AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY parcel_id ORDER BY nbr, CAST(yr AS VARCHAR), CAST(sq AS VARCHAR), CAST(grade AS VARCHAR)) AS rn FROM b) WHERE rn = 1),
tot AS (SELECT parcel_id, CAST(SUM(sq) AS DOUBLE) AS area, MAX(units) AS units FROM b GROUP BY 1)"""


@query("I01", f"""
WITH {_RES_SQL}
SELECT par.parcel_id, CAST(grade AS INT) AS avg_bldg_grade, CAST(yr AS INT) AS yr_built_primary, area AS total_living_sqft,
  CAST(CASE WHEN grade IS NOT NULL THEN least(grade, 13) END AS INT) AS bldg_grade_capped, CAST(COALESCE(tot.units BETWEEN 2 AND 4, FALSE) AS INT) AS is_small_mf,
  CAST(COALESCE(area, 0) = 0 AS INT) AS is_land_only,
  CAST(NOT (pct BETWEEN 1 AND 99) AND COALESCE(tax_stat = 'T', TRUE) AND tax_val_reason IS NULL AND hbu < 6 AS INT) AS model_flag,
  CAST(noise + CAST(pw = 'Y' AS INT) AS INT) AS nuisance_score, {sql_codes('hbu', codes.HIGHEST_BEST_USE_LABELS)} AS hbu_as_if_vacant_desc
FROM par LEFT JOIN pri USING (parcel_id) LEFT JOIN tot USING (parcel_id)
WHERE NOT COALESCE(prop_type = 'K' AND minor = '0000', FALSE) AND COALESCE(prop_type NOT IN ({sql_list(codes.NON_MODELLED_TYPES)}), TRUE)""")
def residential_snapshot(t: Tables):
    k = F.col("o_orderkey")
    status = F.col("o_orderstatus")
    parcels = t.orders.select(
        k.alias("parcel_id"), F.when(k % 9 == 0, "K").when(k % 9 == 1, "M").when(k % 9 > 2, "R").alias("prop_type"),
        F.when(k % 18 == 0, "0000").otherwise("0010").alias("minor"),
        F.when(status == "P", "X").when(status == "F", "T").alias("tax_stat"),
        F.when(k % 7 == 0, "HP").alias("tax_val_reason"), _text(k % 120).alias("pcnt_complete"),
        _text(k % 8).alias("hbu_as_if_vacant"), F.lit(None).cast("double").alias("appr_imps_val"),
        _text(k % 3).alias("traffic_noise"), F.when(k % 4 == 0, "Y").otherwise("N").alias("power_lines"),
        F.lit(None).cast("string").alias("other_nuisances"))
    part, supp = F.col("l_partkey"), F.col("l_suppkey")
    buildings = t.lineitem.select(
        F.col("l_orderkey").alias("parcel_id"), F.col("l_linenumber").alias("bldg_nbr"),
        _text(part % 22).alias("bldg_grade"), _text(supp % 5).alias("condition"), F.lit("1").alias("heat_system"),
        _text(1900 + part % 120).alias("yr_built"), F.lit("2").alias("stories"),
        _text(F.col("l_quantity").cast("int")).alias("sq_ft_tot_living"), _text(part % 6).alias("nbr_living_units"))
    return sn.residential_snapshot(parcels, buildings).select(
        "parcel_id", "avg_bldg_grade", "yr_built_primary", "total_living_sqft", "bldg_grade_capped",
        "is_small_mf", "is_land_only", "model_flag", "nuisance_score", "hbu_as_if_vacant_desc")


_SHARES = ("office", "retail", "industrial", "parking")


@query("I02", f"""
WITH li AS (SELECT l_orderkey AS parcel_id, l_linenumber AS nbr, l_partkey AS p, l_suppkey AS s, CAST(l_quantity AS INT) AS q,
    300 + l_partkey % 500 AS use_code FROM lineitem),
b AS (SELECT parcel_id, COUNT(*) AS n_comm_bldgs, SUM(q * 10) AS g, SUM(q * 9) AS n, MAX(p % 30) AS st,
        arg_min(use_code, (nbr, use_code)) AS use_code, AVG(CASE WHEN p % 90 > 0 THEN greatest(2026 - (1940 + p % 90), 0) END) AS age,
        MAX(CASE WHEN s % 2 = 0 THEN 1 ELSE 0 END) AS spr FROM li GROUP BY 1),
s AS (SELECT parcel_id, COUNT(*) AS n_sections, COUNT(DISTINCT use_code) AS nu, SUM(q) AS sg,
  {", ".join(f"SUM(CASE WHEN bucket = '{u}' THEN q ELSE 0 END) AS {u}" for u in _SHARES)},
  SUM(q * (8 + p % 5)) / SUM(q) AS height
  FROM (SELECT *, {sql_ranges('use_code', codes.USE_BUCKETS, "'unknown'")} AS bucket FROM (SELECT * REPLACE (CASE WHEN nbr < 6 THEN parcel_id ELSE -parcel_id END AS parcel_id) FROM li)) GROUP BY 1),
f AS (SELECT parcel_id, SUM(CASE WHEN p % 20 = 1 THEN q ELSE 0 END) AS garage, SUM(q) AS tot FROM (SELECT * REPLACE (CASE WHEN p % 3 = 0 THEN parcel_id ELSE -parcel_id END AS parcel_id) FROM li) GROUP BY 1)
SELECT parcel_id, n_comm_bldgs, CAST(g AS BIGINT) AS total_gross_sqft, CAST(st AS BIGINT) AS max_nbr_stories, use_code AS predominant_use,
  round(age, 6) AS avg_age_comm, CAST(spr AS INT) AS has_sprinklers, COALESCE(n_sections, 0) AS n_sections, COALESCE(nu, 0) AS n_distinct_uses,
  round(COALESCE(height, 0), 6) AS avg_story_height, CAST(COALESCE(garage, 0) AS BIGINT) AS parking_garage_sqft, CAST(COALESCE(tot, 0) AS BIGINT) AS total_feature_sqft,
  {", ".join(f"round(CASE WHEN COALESCE(sg, 0) > 0 THEN CAST({u} AS DOUBLE) / sg ELSE 0 END, 9) AS {u}_pct" for u in _SHARES)},
  round(CAST(n AS DOUBLE) / g, 9) AS net_to_gross_ratio, {sql_codes('use_code', codes.PREDOMINANT_USE_LABELS, "'Use_' || use_code")} AS predominant_use_desc,
  {sql_ranges('use_code', codes.USE_CLASSES, "'Other Commercial'")} AS prop_class_comm, {sql_ranges('g', codes.BUILDING_SIZE_TIERS)} AS size_tier,
  round(ln(g), 9) AS log_gross_sqft
FROM b LEFT JOIN s USING (parcel_id) LEFT JOIN f USING (parcel_id)""")
def commercial_snapshot(t: Tables):
    q, p = F.col("l_quantity").cast("int"), F.col("l_partkey")
    use = (300 + p % 500)
    nbr = F.col("l_linenumber")
    buildings = t.lineitem.select(
        F.col("l_orderkey").alias("parcel_id"), nbr.alias("bldg_nbr"), (q * 10).alias("bldg_gross_sqft"),
        (q * 9).alias("bldg_net_sqft"), (p % 30).alias("nbr_stories"), F.lit(5).alias("bldg_quality"),
        use.alias("predominant_use"), F.lit(1).alias("constr_class"),
        F.when(p % 90 > 0, 1940 + p % 90).otherwise(0).alias("yr_built"), F.lit(0).alias("eff_yr"),
        F.when(F.col("l_suppkey") % 2 == 0, "Y").otherwise("N").alias("sprinklers"),
        F.lit("N").alias("elevators"), F.lit(100.0).alias("pcnt_complete"))
    # Rows without a building have a key of their own.
    own = lambda known: F.when(known, F.col("l_orderkey")).otherwise(-F.col("l_orderkey")).alias("parcel_id")
    sections = t.lineitem.select(
        own(nbr < 6), use.alias("section_use"), q.alias("gross_sqft"),
        q.alias("net_sqft"), (8 + p % 5).alias("story_height"))
    kind = F.when(p % 20 == 1, 751).otherwise(763)
    features = t.lineitem.select(
        own(p % 3 == 0), kind.alias("feature_type"), q.alias("gross_sqft"))
    out = sn.commercial_snapshot(buildings, sections, features, 2026)
    return out.select(
        "parcel_id", "n_comm_bldgs", "total_gross_sqft", "max_nbr_stories", "predominant_use",
        dbl("avg_age_comm", "avg_age_comm", 6), "has_sprinklers", "n_sections", "n_distinct_uses",
        dbl("avg_story_height", "avg_story_height", 6), "parking_garage_sqft", "total_feature_sqft",
        *[dbl(f"{u}_pct", f"{u}_pct", 9) for u in _SHARES], dbl("net_to_gross_ratio", "net_to_gross_ratio", 9),
        "predominant_use_desc", "prop_class_comm", "size_tier", dbl("log_gross_sqft", "log_gross_sqft", 9))


_KEY = "lpad(CAST({a} AS VARCHAR), 6, '0') || lpad(CAST({b} AS VARCHAR), 4, '0')"


def _key(a, b):
    return F.concat(F.lpad(_text(a), 6, "0"), F.lpad(_text(b), 4, "0"))


@query("I03", f"""
WITH u AS (SELECT o_orderkey, o_custkey, {_KEY.format(a='o_custkey', b='o_orderkey % 10000')} AS parcel_id,
    CASE WHEN o_orderkey % 3 > 0 THEN o_orderkey % 2000 ELSE 0 END AS sq, o_orderkey % 12 AS fl FROM orders),
c AS (SELECT CASE WHEN c_custkey % 10 > 0 THEN c_custkey ELSE -1 - c_custkey END AS c_custkey, CASE WHEN c_custkey % 12 > 0 THEN c_custkey % 12 END AS ct, c_custkey % 1500 AS av, c_custkey % 15 AS st, c_custkey % 90 AS n FROM customer)
SELECT o_orderkey, parcel_id, eff AS effective_unit_sqft, {sql_ranges('eff', codes.UNIT_SIZE_TIERS)} AS unit_size_tier,
  CAST(CASE WHEN st > 0 THEN CAST(fl = st AS INT) END AS INT) AS is_penthouse, CAST(COALESCE(st >= 8, FALSE) AS INT) AS is_highrise,
  CAST(COALESCE(n >= 50, FALSE) AS INT) AS is_large_complex, {sql_codes('ct', codes.CONDO_SEGMENTS, "'Other Condo'")} AS condo_segment,
  o_custkey IN (SELECT s_suppkey FROM supplier) AS in_comm_bldg
FROM (SELECT *, CAST(CASE WHEN sq > 0 THEN sq WHEN av > 0 THEN av END AS DOUBLE) AS eff FROM u LEFT JOIN c ON c_custkey = o_custkey
      WHERE ct <> 3 OR ct IS NULL)""")
def condo_snapshot(t: Tables):
    k, c = F.col("o_orderkey"), F.col("c_custkey")
    units = t.orders.select(
        k, _key(F.col("o_custkey"), k % 10000).alias("parcel_id"),
        F.when(k % 3 > 0, k % 2000).otherwise(0).alias("unit_sqft"), (k % 12).alias("unit_floor"))
    complexes = t.customer.select(
        F.concat(F.when(c % 10 == 0, "none").otherwise(""), F.lpad(_text(c), 6, "0")).alias("major"), F.when(c % 12 > 0, c % 12).alias("complex_type"),
        (c % 1500).alias("avg_unit_size"), (c % 15).alias("nbr_stories_cplx"), (c % 90).alias("nbr_units"),
        F.lit(5).alias("pcnt_with_view"), F.lit(True).alias("has_elevators"), F.lit(True).alias("has_security"),
        F.lit(False).alias("has_fireplace"), F.lit(1).alias("laundry_type"), F.lit(2).alias("project_appeal"),
        F.lit(3).alias("project_location"))
    commercial = t.supplier.select(_key(F.col("s_suppkey"), F.lit(1)).alias("parcel_id"))
    return sn.condo_snapshot(units, complexes, commercial).select(
        "o_orderkey", "parcel_id", "effective_unit_sqft", "unit_size_tier", "is_penthouse", "is_highrise",
        "is_large_complex", "condo_segment", "in_comm_bldg")


# -- panel -------------------------------------------------------------------

@query("I04", f"""
WITH {_CHANGES_SQL}, {PARTS_SQL}
SELECT j.parcel_id, j.tax_yr, COALESCE(last_value(nu IGNORE NULLS) {_HIST}, urgent) AS nuisance_score,
  COALESCE(last_value(nl IGNORE NULLS) {_HIST}, low) AS current_zoning_3, CAST(l AS DOUBLE) AS appr_land_val, CAST(i AS DOUBLE) AS appr_imps_val,
  CAST(CASE WHEN l IS NULL AND i IS NULL THEN NULL ELSE COALESCE(l, 0) + COALESCE(i, 0) END AS DOUBLE) AS total_assessed,
  round(ln(CAST(l AS DOUBLE)), 9) AS log_appr_land_val
FROM (SELECT j.*, appr_land_val AS l, appr_imps_val AS i FROM j LEFT JOIN parts p ON p.parcel_id = j.parcel_id AND p.tax_yr = j.tax_yr) j""")
def assembled_panel(t: Tables):
    from acreline.queries.joining import _changes
    _, changes = _changes(t)
    names = {"1-URGENT": "nuisance_score", "5-LOW": "current_zoning_3"}
    snapshot = t.customer.select(F.col("c_custkey").alias("parcel_id"), F.col("c_acctbal").alias("nuisance_score"),
                                 F.col("c_mktsegment").alias("current_zoning_3"), F.col("c_nationkey").alias("area"))
    # The order key breaks ties between changes of one day.
    stamped = changes.withColumn("update_date", F.col("update_date") + F.make_interval(
        secs=F.col("o_orderkey").cast("decimal(18,6)") / 1000000))
    out = pl.build_panel(snapshot, parts(t), stamped, t.years[0], t.years[-1], names)
    return out.select("parcel_id", "tax_yr", "nuisance_score", "current_zoning_3",
                      *[dbl(c, c) for c in ("appr_land_val", "appr_imps_val", "total_assessed")],
                      dbl("log_appr_land_val", "log_appr_land_val", 9))


def _years(t: Tables):
    return cross_grid(t.orders.select(F.col("o_custkey").alias("parcel_id")), "parcel_id", t.years[0], t.years[-1])


_YEARS_SQL = f"""spine AS (SELECT parcel_id, y AS tax_yr FROM (SELECT DISTINCT o_custkey AS parcel_id FROM orders)
  CROSS JOIN {YEARS_SQL})"""


@query("I05", f"""
WITH {_YEARS_SQL}, sq AS (SELECT l_orderkey, nullif(SUM(CAST(CASE WHEN l_returnflag = 'A' THEN l_quantity ELSE 0 END AS DECIMAL(18,2))), 0) AS s FROM lineitem GROUP BY 1),
ann AS (SELECT o_custkey AS parcel_id, CAST(year(o_orderdate) + CASE WHEN o_orderkey % 4 = 0 THEN 1 ELSE 0 END AS INT) AS tax_yr, COUNT(*) AS n,
    SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS v, COALESCE(SUM(s), 0) AS s, SUM(o_orderkey % 3) AS u
  FROM orders LEFT JOIN sq ON l_orderkey = o_orderkey GROUP BY 1, 2),
p AS (SELECT sp.parcel_id, sp.tax_yr, COALESCE(n, 0) AS n, COALESCE(v, 0) AS v, COALESCE(s, 0) AS s, COALESCE(u, 0) AS u, CASE WHEN n IS NULL THEN 0 ELSE 1 END AS f
  FROM spine sp LEFT JOIN ann a ON a.parcel_id = sp.parcel_id AND a.tax_yr = sp.tax_yr)
SELECT parcel_id, tax_yr, n AS permits_last_1yr, CAST(SUM(n) OVER w3 AS BIGINT) AS permits_last_3yr, CAST(SUM(n) OVER w5 AS BIGINT) AS permits_last_5yr,
  CAST(SUM(v) OVER w3 AS DOUBLE) AS val_last_3yr, CAST(SUM(v) OVER w5 AS DOUBLE) AS val_last_5yr, CAST(SUM(s) OVER w3 AS DOUBLE) AS sqft_last_3yr,
  CAST(SUM(u) OVER w3 AS BIGINT) AS units_last_3yr, CAST(COALESCE(tax_yr - MAX(CASE WHEN f = 1 THEN tax_yr END) OVER wa, 0) AS INT) AS years_since_newconst,
  CAST(f AS INT) AS any_newconst, round(ln(1 + CAST(SUM(v) OVER w3 AS DOUBLE)), 9) AS log_val_last_3yr
FROM p WINDOW w3 AS (PARTITION BY parcel_id ORDER BY tax_yr ROWS 2 PRECEDING), w5 AS (PARTITION BY parcel_id ORDER BY tax_yr ROWS 4 PRECEDING),
  wa AS (PARTITION BY parcel_id ORDER BY tax_yr ROWS UNBOUNDED PRECEDING)""")
def permit_features(t: Tables):
    k = F.col("o_orderkey")
    permits = t.orders.select(
        F.col("o_custkey").alias("parcel_id"), k.alias("record_number"),
        F.when(k % 4 == 0, F.make_date(F.year("o_orderdate") + 1, F.lit(3), F.lit(1))).alias("finished"),
        F.to_date("o_orderdate").alias("issued"), money("o_totalprice").alias("valuation"),
        (k % 3).alias("units_added"))
    lines = t.lineitem.select(F.col("l_orderkey").alias("record_number"),
                              F.when(F.col("l_returnflag") == "A", money("l_quantity"))
                              .otherwise(F.lit(0).cast("decimal(18,2)")).alias("sqft"))
    out = pl.permit_features(_years(t), permits, lines, ["occupancy", "finished", "issued"], t.years)
    return out.select("parcel_id", "tax_yr", "permits_last_1yr", "permits_last_3yr", "permits_last_5yr",
                      *[dbl(c, c) for c in ("val_last_3yr", "val_last_5yr", "sqft_last_3yr")], "units_last_3yr",
                      "years_since_newconst", "any_newconst", dbl("log_val_last_3yr", "log_val_last_3yr", 9))


@query("I06", f"""
WITH {_YEARS_SQL}, det AS (SELECT l_orderkey, {", ".join(
    f"SUM(CASE WHEN l_linenumber = {i} THEN CAST(l_quantity AS INT) END) AS {n}" for i, n in enumerate(codes.PERMIT_ITEMS.values(), 1))} FROM lineitem GROUP BY 1),
ann AS (SELECT o_custkey AS parcel_id, CAST(year(o_orderdate) AS INT) AS tax_yr, COUNT(*) AS n,
    SUM(CASE WHEN o_orderkey % 3 > 0 THEN floor(o_totalprice) ELSE owner_val END) AS v, SUM(permit_sqft) AS s,
    MAX(CASE WHEN o_orderkey % 5 > 0 THEN o_orderkey % 100 END) AS pc, SUM(CASE WHEN o_orderstatus <> 'F' THEN 1 ELSE 0 END) AS op,
    MAX(CASE WHEN o_orderpriority = '2-HIGH' THEN 1 ELSE 0 END) AS nw FROM orders LEFT JOIN det ON l_orderkey = o_orderkey GROUP BY 1, 2),
p AS (SELECT sp.parcel_id, sp.tax_yr, COALESCE(n, 0) AS n, COALESCE(v, 0) AS v, COALESCE(s, 0) AS s, pc, COALESCE(op, 0) AS op, COALESCE(nw, 0) AS nw
  FROM spine sp LEFT JOIN ann a ON a.parcel_id = sp.parcel_id AND a.tax_yr = sp.tax_yr)
SELECT parcel_id, tax_yr, CAST(SUM(n) OVER w3 AS BIGINT) AS kcap_permits_3yr, CAST(SUM(v) OVER w3 AS DOUBLE) AS kcap_val_3yr,
  CAST(SUM(s) OVER w3 AS DOUBLE) AS kcap_sqft_3yr, CAST(op AS BIGINT) AS kcap_open_sum, last_value(pc IGNORE NULLS) OVER wa AS kcap_pct_complete_max,
  CAST(tax_yr - MAX(CASE WHEN nw = 1 THEN tax_yr END) OVER wa AS INT) AS kcap_years_since_permit, CAST(nw AS INT) AS any_newconst
FROM p WINDOW w3 AS (PARTITION BY parcel_id ORDER BY tax_yr ROWS 2 PRECEDING), wa AS (PARTITION BY parcel_id ORDER BY tax_yr ROWS UNBOUNDED PRECEDING)""")
def assessor_permit_features(t: Tables):
    k = F.col("o_orderkey")
    permits = t.orders.select(
        F.col("o_custkey").alias("parcel_id"), k.alias("permit_nbr"), F.to_date("o_orderdate").alias("issue_date"),
        F.when(F.col("o_orderpriority") == "2-HIGH", " New Const").otherwise("Alteration").alias("permit_type"),
        F.when(F.col("o_orderstatus") == "F", "Finaled: FINAL").otherwise("Issued").alias("permit_status"),
        F.when(k % 3 > 0, F.floor("o_totalprice").cast("double")).alias("permit_val"),
        F.when(k % 5 > 0, k % 100).alias("pcnt_complete"))
    # Lines beyond the known items carry an item that no feature uses.
    item = F.coalesce(F.get(F.array(*[F.lit(i) for i in codes.PERMIT_ITEMS]), F.col("l_linenumber") - 1), F.lit(0))
    detail = t.lineitem.select(
        F.col("l_orderkey").alias("permit_nbr"), item.alias("permit_item"),
        F.concat(F.lit("$ "), _text(F.col("l_quantity").cast("int")), F.lit(" sf")).alias("item_value"))
    out = pl.assessor_permit_features(_years(t), permits, detail, t.years)
    return out.select("parcel_id", "tax_yr", "kcap_permits_3yr", dbl("kcap_val_3yr", "kcap_val_3yr"),
                      dbl("kcap_sqft_3yr", "kcap_sqft_3yr"), "kcap_open_sum", "kcap_pct_complete_max",
                      "kcap_years_since_permit", "any_newconst")


@query("I07", f"""
WITH {_YEARS_SQL}, ex AS (SELECT o_custkey AS parcel_id, CAST(year(o_orderdate) AS INT) AS a, CAST(year(o_orderdate) + o_orderkey % 4 - 1 AS INT) AS b,
    CAST(o_totalprice AS DECIMAL(18,2)) AS v FROM orders WHERE o_orderkey % 4 > 0),
app AS (SELECT o_custkey AS parcel_id, CAST(year(o_orderdate) AS INT) AS tax_yr, COUNT(*) AS n, SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS c
  FROM orders WHERE o_orderstatus = 'F' GROUP BY 1, 2),
act AS (SELECT s.parcel_id, s.tax_yr, SUM(v) AS v FROM spine s JOIN ex ON ex.parcel_id = s.parcel_id AND s.tax_yr BETWEEN a AND b GROUP BY 1, 2),
rol AS (SELECT parcel_id, b + 1 AS tax_yr, SUM(v) AS v FROM ex GROUP BY 1, 2),
p AS (SELECT s.parcel_id, s.tax_yr, COALESCE(n, 0) AS n, COALESCE(c, 0) AS c, COALESCE(act.v, 0) AS av, COALESCE(rol.v, 0) AS rv,
    CASE WHEN s.parcel_id IN (SELECT parcel_id FROM ex) THEN 1 ELSE 0 END AS ever
  FROM spine s LEFT JOIN app ON app.parcel_id = s.parcel_id AND app.tax_yr = s.tax_yr LEFT JOIN act ON act.parcel_id = s.parcel_id AND act.tax_yr = s.tax_yr
  LEFT JOIN rol ON rol.parcel_id = s.parcel_id AND rol.tax_yr = s.tax_yr)
SELECT parcel_id, tax_yr, CAST(SUM(n) OVER w3 AS BIGINT) AS hi_app_cnt_3yr, CAST(SUM(c) OVER w3 AS DOUBLE) AS hi_est_cost_3yr,
  CAST(CASE WHEN av > 0 THEN 1 ELSE 0 END AS INT) AS hi_exempt_active, CAST(av AS DOUBLE) AS hi_exempt_val_active, CAST(rv AS DOUBLE) AS hi_rolloff_cur_val,
  CAST(lead(rv, 1, 0) OVER w AS DOUBLE) AS hi_rolloff_next_val, CAST(ever AS INT) AS hi_ever, round(ln(1 + CAST(av AS DOUBLE)), 9) AS log_hi_exempt_val_active
FROM p WINDOW w3 AS (PARTITION BY parcel_id ORDER BY tax_yr ROWS 2 PRECEDING), w AS (PARTITION BY parcel_id ORDER BY tax_yr)""")
def exemption_features(t: Tables):
    k, y = F.col("o_orderkey"), F.year("o_orderdate")
    applications = t.orders.select(
        F.col("o_custkey").alias("parcel_id"), F.when(F.col("o_orderstatus") == "F", " y").otherwise("N").alias("approved"),
        F.when(k % 2 == 0, F.to_date("o_orderdate")).alias("approved_date"),
        F.to_date("o_orderdate").alias("received_date"), money("o_totalprice").alias("est_cost"))
    exemptions = t.orders.select(F.col("o_custkey").alias("parcel_id"), y.alias("first_bill_yr"),
                                 (y + k % 4 - 1).cast("int").alias("last_bill_yr"),
                                 money("o_totalprice").alias("home_imp_val"))
    out = pl.exemption_features(_years(t), applications, exemptions, t.years[0], t.years[-1])
    return out.select("parcel_id", "tax_yr", "hi_app_cnt_3yr", dbl("hi_est_cost_3yr", "hi_est_cost_3yr"),
                      "hi_exempt_active", *[dbl(c, c) for c in ("hi_exempt_val_active", "hi_rolloff_cur_val",
                                                              "hi_rolloff_next_val")], "hi_ever",
                      dbl("log_hi_exempt_val_active", "log_hi_exempt_val_active", 9))


@query("I08", f"""
WITH {_YEARS_SQL}, v AS (SELECT o_orderkey AS id, o_custkey AS estab, year(o_orderdate) AS yr, l_linenumber AS score, l_returnflag, l_linestatus, l_tax
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
i AS (SELECT id, estab, yr, MAX(score) AS score, MAX(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS red,
    MAX(CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END) AS unsat, AVG(CAST(l_tax * 100 AS INT)) AS grade FROM v GROUP BY 1, 2, 3),
a AS (SELECT estab % 400 AS parcel_id, yr + 1 AS tax_yr, COUNT(DISTINCT estab) AS ne, COUNT(*) AS ni, AVG(score) AS sm, MAX(score) AS sx, AVG(red) AS rs, AVG(unsat) AS us
  FROM i WHERE estab % 5 > 0 GROUP BY 1, 2),
r AS (SELECT *, CASE WHEN COUNT(*) OVER w >= 3 THEN AVG(sm) OVER w END AS s3 FROM a WINDOW w AS (PARTITION BY parcel_id ORDER BY tax_yr ROWS 2 PRECEDING)),
p AS (SELECT s.parcel_id, s.tax_yr, ne, ni, sm, sx, rs, us, s3 FROM spine s LEFT JOIN r ON r.parcel_id = s.parcel_id AND r.tax_yr = s.tax_yr)
SELECT parcel_id, tax_yr, last_value(ne IGNORE NULLS) OVER w AS hlth_n_estab, last_value(ni IGNORE NULLS) OVER w AS hlth_n_insp,
  round(last_value(sm IGNORE NULLS) OVER w, 9) AS hlth_score_mean, CAST(last_value(sx IGNORE NULLS) OVER w AS INT) AS hlth_score_max,
  round(last_value(rs IGNORE NULLS) OVER w, 9) AS hlth_red_share, round(last_value(us IGNORE NULLS) OVER w, 9) AS hlth_unsat_share,
  round(last_value(s3 IGNORE NULLS) OVER w, 8) AS hlth_score_mean_3yr
FROM p WINDOW w AS (PARTITION BY parcel_id ORDER BY tax_yr ROWS UNBOUNDED PRECEDING)""")
def inspection_features(t: Tables):
    heads = t.orders.select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("estab_id"),
                            F.to_date("o_orderdate").alias("inspection_date"))
    violations = t.lineitem.join(heads, "l_orderkey").select(
        F.col("l_orderkey").alias("inspection_id"), "estab_id", "inspection_date",
        F.col("l_linenumber").alias("score"),
        F.when(F.col("l_returnflag") == "R", "RED type").otherwise("blue").alias("violation_type"),
        F.when(F.col("l_linestatus") == "O", "Unsatisfactory").otherwise("ok").alias("result"),
        F.lit("false").alias("closed"), (F.col("l_tax") * 100).cast("int").alias("grade"))
    matches = t.customer.select(F.col("c_custkey").alias("estab_id"),
                                F.when(F.col("c_custkey") % 5 > 0, F.col("c_custkey") % 400).alias("parcel_id"))
    out = pl.inspection_features(_years(t), violations, matches)
    return out.select("parcel_id", "tax_yr", "hlth_n_estab", "hlth_n_insp", dbl("hlth_score_mean", "hlth_score_mean", 9),
                      "hlth_score_max", dbl("hlth_red_share", "hlth_red_share", 9),
                      dbl("hlth_unsat_share", "hlth_unsat_share", 9), dbl("hlth_score_mean_3yr", "hlth_score_mean_3yr", 8))


@query("I09 C06", """
WITH d AS (SELECT user_id AS parcel_id, event_id % 500 AS event_id, event_type AS attribute, CASE WHEN event_id % 5 = 0 THEN NULL ELSE CAST(event_id AS VARCHAR) END AS attribute_value, ts AS update_date
  FROM events WHERE event_type IN ('click', 'error')),
l AS (SELECT *, row_number() OVER (PARTITION BY parcel_id, event_id, attribute ORDER BY update_date DESC, attribute_value DESC) AS rn FROM d)
SELECT l.parcel_id, l.event_id, attribute, attribute_value, h.n AS n_events FROM l LEFT JOIN (
  SELECT user_id, event_id % 500 + CASE WHEN event_id % 3 = 0 THEN 1000 ELSE 0 END AS e, COUNT(*) AS n FROM events GROUP BY 1, 2) h ON h.user_id = parcel_id AND h.e = l.event_id WHERE rn = 1""")
def change_log(t: Tables):
    k = F.col("event_id")
    header = t.events.groupBy(F.col("user_id").alias("parcel_id"),
                              (k % 500 + F.when(k % 3 == 0, 1000).otherwise(0)).alias("event_id")).agg(
        F.count(F.lit(1)).alias("n_events"))
    detail = t.events.select(
        F.col("user_id").alias("parcel_id"), (k % 500).alias("event_id"), F.lit(1).alias("component_id"),
        F.concat(F.lit(" "), F.initcap("event_type")).alias("attribute"),
        F.when(k % 5 == 0, "(unknown)").otherwise(F.concat(F.lit("  "), _text(k))).alias("attribute_value"),
        F.col("ts").alias("update_date"), F.lit("x").alias("updated_by"))
    return pl.change_log(header, detail, ["click", "error"]).select(
        "parcel_id", "event_id", "attribute", "attribute_value", "n_events")


@query("I10", f"""
SELECT {_KEY.format(a='c', b='m')} AS parcel_id, tax_yr, k AS o_orderkey, CAST(x AS DOUBLE) AS appr_land_val FROM (
  SELECT *, row_number() OVER (PARTITION BY c, m, tax_yr ORDER BY d DESC, k DESC) AS rn FROM (
    SELECT o_custkey AS c, o_orderkey % 3 AS m, CAST(year(o_orderdate) + 5 AS INT) AS tax_yr, o_orderdate AS d, o_orderkey AS k,
           CAST(o_totalprice AS DECIMAL(18,2)) AS x FROM orders WHERE o_orderstatus <> 'P' AND o_orderkey % 6 > 0 AND o_orderkey % 11 > 0)
  WHERE tax_yr BETWEEN 2001 AND 2005) WHERE rn = 1""")
def value_history(t: Tables):
    k = F.col("o_orderkey")
    raw = t.orders.select(
        "o_orderkey", F.col("o_custkey").alias("major"), (k % 3).alias("minor"),
        (F.year("o_orderdate") + 5).alias("tax_yr"), F.when(k % 6 > 0, "0010").otherwise("9999").alias("levy_code"),
        F.when(F.col("o_orderstatus") == "P", "X").otherwise("T").alias("tax_status"),
        F.when(k % 11 == 0, "EX").alias("tax_val_reason"), F.col("o_orderdate").alias("change_date"),
        money("o_totalprice").alias("appr_land_val"))
    return pl.value_history(raw, 2001, 2005).select("parcel_id", "tax_yr", "o_orderkey",
                                                    dbl("appr_land_val", "appr_land_val"))


@query("I12", f"""
SELECT o_orderkey FROM orders WHERE NOT (o_orderkey % 3 = 0 AND o_custkey IN (SELECT s_suppkey * 2 FROM supplier))""")
def deduplicated_tracks(t: Tables):
    k = F.col("o_orderkey")
    residential = t.orders.select(k, _key(F.col("o_custkey"), k % 10000).alias("parcel_id"),
                                  (k % 3 == 0).cast("int").alias("is_small_mf"))
    commercial = t.supplier.select(_key(F.col("s_suppkey") * 2, F.lit(1)).alias("parcel_id"))
    return pl.dedup_tracks(residential, commercial).select("o_orderkey")


@query("I13", f"""
WITH {PANEL_SQL}, s AS (SELECT s_suppkey AS parcel_id, s_acctbal AS size FROM supplier), n AS (SELECT n_nationkey AS parcel_id FROM nation),
y AS (SELECT CAST(unnest(range(1999, 2002)) AS INT) AS tax_yr), d AS (SELECT tax_yr, COUNT(*) AS mkt_n FROM panel GROUP BY 1),
u AS (SELECT parcel_id, tax_yr, v, 'R' AS prop_type, NULL::DOUBLE AS size FROM panel
  UNION ALL SELECT s.parcel_id, y.tax_yr, v, 'C', size FROM s CROSS JOIN y LEFT JOIN panel p ON p.parcel_id = s.parcel_id AND p.tax_yr = y.tax_yr
  UNION ALL SELECT n.parcel_id, y.tax_yr, v, 'D', NULL FROM n CROSS JOIN y LEFT JOIN panel p ON p.parcel_id = n.parcel_id AND p.tax_yr = y.tax_yr)
SELECT parcel_id, u.tax_yr, CAST(v AS DOUBLE) AS v, prop_type, CASE prop_type WHEN 'R' THEN 'Residential' WHEN 'C' THEN 'Commercial' ELSE 'Condo' END AS prop_class,
  size, mkt_n FROM u LEFT JOIN d ON d.tax_yr = u.tax_yr""")
def unified_panel(t: Tables):
    p = panel(t).select("parcel_id", "tax_yr", dbl("v", "v"))
    commercial = t.supplier.select(F.col("s_suppkey").alias("parcel_id"), F.col("s_acctbal").alias("size"))
    condo = t.nation.select(F.col("n_nationkey").cast("long").alias("parcel_id"))
    drivers = p.groupBy("tax_yr").agg(F.count(F.lit(1)).alias("mkt_n"))
    return pl.unify_tracks(p, {"C": commercial, "D": condo}, p, range(1999, 2002), drivers)


# -- classification ----------------------------------------------------------

_OWNER = "c_name || CASE c_custkey % 4 WHEN 0 THEN ' LLC' WHEN 1 THEN ' Trust' ELSE '' END"


@query("I11", """
SELECT s_suppkey AS parcel_id, CAST(COALESCE(l, 0) AS INT) AS is_llc, CAST(COALESCE(e, 0) AS INT) AS is_entity FROM supplier LEFT JOIN (
  SELECT CASE WHEN c_custkey % 3 = 0 THEN c_custkey // 10 ELSE -c_custkey END AS k, MAX(CASE WHEN c_custkey % 4 = 0 THEN 1 ELSE 0 END) AS l, MAX(CASE WHEN c_custkey % 4 < 2 THEN 1 ELSE 0 END) AS e
  FROM customer GROUP BY 1) ON k = s_suppkey""")
def owner_flags(t: Tables):
    k = F.col("c_custkey")
    accounts = t.customer.select(
        F.when(k % 3 == 0, F.floor(k / 10)).otherwise(-k).alias("parcel_id"), F.expr(_OWNER).alias("taxpayer_name"))
    return cl.owner_flags(accounts, t.supplier.select(F.col("s_suppkey").alias("parcel_id")))


_NAMES = ("Apartment", "Nursinghome", "MajorOffice", "Warehouse", "Hotel", "Biotech", "MajorRetail", "Nothing")
_NAME = "CASE WHEN p_partkey % 3 = 0 THEN CASE p_partkey % 8 " + " ".join(
    f"WHEN {i} THEN '{n}'" for i, n in enumerate(_NAMES)) + " END END"
_USE = "CAST(p_size * 7 AS INT)"
_EXCLUDED = sql_list(codes.VACANT_USES + codes.PARKING_USES)


def _sub_rows(t: Tables):
    return t.part.select("p_partkey", F.expr(_NAME).alias("spec_area_name"), F.expr(_USE).alias("present_use"))


@query("I14", f"""
SELECT p_partkey, COALESCE(CASE {sql_groups('n', codes.SUBGROUP_SPECIALTIES)} END,
  CASE WHEN u NOT IN ({_EXCLUDED}) THEN CASE {sql_groups('u', codes.SUBGROUP_USES)} END END, 'other') AS com_subgroup
FROM (SELECT p_partkey, {_NAME} AS n, {_USE} AS u FROM part)""")
def assigned_subgroup(t: Tables):
    return cl.assign_subgroup(_sub_rows(t)).select("p_partkey", "com_subgroup")


@query("I14", f"""
SELECT p_partkey, CASE {" ".join(f"WHEN n IN ({sql_list(codes.SUBGROUP_SPECIALTIES[k])}) THEN '{k}' WHEN u IN ({sql_list(codes.SUBGROUP_USES[k])}) AND u NOT IN ({_EXCLUDED}) THEN '{k}'" for k in codes.SUBGROUP_USES)}
  ELSE 'other' END AS com_subgroup FROM (SELECT p_partkey, {_NAME} AS n, {_USE} AS u FROM part)""")
def assigned_subgroup_interleaved(t: Tables):
    return cl.assign_subgroup(_sub_rows(t), interleaved=True).select("p_partkey", "com_subgroup")


# Parts as parcels: size as present use, lines as sections and buildings, names as text.
_PU = "CAST(CASE WHEN p_partkey % 5 = 0 THEN 300 WHEN p_partkey % 17 = 0 THEN 180 WHEN p_partkey % 4 = 0 THEN p_size * 5 ELSE 900 END AS INT)"
_SECTION = "CAST(CASE WHEN l_suppkey % 3 = 0 THEN 250 ELSE 300 + l_suppkey * 13 % 260 END AS INT)"
_CLASS_SQL = f"""
par AS (SELECT p_partkey AS parcel_id, {_PU} AS u, upper(trim({_ZONE})) AS z, {_ZONE} AS zone, {NORMAL_SQL.format(x=TEXT_EXPR)} AS w FROM part),
ln AS (SELECT l_partkey AS parcel_id, {_SECTION} AS u, CAST(l_quantity AS INT) AS q, l_orderkey FROM lineitem),
sec AS (SELECT parcel_id, c, SUM(q) AS w FROM (SELECT CASE WHEN l_orderkey % 2 = 0 THEN parcel_id ELSE -parcel_id END AS parcel_id, q, {_USE118} AS c FROM ln) WHERE c IS NOT NULL AND q > 0 GROUP BY 1, 2),
dom AS (SELECT * FROM (SELECT parcel_id, c, w / CAST(SUM(w) OVER (PARTITION BY parcel_id) AS DOUBLE) AS share,
          row_number() OVER (PARTITION BY parcel_id ORDER BY w DESC, c) AS rn FROM sec) WHERE rn = 1 AND share >= 0.5),
big AS (SELECT parcel_id, b, {_USE118.replace('u ', 'b ')} AS c FROM (SELECT parcel_id, u AS b, row_number() OVER (PARTITION BY parcel_id ORDER BY q DESC, u) AS rn
          FROM (SELECT * REPLACE (CASE WHEN l_orderkey % 5 = 1 THEN parcel_id ELSE -parcel_id END AS parcel_id) FROM ln)) WHERE rn = 1),
kw AS (SELECT parcel_id, {KEYWORD_SQL} AS c FROM par),
t AS (SELECT p.parcel_id, COALESCE(u IN ({sql_list(codes.VACANT_USES)}), FALSE) AS vac, COALESCE(u IN ({sql_list(codes.PARKING_USES)}), FALSE) AS park, u,
    CASE {sql_groups('u', codes.SUBGROUP_USES)} END AS t1, dom.c AS t2, share, big.c AS t3, b, kw.c AS t4, {_ZONING} AS t5, zone
  FROM par p LEFT JOIN dom ON dom.parcel_id = p.parcel_id LEFT JOIN big ON big.parcel_id = p.parcel_id JOIN kw ON kw.parcel_id = p.parcel_id),
cls AS (SELECT parcel_id, CASE WHEN park THEN NULL WHEN vac THEN CASE WHEN COALESCE(t1, t2, t3, t4) IS NULL THEN t5 END ELSE COALESCE(t1, t2, t3, t4) END AS subgroup,
  CASE WHEN park THEN 'parking_hold' WHEN vac THEN CASE WHEN COALESCE(t1, t2, t3, t4) IS NULL AND t5 IS NOT NULL THEN '5_zoning' END
       WHEN t1 IS NOT NULL THEN '1_present_use' WHEN t2 IS NOT NULL THEN '2_section_use' WHEN t3 IS NOT NULL THEN '3_predominant_use' WHEN t4 IS NOT NULL THEN '4_keyword' END AS class_tier,
  CASE WHEN park THEN 'PresentUse parking' WHEN vac THEN CASE WHEN COALESCE(t1, t2, t3, t4) IS NULL AND t5 IS NOT NULL THEN 'Zoning=' || zone END
       WHEN t1 IS NOT NULL THEN 'PresentUse=' || u WHEN t2 IS NOT NULL THEN 'SectionUse share=' || printf('%.2f', round(share, 2)) WHEN t3 IS NOT NULL THEN 'PredominantUse=' || b
       WHEN t4 IS NOT NULL THEN 'keyword n=1' END AS class_evidence FROM t)"""


def _classified(t: Tables):
    parcels = t.part.select(F.col("p_partkey").alias("parcel_id"), F.expr(_PU).alias("present_use"),
                            F.expr(_ZONE).alias("current_zoning"), F.expr(TEXT_EXPR).alias("property_name"))
    lines = t.lineitem.select(F.col("l_partkey").alias("parcel_id"), F.expr(_SECTION).alias("use"),
                              F.col("l_quantity").cast("int").alias("q"), "l_orderkey")
    # Lines of no known parcel have a key of their own.
    own = lambda known: F.when(known, F.col("parcel_id")).otherwise(-F.col("parcel_id")).alias("parcel_id")
    sections = lines.select(
        own(F.col("l_orderkey") % 2 == 0), F.col("use").alias("section_use"), F.col("q").alias("gross_sqft"))
    buildings = lines.select(
        own(F.col("l_orderkey") % 5 == 1), F.col("use").alias("predominant_use"), F.col("q").alias("bldg_gross_sqft"))
    return cl.classify_waterfall(parcels, sections, buildings, max_tier=5)


@query("I15", f"WITH {_CLASS_SQL} SELECT parcel_id, subgroup, class_tier, class_evidence FROM cls")
def classified_parcels(t: Tables):
    return _classified(t).select("parcel_id", "subgroup", "class_tier", "class_evidence")


@query("I15", f"""
WITH v AS (SELECT l_orderkey AS parcel_id, c, COUNT(*) AS n, MIN(rk) AS rk FROM (
  SELECT l_orderkey, {KEYWORD_SQL} AS c, CASE WHEN l_linenumber < 3 THEN 1 WHEN l_linenumber < 5 THEN 2 ELSE 4 END AS rk
  FROM (SELECT l_orderkey, l_linenumber, {NORMAL_SQL.format(x=TEXT_EXPR)} AS w FROM lineitem JOIN part ON l_partkey = p_partkey)) WHERE c IS NOT NULL GROUP BY 1, 2),
b AS (SELECT *, row_number() OVER (PARTITION BY parcel_id ORDER BY n DESC, rk, c) AS rn FROM v)
SELECT o_orderkey AS parcel_id, c AS subgroup, CASE WHEN c IS NOT NULL THEN '4_keyword' END AS class_tier,
  CASE WHEN c IS NOT NULL THEN 'keyword n=' || n END AS class_evidence FROM orders LEFT JOIN b ON parcel_id = o_orderkey AND rn = 1""")
def classified_by_keyword_votes(t: Tables):
    parcels = t.orders.select(F.col("o_orderkey").alias("parcel_id"), F.lit(900).alias("present_use"),
                              F.lit(None).cast("string").alias("current_zoning"),
                              F.lit(None).cast("string").alias("property_name"))
    nbr = F.col("l_linenumber")
    src = F.when(nbr < 3, "SectionDescr").when(nbr < 5, "BldgDescr").otherwise("PermitProject")
    named = t.part.select(F.col("p_partkey").alias("l_partkey"), F.expr(TEXT_EXPR).alias("txt"))
    texts = t.lineitem.join(named, "l_partkey").select(F.col("l_orderkey").alias("parcel_id"),
                                                       src.alias("src"), "txt")
    return cl.classify_waterfall(parcels, texts=[texts], max_tier=4).select(
        "parcel_id", "subgroup", "class_tier", "class_evidence")


_TRUTH = "CASE p_partkey % 6 WHEN 0 THEN 'medical' WHEN 1 THEN 'apt' WHEN 2 THEN 'industrial' WHEN 3 THEN 'office' WHEN 4 THEN 'retail' END"


@query("I16", f"""
WITH {_CLASS_SQL}, j AS (SELECT {_TRUTH} AS truth, subgroup, class_tier FROM part JOIN cls ON parcel_id = p_partkey WHERE p_partkey % 6 < 5)
SELECT 'all' AS class_tier, COUNT(*) AS n, COUNT(subgroup) AS n_predicted, round(AVG(CASE WHEN subgroup IS NOT NULL THEN CAST(subgroup = truth AS INT) END), 9) AS accuracy,
  round(AVG(CASE WHEN subgroup IS NULL THEN 0 ELSE 1 END), 9) AS coverage FROM j
UNION ALL SELECT class_tier, COUNT(*), COUNT(*), round(AVG(CAST(subgroup = truth AS INT)), 9), 1.0 FROM j WHERE subgroup IS NOT NULL GROUP BY 1""")
def classifier_validation(t: Tables):
    known = t.part.select(F.col("p_partkey").alias("parcel_id"), F.expr(_TRUTH).alias("truth"))
    out = cl.validate_classifier(known, _classified(t))
    return out.select("class_tier", "n", "n_predicted", dbl("accuracy", "accuracy", 9),
                      dbl("coverage", "coverage", 9))


@query("I17", f"WITH {_CLASS_SQL} SELECT COALESCE(class_tier, 'unmatched') AS class_tier, subgroup, COUNT(*) AS n_entities FROM cls GROUP BY 1, 2")
def classification_audit(t: Tables):
    return cl.class_audit(_classified(t))


