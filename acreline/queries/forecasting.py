"""Queries for model frames, training, rate routing and forecasts."""

from __future__ import annotations

from pyspark.sql import functions as F

from acreline.functions import codes
from acreline.operators.joins import expand_snapshot
from acreline.plans import forecast as fc
from acreline.plans import modeling as md
from acreline.plans import reconcile as rc
from acreline.queries.base import (GRID_SQL, PANEL_SQL, PARTS_SQL, Tables, dbl, grid, money, panel,
                                   parts, query, sql_codes)
from acreline.queries.reconciling import with_segment
from acreline.sources.extracts import run_path

_K, _Y = "parcel_id", "tax_yr"


# -- folds, frames, features -------------------------------------------------

@query("J01", f"""
WITH {PANEL_SQL}, y AS (SELECT tax_yr, row_number() OVER (ORDER BY tax_yr) AS i, COUNT(*) OVER () AS n FROM (SELECT DISTINCT tax_yr FROM panel)),
c AS (SELECT DISTINCT CAST(round_even(3 + k * (n - 1 - 3) / 4.0, 0) AS INT) AS i FROM (SELECT DISTINCT n FROM y) CROSS JOIN (SELECT unnest(range(0, 5)) AS k)),
f AS (SELECT row_number() OVER (ORDER BY i) AS fold, tax_yr AS cut_yr FROM c JOIN y USING (i))
SELECT CAST(fold AS INT) AS fold, cut_yr, CAST(SUM(CASE WHEN tax_yr <= cut_yr THEN 1 ELSE 0 END) AS BIGINT) AS n_train,
  CAST(SUM(CASE WHEN tax_yr > cut_yr THEN 1 ELSE 0 END) AS BIGINT) AS n_val FROM f CROSS JOIN panel GROUP BY 1, 2""")
def rolling_year_folds(t: Tables):
    p = panel(t)
    return md.fold_rows(p, md.rolling_year_folds(p))


@query("J02", f"""
WITH {PANEL_SQL}, f AS (SELECT row_number() OVER (ORDER BY tax_yr) AS fold, tax_yr AS test_yr FROM (SELECT DISTINCT tax_yr FROM panel ORDER BY 1 DESC LIMIT 3))
SELECT CAST(fold AS INT) AS fold, test_yr, CAST(SUM(CASE WHEN tax_yr < test_yr THEN 1 ELSE 0 END) AS BIGINT) AS n_train,
  CAST(SUM(CASE WHEN tax_yr = test_yr THEN 1 ELSE 0 END) AS BIGINT) AS n_val FROM f CROSS JOIN panel GROUP BY 1, 2""")
def last_year_folds(t: Tables):
    p = panel(t)
    return md.fold_rows(p, md.last_year_folds(p))


_W = "OVER (PARTITION BY parcel_id ORDER BY tax_yr)"
_LOGS = f"x AS (SELECT parcel_id, tax_yr, ln(CAST(v AS DOUBLE)) AS l FROM grid WHERE tax_yr > 1995), lg AS (SELECT *, lag(l, 1) {_W} AS l1, lag(l, 2) {_W} AS l2 FROM x)"


def _frames(t: Tables):
    rows = grid(t).withColumns({"econ_lvl": F.col(_Y) * 2, "econ_yoy": F.col(_Y) * 3})
    return md.training_frames(rows, "v", from_year=1995)


@query("J03", f"""
WITH {PANEL_SQL}, {GRID_SQL}, {_LOGS} SELECT parcel_id, tax_yr, tax_yr * 3 AS econ_yoy, round(l, 9) AS log_v, round(l1, 9) AS log_v_lag1,
  round(l2, 9) AS log_v_lag2, round(l - l1, 9) AS delta_log_v FROM lg WHERE l IS NOT NULL AND l1 IS NOT NULL""")
def delta_frame(t: Tables):
    delta, _ = _frames(t)
    logs = ("log_v", "log_v_lag1", "log_v_lag2", "delta_log_v")
    return delta.select(_K, _Y, "econ_yoy", *[dbl(c, c, 9) for c in logs])


@query("J03", f"""
WITH {PANEL_SQL}, {GRID_SQL}, {_LOGS} SELECT parcel_id, tax_yr, tax_yr * 2 AS econ_lvl, round(l, 9) AS log_v FROM lg WHERE l IS NOT NULL""")
def level_frame(t: Tables):
    _, level = _frames(t)
    return level.select(_K, _Y, "econ_lvl", dbl("log_v", "log_v", 9))


@query("J04", f"""
WITH {PARTS_SQL}, x AS (SELECT parcel_id, tax_yr, ln(CAST(appr_land_val AS DOUBLE)) AS l, ln(CAST(appr_imps_val AS DOUBLE)) AS i FROM parts),
d AS (SELECT *, lag(l) {_W} AS l1, lag(l, 2) {_W} AS l2, lag(i) {_W} AS i1, lag(i, 2) {_W} AS i2 FROM x),
f AS (SELECT unnest([parcel_id % 50, 1, CASE WHEN parcel_id < 2 THEN parcel_id END, l1, l2, i1, i2]::DOUBLE[]) AS v, unnest(range(7)) AS k FROM d),
kept AS (SELECT CAST(COUNT(*) AS INT) AS n_features FROM (SELECT k FROM f GROUP BY k HAVING COUNT(v) >= 50 AND MIN(v) < MAX(v)))
SELECT name, n AS n_rows, n_features FROM (
  SELECT 'land_delta' AS name, COUNT(CASE WHEN abs(l - l1) <= 1 THEN 1 END) AS n FROM d UNION ALL SELECT 'land_level', COUNT(l) FROM d
  UNION ALL SELECT 'impr_delta', COUNT(CASE WHEN abs(i - i1) <= 1 THEN 1 END) FROM d UNION ALL SELECT 'impr_level', COUNT(i) FROM d) CROSS JOIN kept WHERE n > 100""")
def subgroup_frames(t: Tables):
    rows = parts(t).withColumns({"size": F.col(_K) % 50, "constant": F.lit(1),
                                 "rare": F.when(F.col(_K) < 2, F.col(_K))})
    frames = md.subgroup_frames(rows, ["size", "constant", "rare"])
    out = None
    for name, (frame, features) in sorted(frames.items()):
        part = frame.agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("n_rows"),
                         F.lit(len(features)).alias("n_features"))
        out = part if out is None else out.unionByName(part)
    return out


@query("J05", """
WITH n AS (SELECT COUNT(*) AS n_rows, COUNT(CASE WHEN c_custkey % 3 = 0 THEN 1 END) AS k3 FROM customer)
SELECT feature, n_rows, n_known, n_levels, reason, reason IS NULL AS keep FROM (
  SELECT 'c_acctbal' AS feature, n_rows, n_rows AS n_known, NULL::BIGINT AS n_levels, NULL::VARCHAR AS reason FROM n
  UNION ALL SELECT 'flat', n_rows, n_rows, NULL, 'constant' FROM n UNION ALL SELECT 'sparse', n_rows, k3, NULL, 'mostly_null' FROM n
  UNION ALL SELECT 'cs_off_cap_rate', n_rows, n_rows, NULL, 'no_coverage' FROM n UNION ALL SELECT 'empty', n_rows, 0, NULL, 'too_few' FROM n
  UNION ALL SELECT 'c_mktsegment', n_rows, n_rows, (SELECT COUNT(DISTINCT c_mktsegment) FROM customer), NULL FROM n
  UNION ALL SELECT 'c_name', n_rows, n_rows, (SELECT COUNT(DISTINCT c_name) FROM customer), CASE WHEN (SELECT COUNT(DISTINCT c_name) FROM customer) > 200 THEN 'many_levels' END FROM n
  UNION ALL SELECT 'one', n_rows, n_rows, 1, 'single_level' FROM n)""")
def screened_features(t: Tables):
    rows = t.customer.select("c_acctbal", "c_mktsegment", "c_name", F.lit(5).alias("flat"), F.lit("x").alias("one"),
                             F.when(F.col("c_custkey") % 3 == 0, F.col("c_acctbal")).alias("sparse"),
                             F.col("c_acctbal").alias("cs_off_cap_rate"), F.lit(None).cast("double").alias("empty"))
    return md.screen_features(rows, ["c_acctbal", "flat", "sparse", "cs_off_cap_rate", "empty"],
                              ["c_mktsegment", "c_name", "one"], dead=md.dead_pattern())


@query("J06", """
WITH m AS (SELECT median(CASE WHEN c_custkey % 3 > 0 THEN c_acctbal END) AS a, median(CAST(CASE WHEN c_custkey % 4 > 0 THEN c_nationkey END AS DOUBLE)) AS b FROM customer)
SELECT c_custkey, COALESCE(CASE WHEN c_custkey % 3 > 0 THEN c_acctbal END, a) AS balance, COALESCE(CASE WHEN c_custkey % 4 > 0 THEN CAST(c_nationkey AS DOUBLE) END, b) AS nation,
  COALESCE(CASE WHEN c_custkey % 5 > 0 THEN c_mktsegment END, 'Unknown') AS segment FROM customer CROSS JOIN m""")
def imputed_features(t: Tables):
    k = F.col("c_custkey")
    rows = t.customer.select(k, F.when(k % 3 > 0, F.col("c_acctbal")).alias("balance"),
                             F.when(k % 4 > 0, F.col("c_nationkey")).alias("nation"),
                             F.when(k % 5 > 0, F.col("c_mktsegment")).alias("segment"))
    return md.apply_imputer(rows, md.fit_imputer(rows, ["balance", "nation"]), ["segment"])


@query("J07", """
SELECT p_partkey, CASE WHEN b IS NULL THEN NULL WHEN n >= 80 THEN b ELSE 'Other' END AS brand FROM (
  SELECT p_partkey, b, COUNT(*) OVER (PARTITION BY b) AS n FROM (SELECT p_partkey, CASE WHEN p_partkey % 9 > 0 THEN p_brand END AS b FROM part))""")
def lumped_levels(t: Tables):
    rows = t.part.select("p_partkey", F.when(F.col("p_partkey") % 9 > 0, F.col("p_brand")).alias("brand"))
    return md.lump_levels(rows, "brand", 80)


@query("J09", f"WITH {PANEL_SQL} SELECT parcel_id, tax_yr, CASE tax_yr WHEN 1999 THEN 0.5 WHEN 2001 THEN 2.0 ELSE 1.0 END::DOUBLE AS weight FROM panel")
def year_weights(t: Tables):
    return md.year_weights(panel(t), {1999: 0.5, 2001: 2.0}).select(_K, _Y, "weight")


def _model_rows(t: Tables):
    segment = t.customer.select(F.col("c_custkey").alias(_K), "c_mktsegment", "c_nationkey", "c_acctbal")
    delta, _ = md.training_frames(panel(t), "v")
    return delta.join(segment, _K).withColumn("weight", F.when(F.col(_Y) == 2001, 2.0).otherwise(1.0))


_FITTED: dict[tuple[str, str], md.FittedModel] = {}


def _fitted(t: Tables):
    """The model at the operator's own settings, five folds; fitted once for the queries of a session that use it."""
    rows, key = _model_rows(t), (t.spark.sparkContext.applicationId, t.path)
    if key not in _FITTED:
        cuts = [r["cut_yr"] for r in md.rolling_year_folds(rows).collect()]
        _FITTED[key] = md.fit_model(rows, "delta_log_v", ["log_v_lag1", "c_acctbal", "c_nationkey"], ["c_mktsegment"],
                                    folds=cuts, weight="weight")
    return rows, _FITTED[key]


@query("J08 J10")
def trained_predictions(t: Tables):
    rows, model = _fitted(t)
    scored = md.score(rows, model, "pred_delta")
    return scored.select(_K, _Y, "pred_delta", F.lit(model.cv_rmse).alias("cv_rmse"), F.lit(model.n_trees).alias("n_trees"))


@query("J08 J10", f"""
WITH {PANEL_SQL}, y AS (SELECT parcel_id, tax_yr, lag(v) {_W} AS before FROM panel)
SELECT tax_yr, COUNT(*) AS n, COUNT(*) AS n_scored, TRUE AS below_mean FROM y WHERE before IS NOT NULL GROUP BY 1""")
def model_checks(t: Tables):
    """Every row is scored, and the held-out error is below that of the mean."""
    rows, model = _fitted(t)
    spread = rows.agg(F.stddev("delta_log_v")).first()[0]
    return md.score(rows, model, "pred_delta").groupBy(_Y).agg(
        F.count(F.lit(1)).alias("n"), F.count("pred_delta").alias("n_scored"),
        F.lit(bool(model.cv_rmse < spread)).alias("below_mean"))


_FAMILIES = (("^log_v_lag", "lags"), ("^c_acct", "balance"))


@query("J37")
def feature_importance(t: Tables):
    _, model = _fitted(t)
    summary, top = md.importance_by_family(model, t.spark, _FAMILIES)
    return top.join(summary, "family")


@query("J37", """
SELECT family, n_features, 1.0::DOUBLE AS all_gains, n_features AS n_top, TRUE AS top_within
FROM (VALUES ('lags', 1::BIGINT), ('balance', 1), ('entity', 2)) x(family, n_features)""")
def feature_importance_checks(t: Tables):
    """Families hold the features that their patterns name, gains are shares of one, and the top ones are among them."""
    _, model = _fitted(t)
    summary, top = md.importance_by_family(model, t.spark, _FAMILIES)
    whole = summary.agg(F.round(F.sum("total_gain"), 6)).scalar()
    per_family = top.groupBy("family").agg(F.count(F.lit(1)).alias("n_top"), F.sum("gain").alias("_top"))
    return summary.join(per_family, "family").select(
        "family", "n_features", whole.alias("all_gains"), "n_top",
        (F.abs(F.col("_top") - F.col("total_gain")) < 1e-9).alias("top_within"))


# -- retrofit, extension, hold-out -------------------------------------------

def _scorers():
    """Column-expression models, so that SQL can state the same forecast."""
    f = F.col("size").cast("double")
    return {"land_delta": lambda df, out: df.withColumn(out, 0.01 + 0.002 * f),
            "land_level": lambda df, out: df.withColumn(out, 10 + 0.1 * f),
            "impr_delta": lambda df, out: df.withColumn(out, 0.05 * f - 0.01 * F.col("log_imps_lag1") + 0.1 * f),
            "impr_level": lambda df, out: df.withColumn(out, 9 + 0.1 * f)}


@query("J11", f"""
WITH {PARTS_SQL}, x AS (SELECT parcel_id, tax_yr, CASE WHEN parcel_id % 4 > 0 THEN CAST(appr_land_val AS DOUBLE) END AS l,
    CASE WHEN (parcel_id + tax_yr) % 3 > 0 THEN CAST(appr_imps_val AS DOUBLE) END AS i, parcel_id % 7 AS size, CASE WHEN parcel_id % 11 = 0 THEN 1 WHEN parcel_id % 11 = 1 THEN 0 END AS lo FROM parts),
y AS (SELECT *, lag(ln(i)) {_W} AS i1 FROM x),
f AS (SELECT *, COALESCE(CASE WHEN l IS NULL THEN exp(10 + 0.1 * size) END, l) AS lf,
    CASE WHEN lo = 1 THEN 0 ELSE COALESCE(i, exp(COALESCE(i1 + 0.03 * size, 9 + 0.1 * size))) END AS if FROM y)
SELECT parcel_id, tax_yr, round(lf, 4) AS appr_land_val_filled, round(if, 4) AS appr_imps_val_filled, round(lf + if, 4) AS total_assessed_filled FROM f""")
def retrofitted_panel(t: Tables):
    rows = parts(t).select(
        _K, _Y, F.when(F.col(_K) % 4 > 0, F.col("appr_land_val").cast("double")).alias("appr_land_val"),
        F.when((F.col(_K) + F.col(_Y)) % 3 > 0, F.col("appr_imps_val").cast("double")).alias("appr_imps_val"),
        (F.col(_K) % 7).alias("size"),
        F.when(F.col(_K) % 11 == 0, 1).when(F.col(_K) % 11 == 1, 0).alias("is_land_only"))
    s = _scorers()
    out = md.retrofit(rows, s["land_level"], lambda df, o: df.withColumn(o, 0.03 * F.col("size")), s["impr_level"])
    return out.select(_K, _Y, *[dbl(c, c, 4) for c in ("appr_land_val_filled", "appr_imps_val_filled",
                                                       "total_assessed_filled")])


@query("J12", f"""
WITH {PANEL_SQL}, {GRID_SQL} SELECT parcel_id, tax_yr, CAST(COALESCE(
  last_value(v IGNORE NULLS) OVER (PARTITION BY parcel_id ORDER BY tax_yr ROWS UNBOUNDED PRECEDING),
  first_value(v IGNORE NULLS) OVER (PARTITION BY parcel_id ORDER BY tax_yr ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS DOUBLE) AS v FROM grid""")
def retrofit_by_carry(t: Tables):
    return md.retrofit_carry(grid(t), ["v"]).select(_K, _Y, dbl("v", "v"))


@query("J13", f"""
WITH {PANEL_SQL}, d AS (SELECT tax_yr + 7 AS tax_yr, COUNT(*) AS mkt_n FROM panel GROUP BY 1), h AS (SELECT parcel_id, tax_yr, v, tax_yr - 1990 AS age FROM panel),
l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY parcel_id ORDER BY tax_yr DESC) AS rn FROM h) WHERE rn = 1)
SELECT parcel_id, tax_yr, CAST(v AS DOUBLE) AS v, CAST(age AS INT) AS age, NULL::BIGINT AS mkt_n FROM h
UNION ALL SELECT parcel_id, CAST(y AS INT), NULL, CAST(age + y - 2001 AS INT), mkt_n FROM l CROSS JOIN (SELECT unnest([2002, 2003]) AS y) LEFT JOIN d ON d.tax_yr = y""")
def extended_panel(t: Tables):
    p = panel(t)
    history = p.select(_K, _Y, dbl("v", "v"), (F.col(_Y) - 1990).alias("age"))
    drivers = p.groupBy((F.col(_Y) + 7).alias(_Y)).agg(F.count(F.lit(1)).alias("mkt_n"))
    return md.extend_panel(history, [2002, 2003], drivers, targets=["v"], advance=["age"])


@query("J13", f"""
WITH {PANEL_SQL} SELECT parcel_id, tax_yr, CAST(v AS DOUBLE) AS v FROM panel
UNION ALL SELECT parcel_id, CAST(y AS INT), NULL FROM panel CROSS JOIN (SELECT unnest([2002, 2003]) AS y) WHERE tax_yr = 2001""")
def extended_from_last_year(t: Tables):
    history = panel(t).select(_K, _Y, dbl("v", "v"))
    return md.extend_panel(history, [2002, 2003], state="last_year", targets=["v"])


@query("J36", f"""
WITH {PANEL_SQL}, x AS (SELECT parcel_id, tax_yr, ln(CAST(v AS DOUBLE)) AS a FROM panel), y AS (SELECT *, lag(a) {_W} AS l1 FROM x),
s AS (SELECT a, l1 + 0.02 AS p FROM y WHERE tax_yr = 2000 AND l1 IS NOT NULL)
SELECT COUNT(*) AS n, round(sqrt(AVG((a - p) ** 2)), 6) AS rmse_log, round(AVG(abs(exp(a) - exp(p)) / greatest(exp(a), 20000)), 6) AS mape,
  round(SUM(abs(exp(a) - exp(p))) / SUM(exp(a)), 6) AS wape, round(SUM(exp(p)) / SUM(exp(a)) - 1, 6) AS gap_pct FROM s""")
def holdout_evaluation(t: Tables):
    metrics, totals = md.evaluate_holdout(panel(t), 2000, "v", lambda df, out: df.withColumn(out, F.lit(0.02)),
                                          by=[_Y])
    return metrics.join(totals, _Y).select(
        "n", *[dbl(c, c, 6) for c in ("rmse_log", "mape", "wape", "gap_pct")])


# -- rates -------------------------------------------------------------------

# Published rates, one per nation and region: geographic for even nations, specialty
# for regions 1 and 2, an older specialty rate for region 3.
_RATES_SQL = """rates AS (
  SELECT CAST(2001 AS INT) AS ayr, 'com' AS pt, 'geo' AS kind, n_nationkey AS area, NULL::INT AS spec, (n_nationkey - 10) / 100.0::DOUBLE AS pct FROM nation WHERE n_nationkey % 2 = 0
  UNION ALL SELECT 2001, 'res', 'geo', n_nationkey, NULL, (n_nationkey - 5) / 200.0::DOUBLE FROM nation
  UNION ALL SELECT 2001, 'com', 'specialty', NULL, r_regionkey, r_regionkey / 50.0::DOUBLE FROM region WHERE r_regionkey IN (1, 2)
  UNION ALL SELECT 2000, 'com', 'specialty', NULL, r_regionkey, -0.03 FROM region WHERE r_regionkey = 3)"""


def _published(t: Tables):
    nation, region = F.col("n_nationkey"), F.col("r_regionkey")
    null = F.lit(None).cast("int")

    def rows(df, yr, prop, kind, area, spec, pct):
        return df.select(F.lit(yr).alias("assessment_yr"), F.lit(prop).alias("prop_type"), F.lit(kind).alias("report_kind"),
                         area.alias("area"), spec.alias("spec_area"), F.lit("population").alias("basis"),
                         pct.cast("double").alias("pct_change"), F.lit("r.txt").alias("source_file"))

    return (rows(t.nation.filter("n_nationkey % 2 = 0"), 2001, "com", "geo", nation, null, (nation - 10) / 100.0)
            .unionByName(rows(t.nation, 2001, "res", "geo", nation, null, (nation - 5) / 200.0))
            .unionByName(rows(t.region.filter("r_regionkey IN (1, 2)"), 2001, "com", "specialty", null, region, region / 50.0))
            .unionByName(rows(t.region.filter("r_regionkey = 3"), 2000, "com", "specialty", null, region, F.lit(-0.03))))


_FUT_SQL = """fut AS (SELECT c_custkey AS parcel_id, CAST(y AS INT) AS tax_yr, c_nationkey AS area, CASE WHEN c_custkey % 3 = 0 THEN 0 ELSE CAST(c_custkey % 4 AS INT) END AS spec
  FROM customer CROSS JOIN (SELECT unnest(range(2001, 2004)) AS y))"""


def _future(t: Tables):
    k = F.col("c_custkey")
    snap = t.customer.select(k.alias(_K), F.col("c_nationkey").alias("area"),
                             F.when(k % 3 == 0, 0).otherwise((k % 4).cast("int")).alias("spec_area"))
    return expand_snapshot(snap, range(2001, 2004))


_ROUTED = f"""
WITH {_RATES_SQL}, {_FUT_SQL}, j AS (SELECT f.*, ln(1 + s.pct) AS s, ln(1 + g.pct) AS g, (SELECT ln(1 + arg_max(pct, ayr)) FROM rates p WHERE p.kind = 'specialty' AND p.spec = f.spec AND p.ayr + 1 < f.tax_yr) AS p
  FROM fut f LEFT JOIN rates s ON s.kind = 'specialty' AND s.spec = f.spec AND s.ayr + 1 = f.tax_yr
  LEFT JOIN rates g ON g.kind = 'geo' AND g.pt = 'com' AND g.area = f.area AND g.ayr + 1 = f.tax_yr)
SELECT parcel_id, tax_yr, round(COALESCE({{0}}), 9) AS dlog_actual, CASE {{1}} END AS rate_source FROM j"""


def _route(t: Tables, **options):
    out = fc.route_rates(_future(t), _published(t), fc.ForecastOptions(**options), 2003)
    return out.select(_K, _Y, dbl("dlog_actual", "dlog_actual", 9), "rate_source")


_GEO = "CASE WHEN NOT COALESCE(spec > 0, FALSE) THEN g END"


@query("J15", _ROUTED.format(f"s, {_GEO}", f"WHEN s IS NOT NULL THEN 'specialty_report' WHEN {_GEO} IS NOT NULL THEN 'geo_report'"))
def routed_rates(t: Tables):
    return _route(t)


@query("J15", _ROUTED.format("s, g, CASE WHEN spec > 0 THEN 0 END", "WHEN s IS NOT NULL THEN 'specialty_report' WHEN g IS NOT NULL THEN 'geo_report' WHEN spec > 0 THEN 'specialty_hold_flat'"))
def routed_rates_all_hold(t: Tables):
    return _route(t, geo_scope="all", specialty_policy="hold")


_PRIOR = "CASE WHEN spec > 0 THEN p END"


@query("J15", _ROUTED.format(f"s, {_GEO}, {_PRIOR}", f"WHEN s IS NOT NULL THEN 'specialty_report' WHEN {_GEO} IS NOT NULL THEN 'geo_report' WHEN {_PRIOR} IS NOT NULL THEN 'specialty_prior_year'"))
def routed_rates_prior(t: Tables):
    return _route(t, specialty_policy="prior")


@query("J16", f"""
WITH {_RATES_SQL}, {_FUT_SQL} SELECT parcel_id, tax_yr, round(ln(1 + pct), 9) AS dlog_actual FROM fut
LEFT JOIN rates r ON r.pt = 'res' AND r.area = fut.area AND ayr + 1 = tax_yr""")
def area_anchors(t: Tables):
    return fc.area_anchor(_future(t), _published(t)).select(_K, _Y, dbl("dlog_actual", "dlog_actual", 9))


@query("J38", f"""
SELECT tax_yr, COALESCE(spec > 0, FALSE) AS is_specialty, COALESCE(rate_source, 'model') AS rate_source, COUNT(*) AS n_entities, CAST(SUM(CAST(c_acctbal AS DECIMAL(18,2))) AS DOUBLE) AS prior_value
FROM (WITH {_FUT_SQL} SELECT * FROM fut) f JOIN ({_ROUTED.format(f"s, {_GEO}", f"WHEN s IS NOT NULL THEN 'specialty_report' WHEN {_GEO} IS NOT NULL THEN 'geo_report'")}) r USING (parcel_id, tax_yr)
JOIN customer ON c_custkey = parcel_id GROUP BY 1, 2, 3""")
def rate_coverage(t: Tables):
    rated = fc.route_rates(_future(t), _published(t), last_year=2003)
    rows = rated.join(t.customer.select(F.col("c_custkey").alias(_K), money("c_acctbal").alias("prior")), _K)
    return fc.rate_coverage(rows, "prior").withColumn("prior_value", F.col("prior_value").cast("double"))


# -- gates and fall-backs ----------------------------------------------------

@query("J17", """
SELECT l_orderkey AS parcel_id FROM lineitem GROUP BY 1
HAVING SUM(CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END) > 0 AND SUM(CASE WHEN l_returnflag <> 'A' THEN 1 ELSE 0 END) = 0""")
def land_only_entities(t: Tables):
    flag = F.col("l_returnflag")
    history = t.lineitem.select(
        F.col("l_orderkey").alias(_K), F.lit(2000).alias(_Y),
        F.when(flag == "A", F.col("l_extendedprice")).alias("appr_land_val"),
        F.when(flag != "A", F.col("l_extendedprice")).alias("appr_imps_val"))
    return fc.land_only_gate(history, 2001)


@query("J18", f"""
WITH {PANEL_SQL}, d AS (SELECT parcel_id, tax_yr, ln(CAST(v AS DOUBLE)) - ln(CAST(lag(v) {_W} AS DOUBLE)) AS d FROM panel)
SELECT parcel_id, tax_yr, round(CASE WHEN d IS NOT NULL THEN least(greatest(d, -ln(1.5)), ln(1.5)) END, 9) AS dlog FROM d""")
def capped_changes(t: Tables):
    from acreline.operators.windows import dlog
    return dlog(panel(t), _K, _Y, "v").select(_K, _Y, dbl(fc.cap_dlog("dlog"), "dlog", 9))


@query("J19", f"""
WITH {PARTS_SQL}, r AS (SELECT parcel_id, median(CAST(appr_imps_val AS DOUBLE) / CAST(appr_land_val AS DOUBLE)) AS r FROM parts WHERE appr_land_val > 0 AND appr_imps_val IS NOT NULL AND parcel_id % 5 > 0 GROUP BY 1)
SELECT p.parcel_id, round(COALESCE(r, (SELECT median(r) FROM r)), 8) AS ratio FROM (SELECT DISTINCT parcel_id FROM parts) p LEFT JOIN r ON r.parcel_id = p.parcel_id""")
def ratio_fallback(t: Tables):
    history = parts(t).withColumn("appr_imps_val", F.when(F.col(_K) % 5 > 0, F.col("appr_imps_val")))
    return fc.ratio_fallback(history).select(_K, dbl("ratio", "ratio", 8))


# -- sequential forecast -----------------------------------------------------

_CAP = 0.37  # not the default ln(1.5): cents times 1.5 would end on a rounding tie


def _clip(x: str) -> str:
    return f"least(greatest({x}, -{_CAP}), {_CAP})"


_SEQ_SQL = f"""{PARTS_SQL}, {_RATES_SQL},
h AS (SELECT parcel_id, tax_yr, ln(CAST(appr_land_val AS DOUBLE)) AS l, CASE WHEN parcel_id % 10 = 0 THEN NULL ELSE ln(CAST(appr_imps_val AS DOUBLE)) END AS i FROM parts),
e AS (SELECT parcel_id, MAX(CASE WHEN tax_yr = 2001 THEN l END) AS l, MAX(CASE WHEN tax_yr = 2001 THEN i END) AS i, COUNT(i) = 0 AND COUNT(l) > 0 AS gate FROM h GROUP BY 1),
b AS (SELECT e.*, parcel_id % 7 AS size, c_nationkey AS area, CASE WHEN parcel_id % 3 = 0 THEN 0 ELSE parcel_id % 4 END AS spec FROM e JOIN customer ON c_custkey = parcel_id),
r AS (SELECT parcel_id, y, COALESCE(ln(1 + s.pct), CASE WHEN b.spec <= 0 THEN ln(1 + g.pct) END) AS rate, CASE WHEN s.pct IS NOT NULL THEN 'specialty_report' WHEN b.spec <= 0 AND g.pct IS NOT NULL THEN 'geo_report' ELSE 'model' END AS src
  FROM b CROSS JOIN (SELECT unnest(range(2002, 2005)) AS y) LEFT JOIN rates s ON s.kind = 'specialty' AND s.spec = b.spec AND s.ayr + 1 = y
  LEFT JOIN rates g ON g.kind = 'geo' AND g.pt = 'com' AND g.area = b.area AND g.ayr + 1 = y),
f AS (SELECT parcel_id, 2001 AS y, l, i, gate, size, NULL::VARCHAR AS src FROM b
  UNION ALL SELECT f.parcel_id, f.y + 1, COALESCE(f.l + r.rate, f.l + {_clip('0.01 + 0.002 * size')}, 10 + 0.1 * size),
    COALESCE(f.i + r.rate, f.i + {_clip('0.15 * size - 0.01 * f.i')}, CASE WHEN NOT gate THEN 9 + 0.1 * size END), gate, size, r.src
  FROM f JOIN r ON r.parcel_id = f.parcel_id AND r.y = f.y + 1)"""


@query("J14", f"""
WITH RECURSIVE {_SEQ_SQL}
SELECT parcel_id, CAST(y AS INT) AS tax_yr, round(exp(l), 4) AS pred_appr_land_val, round(CASE WHEN gate THEN 0 ELSE exp(i) END, 4) AS pred_appr_imps_val,
  round(exp(l) + CASE WHEN gate THEN 0 ELSE exp(i) END, 4) AS pred_total_assessed, src AS rate_source FROM f WHERE y > 2001""")
def sequential_forecast(t: Tables):
    out = fc.forecast_sequential(_forecast_panel(t), [2002, 2003, 2004], _scorers(), _published(t),
                                 fc.ForecastOptions(cap=_CAP), features=["size"])
    return out.select(_K, _Y, *[dbl(c, c, 4) for c in ("pred_appr_land_val", "pred_appr_imps_val",
                                                       "pred_total_assessed")], "rate_source")


def _forecast_panel(t: Tables):
    k = F.col(_K)
    places = t.customer.select(F.col("c_custkey").alias(_K), F.col("c_nationkey").alias("area"), "c_acctbal",
                               "c_mktsegment")
    history = parts(t).withColumn("appr_imps_val", F.when(k % 10 > 0, F.col("appr_imps_val"))).join(places, _K)
    history = history.withColumns({"size": k % 7, "spec_area": F.when(k % 3 == 0, 0).otherwise((k % 4).cast("int"))})
    return md.extend_panel(history, [2002, 2003, 2004], targets=["appr_land_val", "appr_imps_val"],
                           last_year=2001)


_PATHS = (("baseline", 1.0), ("optimistic", 1.5), ("pessimistic", 0.5))


def _drivers(t: Tables):
    """Share of the orders seven years before, by scenario."""
    per_year = t.orders.groupBy((F.year("o_orderdate") + 7).alias(_Y)).agg(F.count(F.lit(1)).alias("n"))
    paths = F.array(*[F.struct(F.lit(s).alias("scenario"), F.lit(f).alias("_f")) for s, f in _PATHS])
    each = per_year.withColumn("_all", t.orders.agg(F.count(F.lit(1))).scalar()).select("*", F.inline(paths))
    return each.select(_Y, "scenario", (F.col("n") / F.col("_all") * F.col("_f")).alias("mkt"))


@query("J13 J14 J34", f"""
WITH RECURSIVE {PARTS_SQL},
d AS (SELECT year(o_orderdate) + 7 AS y, sc, COUNT(*) / (SELECT COUNT(*) FROM orders)::DOUBLE * any_value(f) AS mkt FROM orders
  CROSS JOIN (VALUES {", ".join(f"('{s}', {f}::DOUBLE)" for s, f in _PATHS)}) x(sc, f) GROUP BY 1, 2),
h AS (SELECT parcel_id, tax_yr, ln(CAST(appr_land_val AS DOUBLE)) AS l, CASE WHEN parcel_id % 10 = 0 THEN NULL ELSE ln(CAST(appr_imps_val AS DOUBLE)) END AS i FROM parts),
e AS (SELECT parcel_id, MAX(CASE WHEN tax_yr = 2001 THEN l END) AS l, MAX(CASE WHEN tax_yr = 2001 THEN i END) AS i, COUNT(i) = 0 AND COUNT(l) > 0 AS gate FROM h GROUP BY 1),
f AS (SELECT parcel_id, sc, 2001 AS y, l, i, gate, parcel_id % 7 AS size FROM e CROSS JOIN (SELECT DISTINCT sc FROM d)
  UNION ALL SELECT parcel_id, f.sc, f.y + 1, COALESCE(l + {_clip('0.002 * size + mkt')}, 10 + 0.1 * size),
    COALESCE(i + {_clip('0.05 * size - mkt')}, CASE WHEN NOT gate THEN 9 + 0.1 * size END), gate, size
  FROM f JOIN d ON d.sc = f.sc AND d.y = f.y + 1 WHERE f.y < 2004),
v AS (SELECT y, sc, SUM(exp(l) + CASE WHEN gate THEN 0 ELSE exp(i) END) AS t FROM f WHERE y > 2001 GROUP BY 1, 2),
w AS (SELECT CAST(y AS INT) AS tax_yr, {", ".join(f"MAX(CASE WHEN sc = '{s}' THEN t END) AS {s}" for s, _ in _PATHS)} FROM v GROUP BY 1)
SELECT tax_yr, round(baseline, 2) AS baseline, round(optimistic, 2) AS optimistic, round(pessimistic, 2) AS pessimistic,
  round(optimistic - baseline, 2) AS diff_optimistic_vs_baseline, round(pessimistic - baseline, 2) AS diff_pessimistic_vs_baseline FROM w""")
def scenario_forecast(t: Tables):
    """History once, three scenarios of a driver from the extension to the summary."""
    future, mkt, size = [2002, 2003, 2004], F.col("mkt"), F.col("size")
    k = F.col(_K)
    history = (parts(t).withColumn("appr_imps_val", F.when(k % 10 > 0, F.col("appr_imps_val")))
               .withColumns({"size": k % 7}))
    rows = md.extend_panel(history, future, _drivers(t), targets=["appr_land_val", "appr_imps_val"],
                           last_year=2001, scenario="scenario")
    level = _scorers()
    scorers = {"land_delta": lambda df, out: df.withColumn(out, 0.002 * size + mkt),
               "impr_delta": lambda df, out: df.withColumn(out, 0.05 * size - mkt),
               "land_level": level["land_level"], "impr_level": level["impr_level"]}
    paths = fc.forecast_sequential(rows, future, scorers, options=fc.ForecastOptions(cap=_CAP),
                                   features=["size", "mkt"], scenario="scenario")
    out = rc.scenario_summary(paths, "pred_total_assessed", [s for s, _ in _PATHS])
    return out.select(_Y, *[dbl(c, c, 2) for c in out.columns if c != _Y])


@query("J14 J16 E18", f"""
WITH RECURSIVE {PARTS_SQL}, {_RATES_SQL},
h AS (SELECT parcel_id, tax_yr, ln(CAST(appr_land_val AS DOUBLE)) AS l, CASE WHEN parcel_id % 10 = 0 THEN NULL ELSE ln(CAST(appr_imps_val AS DOUBLE)) END AS i FROM parts),
e AS (SELECT parcel_id, MAX(CASE WHEN tax_yr = 2001 THEN l END) AS l, MAX(CASE WHEN tax_yr = 2001 THEN i END) AS i, COUNT(i) = 0 AND COUNT(l) > 0 AS gate FROM h GROUP BY 1),
f AS (SELECT parcel_id, 2001 AS y, l, i, gate, parcel_id % 7 AS size, c_nationkey AS area, FALSE AS act FROM e JOIN customer ON c_custkey = parcel_id
  UNION ALL SELECT parcel_id, y + 1, l + COALESCE(ln(1 + pct), 0.01 + 0.002 * size), i + COALESCE(ln(1 + pct), 0.15 * size - 0.01 * i), gate, size, f.area, pct IS NOT NULL
  FROM f LEFT JOIN rates r ON r.pt = 'res' AND r.area = f.area AND r.ayr = f.y WHERE y < 2003),
m AS (SELECT y, CASE WHEN l IS NULL THEN 'none' WHEN act THEN 'actual' ELSE 'delta' END AS lm, CASE WHEN gate THEN 'land_only' WHEN i IS NULL THEN 'none' WHEN act THEN 'actual' ELSE 'delta' END AS im,
  exp(l) + CASE WHEN gate THEN 0 ELSE exp(i) END AS t FROM f WHERE y > 2001)
SELECT CAST(y AS INT) AS tax_yr, lm AS land_method, im AS impr_method, COUNT(*) AS n, round(SUM(t), 2) AS total FROM m GROUP BY 1, 2, 3""")
def residential_sequential_forecast(t: Tables):
    s = _scorers()
    deltas = {k: s[k] for k in ("land_delta", "impr_delta")}
    out = fc.forecast_sequential(_forecast_panel(t), [2002, 2003], deltas, _published(t),
                                 fc.ForecastOptions(track="res"), features=["size"])
    none = lambda c: F.coalesce(c, F.lit("none")).alias(c)
    return out.groupBy(_Y, none("land_method"), none("impr_method")).agg(
        F.count(F.lit(1)).alias("n"), dbl(F.sum("pred_total_assessed"), "total", 2))


@query("J08 J10 J14")
def sequential_forecast_with_models(t: Tables):
    panel_ = _forecast_panel(t)
    frames = md.subgroup_frames(panel_.filter(F.col(_Y) <= 2001), ["size", "c_acctbal"])
    targets = {f"{k}_{w}": f"{'dlog' if w == 'delta' else 'log'}_{k}" for k in ("land", "impr") for w in ("delta", "level")}
    # Level models must not see the lag they stand in for.
    usable = {n: (df, [c for c in cols if "delta" in n or "_lag" not in c])
              for n, (df, cols) in frames.items()}
    cuts = [r["cut_yr"] for r in md.rolling_year_folds(panel_.filter(F.col(_Y) <= 2001)).collect()]
    # The forecast reads the models that the training published.
    root = run_path(t.spark, "models")
    for name, model in md.fit_delta_level(usable, targets, folds=cuts).items():
        model.publish(f"{root}/{name}")
    models = {name: md.FittedModel.latest(f"{root}/{name}") for name in usable}
    scorers = {n: (lambda m: lambda df, out: md.score(df, m, out))(m) for n, m in models.items()}
    return fc.forecast_sequential(panel_, [2002, 2003, 2004], scorers, _published(t),
                                  features=["size", "c_acctbal"])


# -- residual group and aggregate forecast -----------------------------------

_GROWTH_SQL = f"""tot AS (SELECT c_mktsegment AS subgroup, tax_yr, SUM(v) AS av FROM panel JOIN customer ON c_custkey = parcel_id GROUP BY 1, 2),
gr AS (SELECT *, ln(CAST(av AS DOUBLE)) - ln(CAST(lav AS DOUBLE)) AS dlog FROM (SELECT *, lag(av) OVER (PARTITION BY subgroup ORDER BY tax_yr) AS lav FROM tot) WHERE lav IS NOT NULL)"""


def _growth(t: Tables):
    rows = with_segment(t).withColumnRenamed("c_mktsegment", "subgroup")
    return fc.group_growth(rows, "subgroup", "v")


@query("J20", f"WITH {PANEL_SQL}, {_GROWTH_SQL} SELECT subgroup, tax_yr, CAST(av AS DOUBLE) AS av, CAST(lav AS DOUBLE) AS av_lag, round(dlog, 9) AS dlog FROM gr")
def group_growth(t: Tables):
    return _growth(t).select("subgroup", _Y, dbl("av", "av"), dbl("av_lag", "av_lag"), dbl("dlog", "dlog", 9))


_WEIGHTS = {"BUILDING": 0.3, "MACHINERY": 0.3, "FURNITURE": 0.1, "ABSENT": 0.3}
_CASE_W = "CASE subgroup " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in _WEIGHTS.items()) + " END"


@query("J21", f"""
WITH {PANEL_SQL}, {_GROWTH_SQL}, m AS (
  SELECT 'weighted' AS method, tax_yr, SUM(dlog * CAST(lav AS DOUBLE)) / SUM(CAST(lav AS DOUBLE)) AS d, 'value_weighted_com' AS basis FROM gr GROUP BY 2
  UNION ALL SELECT 'blend', tax_yr, SUM(dlog * {_CASE_W}) / SUM({_CASE_W}), 'fixed_blend' FROM gr WHERE {_CASE_W} IS NOT NULL GROUP BY 2
  UNION ALL SELECT 'proxy', tax_yr, dlog, 'proxy_BUILDING' FROM gr WHERE subgroup = 'BUILDING'
  UNION ALL SELECT DISTINCT 'flat', tax_yr, 0.0::DOUBLE, 'flat' FROM gr)
SELECT method, tax_yr, round(least(greatest(d, -0.05), 0.05), 9) AS dlog_other, basis || CASE WHEN abs(d) > 0.05 THEN '_capped' ELSE '' END AS basis FROM m""")
def residual_rates(t: Tables):
    g, out = _growth(t), None
    for label, args in (("weighted", {"method": "com_weighted"}), ("blend", {"method": "blend", "weights": _WEIGHTS}),
                        ("proxy", {"method": "proxy", "proxy": "BUILDING"}), ("flat", {"method": "flat"})):
        part = fc.residual_rate(g, cap=0.05, **args).withColumn("method", F.lit(label))
        out = part if out is None else out.unionByName(part)
    return out.select("method", _Y, dbl("dlog_other", "dlog_other", 9), "basis")


@query("J22", f"""
WITH {PANEL_SQL}, {PARTS_SQL}, {_GROWTH_SQL}, {_RATES_SQL},
rate AS (SELECT tax_yr + 2 AS tax_yr, least(greatest(SUM(dlog * CAST(lav AS DOUBLE)) / SUM(CAST(lav AS DOUBLE)), -0.15), 0.15) AS d,
    CASE WHEN abs(SUM(dlog * CAST(lav AS DOUBLE)) / SUM(CAST(lav AS DOUBLE))) > 0.15 THEN 'value_weighted_com_capped' ELSE 'value_weighted_com' END AS basis FROM gr GROUP BY 1),
g AS (SELECT c_custkey AS parcel_id, c_nationkey AS area, CAST(c_custkey % 3 AS INT) AS spec, CAST(y AS INT) AS tax_yr, CASE WHEN c_custkey % 4 > 0 THEN CAST(appr_land_val AS DOUBLE) END AS l,
    CASE WHEN c_custkey % 4 > 1 THEN CAST(appr_imps_val AS DOUBLE) END AS i, CASE WHEN c_custkey % 8 = 0 THEN CAST(appr_land_val AS DOUBLE) END AS tot
  FROM customer CROSS JOIN (SELECT unnest(range(1999, 2005)) AS y) LEFT JOIN parts p ON p.parcel_id = c_custkey AND p.tax_yr = y),
s AS (SELECT g.*, CASE WHEN g.spec > 0 THEN NULL ELSE ln(1 + r.pct) END AS geo, rate.d, basis, COALESCE(CASE WHEN l IS NULL AND i IS NULL THEN NULL ELSE COALESCE(l, 0) + COALESCE(i, 0) END, CASE WHEN tot > 0 THEN tot END) AS t
  FROM g LEFT JOIN rates r ON r.kind = 'geo' AND r.pt = 'com' AND r.area = g.area AND r.ayr + 1 = g.tax_yr LEFT JOIN rate ON rate.tax_yr = g.tax_yr),
w AS (SELECT *, tax_yr >= 2002 AS fut, exp(SUM(CASE WHEN tax_yr >= 2002 THEN COALESCE(geo, d, 0) ELSE 0 END) OVER o) AS gw, last_value(l IGNORE NULLS) OVER o AS bl,
    last_value(i IGNORE NULLS) OVER o AS bi, last_value(t IGNORE NULLS) OVER o AS bt FROM s WINDOW o AS (PARTITION BY parcel_id ORDER BY tax_yr ROWS UNBOUNDED PRECEDING)),
p AS (SELECT *, CASE WHEN fut AND bl IS NOT NULL THEN bl * gw ELSE l END AS pl, CASE WHEN fut AND bi IS NOT NULL THEN bi * gw ELSE i END AS pi FROM w)
SELECT parcel_id, tax_yr, CASE WHEN geo IS NOT NULL THEN 'geo_report' WHEN fut AND d IS NOT NULL THEN basis WHEN fut THEN 'flat_fallback' END AS co_rate_source,
  round(pl, 4) AS pred_appr_land_val, round(pi, 4) AS pred_appr_imps_val, round(CASE WHEN bl IS NOT NULL OR bi IS NOT NULL THEN CASE WHEN pl IS NULL AND pi IS NULL THEN NULL ELSE COALESCE(pl, 0) + COALESCE(pi, 0) END
    WHEN fut AND bt IS NOT NULL THEN bt * gw ELSE t END, 4) AS pred_total_assessed FROM p""")
def residual_forecast(t: Tables):
    k = F.col("c_custkey")
    snap = t.customer.select(k.alias(_K), F.col("c_nationkey").alias("area"), (k % 3).cast("int").alias("spec_area"))
    panel_ = expand_snapshot(snap, range(1999, 2005)).join(parts(t), [_K, _Y], "left")
    key = F.col(_K)
    land, imps = F.col("appr_land_val").cast("double"), F.col("appr_imps_val").cast("double")
    panel_ = panel_.select(_K, "area", "spec_area", _Y, F.when(key % 4 > 0, land).alias("appr_land_val"),
                           F.when(key % 4 > 1, imps).alias("appr_imps_val"),
                           F.when(key % 8 == 0, land).alias("total_assessed"))
    rate = fc.residual_rate(_growth(t)).withColumn(_Y, F.col(_Y) + 2)
    out = fc.residual_forecast(panel_, rate, 2002, _published(t))
    return out.select(_K, _Y, "co_rate_source", *[dbl(c, c, 4) for c in (
        "pred_appr_land_val", "pred_appr_imps_val", "pred_total_assessed")])


_GROUP_NAMES = ("Apartment", "Warehouse", "MajorRetail", "Hotel", "MajorOffice", "Unlisted")
_GROUP_NAME = "CASE p_partkey % 6 " + " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(_GROUP_NAMES)) + " END"
_BASE_SQL = f"""acc AS (SELECT CASE WHEN p_partkey % 2 = 0 THEN CAST(p_size AS INT) END AS spec, {_GROUP_NAME} AS nm, CAST(290 + p_size * 5 AS INT) AS u, CAST(p_retailprice AS DECIMAL(18,2)) AS av FROM part),
lab AS (SELECT av, COALESCE(spec <> 0, FALSE) AS sp, CASE WHEN COALESCE(spec <> 0, FALSE) THEN {sql_codes('nm', codes.GROUP_BY_SPECIALTY, "'Other'")} ELSE {sql_codes('u', codes.GROUP_BY_USE)} END AS g FROM acc),
rest AS (SELECT CAST(SUM(av) AS DOUBLE) AS r FROM lab WHERE g IS NULL),
base AS (SELECT g, SUM(b) AS base, SUM(n) AS n FROM (SELECT g, sp, CAST(SUM(av) AS DOUBLE) AS b, COUNT(*) AS n FROM lab WHERE g IS NOT NULL GROUP BY 1, 2
  UNION ALL SELECT k, NULL, r * w, 0 FROM rest CROSS JOIN (VALUES {", ".join(f"('{k}', {v}::DOUBLE)" for k, v in codes.GROUP_BLEND.items())}) x(k, w)) GROUP BY 1)"""


def _groups(t: Tables):
    k = F.col("p_partkey")
    accounts = t.part.select(F.when(k % 2 == 0, F.col("p_size")).alias("spec_area"), F.expr(_GROUP_NAME).alias("spec_name"),
                             (290 + F.col("p_size") * 5).alias("present_use"), money("p_retailprice").alias("av"))
    return fc.forecast_groups(accounts)


@query("J23 J24 E16", f"WITH {_BASE_SQL} SELECT g AS forecast_group, round(base, 4) AS base, CAST(n AS BIGINT) AS n_parcels FROM base")
def forecast_groups(t: Tables):
    return _groups(t).select("forecast_group", dbl("base", "base", 4), "n_parcels")


_SERIES = {"1-URGENT": "Major Office", "2-HIGH": "Industrial", "3-MEDIUM": "Retail", "4-NOT SPECIFIED": "Hotels",
           "5-LOW": "Multifamily"}
_SERIES_SQL = f"""sr AS (SELECT {sql_codes('o_orderpriority', _SERIES)} AS rg, CAST(year(o_orderdate) AS INT) AS yr, CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS x FROM orders GROUP BY 1, 2),
gg AS (SELECT rg, yr, x / lag(x) OVER (PARTITION BY rg ORDER BY yr) - 1 AS gyy FROM sr)"""


def _group_rates(t: Tables):
    from acreline.functions.labels import code_label
    from acreline.operators.windows import yoy
    sums = t.orders.groupBy(code_label("o_orderpriority", _SERIES).alias("rate_group"),
                            F.year("o_orderdate").alias("year")).agg(F.sum(money("o_totalprice")).alias("x"))
    return yoy(sums, "rate_group", "year", "x", "gyy").select("rate_group", "year", "gyy")


def _aggregate_sql(shift: int) -> str:
    return f"""
WITH RECURSIVE {_BASE_SQL}, {_SERIES_SQL}, mp AS (SELECT g, base, COALESCE({sql_codes('g', codes.GROUP_RATE_SOURCE)}, 'Retail') AS rg FROM base),
fc AS (SELECT g, rg, 1996 AS y, base AS av FROM mp UNION ALL SELECT fc.g, fc.rg, fc.y + 1, fc.av * (1 + gyy) FROM fc JOIN gg ON gg.rg = fc.rg AND gg.yr = fc.y + 1 - {shift} WHERE fc.y + 1 - {shift} <= 2000),
tt AS (SELECT y, SUM(av) AS b FROM fc GROUP BY 1), tg AS (SELECT *, b / lag(b) OVER (ORDER BY y) - 1 AS g FROM tt),
sc AS (SELECT y, b, b AS o, b AS p FROM tg WHERE y = 1996 UNION ALL SELECT tg.y, tg.b, sc.o * (1 + tg.g + 0.01), sc.p * (1 + tg.g - 0.01) FROM sc JOIN tg ON tg.y = sc.y + 1)
SELECT CAST(y AS INT) AS tax_year, round(b, 3) AS baseline, round(o, 3) AS optimistic, round(p, 3) AS pessimistic FROM sc"""


def _aggregate(t: Tables, rate_year: str):
    out = fc.aggregate_forecast(_groups(t), _group_rates(t), 1996, 2000, rate_year)
    return out.select("tax_year", *[dbl(c, c, 3) for c in ("baseline", "optimistic", "pessimistic")])


@query("J23 H08", _aggregate_sql(1))
def aggregate_forecast(t: Tables):
    return _aggregate(t, "from")


@query("J23", _aggregate_sql(0))
def aggregate_forecast_to_year(t: Tables):
    return _aggregate(t, "to")


@query("J24", f"""
WITH {PANEL_SQL} SELECT tax_yr, k AS forecast_group, round(CAST(SUM(v) AS DOUBLE) * w, 4) AS v FROM panel
CROSS JOIN (VALUES {", ".join(f"('{k}', {v}::DOUBLE)" for k, v in codes.GROUP_BLEND.items())}) x(k, w) GROUP BY 1, 2, w""")
def allocated_totals(t: Tables):
    totals = panel(t).groupBy(_Y).agg(F.sum("v").alias("v"))
    return fc.allocate(totals, codes.GROUP_BLEND, "v").select(_Y, "forecast_group", dbl("v", "v", 4))


