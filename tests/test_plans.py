import datetime as dt
import math
import threading

import pytest
from pyspark.sql import functions as F

from acreline.plans import classify as cl
from acreline.plans import forecast as fc
from acreline.plans import modeling as md
from acreline.plans import panel as pp
from acreline.plans import reconcile as rc


def growth_frame(spark):
    rows = []
    for group, values in (("office", (13.0, 13.0, 13.0)), ("retail", (10.0, 10.5, 11.0)), ("industrial", (25.5, 26.0, 26.5))):
        for (before, now), year in zip(zip(values, values[1:]), (2027, 2028)):
            rows.append((group, year, now, before, math.log(now / before)))
    return spark.createDataFrame(rows, "subgroup string, tax_yr int, av double, av_lag double, dlog double")


def rate(df, year, c="dlog_other"):
    return df.filter(F.col("tax_yr") == year).collect()[0][c]


def test_value_weighted_rate(spark):
    g = growth_frame(spark)
    got = rate(fc.residual_rate(g), 2027)
    want = (10 * math.log(1.05) + 25.5 * math.log(26 / 25.5)) / (13 + 10 + 25.5)
    assert abs(got - want) < 1e-12


def test_blend_is_renormalized_and_proxy_and_flat(spark):
    g = growth_frame(spark)
    weights = {"office": 0.3, "retail": 0.3, "industrial": 0.1, "absent": 0.3}
    got = rate(fc.residual_rate(g, "blend", weights), 2027)
    assert abs(got - (0.3 * math.log(1.05) + 0.1 * math.log(26 / 25.5)) / 0.7) < 1e-12
    assert abs(rate(fc.residual_rate(g, "proxy", proxy="retail"), 2028) - math.log(11 / 10.5)) < 1e-12
    assert rate(fc.residual_rate(g, "flat"), 2027) == 0
    with pytest.raises(ValueError):
        fc.residual_rate(g, "nope")


def test_hot_rates_are_capped(spark):
    out = fc.residual_rate(growth_frame(spark).withColumn("dlog", F.lit(0.9)), cap=0.15).collect()
    assert all(r["dlog_other"] == 0.15 and r["basis"].endswith("_capped") for r in out)


def residual_panel(spark):
    rows = []
    for y in range(2024, 2032):
        past = y < 2027
        rows += [("A", y, "30", 0, 1e6 if past else None, 4e6 if past else None),
                 ("B", y, "30", 0, 2e6 if past else None, None),
                 ("C", y, "77", 0, 5e5 if past else None, 5e5 if past else None)]
    return spark.createDataFrame(rows, "parcel_id string, tax_yr int, area string, spec_area int, appr_land_val double, appr_imps_val double")


def area_rate(spark):
    return spark.createDataFrame([("30", 2026, "com", "geo", "population", -0.02, "f")],
                                 "area string, assessment_yr int, prop_type string, report_kind string, basis string, pct_change double, source_file string")


def rates_table(spark, dlog=math.log(1.02)):
    return spark.createDataFrame([(y, dlog, "value_weighted_com") for y in range(2027, 2032)],
                                 "tax_yr int, dlog_other double, basis string")


def test_residual_forecast_routes_and_compounds(spark):
    out = {(r["parcel_id"], r["tax_yr"]): r for r in fc.residual_forecast(
        residual_panel(spark), rates_table(spark), 2027, area_rate(spark)).collect()}
    a27, a28 = out["A", 2027], out["A", 2028]
    assert abs(a27["pred_appr_land_val"] - 0.98e6) < 1e-3 and a27["co_rate_source"] == "geo_report"
    assert abs(a28["pred_appr_land_val"] - 0.98e6 * 1.02) < 1e-3
    assert out["C", 2027]["co_rate_source"] == "value_weighted_com"
    assert out["B", 2028]["pred_appr_imps_val"] is None
    assert abs(out["B", 2027]["pred_total_assessed"] - 2e6 * 0.98) < 1e-3
    assert out["A", 2026]["pred_total_assessed"] == 5e6 and out["A", 2026]["co_rate_source"] is None


def test_specialty_entities_skip_geographic_rates(spark):
    panel = residual_panel(spark).withColumn("spec_area", F.when(F.col("parcel_id") == "A", 280).otherwise(0))
    get = lambda scope: fc.residual_forecast(panel, rates_table(spark), 2027, area_rate(spark), scope).filter(
        "parcel_id = 'A' AND tax_yr = 2027").collect()[0]["co_rate_source"]
    assert get("nonspecialty") == "value_weighted_com" and get("all") == "geo_report"


def test_flat_rate_carries_forward(spark):
    out = fc.residual_forecast(residual_panel(spark), rates_table(spark, 0.0), 2027)
    totals = {r["pred_total_assessed"] for r in out.filter("parcel_id = 'A' AND tax_yr >= 2027").collect()}
    assert totals == {5e6}


@pytest.mark.parametrize("column, value", [("total_assessed", 1e6), ("log_total_assessed", math.log(1e6))])
def test_total_only_bases(spark, column, value):
    rows = [("A", y, value if y < 2027 else None) for y in range(2024, 2032)]
    panel = spark.createDataFrame(rows, f"parcel_id string, tax_yr int, {column} double")
    got = {r["tax_yr"]: r["pred_total_assessed"] for r in fc.residual_forecast(panel, rates_table(spark), 2027).collect()}
    assert abs(got[2027] - 1.02e6) < 1e-3 and abs(got[2031] - 1e6 * 1.02 ** 5) < 1e-3 and abs(got[2026] - 1e6) < 1e-3


def test_stock_flow_equals_loop(spark):
    g = [0.1, None, -1.0, 0.5, 0.2, -1.0, -0.3]
    flow = [10.0, 5.0, 7.0, None, 1.0, 2.0, 3.0]
    df = spark.createDataFrame([("k", i, f, x) for i, (f, x) in enumerate(zip(flow, g))], "k string, tax_yr int, flow double, g double")
    got = [r["stock"] for r in rc.stock_flow(df, ["k"], "flow", "g").orderBy("tax_yr").collect()]
    stock, want = 0.0, []
    for f, x in zip(flow, g):
        stock = stock * (1 + (x or 0)) + (f or 0)
        want.append(stock)
    assert all(abs(a - b) < 1e-9 for a, b in zip(got, want))


def test_chain_back_equals_loop_and_stops_at_gaps(spark):
    g = {2019: 0.02, 2020: 0.05, 2021: None, 2022: 0.1, 2023: 0.3}
    df = spark.createDataFrame([("k", y, x) for y, x in g.items()], "k string, tax_yr int, gyy double")
    anchor = spark.createDataFrame([("k", 2022, 110.0)], "k string, anchor_yr int, av double")
    got = {r["tax_yr"]: r["av"] for r in rc.chain_back(df, anchor, ["k"]).collect()}
    assert abs(got.pop(2021) - 100.0) < 1e-9
    assert got == {2022: 110.0, 2020: None, 2019: None}


def test_compound_treats_missing_rates_as_zero(spark):
    base = spark.createDataFrame([("res", 100.0)], "track string, cert_av double")
    rates = spark.createDataFrame([("res", "baseline", 2027, 0.1), ("res", "baseline", 2029, 0.1)],
                                  "track string, scenario string, tax_yr int, gyy double")
    got = [round(r["cert_av"], 6) for r in rc.compound(base, rates, ["track"], 2026, 2029).orderBy("tax_yr").collect()]
    assert got == [100.0, 110.0, 110.0, 121.0]


def test_matched_growth_ignores_entrants(spark):
    df = spark.createDataFrame([("a", 2020, 100.0), ("a", 2021, 110.0), ("b", 2021, 900.0), ("c", 2019, 5.0), ("c", 2021, 50.0)],
                               "id string, yr int, v double")
    got = rc.matched_growth(df, "id", "yr", "v").collect()
    assert [(r["yr"], r["n_matched"], round(r["gyy"], 9)) for r in got] == [(2021, 1, 0.1)]


def test_sequential_forecast_equals_loop(spark):
    rows = [("a", y, 100.0, 50.0) for y in (2024, 2025)] + [("b", 2025, 80.0, None)] + [("c", 2025, 10.0, 0.0)]
    rows += [(p, y, None, None) for p in "abc" for y in (2026, 2027)]
    panel = spark.createDataFrame(rows, "parcel_id string, tax_yr int, appr_land_val double, appr_imps_val double")
    panel = panel.withColumns({"area": F.lit(1), "spec_area": F.lit(0)})
    lag = lambda c, k: lambda df, out: df.withColumn(out, F.col(c) * k)
    flat = lambda v: lambda df, out: df.withColumn(out, F.lit(v))
    scorers = {"land_delta": lag("log_land_lag1", 0.01), "impr_delta": flat(2.0), "impr_level": flat(3.0)}
    got = {(r["parcel_id"], r["tax_yr"]): r for r in fc.forecast_sequential(panel, [2026, 2027], scorers).collect()}
    land = math.log(100.0)
    for y in (2026, 2027):
        land += 0.01 * land
        assert abs(got["a", y]["pred_log_land"] - land) < 1e-12
    assert abs(got["a", 2026]["pred_appr_imps_val"] - 75.0) < 1e-9      # capped at ln(1.5)
    # b and c never held improvements: gated to zero.
    assert got["b", 2027]["pred_appr_imps_val"] == 0 and got["c", 2026]["impr_method"] == "land_only"
    loose = fc.ForecastOptions(land_only_gate=False)
    free = fc.forecast_sequential(panel, [2026], scorers, options=loose).filter("parcel_id = 'b'").collect()[0]
    assert abs(free["pred_log_imps"] - 3.0) < 1e-12 and free["impr_method"] == "level"


def test_ratio_stands_in_without_improvement_models(spark):
    rows = [("a", 2024, 100.0, 50.0), ("a", 2025, 100.0, None), ("b", 2025, 100.0, 30.0), ("a", 2026, None, None), ("b", 2026, None, None)]
    panel = spark.createDataFrame(rows, "parcel_id string, tax_yr int, appr_land_val double, appr_imps_val double")
    flat = lambda df, out: df.withColumn(out, F.lit(0.0))
    out = {r["parcel_id"]: r for r in fc.forecast_sequential(panel, [2026], {"land_delta": flat}).collect()}
    assert abs(out["a"]["pred_appr_imps_val"] - 50.0) < 1e-9 and out["a"]["impr_method"] == "ratio"


def test_folds(spark):
    df = spark.createDataFrame([(y,) for y in range(2000, 2007)], "tax_yr int")
    assert [r["cut_yr"] for r in md.rolling_year_folds(df).orderBy("fold").collect()] == [2002, 2003, 2004, 2005]
    assert md.rolling_year_folds(df.filter("tax_yr < 2003")).count() == 0
    assert [r["test_yr"] for r in md.last_year_folds(df).orderBy("fold").collect()] == [2004, 2005, 2006]


def test_model_learns_and_scores_with_missing_features(spark):
    df = spark.range(400).select((F.col("id") % 4 + 2000).cast("int").alias("tax_yr"), (F.col("id") % 10).cast("double").alias("x"),
                                 F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("c"))
    df = df.withColumn("y", F.col("x") * 2)
    model = md.fit_model(df, "y", ["x"], ["c"], folds=[2002], max_trees=5, min_leaf=1)
    assert model.cv_rmse < 6 and 1 <= model.n_trees <= 5
    absent = df.drop("c").withColumn("x", F.when(F.col("x") > 5, F.col("x")))
    with pytest.raises(ValueError, match="absent: c"):
        md.score(absent, model)
    out = md.score(absent, model, allow_absent=["c"])
    assert out.columns == ["tax_yr", "x", "y", "prediction"]
    assert out.filter("x IS NULL").count() == 240 and out.filter("prediction IS NULL").count() == 0


def test_extension_state(spark):
    df = spark.createDataFrame([("a", 2024, 1.0, 3), ("b", 2025, 2.0, 5)], "parcel_id string, tax_yr int, v double, age int")
    rows = md.extend_panel(df, [2026], state="last_row", targets=["v"], advance=["age"]).filter("tax_yr = 2026").collect()
    assert {r["parcel_id"]: (r["v"], r["age"]) for r in rows} == {"a": (None, 4), "b": (None, 6)}
    assert md.extend_panel(df, [2026], state="last_year").filter("tax_yr = 2026").count() == 1
    with pytest.raises(ValueError):
        md.extend_panel(df, [2026], state="other")


def test_waterfall_guards(spark):
    parcels = spark.createDataFrame([("v", 300, "IG1 U/45", "HOTEL"), ("p", 180, "NC3", "BANK"), ("u", 106, None, None),
                                     ("k", 900, None, "Corner Store"), ("w", 300, "IG1", None)],
                                    "parcel_id string, present_use int, current_zoning string, property_name string")
    got = {r["parcel_id"]: (r["subgroup"], r["class_tier"]) for r in cl.classify_waterfall(parcels, max_tier=5).collect()}
    assert got == {"v": (None, None), "p": (None, "parking_hold"), "u": ("office", "1_present_use"),
                   "k": ("retail", "4_keyword"), "w": ("industrial", "5_zoning")}
    capped = {r["parcel_id"]: r["subgroup"] for r in cl.classify_waterfall(parcels, max_tier=3).collect()}
    assert capped["k"] is None and capped["w"] is None


def test_specialty_name_beats_earlier_code_unless_interleaved(spark):
    df = spark.createDataFrame([("Hotel", 11)], "spec_area_name string, present_use int")
    get = lambda **kw: cl.assign_subgroup(df, **kw).collect()[0]["com_subgroup"]
    assert get() == "hospitality" and get(interleaved=True) == "apt"


def test_model_takes_as_many_trees_as_it_needs_and_survives_a_save(spark, tmp_path):
    df = spark.range(1500).coalesce(2).select(
        (F.col("id") % 5 + 2000).cast("int").alias("tax_yr"), (F.xxhash64("id") % 1000 / 100).alias("x"))
    df = df.withColumn("y", F.sin("x") * 3 + F.col("x"))
    model = md.fit_model(df, "y", ["x"], folds=[2002], patience=4, step=0.3, depth=2)
    spread = df.agg(F.stddev("y")).first()[0]
    assert model.n_trees > 20 and model.cv_rmse < 0.2 * spread
    model.publish(str(tmp_path / "models"))
    again = md.FittedModel.latest(str(tmp_path / "models"))
    assert again.n_trees == model.n_trees and again.medians == model.medians
    both = [[r[0] for r in md.score(df, m).select("prediction").collect()] for m in (model, again)]
    assert both[0] == both[1]


def test_an_ensemble_grows_in_chunks_until_it_needs_no_more(spark):
    df = spark.range(1200).coalesce(1).select(
        (F.col("id") % 4 + 2000).cast("int").alias("tax_yr"), (F.xxhash64("id") % 1000 / 100).alias("x"))
    df = df.withColumn("y", F.sin(F.col("x") * 3) * 3 + F.col("x"))
    grown = md.fit_model(df, "y", ["x"], folds=[2002], patience=20, depth=2, min_leaf=5, max_trees=120)
    short = md.fit_model(df, "y", ["x"], folds=[2002], patience=20, depth=2, min_leaf=5, max_trees=10)
    assert grown.n_trees > 100 and short.n_trees == 10 and grown.cv_rmse < 0.5 * short.cv_rmse
    parts = [s for s in grown.pipeline.stages if hasattr(s, "featureImportances")]
    assert sum(p.getNumTrees for p in parts) == grown.n_trees and len(parts) > 3
    error = md.score(df, grown).agg(F.sqrt(F.avg((F.col("prediction") - F.col("y")) ** 2))).first()[0]
    assert error < 1.2 * grown.cv_rmse


def forecast_rows(spark, rows):
    return spark.createDataFrame(
        rows, "parcel_id string, tax_yr int, scenario string, appr_land_val double, appr_imps_val double, bump double")


def test_scenarios_stay_apart(spark):
    rows = [("a", y, s, v, None, b) for s, b in (("low", 0.0), ("high", 1.0))
            for y, v in ((2024, 100.0), (2025, 100.0), (2026, None))]
    land = lambda df, out: df.withColumn(out, F.col("bump") * F.log(F.lit(1.2)))
    out = fc.forecast_sequential(forecast_rows(spark, rows), [2026], {"land_delta": land}, features=["bump"],
                                 keys=["parcel_id", "scenario"])
    got = {r["scenario"]: round(r["pred_appr_land_val"], 6) for r in out.collect()}
    assert got == {"low": 100.0, "high": 120.0}


def test_a_ratio_of_zero_gives_no_improvements(spark):
    rows = [("a", 2022, "s", 100.0, 50.0, 0.0), ("a", 2023, "s", 100.0, 0.0, 0.0), ("a", 2024, "s", 100.0, 0.0, 0.0),
            ("a", 2025, "s", 100.0, 0.0, 0.0), ("a", 2026, "s", None, None, 0.0)]
    flat = lambda df, out: df.withColumn(out, F.lit(0.0))
    [r] = fc.forecast_sequential(forecast_rows(spark, rows), [2026], {"land_delta": flat}).collect()
    assert (round(r["pred_total_assessed"], 6), r["pred_appr_imps_val"], r["impr_method"]) == (100.0, 0.0, "ratio")


def test_only_commercial_changes_are_capped_by_default(spark):
    rows = [("a", 2025, "s", 100.0, None, 0.0), ("a", 2026, "s", None, None, 0.0)]
    jump = lambda df, out: df.withColumn(out, F.lit(0.9))
    got = [fc.forecast_sequential(forecast_rows(spark, rows), [2026], {"land_delta": jump}, None,
                                  fc.ForecastOptions(track=t)).first()["pred_appr_land_val"] for t in ("com", "res")]
    assert [round(x, 2) for x in got] == [150.0, 245.96]


def test_changes_before_the_first_year_hold(spark):
    snapshot = spark.createDataFrame([("a", 1, "old")], "parcel_id string, area int, zone string")
    values = spark.createDataFrame([], "parcel_id string, tax_yr int, appr_land_val double, appr_imps_val double")
    changes = spark.createDataFrame([("a", "zone", "1998", dt.date(1998, 5, 1)), ("a", "zone", "1997", dt.date(1997, 5, 1)),
                                     ("a", "zone", "2001", dt.date(2001, 5, 1))],
                                    "parcel_id string, attribute string, attribute_value string, update_date date")
    got = {c: [r["zone"] for r in pp.build_panel(snapshot, values, changes, 2000, 2002, {"zone": "zone"}, carry=c)
               .orderBy("tax_yr").collect()] for c in ("until_next", "point")}
    assert got == {"until_next": ["1998", "2001", "2001"], "point": ["old", "2001", "old"]}


def test_scenarios_share_one_history(spark):
    history = spark.createDataFrame([("a", 2024, 100.0, 10.0), ("a", 2025, 100.0, 10.0), ("b", 2025, 50.0, None)],
                                    "parcel_id string, tax_yr int, appr_land_val double, appr_imps_val double")
    drivers = spark.createDataFrame([(y, s, x) for y in (2026, 2027) for s, x in (("low", 0.0), ("high", 0.1))],
                                    "tax_yr int, scenario string, bump double")
    rows = md.extend_panel(history, [2026, 2027], drivers, targets=["appr_land_val", "appr_imps_val"], scenario="scenario")
    assert rows.count() == 3 + 2 * 2 * 2 and rows.filter("scenario IS NULL").count() == 3
    bump = lambda df, out: df.withColumn(out, F.col("bump"))
    got = fc.forecast_sequential(rows, [2026, 2027], {"land_delta": bump, "impr_delta": bump}, features=["bump"],
                                 scenario="scenario").collect()
    assert {(r["parcel_id"], r["scenario"], r["tax_yr"]): round(r["pred_total_assessed"], 6) for r in got} == {
        (p, s, y): round(v * math.exp(x * n), 6) for p, v in (("a", 110.0), ("b", 50.0))
        for s, x in (("low", 0.0), ("high", 0.1)) for n, y in ((1, 2026), (2, 2027))}


# -- plans: how often rows are dealt anew -------------------------------------------------

@pytest.fixture
def plain_plans(spark):
    """No broadcast by size, no adaptive execution."""
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def exchanges(df):
    """Hash and range exchanges of the physical plan, each with what it deals by."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [line.split("Exchange ")[1].split(", ENSURE")[0].split(", REPART")[0] for line in plan.splitlines()
            if "Exchange " in line and "Broadcast" not in line and "Reused" not in line]


SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name, most", [
    # the panel once; each source once, and once more where it is first joined on a key of its own
    ("permit_features", 4), ("assessor_permit_features", 4), ("exemption_features", 3), ("inspection_features", 6),
    ("assembled_panel", 6)])
def test_panel_steps_deal_rows_once(spark, plain_plans, name, most):
    from acreline.queries import REGISTRY
    found = exchanges(REGISTRY[name](spark, SF))
    assert len(found) <= most, found
    # Nothing is dealt by entity and year but the raw values of the assembled panel.
    both = [x for x in found if "tax_yr" in x]
    assert len(both) <= (name == "assembled_panel"), both


@pytest.mark.parametrize("name", ["routed_rates", "routed_rates_prior", "area_anchors", "attach_drivers"])
def test_lookups_leave_the_panel_in_place(spark, plain_plans, name):
    from acreline.queries import REGISTRY
    found = exchanges(REGISTRY[name](spark, SF))
    assert not any("area" in x or "tax_yr" in x for x in found), found


def test_large_lookups_are_salted(spark):
    from acreline.operators.joins import lookup_join
    left = spark.range(1000).select(F.col("id"), F.when(F.col("id") % 3 > 0, 1).otherwise((F.col("id") % 50).cast("int")).alias("k"))
    table = spark.range(40).select(F.col("id").cast("int").alias("k"), (F.col("id") * 2).alias("v"))
    small, large = lookup_join(left, table, "k"), lookup_join(left, table, "k", most_rows=10, salts=4)
    assert sorted(map(tuple, small.collect())) == sorted(map(tuple, large.select(*small.columns).collect()))
    assert small.count() == 1000 and small.filter("v IS NULL").count() > 0
    assert "_salt" in large._jdf.queryExecution().optimizedPlan().toString()


def test_fold_and_unfold(spark):
    from acreline.plans import fold
    panel = spark.createDataFrame([("a", 2001, 1), ("a", 2003, 3), ("b", 2002, 2)], "parcel_id string, tax_yr int, v int")
    source = spark.createDataFrame([("a", 2001, 5), ("a", 2001, 6), ("a", 1990, 7), ("b", 2003, 8), (None, 2001, 9), ("z", 2001, 1)],
                                   "parcel_id string, tax_yr int, x int")
    years = range(2001, 2004)
    annual = fold.annual(source, years, {"n": fold.times(), "s": fold.total(F.col("x")), "m": fold.greatest(F.col("x"))},
                         whole={"all": F.sum("x")})
    got = {(r["parcel_id"], r["tax_yr"]): r.asDict() for r in fold.attach(panel, [annual], years, {"s": 0}).collect()}
    assert len(got) == 3
    assert got["a", 2001] == {"parcel_id": "a", "tax_yr": 2001, "v": 1, "n": 2, "s": 11, "m": 6, "all": 18}
    assert got["a", 2003] == {"parcel_id": "a", "tax_yr": 2003, "v": 3, "n": 0, "s": 0, "m": None, "all": 18}
    assert got["b", 2002] == {"parcel_id": "b", "tax_yr": 2002, "v": 2, "n": 0, "s": 0, "m": None, "all": 8}


def test_training_rows_lie_in_as_many_partitions_as_their_size_needs(spark, monkeypatch):
    """Each level of each tree is a job over all partitions of the rows."""
    seen, fit = [], md.GBTRegressor.fit
    monkeypatch.setattr(md.GBTRegressor, "fit", lambda self, rows: seen.append(rows.rdd.getNumPartitions()) or fit(self, rows))
    frame = spark.range(600).selectExpr("id % 6 + 2000 AS tax_yr", "id % 7 AS x", "double(id % 7) AS y").repartition(64)
    model = md.fit_model(frame, "y", ["x"], folds=[2003], max_trees=2, patience=1, depth=2, min_leaf=5)
    assert seen and set(seen) == {1}
    assert md.score(frame, model).filter("prediction IS NOT NULL").count() == 600
    assert md._parts_for(10_000_000, 10) > 300  # large frames keep theirs


def test_trees_are_fitted_to_few_partitions_of_bounded_size(spark, monkeypatch):
    """The folds' rows stay in partitions by size; those that each level of each tree reads need no more than the cores."""
    monkeypatch.setattr(md, "_CELLS", 100)
    seen, fit = [], md.GBTRegressor.fit
    monkeypatch.setattr(md.GBTRegressor, "fit", lambda self, rows: seen.append(rows.rdd.getNumPartitions()) or fit(self, rows))
    frame = spark.range(600).selectExpr("id % 6 + 2000 AS tax_yr", "id % 7 AS x", "double(id % 7) AS y", "id AS unused").repartition(16)
    model = md.fit_model(frame, "y", ["x"], folds=[2003], max_trees=2, patience=1, depth=2, min_leaf=5)
    assert md._parts_for(600, 3) == 18 and seen and set(seen) == {1}
    assert md.score(frame, model).filter("prediction IS NOT NULL").count() == 600
    assert md._tree_parts(3_000_000, 6, 8, 1 << 21) == 8 and md._tree_parts(100_000_000, 6, 8, 1 << 21) == 72


def test_folds_that_do_not_fit_together_are_searched_in_turn(spark, monkeypatch):
    running, most, search = [], [], md._best_size

    def watched(*args):
        running.append(1)
        most.append(len(running))
        try:
            return search(*args)
        finally:
            running.pop()
    monkeypatch.setattr(md, "_best_size", watched)
    monkeypatch.setattr(md, "_HELD", 2000)  # the frame has 1800 values
    frame = spark.range(600).selectExpr("id % 6 + 2000 AS tax_yr", "id % 7 AS x", "double(id % 7) AS y")
    model = md.fit_model(frame, "y", ["x"], folds=[2002, 2003, 2004], max_trees=2, patience=1, depth=2, min_leaf=5)
    assert most == [1, 1, 1] and model.n_trees == 2


def test_models_of_several_frames_are_fitted_at_the_same_time(spark, monkeypatch):
    both = threading.Barrier(2, timeout=20)  # breaks if one is fitted after the other
    monkeypatch.setattr(md, "fit_model", lambda frame, target, features, **options: (both.wait(), target, features, options)[1:])
    frame = spark.range(1)
    got = md.fit_delta_level({"land_delta": (frame, ["a"]), "impr_delta": (frame, ["b"])},
                             {"land_delta": "x", "impr_delta": "y"}, folds=[1])
    assert got == {"land_delta": ("x", ["a"], {"folds": [1]}), "impr_delta": ("y", ["b"], {"folds": [1]})}
    assert md.fit_delta_level({}, {}) == {}


def test_values_are_reduced_to_a_small_snapshot_before_they_meet_it(spark):
    orders = spark.range(2000).selectExpr("id % 100 AS parcel_id", "int(id % 7 + 1999) AS tax_yr", "id AS v")
    values = orders.groupBy("parcel_id", "tax_yr").agg(F.sum("v").alias("v"))
    snap = spark.createDataFrame([(1, 5.0), (1, 6.0), (None, 7.0), (700, 8.0), (2, None)], "parcel_id long, size double")
    out = pp.unify_tracks(values, {"C": snap}, values, [2000, 2001])
    plan = out._jdf.queryExecution().optimizedPlan().toString().splitlines()
    depth = lambda line: len(line) - len(line.lstrip(" :+-"))
    semi = next(i for i, line in enumerate(plan) if "Join LeftSemi" in line)
    above = [line for line in plan[:semi] if depth(line) < depth(plan[semi])]
    assert any("Aggregate [parcel_id" in line for line in above), plan
    assert any("IN (2000,2001)" in line.replace(", ", ",") or "2000" in line for line in plan[semi:])
    got = sorted(map(str, out.filter("prop_type = 'C'").select("parcel_id", "tax_yr", "v", "size").collect()))
    wide = snap.withColumn("tax_yr", F.explode(F.array(F.lit(2000), F.lit(2001))))
    want = wide.join(values, ["parcel_id", "tax_yr"], "left").select("parcel_id", "tax_yr", "v", "size").collect()
    assert got == sorted(map(str, want)) and len(got) == 10
