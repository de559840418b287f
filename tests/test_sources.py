import pytest

from acreline.functions import codes
from acreline.sources import extracts as ex
from acreline.sources import published as pb
from acreline.sources import report_text as rt
from acreline.sources import tables as tb


def lines(spark, **files):
    rows = [(name + ".txt", i, text) for name, texts in files.items() for i, text in enumerate(texts, 1)]
    return spark.createDataFrame(rows, "source_file string, line_no long, text string")


def test_residential_rows(spark):
    df = lines(spark, a=["  Area 1 Sales  $1,200,800  $1,143,400  -$57,400  -4.8%  $1,255,900  91.5%",
                         "Area 1 Pop    $1,145,200  $1,091,700  -$53,500  -4.7%", "Area without numbers"])
    got = [(r["area"], r["basis"], r["av_prev"], r["delta"], round(r["pct_change"], 4))
           for r in rt.extract_res_rates(df).orderBy("line_no").collect()]
    assert got == [(1, "sales", 1200800.0, -57400.0, -0.048), (1, "population", 1145200.0, -53500.0, -0.047)]


def test_district_table_ends_at_text_and_skips_blanks(spark):
    row = "10   $3,962,976,475   $3,947,479,200   -$15,497,275   -0.39%"
    df = lines(spark, a=[row, "Geo Area   2025 Total Value   2026 Total Value", row, "", row, "Total $1", row,
                         "Geo Area 2025 Total Value", row, "note", row])
    assert sorted(r["line_no"] for r in rt.extract_com_rates(df).collect()) == [3, 5, 9]


def test_district_state_crosses_chunks(spark, monkeypatch):
    monkeypatch.setattr(rt, "LINES_PER_CHUNK", 2)
    row = "10   $3,962   $3,947   -$15   -0.39%"
    df = lines(spark, a=["Geo Area 2025 Total Value"] + [row] * 7 + ["end"] + [row] * 3, b=[row] * 3)
    assert rt.extract_com_rates(df).count() == 7


def test_specialty_total_and_submarkets(spark):
    ex.shared_dir(spark)
    total = "$ 23,200,000 $ 21,700,000 $ (1,500,000) -6.47%"
    df = lines(spark, a=["Major Office Buildings", "Area: 280", "Change in Total Assessed Value", "", total, total,
                         "280-120 Central Business District 69 $ 7,457,718,200 $ 108,082,872 -8.66%",
                         "280-120 Central Business District 69 $ 7,000 $ 1 -1.00%", "250-110 Other 3 $ 5 $ 5 1.0%"])
    got = [(r["report_kind"], r["spec_area"], r["spec_sub"], r["av_curr"], r["delta"])
           for r in rt.extract_spec_rates(df).orderBy("line_no").collect()]
    assert got == [("specialty", 280, None, 21700000.0, -1500000.0),
                   ("specialty_submarket", 280, 120, 7457718200.0, None)]


def test_dispatch_by_template(spark):
    ex.shared_dir(spark)
    res = "Area 1 Pop    $1,145,200  $1,091,700  -$53,500  -4.7%"
    df = lines(spark, a=["Residential Revalue 2026", res], b=["letter", res], c=["Commercial Revalue", res],
               d=["Specialty Area 280", res])
    got = {r["source_file"]: (r["prop_type"], r["district"]) for r in rt.extract_rates(df, 2026).collect()}
    assert got == {"a.txt": ("res", "Residential Revalue 2026"), "b.txt": ("res", "letter")}


def test_read_latest_falls_back_to_any_scenario(spark):
    rows = spark.createDataFrame([(1, "baseline", 1), (2, "baseline", 2), (3, "optimistic", 1)],
                                 "v int, scenario string, run_id int")
    path = ex.write_table(rows, ex.run_path(spark, "runs"), partition_by=["scenario", "run_id"])
    get = lambda s: [r["v"] for r in ex.read_latest(spark, path, s).collect()]
    assert get("optimistic") == [3] and get("baseline") == [2] and get("pessimistic") == [2]


def test_stages_are_reused_until_inputs_options_or_force_say_otherwise(spark):
    path, source = ex.run_path(spark, "stage"), ex.run_path(spark, "source")
    ex.write_table(spark.range(1), source)
    build = lambda n, **kw: pb.materialize(lambda: spark.range(n), path, [source], spark=spark, **kw).count()
    assert build(3) == 3 and build(5) == 3
    assert build(7, force=True) == 7
    assert build(8, options={"cap": 1}) == 8 and build(9, options={"cap": 1}) == 8
    ex.write_table(spark.range(2), source)
    assert build(9) == 9


def test_a_broken_run_is_never_read_and_old_ones_go(spark):
    root = ex.run_path(spark, "stage")
    assert pb.current(spark, root) is None
    for n in (1, 2, 3):
        pb.publish(spark, root, lambda path, n=n: spark.range(n).write.parquet(path), str(n))

    def breaks(path):
        spark.range(9).write.parquet(path)
        raise OSError("lost")

    with pytest.raises(OSError):
        pb.publish(spark, root, breaks, "4")
    now = pb.current(spark, root)
    assert now.fingerprint == "3" and spark.read.parquet(now.path).count() == 3
    assert len([n for n in pb.Storage(spark, root).names(root) if n.startswith("v")]) == 3  # two and the broken one
    pb.publish(spark, root, lambda path: spark.range(5).write.parquet(path), "5")
    pb.publish(spark, root, lambda path: spark.range(6).write.parquet(path), "6")
    names = pb.Storage(spark, root).names(root)
    assert [n for n in names if not n.startswith("v")] == [pb.POINTER] and len(names) == 3
    assert spark.read.parquet(pb.current(spark, root).path).count() == 6


def test_aliases_report_misses(spark):
    df = spark.createDataFrame([("1",)], "`Present Use` string")
    out, missing = ex.select_with_aliases(df, {"present_use": ["PresentUse", "Present Use"], "zone": ["Zoning"]},
                                          {"present_use": "int"})
    assert missing == ["zone"] and out.dtypes == [("present_use", "int"), ("zone", "string")]


def test_extract_names_and_tokens(spark):
    df = spark.createDataFrame([("a", "NA"), (" ", "x")], "`PropName` string, `Present Use` string")
    path = ex.write_table(df, ex.run_path(spark, "csv"), "csv")
    got = ex.read_extract(spark, path)
    assert got.columns == ["prop_name", "present_use"]
    assert {tuple(r) for r in got.collect()} == {("a", None), (None, "x")}


def test_anchors(spark):
    rows = {r["tax_yr"]: r for r in tb.anchor_table(spark).collect()}
    assert rows[2026]["cert_total"] == 306466960900
    assert rows[2023]["cert_total"] == 308874491598 - codes.EXEMPT_2023
    shares = tb.appraised_table(spark).groupBy("tax_yr").sum("share").collect()
    assert all(abs(r[1] - 1) < 1e-12 for r in shares)
