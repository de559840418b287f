import pytest
from pyspark.sql import functions as F

from acreline.functions import cleaning as c
from acreline.functions import codes
from acreline.functions import labels as lb


def values(spark, column, rows, schema="x string"):
    return [r[0] for r in spark.createDataFrame([(v,) for v in rows], schema).select(column).collect()]


def test_padding_keeps_long_text(spark):
    assert values(spark, c.pad_left("x", 4), ["7", "12345", " 9 "]) == ["0007", "12345", "0009"]


def test_key_round_trip(spark):
    plain = c.normalize_key("x")
    assert values(spark, plain, ["123456-0010"]) == ["1234560010"]
    assert values(spark, c.restore_key(plain), ["123456-0010"]) == ["123456-0010"]


def test_numbers_from_text(spark):
    assert values(spark, c.to_int("x"), ["7.9", " 3 ", "x", "", None, "NaN"]) == [7, 3, None, None, None, None]
    assert values(spark, c.parse_money("x"), ["$1,143,400", "-$57,400", "$ -15,497,275", "$ (1,889)", "$"]) == [
        1143400.0, -57400.0, -15497275.0, -1889.0, None]


def test_null_rules(spark):
    rows = spark.createDataFrame([(1.0, None), (None, None), (None, 2.0), (1.0, 2.0)], "a double, b double")
    assert [r[0] for r in rows.select(c.null_sum("a", "b")).collect()] == [1.0, None, 2.0, 3.0]
    assert values(spark, c.clamp("x", 0.0, 1.0), [None, 5.0, -5.0, 0.5], "x double") == [None, 1.0, 0.0, 0.5]
    assert values(spark, c.yn_flag("x"), [None, "y", "no"]) == [0, 1, 0]
    assert values(spark, c.log_pos("x"), [0.0, -1.0, None, 1.0], "x double") == [None, None, None, 0.0]


def test_periods(spark):
    got = values(spark, c.parse_period("x"), ["2026 Q1", "2026Q3", "2026 Q1 EST", "2026 Q1 QTD", "2026M03", "2026M13"])
    assert [str(g) if g else None for g in got] == ["2026-01-01", "2026-07-01", "2026-01-01", None, "2026-03-01", None]


def test_addresses(spark):
    address = c.normalize_address("x")
    assert values(spark, address, ["1201 4th Avenue, Suite 300", "500 North Main Street #4"]) == ["1201 4TH AVE", "500 N MAIN ST"]
    assert values(spark, c.address_core_key("x"), ["500 N MAIN ST", "12 AVE", "12", "9 4TH AVE"]) == [
        "500 MAIN", "12 AVE", None, "9 4TH"]
    assert values(spark, c.zip5("x"), ["98101-1234", "981", None]) == ["98101", None, None]


def test_use_codes(spark):
    got = values(spark, lb.classify_use("x"), [344, 300, 341, 349, 350, 353, 406, 407, None, 999], "x int")
    assert got == ["office", "apt", "medical", "hospitality", "hospitality", "retail", "industrial", "industrial",
                   None, None]


@pytest.mark.parametrize("text, label", [
    ("DOWNTOWN MEDICAL OFFICE BUILDING", "medical"), ("ACME PROPERTIES LLC", None), (None, None), ("", None),
    ("HOTEL RETAIL", "hospitality"), ("cold storage", "industrial"), ("Corner Store", "retail"),
    ("business park", "office"), ("Garden Apartments", "apt"), ("OFFICES", "office"), ("RESTAURANTS", "hospitality"),
    ("WAREHOUSES", "industrial"), ("STORES", "retail"), ("CLINICS", "medical")])
def test_keywords(spark, text, label):
    assert values(spark, lb.classify_keywords("x"), [text]) == [label]


def test_normalized_text_is_whole(spark):
    long = "Straße " * 5000 + "bank"
    got = values(spark, c.normalize_text("x"), [long])[0]
    assert got.endswith("BANK") and got.count("STRA E") == 5000


def test_zoning(spark):
    got = values(spark, lb.classify_zoning("x"), ["IG1 U/45", "DOC1 U/450/U", "NC3P-75 (M)", "LR3 (M)", None])
    assert got == ["industrial", "office", "retail", "apt", None]


def test_code_lists_are_disjoint():
    every = [u for uses in codes.SUBGROUP_USES.values() for u in uses]
    assert len(every) == len(set(every))
    assert not set(every) & set(codes.VACANT_USES + codes.PARKING_USES)


def test_multifamily_class_is_shadowed(spark):
    assert values(spark, lb.case_label("x", codes.USE_CLASSES, "Other Commercial"), [470, 705, 10], "x int") == [
        "Industrial", "Mixed Use", "Other Commercial"]


def test_repair_suffixed(spark):
    df = spark.createDataFrame([(1, None, "x", "y")], "id int, a string, `a.x` string, `a.y` string")
    assert c.repair_suffixed(df).collect()[0].asDict() == {"id": 1, "a": "y"}


def test_typed_features_skip_absent_columns(spark):
    df = spark.createDataFrame([("3",)], "access string")
    out = c.type_features(df, ints=["access", "sewer"], flags=["stream"])
    assert out.dtypes == [("access", "int")]


def test_eligibility_schema_is_fixed(spark):
    out = lb.eligibility_flags(spark.createDataFrame([(1,)], "id int"))
    assert out.drop("id").collect()[0].asDict() == {
        "is_incomplete_bldg": 0, "is_exceptional_grade": 0, "bldg_grade_capped": None, "is_non_sfr_hbu": 0,
        "is_small_mf": 0, "is_land_only": 0, "model_flag": 1, "train_flag": 1, "forecast_flag": 1}


def test_owner_flags(spark):
    flags = c.entity_flags("x")
    names = ["ACME LLC", "ACME L.L.C.", "Smith Living Trust", "Jane Corpus", "X INC"]
    assert values(spark, flags["is_llc"], names) == [1, 1, 0, 0, 0]
    assert values(spark, flags["is_entity"], names) == [1, 1, 1, 0, 1]
    assert values(spark, F.lit(1), [None]) == [1]
