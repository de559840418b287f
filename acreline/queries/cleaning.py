"""Queries for the cleaning and labelling expressions and the simple filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from acreline.functions import cleaning as c
from acreline.functions import codes
from acreline.functions import labels as lb
from acreline.operators import filters as fl
from acreline.queries.base import (GRID_SQL, PANEL_SQL, Tables, dbl, grid, panel, query,
                                   sql_codes, sql_groups, sql_list, sql_ranges)


@query("B01", """
SELECT c_custkey, a || b AS key, a || '-' || b AS dashed FROM (
  SELECT c_custkey,
    CASE WHEN length(x) >= 6 THEN x ELSE lpad(x, 6, '0') END AS a,
    CASE WHEN length(y) >= 4 THEN y ELSE lpad(y, 4, '0') END AS b
  FROM (SELECT c_custkey, CAST(c_custkey * 1371 AS VARCHAR) AS x,
               CAST(c_nationkey AS VARCHAR) AS y FROM customer))""")
def entity_key(t: Tables):
    major = F.col("c_custkey") * 1371
    return t.customer.select("c_custkey", c.entity_key(major, "c_nationkey").alias("key"),
                             c.entity_key(major, "c_nationkey", "-").alias("dashed"))


@query("B02", """
SELECT c_custkey, lpad(CAST(c_custkey AS VARCHAR), 6, '0') || lpad(CAST(c_nationkey AS VARCHAR), 4, '0') AS plain,
       lpad(CAST(c_custkey AS VARCHAR), 6, '0') || '-' || lpad(CAST(c_nationkey AS VARCHAR), 4, '0') AS restored
FROM customer""")
def normalize_key(t: Tables):
    dashed = t.customer.select("c_custkey", c.entity_key("c_custkey", "c_nationkey", "-").alias("k"))
    return dashed.select("c_custkey", c.normalize_key("k").alias("plain"),
                         c.restore_key(c.normalize_key("k")).alias("restored"))


_NUM = ("CASE event_id % 6 WHEN 0 THEN ' ' || event_id || ' ' WHEN 1 THEN event_id || '.7' "
        "WHEN 2 THEN 'n/a' WHEN 3 THEN '' WHEN 4 THEN '-' || event_id || '.25' ELSE NULL END")


@query("B03", f"""
SELECT event_id, n AS num, CAST(trunc(n) AS INT) AS whole FROM (
  SELECT event_id, TRY_CAST(trim({_NUM}) AS DOUBLE) AS n FROM events)""")
def lenient_numbers(t: Tables):
    e = t.events.select("event_id", F.expr(_NUM).alias("x"))
    return e.select("event_id", c.to_num("x").alias("num"), c.to_int("x").alias("whole"))


_YN = "CASE event_id % 6 WHEN 0 THEN ' y ' WHEN 1 THEN '1' WHEN 2 THEN 'Yes' WHEN 3 THEN 'true' WHEN 4 THEN 'N' ELSE NULL END"


@query("B04", f"""
SELECT event_id, CAST(COALESCE(x IN ('Y','1','YES'), FALSE) AS INT) AS flag,
       COALESCE(x IN ('Y','YES','TRUE','1'), FALSE) AS truth
FROM (SELECT event_id, upper(trim({_YN})) AS x FROM events)""")
def yes_no_flags(t: Tables):
    e = t.events.select("event_id", F.expr(_YN).alias("x"))
    return e.select("event_id", c.yn_flag("x").alias("flag"), c.coerce_bool("x").alias("truth"))


_TOK = "CASE event_id % 4 WHEN 0 THEN '(unknown)' WHEN 1 THEN '   ' WHEN 2 THEN '  ' || event_type || '   x ' ELSE event_type END"


@query("B05", f"""
SELECT event_id, CASE WHEN x IN ('', '(unknown)') THEN NULL ELSE x END AS value
FROM (SELECT event_id, trim(regexp_replace({_TOK}, '\\s+', ' ', 'g')) AS x FROM events)""")
def null_tokens(t: Tables):
    return t.events.select("event_id", c.null_tokens(F.expr(_TOK)).alias("value"))


@query("B06", r"""
SELECT p_partkey, regexp_replace(regexp_replace(lower(' ' || p_name || ' (' || p_brand || ')'),
       '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS slug FROM part""")
def slug_names(t: Tables):
    name = F.concat(F.lit(" "), "p_name", F.lit(" ("), "p_brand", F.lit(")"))
    return t.part.select("p_partkey", c.slug(name).alias("slug"))


@query("B07", """
SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 2 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS parsed
FROM orders""")
def parse_dates(t: Tables):
    key = F.col("o_orderkey") % 3
    text = (F.when(key == 0, F.date_format("o_orderdate", "MM/dd/yyyy"))
            .when(key == 1, F.date_format("o_orderdate", "yyyy-MM-dd"))
            .otherwise(F.date_format("o_orderdate", "yyyy.MM")))
    return t.orders.select("o_orderkey", c.parse_date(text).alias("parsed"))


@query("B08", """
SELECT o_orderkey, CAST(CASE WHEN o_orderkey % 4 < 2 THEN date_trunc('quarter', o_orderdate)
       WHEN o_orderkey % 4 = 2 THEN date_trunc('month', o_orderdate) END AS DATE) AS period
FROM orders""")
def parse_periods(t: Tables):
    y, q = F.year("o_orderdate").cast("string"), F.quarter("o_orderdate").cast("string")
    key = F.col("o_orderkey") % 4
    text = (F.when(key == 0, F.concat(y, F.lit(" Q"), q))
            .when(key == 1, F.concat(y, F.lit("Q"), q, F.lit(" EST")))
            .when(key == 2, F.concat(y, F.lit("M"), F.date_format("o_orderdate", "MM")))
            .otherwise(F.concat(y, F.lit(" Q"), q, F.lit(" QTD"))))
    return t.orders.select("o_orderkey", c.parse_period(text).alias("period"))


_DOLLARS = "CAST(floor(o_totalprice) AS BIGINT)"
_THOUSANDS = (f"CAST(CAST(floor(o_totalprice / 1000) AS BIGINT) AS VARCHAR) || ',' || "
              f"lpad(CAST({_DOLLARS} % 1000 AS VARCHAR), 3, '0')")


@query("B09", f"""
SELECT o_orderkey, CAST(CASE o_orderkey % 4 WHEN 0 THEN d WHEN 1 THEN -d WHEN 2 THEN -d END AS DOUBLE) AS amount
FROM (SELECT o_orderkey, {_DOLLARS} AS d FROM orders)""")
def parse_money(t: Tables):
    text = F.expr(_THOUSANDS.replace("VARCHAR", "STRING"))
    key = F.col("o_orderkey") % 4
    shown = (F.when(key == 0, F.concat(F.lit("$"), text))
             .when(key == 1, F.concat(F.lit("-$"), text))
             .when(key == 2, F.concat(F.lit("$ ("), text, F.lit(")")))
             .otherwise(F.lit("$")))
    return t.orders.select("o_orderkey", c.parse_money(shown).alias("amount"))


@query("B10", r"""
SELECT page_id, TRY_CAST(regexp_replace(url, '[^0-9.\-]', '', 'g') AS DOUBLE) AS num FROM pages""")
def digits_to_number(t: Tables):
    return t.pages.select("page_id", c.digits_to_num("url").alias("num"))


_NORMAL = (r"trim(regexp_replace(regexp_replace(regexp_replace(upper({x}), '[^A-Z0-9&]+', ' ', 'g'), "
           "'" + codes.KEYWORD_NOISE + r"', ' ', 'g'), '\s+', ' ', 'g'))")


@query("B11", f"SELECT doc_id, {_NORMAL.format(x='text')} AS words FROM documents")
def normalize_text(t: Tables):
    return t.documents.select("doc_id", c.normalize_text("text").alias("words"))


@query("B12", """
SELECT c_custkey, CASE WHEN b > 0 THEN round(ln(b), 9) END AS log_value,
       round(ln(1 + greatest(b, 0)), 9) AS log1p_value
FROM (SELECT c_custkey, c_acctbal - 2000 AS b FROM customer)""")
def positive_logs(t: Tables):
    shifted = t.customer.select("c_custkey", (F.col("c_acctbal") - 2000).alias("b"))
    return shifted.select("c_custkey", dbl(c.log_pos("b"), "log_value", 9),
                          dbl(c.log1p_pos("b"), "log1p_value", 9))


_STREETS = ("Main Street", "4th Avenue", "North Lake Boulevard", "Oak Rd.", "Southwest Hill Parkway",
            "Broadway")
_ADDRESS = ("c_custkey || ' ' || CASE c_custkey % 6 "
            + " ".join(f"WHEN {i} THEN '{s}'" for i, s in enumerate(_STREETS))
            + " END || CASE c_custkey % 4 WHEN 0 THEN ' Suite ' || c_nationkey WHEN 1 THEN ', NE' "
            "WHEN 2 THEN ' #' || c_nationkey ELSE '' END")


def _sql_word(w: str) -> str:
    return (f"CASE " + " ".join(f"WHEN {w} = '{k}' THEN '{v}'"
                                for k, v in codes.STREET_ABBREVIATIONS.items()) + f" ELSE {w} END")


_GENERIC = sorted(set(codes.STREET_ABBREVIATIONS.values()))
_ADDRESS_SQL = f"""
addr AS (
  SELECT c_custkey, list_transform(string_split(trim(regexp_replace(regexp_replace(
           regexp_replace(upper(trim({_ADDRESS})), '{codes.UNIT_SUFFIX}', ''),
           '[^A-Z0-9 ]', ' ', 'g'), '\\s+', ' ', 'g')), ' '), lambda w: {_sql_word('w')}) AS words
  FROM customer)"""


@query("B13", f"WITH {_ADDRESS_SQL} SELECT c_custkey, array_to_string(words, ' ') AS address FROM addr")
def normalize_address(t: Tables):
    return t.customer.select("c_custkey", c.normalize_address(F.expr(_ADDRESS)).alias("address"))


@query("B14", f"""
WITH {_ADDRESS_SQL}
SELECT c_custkey, CASE WHEN len(words) < 2 THEN NULL ELSE words[1] || ' ' || array_to_string(
         CASE WHEN len(core) = 0 THEN words[2:] ELSE core END, ' ') END AS core_key
FROM (SELECT c_custkey, words, list_filter(words[2:], lambda w: w NOT IN ({sql_list(_GENERIC)})) AS core
      FROM addr)""")
def address_core_key(t: Tables):
    address = c.normalize_address(F.expr(_ADDRESS))
    return t.customer.select("c_custkey", address.alias("a")).select(
        "c_custkey", c.address_core_key("a").alias("core_key"))


@query("B15", """
SELECT o_orderkey, CASE WHEN length(d) >= 5 THEN substr(d, 1, 5) END AS zip FROM (
  SELECT o_orderkey, regexp_replace(o_orderkey || '-' || o_custkey, '[^0-9]', '', 'g') AS d FROM orders)""")
def zip_codes(t: Tables):
    text = F.concat_ws("-", F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string"))
    return t.orders.select("o_orderkey", c.zip5(text).alias("zip"))


_OWNER = ("c_name || CASE c_custkey % 8 WHEN 0 THEN ' LLC' WHEN 1 THEN ' L.L.C.' WHEN 2 THEN ' Inc.' "
          "WHEN 3 THEN ' Living Trust' WHEN 4 THEN ' Limited Liability Company' WHEN 5 THEN ' LP' ELSE '' END")


def _any(expr: str, patterns) -> str:
    return "(" + " OR ".join(f"regexp_matches({expr}, '{p}')" for p in patterns) + ")"


_LLC, _ENTITY = _any("u", codes.LLC_PATTERNS), _any("u", codes.ENTITY_PATTERNS)


@query("B16", f"""
SELECT c_custkey, CAST({_LLC} AS INT) AS is_llc, CAST({_LLC} OR {_ENTITY} AS INT) AS is_entity
FROM (SELECT c_custkey, upper({_OWNER}) AS u FROM customer)""")
def owner_name_flags(t: Tables):
    owners = t.customer.select("c_custkey", F.expr(_OWNER).alias("owner"))
    flags = c.entity_flags("owner")
    return owners.select("c_custkey", *[v.alias(k) for k, v in flags.items()])


@query("B17", f"""
WITH {PANEL_SQL}, {GRID_SQL}
SELECT parcel_id, tax_yr, CAST(COALESCE(v, tax_yr) AS DOUBLE) AS value FROM grid""")
def coalesce_present(t: Tables):
    g = grid(t).withColumn("filled", F.col("tax_yr"))
    return g.select("parcel_id", "tax_yr",
                    dbl(c.coalesce_present(g, ["absent", "v", "filled"]), "value"))


@query("B18", """
SELECT o_orderkey, CAST(CASE WHEN a IS NULL AND b IS NULL THEN NULL
       ELSE COALESCE(a, 0) + COALESCE(b, 0) END AS DOUBLE) AS total
FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 3 > 0 THEN CAST(o_totalprice AS DECIMAL(18,2)) END AS a,
             CASE WHEN o_orderkey % 2 > 0 THEN CAST(o_custkey AS DECIMAL(18,2)) END AS b FROM orders)""")
def null_aware_sum(t: Tables):
    a = F.when(F.col("o_orderkey") % 3 > 0, F.col("o_totalprice").cast("decimal(18,2)"))
    b = F.when(F.col("o_orderkey") % 2 > 0, F.col("o_custkey").cast("decimal(18,2)"))
    return t.orders.select("o_orderkey", dbl(c.null_sum(a, b), "total"))


_USE = "CAST(295 + p_size * 11 AS INT)"


@query("B19", f"""
SELECT p_partkey, {sql_codes('q', codes.QUALITY_LABELS)} AS quality,
       {sql_codes('k', codes.CONSTRUCTION_LABELS)} AS construction,
       {sql_ranges('u', codes.USE_BUCKETS, "'unknown'")} AS bucket,
       {sql_ranges('u', codes.USE_CLASSES, "'Other Commercial'")} AS use_class,
       {sql_codes('u', codes.PREDOMINANT_USE_LABELS, "'Use_' || u")} AS use_label,
       {sql_ranges('s', codes.UNIT_SIZE_TIERS)} AS size_tier
FROM (SELECT p_partkey, p_size % 11 AS q, p_size % 7 AS k, {_USE} AS u, p_size * 45 AS s FROM part)""")
def case_labels(t: Tables):
    size = F.col("p_size")
    use = F.expr(_USE)
    return t.part.select(
        "p_partkey", lb.case_label(size % 11, codes.QUALITY_LABELS).alias("quality"),
        lb.case_label(size % 7, codes.CONSTRUCTION_LABELS).alias("construction"),
        lb.case_label(use, codes.USE_BUCKETS, "unknown").alias("bucket"),
        lb.case_label(use, codes.USE_CLASSES, "Other Commercial").alias("use_class"),
        lb.code_label(use, codes.PREDOMINANT_USE_LABELS, other_prefix="Use_").alias("use_label"),
        lb.case_label(size * 45, codes.UNIT_SIZE_TIERS).alias("size_tier"))


_USE118 = (f"CASE {sql_groups('u', codes.SECTION_USE_SETS)} "
           + " ".join(f"WHEN u >= {a} AND u < {b} THEN '{v}'" for a, b, v in codes.SECTION_USE_RANGES)
           + " END")
_ZONES = ("IG1 U/45", "DOC1 U/450/U", "NC3P-75 (M)", "LR3 (M)", "  sm-x 240", "ZZ 9")
_ZONE = "CASE p_size % 7 " + " ".join(f"WHEN {i} THEN '{z}'" for i, z in enumerate(_ZONES)) + " ELSE NULL END"
_ZONING = "CASE " + " ".join(
    f"WHEN regexp_matches(z, '{p}') THEN '{v}'" for p, v in codes.ZONING_PREFIXES) + " END"


@query("B20", f"""
SELECT p_partkey, {_USE118} AS use_class, {_ZONING} AS zone_class
FROM (SELECT p_partkey, CAST(290 + p_size * 5 AS INT) AS u, upper(trim({_ZONE})) AS z FROM part)""")
def use_and_zoning_class(t: Tables):
    return t.part.select(
        "p_partkey", lb.classify_use((290 + F.col("p_size") * 5).cast("int")).alias("use_class"),
        lb.classify_zoning(F.expr(_ZONE)).alias("zone_class"))


_WORDS = ("Medical Office Building", "Inn & Suites", "Lofts Apartments", "cold storage warehouses",
          "Shopping Centre", "Corporate Center Tower", "Properties LLC", "Bed and Breakfast", "", "flats")
TEXT_EXPR = ("p_name || ' ' || CASE p_partkey % 10 "
             + " ".join(f"WHEN {i} THEN '{w}'" for i, w in enumerate(_WORDS)) + " END")
KEYWORD_SQL = "CASE " + " ".join(
    f"WHEN regexp_matches(w, '{p}') THEN '{label}'" for label, p in codes.KEYWORDS) + " END"


@query("B21", f"""
SELECT p_partkey, {KEYWORD_SQL} AS class FROM (
  SELECT p_partkey, {_NORMAL.format(x=TEXT_EXPR)} AS w FROM part)""")
def keyword_class(t: Tables):
    return t.part.select("p_partkey", lb.classify_keywords(F.expr(TEXT_EXPR)).alias("class"))


NORMAL_SQL = _NORMAL


@query("B22", """
SELECT c_custkey, CASE WHEN d > 0 THEN c_acctbal / d WHEN d <= 0 THEN 0.0 END AS share,
       CASE WHEN d > 0 THEN c_acctbal / d END AS ratio
FROM (SELECT c_custkey, c_acctbal, CAST(c_custkey % 5 AS DOUBLE) AS d FROM customer)""")
def guarded_ratios(t: Tables):
    d = F.col("c_custkey") % 5
    return t.customer.select("c_custkey", c.safe_ratio("c_acctbal", d, 0.0).alias("share"),
                             c.safe_ratio("c_acctbal", d).alias("ratio"))


@query("B23", f"""
WITH {PANEL_SQL}, {GRID_SQL}
SELECT parcel_id, tax_yr, CAST(CASE WHEN v IS NOT NULL THEN least(greatest(v, 100000), 300000) END AS DOUBLE) AS bounded,
       CAST(CASE WHEN v IS NOT NULL THEN least(v, 250000) END AS DOUBLE) AS capped FROM grid""")
def clamped_values(t: Tables):
    return grid(t).select("parcel_id", "tax_yr", dbl(c.clamp("v", 100000, 300000), "bounded"),
                          dbl(c.clamp("v", hi=250000), "capped"))


@query("B24", """
SELECT o_orderkey, CAST(COALESCE(a, 0) + COALESCE(b, 0) AS INT) AS nuisance, CAST(a + b AS INT) AS amenity
FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 4 > 0 THEN o_orderkey % 4 END AS a,
             CASE WHEN o_orderkey % 3 > 0 THEN o_orderkey % 3 END AS b FROM orders)""")
def additive_scores(t: Tables):
    a = F.when(F.col("o_orderkey") % 4 > 0, F.col("o_orderkey") % 4)
    b = F.when(F.col("o_orderkey") % 3 > 0, F.col("o_orderkey") % 3)
    return t.orders.select("o_orderkey", c.score([a, b]).cast("int").alias("nuisance"),
                           c.score([a, b], null_as_zero=False).cast("int").alias("amenity"))


@query("B25", """
SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority ELSE o_orderstatus END AS label
FROM orders""")
def repair_join_twins(t: Tables):
    twins = t.orders.select(
        "o_orderkey", F.col("o_orderstatus").alias("label.x"),
        F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderpriority")).alias("label.y"))
    return c.repair_suffixed(twins)


_ELIG = """
SELECT o_orderkey, CAST(o_orderkey % 120 AS VARCHAR) AS pct, CAST(o_orderkey % 23 AS VARCHAR) AS grade,
       CASE WHEN o_orderstatus = 'P' THEN 'O' WHEN o_orderstatus = 'F' THEN 'T' END AS stat,
       CASE WHEN o_orderkey % 7 = 0 THEN 'HP' WHEN o_orderkey % 7 = 1 THEN 'ZZ' END AS reason,
       CASE WHEN o_orderkey % 5 > 0 THEN CAST(o_orderkey % 9 AS VARCHAR) END AS hbu,
       CASE WHEN o_orderkey % 4 > 0 THEN o_orderkey % 4 - 1 END AS area,
       CASE WHEN o_orderkey % 3 > 0 THEN o_orderkey % 3 - 1 END AS imps,
       o_orderkey % 6 AS units FROM orders"""


@query("B26", f"""
SELECT o_orderkey, inc AS is_incomplete_bldg, CAST(COALESCE(g = 20, FALSE) AS INT) AS is_exceptional_grade,
       CAST(least(g, 13) AS INT) AS bldg_grade_capped, sfr AS is_non_sfr_hbu,
       CAST(units BETWEEN 2 AND 4 AS INT) AS is_small_mf, lo AS is_land_only, m AS model_flag,
       CAST(m = 1 AND lo = 0 AS INT) AS train_flag, 1 AS forecast_flag
FROM (SELECT *, CAST(inc = 0 AND sfr = 0 AND NOT COALESCE(stat <> 'T', FALSE)
                AND NOT COALESCE(reason IN ({sql_list(codes.EXEMPT_REASONS)}), FALSE) AS INT) AS m
  FROM (SELECT *, CAST(CAST(pct AS INT) BETWEEN 1 AND 99 AS INT) AS inc, CAST(grade AS INT) AS g,
               CAST(COALESCE(CAST(hbu AS INT) >= 6, FALSE) AS INT) AS sfr,
               CAST(COALESCE(area, 0) = 0 AND COALESCE(imps, 0) = 0 AS INT) AS lo
        FROM ({_ELIG})))""")
def eligibility_flags(t: Tables):
    rows = t.spark.sql(_ELIG.replace("VARCHAR", "STRING").replace("FROM orders", "FROM {orders}"),
                       orders=t.orders)
    flags = lb.eligibility_flags(rows, pcnt_complete="pct", grade="grade", tax_status="stat",
                                 tax_reason="reason", best_use="hbu", living_area="area",
                                 improvements="imps", living_units="units")
    return flags.drop("pct", "grade", "stat", "reason", "hbu", "area", "imps", "units")


@query("B27", """
SELECT o_orderkey, CAST(o_orderkey % 5 AS INT) AS access, CAST(o_orderkey % 2 = 1 AS INT) AS topography,
       CAST(o_custkey AS DOUBLE) AS lot_depth_factor, CAST(o_orderkey % 2 = 0 AS INT) AS ngpe,
       CASE WHEN o_orderkey % 4 > 0 THEN CAST(o_orderkey % 4 - 1 AS INT) END AS waterfront_location,
       CAST(COALESCE(o_orderkey % 4 - 1 > 0, FALSE) AS INT) AS is_waterfront FROM orders""")
def typed_features(t: Tables):
    key = F.col("o_orderkey")
    raw = t.orders.select(
        "o_orderkey", (key % 5).cast("string").alias("access"),
        (key % 2).cast("string").alias("topography"),
        F.col("o_custkey").cast("string").alias("lot_depth_factor"),
        F.when(key % 2 == 0, " y ").otherwise("N").alias("native_growth_protection_easement"),
        F.when(key % 4 > 0, (key % 4 - 1).cast("string")).alias("waterfront_location"))
    return c.type_features(raw, ints=["access", "waterfront_location"], doubles=["lot_depth_factor"],
                           flags=["native_growth_protection_easement", "wetland"],
                           equals_one=["topography"],
                           positive={"waterfront_location": "is_waterfront"},
                           rename={"native_growth_protection_easement": "ngpe"})


@query("B28", """
SELECT o_orderkey, CAST(CASE WHEN y <> 0 THEN greatest(1999 - y, 0) END AS INT) AS age
FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 9 = 0 THEN 0 ELSE year(o_orderdate) END AS y FROM orders)""")
def ages(t: Tables):
    built = F.when(F.col("o_orderkey") % 9 == 0, 0).otherwise(F.year("o_orderdate"))
    return t.orders.select("o_orderkey", c.age_at(built, 1999).alias("age"))


@query("B29", f"""
SELECT p_partkey, eff AS effective_unit_sqft, {sql_ranges('eff', codes.UNIT_SIZE_TIERS)} AS unit_size_tier,
       CAST(CASE WHEN st > 0 THEN CAST(fl = st AS INT) END AS INT) AS is_penthouse,
       CAST(COALESCE(st >= 8, FALSE) AS INT) AS is_highrise, CAST(p_size * 2 >= 50 AS INT) AS is_large_complex,
       CAST(p_size % 5 > 0 AS INT) AS complex_has_view,
       CAST(CAST(p_size % 2 = 0 AS INT) + CAST(p_size % 3 = 0 AS INT) + 1 + CAST(p_size % 3 >= 1 AS INT) AS INT) AS amenity_score,
       CAST(p_size % 5 + p_size % 4 AS DOUBLE) AS appeal_location_score
FROM (SELECT *, CAST(CASE WHEN a > 0 THEN a WHEN b > 0 THEN b END AS DOUBLE) AS eff
      FROM (SELECT *, CASE WHEN p_partkey % 3 > 0 THEN p_size * 40 ELSE 0 END AS a,
                   CASE WHEN p_partkey % 4 > 0 THEN p_size * 50 END AS b,
                   CASE WHEN p_partkey % 5 > 0 THEN p_size % 12 END AS st, p_size % 10 AS fl FROM part))""")
def unit_features(t: Tables):
    k, s = F.col("p_partkey"), F.col("p_size")
    rows = t.part.select(
        "p_partkey", F.when(k % 3 > 0, s * 40).otherwise(0).alias("unit_sqft"),
        F.when(k % 4 > 0, s * 50).alias("avg_unit_size"), F.when(k % 5 > 0, s % 12).alias("nbr_stories_cplx"),
        (s % 10).alias("unit_floor"), (s * 2).alias("nbr_units"), (s % 5).alias("pcnt_with_view"),
        (s % 2 == 0).alias("has_elevators"), (s % 3 == 0).alias("has_security"),
        F.lit(True).alias("has_fireplace"), (s % 3).alias("laundry_type"),
        (s % 5).alias("project_appeal"), (s % 4).alias("project_location"))
    return lb.unit_flags(rows).select(
        "p_partkey", "effective_unit_sqft", "unit_size_tier", "is_penthouse", "is_highrise",
        "is_large_complex", "complex_has_view", "amenity_score", "appeal_location_score")


# -- filters -----------------------------------------------------------------

_CODED = "CASE WHEN o_orderkey % 5 > 0 THEN o_orderpriority END"


@query("C01", f"""
SELECT 'kept' AS part, o_orderkey FROM orders WHERE {_CODED} IN ('1-URGENT', '2-HIGH')
UNION ALL SELECT 'rest', o_orderkey FROM orders
WHERE {_CODED} IS NULL OR {_CODED} NOT IN ('1-URGENT', '2-HIGH')""")
def filter_codes(t: Tables):
    rows = t.orders.select("o_orderkey", F.expr(_CODED).alias("code"))
    listed = ("1-URGENT", "2-HIGH")
    kept = fl.filter_codes(rows, "code", listed).select(F.lit("kept").alias("part"), "o_orderkey")
    rest = fl.filter_codes(rows, "code", listed, keep=False).select(F.lit("rest").alias("part"),
                                                                    "o_orderkey")
    return kept.unionByName(rest)


@query("C02", f"WITH {PANEL_SQL} SELECT parcel_id, tax_yr, CAST(v AS DOUBLE) AS v FROM panel WHERE tax_yr BETWEEN 1997 AND 1999")
def filter_years(t: Tables):
    return fl.filter_years(panel(t), 1997, 1999).select("parcel_id", "tax_yr", dbl("v", "v"))


@query("C03", f"WITH {PANEL_SQL}, {GRID_SQL} SELECT parcel_id, tax_yr, CAST(v AS DOUBLE) AS v FROM grid WHERE v IS NOT NULL")
def drop_missing(t: Tables):
    return fl.drop_null(grid(t), ["v"]).select("parcel_id", "tax_yr", dbl("v", "v"))


@query("C04", "SELECT l_orderkey, l_linenumber, l_quantity, l_shipdate FROM lineitem")
def drop_columns_like(t: Tables):
    return fl.drop_like(t.lineitem, "^l_(part|supp)|flag$|status$|price$|tax$|discount$")


@query("C05", r"""
SELECT o_orderkey, q FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'Total'
  ELSE year(o_orderdate) || 'Q' || quarter(o_orderdate) END AS q FROM orders)
WHERE regexp_matches(q, '^\d{4}Q[1-4]$')""")
def filter_pattern(t: Tables):
    q = F.when(F.col("o_orderkey") % 3 == 0, "Total").otherwise(
        F.concat(F.year("o_orderdate"), F.lit("Q"), F.quarter("o_orderdate")))
    return fl.filter_rlike(t.orders.select("o_orderkey", q.alias("q")), "q", r"^\d{4}Q[1-4]$")
