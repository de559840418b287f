"""Queries for sources, sinks, code tables and report text."""

from __future__ import annotations

from pyspark.sql import functions as F

from acreline.functions import codes
from acreline.functions.cleaning import to_num
from acreline.queries.base import PANEL_SQL, Tables, dbl, panel, query
from acreline.sources import extracts as ex
from acreline.sources import published as pb
from acreline.sources import report_text as rt
from acreline.sources import tables as tb

_SEGMENT = ("CASE c_custkey % 5 WHEN 0 THEN 'NA' WHEN 1 THEN ' ' WHEN 2 THEN '' ELSE c_mktsegment END")


@query("A01", """
SELECT CAST(c_custkey AS VARCHAR) AS cust_key, CASE WHEN c_custkey % 5 > 2 THEN c_mktsegment END AS mkt_segment,
       CAST(c_nationkey AS VARCHAR) AS nation_key FROM customer""")
def read_extract(t: Tables):
    raw = t.customer.select(F.col("c_custkey").alias("CustKey"), F.expr(_SEGMENT).alias("MktSegment"),
                            F.col("c_nationkey").alias("Nation Key"))
    path = ex.write_table(raw, ex.run_path(t.spark, "extract"), "csv")
    return ex.read_extract(t.spark, path, columns=["CustKey", "MktSegment", "Nation Key"])


@query("A02", """
SELECT c_custkey AS parcel_id, c_acctbal AS value, NULL::INT AS zoning, c_mktsegment AS segment FROM customer""")
def select_with_aliases(t: Tables):
    out, _ = ex.select_with_aliases(
        t.customer, {"parcel_id": ["ParcelId", "c_custkey"], "value": ["c_acctbal", "c_nationkey"],
                     "zoning": ["Zoning", "CurrentZoning"], "segment": ["c_mktsegment"]},
        {"value": "double", "zoning": "int"})
    return out


@query("A03", f"WITH {PANEL_SQL} SELECT CAST(parcel_id AS VARCHAR) AS parcel_id, CAST(tax_yr AS VARCHAR) AS tax_yr, CAST(v AS DOUBLE) AS v FROM panel")
def csv_sink(t: Tables):
    path = ex.write_table(panel(t), ex.run_path(t.spark, "panel"), "csv", dated="2026-08-01")
    back = ex.read_extract(t.spark, path, columns=["parcel_id", "tax_yr", "v"])
    return back.withColumn("v", to_num("v"))


@query("A04", f"WITH {PANEL_SQL} SELECT parcel_id, CAST(v AS DOUBLE) AS v, 'baseline' AS scenario, tax_yr FROM panel")
def parquet_sink(t: Tables):
    tagged = panel(t).select("parcel_id", dbl("v", "v"), F.lit("baseline").alias("scenario"), "tax_yr")
    path = ex.write_table(tagged, ex.run_path(t.spark, "panel"), partition_by=["scenario", "tax_yr"])
    return t.spark.read.parquet(path)


@query("A05", """
SELECT s_suppkey, 'optimistic' AS scenario, CAST(2 AS INT) AS run_id FROM supplier""")
def read_latest_run(t: Tables):
    rows = t.supplier.select("s_suppkey")
    runs = None
    for scenario, run in (("optimistic", 1), ("optimistic", 2), ("baseline", 3)):
        part = rows.withColumns({"scenario": F.lit(scenario), "run_id": F.lit(run)})
        runs = part if runs is None else runs.unionByName(part)
    path = ex.write_table(runs, ex.run_path(t.spark, "runs"), partition_by=["scenario", "run_id"])
    return ex.read_latest(t.spark, path, "optimistic")


@query("A06", "SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY 1")
def materialized_stage(t: Tables):
    path = ex.run_path(t.spark, "stage")
    make = lambda: t.orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    source = [f"{t.path}/orders.parquet"]
    pb.materialize(make, path, source, spark=t.spark)
    # The second call finds the stage made from the same source and reads it.
    return pb.materialize(lambda: make().filter("n < 0"), path, source, spark=t.spark)


_SUBGROUP_ROWS = ", ".join(f"({c}, '{k}')" for k, v in codes.SUBGROUP_USES.items() for c in v)


@query("A11", f"""
WITH codes(code, label) AS (VALUES {_SUBGROUP_ROWS})
SELECT label, COUNT(*) AS n_parts FROM part JOIN codes ON code = p_size + 150 GROUP BY 1""")
def code_table_use(t: Tables):
    table = tb.code_table(t.spark, codes.SUBGROUP_USES)
    coded = t.part.select((F.col("p_size") + 150).alias("code"))
    return coded.join(table, "code").groupBy("label").agg(F.count(F.lit(1)).alias("n_parts"))


_EX, _BEFORE = codes.EXEMPT_2023, codes.CERTIFIED_BEFORE_EXEMPT_2023 + codes.EXEMPT_2023
_ANCHOR_ROWS = ", ".join(f"({y}, {g}, {c or 'NULL'}, {p})" for y, g, c, p in codes.CERTIFIED)
ANCHOR_SQL = f"""anchors AS (
  SELECT tax_yr, pp_av, COALESCE(CAST(stated AS DOUBLE), CASE WHEN tax_yr = 2023 THEN CAST(grand - {_EX} AS DOUBLE)
         ELSE grand * (1 - {_EX}::DOUBLE / {_BEFORE}) END) AS cert_total
  FROM (VALUES {_ANCHOR_ROWS}) a(tax_yr, grand, stated, pp_av))"""
APPRAISED_SQL = "appraised AS (SELECT tax_yr, track, b, b * 1e9 / SUM(b * 1e9) OVER (PARTITION BY tax_yr) AS share FROM (VALUES " + ", ".join(
    f"({y}, '{k}', {b}::DOUBLE)" for y, k, b in codes.APPRAISED_BILLIONS) + ") a(tax_yr, track, b))"


@query("A12", f"""
WITH {PANEL_SQL}, {ANCHOR_SQL}, s AS (SELECT tax_yr + 25 AS tax_yr, SUM(v) AS raw FROM panel GROUP BY 1)
SELECT CAST(s.tax_yr AS INT) AS tax_yr, CAST(raw AS DOUBLE) AS raw, round(cert_total, 0) AS cert_total,
       round(cert_total - pp_av, 0) AS cert_real FROM s JOIN anchors USING (tax_yr)""")
def certified_anchors(t: Tables):
    raw = panel(t).groupBy((F.col("tax_yr") + 25).alias("tax_yr")).agg(dbl(F.sum("v"), "raw"))
    return raw.join(tb.anchor_table(t.spark), "tax_yr").select(
        "tax_yr", "raw", dbl("cert_total", "cert_total", 0), dbl("cert_real", "cert_real", 0))


# -- report text -------------------------------------------------------------

# Report lines made from whole `orders`: 400 orders are one report, of one of four
# templates. The text is the same expression in both dialects.
_AMOUNT = "CAST(CAST(floor(p / 1000) AS BIGINT) AS VARCHAR) || ',' || lpad(CAST(CAST(floor(p) AS BIGINT) % 1000 AS VARCHAR), 3, '0')"
_LINES = f"""
SELECT CASE f % 4 WHEN 0 THEN 'res_' WHEN 1 THEN 'district_' WHEN 2 THEN 'specialty_' ELSE 'letter_' END
         || CAST(f + 300 AS VARCHAR) || '.txt' AS source_file, n AS line_no,
  CASE
    WHEN n = 1 THEN CASE f % 4 WHEN 0 THEN '  2026 Residential Revalue' WHEN 1 THEN 'Geographic Areas Report: Commercial Revalue'
      WHEN 2 THEN 'Commercial Revalue: Specialty Area ' || CAST(200 + f % 50 AS VARCHAR) ELSE 'Annual letter' END
    WHEN f % 4 = 0 OR (f % 8 = 3 AND n > 3) THEN CASE n % 5 WHEN 0 THEN '' WHEN 1 THEN 'Sales ratio of area ' || CAST(n AS VARCHAR)
      WHEN 4 THEN ' Area ' || CAST(n % 90 AS VARCHAR) || ' Sales  $' || a || '  $' || a || '  $1,000  +' || pc || '%  91.5%'
      ELSE '  Area ' || CAST(n % 90 AS VARCHAR) || ' Pop   $' || a || '  $' || a || '   -$57,400   -' || pc || '%' END
    WHEN f % 2 = 1 THEN CASE WHEN n % 20 IN (2, 12) THEN 'Geo Area   2025 Total Value   2026 Total Value   $ Change   % Change'
      WHEN n % 20 = 6 THEN '   ' WHEN n % 20 = 10 THEN '  Total  $' || a WHEN n % 20 = 16 THEN 'Narrative text'
      WHEN n % 20 > 2 AND n % 20 < 18 THEN '  ' || CAST(n % 100 AS VARCHAR) || '  $' || a || '  $' || a || '  -$' || a || '  -' || pc || '%'
      ELSE 'More text' END
    ELSE CASE WHEN n % 50 = 10 THEN 'Change in Total Assessed Value' WHEN n % 50 IN (13, 15, 18) THEN '$ ' || a || '  $ ' || a || '  $ (' || a || ')  -' || pc || '%'
      WHEN n % 14 = 0 THEN CAST(201 + f % 50 AS VARCHAR) || '-110 Elsewhere 12 $ ' || a || ' $ ' || a || ' 1.5%'
      WHEN n % 7 = 0 THEN CAST(200 + f % 50 AS VARCHAR) || '-' || CAST(100 + n % 30 AS VARCHAR) || ' Central District 69 $ ' || a || ' $ ' || a || ' -' || pc || '%'
      ELSE '' END
  END AS text
FROM (SELECT CAST(floor(o_orderkey / 400) AS BIGINT) AS f, CAST(o_orderkey % 400 + 1 AS BIGINT) AS n, {_AMOUNT} AS a,
             CAST(o_custkey % 9 AS VARCHAR) || '.' || CAST(o_custkey % 10 AS VARCHAR) AS pc
      FROM (SELECT o_orderkey, o_custkey, o_totalprice AS p FROM orders))"""
_LINES_CTE = f"lines AS ({_LINES})"


def report_lines(t: Tables):
    """The lines as a landed table: written once, so that no reader derives them again."""
    ex.shared_dir(t.spark)
    text = _LINES.replace("VARCHAR", "STRING").replace("FROM orders", "FROM {orders}")
    return t.spark.sql(text, orders=t.orders).checkpoint()


def _sql_money(pattern: str, n: int) -> str:
    g = f"regexp_extract(text, '{pattern}', {n})"
    return (f"(CASE WHEN regexp_matches({g}, '[-(]') THEN -1 ELSE 1 END * "
            f"TRY_CAST(regexp_replace({g}, '[^0-9.]', '', 'g') AS DOUBLE))")


def _sql_int(pattern: str, n: int) -> str:
    return f"TRY_CAST(regexp_extract(text, '{pattern}', {n}) AS INT)"


_R, _D, _T, _S = codes.RES_RATE_ROW, codes.DISTRICT_ROW, codes.SPECIALTY_TOTAL, codes.SPECIALTY_ROW
_RES = f"""res AS (SELECT source_file, line_no, 'res' AS prop_type, 'geo' AS report_kind, {_sql_int(_R, 1)} AS area,
  NULL::INT AS spec_area, NULL::INT AS spec_sub,
  CASE WHEN regexp_extract(text, '{_R}', 2) = 'Pop' THEN 'population' ELSE 'sales' END AS basis, {_sql_money(_R, 3)} AS av_prev,
  {_sql_money(_R, 4)} AS av_curr, {_sql_money(_R, 5)} AS delta, {_sql_money(_R, 6)} / 100 AS pct_change
  FROM lines WHERE regexp_matches(text, '{_R}'))"""
_COM = f"""com AS (SELECT source_file, line_no, 'com' AS prop_type, 'geo' AS report_kind, {_sql_int(_D, 1)} AS area,
  NULL::INT AS spec_area, NULL::INT AS spec_sub, 'population' AS basis, {_sql_money(_D, 2)} AS av_prev, {_sql_money(_D, 3)} AS av_curr,
  {_sql_money(_D, 4)} AS delta, {_sql_money(_D, 5)} / 100 AS pct_change
  FROM (SELECT *, last_value(m IGNORE NULLS) OVER (PARTITION BY source_file ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS s
    FROM (SELECT *, CASE WHEN regexp_matches(text, '{codes.DISTRICT_HEADER}') THEN 1
      WHEN regexp_matches(text, '{_D}') OR regexp_matches(text, '^\\s*$') THEN NULL ELSE 0 END AS m FROM lines))
  WHERE s = 1 AND m IS NULL AND regexp_matches(text, '{_D}'))"""
_SPEC = f"""spec_no AS (SELECT source_file, COALESCE(TRY_CAST(regexp_extract(head, '{codes.SPECIALTY_NUMBER}', 1) AS INT),
    TRY_CAST(regexp_extract(source_file, '(\\d{{2,3}})', 1) AS INT)) AS spec_no
  FROM (SELECT source_file, string_agg(text, ' ' ORDER BY line_no) AS head FROM lines WHERE line_no <= 120 GROUP BY 1)),
tot AS (SELECT l.*, row_number() OVER (PARTITION BY l.source_file ORDER BY h.line_no, l.line_no) AS rn
  FROM lines l JOIN lines h ON h.source_file = l.source_file AND regexp_matches(h.text, '{codes.SPECIALTY_HEADER}')
   AND l.line_no BETWEEN h.line_no + 1 AND h.line_no + 6 WHERE regexp_matches(l.text, '{_T}')),
sub AS (SELECT l.*, spec_no, row_number() OVER (PARTITION BY l.source_file, {_sql_int(_S, 2)} ORDER BY line_no) AS rn
  FROM lines l JOIN spec_no USING (source_file) WHERE regexp_matches(text, '{_S}') AND {_sql_int(_S, 1)} = spec_no),
spec AS (SELECT source_file, line_no, 'com' AS prop_type, 'specialty' AS report_kind, NULL::INT AS area, spec_no AS spec_area,
  NULL::INT AS spec_sub, 'population' AS basis, {_sql_money(_T, 1)} AS av_prev, {_sql_money(_T, 2)} AS av_curr,
  {_sql_money(_T, 3)} AS delta, {_sql_money(_T, 4)} / 100 AS pct_change FROM tot JOIN spec_no USING (source_file) WHERE rn = 1
  UNION ALL SELECT source_file, line_no, 'com', 'specialty_submarket', NULL, spec_no, {_sql_int(_S, 2)}, 'population', NULL,
  {_sql_money(_S, 3)}, NULL, {_sql_money(_S, 4)} / 100 FROM sub WHERE rn = 1)"""


@query("A07", f"WITH {_LINES_CTE}, {_RES} SELECT * FROM res")
def residential_rates(t: Tables):
    return rt.extract_res_rates(report_lines(t))


@query("A08", f"WITH {_LINES_CTE}, {_COM} SELECT * FROM com")
def district_rates(t: Tables):
    return rt.extract_com_rates(report_lines(t))


@query("A09", f"WITH {_LINES_CTE}, {_SPEC} SELECT * FROM spec")
def specialty_rates(t: Tables):
    return rt.extract_spec_rates(report_lines(t))


@query("A10", f"""
WITH {_LINES_CTE}, {_RES}, {_COM}, {_SPEC},
heads AS (SELECT source_file, string_agg(text, ' ' ORDER BY line_no) AS head FROM lines WHERE line_no <= 200 GROUP BY 1),
kinds AS (SELECT source_file, CASE WHEN regexp_matches(head, '(?i)Specialty') AND NOT regexp_matches(head, '(?i)Geographic Areas Report') THEN 3
  WHEN regexp_matches(head, '(?i)Residential Revalue') THEN 1 WHEN regexp_matches(head, '(?i)Commercial Revalue') THEN 2 END AS kind FROM heads),
titles AS (SELECT source_file, trim(arg_min(text, line_no)) AS district FROM lines WHERE length(trim(text)) > 0 GROUP BY 1),
found AS (SELECT 1 AS i, * FROM res UNION ALL SELECT 2, * FROM com UNION ALL SELECT 3, * FROM spec),
firsts AS (SELECT source_file, min(i) AS first FROM found GROUP BY 1)
SELECT CAST(2026 AS INT) AS assessment_yr, prop_type, report_kind, area, spec_area, spec_sub, basis, av_prev, av_curr, delta,
  pct_change, CASE WHEN av_prev <> 0 THEN delta / av_prev END AS pct_change_chk, district, source_file
FROM found JOIN kinds USING (source_file) JOIN firsts USING (source_file) LEFT JOIN titles USING (source_file)
WHERE i = COALESCE(kind, first)""")
def published_rates(t: Tables):
    return rt.extract_rates(report_lines(t), 2026)
