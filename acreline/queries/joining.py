"""Queries for the join operators and the set operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from acreline.operators import joins as j
from acreline.operators import sets
from acreline.queries.base import (GRID_SQL, PANEL_SQL, YEARS_SQL, Tables, dbl, grid, panel,
                                   query)


def _lookup(t: Tables):
    """Nation and region names as one (type, item, description) table."""
    nation = t.nation.select(F.lit(1).alias("lu_type"), F.col("n_nationkey").alias("lu_item"),
                             F.col("n_name").alias("lu_description"))
    region = t.region.select(F.lit(2).alias("lu_type"), F.col("r_regionkey").alias("lu_item"),
                             F.col("r_name").alias("lu_description"))
    return nation.unionByName(region)


@query("D01", """
SELECT s_suppkey, CAST(s_nationkey AS VARCHAR) AS s_nationkey, n_name AS s_nationkey_desc
FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey""")
def decode(t: Tables):
    return j.decode(t.supplier.select("s_suppkey", "s_nationkey"), _lookup(t), "s_nationkey", 1)


@query("D02", """
SELECT c_custkey, CAST(c_nationkey AS VARCHAR) AS nation, n_name AS nation_desc,
       CAST(c_custkey % 7 AS VARCHAR) AS region, r_name AS region_desc
FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON c_custkey % 7 = r_regionkey""")
def decode_many(t: Tables):
    coded = t.customer.select("c_custkey", F.col("c_nationkey").alias("nation"),
                              (F.col("c_custkey") % 7).alias("region"))
    return j.decode_many(coded, _lookup(t), {"nation": 1, "region": 2})


@query("D03", f"""
WITH {PANEL_SQL} SELECT p.parcel_id, tax_yr, CAST(v AS DOUBLE) AS v, c_mktsegment
FROM panel p LEFT JOIN customer ON c_custkey = p.parcel_id""")
def left_join_unique(t: Tables):
    segment = t.customer.select(F.col("c_custkey").alias("parcel_id"), "c_mktsegment")
    return j.left_join_unique(panel(t), segment, "parcel_id").select(
        "parcel_id", "tax_yr", dbl("v", "v"), "c_mktsegment")


_UPD_SQL = """upd AS (
  SELECT c_custkey AS parcel_id, CASE WHEN c_custkey % 4 > 0 THEN CAST(c_acctbal AS DECIMAL(28,2)) END AS v
  FROM customer WHERE c_custkey % 2 = 0)"""


def _updates(t: Tables):
    value = F.when(F.col("c_custkey") % 4 > 0, F.col("c_acctbal").cast("decimal(28,2)"))
    return t.customer.filter(F.col("c_custkey") % 2 == 0).select(
        F.col("c_custkey").alias("parcel_id"), value.alias("v"))


def _with_rule(rule: str) -> str:
    return f"""
WITH {PANEL_SQL}, {GRID_SQL}, {_UPD_SQL}
SELECT g.parcel_id, g.tax_yr, CAST({rule} AS DOUBLE) AS v
FROM grid g LEFT JOIN upd u ON u.parcel_id = g.parcel_id"""


def _show(df):
    return df.select("parcel_id", "tax_yr", dbl("v", "v"))


@query("D04", _with_rule("CASE WHEN u.parcel_id IS NOT NULL THEN u.v ELSE g.v END"))
def update_join(t: Tables):
    return _show(j.update_join(grid(t), _updates(t), "parcel_id", ["v"]))


@query("D05", _with_rule("COALESCE(g.v, u.v)"))
def fill_join(t: Tables):
    return _show(j.fill_join(grid(t), _updates(t), "parcel_id", ["v"]))


@query("D18", _with_rule("COALESCE(u.v, g.v)"))
def overlay_join(t: Tables):
    return _show(j.overlay_join(grid(t), _updates(t), "parcel_id", ["v"]))


@query("D06", """
SELECT o_custkey, CAST(y AS INT) AS tax_yr FROM (SELECT DISTINCT o_custkey FROM orders)
CROSS JOIN (SELECT unnest(range(1995, 2002)) AS y)""")
def cross_grid(t: Tables):
    return j.cross_grid(t.orders, "o_custkey", 1995, 2001)


@query("D07", """
SELECT s_suppkey, s_acctbal, CAST(y AS INT) AS tax_yr FROM supplier
CROSS JOIN (SELECT unnest([2026, 2027, 2028]) AS y)""")
def expand_snapshot(t: Tables):
    return j.expand_snapshot(t.supplier.select("s_suppkey", "s_acctbal"), [2026, 2027, 2028])


_OWNERS = "SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT' AND o_totalprice > 450000"


@query("D08", f"SELECT c_custkey, c_name FROM customer WHERE c_custkey IN ({_OWNERS})")
def semi_join(t: Tables):
    keys = t.orders.filter("o_orderpriority = '1-URGENT' AND o_totalprice > 450000").select(
        F.col("o_custkey").alias("c_custkey"))
    return j.semi(t.customer.select("c_custkey", "c_name"), keys, "c_custkey")


@query("D09", f"SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN ({_OWNERS})")
def anti_join(t: Tables):
    keys = t.orders.filter("o_orderpriority = '1-URGENT' AND o_totalprice > 450000").select(
        F.col("o_custkey").alias("c_custkey"))
    return j.anti(t.customer.select("c_custkey", "c_name"), keys, "c_custkey")


@query("D10", """
SELECT c_custkey, n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey
JOIN region ON n_regionkey = r_regionkey""")
def inner_join(t: Tables):
    nation = j.inner_join(t.nation.withColumnRenamed("n_regionkey", "r_regionkey"), t.region,
                          "r_regionkey").withColumnRenamed("n_nationkey", "c_nationkey")
    return j.inner_join(t.customer, nation, "c_nationkey").select("c_custkey", "n_name", "r_name")


@query("D11", """
SELECT COALESCE(a.yr, b.yr) AS yr, a.n_orders, b.n_lines
FROM (SELECT CAST(year(o_orderdate) AS INT) + 1 AS yr, COUNT(*) AS n_orders FROM orders GROUP BY 1) a
FULL JOIN (SELECT CAST(year(l_shipdate) AS INT) AS yr, COUNT(*) AS n_lines FROM lineitem GROUP BY 1) b ON a.yr = b.yr""")
def outer_join_years(t: Tables):
    orders = t.orders.groupBy((F.year("o_orderdate") + 1).alias("yr")).agg(
        F.count(F.lit(1)).alias("n_orders"))
    lines = t.lineitem.groupBy(F.year("l_shipdate").alias("yr")).agg(
        F.count(F.lit(1)).alias("n_lines"))
    return j.outer_join(orders, lines, "yr")


@query("D12", """
SELECT l_orderkey, l_linenumber, l_quantity, o_custkey, o_orderpriority
FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey""")
def many_join(t: Tables):
    header = t.orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey", "o_orderpriority")
    return j.many_join(t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity"), header,
                       "l_orderkey")


@query("D13", """
SELECT o_orderkey, lpad(CAST(o_custkey AS VARCHAR), 6, '0') || lpad(CAST(o_orderkey % 10000 AS VARCHAR), 4, '0') AS parcel_id,
       c_name FROM orders LEFT JOIN customer ON o_custkey = CASE WHEN c_custkey % 5 > 0 THEN c_custkey ELSE -1 - c_custkey END""")
def prefix_join(t: Tables):
    units = t.orders.select("o_orderkey", F.concat(
        F.lpad(F.col("o_custkey").cast("string"), 6, "0"),
        F.lpad((F.col("o_orderkey") % 10000).cast("string"), 4, "0")).alias("parcel_id"))
    k = F.col("c_custkey")
    parents = t.customer.select(F.concat(F.when(k % 5 == 0, "none").otherwise(""),
                                         F.lpad(k.cast("string"), 6, "0")).alias("major"), "c_name")
    return j.prefix_join(units, parents)


# -- changes over time -------------------------------------------------------

_CHANGES_SQL = f"""
ev AS (SELECT o_custkey AS parcel_id, CAST(year(o_orderdate) AS INT) AS eff_yr, o_orderpriority AS attribute,
              CASE WHEN o_orderkey % 7 > 0 THEN CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR) END AS val,
              o_orderdate AS d, o_orderkey AS k FROM orders),
lastch AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY parcel_id, eff_yr, attribute
             ORDER BY d DESC, k DESC) AS rn FROM ev WHERE attribute IN ('1-URGENT', '5-LOW')) WHERE rn = 1),
base AS (SELECT c_custkey AS parcel_id, CAST(y AS INT) AS tax_yr, CAST(c_acctbal AS DOUBLE) AS urgent,
                c_mktsegment AS low FROM customer CROSS JOIN {YEARS_SQL}),
j AS (SELECT b.*, u.parcel_id IS NOT NULL AS has_u, CAST(u.val AS DOUBLE) AS nu, l.parcel_id IS NOT NULL AS has_l, l.val AS nl
  FROM base b LEFT JOIN lastch u ON u.parcel_id = b.parcel_id AND u.eff_yr = b.tax_yr AND u.attribute = '1-URGENT'
  LEFT JOIN lastch l ON l.parcel_id = b.parcel_id AND l.eff_yr = b.tax_yr AND l.attribute = '5-LOW')"""
_HIST = "OVER (PARTITION BY parcel_id ORDER BY tax_yr ROWS UNBOUNDED PRECEDING)"


def _changes(t: Tables):
    base = j.expand_snapshot(t.customer.select(
        F.col("c_custkey").alias("parcel_id"), F.col("c_acctbal").alias("urgent"),
        F.col("c_mktsegment").alias("low")), t.years)
    value = F.when(F.col("o_orderkey") % 7 > 0,
                   F.floor("o_totalprice").cast("long").cast("string"))
    changes = t.orders.select(
        F.col("o_custkey").alias("parcel_id"), F.year("o_orderdate").alias("eff_yr"),
        F.col("o_orderpriority").alias("attribute"), value.alias("attribute_value"),
        F.col("o_orderdate").alias("update_date"), "o_orderkey")
    return base, changes


@query("D14", f"""
WITH {_CHANGES_SQL} SELECT parcel_id, tax_yr, COALESCE(last_value(nu IGNORE NULLS) {_HIST}, urgent) AS urgent,
       COALESCE(last_value(nl IGNORE NULLS) {_HIST}, low) AS low FROM j""")
def apply_changes_until_next(t: Tables):
    base, changes = _changes(t)
    return j.apply_changes(base, changes, {"1-URGENT": "urgent", "5-LOW": "low"},
                           order=("update_date", "o_orderkey"))


@query("D14", f"""
WITH {_CHANGES_SQL}, p AS (SELECT parcel_id, tax_yr, CASE WHEN has_u THEN nu ELSE urgent END AS a,
                           CASE WHEN has_l THEN nl ELSE low END AS b FROM j)
SELECT parcel_id, tax_yr, last_value(a IGNORE NULLS) {_HIST} AS urgent,
       last_value(b IGNORE NULLS) {_HIST} AS low FROM p""")
def apply_changes_point(t: Tables):
    base, changes = _changes(t)
    return j.apply_changes(base, changes, {"1-URGENT": "urgent", "5-LOW": "low"},
                           order=("update_date", "o_orderkey"), carry="point")


@query("D15", """
SELECT o_orderkey, CAST(y AS INT) AS tax_yr FROM (
  SELECT o_orderkey, unnest(range(greatest(a, 1996), least(b, 2000) + 1)) AS y FROM (
    SELECT o_orderkey, CAST(year(o_orderdate) AS INT) AS a,
           CAST(year(o_orderdate) + o_orderkey % 4 - 1 AS INT) AS b FROM orders) WHERE b >= a)""")
def expand_interval(t: Tables):
    rows = t.orders.select("o_orderkey", F.year("o_orderdate").alias("a"),
                           (F.year("o_orderdate") + F.col("o_orderkey") % 4 - 1).cast("int").alias("b"))
    return j.expand_interval(rows, "a", "b", 1996, 2000).select("o_orderkey", "tax_yr")


@query("D16", """
WITH r AS (SELECT c_custkey AS parcel_id, c_nationkey || ' ' || c_custkey // 3 AS k1,
                  c_nationkey || ' ' || c_custkey // 40 AS k2 FROM customer),
l AS (SELECT o_orderkey, o_custkey % 25 || ' ' || o_custkey // 3 AS k1, o_custkey % 25 || ' ' || o_custkey // 40 AS k2 FROM orders),
m1 AS (SELECT k1, min(parcel_id) AS p FROM r GROUP BY 1 HAVING COUNT(DISTINCT parcel_id) = 1),
m2 AS (SELECT k2, min(parcel_id) AS p FROM r GROUP BY 1 HAVING COUNT(DISTINCT parcel_id) = 1)
SELECT o_orderkey, COALESCE(m1.p, m2.p) AS parcel_id,
       CAST(CASE WHEN m1.p IS NOT NULL THEN 1 WHEN m2.p IS NOT NULL THEN 2 END AS INT) AS match_pass
FROM l LEFT JOIN m1 ON m1.k1 = l.k1 LEFT JOIN m2 ON m2.k2 = l.k2""")
def two_pass_match(t: Tables):
    def keys(first, key):
        text = lambda c: c.cast("string")
        return [F.concat_ws(" ", text(first), text(F.floor(F.col(key) / n))).alias(k)
                for k, n in (("k1", 3), ("k2", 40))]
    right = t.customer.select(F.col("c_custkey").alias("parcel_id"),
                              *keys(F.col("c_nationkey"), "c_custkey"))
    left = t.orders.select("o_orderkey", *keys(F.col("o_custkey") % 25, "o_custkey"))
    return j.two_pass_match(left, right, ["k1", "k2"]).drop("k1", "k2")


@query("D17", f"""
WITH {PANEL_SQL}, d AS (SELECT tax_yr + 1 AS tax_yr, SUM(v) AS total, COUNT(*) AS n FROM panel GROUP BY 1)
SELECT parcel_id, p.tax_yr, CAST(p.v AS DOUBLE) AS v, CAST(total AS DOUBLE) AS mkt_total, n AS mkt_n
FROM panel p LEFT JOIN d ON d.tax_yr = p.tax_yr""")
def attach_drivers(t: Tables):
    p = panel(t)
    drivers = p.groupBy((F.col("tax_yr") + 1).alias("tax_yr")).agg(
        dbl(F.sum("v"), "mkt_total"), F.count(F.lit(1)).alias("mkt_n"))
    stale = p.select("parcel_id", "tax_yr", dbl("v", "v"), F.lit(0).alias("mkt_stale"))
    return j.attach_drivers(stale, drivers, prefix="mkt_")


@query("D19", f"""
WITH {PANEL_SQL} SELECT a.parcel_id, a.tax_yr, CAST(a.v AS DOUBLE) AS v, CAST(b.v AS DOUBLE) AS v_lag1,
       CAST(c.v AS DOUBLE) AS v_lag2
FROM panel a LEFT JOIN panel b ON b.parcel_id = a.parcel_id AND b.tax_yr = a.tax_yr - 1
LEFT JOIN panel c ON c.parcel_id = a.parcel_id AND c.tax_yr = a.tax_yr - 2""")
def lag_join(t: Tables):
    p = panel(t).select("parcel_id", "tax_yr", dbl("v", "v"))
    return j.lag_join(j.lag_join(p, p, "parcel_id", ["v"], 1), p, "parcel_id", ["v"], 2)


@query("D20", f"""
WITH {PANEL_SQL} SELECT a.parcel_id, a.tax_yr, CAST(a.v AS DOUBLE) AS av1, CAST(b.v AS DOUBLE) AS av0
FROM panel a JOIN panel b ON b.parcel_id = a.parcel_id AND b.tax_yr = a.tax_yr - 1 WHERE a.tax_yr >= 1998""")
def pair_years(t: Tables):
    pairs = j.pair_years(panel(t), "parcel_id", "tax_yr", "v", range(1998, 2002))
    return pairs.select("parcel_id", "tax_yr", dbl("av1", "av1"), dbl("av0", "av0"))


# -- sets --------------------------------------------------------------------

@query("G01", f"WITH {PANEL_SQL} SELECT parcel_id, tax_yr, CAST(v AS DOUBLE) AS v FROM panel")
def sorted_panel(t: Tables):
    return sets.sort(panel(t), "parcel_id", "tax_yr").select("parcel_id", "tax_yr", dbl("v", "v"))


@query("G02", """
SELECT c_custkey AS k, c_mktsegment AS segment, NULL::DOUBLE AS balance FROM customer
UNION ALL SELECT s_suppkey, NULL, s_acctbal FROM supplier""")
def stacked_tables(t: Tables):
    return sets.stack([t.customer.select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("segment")),
                       t.supplier.select(F.col("s_suppkey").alias("k"), F.col("s_acctbal").alias("balance"))])


@query("G03", """
SELECT c_mktsegment, COUNT(*) AS n, MIN(c_custkey) AS first_key FROM customer
WHERE c_mktsegment IS NOT NULL GROUP BY 1""")
def split_by_segment(t: Tables):
    names = [r[0] for r in t.customer.select("c_mktsegment").distinct().collect() if r[0] is not None]
    found = sets.split_by(t.customer, "c_mktsegment", sorted(names))
    return sets.stack([part.groupBy("c_mktsegment").agg(
        F.count(F.lit(1)).alias("n"), F.min("c_custkey").alias("first_key")) for part in found.values()])


@query("G04", "SELECT DISTINCT l_suppkey, l_returnflag, l_linestatus FROM lineitem")
def distinct_rows(t: Tables):
    return sets.distinct_rows(t.lineitem, ["l_suppkey", "l_returnflag", "l_linestatus"])


@query("G05", f"""
WITH {PANEL_SQL}, {GRID_SQL} SELECT parcel_id, tax_yr FROM grid
EXCEPT SELECT parcel_id, tax_yr FROM panel""")
def missing_keys(t: Tables):
    return sets.missing_keys(grid(t), panel(t), ["parcel_id", "tax_yr"])


@query("G06", """
WITH a AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderpriority = '1-URGENT'),
b AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderpriority = '5-LOW'),
n AS (SELECT (SELECT COUNT(*) FROM a) AS l, (SELECT COUNT(*) FROM b) AS r,
             (SELECT COUNT(*) FROM a JOIN b USING (k)) AS b)
SELECT l AS n_left, r AS n_right, b AS n_both, round(100.0 * b / l, 1)::DOUBLE AS pct_left FROM n""")
def key_overlap(t: Tables):
    side = lambda p: t.orders.filter(F.col("o_orderpriority") == p).select("o_custkey")
    return sets.overlap(side("1-URGENT"), side("5-LOW"), "o_custkey")


