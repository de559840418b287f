"""Query registry: each query binds an operator to the given tables.

A query is a function of `Tables`. Next to it stands the SQL that states the same
result, where SQL can. Helper frames and the SQL text of the same rows are defined
side by side so that both sides read whole tables.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class Tables:
    """The given tables of one directory, read on access."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        # Kept on the instance, so a table's schema is looked up once per query.
        table = self.spark.read.parquet(f"{self.path}/{name}.parquet")
        setattr(self, name, table)
        return table


    @cached_property
    def years(self) -> range:
        """The years of the orders, from the first to the last."""
        lo, hi = self.orders.agg(F.min(F.year("o_orderdate")), F.max(F.year("o_orderdate"))).first()
        return range(lo, hi + 1)


@dataclass(frozen=True)
class Query:
    name: str
    operators: tuple[str, ...]
    build: Callable[[Tables], DataFrame]
    sql: str | None

    def __call__(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return self.build(Tables(spark, sf_dir))


REGISTRY: dict[str, Query] = {}


def query(operators: str, sql: str | None = None):
    """Register a function under its own name for the listed operator ids."""
    def register(build: Callable[[Tables], DataFrame]):
        name = build.__name__
        if name in REGISTRY:
            raise ValueError(f"query {name} is registered twice")
        REGISTRY[name] = Query(name, tuple(operators.split()), build, sql)
        return build
    return register


# -- shared rows -------------------------------------------------------------

def money(c: str) -> Column:
    """Exact cents, so that sums do not depend on their order."""
    return F.col(c).cast("decimal(18,2)")


def year_of(c: str) -> Column:
    return F.year(c)


def dbl(c: str | Column, name: str, digits: int | None = None) -> Column:
    value = (F.col(c) if isinstance(c, str) else c).cast("double")
    return (value if digits is None else F.round(value, digits)).alias(name)


PANEL_SQL = """panel AS (
  SELECT o_custkey AS parcel_id, CAST(year(o_orderdate) AS INT) AS tax_yr,
         SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS v
  FROM orders GROUP BY 1, 2)"""


def panel(t: Tables) -> DataFrame:
    """Customer-year values: one row per customer and year with orders."""
    return t.orders.groupBy(F.col("o_custkey").alias("parcel_id"),
                            F.year("o_orderdate").alias("tax_yr")).agg(
        F.sum(money("o_totalprice")).alias("v"))


PARTS_SQL = """parts AS (
  SELECT parcel_id, tax_yr,
         SUM(CASE WHEN l_returnflag = 'A' THEN x END) AS appr_land_val,
         SUM(CASE WHEN l_returnflag <> 'A' THEN x END) AS appr_imps_val
  FROM (SELECT o_custkey AS parcel_id, CAST(year(o_orderdate) AS INT) AS tax_yr,
               l_returnflag, CAST(l_extendedprice AS DECIMAL(18,2)) AS x
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
  GROUP BY 1, 2)"""


def parts(t: Tables) -> DataFrame:
    """Customer-year land and improvements: sums by return flag.

    Lines are summed per order before they meet the orders.
    """
    flag = F.col("l_returnflag")
    per_order = t.lineitem.groupBy("l_orderkey").agg(
        F.sum(F.when(flag == "A", money("l_extendedprice"))).alias("land"),
        F.sum(F.when(flag != "A", money("l_extendedprice"))).alias("imps"))
    return (t.orders.join(per_order, F.col("o_orderkey") == F.col("l_orderkey"))
            .groupBy(F.col("o_custkey").alias("parcel_id"),
                     F.year("o_orderdate").alias("tax_yr"))
            .agg(F.sum("land").alias("appr_land_val"), F.sum("imps").alias("appr_imps_val")))


YEARS_SQL = """(SELECT CAST(unnest(range(MIN(year(o_orderdate)), MAX(year(o_orderdate)) + 1)) AS INT) AS y FROM orders)"""

GRID_SQL = f"""grid AS (
  SELECT k.parcel_id, CAST(y.y AS INT) AS tax_yr, p.v
  FROM (SELECT DISTINCT o_custkey AS parcel_id FROM orders) k
  CROSS JOIN {YEARS_SQL} y
  LEFT JOIN panel p ON p.parcel_id = k.parcel_id AND p.tax_yr = y.y)"""


def grid(t: Tables) -> DataFrame:
    """Every customer in every year; value NULL in years without orders."""
    from acreline.operators.joins import cross_grid
    keys = t.orders.select(F.col("o_custkey").alias("parcel_id"))
    return cross_grid(keys, "parcel_id", t.years[0], t.years[-1]).join(
        panel(t), ["parcel_id", "tax_yr"], "left")


# -- SQL text helpers --------------------------------------------------------

def sql_list(values) -> str:
    return ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in values)


def sql_codes(c: str, table: dict, default: str = "NULL") -> str:
    whens = " ".join(f"WHEN {c} = {sql_list([k])} THEN '{v}'" for k, v in table.items())
    return f"CASE {whens} ELSE {default} END"


def sql_ranges(c: str, ranges, default: str = "NULL") -> str:
    def inside(lo, hi):
        parts_ = ([f"{c} >= {lo}"] if lo is not None else []) + (
            [f"{c} < {hi}"] if hi is not None else [])
        return " AND ".join(parts_)
    whens = " ".join(f"WHEN {inside(lo, hi)} THEN '{v}'" for lo, hi, v in ranges)
    return f"CASE {whens} ELSE {default} END"


def sql_groups(c: str, groups) -> str:
    """CASE over (members, label) pairs or a {label: members} table."""
    pairs = groups.items() if isinstance(groups, dict) else [(v, k) for k, v in groups]
    return " ".join(f"WHEN {c} IN ({sql_list(m)}) THEN '{label}'" for label, m in pairs)
