"""Compare a Spark result with the DuckDB result of the same query."""

from __future__ import annotations

import math
from decimal import Decimal

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()
TYPES = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR",
         "boolean": "BOOLEAN", "date": "DATE", "timestamp_ntz": "TIMESTAMP"}


def connect(sf_dir):
    import duckdb
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return (0, "")
    if isinstance(v, bool):
        return (1, str(v))
    if isinstance(v, (int, Decimal)):
        return (2, float(v))
    if isinstance(v, float):
        return (2, v)
    return (3, str(v))


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(_norm(r[i]) for i in order) for r in rows)


def differences(df, con, sql):
    """Texts that say how the two results differ; empty when they are equal."""
    rel = con.sql(sql)
    spark_types = {n: TYPES.get(t, t) for n, t in df.dtypes}
    duck_types = dict(zip(rel.columns, map(str, rel.types)))
    out = []
    if spark_types != duck_types:
        out.append(f"schema: {sorted(set(spark_types.items()) ^ set(duck_types.items()))}")
        if set(spark_types) != set(duck_types):
            return out
    a = rows_of(df.columns, [tuple(r) for r in df.collect()])
    b = rows_of(rel.columns, rel.fetchall())
    if len(a) != len(b):
        out.append(f"rows: {len(a)} against {len(b)}")
    elif a != b:
        bad = [(x, y) for x, y in zip(a, b) if x != y]
        out.append(f"values: {len(bad)} rows, first {bad[0]}")
    if not a:
        out.append("no rows")
    return out
