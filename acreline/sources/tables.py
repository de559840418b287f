"""Code tables and certified anchors as DataFrames."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from acreline.functions import codes
from acreline.operators.aggregates import share


def code_table(spark: SparkSession, mapping: Mapping, key: str = "code",
               value: str = "label") -> DataFrame:
    """One row per code. A value that is a list is turned round: each of its
    members becomes a code with the mapping's key as label."""
    rows = []
    for k, v in mapping.items():
        if isinstance(v, (tuple, list)):
            rows += [(member, k) for member in v]
        else:
            rows.append((k, v))
    kinds = {int: "int", float: "double", str: "string"}
    schema = f"{key} {kinds[type(rows[0][0])]}, {value} {kinds[type(rows[0][1])]}"
    return spark.createDataFrame(rows, schema)


def anchor_table(spark: SparkSession) -> DataFrame:
    """Certified total, personal property and real base by tax year.

    Years without a stated certified total take the exempt share of 2023.
    """
    rows = [(y, g, c, p) for y, g, c, p in codes.CERTIFIED]
    raw = spark.createDataFrame(
        rows, "tax_yr int, grand_total long, stated long, pp_av long")
    exempt = codes.EXEMPT_2023
    before = codes.CERTIFIED_BEFORE_EXEMPT_2023 + exempt
    total = (F.when(F.col("stated").isNotNull(), F.col("stated").cast("double"))
             .when(F.col("tax_yr") == 2023, (F.col("grand_total") - exempt).cast("double"))
             .otherwise(F.col("grand_total") * (1 - F.lit(exempt) / F.lit(before))))
    return (raw.withColumn("cert_total", total)
            .withColumn("cert_real", F.col("cert_total") - F.col("pp_av"))
            .drop("stated"))


def appraised_table(spark: SparkSession) -> DataFrame:
    """Appraised value and share by tax year and track."""
    raw = spark.createDataFrame(
        list(codes.APPRAISED_BILLIONS), "tax_yr int, track string, appraised_b double")
    return share(raw.withColumn("appraised_av", F.col("appraised_b") * 1e9),
                 "tax_yr", "appraised_av", small_groups=True)
