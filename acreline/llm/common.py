"""Small helpers that several operators share."""

from __future__ import annotations

import ctypes
from collections.abc import Sequence
from contextlib import suppress

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from acreline.sources.extracts import shared_dir

#: A word is a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


#: Whether a query's shuffle files go at its end; else they stay until the driver's next large garbage collection.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame) -> DataFrame:
    """Compute once and cut the lineage: a checkpoint in the cluster's shared folder.

    Nothing reads the shuffle files of what is checkpointed, so they go at once.
    """
    conf = df.sparkSession.conf
    shared_dir(df.sparkSession)
    before = conf.get(_CLEANUP, "false")
    conf.set(_CLEANUP, "true")
    try:
        return df.select("*").checkpoint(eager=True)  # a query of its own, planned under the setting
    finally:
        conf.set(_CLEANUP, before)


def give_back() -> None:
    """Return to the system what this Python worker has freed, of Arrow's pool and of malloc's heap.

    Workers are reused, so what a task leaves in them adds to the memory of the executor's later tasks.
    """
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL(None).malloc_trim(0)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def chunk_of(spark: SparkSession, *by: str) -> Column:
    """A pseudo-random chunk number; four chunks for each shuffle partition."""
    return F.pmod(F.xxhash64(*by), F.lit(4 * shuffle_partitions(spark))).cast("int")


def null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> Column:
    match = F.lit(True)
    for k in keys:
        match = match & left[k].eqNullSafe(right[f"_r_{k}"])
    return match


def exclusive_sum(df: DataFrame, keys: Sequence[str], chunk: Column, order: Sequence[str],
                  amount: str | Column, out: str, few: bool = False) -> DataFrame:
    """Add `out`: the sum of `amount` over the rows before this one in its group.

    Rows of a group are ordered by (chunk, order). Only rows of one chunk meet in a
    task, so a group may hold any share of all rows: the chunks' totals are summed up
    per group and joined back. With amount 1 this is a rank from 0. Rows equal in
    every column of `order` stand in any order. With `few` groups the totals go to every
    task, so that wide rows are shuffled once.
    """
    amount = F.col(amount) if isinstance(amount, str) else amount
    rows = df.withColumns({"_chunk": chunk, "_amount": amount.cast("long")})
    before = (Window.unboundedPreceding, -1)
    totals = rows.groupBy(*keys, "_chunk").agg(F.sum("_amount").alias("_total"))
    carry = totals.select(
        *[F.col(k).alias(f"_r_{k}") for k in keys], F.col("_chunk").alias("_r__chunk"),
        F.coalesce(F.sum("_total").over(
            Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(*before)),
            F.lit(0)).alias("_carry"))
    here = F.coalesce(F.sum("_amount").over(
        Window.partitionBy(*keys, "_chunk").orderBy(*order).rowsBetween(*before)), F.lit(0))
    local = rows.withColumn("_here", here)
    return (local.join(F.broadcast(carry) if few else carry, null_safe(local, carry, [*keys, "_chunk"]))
            .select(*[local[c] for c in df.columns],
                    (F.col("_carry") + F.col("_here")).alias(out)))
