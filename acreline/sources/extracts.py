"""Extract files in, tables out.

Paths are shared storage: `shared_dir` takes the folder the cluster names in
`spark.checkpoint.dir`, so any executor can read what another one wrote.
"""

from __future__ import annotations

import tempfile
import uuid
from urllib.parse import unquote
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from acreline.functions.cleaning import slug_name
from acreline.sources.published import Storage


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in `spark.checkpoint.dir`.

    Only a local session, as in tests, gets a temporary one where none is set: on a
    cluster a machine-local folder would hold a part of each table on each machine.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="acreline-")
        spark.conf.set("spark.checkpoint.dir", folder)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def run_path(spark: SparkSession, name: str) -> str:
    """A path of its own below the shared folder; what is written there goes when the driver ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    Storage(spark, path).remove_at_exit(path)
    return path


def read_extract(spark: SparkSession, path: str, na: Sequence[str] = ("", "NA", " "),
                 encoding: str = "ISO-8859-1", columns: Sequence[str] | None = None) -> DataFrame:
    """Read a CSV extract as strings with snake_case names and NULL for NA tokens.

    Pass `columns` to give the header names and skip the read of the first line.
    """
    reader = spark.read.option("header", True).option("encoding", encoding)
    if columns:
        reader = reader.schema(", ".join(f"`{c}` string" for c in columns))
    raw = reader.csv(path)
    tokens = sorted({t.strip() for t in na})
    return raw.select(*[
        F.when(~F.trim(F.col(f"`{c}`")).isin(*tokens), F.col(f"`{c}`")).alias(slug_name(c))
        for c in raw.columns])


def select_with_aliases(df: DataFrame, spec: Mapping[str, Sequence[str]],
                        types: Mapping[str, str] | None = None) -> tuple[DataFrame, list[str]]:
    """Select each wanted column under the first candidate name that is present.

    Columns with no candidate are NULL of the declared type (string by default).
    Returns the frame and the names that were missing.
    """
    types = types or {}
    cols, missing = [], []
    for name, candidates in spec.items():
        found = next((c for c in candidates if c in df.columns), None)
        if found is None:
            missing.append(name)
            cols.append(F.lit(None).cast(types.get(name, "string")).alias(name))
        else:
            value = F.col(f"`{found}`")
            cols.append((value.try_cast(types[name]) if name in types else value).alias(name))
    return df.select(*cols), missing


def write_table(df: DataFrame, path: str, fmt: str = "parquet",
                partition_by: Sequence[str] = (), mode: str = "overwrite",
                dated: str | None = None) -> str:
    """Write CSV or Parquet and return the path; `dated` adds a date suffix.

    Partitioned writes are first hashed by the partition columns and split by
    size, so a partition is written by a few tasks and not by all of them.
    """
    if fmt not in ("csv", "parquet"):
        raise ValueError(f"unknown format {fmt!r}")
    path = f"{path}_{dated}" if dated else path
    if partition_by:
        df = df.hint("rebalance", *partition_by)
    writer = df.write.mode(mode).partitionBy(*partition_by)
    if fmt == "csv":
        writer.option("header", True).csv(path)
    else:
        writer.parquet(path)
    return path


def read_latest(spark: SparkSession, root: str, scenario: str | None = None,
                run_col: str = "run_id") -> DataFrame:
    """Newest run below `root`: of the scenario if it has runs, else of any.

    Runs are found by their partition folders; no row is read for that, and the result
    is pruned to the newest one.
    """
    table = spark.read.parquet(root)
    parts = _partitions(spark, root, [c for c in ("scenario", run_col) if c in table.columns])
    own = [p for p in parts if scenario is not None and p.get("scenario") == scenario]
    runs = [p[run_col] for p in own or parts if p.get(run_col) is not None]
    if not runs:
        return table.limit(0)
    # Partition values are compared as the table types them.
    kind = table.schema[run_col].dataType
    typed = spark.createDataFrame([(r,) for r in sorted(set(runs))], "r string").select(
        F.max(F.col("r").cast(kind))).first()[0]
    newest = table.filter(F.col(run_col) == F.lit(typed))
    return newest.filter(F.col("scenario") == scenario) if own else newest


def _partitions(spark: SparkSession, root: str, names: Sequence[str]) -> list[dict[str, str]]:
    """Partition values of a table's folders, level by level; no file is listed."""
    storage, open_, found = Storage(spark, root), [(root, {})], []
    while open_:
        path, keys = open_.pop()
        below = [n for n in storage.names(path) if "=" in n and not n.startswith(("_", "."))]
        if not below or set(names) <= set(keys):
            found.append({n: keys[n] for n in names if n in keys})
            continue
        open_ += [(f"{path}/{n}", keys | {n.split("=", 1)[0]: unquote(n.split("=", 1)[1])}) for n in below]
    return found
