"""Where jobs keep shared intermediate files."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def match(rows: DataFrame, other: DataFrame, by: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on equal columns, where null equals null; no row is lost because its key is null."""
    theirs = {key: f"_on_{key}" for key in by}
    same = [F.col(key).eqNullSafe(F.col(f"_on_{key}")) for key in by]
    out = rows.join(other.withColumnsRenamed(theirs), reduce(lambda a, b: a & b, same), how)
    return out.drop(*theirs.values())


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: the session's `spark.checkpoint.dir`.

    Only a local session without that setting gets a temporary folder of its own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    folder = tempfile.mkdtemp(prefix="gridseries-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def new_folder(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that no earlier run has used."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str = "stage", partition_by: Sequence[str] = ()) -> DataFrame:
    """Write a stage to the shared folder and read it back.

    Cuts the lineage: later stages that read the data several times do not
    repeat the work, a lost executor costs only the files it was reading, and
    column pruning still reaches the scan. With `partition_by`, later filters on
    those columns skip files.
    """
    folder = new_folder(df.sparkSession, name)
    if partition_by:
        df.hint("rebalance", *partition_by).write.partitionBy(*partition_by).parquet(folder)
    else:
        df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)
