"""Shared folder for written tables and stream checkpoints."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"
#: A table whose number of rows is known goes to one file at most for so many of them.
ROWS_A_FILE = 50_000


def scratch_root(spark: SparkSession) -> str:
    """The folder that the cluster names. Only a local session, whose tasks all see this machine's disk, gets its own."""
    root = spark.conf.get(SETTING, None)
    if not root:
        if not spark.sparkContext.master.partition("[")[0] == "local":
            raise ValueError(f"set {SETTING} to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="wardenlog-")
        spark.conf.set(SETTING, root)
    return root.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """Write a frame as a table and read it back: cuts the lineage and survives lost executors.

    `rows`: about how many there are, if that is known. Few rows then go to few files, whatever the number of shuffle
    partitions is; on a local disk each file also starts processes that set its permissions.
    """
    if rows is not None:
        df = df.coalesce(max(1, -(-rows // ROWS_A_FILE)))
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
