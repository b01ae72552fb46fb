"""Intermediates in the folder that the driver and all executors share."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Only for sessions on one machine that name no shared folder (tests).
LOCAL_SHARED = "file:///tmp/checkpoints/lodestar"
#: Rows of a file of a table of few columns whose number of rows is known beforehand.
FILE_ROWS = 100_000


def shared_dir(spark: SparkSession) -> str:
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return LOCAL_SHARED


def gathered(df: DataFrame, rows: int) -> DataFrame:
    """df, of about so many rows at most, in parts of FILE_ROWS if these are fewer than the shuffle partitions.

    Else a small table becomes a file for each partition, and each file costs a writer's buffers and, in a local folder
    without Hadoop's native library, three processes started by the executor.
    """
    files = max(1, math.ceil(rows / FILE_ROWS))
    return df.repartition(files) if files < int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def written(df: DataFrame, label: str, rows: int | None = None) -> DataFrame:
    """df as a Parquet table in the shared folder: the lineage ends there and survives lost executors. rows: see gathered()."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lodestar-{label}-{uuid.uuid4().hex}"
    (df if rows is None else gathered(df, rows)).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
