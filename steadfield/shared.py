"""The folder that the driver and all tasks share, and tables and files kept there."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

#: Set where the session names no shared folder and runs on one machine, as in tests.
LOCAL_DIR = "file:///tmp/checkpoints/steadfield-engine"


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir as an address. On one machine a folder is set where there is none; a cluster must name its own,
    as a machine's folder is not seen by the others."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = LOCAL_DIR
        spark.conf.set("spark.checkpoint.dir", root)
    if "://" not in root:
        root = "file://" + root.removeprefix("file:")
    return root.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def keep(df: DataFrame, name: str) -> DataFrame:
    """Written once and read back, for tables that several plans need."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
