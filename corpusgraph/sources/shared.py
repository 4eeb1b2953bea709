"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


@functools.cache
def _own_dir(app_id: str) -> str:
    return tempfile.mkdtemp(prefix="spark-shared-")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder named in spark.checkpoint.dir; a local session that has none gets a temporary folder, any other an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not (spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = _own_dir(spark.sparkContext.applicationId)
    return f"{base}/{name}-{uuid.uuid4().hex}"


def write_table(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read back, so that what is used twice is computed once and a lost executor costs nothing before it."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
