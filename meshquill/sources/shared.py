"""Steps of iterative operators, written to the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def checkpoint(df: DataFrame) -> DataFrame:
    """df with its lineage cut, in the folder named by spark.checkpoint.dir (one of our own only where that is unset)."""
    spark = df.sparkSession
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or "file://" + tempfile.mkdtemp(prefix="meshquill-"))
    return df.checkpoint()


def new_path(spark: SparkSession, name: str) -> str:
    """A place of its own in that folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or "file://" + tempfile.mkdtemp(prefix="meshquill-")
    return f"{folder.rstrip('/')}/meshquill/{name}-{uuid.uuid4().hex}"
