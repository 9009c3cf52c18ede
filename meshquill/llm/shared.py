"""Tables written between the steps of an operator, in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; only where that is unset, one of our own (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        app = spark.sparkContext.applicationId
        if app not in _own:
            _own[app] = "file://" + tempfile.mkdtemp(prefix="meshquill-")
        named = _own[app]
    return named.rstrip("/")


def folder(spark: SparkSession) -> str:
    """This application's part of it."""
    return f"{shared_dir(spark)}/meshquill/{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{folder(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df once and read it back: cuts the lineage, survives lost executors."""
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clean(spark: SparkSession) -> None:
    """Delete the tables written on the way, of all operators of this application. For callers, once their results
    are written: a DataFrame that an operator returned still reads them, so no operator can do it itself."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def bound_batches(spark: SparkSession, most: int = 16 << 20) -> None:
    """Arrow batches by bytes, as texts differ: a Python worker holds a few of these. Never raises a setting."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = str(spark.conf.get(name, "64m")).lower().rstrip("b")
    size = int(now[:-1]) << {"k": 10, "m": 20, "g": 30}[now[-1]] if now[-1] in "kmg" else int(now)
    if size <= 0 or size > most:
        spark.conf.set(name, str(most))


def text_rows(docs: DataFrame, id_col: str, text_col: str, *more) -> DataFrame:
    """Only what an operator needs, under names that can't clash with the caller's columns."""
    bound_batches(docs.sparkSession)
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("__id"), F.col(f"`{text_col}`").cast("string").alias("__text"), *more)
