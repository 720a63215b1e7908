"""Frames stored once in the folder that all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL_DEFAULT = "/tmp/checkpoints"
_made: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Only on one machine (tests), and only where that is unset, a folder under /tmp serves.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found is None and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return (found or f"file://{_LOCAL_DEFAULT}").rstrip("/")


def store(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet and read back: its rows stay as they are, whatever executor is lost."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _made.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Deletes what operators have stored for this session; frames that come from it can no longer be read."""
    for owner, path in _made:
        if owner is spark:
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    _made[:] = [m for m in _made if m[0] is not spark]
