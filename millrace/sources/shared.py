"""Tables and folders that the driver and all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

_made: list[str] = []


def shared_dir(spark: SparkSession, prefix: str = "millrace") -> str:
    """A new folder below spark.checkpoint.dir, which every executor reaches.

    The setting is read from the session.  Only where the cluster names none and every task
    runs on this machine, as in tests, does the session get a folder under /tmp/checkpoints.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        context = spark.sparkContext
        found = context._jsc.sc().getCheckpointDir()
        if not found.isDefined() and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = found.get() if found.isDefined() else "file:///tmp/checkpoints"
    made = f"{base.rstrip('/')}/{prefix}-{uuid.uuid4().hex}"
    _made.append(made)
    return made


def written(spark: SparkSession, df: DataFrame, folder: str, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts the lineage and survives lost executors."""
    path = f"{folder}/{name}"
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, *paths: str) -> None:
    """Delete tables or folders that nothing reads any more."""
    for path in paths:
        found = spark._jvm.org.apache.hadoop.fs.Path(path)
        found.getFileSystem(spark._jsc.hadoopConfiguration()).delete(found, True)


def remove_shared(spark: SparkSession) -> int:
    """Delete the folders that this driver process has made by ``shared_dir``; returns their number.

    To be called once the results built on them are consumed: they are read from there.
    """
    n = len(_made)
    while _made:
        discard(spark, _made.pop())
    return n
