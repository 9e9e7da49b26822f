"""The folder for tables between steps: that of spark.checkpoint.dir, which driver and executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def shared_root(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; only on one machine, where that is unset as in tests, a temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return tempfile.mkdtemp(prefix="spark-")


def saver(spark: SparkSession):
    """A function that writes a table there and reads it again."""
    if not spark.conf.get("spark.checkpoint.dir", None):
        spark.sparkContext.setCheckpointDir(shared_root(spark))
    return lambda df: df.checkpoint()
