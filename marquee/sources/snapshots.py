"""Versioned tables: snapshots by date with a row of facts each, rosters rewritten to a new version, never in place."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def take(rows: DataFrame, path: str, day: date) -> None:
    """Write the snapshot of a day and its (taken_at, n)."""
    rows.write.mode("overwrite").parquet(f"{path}/rows/snapshot_date={day}")
    rows.sparkSession.read.parquet(f"{path}/rows/snapshot_date={day}").agg(F.lit(str(day)).alias("taken_at"), F.count("*").alias("n")).write.mode("overwrite").parquet(f"{path}/meta/snapshot_date={day}")


def before(spark: SparkSession, path: str, day: date) -> DataFrame | None:
    """The last snapshot before a day, or None. Only its partition is read."""
    try:
        every = spark.read.parquet(f"{path}/rows")
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            return None
        raise
    last = spark.read.parquet(f"{path}/meta").filter(F.col("snapshot_date") < F.lit(str(day)).cast("date")).agg(F.max("snapshot_date")).first()[0]
    return None if last is None else every.filter(F.col("snapshot_date") == F.lit(last)).drop("snapshot_date")


def next_version(rows: DataFrame, path: str, version: int) -> str:
    """Write a table's next version beside the one that is being read."""
    to = f"{path}/v={version}"
    rows.write.mode("overwrite").parquet(to)
    return to
