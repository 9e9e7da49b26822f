"""Snapshots landed once: a table cut by snapshot_date and bucketed by uid, each uid once a snapshot, so that comparing two of them moves no row.

The table lies in the shared folder and is named in the session's catalogue, whose bucket specification spares both the shuffle of a join by uid and that of a
grouping by it. Rows are dealt by uid before they are written, so a bucket is one file for each day; equal uids collapse where they meet then, the last row
staying.
"""

from __future__ import annotations

import uuid
from datetime import date

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marquee.operators.reconcile import last_per_uid
from marquee.sources.scratch import shared_root

#: Tables and folders of this process by application and what they were made of.
_landed: dict[tuple[str, str], str] = {}


def parquet_once(spark: SparkSession, what: str, make, *partition: str) -> DataFrame:
    """The rows that make() gives, as Parquet cut by `partition`, if any: written once in an application for each `what`, and read from then on."""
    rows = make()
    key = (spark.sparkContext.applicationId, what)
    for _ in range(2):
        if key not in _landed:
            path = f"{shared_root(spark)}/landed-{uuid.uuid4().hex[:12]}"
            rows.write.partitionBy(*partition).parquet(path)
            _landed[key] = path
        try:
            return spark.read.schema(rows.schema).parquet(_landed[key]).select(*rows.columns)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            del _landed[key]  # the folder was cleared meanwhile
    raise FileNotFoundError(what)


def is_landed(spark: SparkSession, what: str) -> bool:
    """Whether parquet_once has written this in the application."""
    return (spark.sparkContext.applicationId, what) in _landed


def land(snapshots: dict[date, DataFrame], buckets: int | None = None, order: str = "row_no") -> str:
    """The name of a new table of these snapshots, whose rows have a uid; columns that one lacks are null there."""
    out = None
    for taken, rows in snapshots.items():
        own = rows.withColumn("snapshot_date", F.lit(taken))
        out = own if out is None else out.unionByName(own, allowMissingColumns=True)
    spark = out.sparkSession
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"listing_snapshots_{uuid.uuid4().hex[:12]}"
    dealt = out.repartition(n, "uid")
    dealt = last_per_uid(dealt, order, ["snapshot_date"])
    dealt.write.partitionBy("snapshot_date").bucketBy(n, "uid").sortBy("uid").option("path", f"{shared_root(spark)}/{name}").saveAsTable(name)
    return name


def landed_once(spark: SparkSession, what: str, make) -> str:
    """The table that was landed in this application for `what`, or a new one of the snapshots that make() gives."""
    key = (spark.sparkContext.applicationId, what)
    if key not in _landed or not spark.catalog.tableExists(_landed[key]):
        _landed[key] = land(make())
    return _landed[key]


def snapshot(spark: SparkSession, table: str, taken: date) -> DataFrame:
    """A snapshot's rows; only its files are read."""
    return spark.table(table).filter(F.col("snapshot_date") == F.lit(taken)).drop("snapshot_date")


def before(spark: SparkSession, table: str, day: date) -> DataFrame | None:
    """The last snapshot before a day, or None; the days are told by the folders."""
    last = spark.table(table).filter(F.col("snapshot_date") < F.lit(day)).agg(F.max("snapshot_date")).first()[0]
    return None if last is None else snapshot(spark, table, last)
