"""Incremental forms: batch intake, roster hits, and the daily rollover."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from marquee.operators import reconcile
from marquee.sources.scratch import shared_root

HIT = T.StructType([T.StructField("hit_id", T.StringType()), T.StructField("name", T.StringType()), T.StructField("day", T.DateType()), T.StructField("seen_at", T.TimestampType())])


def intake(
    spark: SparkSession, source: str, schema: T.StructType, previous: DataFrame, places: DataFrame, out: str, checkpoint: str, always: list[str], by_place: list[str], never: list[str]
) -> StreamingQuery:
    """JSON-lines batches land in `source`; each is filled from a fixed snapshot, and appended below `out/rows` with what it asked
    for in vain below `out/rejects`. Every batch has a folder of its own, so one that is run again replaces itself."""

    def one(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        known = [c for c in batch.columns if c not in ("request", "carry_from")]
        asked = F.filter(F.transform(F.split(F.coalesce("request", F.lit("")), "[|]"), lambda c: F.trim(c)), lambda c: c != "")
        allowed = [c for c in known if c not in never]
        carry = F.when(F.array_contains(asked, "*"), F.array(*map(F.lit, allowed))).otherwise(F.array_except(asked, F.array(*map(F.lit, never)) if never else F.array().cast("array<string>")))
        rows = reconcile.carry_forward(batch.withColumn("carry", carry), previous, places, always, by_place)
        rows.drop("carry").write.mode("overwrite").parquet(f"{out}/rows/batch={number}")
        reconcile.carry_rejects(batch.filter("request is not null"), never, known).write.mode("overwrite").parquet(f"{out}/rejects/batch={number}")
        batch.unpersist()

    return spark.readStream.schema(schema).json(source).writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def roster_hits(spark: SparkSession, source: str, checkpoint: str, sink: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """A running (name, n, last_day) of a hit log; a hit's id counts once within a week. Late hits can't move last_day back,
    and counts don't depend on order, so the watermark only bounds the memory of ids."""
    hits = spark.readStream.schema(HIT).json(source).withWatermark("seen_at", "7 days").dropDuplicatesWithinWatermark(["hit_id"])
    running = hits.groupBy("name").agg(F.count("*").alias("n"), F.max("day").alias("last_day"))
    return running.writeStream.outputMode("update").foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def rollover(rows: DataFrame, view: Callable[[DataFrame], DataFrame], out: str, day: str) -> None:
    """Write the view of a new day: nothing that depends on the day is stored with the rows."""
    view(rows).write.mode("overwrite").parquet(f"{out}/day={day}")


def counted_stream(spark: SparkSession, source: str, schema: T.StructType, place: Column, seen_at: Column) -> DataFrame:
    """Run all files of `source` through a streaming count by place and give its last state, (place, n, last_day)."""
    folder = f"{shared_root(spark)}/hits-{uuid.uuid4().hex[:12]}"
    rows = spark.readStream.schema(schema).parquet(source).select(place.alias("place"), F.to_date(seen_at).alias("day"))
    state = rows.groupBy("place").agg(F.count("*").alias("n"), F.max("day").alias("last_day"))
    keep = lambda df, number: df.write.mode("overwrite").parquet(f"{folder}/state/v={number}")
    state.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start().awaitTermination()
    every = spark.read.parquet(f"{folder}/state")
    return every.filter(F.col("v") == F.lit(every.agg(F.max("v")).first()[0])).drop("v")
