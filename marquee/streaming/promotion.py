"""Promotions as events: a stream of roster hits whose state says once when a candidate has hits enough, or has been idle too long.

A hit's id counts once within `repeats` of event time. The state of a place is its status, hit count and last hit, begun from the roster; names are those of
the roster's own norm. Hits come in any order: counts and the latest day don't depend on it, and what is late beyond the watermark is dropped by it. A
candidate that reaches the hits for promotion gives one event `active`; one whose last hit lies more than `idle_days` before the watermark gives one
event `retired`, and none after. Only the roster's candidates can give an event, so only they and their hits get a state; every hit moves the watermark. The
roster is that of the first run, as Spark takes begun states only then. A place's hits of a batch are added up before its state sees them.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import UTC, date, datetime

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from marquee.functions import exact
from marquee.operators.roster import CANDIDATE_DAYS, PROMOTE_HITS

EVENT = "name string, event string, hit_count long, last_hit date"
ADDED = "key string, hits long, day date"
STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",  # the one that keeps such state
    "spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows": "false",  # else each id is read before it is written or removed
}


def at(day: date, more: int = 0) -> int:
    """A day as milliseconds."""
    return int(datetime(day.year, day.month, day.day, tzinfo=UTC).timestamp() * 1000) + more * 86_400_000


class Promotion(StatefulProcessor):
    def __init__(self, promote: int, idle_days: int):
        self.promote, self.idle_days = promote, idle_days

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.place = handle.getValueState("place", "name string, status string, hit_count long, last_hit date, timer long")

    def keep(self, name: str, status: str | None, hits: int, last: date | None, timer: int | None) -> None:
        """Write the state; a candidate with a last hit is looked at again when it will have been idle too long."""
        new = at(last, self.idle_days + 1) if status == "candidate" and last else None
        if timer != new:
            if timer:
                self.handle.deleteTimer(timer)
            if new:
                self.handle.registerTimer(new)
        self.place.update((name, status, hits, last, new))

    def handleInitialState(self, key, initialState: Row, timerValues) -> None:  # noqa: N802, N803
        self.keep(initialState.name, initialState.status, initialState.hit_count or 0, initialState.last_hit, None)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        name, status, hits, last, timer = self.place.get() if self.place.exists() else (None, None, 0, None, None)
        for r in rows:
            hits += r.hits
            last = max(last, r.day) if last and r.day else last or r.day
        promoted = status == "candidate" and hits >= self.promote
        self.keep(name, "active" if promoted else status, hits, last, timer)
        if promoted:
            yield Row(name=name, event="active", hit_count=hits, last_hit=last)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        name, status, hits, last, _ = self.place.get()
        if status == "candidate":
            self.place.update((name, "retired", hits, last, None))
            yield Row(name=name, event="retired", hit_count=hits, last_hit=last)

    def close(self) -> None:
        pass


def added(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A place's hits of a batch as one row: how many there are, and the latest day."""
    n, last = 0, None
    for b in batches:
        n, day = n + b.num_rows, pc.max(b.column("day")).as_py()
        last = max(last, day) if last and day else last or day
    yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.string()), pa.array([n], pa.int64()), pa.array([last], pa.date32())], names=["key", "hits", "day"])


def promotions(hits: DataFrame, roster: DataFrame, repeats: str = "7 days", promote: int = PROMOTE_HITS, idle_days: int = CANDIDATE_DAYS) -> DataFrame:
    """The events of a stream `hits` (hit_id, name, day, seen_at timestamp) over a roster (name, status, hit_count, last_hit), a table with one row a name."""
    spark = hits.sparkSession
    for k, v in STATE_STORE.items():
        if spark.conf.get(k, None) != v:
            spark.conf.set(k, v)
    key = {"key": (F.col("name"), exact.ROSTER)}
    begun = exact.with_norms(roster.filter("status = 'candidate'"), key).select("key", "name", "status", F.col("hit_count").cast("long").alias("hit_count"), "last_hit")
    seen = exact.with_norms(hits.filter("name is not null"), key).select("hit_id", "key", "day", "seen_at").withWatermark("seen_at", repeats)
    once = seen.join(begun.select("key"), "key", "left_semi").dropDuplicatesWithinWatermark(["hit_id"])
    each = once.select("key", "day").groupBy("key").applyInArrow(added, ADDED)
    return each.groupBy("key").transformWithState(Promotion(promote, idle_days), EVENT, "Append", "EventTime", begun.groupBy("key"), "")
