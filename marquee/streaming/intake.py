"""Transactional intake: batches of JSON lines are filled from the snapshot before, numbered and appended, each of them once.

Every batch has folders of its own below `out`: rows, rejects, misses, fields and fills, and at last a row of the id-range log (ranges), which commits it. The
ids of a batch begin behind the ranges of the batches before it, and its rows are numbered in the order of their lines as text. So a batch that was
stopped anywhere and runs again writes the same rows under the same ids; one that is committed already is left alone. Readers see committed
batches alone.

A field that the set doesn't have is counted and left out. A line that is no JSON object goes to the rejects. Requests to carry what must not be carried, or
a column that doesn't exist, are rejected, and the row is taken without them; a request for a previous row that isn't there is a miss.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from marquee.operators import reconcile, search
from marquee.sources.scratch import saver

# What a line says besides its columns.
CARRY, CARRY_FROM = "_carry", "_carry_from"


@dataclass(frozen=True)
class Policy:
    """Columns that are filled whenever they are blank, facts of the place, and columns that are never carried."""

    columns: tuple[str, ...]
    always: tuple[str, ...] = ()
    by_place: tuple[str, ...] = ()
    never: tuple[str, ...] = ()
    place: str = "place"


def committed(spark: SparkSession, out: str, part: str = "rows") -> DataFrame | None:
    """All rows of a part of the committed batches, with their `batch`; None before the first one."""
    try:
        ranges = spark.read.parquet(f"{out}/ranges")
        rows = spark.read.parquet(f"{out}/{part}")
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise
    return rows.join(F.broadcast(ranges.select("batch")), "batch", "left_semi")


def parsed(lines: DataFrame, policy: Policy) -> DataFrame:
    """(file, line, fields, columns of the policy, carry, carry_from) of lines (file, line); fields is null for what is no JSON object."""
    fields = F.from_json("line", "map<string,string>", {"mode": "PERMISSIVE"})
    rows = lines.filter(F.trim("line") != "").withColumn("fields", F.when(F.trim("line").startswith("{"), fields))
    return rows.select("file", "line", "fields", *[F.col("fields")[c].alias(c) for c in policy.columns], F.col("fields")[CARRY].alias("request"), F.nullif(F.trim(F.col("fields")[CARRY_FROM]), F.lit("")).alias("carry_from"))


def requested(policy: Policy) -> Column:
    """The columns that a row asks for and may have."""
    asked = F.filter(F.transform(F.split(F.coalesce("request", F.lit("")), "[|]"), lambda c: F.trim(c)), lambda c: c != "")
    names = lambda cs: F.array(*map(F.lit, cs)) if cs else F.array().cast("array<string>")
    allowed = names([c for c in policy.columns if c not in policy.never and c not in policy.always])
    return F.when(F.array_contains(asked, "*"), allowed).otherwise(F.array_intersect(F.array_except(asked, names(policy.never)), names(policy.columns)))


def take(spark: SparkSession, lines: DataFrame, number: int, previous: DataFrame, out: str, policy: Policy, uid: Callable[[DataFrame], Column], last_id: int = 0, stop: Callable[[str], None] = lambda _: None) -> None:
    """Take batch `number` of lines (file, line). `previous` has (uid, row_no, columns of the policy); `uid` says what a row's is. `stop` is told of each step
    that is done."""
    try:
        ranges = spark.read.parquet(f"{out}/ranges").collect()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        ranges = []
    if any(r.batch == number for r in ranges):
        return
    base = max([last_id, *[r.last_id for r in ranges if r.batch < number]])
    save = saver(spark)
    batch = save(parsed(lines, policy))
    good = batch.filter("fields is not null")
    good = good.withColumn("uid", uid(good)).withColumn("carry", requested(policy)).withColumn("place", F.nullif(F.trim(F.col(policy.place)), F.lit("")))
    before = committed(spark, out)
    facts = [*policy.by_place]
    current = previous.select(F.col(policy.place).alias("place"), "row_no", *facts).limit(0) if before is None else before.filter(F.col("batch") < number).select(F.col(policy.place).alias("place"), F.col("id").alias("row_no"), *facts)
    places = reconcile.place_facts(previous.select(F.col(policy.place).alias("place"), "row_no", *facts), current, facts)
    filled = reconcile.carry_forward(good, previous.select("uid", *[c for c in policy.columns if c != "place"]), places, [*policy.always], facts)
    placed = search.placed(filled.withColumnRenamed("place", "own_place"), [F.col("line").asc(), F.col("file").asc()], save)
    rows = save(placed.select((F.lit(base) + F.col("place")).alias("id"), "uid", *[F.col("own_place" if c == "place" else c).alias(c) for c in policy.columns], "filled"))
    write = lambda df, part: (df.write.mode("overwrite").parquet(f"{out}/{part}/batch={number}"), stop(part))
    write(rows, "rows")
    bad = batch.filter("fields is null").select(F.lit(None).cast("string").alias("uid"), F.col("line").alias("column"), F.lit("no object").alias("reason"))
    write(reconcile.carry_rejects(good.filter("request is not null"), [*policy.never], [*policy.columns]).select("uid", "column", "reason").union(bad), "rejects")
    write(reconcile.carry_misses(good, previous), "misses")
    write(reconcile.unknown_fields(good, "fields", [*policy.columns]), "fields")
    write(reconcile.fill_statistics(rows), "fills")
    n = rows.count()
    write(spark.createDataFrame([(base + 1, base + n, n)], "first_id long, last_id long, n long").coalesce(1), "ranges")


def stream(spark: SparkSession, source: str, previous: DataFrame, out: str, checkpoint: str, policy: Policy, uid: Callable[[DataFrame], Column], last_id: int = 0, stop: Callable[[str], None] = lambda _: None) -> StreamingQuery:
    """Take what lies in `source`, a folder or a pattern of folders, and hasn't been taken."""
    lines = spark.readStream.text(source).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("line"))

    def one(batch: DataFrame, number: int) -> None:
        take(spark, batch, number, previous, out, policy, uid, last_id, stop)

    return lines.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
