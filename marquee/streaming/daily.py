"""The view of each day from the day before: rows are computed again only when something about them changes.

What depends on the day (phase, status, rank, sale state, newness, next open day) can only change on days that the row itself names: its first, last, listed and backup
days, the days after them, the day from which it is soon, and the edges of its sale and of its newness. A record says from which day it holds (asof) and which is the
next such day (next_change): it holds on every day from the one until before the other. So a day's view is a filter, and the next day's work is what comes due:
both read the folders of the months in question alone. A day that is run again replaces itself; days may be left out. Rows that change otherwise belong to a new
snapshot, which begins anew.
"""

from __future__ import annotations

from datetime import date, datetime, time, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marquee.functions import sale, schedule

NEVER = date(9999, 12, 31)
#: When in the day sales are looked at.
HOUR = time(9, 0)


def turns() -> Column:
    """All days on which something about a row may change."""
    day, nothing = F.col, F.array().cast("array<date>")
    plus = lambda c, n: F.date_add(c, n)
    first = F.coalesce(F.get("dates", F.lit(0)), day("start_date"))
    listed = F.concat(F.coalesce("dates", nothing), F.coalesce("backup_date", nothing), F.array_compact(F.array("start_date", "end_date", "onsale_start", "onsale_end")))
    others = F.array_compact(F.array(plus(first, -schedule.SOON_DAYS), day("announced_date"), plus(day("announced_date"), 8)))
    return F.concat(listed, F.transform(listed, lambda d: F.date_add(d, 1)), others)


def view(rows: DataFrame, today: date) -> DataFrame:
    """(row_no, what depends on the day, next_change)."""
    now = datetime.combine(today, HOUR)
    after = F.array_min(F.filter(turns(), lambda d: d > F.lit(today)))
    return rows.select(
        "row_no", schedule.phase(today).alias("phase"), schedule.status(today).alias("status"), schedule.rank(today).alias("rank"), sale.state(now).alias("state"), F.coalesce(schedule.newly_announced(today), F.lit(False)).alias("fresh"),
        schedule.next_open_day(today).alias("next_open"), F.coalesce(after, F.lit(NEVER)).alias("next_change"),
    )


def _write(told: DataFrame, path: str, today: date) -> None:
    told.withColumn("due_month", F.date_format("next_change", "yyyyMM").cast("int")).write.partitionBy("due_month").mode("overwrite").parquet(f"{path}/asof={today}")


def begin(rows: DataFrame, path: str, today: date) -> None:
    """Compute all rows."""
    _write(view(rows, today), path, today)


def due(spark: SparkSession, path: str, last: date, today: date) -> DataFrame:
    """Row numbers whose record held on `last` and doesn't hold on `today`."""
    month = lambda d: d.year * 100 + d.month
    inside = F.col("due_month").between(month(last), month(today)) & (F.col("next_change") > F.lit(last)) & (F.col("next_change") <= F.lit(today))
    return spark.read.parquet(path).filter((F.col("asof") <= F.lit(last)) & inside).select("row_no")


def advance(rows: DataFrame, path: str, last: date, today: date) -> None:
    """Go from the view of `last` to that of `today`."""
    spark = rows.sparkSession
    _write(view(rows.join(due(spark, path, last, today), "row_no", "left_semi"), today), path, today)


def current(spark: SparkSession, path: str, today: date) -> DataFrame:
    """The view of a day up to which the records go."""
    month = today.year * 100 + today.month
    return spark.read.parquet(path).filter((F.col("asof") <= F.lit(today)) & (F.col("due_month") >= month) & (F.col("next_change") > F.lit(today))).drop("asof", "due_month")


def days(first: date, last: date, step: int = 1) -> list[date]:
    return [first + timedelta(n) for n in range(0, (last - first).days + 1, step)]
