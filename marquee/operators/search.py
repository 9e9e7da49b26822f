"""Counts and order of search results."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marquee.functions import geo, schedule
from marquee.plans.spec import FilterSpec, Flag, Search


def facet_counts(rows: DataFrame, search: Search) -> DataFrame:
    """(axis, value, n) under all conditions but the axis's own: one scan, each row giving one line for every axis whose other
    conditions it meets, then one grouped count. A declared key without rows shows 0."""
    axes = F.array(*[F.struct(F.lit(f.name).alias("axis"), f.values.alias("values"), search.all_but(lambda x, f=f: x is f).alias("met")) for f in search.facets])
    each = rows.select(F.explode(F.filter(axes, lambda a: a["met"] & (F.size(a["values"]) > 0))).alias("a")).select("a.axis", F.explode("a.values").alias("value"))
    counted = each.groupBy("axis", "value").agg(F.count("*").alias("n"))
    declared = [(f.name, key) for f in search.facets for key in f.order]
    if not declared:
        return counted
    keys = rows.sparkSession.createDataFrame(declared, "axis string, value string")
    return keys.join(counted, ["axis", "value"], "full_outer").select("axis", "value", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def flag_counts(rows: DataFrame, search: Search) -> DataFrame:
    """(flag, n): rows that meet the flag and all other conditions; one aggregation for all flags."""
    sums = [F.count_if(search.all_but(lambda x, f=f: x is f) & F.coalesce(f.test, F.lit(False))).alias(f.name) for f in search.flags]
    pairs = F.array(*[F.struct(F.lit(f.name).alias("flag"), F.col(f.name).alias("n")) for f in search.flags])
    return rows.agg(*sums).select(F.inline(pairs))


def venue_counts(rows: DataFrame, search: Search) -> DataFrame:
    return rows.filter(search.base()).select(F.explode("venues").alias("venue")).groupBy("venue").agg(F.count("*").alias("n"))


def result_size(rows: DataFrame, search: Search) -> DataFrame:
    """(total, shown, located_shown, unlocated): of all rows, of those that match, and of those without coordinates."""
    full = search.full()
    return rows.agg(F.count("*").alias("total"), F.count_if(full).alias("shown"), F.count_if(full & F.col("lat").isNotNull()).alias("located_shown"), F.count_if(full & F.col("lat").isNull()).alias("unlocated"))


def default_order(today: date, range_start: date | None = None) -> list[Column]:
    """Ended rows last, then effective date, rank, id, and the input's order."""
    return [schedule.has_ended(today).asc(), schedule.effective_date(today, range_start).asc(), schedule.rank(today).asc(), F.coalesce("id", F.lit(0)).asc(), F.col("row_no").asc()]


def order_of(spec: FilterSpec, today: date) -> list[Column]:
    fallback = default_order(today, spec.start)
    if spec.sort == "location" and spec.here:
        km = geo.haversine(F.lit(spec.here[0]), F.lit(spec.here[1]), F.col("lat"), F.col("lng"))
        return [km.asc_nulls_last(), F.col("row_no").asc()]
    return [F.desc_nulls_last("announced_date"), *fallback] if spec.sort == "announced" else fallback


def numbered(rows: DataFrame, order: list[Column], most: int) -> DataFrame:
    """The first `most` rows in order, numbered: a top-k, then a window over it alone."""
    return rows.orderBy(*order).limit(most).withColumn("place", F.row_number().over(Window.orderBy(*order)))


def placed(rows: DataFrame, order: list[Column], save) -> DataFrame:
    """All rows with their place in order. They are numbered within range partitions, of which the driver gets the sizes alone, so that no
    task numbers all rows. `order` should end in a unique column; `save` writes a table and reads it again."""
    parts = save(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    base, at = [], 0
    for r in parts.groupBy("_part").count().orderBy("_part").collect():
        base.append((r["_part"], at))
        at += r["count"]
    bases = F.broadcast(rows.sparkSession.createDataFrame(base or [(0, 0)], "_part int, _base long"))
    own = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return parts.withColumn("_own", own).join(bases, "_part").withColumn("place", F.col("_base") + F.col("_own")).drop("_part", "_own", "_base")


def present_keys(rows: DataFrame, values: Column, declared: list[str]) -> DataFrame:
    """(value, place): values that occur, in declared order, others after them by first sight."""
    seen = rows.select(F.explode(values).alias("value"), "row_no").groupBy("value").agg(F.min("row_no").alias("first"))
    place = F.coalesce(F.create_map(*[F.lit(x) for i, k in enumerate(declared) for x in (k, i)])[F.col("value")], F.lit(len(declared))) if declared else F.lit(0)
    return seen.select("value", place.alias("declared"), "first")


def venue_picker(counts: DataFrame, most: int = 60, part: str = "", kind: str | None = None) -> DataFrame:
    """(venue, n, place) of the most frequent venues, by name in Japanese collation where counts are equal (and by code points where that tells no difference); a top-k. With a
    `kind`, of venues of that kind alone, counts having a column of it."""
    some = counts.filter(F.lower("venue").contains(part.lower())) if part else counts
    some = some.filter(F.col("kind") == kind) if kind is not None else some
    order = [F.desc("n"), F.collate("venue", "ja").asc(), F.col("venue").asc()]
    return some.orderBy(*order).limit(most).withColumn("place", F.row_number().over(Window.orderBy(*order)))


def first_of(values: Column, most: int) -> tuple[Column, Column]:
    """(the first ones in one text, how many are left)."""
    return F.array_join(F.slice(values, 1, most), "・"), F.greatest(F.size(values) - most, F.lit(0))


def in_live_circle(rows: DataFrame, search: Search, lat: float, lng: float, km: float) -> DataFrame:
    """(n,): rows in a circle that is being drawn, under all conditions but those of place."""
    return rows.agg(F.count_if(search.base() & F.coalesce(geo.within(lat, lng, km), F.lit(False))).alias("n"))


def deals_flag() -> Flag:
    """The switch for rows with a stated discount or a coupon."""
    return Flag("dealsOnly", (F.coalesce(F.col("discount_pct"), F.lit(0)) != 0) | (F.coalesce(F.col("coupon_note"), F.lit("")) != ""))


def deals(official: Column, best: Column, coupon: Column) -> Column:
    """A discount or a coupon is known."""
    return F.coalesce(official > best, F.lit(False)) | coupon.isNotNull()
