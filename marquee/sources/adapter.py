"""The listing table: a catalogue of dated, located, multi-labelled rows, built from the order tables so that every
operator has real input that grows with them. Arrays are never null; a null scalar means unknown."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marquee.sources import landing

#: The clock of the registered queries: a calendar day, and an instant of the listing's own zone.
TODAY, NOW = date(1998, 6, 15), datetime(1998, 6, 15, 9, 0)
DEFAULT_TITLE = "(untitled)"
TABS = ("event", "movie", "live")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def named_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order's lines with the names of their part and supplier."""
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", F.to_date("l_shipdate").alias("day"), "l_extendedprice", "l_discount")
    parts = read(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type")
    suppliers = read(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    return lines.join(parts, F.col("l_partkey") == F.col("p_partkey"), "left").join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"), "left")


def line_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an order's lines say. The lines are dealt by order before they are aggregated: sets of one or two values each, made before a shuffle that they don't
    shrink, are larger than the lines."""
    price = F.col("l_extendedprice").cast("decimal(18,2)")
    lines = named_lines(spark, sf_dir).select("l_orderkey", "p_name", "p_type", "s_name", "day", "l_extendedprice", "l_discount").repartition("l_orderkey")
    return lines.groupBy("l_orderkey").agg(
        F.max("p_name").alias("title"), F.array_sort(F.collect_set("p_type")).alias("cats"), F.array_sort(F.collect_set("s_name")).alias("venues"), F.max("day").alias("last_day"),
        F.array_sort(F.collect_set("day")).alias("days"), F.floor(F.sum(price)).cast("long").alias("price_official"),
        F.floor(F.sum(price * (F.lit(1).cast("decimal(18,2)") - F.col("l_discount").cast("decimal(18,2)")))).cast("long").alias("price_best"),
    )


def head_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The facts behind HEADS: maxima and a minimum alone, the first venue being the list's only one."""
    found = named_lines(spark, sf_dir).groupBy("l_orderkey").agg(F.max("p_name").alias("title"), F.min("s_name").alias("first"), F.max("day").alias("last_day"))
    none = {"cats": "array<string>", "days": "array<date>", "price_official": "long", "price_best": "long"}
    return found.withColumns({"venues": F.array_compact(F.array("first")), **{c: F.lit(None).cast(kind) for c, kind in none.items()}}).drop("first")


def listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The listing table, landed once in a session and cut by tab: searches and counts read its columns, not six tables."""
    return landing.parquet_once(spark, f"listing {sf_dir}", lambda: derived_listing(spark, sf_dir, line_facts(spark, sf_dir)), "tab")


#: What comparing snapshots needs of a listing, besides its first venue.
HEADS = ("row_no", "id", "title", "area", "start_date", "end_date", "onsale_label", "limited_sale")


def heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """HEADS and `venues`, cut to the first one, of all listings: read from the landed table where there is one, else derived and landed without the lists
    and sums that make up most of it."""
    if landing.is_landed(spark, f"listing {sf_dir}"):
        return listing(spark, sf_dir).select(*HEADS, F.slice("venues", 1, 1).alias("venues"))
    return landing.parquet_once(spark, f"heads {sf_dir}", lambda: derived_listing(spark, sf_dir, head_facts(spark, sf_dir)).select(*HEADS, "venues"))


def derived_listing(spark: SparkSession, sf_dir: str, facts: DataFrame) -> DataFrame:
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate", "o_orderpriority")
    places = (
        read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey").join(read(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("c_custkey", F.col("n_name").alias("area"), F.col("r_name").alias("pref"))
    )
    k, day = F.col("o_orderkey"), F.to_date("o_orderdate")
    rows = orders.join(facts, k == F.col("l_orderkey"), "left").join(places, F.col("o_custkey") == F.col("c_custkey"), "left")
    strings, days = F.array().cast("array<string>"), F.array().cast("array<date>")
    end = F.when(k % 13 != 0, F.col("last_day"))
    known = k % 29 != 0
    return rows.select(
        k.alias("row_no"), k.alias("id"), F.element_at(F.array(*map(F.lit, TABS)), (k % 3 + 1).cast("int")).alias("tab"), F.coalesce("title", F.lit(DEFAULT_TITLE)).alias("title"),
        F.coalesce("cats", strings).alias("cats"), F.coalesce("venues", strings).alias("venues"), "area", "pref", F.when(k % 17 != 0, day).alias("start_date"), end.alias("end_date"),
        F.when(k % 3 == 0, F.coalesce("days", days)).otherwise(days).alias("dates"),
        F.when((k % 2 == 0) & end.isNotNull(), F.array(F.date_add(end, (k % 7 + 1).cast("int")))).otherwise(days).alias("backup_date"),
        F.when(k % 19 != 0, F.date_sub(day, (k % 60).cast("int"))).alias("announced_date"), (F.col("o_orderpriority") == "1-URGENT").alias("is_additional"),
        F.when(F.col("o_orderstatus") == "F", "完売").when(F.col("o_orderstatus") == "O", "advance").alias("onsale_label"), F.date_sub(day, 40).alias("onsale_start"),
        F.date_sub(day, (k % 30).cast("int")).alias("onsale_end"), F.when(k % 2 == 0, "10:00").alias("onsale_time"), F.when(k % 23 == 0, "extra").alias("limited_sale"),
        F.col("o_custkey").alias("series_id"), "price_official", "price_best",
        F.when(known, F.lit(34.5) + (F.col("o_custkey") % 300).cast("double") / 100).alias("lat"), F.when(known, F.lit(138.0) + (F.col("o_custkey") % 350).cast("double") / 100).alias("lng"),
    )


#: The same table in DuckDB's SQL.
LISTING_SQL = """
WITH line_facts AS (
  SELECT l_orderkey, max(p_name) AS title, list_sort(list(DISTINCT p_type) FILTER (p_type IS NOT NULL)) AS cats,
    list_sort(list(DISTINCT s_name) FILTER (s_name IS NOT NULL)) AS venues, max(CAST(l_shipdate AS DATE)) AS last_day,
    list_sort(list(DISTINCT CAST(l_shipdate AS DATE)) FILTER (l_shipdate IS NOT NULL)) AS days,
    CAST(floor(sum(CAST(l_extendedprice AS DECIMAL(18,2)))) AS BIGINT) AS price_official,
    CAST(floor(sum(CAST(l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l_discount AS DECIMAL(4,2))))) AS BIGINT) AS price_best
  FROM lineitem LEFT JOIN part ON l_partkey = p_partkey LEFT JOIN supplier ON l_suppkey = s_suppkey GROUP BY l_orderkey),
base AS (
  SELECT *, o_orderkey AS k, CAST(o_orderdate AS DATE) AS d, CASE WHEN o_orderkey % 13 <> 0 THEN last_day END AS e
  FROM orders LEFT JOIN line_facts ON o_orderkey = l_orderkey
  LEFT JOIN (SELECT c_custkey, n_name AS area, r_name AS pref FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey) ON o_custkey = c_custkey),
listing AS (
  SELECT k AS row_no, k AS id, ['event', 'movie', 'live'][k % 3 + 1] AS tab, coalesce(title, '(untitled)') AS title, coalesce(cats, []) AS cats, coalesce(venues, []) AS venues, area, pref,
    CASE WHEN k % 17 <> 0 THEN d END AS start_date, e AS end_date, CASE WHEN k % 3 = 0 THEN coalesce(days, []) ELSE [] END AS dates,
    CASE WHEN k % 2 = 0 AND e IS NOT NULL THEN [e + CAST(k % 7 + 1 AS INTEGER)] ELSE [] END AS backup_date,
    CASE WHEN k % 19 <> 0 THEN d - CAST(k % 60 AS INTEGER) END AS announced_date, o_orderpriority = '1-URGENT' AS is_additional,
    CASE o_orderstatus WHEN 'F' THEN '完売' WHEN 'O' THEN 'advance' END AS onsale_label, d - 40 AS onsale_start, d - CAST(k % 30 AS INTEGER) AS onsale_end,
    CASE WHEN k % 2 = 0 THEN '10:00' END AS onsale_time, CASE WHEN k % 23 = 0 THEN 'extra' END AS limited_sale, o_custkey AS series_id, price_official, price_best,
    CASE WHEN k % 29 <> 0 THEN 34.5 + CAST(o_custkey % 300 AS DOUBLE) / 100 END AS lat, CASE WHEN k % 29 <> 0 THEN 138.0 + CAST(o_custkey % 350 AS DOUBLE) / 100 END AS lng
  FROM base)
"""
