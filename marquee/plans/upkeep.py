"""Registered queries that keep tables up: intake of batches, promotions as events, publications."""

from __future__ import annotations

import itertools
import uuid
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marquee.operators import favourites, quality
from marquee.plans.queries import PHASED_SQL, ROSTER_SQL, STATE_SQL, day, query, supplier_roster
from marquee.sources import export, publish, readers
from marquee.sources.adapter import TABS, TODAY, listing, read
from marquee.sources.scratch import saver, shared_root
from marquee.streaming import daily, intake, promotion

LAST_ID = 1000
POLICY = intake.Policy(("title", "venue", "kana", "lat", "note", "price"), ("kana", "lat"), ("lat",), ("price", "title"), "venue")

INTAKE_SQL = """WITH prev AS (SELECT lpad(CAST(c_custkey AS VARCHAR), 9, '0') AS uid, c_custkey AS row_no, c_mktsegment AS venue, 'K' || c_custkey AS kana, CASE WHEN c_custkey % 2 = 0 THEN CAST(c_custkey AS VARCHAR) END AS lat, CASE WHEN c_custkey % 3 > 0 THEN 'old ' || c_custkey END AS note FROM customer WHERE c_custkey % 4 <> 1),
b AS (SELECT c_custkey AS k, c_custkey % 3 AS batch, lpad(CAST(c_custkey AS VARCHAR), 9, '0') AS uid, c_name AS title, c_mktsegment AS venue, CASE WHEN c_custkey % 6 = 0 THEN 'given' END AS note, CASE c_custkey % 5 WHEN 0 THEN ['note'] WHEN 1 THEN ['note'] ELSE [] END AS carry, lpad(CAST(c_custkey - CAST(c_custkey % 7 = 0 AND c_custkey > 0 AS INTEGER) AS VARCHAR), 9, '0') AS wanted FROM customer),
f AS (SELECT venue, min_by(lat, row_no) AS lat FROM prev WHERE lat IS NOT NULL GROUP BY venue),
m AS (SELECT b.*, p.uid IS NOT NULL AS met, p.kana AS kana, p.lat AS p_lat, p.note AS p_note, f.lat AS f_lat FROM b LEFT JOIN prev p ON p.uid = b.wanted LEFT JOIN f ON f.venue = b.venue)"""


def intake_folder(spark: SparkSession, sf_dir: str) -> str:
    """Three batches of JSON lines, made from the customers, land one after the other and are taken by the same stream."""
    root = f"{shared_root(spark)}/intake-{uuid.uuid4().hex[:12]}"
    k = F.col("c_custkey")
    uid = lambda c: F.lpad(c.cast("string"), 9, "0")
    people = read(spark, sf_dir, "customer")
    previous = people.filter(k % 4 != 1).select(
        uid(k).alias("uid"), k.alias("row_no"), F.lit("old title").alias("title"), F.col("c_mktsegment").alias("venue"), F.concat(F.lit("K"), k.cast("string")).alias("kana"), F.when(k % 2 == 0, k.cast("string")).alias("lat"),
        F.when(k % 3 > 0, F.concat(F.lit("old "), k.cast("string"))).alias("note"), F.lit("5").alias("price"),
    )
    asked = F.when(k % 5 == 0, "note|price").when(k % 5 == 1, "*")
    line = F.to_json(F.struct(uid(k).alias("uid"), F.col("c_name").alias("title"), F.col("c_mktsegment").alias("venue"), F.when(k % 6 == 0, "given").alias("note"), asked.alias("_carry"), F.when((k % 7 == 0) & (k > 0), uid(k - 1)).alias("_carry_from"), F.when(k % 4 == 0, F.lit("?")).alias("odd")))
    for n in range(3):
        people.filter(k % 3 == n).select(line.alias("value")).write.text(f"{root}/in/{n}")
        intake.stream(spark, f"{root}/in/*", previous, f"{root}/out", f"{root}/progress", POLICY, lambda rows: F.col("fields")["uid"], LAST_ID).awaitTermination()
    return f"{root}/out"


@query(
    INTAKE_SQL + f""" SELECT {LAST_ID} + row_number() OVER (ORDER BY batch, uid) AS id, CAST(batch AS INTEGER) AS batch, uid, title, venue, kana, coalesce(p_lat, f_lat) AS lat, coalesce(note, CASE WHEN len(carry) > 0 THEN p_note END) AS note, CAST(NULL AS VARCHAR) AS price,
    concat_ws(',', CASE WHEN met THEN 'always:kana' END, CASE WHEN p_lat IS NOT NULL THEN 'always:lat' WHEN f_lat IS NOT NULL THEN 'place:lat' END, CASE WHEN note IS NULL AND len(carry) > 0 AND p_note IS NOT NULL THEN 'asked:note' END) AS filled FROM m""",
    base="",
)
def intake_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = intake.committed(spark, intake_folder(spark, sf_dir))
    return rows.select("id", "batch", "uid", *POLICY.columns, F.array_join("filled", ",").alias("filled"))


@query(
    INTAKE_SQL + """ SELECT 'misses' AS part, CAST(batch AS INTEGER) AS batch, uid || ' ' || wanted AS what, CAST(1 AS BIGINT) AS n FROM m WHERE len(carry) > 0 AND NOT met
    UNION ALL SELECT 'rejects', CAST(batch AS INTEGER), uid || ' price forbidden', 1 FROM m WHERE k % 5 = 0 UNION ALL SELECT 'fields', CAST(batch AS INTEGER), 'odd', count(*) FROM m WHERE k % 4 = 0 GROUP BY batch UNION ALL SELECT 'fields', CAST(batch AS INTEGER), 'uid', count(*) FROM m GROUP BY batch
    UNION ALL SELECT 'ranges', CAST(batch AS INTEGER), CAST(1001 + coalesce(sum(count(*)) OVER (ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS VARCHAR), count(*) FROM m GROUP BY batch""",
    base="",
)
def intake_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = intake_folder(spark, sf_dir)
    part = lambda name, what, n: intake.committed(spark, out, name).select(F.lit(name).alias("part"), "batch", what.alias("what"), n.cast("long").alias("n"))
    told = part("misses", F.concat_ws(" ", "uid", "wanted"), F.lit(1)).union(part("rejects", F.concat_ws(" ", "uid", "column", "reason"), F.lit(1)))
    return told.union(part("fields", F.col("field"), F.col("n"))).union(part("ranges", F.col("first_id").cast("string"), F.col("n")))


@query(
    ROSTER_SQL + """, h AS (SELECT l_suppkey AS k, count(DISTINCT (l_orderkey, CAST(l_shipdate AS DATE))) AS n, max(CAST(l_shipdate AS DATE)) AS d FROM lineitem GROUP BY l_suppkey), w AS (SELECT max(CAST(l_shipdate AS DATE)) - 7 AS mark FROM lineitem)
    SELECT name, 'active' AS event, coalesce(hit_count, 0) + n AS hit_count, CAST(greatest(last_hit, d) AS VARCHAR) AS last_hit FROM r JOIN h USING (k) WHERE status = 'candidate' AND coalesce(hit_count, 0) + n >= 2
    UNION ALL SELECT 'New ' || name, 'retired', coalesce(hit_count, 0), CAST(last_hit AS VARCHAR) FROM r, w WHERE status = 'candidate' AND last_hit + 61 <= mark""",
    base="",
)
def promotions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All lines as a stream of hits over two rosters; the places of the second one have none. An order's lines of one place and day are one hit."""
    own = supplier_roster(spark, sf_dir)
    both = own.union(own.withColumn("name", F.concat(F.lit("New "), "name")).select(*own.columns))
    lines = read(spark, sf_dir, "lineitem")
    seen = spark.readStream.schema(lines.schema).parquet(f"{sf_dir}/lineitem.parque[t]")
    name = F.concat(F.lit("SUPPLIER#"), F.lpad(F.col("l_suppkey").cast("string"), 9, "0"))
    hits = seen.select(F.concat_ws(":", "l_orderkey", "l_suppkey", F.to_date("l_shipdate")).alias("hit_id"), name.alias("name"), F.to_date("l_shipdate").alias("day"), F.col("l_shipdate").cast("timestamp").alias("seen_at"))
    root = f"{shared_root(spark)}/promotions-{uuid.uuid4().hex[:12]}"
    events = promotion.promotions(hits, both)
    events.writeStream.outputMode("append").format("parquet").option("path", f"{root}/events").option("checkpointLocation", f"{root}/progress").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(events.schema).parquet(f"{root}/events").select("name", "event", "hit_count", day("last_hit"))


@query(
    """, clean AS (SELECT * FROM listing WHERE row_no % 97 <> 0 AND NOT coalesce(end_date < start_date, false)) SELECT 'good' AS step, 'listing' AS "table", count(*) AS n, CAST(1 AS BIGINT) AS version FROM clean UNION ALL SELECT 'good', 'dispositions', count(*), 1 FROM clean WHERE row_no % 10 = 0
    UNION ALL SELECT 'refused', 'listing', count(*), 1 FROM clean UNION ALL SELECT 'refused', 'dispositions', count(*), 1 FROM clean WHERE row_no % 10 = 0
    UNION ALL SELECT 'next run', 'listing', 0, 2 UNION ALL SELECT 'next run', 'dispositions', 0, 2 UNION ALL SELECT 'next run', 'previous', count(*), 2 FROM clean"""
)
def publications(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is current after a good publication, after one that the rules refuse, and after a run has begun."""
    root = f"{shared_root(spark)}/published-{uuid.uuid4().hex[:12]}"
    rows = listing(spark, sf_dir).select("row_no", F.when(F.col("row_no") % 97 == 0, "1990-01-01").otherwise(F.col("end_date").cast("string")).alias("end_date"), F.when(F.col("row_no") % 97 == 0, "1990-01-02").otherwise(F.col("start_date").cast("string")).alias("start_date"))
    gate = lambda tables: quality.gate(quality.violations(tables["listing"], quality.raw_rules(tables["listing"].columns), "listing"))
    clean = rows.filter("row_no % 97 <> 0 and not coalesce(end_date < start_date, false)")
    seen = []

    def look(step: str) -> None:
        now = publish.manifest(spark, root)
        seen.extend((step, name, df, now["version"]) for name, df in publish.current(spark, root).items())

    publish.publish(spark, root, {"listing": clean, "dispositions": clean.filter("row_no % 10 = 0").select("row_no", F.lit("ended").alias("code"))}, gate)
    look("good")
    publish.publish(spark, root, {"listing": rows}, gate)
    look("refused")
    publish.next_run(spark, root, TODAY)
    look("next run")
    counts = [df.agg(F.count("*").alias("n")).select(F.lit(step).alias("step"), F.lit(name).alias("table"), "n", F.lit(version).cast("long").alias("version")) for step, name, df, version in seen]
    out = counts[0]
    for c in counts[1:]:
        out = out.union(c)
    return out


SET_COLUMNS = {"title": ("title", "txt"), "venues": ("venues", "list"), "start_date": ("start_date", "txt"), "lat": ("lat", "num")}


def set_files(spark: SparkSession, sf_dir: str) -> str:
    """The folder of the three sets as CSV files, each in the order of ids, every ninth title blank. Lines have their id, as a reader leaves blank ones out."""
    root = f"{shared_root(spark)}/sets-{uuid.uuid4().hex[:12]}"
    rows = listing(spark, sf_dir).select("id", "tab", F.when(F.col("id") % 9 != 0, F.col("title")).alias("title"), F.array_join("venues", "|").alias("venues"), day("start_date"), F.col("lat").cast("string").alias("lat"))
    for tab in TABS:
        own = rows.filter(F.col("tab") == tab).drop("tab").repartitionByRange("id").sortWithinPartitions("id")
        readers.write_listing(own.select("id", F.col("title").alias(" title "), "venues", "start_date", "lat"), f"{root}/{tab}", ["id", " title ", "venues", "start_date", "lat"])
    return root


@query(", f AS (SELECT *, row_number() OVER (PARTITION BY tab ORDER BY id) - 1 AS n FROM listing) SELECT tab, n AS row_no, tab || '-' || n AS \"key\", CASE WHEN id % 9 <> 0 THEN title ELSE '(' || tab || ')' END AS title, len(venues) AS venues, CAST(start_date AS VARCHAR) AS start_date, round(lat, 6) AS lat FROM f")
def loaded_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sets written as files, loaded and united again: rows are numbered as they stand in the files."""
    root, save = set_files(spark, sf_dir), saver(spark)
    sets = {tab: readers.load_set(spark, f"{root}/{tab}", SET_COLUMNS, save, tab, untitled=f"({tab})").drop("tab") for tab in TABS}
    return readers.all_sets(sets).select("tab", "row_no", "key", "title", F.size("venues").cast("long").alias("venues"), "start_date", F.round("lat", 6).alias("lat"))


@query("SELECT tab AS dataset, CASE tab WHEN 'movie' THEN '2026-07-01' WHEN 'live' THEN '2026-07-02' ELSE 'today' END AS updated, count(*) AS n FROM listing GROUP BY tab")
def set_freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When each set was updated: by the manifest where it names the set (a bare day as it is, an instant as the day in Japan), else by its files' times."""
    root = set_files(spark, sf_dir)
    manifest = spark.createDataFrame([("movie", "2026-07-01"), ("live", "2026-07-01T20:00:00Z")], "dataset string, value string")
    told = readers.freshness(readers.file_times(spark, {tab: f"{root}/{tab}" for tab in TABS}), manifest)
    recent = F.datediff(readers.japan_date(F.current_timestamp()), "updated").between(0, 1)
    counts = listing(spark, sf_dir).groupBy(F.col("tab").alias("dataset")).agg(F.count("*").alias("n"))
    return told.join(counts, "dataset").select("dataset", F.when(recent, "today").otherwise(F.col("updated").cast("string")).alias("updated"), "n")


@query(PHASED_SQL + f" SELECT row_no, phase, {STATE_SQL} AS state FROM phased")
def rolled_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The day's view after five weeks of going from day to day, some of them left out: only rows that came due were computed again."""
    rows, path = listing(spark, sf_dir), f"{shared_root(spark)}/daily-{uuid.uuid4().hex[:12]}"
    steps = [TODAY - timedelta(n) for n in (35, 21, 8, 1, 0)]
    daily.begin(rows, path, steps[0])
    for last, today in itertools.pairwise(steps):
        daily.advance(rows, path, last, today)
    return daily.current(spark, path, TODAY).select("row_no", "phase", "state")


@query(
    """WITH t AS (SELECT user_id, event_id % 500 AS uid, event_id, event_type, max(CASE WHEN event_type IN ('click', 'view') THEN event_id END) OVER (PARTITION BY user_id, event_id % 500) AS set_at FROM events),
    s AS (SELECT user_id, uid, coalesce(bool_or(event_id = set_at AND event_type = 'click'), false) AS stood, count(*) FILTER (event_type NOT IN ('click', 'view') AND (set_at IS NULL OR event_id >= set_at)) % 2 = 1 AS odd FROM t GROUP BY user_id, uid)
    SELECT user_id, uid FROM s WHERE stood <> odd""",
    base="",
)
def favourite_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Favourites from a log of changes, after two compactions and a tail: clicks add, views remove, all else toggles."""
    kind = F.when(F.col("event_type") == "click", "add").when(F.col("event_type") == "view", "remove").otherwise("toggle")
    log = read(spark, sf_dir, "events").select("user_id", (F.col("event_id") % 500).alias("uid"), F.col("event_id").alias("seq"), kind.alias("action"))
    root, last = f"{shared_root(spark)}/favourites-{uuid.uuid4().hex[:12]}", log.agg(F.max("seq")).first()[0] or 0
    for upto in (last // 3, last // 2):
        favourites.compact(spark, root, log, upto)
    return favourites.standing(spark, root, log)


@query(
    """, e AS (SELECT row_no, title, coalesce(start_date, end_date) AS a, coalesce(end_date, start_date) AS b FROM listing WHERE start_date IS NOT NULL OR end_date IS NOT NULL)
    SELECT line, count(*) AS n FROM (SELECT unnest(['BEGIN:VEVENT', 'UID:' || row_no, 'SUMMARY:' || replace(replace(title, ',', '\\,'), ';', '\\;'), 'DTSTART;VALUE=DATE:' || strftime(a, '%Y%m%d'), 'DTEND;VALUE=DATE:' || strftime(b + 1, '%Y%m%d'), 'END:VEVENT']) AS line FROM e) GROUP BY line"""
)
def calendar_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feed written to files, and their lines read back and counted."""
    root = f"{shared_root(spark)}/calendar-{uuid.uuid4().hex[:12]}"
    export.calendar_file(listing(spark, sf_dir).select(F.col("row_no").alias("uid"), "title", "start_date", "end_date"), root)
    return export.read_lines(spark, root).groupBy("line").agg(F.count("*").alias("n"))
