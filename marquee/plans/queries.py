"""The registered queries of the listing operators, each with its SQL over the same tables."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marquee.functions import exact, geo, sale, schedule, text
from marquee.operators import percolate, places, quality, reconcile, roster, search
from marquee.plans.spec import FilterSpec, Search, default_facets, default_flags, in_range
from marquee.sources import landing
from marquee.sources.adapter import LISTING_SQL, NOW, TABS, TODAY, heads, listing, read
from marquee.sources.scratch import saver
from marquee.streaming import jobs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
T = "DATE '1998-06-15'"


def query(sql: str | None, base: str = LISTING_SQL):
    """Register a query, and its SQL (a SELECT, or further CTEs and a SELECT, over `listing`)."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            body = sql.strip()
            ORACLE[f.__name__] = f"{base.rstrip()}{body if body.startswith(',') else chr(10) + body}" if base else body
        return f

    return add


def day(c: str):
    return F.col(c).cast("string").alias(c)


# --- derived state ---

PHASE_SQL = f"""CASE WHEN s IS NULL AND e IS NULL THEN NULL WHEN list_contains(backup_date, {T}) THEN 'backup' WHEN e < {T} THEN 'ended'
  WHEN s > {T} THEN CASE WHEN s - {T} <= 14 THEN 'soon' ELSE 'far' END WHEN e IS NULL THEN 'openrun' WHEN len(dates) > 0 AND NOT list_contains(dates, {T}) THEN 'gap'
  WHEN e = {T} THEN 'last' WHEN s = {T} THEN 'opening' ELSE 'ongoing' END"""
PHASED_SQL = f""", run AS (SELECT *, CASE WHEN len(dates) > 0 THEN dates[1] ELSE start_date END AS s, CASE WHEN len(dates) > 0 THEN dates[-1] ELSE end_date END AS e FROM listing),
phased AS (SELECT *, {PHASE_SQL} AS phase FROM run)"""


def _pairs(table: dict[str, dict[str, str]]) -> str:
    return ", ".join(f"('{tab}', '{k}', '{v}')" for tab, own in table.items() for k, v in own.items())


STATUS_SQL = PHASED_SQL + f""", labels(t, p, status) AS (VALUES {_pairs(schedule.STATUS_BY_PHASE)}),
ranks(t, status, rank) AS (VALUES {", ".join(f"('{tab}', '{x}', {i})" for tab, xs in schedule.STATUS_ORDER.items() for i, x in enumerate(xs))}),
stated AS (SELECT phased.*, labels.status, coalesce(ranks.rank, {schedule.RANK_FALLBACK}) AS rank FROM phased LEFT JOIN labels ON t = tab AND p = phase LEFT JOIN ranks ON ranks.t = tab AND ranks.status = labels.status)"""
ENDED_SQL = f"coalesce(end_date < {T}, false) AND len(list_filter(backup_date, lambda d: d >= {T})) = 0"
EFFECTIVE_SQL = f"CASE WHEN start_date IS NOT NULL THEN greatest(start_date, {T}) WHEN end_date IS NOT NULL THEN least(end_date, {T}) ELSE {T} END"
ORDERED_SQL = STATUS_SQL + f", ordered AS (SELECT *, {ENDED_SQL} AS ended, {EFFECTIVE_SQL} AS eff FROM stated)"
STATE_SQL = """CASE WHEN onsale_label = '完売' THEN 'closed' WHEN onsale_end + CAST(coalesce(onsale_time, '23:59') || ':00' AS TIME) < TIMESTAMP '1998-06-15 09:00:00' THEN 'closed'
  WHEN onsale_start + CAST(coalesce(onsale_time, '00:00') || ':00' AS TIME) > TIMESTAMP '1998-06-15 09:00:00' THEN 'before' WHEN onsale_label IS NOT NULL OR onsale_start IS NOT NULL THEN 'open' ELSE 'unknown' END"""


@query("SELECT row_no, tab, title, array_to_string(cats, '|') AS cats, array_to_string(venues, '|') AS venues, area, pref, CAST(start_date AS VARCHAR) AS start_date, CAST(end_date AS VARCHAR) AS end_date, len(dates) AS n_dates, CAST(backup_date[1] AS VARCHAR) AS backup, CAST(announced_date AS VARCHAR) AS announced_date, is_additional, onsale_label, price_official, price_best, round(lat, 6) AS lat, round(lng, 6) AS lng FROM listing")
def listing_typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing(spark, sf_dir).select(
        "row_no", "tab", "title", F.array_join("cats", "|").alias("cats"), F.array_join("venues", "|").alias("venues"), "area", "pref", day("start_date"), day("end_date"), F.size("dates").cast("long").alias("n_dates"),
        F.get("backup_date", F.lit(0)).cast("string").alias("backup"), day("announced_date"), "is_additional", "onsale_label", "price_official", "price_best", F.round("lat", 6).alias("lat"), F.round("lng", 6).alias("lng"),
    )


@query(PHASED_SQL + " SELECT row_no, phase FROM phased")
def schedule_phase(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing(spark, sf_dir).select("row_no", schedule.phase(TODAY).alias("phase"))


@query(STATUS_SQL + " SELECT row_no, tab, status FROM stated")
def status_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing(spark, sf_dir).select("row_no", "tab", schedule.status(TODAY).alias("status"))


@query(STATUS_SQL + " SELECT row_no, CAST(rank AS BIGINT) AS rank FROM stated")
def status_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing(spark, sf_dir).select("row_no", schedule.rank(TODAY).alias("rank"))


@query(f"SELECT row_no, CAST(list_filter(dates, lambda d: d >= {T})[1] AS VARCHAR) AS next_day FROM listing")
def next_open_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing(spark, sf_dir).select("row_no", schedule.next_open_day(TODAY).cast("string").alias("next_day"))


@query(f"SELECT row_no, CAST({EFFECTIVE_SQL} AS VARCHAR) AS effective, {ENDED_SQL} AS ended, coalesce({T} - announced_date BETWEEN 0 AND 7, false) AS is_new FROM listing")
def effective_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing(spark, sf_dir).select("row_no", schedule.effective_date(TODAY).cast("string").alias("effective"), schedule.has_ended(TODAY).alias("ended"), schedule.newly_announced(TODAY).alias("is_new"))


@query(f"SELECT row_no, {STATE_SQL} AS state FROM listing")
def sale_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing(spark, sf_dir).select("row_no", sale.state(NOW).alias("state"))


@query(f", s AS (SELECT *, {STATE_SQL} AS state FROM listing) SELECT row_no, CASE WHEN state = 'open' AND onsale_end - {T} BETWEEN 0 AND 7 THEN CAST(onsale_end - {T} AS BIGINT) END AS deadline, CASE WHEN state = 'before' AND onsale_start - {T} BETWEEN 0 AND 14 THEN CAST(onsale_start - {T} AS BIGINT) END AS opening FROM s")
def sale_countdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = listing(spark, sf_dir).withColumn("state", sale.state(NOW))
    return rows.select("row_no", sale.deadline_days(F.col("state"), F.col("onsale_end"), TODAY).cast("long").alias("deadline"), sale.opening_days(F.col("state"), F.col("onsale_start"), TODAY).cast("long").alias("opening"))


WD = "['日','月','火','水','木','金','土']"
DOTS = lambda d: f"year({d}) || '.' || month({d}) || '.' || day({d})"
WDAY = lambda d: f"'(' || {WD}[dayofweek({d}) + 1] || ')'"
SHORT = lambda d, p: f"CASE WHEN year({d}) <> year({p}) THEN {DOTS(d)} WHEN month({d}) <> month({p}) THEN month({d}) || '.' || day({d}) ELSE CAST(day({d}) AS VARCHAR) END || {WDAY(d)}"
SPAN_SQL = f"""CASE WHEN len(dates) > 0 THEN
  array_to_string(list_transform(CASE WHEN len(dates) > 8 THEN dates[1:7] ELSE dates END, lambda d, i: CASE WHEN i = 1 THEN {DOTS("d")} || {WDAY("d")} ELSE {SHORT("d", "dates[i - 1]")} END), '・')
    || CASE WHEN len(dates) > 8 THEN '・ほか' || (len(dates) - 7) || '日' ELSE '' END
  WHEN start_date <> end_date THEN {DOTS("start_date")} || {WDAY("start_date")} || '〜' || {SHORT("end_date", "start_date")}
  WHEN start_date IS NOT NULL AND end_date IS NULL THEN {DOTS("start_date")} || {WDAY("start_date")} || '〜' WHEN start_date IS NOT NULL THEN {DOTS("start_date")} || {WDAY("start_date")}
  WHEN end_date IS NOT NULL THEN '〜' || {DOTS("end_date")} || {WDAY("end_date")} END"""
SPAN = lambda: schedule.span(F.col("start_date"), F.col("end_date"), F.col("dates"))


@query(f"SELECT row_no, {SPAN_SQL} AS span FROM listing")
def span_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing(spark, sf_dir).select("row_no", SPAN().alias("span"))


@query(
    f""", s AS (SELECT *, {SPAN_SQL} AS span, CASE WHEN onsale_time IS NULL THEN NULL WHEN tab = 'event' THEN '開場10:00／開始10:00' WHEN tab = 'movie' THEN '開場10:00／上映10:00' ELSE '開場10:00／開演10:00' END AS t FROM listing)
    SELECT row_no, nullif(concat_ws(' ', span, t) || coalesce('（' || limited_sale || '）', ''), '') AS shown FROM s"""
)
def display_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    times = schedule.times(F.col("onsale_time"), F.col("onsale_time"), F.lit(None).cast("string"), F.col("tab"))
    return listing(spark, sf_dir).select("row_no", schedule.display_date(F.lit(None).cast("string"), SPAN(), times, F.col("limited_sale")).alias("shown"))


@query(
    """WITH d AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS t FROM orders), r AS (
    SELECT t, 'today' AS preset, t AS a, t AS b FROM d UNION ALL SELECT t, '7d', t, t + 6 FROM d UNION ALL SELECT t, 'month', t, last_day(t) FROM d
    UNION ALL SELECT t, 'weekend', CASE WHEN dayofweek(t) = 0 THEN t ELSE t + CAST(6 - dayofweek(t) AS INTEGER) END, CASE WHEN dayofweek(t) = 0 THEN t ELSE t + CAST(7 - dayofweek(t) AS INTEGER) END FROM d
    UNION ALL SELECT t, '3m', t, CAST(date_trunc('month', t) + INTERVAL 3 MONTH AS DATE) + CAST(day(t) - 1 AS INTEGER) FROM d)
    SELECT CAST(t AS VARCHAR) AS today, preset, CAST(a AS VARCHAR) AS first_day, CAST(b AS VARCHAR) AS last_day FROM r""",
    base="",
)
def preset_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = read(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("t")).distinct()
    each = [F.struct(F.lit(k).alias("preset"), *[c.cast("string").alias(n) for c, n in zip(schedule.preset_range(k, F.col("t")), ("first_day", "last_day"), strict=True)]) for k in schedule.PRESETS]
    return days.select(F.col("t").cast("string").alias("today"), F.inline(F.array(*each)))


@query(f"SELECT row_no, CASE WHEN price_official IS NOT NULL AND price_best IS NOT NULL AND title IS NOT NULL THEN 'compared' WHEN price_official IS NOT NULL THEN 'official_only' END AS kind, CASE WHEN price_official > price_best THEN price_official - price_best END AS saved, abs(round_even((price_official - price_best) * 100.0 / nullif(price_official, 0), 0) - 5) > 2 AS off FROM listing")
def price_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = sale.price_comparison(F.col("price_official"), F.col("price_best"), F.col("title"))
    off = sale.discount_off(F.nullif("price_official", F.lit(0)), F.col("price_best"), F.lit(5))
    return listing(spark, sf_dir).select("row_no", p["kind"].alias("kind"), p["saved"].alias("saved"), off.alias("off"))


HAV_SQL = lambda a, b: f"2 * 6371.0 * atan2(sqrt(h), sqrt(1 - h)) FROM (SELECT *, pow(sin(radians(lat - {a}) / 2), 2) + cos(radians({a})) * cos(radians(lat)) * pow(sin(radians(lng - {b}) / 2), 2) AS h"
HERE = (35.6812, 139.7671)


@query(f"SELECT row_no, round({HAV_SQL(*HERE).replace(' FROM (', ', 6) AS km FROM (', 1)} FROM listing)")
def haversine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing(spark, sf_dir).select("row_no", F.round(geo.haversine(F.lit(HERE[0]), F.lit(HERE[1]), F.col("lat"), F.col("lng")), 6).alias("km"))


@query(f"SELECT row_no FROM (SELECT row_no, {HAV_SQL(*HERE).replace(' FROM (', ' AS km FROM (', 1)} FROM listing)) WHERE km <= 60")
def within_radius(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing(spark, sf_dir).filter(geo.within(*HERE, 60.0)).select("row_no")


@query(
    """, c AS (SELECT s_suppkey AS centre_id, 34.5 + CAST(s_suppkey * 7 % 300 AS DOUBLE) / 100 AS clat, 138.0 + CAST(s_suppkey * 11 % 350 AS DOUBLE) / 100 AS clng FROM supplier),
    p AS (SELECT row_no, centre_id, pow(sin(radians(lat - clat) / 2), 2) + cos(radians(clat)) * cos(radians(lat)) * pow(sin(radians(lng - clng) / 2), 2) AS h FROM listing, c WHERE lat BETWEEN clat - 0.05 AND clat + 0.05)
    SELECT row_no, centre_id, round(2 * 6371.0 * atan2(sqrt(h), sqrt(1 - h)), 6) AS km FROM p WHERE 2 * 6371.0 * atan2(sqrt(h), sqrt(1 - h)) <= 3"""
)
def radius_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    centres = read(spark, sf_dir, "supplier").select(k.alias("centre_id"), (F.lit(34.5) + (k * 7 % 300).cast("double") / 100).alias("clat"), (F.lit(138.0) + (k * 11 % 350).cast("double") / 100).alias("clng"))
    return geo.radius_join(listing(spark, sf_dir).select("row_no", "lat", "lng"), centres, 3.0).select("row_no", "centre_id", F.round("km", 6).alias("km"))


# --- search ---

SPEC = FilterSpec(query="ri", facets={"cats": ("ECONOMY", "PROMO"), "tab": ("event", "live")}, flags=frozenset({"newOnly"}), start=date(1998, 1, 1), end=date(1999, 6, 30), pref="ASIA")
FOLDED_SQL = ", folded AS (SELECT *, lower(concat_ws(' ', title, array_to_string(venues, ' '), area, array_to_string(cats, ' '))) AS folded FROM listing)"
M_TEXT = "contains(folded, 'ri')"
M_DATE = """(len(list_filter(backup_date, lambda d: d BETWEEN DATE '1998-01-01' AND DATE '1999-06-30')) > 0 OR CASE WHEN len(dates) > 0 THEN len(list_filter(dates, lambda d: d BETWEEN DATE '1998-01-01' AND DATE '1999-06-30')) > 0
  ELSE coalesce(end_date >= DATE '1998-01-01', true) AND coalesce(start_date <= DATE '1999-06-30', true) END)"""
M_CATS, M_TAB, M_PREF = "list_has_any(cats, ['ECONOMY', 'PROMO'])", "tab IN ('event', 'live')", "coalesce(pref = 'ASIA', false)"
F_NEW = f"(is_additional OR coalesce({T} - announced_date BETWEEN 0 AND 7, false))"
MATCHED_SQL = FOLDED_SQL + f", m AS (SELECT *, {M_TEXT} AND {M_DATE} AS base, {M_CATS} AS m_cats, {M_TAB} AS m_tab, coalesce({F_NEW}, false) AS m_new, {M_PREF} AS m_pref, {STATE_SQL} AS state FROM folded)"


def searchable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The listing with its folded text, which is stored with it: it is folded once, not for every search."""
    return landing.parquet_once(spark, f"searchable {sf_dir}", lambda: exact.with_norms(listing(spark, sf_dir), {"folded": (text.haystack(), exact.SEARCH)}), "tab")


def spec_search(spec: FilterSpec = SPEC) -> Search:
    return Search(spec, default_facets(), default_flags(TODAY, NOW))


@query(FOLDED_SQL + " SELECT row_no FROM folded WHERE contains(folded, 'small') AND contains(folded, 'economy')")
def search_and_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return searchable(spark, sf_dir).filter(text.has_all_terms("folded", "ｓｍａｌｌ　Economy")).select("row_no")


@query(f"SELECT row_no FROM listing WHERE {M_DATE}")
def date_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing(spark, sf_dir).filter(in_range(F.lit(date(1998, 1, 1)), F.lit(date(1999, 6, 30)))).select("row_no")


@query(MATCHED_SQL + " SELECT row_no FROM m WHERE base AND m_cats AND m_tab AND m_new AND m_pref")
def facet_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return searchable(spark, sf_dir).filter(spec_search().full()).select("row_no")


@query(
    MATCHED_SQL
    + """ SELECT axis, value, count(*) AS n FROM (SELECT 'cats' AS axis, unnest(cats) AS value FROM m WHERE base AND m_tab AND m_new AND m_pref UNION ALL SELECT 'tab', tab FROM m WHERE base AND m_cats AND m_new AND m_pref
    UNION ALL SELECT 'pref', pref FROM m WHERE base AND m_cats AND m_tab AND m_new AND m_pref AND pref IS NOT NULL) GROUP BY ALL"""
)
def facet_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.facet_counts(searchable(spark, sf_dir), spec_search())


@query(
    MATCHED_SQL
    + """, c AS (SELECT count(*) FILTER (m_new) AS a, count(*) FILTER (m_new AND state = 'open') AS b, count(*) FILTER (m_new AND state = 'before') AS c, count(*) FILTER (m_new AND limited_sale IS NOT NULL) AS d
    FROM m WHERE base AND m_cats AND m_tab AND m_pref) SELECT 'newOnly' AS flag, a AS n FROM c UNION ALL SELECT 'onsaleOnly', b FROM c UNION ALL SELECT 'beforeOnly', c FROM c UNION ALL SELECT 'limitedOnly', d FROM c"""
)
def flag_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.flag_counts(searchable(spark, sf_dir), spec_search())


@query(MATCHED_SQL + " SELECT venue, count(*) AS n FROM (SELECT unnest(venues) AS venue FROM m WHERE base AND m_cats AND m_tab AND m_new) GROUP BY venue")
def venue_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.venue_counts(searchable(spark, sf_dir), spec_search())


@query(MATCHED_SQL + " SELECT count(*) AS total, count(*) FILTER (x) AS shown, count(*) FILTER (x AND lat IS NOT NULL) AS located_shown, count(*) FILTER (x AND lat IS NULL) AS unlocated FROM (SELECT *, base AND m_cats AND m_tab AND m_new AND m_pref AS x FROM m)")
def result_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.result_size(searchable(spark, sf_dir), spec_search())


PLACED = lambda order: f" SELECT row_no, CAST(row_number() OVER (ORDER BY {order}) AS BIGINT) AS place FROM ordered"


def all_placed(rows: DataFrame, order) -> DataFrame:
    return search.placed(rows, order, saver(rows.sparkSession)).select("row_no", "place")


@query(ORDERED_SQL + PLACED("ended, eff, rank, id, row_no"))
def sort_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    return all_placed(listing(spark, sf_dir), search.order_of(FilterSpec(), TODAY))


@query(ORDERED_SQL + PLACED("announced_date DESC NULLS LAST, ended, eff, rank, id, row_no"))
def sort_announced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return all_placed(listing(spark, sf_dir), search.order_of(FilterSpec(sort="announced"), TODAY))


@query(f", o AS (SELECT row_no, {HAV_SQL(*HERE).replace(' FROM (', ' AS km FROM (', 1)} FROM listing)) SELECT row_no, CAST(row_number() OVER (ORDER BY round(km, 9) NULLS LAST, row_no) AS BIGINT) AS place FROM o")
def sort_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    km = F.round(geo.haversine(F.lit(HERE[0]), F.lit(HERE[1]), F.col("lat"), F.col("lng")), 9)
    return all_placed(listing(spark, sf_dir).select("row_no", km.alias("km")), [F.col("km").asc_nulls_last(), F.col("row_no").asc()])


@query(", v AS (SELECT unnest(cats) AS value, row_no FROM listing) SELECT value, CASE value WHEN 'PROMO' THEN 0 WHEN 'ECONOMY' THEN 1 ELSE 2 END AS declared, min(row_no) AS first FROM v GROUP BY value")
def present_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.present_keys(listing(spark, sf_dir), F.col("cats"), ["PROMO", "ECONOMY"])


#: A part's saved search. Equal names and types give many equal ones.
SAVED_SQL = """, s AS (SELECT *, CASE WHEN terms IS NULL AND k % 4 = 0 THEN 'Supplier#' || lpad(CAST(k % 10 AS VARCHAR), 9, '0') END AS venue, terms IS NULL AND k % 4 = 1 AS circle,
    34.5 + CAST(k % 300 AS DOUBLE) / 100 AS clat, 138.0 + CAST(k % 350 AS DOUBLE) / 100 AS clng, CASE WHEN k % 4 = 3 THEN 'EUROPE' END AS s_pref, terms IS NULL AND k % 4 >= 2 AS short, b + CASE WHEN terms IS NULL AND k % 4 >= 2 THEN 2 ELSE 30 END AS c FROM (
    SELECT p_partkey AS k, p_partkey AS search_id, ['event', 'movie', 'live'][p_partkey % 3 + 1] AS s_tab, CASE WHEN p_partkey % 5 <> 4 THEN string_split(lower(p_name), ' ') END AS terms, CASE WHEN p_partkey % 7 < 4 THEN [p_type, 'NONE'] END AS s_cats,
    CASE WHEN p_partkey % 2 = 0 OR p_partkey % 20 = 19 THEN DATE '1997-01-01' + CAST(p_partkey % 900 AS INTEGER) END AS b FROM part))"""


def saved_searches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(search_id, query): a saved search for each part; names are typed in full width and back to front."""
    k = F.col("p_partkey")
    spoken, number = k % 5 != 4, lambda m: F.format_string("%.2f", m)
    short = ~spoken & (k % 4 >= 2)
    start = F.date_add(F.lit(date(1997, 1, 1)), (k % 900).cast("int"))
    end = F.date_add(start, F.when(short, 2).otherwise(30))
    wide = F.translate("p_name", "".join(map(chr, range(0x21, 0x7F))), "".join(map(chr, range(0xFF01, 0xFF5F))))
    label = F.url_encode(F.concat("p_type", F.lit(",NONE")))
    part = lambda name, value, when: F.when(when, F.concat(F.lit(f"{name}="), value))
    given = [
        part("tab", F.element_at(F.array(*map(F.lit, TABS)), (k % 3 + 1).cast("int")), k % 3 != 0), part("q", F.url_encode(F.array_join(F.reverse(F.split(wide, " ")), "\u3000")), spoken),
        part("cats", label, (k % 7 < 4) & (k % 3 == 0)), part("genre", label, (k % 7 < 4) & (k % 3 != 0)),
        *[part(name, F.when(k % 6 == 0, b).otherwise(a).cast("string"), (k % 2 == 0) | (k % 20 == 19)) for name, a, b in (("from", start, end), ("to", end, start))],
        part("venue", F.url_encode(F.concat(F.lit("Supplier#"), F.lpad((k % 10).cast("string"), 9, "0"))), ~spoken & (k % 4 == 0)),
        part("map", F.concat_ws(",", number(F.lit(34.5) + (k % 300) / 100.0), number(F.lit(138.0) + (k % 350) / 100.0), F.lit("2.00")), ~spoken & (k % 4 == 1)),
        part("pref", F.lit("EUROPE"), k % 4 == 3), part("f", F.concat_ws(",", F.when((k % 11 == 0) | short, "new"), F.when(k % 13 == 0, "onsale,beforeOnly")), (k % 11 == 0) | short | (k % 13 == 0)), part("sort", F.lit("new"), k % 17 == 0),
    ]
    return read(spark, sf_dir, "part").select(k.alias("search_id"), F.concat_ws("&", *given, F.when(k % 3 == 0, F.lit("tab=event"))).alias("query"))


def saved_axes() -> dict[str, percolate.Axis]:
    return {"cats": (F.col("cats"), ("event",)), "genre": (F.col("cats"), ("movie", "live")), "status": (F.array_compact(F.array(schedule.status(TODAY))), TABS)}


def saved_switches() -> dict[str, percolate.Switch]:
    short = {"newOnly": "new", "onsaleOnly": "onsale", "beforeOnly": "before", "limitedOnly": "limited"}
    return {short[f.name]: (f.name, f.test, TABS) for f in default_flags(TODAY, NOW)}


@query(
    FOLDED_SQL + SAVED_SQL + f""" SELECT search_id, row_no FROM (SELECT *, {STATE_SQL} AS state, coalesce({F_NEW}, false) AS fresh FROM folded) l JOIN s ON l.tab = s.s_tab
    AND (terms IS NULL OR (contains(folded, terms[1]) AND contains(folded, terms[-1]))) AND (s_cats IS NULL OR list_has_any(l.cats, s_cats))
    AND (b IS NULL OR len(list_filter(backup_date, lambda d: d BETWEEN b AND c)) > 0 OR CASE WHEN len(dates) > 0 THEN len(list_filter(dates, lambda d: d BETWEEN b AND c)) > 0 ELSE coalesce(end_date >= b, true) AND coalesce(start_date <= c, true) END)
    AND (fresh OR NOT (k % 11 = 0 OR short)) AND (state = 'open' OR k % 13 <> 0)
    AND CASE WHEN circle THEN coalesce(2 * 6371.0 * asin(sqrt(pow(sin(radians(lat - clat) / 2), 2) + cos(radians(clat)) * cos(radians(lat)) * pow(sin(radians(lng - clng) / 2), 2))) <= 2, false) WHEN venue IS NOT NULL THEN list_contains(venues, venue) WHEN s_pref IS NOT NULL THEN coalesce(l.pref = s_pref, false) ELSE true END"""
)
def saved_search_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return percolate.matches(searchable(spark, sf_dir), saved_searches(spark, sf_dir), TABS, saved_axes(), saved_switches(), saver(spark))


# --- places and series ---

MASTER_SQL = ", vm AS (SELECT s_name AS venue, 35.0 + CAST(min(s_suppkey) % 200 AS DOUBLE) / 100 AS vlat, 139.0 + CAST(min(s_suppkey) % 100 AS DOUBLE) / 100 AS vlng FROM supplier GROUP BY s_name)"


def venue_master(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = places.first_per_name(read(spark, sf_dir, "supplier").select(F.col("s_name").alias("venue"), "s_suppkey"), "venue", "s_suppkey")
    k = F.col("s_suppkey")
    return first.select("venue", (F.lit(35.0) + (k % 200).cast("double") / 100).alias("vlat"), (F.lit(139.0) + (k % 100).cast("double") / 100).alias("vlng"))


@query(MASTER_SQL + " SELECT row_no, round(coalesce(lat, vlat), 6) AS lat, round(coalesce(lng, vlng), 6) AS lng FROM listing LEFT JOIN vm ON vm.venue = venues[1]")
def venue_enrich(spark: SparkSession, sf_dir: str) -> DataFrame:
    return places.venue_enrich(listing(spark, sf_dir), venue_master(spark, sf_dir)).select("row_no", F.round("lat", 6).alias("lat"), F.round("lng", 6).alias("lng"))


@query(MASTER_SQL + " SELECT row_no, round(CASE WHEN len(venues) = 1 AND lat IS NULL AND vlat IS NOT NULL THEN vlat ELSE lat END, 6) AS lat, round(CASE WHEN len(venues) = 1 AND lat IS NULL AND vlat IS NOT NULL THEN vlng ELSE lng END, 6) AS lng FROM listing LEFT JOIN vm ON vm.venue = venues[1]")
def theatre_enrich(spark: SparkSession, sf_dir: str) -> DataFrame:
    theatres = venue_master(spark, sf_dir).toDF("name", "tlat", "tlng")
    return places.theatre_enrich(listing(spark, sf_dir), theatres).select("row_no", F.round("lat", 6).alias("lat"), F.round("lng", 6).alias("lng"))


@query(
    """, tiers AS (SELECT n_name AS place, 1 AS tier, 35.0 + CAST(s_suppkey % 200 AS DOUBLE) / 100 AS lat, 139.0 + CAST(s_suppkey % 100 AS DOUBLE) / 100 AS lng FROM supplier JOIN nation ON s_nationkey = n_nationkey
    UNION ALL SELECT s_name, 2, 35.0 + CAST(s_suppkey % 200 AS DOUBLE) / 100, 139.0 + CAST(s_suppkey % 100 AS DOUBLE) / 100 FROM supplier WHERE s_suppkey % 3 = 0
    UNION ALL SELECT s_name, 3, 35.0 + CAST(s_suppkey % 200 AS DOUBLE) / 100, 139.0 + CAST(s_suppkey % 100 AS DOUBLE) / 100 FROM supplier WHERE s_suppkey % 3 <> 2
    UNION ALL SELECT place, 4, lat, lng FROM (SELECT unnest(venues) AS place, tab, row_no, lat, lng FROM listing WHERE lat IS NOT NULL) QUALIFY row_number() OVER (PARTITION BY place ORDER BY tab, row_no) = 1)
    SELECT place, tier, round(lat, 6) AS lat, round(lng, 6) AS lng FROM tiers QUALIFY tier = min(tier) OVER (PARTITION BY place)"""
)
def place_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    lat, lng = F.lit(35.0) + (k % 200).cast("double") / 100, F.lit(139.0) + (k % 100).cast("double") / 100
    own = read(spark, sf_dir, "supplier")
    branches = own.join(read(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("chain"), lat.alias("lat"), lng.alias("lng"))
    venues = own.filter(k % 3 == 0).select(F.col("s_name").alias("venue"), lat.alias("vlat"), lng.alias("vlng"))
    theatres = own.filter(k % 3 != 2).select(F.col("s_name").alias("name"), lat.alias("tlat"), lng.alias("tlng"))
    return places.place_points(listing(spark, sf_dir), branches, venues, theatres).select("place", "tier", F.round("lat", 6).alias("lat"), F.round("lng", 6).alias("lng"))


@query(
    ORDERED_SQL + """, here AS (SELECT unnest(venues) AS place, row_no, ended, eff, rank, id FROM ordered) SELECT place, CAST(row_number() OVER (PARTITION BY place ORDER BY ended, eff, rank, id, row_no) AS BIGINT) AS place_no, row_no,
    greatest(count(*) OVER (PARTITION BY place) - 8, 0) AS more FROM here QUALIFY place_no <= 8"""
)
def place_upcoming(spark: SparkSession, sf_dir: str) -> DataFrame:
    return places.place_upcoming(listing(spark, sf_dir), TODAY).select("place", F.col("place_no").cast("long").alias("place_no"), "row_no", F.col("more").cast("long").alias("more"))


@query(f" SELECT a.row_no, b.row_no AS sibling, CAST(b.start_date AS VARCHAR) AS start_date, b.state, b.limited_sale IS NOT NULL AS limited FROM listing a JOIN (SELECT *, {STATE_SQL} AS state FROM listing) b ON a.series_id = b.series_id AND a.row_no <> b.row_no")
def series_siblings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return places.series_siblings(listing(spark, sf_dir), NOW).select("row_no", "sibling", day("start_date"), "state", "limited")


@query(
    f""", s AS (SELECT *, {STATE_SQL} AS state FROM listing) SELECT row_no, count(*) OVER w - 1 AS others, CAST(sum(CAST(limited_sale IS NOT NULL AS INTEGER)) OVER w - CAST(limited_sale IS NOT NULL AS INTEGER) AS BIGINT) AS others_limited,
    CAST(sum(CAST(state = 'before' AS INTEGER)) OVER w - CAST(state = 'before' AS INTEGER) AS BIGINT) AS others_before FROM s WHERE series_id IS NOT NULL WINDOW w AS (PARTITION BY series_id)"""
)
def series_highlights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return places.series_highlights(listing(spark, sf_dir), NOW)


# --- identity and reconciliation ---

NORM_SQL = "lower(regexp_replace({}, '[^A-Za-z0-9]', '', 'g'))"
KEY_SQL = f"{NORM_SQL.format('title')} || chr(31) || coalesce({NORM_SQL.format('venues[1]')}, '') || chr(31) || coalesce(CAST(start_date AS VARCHAR), '')"
SNAP_SQL = f""", keyed AS (SELECT *, sha1({KEY_SQL}) AS uid FROM listing), prev AS (SELECT * FROM keyed WHERE id % 20 <> 3 QUALIFY row_number() OVER (PARTITION BY uid ORDER BY row_no DESC) = 1),
cur AS (SELECT * EXCLUDE (end_date, onsale_label), CASE WHEN id % 11 = 0 THEN end_date + 1 ELSE end_date END AS end_date, CASE WHEN id % 44 = 0 THEN 'changed' ELSE onsale_label END AS onsale_label FROM keyed WHERE id % 20 <> 7 QUALIFY row_number() OVER (PARTITION BY uid ORDER BY row_no DESC) = 1),
gone AS (SELECT * FROM prev WHERE uid NOT IN (SELECT uid FROM cur)), added AS (SELECT * FROM cur WHERE uid NOT IN (SELECT uid FROM prev)), dispo AS (SELECT uid, ['ended', 'cancelled', 'renamed', 'moved', 'merged', 'unknown'][id % 6 + 1] AS code, id FROM gone WHERE id % 4 <> 0)"""


PREVIOUS_DAY = date(1998, 6, 8)


def snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The previous and the current snapshot, landed once in a session: of a listing what is compared, shown or carried on by a comparison."""

    def make() -> dict[date, DataFrame]:
        rows = exact.with_natural_key(heads(spark, sf_dir), "key", F.col("title"), F.get("venues", F.lit(0)), F.col("start_date"))
        rows = rows.withColumn("uid", text.key_uid(F.col("key"))).drop("key")
        moved = rows.filter("id % 20 <> 7").withColumns({"end_date": F.when(F.col("id") % 11 == 0, F.date_add("end_date", 1)).otherwise(F.col("end_date")), "onsale_label": F.when(F.col("id") % 44 == 0, "changed").otherwise(F.col("onsale_label"))})
        return {PREVIOUS_DAY: rows.filter("id % 20 <> 3"), TODAY: moved}

    table = landing.landed_once(spark, sf_dir, make)
    return landing.snapshot(spark, table, PREVIOUS_DAY), landing.snapshot(spark, table, TODAY)


def dispositions(gone: DataFrame) -> DataFrame:
    codes = F.array(*map(F.lit, ("ended", "cancelled", "renamed", "moved", "merged", "unknown")))
    return gone.filter("id % 4 <> 0").select("uid", F.element_at(codes, (F.col("id") % 6 + 1).cast("int")).alias("code"), F.col("id").alias("seq"))


@query(f", c AS (SELECT row_no, {KEY_SQL} AS k FROM listing) SELECT row_no, sha1(k) AS uid, left(sha1(k), 8) AS short FROM c")
def natural_uid(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = exact.with_natural_key(listing(spark, sf_dir), "key", F.col("title"), F.get("venues", F.lit(0)), F.col("start_date"))
    return rows.select("row_no", text.key_uid(F.col("key")).alias("uid"), text.key_uid(F.col("key"), 8).alias("short"))


@query(None)
def content_uid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing(spark, sf_dir).select("row_no", text.content_uid(F.col("title"), F.get("venues", F.lit(0)), F.col("start_date")).alias("uid"))


@query(SNAP_SQL + " SELECT uid, row_no FROM added")
def diff_added(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconcile.added(*snapshots(spark, sf_dir)).select("uid", "row_no")


@query(SNAP_SQL + " SELECT uid, row_no FROM gone")
def diff_gone(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconcile.gone(*snapshots(spark, sf_dir)).select("uid", "row_no")


@query(
    SNAP_SQL + """ SELECT p.uid, 'end_date' AS "column", CAST(p.end_date AS VARCHAR) AS old, CAST(c.end_date AS VARCHAR) AS new FROM prev p JOIN cur c USING (uid) WHERE p.end_date IS DISTINCT FROM c.end_date
    UNION ALL SELECT p.uid, 'onsale_label', p.onsale_label, c.onsale_label FROM prev p JOIN cur c USING (uid) WHERE p.onsale_label IS DISTINCT FROM c.onsale_label
    UNION ALL SELECT p.uid, 'limited_sale', p.limited_sale, c.limited_sale FROM prev p JOIN cur c USING (uid) WHERE p.limited_sale IS DISTINCT FROM c.limited_sale
    UNION ALL SELECT p.uid, 'area', NULL, NULL FROM prev p JOIN cur c USING (uid) WHERE p.area IS DISTINCT FROM c.area"""
)
def diff_changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconcile.changed(*snapshots(spark, sf_dir), ["end_date", "onsale_label", "limited_sale", "not_there"], ["area"])


@query(SNAP_SQL + " SELECT uid, code, id AS seq FROM dispo")
def dispositions_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = dispositions(reconcile.gone(*snapshots(spark, sf_dir)))
    older = log.select("uid", F.lit("older").alias("code"), (F.col("seq") - 1).alias("seq"))
    return reconcile.latest_dispositions(log.union(older)).select("uid", "code", "seq")


CHARS_SQL = """, ga AS (SELECT uid AS a, lower(regexp_replace(title, '[^A-Za-z0-9]', '', 'g')) AS title, coalesce(lower(regexp_replace(venues[1], '[^A-Za-z0-9]', '', 'g')), '') AS place, start_date AS day FROM gone),
ad AS (SELECT uid AS b, lower(regexp_replace(title, '[^A-Za-z0-9]', '', 'g')) AS title, coalesce(lower(regexp_replace(venues[1], '[^A-Za-z0-9]', '', 'g')), '') AS place, start_date AS day FROM added),
letters AS (SELECT chr(CAST(i + 96 AS INTEGER)) AS ch FROM range(1, 27) t(i) UNION ALL SELECT chr(CAST(i + 47 AS INTEGER)) FROM range(1, 11) t(i)),
ta AS (SELECT DISTINCT title FROM ga), tb AS (SELECT DISTINCT title FROM ad),
sims AS (SELECT x.title AS ta, y.title AS tb, sum(least(len(x.title) - len(replace(x.title, ch, '')), len(y.title) - len(replace(y.title, ch, '')))) / CAST(least(len(x.title), len(y.title)) AS DOUBLE) AS score FROM ta x, tb y, letters WHERE x.title <> '' AND y.title <> '' GROUP BY x.title, y.title),
cand AS (SELECT a AS prev_uid, b AS uid, score FROM ga JOIN sims ON ga.title = ta JOIN ad ON ad.title = tb WHERE score >= 0.82 OR (score >= 0.45 AND ga.place = ad.place AND ga.place <> '' AND ga.day = ad.day))"""


def rename_sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Gone and added rows by their key of three parts."""
    prev, cur = snapshots(spark, sf_dir)
    part = lambda df: reconcile.keyed_by_place(exact.with_norms(df, {"t": (F.col("title"), exact.IDENTITY), "p": (F.get("venues", F.lit(0)), exact.IDENTITY)}).select("uid", F.col("t").alias("title"), F.col("p").alias("place"), F.col("start_date").alias("day")))
    return part(reconcile.gone(prev, cur)), part(reconcile.added(prev, cur))


def renamed(spark: SparkSession, sf_dir: str, digits: int | None = None) -> DataFrame:
    return reconcile.renames_by_key(*rename_sides(spark, sf_dir), save=saver(spark), digits=digits)


@query(SNAP_SQL + CHARS_SQL + " SELECT prev_uid, uid, round(score, 6) AS score FROM cand")
def rename_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return renamed(spark, sf_dir, 6)


@query(SNAP_SQL + " SELECT uid, row_no FROM gone WHERE uid NOT IN (SELECT uid FROM dispo)")
def diff_unexplained(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = reconcile.gone(*snapshots(spark, sf_dir))
    none = spark.createDataFrame([], "prev_uid string")
    return reconcile.unexplained(gone, dispositions(gone), none).select("uid", "row_no")


@query(SNAP_SQL + " SELECT (SELECT count(*) FROM prev) AS previous, (SELECT count(*) FROM cur) AS current, (SELECT count(*) FROM added) AS added, (SELECT count(*) FROM gone) AS gone, (SELECT count(*) FROM gone WHERE id % 4 = 0) AS unexplained")
def diff_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    prev, cur = snapshots(spark, sf_dir)
    both = prev.select("uid", "id", F.lit(1).alias("p")).join(cur.select("uid", F.lit(1).alias("c")), "uid", "full_outer")
    went = F.col("c").isNull()
    return both.agg(F.count("p").alias("previous"), F.count("c").alias("current"), F.count_if(F.col("p").isNull()).alias("added"), F.count_if(went).alias("gone"), F.count_if(went & (F.col("id") % 4 == 0)).alias("unexplained"))


@query(None)
def rename_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconcile.assign_renames(*rename_sides(spark, sf_dir), saver(spark))


@query(", p AS (SELECT area AS place, CASE WHEN row_no % 20 <> 3 THEN 0 ELSE 1 END AS source, row_no, onsale_label, limited_sale FROM listing) SELECT place, arg_min(onsale_label, (source, row_no)) FILTER (onsale_label IS NOT NULL) AS onsale_label, arg_min(limited_sale, (source, row_no)) FILTER (limited_sale IS NOT NULL) AS limited_sale FROM p WHERE place IS NOT NULL GROUP BY place")
def place_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = listing(spark, sf_dir).withColumn("place", F.col("area"))
    return reconcile.place_facts(rows.filter("row_no % 20 <> 3"), rows.filter("row_no % 20 = 3"), ["onsale_label", "limited_sale"])


@query(
    """, old AS (SELECT row_no AS uid, title, onsale_label, limited_sale FROM listing WHERE row_no % 5 <> 0), facts AS (SELECT area AS place, min(limited_sale) AS limited_sale FROM listing WHERE area IS NOT NULL GROUP BY area),
    b AS (SELECT row_no AS uid, area AS place, CASE WHEN row_no % 2 = 0 THEN title ELSE ' ' END AS title, CASE WHEN row_no % 3 = 0 THEN onsale_label END AS onsale_label, CAST(NULL AS VARCHAR) AS limited_sale, row_no % 4 = 0 AS asks, CASE WHEN row_no % 6 = 1 THEN row_no + 1 ELSE row_no END AS src FROM listing)
    SELECT b.uid, CASE WHEN trim(b.title) <> '' THEN b.title ELSE old.title END AS title, coalesce(b.onsale_label, CASE WHEN asks THEN old.onsale_label END) AS onsale_label, coalesce(old.limited_sale, facts.limited_sale) AS limited_sale
    FROM b LEFT JOIN old ON old.uid = src LEFT JOIN facts ON facts.place = b.place"""
)
def carry_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = listing(spark, sf_dir)
    k = F.col("row_no")
    prev = rows.filter("row_no % 5 <> 0").select(k.alias("uid"), "title", "onsale_label", "limited_sale")
    facts = rows.filter("area is not null").groupBy(F.col("area").alias("place")).agg(F.min("limited_sale").alias("limited_sale"))
    batch = rows.select(
        k.alias("uid"), F.col("area").alias("place"), F.when(k % 2 == 0, F.col("title")).otherwise(" ").alias("title"), F.when(k % 3 == 0, F.col("onsale_label")).alias("onsale_label"), F.lit(None).cast("string").alias("limited_sale"),
        F.when(k % 4 == 0, F.array(F.lit("onsale_label"))).alias("carry"), F.when(k % 6 == 1, k + 1).alias("carry_from"),
    )
    return reconcile.carry_forward(batch, prev, facts, ["title", "limited_sale"], ["limited_sale"]).select("uid", "title", "onsale_label", "limited_sale")


@query("SELECT DISTINCT row_no AS uid, c AS \"column\", CASE WHEN c = 'price' THEN 'forbidden' ELSE 'unknown' END AS reason FROM (SELECT row_no, unnest(CASE WHEN row_no % 3 = 0 THEN ['kana', 'price'] WHEN row_no % 3 = 1 THEN ['x' || (row_no % 7)] ELSE [] END) AS c FROM listing) WHERE c <> 'kana'")
def carry_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("row_no")
    asked = F.when(k % 3 == 0, F.lit("kana| price |")).when(k % 3 == 1, F.concat(F.lit("x"), k % 7)).otherwise("*")
    return reconcile.carry_rejects(listing(spark, sf_dir).select(k.alias("uid"), asked.alias("request")), ["price", "id", "title"], ["kana", "price", "id", "title", "lat"])


@query("SELECT row_no, (SELECT max(id) FROM listing WHERE id % 2 = 0) + row_number() OVER (ORDER BY row_no) AS new_id FROM listing WHERE id % 2 = 1")
def append_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = listing(spark, sf_dir).select("id", "row_no")
    return reconcile.append_ids(rows.filter("id % 2 = 0"), rows.filter("id % 2 = 1"), "row_no", saver(spark)).select("row_no", "new_id")


# --- rosters and review ---

ROSTER_SQL = """WITH r AS (SELECT s_suppkey AS k, s_name AS name, CASE s_suppkey % 4 WHEN 0 THEN 'active' WHEN 1 THEN 'candidate' WHEN 2 THEN 'retired' END AS status, DATE '1998-01-01' + CAST(s_suppkey % 150 AS INTEGER) AS first_seen,
  CASE WHEN s_suppkey % 5 <> 0 THEN DATE '1997-11-01' + CAST(s_suppkey % 220 AS INTEGER) END AS last_hit, CASE WHEN s_suppkey % 6 <> 0 THEN s_suppkey % 3 END AS hit_count, CASE WHEN s_suppkey % 7 = 0 THEN DATE '1998-06-10' + CAST(s_suppkey % 12 AS INTEGER) END AS closed_until, CAST(s_nationkey AS VARCHAR) AS pref FROM supplier)"""


def supplier_roster(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    plus = lambda d, n: F.date_add(F.lit(d), (k % n).cast("int"))
    return read(spark, sf_dir, "supplier").select(
        k.alias("k"), F.col("s_name").alias("name"), F.when(k % 4 == 0, "active").when(k % 4 == 1, "candidate").when(k % 4 == 2, "retired").alias("status"), plus(date(1998, 1, 1), 150).alias("first_seen"),
        F.when(k % 5 != 0, plus(date(1997, 11, 1), 220)).alias("last_hit"), F.when(k % 6 != 0, k % 3).alias("hit_count"), F.when(k % 7 == 0, plus(date(1998, 6, 10), 12)).alias("closed_until"),
        F.col("s_nationkey").cast("string").alias("pref"), F.lit(None).cast("string").alias("kind"), F.lit("x").alias("chain"), F.lit(None).cast("string").alias("note"),
    )


def hit_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read(spark, sf_dir, "lineitem").select("l_suppkey", F.to_date("l_shipdate").alias("day")).filter("day < '1998-06-15'")
    return lines.join(read(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).select(F.upper("s_name").alias("name"), "day")


@query(
    ROSTER_SQL + """, o AS (SELECT * FROM r UNION ALL SELECT k, 'New ' || name, status, first_seen, last_hit, hit_count, closed_until, pref FROM r), h AS (SELECT s_name AS name, max(CAST(l_shipdate AS DATE)) AS d, count(*) AS n FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE CAST(l_shipdate AS DATE) < DATE '1998-06-15' GROUP BY s_name)
    SELECT o.name, CASE WHEN status = 'candidate' AND n IS NOT NULL AND coalesce(hit_count, 0) + coalesce(n, 0) >= 2 THEN 'active' ELSE status END AS status, CAST(CASE WHEN d IS NULL OR last_hit > d THEN last_hit ELSE d END AS VARCHAR) AS last_hit, coalesce(hit_count, 0) + coalesce(n, 0) AS hit_count FROM o LEFT JOIN h USING (name)""",
    base="",
)
def roster_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All lines before the day; a second place of each supplier has no hits."""
    own = supplier_roster(spark, sf_dir)
    both = own.union(own.withColumn("name", F.concat(F.lit("New "), "name")).select(*own.columns))
    return roster.hits(both, hit_log(spark, sf_dir)).select("name", "status", day("last_hit"), "hit_count")


@query(ROSTER_SQL + " SELECT k, CASE WHEN status = 'candidate' AND idle > 60 THEN 'retired' WHEN coalesce(status, 'active') = 'active' AND idle > 180 THEN 'candidate' ELSE status END AS status, idle FROM (SELECT *, DATE '1998-06-15' - coalesce(last_hit, first_seen) AS idle FROM r)", base="")
def roster_gc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return roster.age(supplier_roster(spark, sf_dir), TODAY).select("k", "status", F.col("idle").cast("long").alias("idle"))


@query(ROSTER_SQL + " SELECT k FROM r WHERE coalesce(status, 'active') <> 'retired' AND NOT coalesce(closed_until > DATE '1998-06-15', false) AND pref IN ('3')", base="")
def roster_open(spark: SparkSession, sf_dir: str) -> DataFrame:
    return roster.open_places(supplier_roster(spark, sf_dir), TODAY, pref="3", kind="x").select("k")


@query(
    """WITH b AS (SELECT 'Supplier#' || lpad(CAST(c_custkey % 4000 AS VARCHAR), 9, '0') AS name, c_custkey AS seq FROM customer) SELECT name, min(seq) AS seq FROM b WHERE name NOT IN (SELECT s_name FROM supplier) GROUP BY name""",
    base="",
)
def roster_add(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    batch = read(spark, sf_dir, "customer").select(F.concat(F.lit("Supplier#"), F.lpad((k % 4000).cast("string"), 9, "0")).alias("name"), k.alias("seq"), k.alias("source"))
    return roster.add(supplier_roster(spark, sf_dir), batch, TODAY).select("name", F.col("source").alias("seq"))


REVIEW_SQL = f""", rv AS (SELECT *, end_date <= {T} + 21 AS r1, start_date BETWEEN {T} AND {T} + 21 AS r2, onsale_end <= {T} + 21 AS r3, onsale_start >= {T} AS r4, onsale_label IS NOT NULL AND onsale_end IS NULL AS r5, is_additional AS r6,
  (price_official IS NOT NULL OR price_best IS NOT NULL) AND NOT coalesce({T} - announced_date <= 14, false) AS r7 FROM listing),
tiered AS (SELECT *, CASE WHEN coalesce(r1, false) OR coalesce(r2, false) OR coalesce(r3, false) OR coalesce(r4, false) OR r5 OR coalesce(r6, false) OR r7 THEN 'A' WHEN start_date IS NULL AND end_date IS NULL THEN 'C' ELSE 'B' END AS tier FROM rv)"""


def reviewed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing(spark, sf_dir).withColumn("price_checked", F.col("announced_date"))


@query(REVIEW_SQL + " SELECT row_no, tier, CAST(coalesce(r1, false) AS INTEGER) + CAST(coalesce(r2, false) AS INTEGER) + CAST(coalesce(r3, false) AS INTEGER) + CAST(coalesce(r4, false) AS INTEGER) + CAST(r5 AS INTEGER) + CAST(coalesce(r6, false) AS INTEGER) + CAST(r7 AS INTEGER) AS n_reasons FROM tiered")
def review_tier(spark: SparkSession, sf_dir: str) -> DataFrame:
    tier, reasons = roster.review(TODAY)
    return reviewed(spark, sf_dir).select("row_no", tier.alias("tier"), F.size(reasons).alias("n_reasons"))


@query(REVIEW_SQL + " SELECT tier, count(*) AS n FROM tiered GROUP BY tier")
def tier_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reviewed(spark, sf_dir).groupBy(roster.review(TODAY)[0].alias("tier")).agg(F.count("*").alias("n"))


@query(REVIEW_SQL + f", k AS (SELECT *, left(sha1({KEY_SQL}), 8) AS uid FROM tiered) SELECT uid, row_no, tier, pref, CASE WHEN len(title) > 24 THEN title[1:23] || '…' ELSE title END AS title, CASE WHEN len(venues[1]) > 16 THEN venues[1][1:15] || '…' ELSE venues[1] END AS venue, concat_ws('~', CAST(start_date AS VARCHAR)[6:10], CAST(end_date AS VARCHAR)[6:10]) AS span, CAST(onsale_end AS VARCHAR) AS deadline FROM k")
def worklist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return roster.worklist(reviewed(spark, sf_dir), TODAY).drop("reasons")


# --- quality, links, text ---

@query(
    """SELECT page_id, CASE WHEN regexp_matches(u, '^(https?|mailto|tel):', 'i') OR (regexp_matches(u, '^(/|[.]/|#)') AND NOT starts_with(u, '//')) THEN u END AS link FROM (SELECT page_id, trim(CASE page_id % 5 WHEN 0 THEN url WHEN 1 THEN ' ' || url WHEN 2 THEN 'javascript:' || url WHEN 3 THEN '//' || url ELSE '/path' END) AS u FROM pages)""",
    base="",
)
def safe_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, u = F.col("page_id"), F.col("url")
    link = F.when(k % 5 == 0, u).when(k % 5 == 1, F.concat(F.lit(" "), u)).when(k % 5 == 2, F.concat(F.lit("javascript:"), u)).when(k % 5 == 3, F.concat(F.lit("//"), u)).otherwise("/path")
    return read(spark, sf_dir, "pages").select("page_id", text.safe_url(link).alias("link"))


@query(
    r"""WITH c AS (SELECT doc_id, regexp_replace(trim(coalesce(text, '')), '[\x00-\x1f\x7f]', '', 'g') AS clean FROM documents) SELECT doc_id, CASE WHEN regexp_matches(clean, '(ignore\s+(all\s+)?previous|disregard\s+the|system\s*prompt)', 'i') THEN 'instruction-like' WHEN length(clean) > 2000 THEN 'too long' END AS reason, length(clean) AS n FROM c""",
    base="",
)
def quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return roster.quarantine(read(spark, sf_dir, "documents"), "text", 2000).select("doc_id", "reason", F.length("clean").cast("long").alias("n"))


@query(
    """, t AS (SELECT row_no, title, CASE WHEN start_date IS NULL THEN '' WHEN row_no % 10 = 0 THEN '1998-2-30' WHEN row_no % 10 = 1 THEN '1998-02-30' ELSE CAST(start_date AS VARCHAR) END AS s, coalesce(CAST(end_date AS VARCHAR), '') AS e, round(lat, 2) AS lat, CASE WHEN row_no % 31 <> 0 THEN round(lng, 2) END AS lng,
    price_official AS po, CASE WHEN row_no % 9 = 0 THEN price_official + 1 ELSE price_best END AS pb, tab FROM listing)
    SELECT row_no, 'K6' AS rule FROM t WHERE s = '1998-2-30' UNION ALL SELECT row_no, 'K7' FROM t WHERE s = '1998-02-30' UNION ALL SELECT row_no, 'K8' FROM t WHERE regexp_matches(s, '^\\d{4}-\\d{2}-\\d{2}$') AND s <> '1998-02-30' AND e <> '' AND TRY_CAST(e AS DATE) < TRY_CAST(s AS DATE)
    UNION ALL SELECT row_no, 'K9' FROM t WHERE s = '' AND e = '' UNION ALL SELECT row_no, 'K21' FROM t WHERE tab = 'live' AND e = '' AND s NOT IN ('', '1998-2-30', '1998-02-30') UNION ALL SELECT row_no, 'K39' FROM t WHERE lat NOT BETWEEN 34.5 AND 37.5 UNION ALL SELECT row_no, 'K39' FROM t WHERE lng NOT BETWEEN 138.0 AND 141.5
    UNION ALL SELECT row_no, 'K40' FROM t WHERE (lat IS NULL) <> (lng IS NULL) UNION ALL SELECT row_no, 'K42' FROM t WHERE pb IS NOT NULL UNION ALL SELECT row_no, 'K43' FROM t WHERE pb > po UNION ALL SELECT row_no, 'K41' FROM t WHERE pb IS NOT NULL AND po IS NULL UNION ALL SELECT row_no, 'K45' FROM t WHERE po = 0"""
)
def dq_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, s = F.col("row_no"), F.col("start_date")
    raw = listing(spark, sf_dir).select(
        "row_no", "tab", "title", F.when(s.isNull(), "").when(k % 10 == 0, "1998-2-30").when(k % 10 == 1, "1998-02-30").otherwise(s.cast("string")).alias("start_date"), F.coalesce(F.col("end_date").cast("string"), F.lit("")).alias("end_date"),
        F.round("lat", 2).cast("string").alias("lat"), F.when(k % 31 != 0, F.round("lng", 2)).cast("string").alias("lng"), F.col("price_official").cast("string").alias("price_official"),
        F.when(k % 9 == 0, F.col("price_official") + 1).otherwise(F.col("price_best")).cast("string").alias("price_best"), F.lit("").alias("best_source"), F.lit("").alias("discount_pct"),
    )
    return quality.violations(raw, quality.raw_rules(raw.columns), "listing").select("row_no", "rule")


@query(", c AS (SELECT row_no, area, lag(row_no) OVER (PARTITION BY title, area ORDER BY row_no) AS b, count(*) OVER (PARTITION BY series_id) AS n, series_id FROM listing) SELECT row_no, 'K48' AS rule, CAST(series_id AS VARCHAR) AS value FROM c WHERE n = 1 UNION ALL SELECT row_no, 'K5', CAST(b AS VARCHAR) FROM c WHERE b IS NOT NULL")
def dq_grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = listing(spark, sf_dir).withColumn("key", F.concat_ws("\x1f", "title", F.coalesce("area", F.lit(""))))
    found = quality.single_rows(rows, "series_id", "listing").unionByName(quality.repeated(rows, "key", "K5", quality.WARNING, "listing"))
    return found.select("row_no", "rule", "value")


@query("SELECT count(*) FILTER (start_date IS NULL AND end_date IS NULL) AS warnings, count(*) FILTER (end_date < start_date) AS errors, count(*) FILTER (end_date < start_date) = 0 AS publish FROM listing")
def dq_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = listing(spark, sf_dir).select("row_no", F.col("start_date").cast("string").alias("start_date"), F.col("end_date").cast("string").alias("end_date"))
    return quality.gate(quality.violations(raw, quality.raw_rules(raw.columns), "listing"))


@query("SELECT row_no, CASE tab WHEN 'event' THEN 'Event' WHEN 'movie' THEN 'Film' ELSE 'Other' END AS label FROM listing")
def label_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing(spark, sf_dir).select("row_no", text.label({"event": "Event", "movie": "Film"}, F.col("tab"), "Other").alias("label"))


@query(None, base="")
def highlight(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", text.highlight(F.col("text"), "the que").alias("marked"))


@query("WITH p AS (SELECT unnest(string_split(p_name, ' ')) AS w FROM part), w AS (SELECT DISTINCT w FROM p) SELECT a.w AS a, b.w AS b, round(sum(least(len(a.w) - len(replace(a.w, ch, '')), len(b.w) - len(replace(b.w, ch, '')))) / CAST(least(len(a.w), len(b.w)) AS DOUBLE), 6) AS score FROM w a, w b, (SELECT chr(CAST(i AS INTEGER)) AS ch FROM range(97, 123) t(i)) GROUP BY a.w, b.w HAVING sum(least(len(a.w) - len(replace(a.w, ch, '')), len(b.w) - len(replace(b.w, ch, '')))) >= 0.6 * least(len(a.w), len(b.w)) - 1e-9", base="")
def title_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = read(spark, sf_dir, "part").select(F.explode(F.split("p_name", " ")).alias("title")).distinct()
    left, right = words.select(F.col("title").alias("a"), "title"), words.select(F.col("title").alias("b"), "title")
    return reconcile.title_pairs(left, right, 0.6).select("a", "b", F.round("score", 6).alias("score"))


@query("SELECT row_no, 'BEGIN:VEVENT' || chr(13) || chr(10) || 'UID:' || row_no || chr(13) || chr(10) || 'SUMMARY:' || replace(replace(title, ',', '\\,'), ';', '\\;') || chr(13) || chr(10) || 'DTSTART;VALUE=DATE:' || strftime(coalesce(start_date, end_date), '%Y%m%d') || chr(13) || chr(10) || 'DTEND;VALUE=DATE:' || strftime(coalesce(end_date, start_date) + 1, '%Y%m%d') || chr(13) || chr(10) || 'END:VEVENT' AS entry FROM listing WHERE start_date IS NOT NULL OR end_date IS NOT NULL")
def calendar_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marquee.sources.export import calendar_entries

    return calendar_entries(listing(spark, sf_dir).select(F.col("row_no").alias("uid"), "title", "start_date", "end_date")).select(F.col("uid").alias("row_no"), "entry")


# --- more of places, lists and streams ---


@query(", v AS (SELECT venue, count(*) AS n FROM (SELECT unnest(venues) AS venue FROM listing) GROUP BY venue) SELECT venue, n, CAST(row_number() OVER (ORDER BY n DESC, venue) AS BIGINT) AS place FROM v QUALIFY place <= 60")
def venue_picker(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search.venue_counts(searchable(spark, sf_dir), spec_search(FilterSpec()))
    return search.venue_picker(found).select("venue", "n", F.col("place").cast("long").alias("place"))


@query("SELECT row_no, array_to_string(venues[1:4], '・') AS shown, greatest(len(venues) - 4, 0) AS more, coalesce(price_official > price_best, false) OR limited_sale IS NOT NULL AS deal FROM listing")
def lineup(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown, more = search.first_of(F.col("venues"), 4)
    return listing(spark, sf_dir).select("row_no", shown.alias("shown"), more.cast("long").alias("more"), search.deals(F.col("price_official"), F.col("price_best"), F.col("limited_sale")).alias("deal"))


@query("SELECT tab, count(*) AS n, CAST(max(announced_date) AS VARCHAR) AS as_of FROM listing GROUP BY tab")
def directory_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing(spark, sf_dir).groupBy("tab").agg(F.count("*").alias("n"), F.max("announced_date").cast("string").alias("as_of"))


@query("SELECT row_no, tab FROM listing WHERE row_no IN (SELECT event_id * 3 FROM events WHERE event_type = 'click')")
def favourite_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    favourites = read(spark, sf_dir, "events").filter("event_type = 'click'").select("user_id", (F.col("event_id") * 3).alias("uid"))
    return places.favoured(listing(spark, sf_dir), favourites, "row_no").select("row_no", "tab")


@query("WITH t AS (SELECT user_id, event_id % 500 AS uid, count(*) AS n FROM events GROUP BY ALL) SELECT user_id, uid FROM t WHERE n % 2 = 1", base="")
def favourite_toggles(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = read(spark, sf_dir, "events").select("user_id", (F.col("event_id") % 500).alias("uid"))
    return places.toggled(log.limit(0), log)


@query(
    """, named AS (SELECT place, bool_or(located) AS located FROM (SELECT unnest(venues) AS place, lat IS NOT NULL AS located FROM listing) GROUP BY place),
    b AS (SELECT s_name AS place, count(*) AS branches FROM supplier WHERE s_suppkey % 4 = 1 GROUP BY s_name), m AS (SELECT s_name AS place, 'hall' AS kind, s_suppkey * 10 AS capacity FROM supplier WHERE s_suppkey % 3 = 0)
    SELECT place, coalesce(kind, CASE WHEN branches IS NOT NULL THEN 'chain' END) AS kind, capacity, coalesce(branches, 0) AS branches, kind IS NOT NULL OR branches IS NOT NULL OR located AS resolvable FROM named LEFT JOIN m USING (place) LEFT JOIN b USING (place)"""
)
def place_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    own, k = read(spark, sf_dir, "supplier"), F.col("s_suppkey")
    masters = own.filter(k % 3 == 0).select(F.col("s_name").alias("venue"), F.lit("hall").alias("kind"), (k * 10).alias("capacity"), F.lit(35.0).alias("vlat"))
    return places.place_cards(listing(spark, sf_dir), masters, own.filter(k % 4 == 1).select(F.col("s_name").alias("chain")))


@query(ROSTER_SQL + ", a AS (SELECT name FROM (SELECT *, DATE '1998-06-15' - coalesce(last_hit, first_seen) AS idle FROM r) WHERE (status = 'candidate' AND idle > 60) OR (coalesce(status, 'active') = 'active' AND idle > 180)) SELECT name, (SELECT count(*) FROM a) AS total FROM a ORDER BY name LIMIT 20", base="")
def aged_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    aged = roster.age(supplier_roster(spark, sf_dir), TODAY).filter("aged is not null").select("name")
    return aged.orderBy("name").limit(20).withColumn("total", F.lit(aged.count()))


@query("SELECT k AS uid, 1 + CAST(k % 7 <> 0 AS INTEGER) AS n FROM (SELECT row_no AS k, area FROM listing) WHERE k % 9 = 0 OR area = 'NATION_3'")
def previous_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("row_no")
    prev = listing(spark, sf_dir).select(k.alias("uid"), F.col("area").alias("place"), F.when(k % 7 != 0, "x").otherwise("").alias("note"))
    found = reconcile.previous_rows(prev, prev.filter("uid % 9 = 0"), spark.createDataFrame([("NATION_3",)], "place string"))
    return found.select("uid", (F.lit(1) + F.get_json_object("row", "$.note").isNotNull().cast("int")).alias("n"))


@query("SELECT l_suppkey AS place, count(*) AS n, CAST(CAST(max(l_shipdate) AS DATE) AS VARCHAR) AS last_day FROM lineitem GROUP BY l_suppkey", base="")
def streamed_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read(spark, sf_dir, "lineitem")
    return jobs.counted_stream(spark, f"{sf_dir}/lineitem.parque[t]", lines.schema, F.col("l_suppkey"), F.col("l_shipdate")).select("place", "n", F.col("last_day").cast("string").alias("last_day"))
