"""Further registered queries: texts of cards, whole rule catalogue, gates, films, reviews and rosters. What rows need beyond the listing
table is derived by the same SQL expressions on both sides (DERIVED, RAW); results are computed apart."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marquee.functions import cards, exact, sale, schedule, text
from marquee.operators import places, quality, reconcile, roster, search
from marquee.plans.queries import DOTS, MATCHED_SQL, NORM_SQL, PHASED_SQL, ROSTER_SQL, SHORT, SNAP_SQL, STATE_SQL, STATUS_SQL, T, WDAY, query, rename_sides, searchable, snapshots, spec_search, supplier_roster
from marquee.plans.spec import FilterSpec, Search, default_facets, default_flags
from marquee.sources import export
from marquee.sources.adapter import NOW, TABS, TODAY, listing, read
from marquee.sources.scratch import saver

DERIVED = {
    "kana": "CASE WHEN row_no % 3 = 0 THEN lower(area) END",
    "desc": "CASE WHEN row_no % 5 = 0 THEN 'Open Air ' || row_no % 11 WHEN row_no % 5 = 1 THEN '' END",
    "note": "CASE WHEN row_no % 7 = 0 THEN 'Bring a friend' END",
    "source": "CASE WHEN row_no % 4 = 0 THEN 'Tickets ' || row_no % 3 WHEN row_no % 4 = 1 THEN '' END",
    "url": "'https://example.org/' || row_no % 10",
    "official_url": "CASE row_no % 6 WHEN 0 THEN 'https://example.org/' || row_no % 10 WHEN 1 THEN 'javascript:x' WHEN 2 THEN ' https://example.org/o ' END",
    "status": "CASE WHEN row_no % 43 = 0 THEN '通年予約可' WHEN row_no % 47 = 0 THEN 'まもなく開催' WHEN row_no % 53 = 0 THEN '終了' END",
    "coupon_note": "CASE WHEN row_no % 37 = 0 THEN 'coupon' WHEN row_no % 37 = 1 THEN ' ' END",
    "discount_pct": "CASE WHEN row_no % 41 = 0 THEN 10 WHEN row_no % 41 = 1 THEN 0 END",
    "screening_type": "CASE row_no % 4 WHEN 0 THEN 'new' WHEN 1 THEN 'new|3D' WHEN 2 THEN ' Revival ' END",
    "venue": "CASE row_no % 3 WHEN 0 THEN '-' WHEN 1 THEN 'Hall ' || row_no % 9 END",
}
DERIVED_SQL = ", derived AS (SELECT *, " + ", ".join(f'{sql} AS "{name}"' for name, sql in DERIVED.items()) + " FROM listing)"


def derived(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing(spark, sf_dir).withColumns({name: F.expr(sql) for name, sql in DERIVED.items()})


# --- texts of cards ---

PLACES_SQL = "CASE WHEN row_no % 10 = 0 OR len(venues) = 0 THEN CASE WHEN venue IS NULL OR venue IN ('', '-') THEN [] ELSE [venue] END ELSE list_filter(list_transform(venues, lambda v: CASE WHEN ends_with(v, '7') THEN '-' ELSE v END), lambda v: v <> '-') END"


def named(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with their places: some have no list, some of a list's names are dashes."""
    listed = F.transform("venues", lambda v: F.when(v.endswith("7"), "-").otherwise(v))
    return derived(spark, sf_dir).withColumn("names", cards.venue_names(F.when(F.col("row_no") % 10 != 0, listed), F.col("venue")))


@query(DERIVED_SQL + f", n AS (SELECT *, {PLACES_SQL} AS names FROM derived) SELECT row_no, CASE WHEN len(names) = 0 THEN coalesce(area, '') ELSE array_to_string(names, '・') || CASE WHEN area IS NULL OR area = '' OR (len(names) = 1 AND starts_with(names[1], 'Hall')) THEN '' ELSE '／' || area END END AS place FROM n")
def place_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    of_chain = F.coalesce(F.get("names", F.lit(0)).startswith("Hall"), F.lit(False))
    return named(spark, sf_dir).select("row_no", cards.place_line(F.col("names"), F.col("area"), of_chain).alias("place"))


@query(" SELECT row_no, CASE WHEN len(cats) >= 2 THEN '出演：' || array_to_string(cats[1:4], '・') || CASE WHEN len(cats) > 4 THEN '　ほか' || (len(cats) - 4) || '組' ELSE '' END END AS performers FROM listing")
def performer_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing(spark, sf_dir).select("row_no", cards.performer_line(F.col("cats")).alias("performers"))


@query(
    DERIVED_SQL + """ SELECT row_no, CASE WHEN source IS NULL OR source = '' THEN CASE tab WHEN 'event' THEN '予約ページを開く' WHEN 'movie' THEN '上映情報を見る' ELSE 'チケットページを開く' END
    ELSE source || CASE tab WHEN 'event' THEN 'で予約する' WHEN 'movie' THEN 'で上映情報を見る' ELSE 'でチケットを見る' END END AS link,
    CASE WHEN row_no % 6 = 2 THEN 'https://example.org/o' END AS official FROM derived"""
)
def link_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir).select("row_no", cards.link_text(F.col("source"), F.col("tab")).alias("link"), cards.official_link(F.col("official_url"), F.col("url")).alias("official"))


@query(
    DERIVED_SQL + f""", n AS (SELECT *, {PLACES_SQL} AS names, CASE WHEN start_date IS NOT NULL THEN {DOTS("start_date")} || {WDAY("start_date")} END AS d FROM derived)
    SELECT row_no, title || '（' || concat_ws(' / ', d, nullif(CASE WHEN len(names) > 0 THEN array_to_string(names, '・') ELSE area END, '')) || '）' AS shared FROM n"""
)
def share_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    when = F.when(F.col("start_date").isNotNull(), schedule.with_weekday(F.col("start_date")))
    return named(spark, sf_dir).select("row_no", cards.share_text(F.col("title"), when, F.col("names"), F.col("area")).alias("shared"))


WHEN_SQL = lambda d, t: f"{DOTS(d)} || {WDAY(d)} || coalesce(' ' || {t}, '')"


@query(
    f""", s AS (SELECT *, {STATE_SQL} AS state FROM listing), o AS (SELECT series_id, count(*) FILTER (limited_sale IS NOT NULL) AS l, count(*) FILTER (state = 'before') AS b FROM s GROUP BY series_id),
    h AS (SELECT s.*, o.l - CAST(limited_sale IS NOT NULL AS INTEGER) AS ol, o.b - CAST(state = 'before' AS INTEGER) AS ob, onsale_end - {T} AS dl, onsale_start - {T} AS op FROM s JOIN o USING (series_id)),
    notes AS (SELECT *, array_to_string(list_filter([CASE WHEN ol > 0 AND limited_sale IS NULL THEN '他' || ol || '件に限定・追加販売あり' END, CASE WHEN ob > 0 AND state <> 'before' THEN '他' || ob || '件が' || CASE tab WHEN 'event' THEN '受付前' WHEN 'movie' THEN '前売り発売前' ELSE '発売前' END END], lambda x: x IS NOT NULL), '／') AS n FROM h),
    lines AS (SELECT *, list_filter([CASE WHEN state = 'before' THEN {WHEN_SQL("onsale_start", "onsale_time")} || ' 受付開始' || CASE WHEN op BETWEEN 0 AND 14 THEN CASE WHEN op = 0 THEN '（本日）' ELSE '（あと' || op || '日）' END ELSE '' END END,
      CASE WHEN state = 'before' THEN '締切 ' || {WHEN_SQL("onsale_end", "onsale_time")} END, CASE WHEN state = 'open' THEN {WHEN_SQL("onsale_start", "onsale_time")} || ' より受付中' END,
      CASE WHEN state = 'open' THEN '締切 ' || {WHEN_SQL("onsale_end", "onsale_time")} || CASE WHEN dl BETWEEN 0 AND 7 THEN CASE WHEN dl = 0 THEN '（本日開催）' ELSE '（あと' || dl || '日）' END ELSE '' END END,
      '限定・追加販売：' || limited_sale, CASE WHEN n <> '' THEN CASE tab WHEN 'event' THEN 'この巡回展' WHEN 'movie' THEN 'この特集' ELSE 'このツアー' END || '：' || n END], lambda x: x IS NOT NULL) AS ls FROM notes)
    SELECT row_no, CASE WHEN NOT (state = 'unknown' AND limited_sale IS NULL AND ol = 0 AND ob = 0) AND NOT (state = 'closed' AND len(ls) = 0) THEN array_to_string(ls, '|') END AS lines, state = 'open' AND dl BETWEEN 0 AND 7 AS urgent FROM lines"""
)
def sale_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = listing(spark, sf_dir).withColumn("state", sale.state(NOW))
    own = rows.groupBy("series_id").agg(F.count("limited_sale").alias("l"), F.count_if(F.col("state") == "before").alias("b"))
    rows = rows.join(own, "series_id")
    parts = {
        "tab": F.col("tab"), "start": F.col("onsale_start"), "start_time": F.col("onsale_time"), "end": F.col("onsale_end"), "end_time": F.col("onsale_time"), "limited": F.col("limited_sale"),
        "others_limited": F.col("l") - F.col("limited_sale").isNotNull().cast("int"), "others_before": F.col("b") - (F.col("state") == "before").cast("int"),
    }
    lines, urgent = cards.sale_rows(F.col("state"), TODAY, parts)
    return rows.select("row_no", F.array_join(lines, "|").alias("lines"), urgent.alias("urgent"))


@query(
    PHASED_SQL + f""", d AS (SELECT *, list_filter(dates, lambda x: x >= {T})[1] AS nd, backup_date || list_transform(backup_date, lambda x: x + 31) AS bd FROM phased)
    SELECT row_no, CASE WHEN phase = 'gap' THEN {DOTS("nd")} || {WDAY("nd")} END AS next_day, CASE WHEN len(bd) > 0 THEN {DOTS("bd[1]")} || {WDAY("bd[1]")} || '・' || {SHORT("bd[2]", "bd[1]")} END AS backup FROM d"""
)
def other_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    next_day, backup = cards.other_days(TODAY)
    rows = listing(spark, sf_dir)
    both = F.concat("backup_date", F.transform("backup_date", lambda d: F.date_add(d, 31)))
    return rows.select("row_no", next_day.alias("next_day")).join(rows.withColumn("backup_date", both).select("row_no", backup.alias("backup")), "row_no")


# --- search ---


@query(
    DERIVED_SQL + """ SELECT row_no FROM derived WHERE contains(lower(concat_ws(' ', title, kana, venue, area, "desc", note, array_to_string(venues, ' '), array_to_string(cats, ' '))), 'air 3') OR contains(lower(coalesce(note, '')), 'friend')"""
)
def search_haystack(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = derived(spark, sf_dir)
    rows = rows.withColumn("folded", text.fold(text.haystack(rows, [F.col("cats")])))
    return rows.filter(F.col("folded").contains(text.fold_text("ＡＩＲ 3")) | text.has_all_terms("folded", "Friend")).select("row_no")


@query(
    DERIVED_SQL + f""", s AS (SELECT *, {STATE_SQL} AS state, coalesce(discount_pct, 0) <> 0 OR coalesce(coupon_note, '') <> '' AS deal FROM derived)
    SELECT 'dealsOnly' AS flag, count(*) FILTER (deal) AS n FROM s WHERE pref = 'ASIA' UNION ALL SELECT 'onsaleOnly', count(*) FILTER (deal AND state = 'open') FROM s WHERE pref = 'ASIA' UNION ALL SELECT 'limitedOnly', count(*) FILTER (deal AND limited_sale IS NOT NULL) FROM s WHERE pref = 'ASIA'
    UNION ALL SELECT 'beforeOnly', count(*) FILTER (deal AND state = 'before') FROM s WHERE pref = 'ASIA' UNION ALL SELECT 'newOnly', count(*) FILTER (deal AND (is_additional OR coalesce({T} - announced_date BETWEEN 0 AND 7, false))) FROM s WHERE pref = 'ASIA'"""
)
def deals_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = Search(FilterSpec(flags=frozenset({"dealsOnly"}), pref="ASIA"), default_facets(), [*default_flags(TODAY, NOW), search.deals_flag()])
    return search.flag_counts(derived(spark, sf_dir).withColumn("folded", F.lit("")), wanted)


@query(MATCHED_SQL + ", c AS (SELECT *, pow(sin(radians(lat - 35.0) / 2), 2) + cos(radians(35.0)) * cos(radians(lat)) * pow(sin(radians(lng - 139.5) / 2), 2) AS h FROM m) SELECT count(*) FILTER (base AND m_cats AND m_tab AND m_new AND 2 * 6371.0 * atan2(sqrt(h), sqrt(1 - h)) <= 80) AS n FROM c")
def live_circle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.in_live_circle(searchable(spark, sf_dir), spec_search(), 35.0, 139.5, 80.0)


# --- films, snapshots, gates ---

FILM_SQL = f"""array_to_string([{NORM_SQL.format("title")}, coalesce(replace(CAST(start_date AS VARCHAR), '-', ''), ''), {NORM_SQL.format("coalesce(screening_type, '')")},
  CASE WHEN starts_with(coalesce(screening_type, ''), 'new') THEN '' ELSE coalesce({NORM_SQL.format("venues[1]")}, '') END], chr(31))"""


@query(DERIVED_SQL + f", k AS (SELECT row_no, sha1({FILM_SQL}) AS uid FROM derived WHERE tab = 'movie') SELECT row_no, uid, left(uid, 8) AS short FROM k")
def film_uid(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = text.film_key(F.col("title"), F.col("start_date"), F.col("screening_type"), F.array_join("venues", "|"))
    return derived(spark, sf_dir).filter("tab = 'movie'").select("row_no", text.key_uid(key).alias("uid"), text.key_uid(key, 8).alias("short"))


FILM_SQL = """, fk AS (SELECT id, row_no, nt AS t, coalesce(replace(CAST(start_date AS VARCHAR), '-', ''), '') AS d, lower(regexp_replace(coalesce(screening_type, ''), '[^A-Za-z0-9]', '', 'g')) AS y,
    CASE WHEN starts_with(trim(coalesce(screening_type, '')), 'new') THEN '' ELSE coalesce(lower(regexp_replace(venues[1], '[^A-Za-z0-9]', '', 'g')), '') END AS p FROM (SELECT *, lower(regexp_replace(title, '[^A-Za-z0-9]', '', 'g')) AS nt FROM derived WHERE tab = 'movie')),
    fu AS (SELECT *, sha1(t || chr(31) || d || chr(31) || y || chr(31) || p) AS uid FROM fk), fp AS (SELECT * FROM fu WHERE id % 20 <> 3 QUALIFY row_number() OVER (PARTITION BY uid ORDER BY row_no DESC) = 1),
    fc AS (SELECT * FROM fu WHERE id % 20 <> 7 QUALIFY row_number() OVER (PARTITION BY uid ORDER BY row_no DESC) = 1), fgone AS (SELECT * FROM fp WHERE uid NOT IN (SELECT uid FROM fc)), fadd AS (SELECT * FROM fc WHERE uid NOT IN (SELECT uid FROM fp)),
    letters AS (SELECT chr(CAST(i + 96 AS INTEGER)) AS ch FROM range(1, 27) t(i) UNION ALL SELECT chr(CAST(i + 47 AS INTEGER)) FROM range(1, 11) t(i)),
    sims AS (SELECT x.t AS ta, y.t AS tb, sum(least(len(x.t) - len(replace(x.t, ch, '')), len(y.t) - len(replace(y.t, ch, '')))) / CAST(least(len(x.t), len(y.t)) AS DOUBLE) AS score FROM (SELECT DISTINCT t FROM fgone) x, (SELECT DISTINCT t FROM fadd) y, letters WHERE x.t <> '' AND y.t <> '' GROUP BY x.t, y.t)"""


@query(
    DERIVED_SQL + FILM_SQL + """ SELECT g.uid AS prev_uid, a.uid AS uid, round(score, 6) AS score FROM fgone g JOIN sims ON g.t = ta JOIN fadd a ON a.t = tb
    WHERE score >= 0.82 OR (score >= 0.45 AND len(list_filter([g.d, g.y, g.p], lambda x: x <> '')) >= 2 AND len(list_distinct(list_filter([g.d, g.y, g.p], lambda x: x <> '' AND list_contains([a.d, a.y, a.p], x)))) >= len(list_filter([g.d, g.y, g.p], lambda x: x <> '')))"""
)
def film_renames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Films by their key of four parts: gone and new ones that may be the same."""
    films = derived(spark, sf_dir).filter("tab = 'movie'")
    films = films.withColumn("key", text.film_key(F.col("title"), F.col("start_date"), F.col("screening_type"), F.array_join("venues", "|"))).withColumn("uid", text.key_uid(F.col("key"))).select("uid", "row_no", "id", "key")
    films = saver(spark)(films)
    prev, cur = (reconcile.last_per_uid(films.filter(F.col("id") % 20 != k)) for k in (3, 7))
    return reconcile.renames_by_key(reconcile.gone(prev, cur), reconcile.added(prev, cur), save=saver(spark), digits=6)


UID_SQL = """, p AS (SELECT row_no, concat_ws('|', nullif(title, ''), nullif(venues[1], ''), CAST(start_date AS VARCHAR)) || '|😀' AS s FROM listing),
h AS (SELECT row_no, list_reduce(list_prepend(CAST(5381 AS BIGINT), flatten(list_transform(list_filter(string_split(s, ''), lambda c: c <> ''), lambda c: CASE WHEN unicode(c) > 65535 THEN [CAST(55296 + (unicode(c) - 65536) // 1024 AS BIGINT), CAST(56320 + (unicode(c) - 65536) % 1024 AS BIGINT)] ELSE [CAST(unicode(c) AS BIGINT)] END))), lambda h, c: (h * 33 + c) % 4294967296) AS h FROM p)"""


@query(UID_SQL + " SELECT row_no, ltrim(array_to_string(list_transform([6, 5, 4, 3, 2, 1, 0], lambda i: substr('0123456789abcdefghijklmnopqrstuvwxyz', CAST(h // CAST(pow(36, i) AS BIGINT) % 36 AS INTEGER) + 1, 1)), ''), '0') AS uid FROM h")
def content_uid_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing(spark, sf_dir).select("row_no", text.content_uid(F.col("title"), F.get("venues", F.lit(0)), F.col("start_date"), F.lit("😀")).alias("uid"))


#: Of the gone rows two thirds are explained here, so that some are left.
TOLD = "row_no % 3 <> 0"


@query(SNAP_SQL + f" SELECT uid, row_no FROM gone WHERE NOT ({TOLD})")
def diff_open(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = reconcile.gone(*snapshots(spark, sf_dir))
    return reconcile.unexplained(gone, gone.filter(TOLD), spark.createDataFrame([], "prev_uid string")).select("uid", "row_no")


@query(None)
def diff_open_renamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As diff_open, but rows that were given a new name are explained too."""
    gone = reconcile.gone(*snapshots(spark, sf_dir))
    return reconcile.unexplained(gone, gone.filter(TOLD), reconcile.assign_renames(*rename_sides(spark, sf_dir), saver(spark))).select("uid", "row_no")


@query(
    SNAP_SQL + f""", x AS (SELECT count(*) AS n FROM prev p JOIN cur c USING (uid) WHERE p.end_date IS DISTINCT FROM c.end_date OR p.onsale_label IS DISTINCT FROM c.onsale_label)
    SELECT (SELECT count(*) FROM prev) AS previous, (SELECT count(*) FROM cur) AS current, (SELECT count(*) FROM added) AS added, (SELECT count(*) FROM gone) AS gone, (SELECT n FROM x) AS changed,
    (SELECT count(*) FROM gone WHERE {TOLD}) AS explained, (SELECT count(*) FROM gone WHERE NOT ({TOLD})) AS unexplained"""
)
def diff_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    prev, cur = snapshots(spark, sf_dir)
    none = spark.createDataFrame([], "prev_uid string")
    return reconcile.summary(prev, cur, reconcile.changed(prev, cur, ["end_date", "onsale_label"]), reconcile.gone(prev, cur).filter(TOLD), none)


@query(SNAP_SQL + f" SELECT count(*) FILTER (NOT ({TOLD})) AS unexplained, count(*) FILTER (NOT ({TOLD})) = 0 AS publish FROM gone")
def diff_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = reconcile.gone(*snapshots(spark, sf_dir))
    return reconcile.gate(reconcile.unexplained(gone, gone.filter(TOLD), spark.createDataFrame([], "prev_uid string")))


@query(SNAP_SQL + """ SELECT 'gone' AS part, uid, '{"uid":"' || uid || '","row_no":' || row_no || '}' AS line FROM gone UNION ALL SELECT 'added', uid, '{"uid":"' || uid || '","row_no":' || row_no || '}' FROM added""")
def diff_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    prev, cur = snapshots(spark, sf_dir)
    return reconcile.report({"gone": reconcile.gone(prev, cur).select("uid", "row_no"), "added": reconcile.added(prev, cur).select("uid", "row_no")})


@query("SELECT row_no AS uid, row_no + 1 AS wanted FROM listing WHERE row_no % 6 = 1 AND row_no % 4 = 1 AND (row_no + 1) NOT IN (SELECT row_no FROM listing WHERE row_no % 5 <> 0)")
def carry_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, k = listing(spark, sf_dir).select("row_no"), F.col("row_no")
    batch = rows.select(k.alias("uid"), F.when(k % 4 == 1, F.array(F.lit("title"))).alias("carry"), F.when(k % 6 == 1, k + 1).alias("carry_from"))
    return reconcile.carry_misses(batch.filter("carry_from is not null"), rows.filter("row_no % 5 <> 0").select(k.alias("uid")))


@query(
    """, f AS (SELECT area AS place, min(limited_sale) AS l FROM listing WHERE area IS NOT NULL GROUP BY area), b AS (SELECT row_no, area AS place, row_no % 2 = 1 AS blank, row_no % 4 = 0 AS asks, row_no % 3 = 0 AND onsale_label IS NOT NULL AS has FROM listing),
    j AS (SELECT b.*, o.title, o.onsale_label, o.limited_sale, f.l FROM b LEFT JOIN (SELECT * FROM listing WHERE row_no % 5 <> 0) o USING (row_no) LEFT JOIN f USING (place))
    SELECT 'always' AS kind, count(*) FILTER (blank AND title IS NOT NULL) + count(*) FILTER (limited_sale IS NOT NULL) AS n FROM j UNION ALL SELECT 'asked', count(*) FILTER (asks AND NOT has AND onsale_label IS NOT NULL) FROM j UNION ALL SELECT 'place', count(*) FILTER (limited_sale IS NULL AND l IS NOT NULL) FROM j"""
)
def fill_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, k = listing(spark, sf_dir), F.col("row_no")
    prev = rows.filter("row_no % 5 <> 0").select(k.alias("uid"), "title", "onsale_label", "limited_sale")
    facts = rows.filter("area is not null").groupBy(F.col("area").alias("place")).agg(F.min("limited_sale").alias("limited_sale"))
    batch = rows.select(k.alias("uid"), F.col("area").alias("place"), F.when(k % 2 == 0, F.col("title")).alias("title"), F.when(k % 3 == 0, F.col("onsale_label")).alias("onsale_label"), F.lit(None).cast("string").alias("limited_sale"), F.when(k % 4 == 0, F.array(F.lit("onsale_label"))).alias("carry"), F.lit(None).cast("long").alias("carry_from"))
    return reconcile.fill_statistics(reconcile.carry_forward(batch, prev, facts, ["title", "limited_sale"], ["limited_sale"]))


@query("SELECT 'extra' || row_no % 7 AS field, count(*) AS n FROM listing WHERE row_no % 3 = 0 GROUP BY ALL")
def unknown_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("row_no")
    fields = F.create_map(F.lit("title"), F.col("title"), F.lit("_carry"), F.lit("x"), F.when(k % 3 == 0, F.concat(F.lit("extra"), k % 7)).otherwise("area"), F.lit("y"))
    return reconcile.unknown_fields(listing(spark, sf_dir).select(fields.alias("fields")), "fields", ["title", "area"])


# --- review and rosters ---

TIER_SQL = DERIVED_SQL + f""", priced AS (SELECT * EXCLUDE (price_official, price_best), CASE WHEN row_no % 3 = 0 THEN price_official END AS price_official, CASE WHEN row_no % 9 = 0 THEN price_best END AS price_best FROM derived),
why AS (SELECT *, [coalesce(status IN ('本日開催', 'まもなく開催', '本日が最終上映', 'まもなく公開'), false), coalesce(end_date <= {T} + 21, false), coalesce(start_date >= {T} AND start_date <= {T} + 21, false), coalesce(onsale_end <= {T} + 21, false),
  coalesce(onsale_start >= {T}, false), onsale_label IS NOT NULL AND onsale_end IS NULL, trim(coalesce(coupon_note, '')) <> '', is_additional,
  (price_official IS NOT NULL OR price_best IS NOT NULL OR discount_pct IS NOT NULL) AND (announced_date IS NULL OR {T} - announced_date > 14)] AS r FROM priced),
tiers AS (SELECT row_no, len(list_filter(r, lambda x: x)) AS n_reasons, CASE WHEN len(list_filter(r, lambda x: x)) > 0 THEN 'A' WHEN coalesce(status = '通年予約可', false) OR (start_date IS NULL AND end_date IS NULL) THEN 'C' ELSE 'B' END AS tier FROM why)"""


def review_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("row_no")
    return derived(spark, sf_dir).withColumns({"price_checked": F.col("announced_date"), "price_official": F.when(k % 3 == 0, F.col("price_official")), "price_best": F.when(k % 9 == 0, F.col("price_best"))})


@query(TIER_SQL + " SELECT * FROM tiers")
def review_tier_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = review_rows(spark, sf_dir)
    tier, reasons = roster.review(TODAY, rows.columns)
    return rows.select("row_no", F.size(reasons).cast("long").alias("n_reasons"), tier.alias("tier"))


@query(TIER_SQL + " SELECT row_no FROM tiers WHERE tier IN ('B', 'C')")
def worklist_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return roster.worklist(review_rows(spark, sf_dir), TODAY, ["B", "C"]).select("row_no")


@query(
    ROSTER_SQL + """, i AS (SELECT *, DATE '1998-06-15' - coalesce(last_hit, first_seen) AS idle, CASE WHEN k % 3 = 0 THEN 'old' END AS note FROM r)
    SELECT k, CASE WHEN status = 'candidate' AND idle > 60 THEN coalesce(note, '') || '（1998-06-15 自動整理: ' || idle || '日間ヒットなし）' WHEN coalesce(status, 'active') = 'active' AND idle > 180 THEN coalesce(note, '') || '（1998-06-15 自動降格: ' || idle || '日間ヒットなし）' ELSE note END AS note FROM i""",
    base="",
)
def roster_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = supplier_roster(spark, sf_dir).withColumn("note", F.when(F.col("k") % 3 == 0, "old"))
    return roster.age(own, TODAY).select("k", "note")


@query("""WITH b AS (SELECT 'New ' || c_custkey % 1000 AS name, c_custkey AS seq FROM customer WHERE c_custkey % 5 < 3) SELECT name, min(seq) AS seq FROM b GROUP BY name""", base="")
def roster_add_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    url = F.when(k % 5 == 0, "https://a.example").when(k % 5 == 1, " ").when(k % 5 == 3, "javascript:x").when(k % 5 == 4, "a.example")
    batch = read(spark, sf_dir, "customer").select(F.concat(F.lit("New "), (k % 1000).cast("string")).alias("name"), k.alias("seq"), url.alias("url"), k.alias("source"))
    return roster.add(supplier_roster(spark, sf_dir), batch, TODAY).select("name", F.col("source").alias("seq"))


@query(ROSTER_SQL + " SELECT pref AS dataset, count(*) AS rows, count(*) FILTER (coalesce(status, '') IN ('', 'active')) AS active, count(*) FILTER (k % 2 = 0) AS unknown FROM r GROUP BY pref", base="")
def roster_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per area, by one grouped pass; active_rows and without_link give the same for a roster as a whole."""
    blank = F.trim(F.coalesce("status", F.lit(""))).isin("", "active")
    rows = supplier_roster(spark, sf_dir).withColumn("url", F.when(F.col("k") % 2 == 1, "https://a.example"))
    return rows.groupBy(F.col("pref").alias("dataset")).agg(F.count("*").alias("rows"), F.count_if(blank).alias("active"), F.count_if(F.col("url").isNull()).alias("unknown"))


@query(
    """WITH s AS (SELECT count(*) AS n, count(*) FILTER (s_suppkey % 2 = 0) AS half FROM supplier) SELECT 'closed' AS dataset, 'K58' AS rule, 'status' AS "column", CAST(half AS VARCHAR) AS value FROM s WHERE half > 0
    UNION ALL SELECT 'none', 'K3', NULL, NULL FROM s UNION ALL SELECT 'gone', 'K1', NULL, NULL FROM s UNION ALL SELECT 'header', 'K2', 'kind', 'missing' FROM s UNION ALL SELECT 'header', 'K2', 's_phone', 'extra' FROM s WHERE n >= 0""",
    base="",
)
def dq_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    supplier = read(spark, sf_dir, "supplier")
    own = supplier.select("s_suppkey", "s_name", F.lit("retired").alias("status"))
    found = quality.inactive_roster(own.filter("s_suppkey % 2 = 0"), "closed")
    for name, rows, wanted in (("none", own.filter("s_suppkey < 0"), own.columns), ("gone", None, own.columns), ("header", supplier.select("s_suppkey", F.lit("").alias("s_phone")), ["s_suppkey", "kind"]), ("sound", own, own.columns)):
        found = found.union(quality.file_violations(name, rows, wanted, spark))
    return found.select("dataset", "rule", "column", "value")


# --- the rule catalogue ---

_D = lambda c: f"coalesce(CAST({c} AS STRING), '')"
RAW = {
    "tab": "tab",
    "title": "CASE WHEN row_no % 101 = 0 THEN ' ' ELSE title END",
    "start_date": f"CASE WHEN row_no % 10 = 0 THEN '1998-2-30' WHEN row_no % 10 = 1 THEN '1998-02-30' ELSE {_D('start_date')} END",
    "end_date": f"CASE WHEN row_no % 12 = 0 THEN '1990-01-01' ELSE {_D('end_date')} END",
    "announced_date": f"CASE WHEN row_no % 15 = 0 THEN 'soon' ELSE {_D('announced_date')} END",
    "onsale_start": _D("onsale_start"),
    "onsale_end": f"CASE WHEN row_no % 14 = 0 THEN '' ELSE {_D('onsale_end')} END",
    "onsale_start_time": "CASE row_no % 3 WHEN 0 THEN '10:00' WHEN 1 THEN '10' ELSE '' END",
    "onsale_end_time": "CASE row_no % 7 WHEN 0 THEN '9:30' WHEN 1 THEN '9.30' ELSE '' END",
    "dates": "CASE row_no % 8 WHEN 0 THEN '1998-01-05|1998-01-03' WHEN 1 THEN '1998-01-05' WHEN 2 THEN '1998-01-03|bad|1998-02-31|1998-01-04' WHEN 3 THEN '|' ELSE '' END",
    "backup_date": "CASE row_no % 9 WHEN 0 THEN '1990-01-01' WHEN 1 THEN '1998-13-01' WHEN 2 THEN 'later' WHEN 3 THEN '1996-06-01|2000-01-01' ELSE '' END",
    "open_time": "CASE row_no % 5 WHEN 0 THEN '18:30' WHEN 1 THEN '1830' ELSE '' END",
    "start_time": "CASE row_no % 6 WHEN 0 THEN '18:00' WHEN 1 THEN '9:00' ELSE '' END",
    "end_time": "CASE row_no % 4 WHEN 0 THEN '21:00' WHEN 1 THEN 'late' ELSE '' END",
    "date": "CASE row_no % 11 WHEN 0 THEN '3月ごろ' WHEN 1 THEN '秋' WHEN 2 THEN '未定' ELSE '' END",
    "status": "CASE row_no % 6 WHEN 0 THEN '終了' WHEN 1 THEN 'odd' ELSE '' END",
    "rank": "CASE row_no % 13 WHEN 2 THEN '3' ELSE '' END",
    "is_additional": "CASE row_no % 5 WHEN 0 THEN 'TRUE' WHEN 1 THEN 'maybe' WHEN 2 THEN '0' ELSE '' END",
    "cats": "CASE row_no % 5 WHEN 0 THEN 'art| zoo ' WHEN 1 THEN 'food' WHEN 2 THEN '|' ELSE 'art|food' END",
    "pref": "CASE row_no % 6 WHEN 0 THEN '' ELSE pref END",
    "url": "CASE row_no % 5 WHEN 0 THEN 'https://a.example' WHEN 1 THEN 'http://a.example' WHEN 2 THEN 'a.example' ELSE '' END",
    "official_url": "CASE row_no % 4 WHEN 0 THEN 'HTTP://b.example' ELSE '' END",
    "apple_music_url": "CASE row_no % 4 WHEN 0 THEN 'https://music.apple.com/jp/artist/1' WHEN 1 THEN 'https://music.apple.com/jp/album/1' WHEN 2 THEN 'https://m.example/artist/' ELSE '' END",
    "source": "CASE row_no % 9 WHEN 0 THEN 'https://s.example' ELSE 'Site' END",
    "lat": "CASE row_no % 7 WHEN 0 THEN '' WHEN 1 THEN 'north' WHEN 2 THEN '38.5' ELSE '35.5' END",
    "lng": "CASE row_no % 8 WHEN 0 THEN '' WHEN 1 THEN '137.5' ELSE '139.5' END",
    "price_official": "CASE row_no % 7 WHEN 0 THEN '' WHEN 1 THEN '0' WHEN 2 THEN 'free' ELSE '2800' END",
    "price_best": "CASE row_no % 5 WHEN 0 THEN '' WHEN 1 THEN '3000' ELSE '2380' END",
    "best_source": "CASE row_no % 3 WHEN 0 THEN '' ELSE 'Shop' END",
    "discount_pct": "CASE row_no % 4 WHEN 0 THEN '' WHEN 1 THEN '15' WHEN 2 THEN '40' ELSE 'half' END",
    "price_condition": "CASE row_no % 3 WHEN 1 THEN 'members' ELSE '' END",
    "price_checked": "CASE row_no % 2 WHEN 1 THEN '1998-06-01' ELSE '' END",
}
STATUSES, PREFS, CATS = ["終了", "開催中"], ["ASIA", "AFRICA", "EUROPE"], ["art", "food"]


def raw_rules_sql() -> str:
    """Each rule written as a condition over the cells of `raw`, whose text columns have the same names."""
    is_day = lambda c: f"regexp_full_match({c}, '\\d{{4}}-\\d{{2}}-\\d{{2}}')"
    real = lambda c: f"(CASE WHEN {is_day(c)} THEN TRY_CAST({c} AS DATE) END)"
    parts = lambda c: f"list_filter(list_transform(string_split({c}, '|'), lambda x: trim(x)), lambda x: x <> '')"
    days = lambda c: f"list_filter(list_transform({parts(c)}, lambda x: {real('x')}), lambda x: x IS NOT NULL)"
    some = lambda xs, cond: f"len(list_filter({xs}, lambda x: {cond})) > 0"
    hour = lambda c: f"({c} <> '' AND NOT regexp_full_match({c}, '\\d{{1,2}}:\\d{{2}}'))"
    dated, s, e = "(start_date <> '' OR end_date <> '')", real("start_date"), real("end_date")
    whole = lambda c: f"(CASE WHEN regexp_full_match({c}, '-?\\d+') THEN CAST({c} AS BIGINT) END)"
    po, pb, pct = map(whole, ("price_official", "price_best", "discount_pct"))
    rules = [("K4", "title", "trim(title) = ''")]
    for c in ("start_date", "end_date", "announced_date", "onsale_start", "onsale_end"):
        rules += [("K6", c, f"{c} <> '' AND NOT {is_day(c)}"), ("K7", c, f"{is_day(c)} AND TRY_CAST({c} AS DATE) IS NULL")]
    for c in ("dates", "backup_date"):
        rules += [("K6", c, some(parts(c), f"NOT {is_day('x')}")), ("K7", c, some(parts(c), f"{is_day('x')} AND TRY_CAST(x AS DATE) IS NULL"))]
    rules += [
        ("K8", "end_date", f"{e} < {s}"), ("K9", "start_date", "start_date = '' AND end_date = ''"), ("K10", "dates", f"len({parts('dates')}) > 0 AND len({days('dates')}) < 2"),
        ("K11", "dates", f"len({days('dates')}) > 1 AND {days('dates')} <> list_sort({days('dates')})"), ("K12", "dates", f"len({days('dates')}) > 0 AND {days('dates')}[1] IS DISTINCT FROM {s}"),
        ("K13", "dates", f"len({days('dates')}) > 0 AND {days('dates')}[-1] IS DISTINCT FROM {e}"), ("K15", "end_time", "end_time <> '' AND start_time = ''"), ("K16", "open_time", "len(open_time) = len(start_time) AND open_time > start_time"),
        ("K17", "backup_date", some(days("backup_date"), f"x BETWEEN {s} AND coalesce({e}, {s})")), ("K18", "backup_date", some(days("backup_date"), f"x < {s}")), ("K19", "date", "date <> ''"),
        ("K20", "date", "regexp_matches(date, '\\d{1,2}月|[春夏秋冬]') AND start_date = '' AND end_date = '' AND dates = ''"), ("K21", "end_date", f"tab = 'live' AND {s} IS NOT NULL AND end_date = ''"),
        ("K22", "status", "status <> '' AND status NOT IN ('終了', '開催中')"), ("K23", "status", f"{dated} AND (status <> '' OR \"rank\" <> '')"), ("K24", "status", f"NOT {dated} AND status = ''"),
        ("K25", "onsale_end", f"{real('onsale_end')} < {real('onsale_start')}"), ("K28", "is_additional", "lower(is_additional) NOT IN ('', '0', '1', 'true', 'false', 'yes', 'no')"),
        ("K29", "cats", some(parts("cats"), "x NOT IN ('art', 'food')")), ("K30", "cats", f"len({parts('cats')}) = 0"), ("K31", "pref", "pref NOT IN ('ASIA', 'AFRICA', 'EUROPE')"), ("K34", "url", "url = '' AND official_url = ''"),
        ("K35", "apple_music_url", "apple_music_url <> '' AND NOT starts_with(apple_music_url, 'https://music.apple.com/')"), ("K36", "apple_music_url", "apple_music_url <> '' AND NOT contains(apple_music_url, '/artist/')"), ("K37", "source", "starts_with(source, 'https://')"),
        ("K38", "lat", "lat = 'north'"), ("K39", "lat", "TRY_CAST(lat AS DOUBLE) NOT BETWEEN 34.5 AND 37.5"), ("K39", "lng", "TRY_CAST(lng AS DOUBLE) NOT BETWEEN 138 AND 141.5"), ("K40", "lat", "(lat = '') <> (lng = '')"),
        ("K41", "price_best", "price_best <> '' AND price_official = ''"), ("K42", "best_source", "price_best <> '' AND best_source = ''"), ("K43", "price_best", f"{pb} > {po}"),
        ("K44", "discount_pct", f"{po} > 0 AND abs(round_even(({po} - {pb}) * 100.0 / {po}, 0) - {pct}) > 2"), ("K45", "price_official", f"(price_official <> '' AND {po} IS NULL) OR (discount_pct <> '' AND {pct} IS NULL) OR {po} = 0"),
        ("K46", "discount_pct", "discount_pct <> '' AND price_condition = ''"), ("K47", "price_official", "price_official <> '' AND price_checked = ''"),
    ]
    rules += [("K14", c, hour(c)) for c in ("open_time", "start_time", "end_time")]
    for c in ("onsale_start", "onsale_end"):
        rules += [("K26", f"{c}_time", hour(f"{c}_time")), ("K27", f"{c}_time", f"{c}_time <> '' AND {c} = ''")]
    for c in ("url", "official_url", "apple_music_url"):
        rules += [("K32", c, f"{c} <> '' AND NOT regexp_matches({c}, '^https?://', 'i')"), ("K33", c, f"starts_with(lower({c}), 'http://')")]
    return ", raw AS (SELECT row_no, " + ", ".join(f'{sql} AS "{c}"' for c, sql in RAW.items()) + " FROM listing)" + " UNION ALL ".join(f" SELECT row_no, '{r}' AS rule, '{c}' AS \"column\" FROM raw WHERE {cond}" for r, c, cond in rules)


@query(raw_rules_sql())
def dq_all_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = listing(spark, sf_dir).select("row_no", *[F.expr(sql).alias(c) for c, sql in RAW.items()])
    return quality.violations(raw, quality.raw_rules(raw.columns, STATUSES, PREFS, {"cats": CATS}), "listing").select("row_no", "rule", "column")


ROSTER_RAW = {
    "name": "CASE WHEN s_suppkey % 10 = 0 THEN '' ELSE s_name END", "kind": "CASE s_suppkey % 3 WHEN 0 THEN 'hall' WHEN 1 THEN 'barn' ELSE '' END", "pref": "CASE s_suppkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'X' ELSE 'ASIA' END",
    "url": "CASE s_suppkey % 5 WHEN 0 THEN 'x.example' WHEN 1 THEN 'http://x.example' ELSE '' END", "lat": "CASE s_suppkey % 6 WHEN 0 THEN 'n' WHEN 1 THEN '30' ELSE '35' END", "status": "CASE s_suppkey % 5 WHEN 0 THEN 'open' WHEN 1 THEN '' ELSE 'active' END",
    "first_seen": "CASE s_suppkey % 4 WHEN 0 THEN '1998-02-30' WHEN 1 THEN '1998' ELSE '1998-01-01' END", "hit_count": "CASE s_suppkey % 3 WHEN 0 THEN '-1' WHEN 1 THEN '12' ELSE '' END",
}


@query(
    "WITH r AS (SELECT s_suppkey AS row_no, " + ", ".join(f'{sql} AS "{c}"' for c, sql in ROSTER_RAW.items()) + """ FROM supplier) SELECT row_no, 'K49' AS rule FROM r WHERE name = '' UNION ALL SELECT row_no, 'K51' FROM r WHERE pref = 'X' UNION ALL SELECT row_no, 'K52' FROM r WHERE kind = 'barn'
    UNION ALL SELECT row_no, 'K55' FROM r WHERE status = 'open' UNION ALL SELECT row_no, 'K56' FROM r WHERE first_seen IN ('1998-02-30', '1998') UNION ALL SELECT row_no, 'K57' FROM r WHERE hit_count = '-1' UNION ALL SELECT row_no, 'K54/K32' FROM r WHERE url = 'x.example'
    UNION ALL SELECT row_no, 'K54/K33' FROM r WHERE url = 'http://x.example' UNION ALL SELECT row_no, 'K54/K38' FROM r WHERE lat = 'n' UNION ALL SELECT row_no, 'K54/K39' FROM r WHERE lat = '30' UNION ALL SELECT row_no, 'K50' FROM (SELECT row_no, name, row_number() OVER (PARTITION BY name ORDER BY row_no) AS i FROM r) WHERE name = '' AND i > 1""",
    base="",
)
def dq_roster_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("row_no"), *[F.expr(sql).alias(c) for c, sql in ROSTER_RAW.items()])
    found = quality.violations(rows, quality.roster_rules(rows.columns, prefs=["ASIA"], kinds=["hall"]), "places")
    return found.unionByName(quality.repeated(rows, "name", "K50", quality.ERROR, "places", first=True)).select("row_no", "rule")


# --- labels, links, facts and rejects ---

LABELS = {"ECONOMY": "おとくな品", "PROMO": "目玉", "LARGE": "Grand"}


@query(
    STATUS_SQL + """ SELECT row_no, contains(hay, 'まもなく開催') AS soon, contains(hay, 'おとくな品') AS cheap, contains(hay, 'grand') AS grand FROM (SELECT row_no, lower(concat_ws(' ', title, area, array_to_string(venues, ' '),
    array_to_string(list_transform(cats, lambda c: CASE c WHEN 'ECONOMY' THEN 'おとくな品' WHEN 'PROMO' THEN '目玉' WHEN 'LARGE' THEN 'Grand' ELSE c END), ' '), status)) AS hay FROM stated) WHERE contains(hay, 'まもなく開催') OR contains(hay, 'おとくな品') OR contains(hay, 'grand')"""
)
def search_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is searched holds the labels of a row's categories and of its status of the day, not their keys."""
    rows = listing(spark, sf_dir)
    labels = [F.transform("cats", lambda c: text.label(LABELS, c)), F.array_compact(F.array(schedule.status(TODAY)))]
    folded = exact.with_norms(rows, {"folded": (text.haystack(rows, labels), exact.SEARCH)})
    met = {name: F.col("folded").contains(text.fold_text(term)) for name, term in (("soon", "マモナク開催"), ("cheap", "オトクナ品"), ("grand", "ＧＲＡＮＤ"))}
    return folded.select("row_no", *[c.alias(n) for n, c in met.items()]).filter("soon or cheap or grand")


@query(
    """WITH b AS (SELECT c_custkey AS seq, CASE WHEN c_custkey % 11 = 0 THEN ' ' WHEN c_custkey % 7 = 0 THEN 'SUPPLIER#' || lpad(CAST(c_custkey % 20 AS VARCHAR), 9, '0') ELSE 'New ' || c_custkey % 1000 END AS name, c_custkey % 5 = 3 AS bad FROM customer),
    s AS (SELECT *, CASE WHEN trim(name) = '' THEN 'no name' WHEN bad THEN 'bad link' END AS early FROM b), f AS (SELECT lower(name) AS k, min(seq) AS first FROM s WHERE early IS NULL GROUP BY lower(name)),
    r AS (SELECT seq, name, coalesce(early, CASE WHEN lower(name) IN (SELECT lower(s_name) FROM supplier) THEN 'known' WHEN seq > first THEN 'repeated' END) AS reason FROM s LEFT JOIN f ON f.k = lower(name)) SELECT * FROM r WHERE reason IS NOT NULL""",
    base="",
)
def roster_add_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    name = F.when(k % 11 == 0, " ").when(k % 7 == 0, F.concat(F.lit("SUPPLIER#"), F.lpad((k % 20).cast("string"), 9, "0"))).otherwise(F.concat(F.lit("New "), (k % 1000).cast("string")))
    batch = read(spark, sf_dir, "customer").select(k.alias("seq"), name.alias("name"), F.when(k % 5 == 3, "javascript:x").when(k % 5 == 0, "https://a.example").alias("url"))
    return roster.add_rejects(supplier_roster(spark, sf_dir), batch)


@query(
    """, n AS (SELECT DISTINCT unnest(venues) AS place FROM listing UNION SELECT n_name FROM nation UNION SELECT 'nowhere'), s AS (SELECT s_suppkey, s_name, n_name AS nation, r_name FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
    c AS (SELECT nation AS chain, count(*) AS k FROM s WHERE s_suppkey % 3 = 2 GROUP BY nation)
    SELECT place, CASE WHEN s.s_suppkey % 3 = 0 THEN concat_ws('　', CASE WHEN s.s_suppkey % 2 = 0 THEN 'Hall' ELSE 'tent' END, CASE WHEN s.s_suppkey > 0 THEN '収容 約' || format('{:,}', s.s_suppkey * 100) || '人' END, s.nation) WHEN s.s_suppkey % 3 = 1 THEN s.nation || '　' || r_name WHEN c.k IS NOT NULL THEN '関東の店舗 ' || c.k || '件' ELSE '' END AS facts,
    CASE WHEN s.s_suppkey % 3 < 2 AND s.s_suppkey % 5 = 0 THEN 'https://a.example/' || s.s_suppkey END AS site FROM n LEFT JOIN s ON s.s_name = place LEFT JOIN c ON c.chain = place"""
)
def place_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is said about every place, and its site."""
    k = F.col("s_suppkey")
    own = read(spark, sf_dir, "supplier").join(read(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    url = F.when(k % 5 == 0, F.concat(F.lit(" https://a.example/"), k.cast("string"))).when(k % 5 == 1, "javascript:x").when(k % 5 == 2, "").alias("url")
    venues = own.filter(k % 3 == 0).select(F.col("s_name").alias("venue"), F.when(k % 2 == 0, "hall").otherwise("tent").alias("kind"), (k * 100).alias("capacity"), F.col("n_name").alias("area"), url)
    theatres = own.filter(k % 3 == 1).select(F.col("s_name").alias("name"), F.col("n_name").alias("area"), F.col("r_name").alias("pref"), url)
    named = listing(spark, sf_dir).select(F.explode("venues").alias("place")).union(read(spark, sf_dir, "nation").select("n_name")).union(spark.createDataFrame([("nowhere",)], "place string")).distinct()
    return places.place_facts(named, venues, theatres, places.chain_branches(own.select(F.col("n_name").alias("chain"), k.alias("k")), read(spark, sf_dir, "nation").select(F.col("n_name").alias("chain"))).filter("k % 3 = 2"), {"hall": "Hall"})


@query(
    """, v AS (SELECT row_no, unnest(cats) AS c FROM listing), d AS (SELECT row_no, unnest(['1998-02-30', CAST(row_no AS VARCHAR), '1998-06-' || lpad(CAST(row_no % 40 AS VARCHAR), 2, '0')]) AS x FROM listing WHERE row_no % 3 = 0)
    SELECT row_no, 'K29' AS rule, 'cats' AS "column", c AS value FROM v WHERE c NOT IN ('ECONOMY', 'PROMO') UNION ALL SELECT row_no, 'K6', 'dates', x FROM d WHERE NOT regexp_full_match(x, '\\d{4}-\\d{2}-\\d{2}') UNION ALL SELECT row_no, 'K7', 'dates', x FROM d WHERE regexp_full_match(x, '\\d{4}-\\d{2}-\\d{2}') AND try_cast(x AS DATE) IS NULL"""
)
def dq_each_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line for each bad value of a list."""
    k = F.col("row_no")
    days = F.when(k % 3 == 0, F.concat_ws("|", F.lit("1998-02-30"), k.cast("string"), F.concat(F.lit(" 1998-06-"), F.lpad((k % 40).cast("string"), 2, "0"))))
    rows = listing(spark, sf_dir).select("row_no", F.array_join("cats", " | ").alias("cats"), days.alias("dates"))
    return quality.bad_values(rows, "listing", {"cats": ["ECONOMY", "PROMO"]}, ["dates"]).select("row_no", "rule", "column", "value")


@query(", e AS (SELECT row_no, title, coalesce(start_date, end_date) AS a, coalesce(end_date, start_date) AS b FROM listing) SELECT row_no, 'https://calendar.example/render?action=TEMPLATE&text=' || replace(replace(replace(title, ' ', '+'), '(', '%28'), ')', '%29') || '&dates=' || strftime(a, '%Y%m%d') || '/' || strftime(b + 1, '%Y%m%d') AS link FROM e WHERE a IS NOT NULL")
def calendar_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    first, last = F.coalesce("start_date", "end_date"), F.coalesce("end_date", "start_date")
    return listing(spark, sf_dir).filter(first.isNotNull()).select("row_no", export.calendar_link(F.col("title"), first, last, "https://calendar.example/render").alias("link"))


@query("SELECT tab, CAST(max(announced_date + CAST(row_no % 3 AS INTEGER)) FILTER (row_no % 4 <> 0) AS VARCHAR) AS as_of, count(*) AS n, count(*) FILTER (row_no % 5 = 0) AS unlinked FROM listing GROUP BY tab")
def prices_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How fresh the prices of a set are: the latest price check; and how many of its rows have no link."""
    k = F.col("row_no")
    rows = listing(spark, sf_dir).select("tab", F.when(k % 4 != 0, F.date_add("announced_date", (k % 3).cast("int"))).alias("price_checked"), F.when(k % 5 != 0, "https://a.example").alias("url"))
    parts = [roster.without_link(rows.filter(F.col("tab") == t)).select(F.lit(t).alias("tab"), F.col("unknown").alias("unlinked")) for t in TABS]
    links = reduce(DataFrame.union, parts)
    return rows.groupBy("tab").agg(F.max("price_checked").cast("string").alias("as_of"), F.count("*").alias("n")).join(links, "tab").select("tab", "as_of", "n", "unlinked")
