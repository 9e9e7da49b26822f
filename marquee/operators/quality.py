"""Data-quality rules: a catalogue of row-level conditions and grouped checks, a long table of violations, a publish gate."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marquee.functions import sale

# Bounds of the area covered, known ways of writing, and the catalogue's severities.
LAT_RANGE, LNG_RANGE = (34.5, 37.5), (138.0, 141.5)
DAY, HOUR, FLAG_DOMAIN = r"^\d{4}-\d{2}-\d{2}$", r"^\d{1,2}:\d{2}$", ["", "0", "1", "true", "false", "yes", "no"]
MONTH_OR_SEASON = r"\d{1,2}月|[春夏秋冬]"
ERROR, WARNING = "E", "W"


@dataclass(frozen=True)
class Rule:
    """A row violates the rule where `bad` is true; `value` is shown."""

    id: str
    severity: str
    column: str
    bad: Column
    value: Column | None = None


def _blank(c: str) -> Column:
    return F.nullif(F.trim(F.col(c).cast("string")), F.lit("")).isNull()


def raw_rules(columns: list[str], statuses: list[str] = (), prefs: list[str] = (), labels: dict[str, list[str]] | None = None) -> list[Rule]:
    """Rules over rows of text cells, for the columns that there are."""
    has, rules = set(columns).issuperset, []

    def add(rule: str, severity: str, column: str, bad: Column, needs: tuple[str, ...] = ()) -> None:
        if has({column, *needs}):
            rules.append(Rule(rule, severity, column, bad, F.col(column).cast("string")))

    text = lambda c: F.trim(F.coalesce(F.col(c), F.lit("")))
    date_of = lambda c: F.when(text(c).rlike(DAY), F.try_to_date(text(c)))
    listed = lambda c: F.filter(F.transform(F.split(text(c), "[|]"), lambda x: F.trim(x)), lambda x: x != "")
    days_of = lambda c: F.filter(F.transform(listed(c), lambda x: F.when(x.rlike(DAY), F.try_to_date(x))), lambda d: d.isNotNull())
    add("K4", ERROR, "title", _blank("title"))
    for c in ("start_date", "end_date", "announced_date", "onsale_start", "onsale_end"):
        add("K6", ERROR, c, ~_blank(c) & ~text(c).rlike(DAY))
        add("K7", ERROR, c, text(c).rlike(DAY) & F.try_to_date(text(c)).isNull())
    for c in ("dates", "backup_date"):
        add("K6", ERROR, c, F.exists(listed(c), lambda x: ~x.rlike(DAY)))
        add("K7", ERROR, c, F.exists(listed(c), lambda x: x.rlike(DAY) & F.try_to_date(x).isNull()))
    if has({"start_date", "end_date"}):
        s, e = date_of("start_date"), date_of("end_date")
        add("K8", ERROR, "end_date", e < s)
        add("K9", WARNING, "start_date", _blank("start_date") & _blank("end_date"))
        if has({"dates"}):
            d = days_of("dates")
            n = F.size(d)
            add("K10", WARNING, "dates", (F.size(listed("dates")) > 0) & (n < 2))
            add("K11", WARNING, "dates", (n > 1) & (d != F.array_sort(d)))
            add("K12", ERROR, "dates", (n > 0) & ~F.get(d, F.lit(0)).eqNullSafe(s))
            add("K13", ERROR, "dates", (n > 0) & ~F.try_element_at(d, F.lit(-1)).eqNullSafe(e))
        if has({"backup_date"}):
            b = days_of("backup_date")
            add("K17", ERROR, "backup_date", F.exists(b, lambda x: x.between(s, F.coalesce(e, s))))
            add("K18", WARNING, "backup_date", F.exists(b, lambda x: x < s))
        add("K21", WARNING, "end_date", (F.col("tab") == "live") & s.isNotNull() & _blank("end_date"), ("tab",))
        if has({"date", "dates"}):
            add("K20", WARNING, "date", text("date").rlike(MONTH_OR_SEASON) & _blank("start_date") & _blank("end_date") & _blank("dates"))
        if has({"status"}):
            stated = ~_blank("status") | ~_blank("rank") if has({"rank"}) else ~_blank("status")
            add("K23", WARNING, "status", stated & (~_blank("start_date") | ~_blank("end_date")))
            add("K24", WARNING, "status", _blank("status") & _blank("start_date") & _blank("end_date"))
    for c in ("open_time", "start_time", "end_time"):
        add("K14", ERROR, c, ~_blank(c) & ~text(c).rlike(HOUR))
    add("K15", WARNING, "end_time", ~_blank("end_time") & _blank("start_time"), ("start_time",))
    add("K16", WARNING, "open_time", (F.length(text("open_time")) == F.length(text("start_time"))) & (text("open_time") > text("start_time")), ("start_time",))
    add("K19", WARNING, "date", ~_blank("date"))
    if statuses:
        add("K22", WARNING, "status", ~_blank("status") & ~text("status").isin(statuses))
    if has({"onsale_start", "onsale_end"}):
        add("K25", ERROR, "onsale_end", date_of("onsale_end") < date_of("onsale_start"))
    for c in ("onsale_start", "onsale_end"):
        t = f"{c}_time"
        add("K26", ERROR, t, ~_blank(t) & ~text(t).rlike(HOUR))
        add("K27", WARNING, t, ~_blank(t) & _blank(c), (c,))
    add("K28", ERROR, "is_additional", ~F.lower(text("is_additional")).isin(FLAG_DOMAIN))
    for c, allowed in (labels or {}).items():
        if has({c}):
            rules.append(Rule("K29", ERROR, c, F.size(F.array_except(listed(c), F.array(*map(F.lit, allowed)))) > 0, F.array_join(F.array_sort(F.array_except(listed(c), F.array(*map(F.lit, allowed)))), "|")))
    add("K30", WARNING, "cats", F.size(listed("cats")) == 0)
    if prefs:
        add("K31", ERROR, "pref", ~text("pref").isin(prefs))
    for c in ("url", "official_url", "venue_url", "theater_url", "poster_url", "apple_music_url"):
        add("K32", ERROR, c, ~_blank(c) & ~text(c).rlike(r"(?i)^https?://"))
        add("K33", WARNING, c, F.lower(text(c)).startswith("http://"))
    add("K34", ERROR, "url", _blank("url") & _blank("official_url"), ("official_url",))
    add("K35", ERROR, "apple_music_url", ~_blank("apple_music_url") & ~text("apple_music_url").startswith("https://music.apple.com/"))
    add("K36", ERROR, "apple_music_url", ~_blank("apple_music_url") & ~text("apple_music_url").contains("/artist/"))
    add("K37", WARNING, "source", text("source").rlike(r"(?i)^https?://"))
    for c, (lo, hi) in (("lat", LAT_RANGE), ("lng", LNG_RANGE)):
        add("K38", ERROR, c, ~_blank(c) & F.col(c).try_cast("double").isNull())
        add("K39", WARNING, c, ~F.col(c).try_cast("double").between(lo, hi))
    add("K40", ERROR, "lat", _blank("lat") != _blank("lng"), ("lng",))
    if has({"price_official", "price_best", "best_source", "discount_pct"}):
        po, pb, pct = (F.col(c).try_cast("bigint") for c in ("price_official", "price_best", "discount_pct"))
        add("K41", ERROR, "price_best", ~_blank("price_best") & _blank("price_official"))
        add("K42", ERROR, "best_source", ~_blank("price_best") & _blank("best_source"))
        add("K43", WARNING, "price_best", pb > po)
        add("K44", ERROR, "discount_pct", (po > 0) & sale.discount_off(F.nullif(po, F.lit(0)), pb, pct))
        unread = [~_blank(c) & x.isNull() for c, x in zip(("price_official", "price_best", "discount_pct"), (po, pb, pct), strict=True)]
        add("K45", ERROR, "price_official", unread[0] | unread[1] | unread[2] | (po == 0))
        add("K46", WARNING, "discount_pct", ~_blank("discount_pct") & _blank("price_condition"), ("price_condition",))
        add("K47", WARNING, "price_official", ~_blank("price_official") & _blank("price_checked"), ("price_checked",))
    return rules


def roster_rules(columns: list[str], key: str = "name", prefs: list[str] = (), kinds: list[str] = (), spots: bool = False) -> list[Rule]:
    """K49 and K51 to K57, the kinds being those of venues (K52) or, for a roster of spots, theirs (K53); the rules for links and coordinates are those of
    listings."""
    has, text = set(columns).__contains__, lambda c: F.trim(F.coalesce(F.col(c).cast("string"), F.lit("")))
    rules = [Rule("K49", ERROR, key, _blank(key), F.col(key))]
    if prefs and has("pref"):
        rules.append(Rule("K51", ERROR, "pref", ~_blank("pref") & ~text("pref").isin(prefs), F.col("pref")))
    if kinds and has("kind"):
        rules.append(Rule("K53" if spots else "K52", ERROR, "kind", ~_blank("kind") & ~text("kind").isin(kinds), F.col("kind")))
    if has("status"):
        rules.append(Rule("K55", ERROR, "status", ~text("status").isin("", "active", "candidate", "retired"), F.col("status")))
    for c in ("first_seen", "last_hit", "closed_until"):
        if has(c):
            rules.append(Rule("K56", ERROR, c, ~_blank(c) & (~text(c).rlike(DAY) | F.try_to_date(text(c)).isNull()), F.col(c).cast("string")))
    if has("hit_count"):
        rules.append(Rule("K57", ERROR, "hit_count", ~_blank("hit_count") & ~text("hit_count").rlike(r"^\d+$"), F.col("hit_count").cast("string")))
    links = [r for r in raw_rules([c for c in columns if c in ("url", "lat", "lng")]) if r.id in ("K32", "K33", "K38", "K39")]
    return rules + [Rule(f"K54/{r.id}", r.severity, r.column, r.bad, r.value) for r in links]


def violations(rows: DataFrame, rules: list[Rule], dataset: Column | str) -> DataFrame:
    """(dataset, row_no, rule, severity, column, value): all rules in one scan."""
    name = F.lit(dataset) if isinstance(dataset, str) else dataset
    found = [
        F.when(F.coalesce(r.bad, F.lit(False)), F.struct(F.lit(r.id).alias("rule"), F.lit(r.severity).alias("severity"), F.lit(r.column).alias("column"), (r.value if r.value is not None else F.lit(None)).cast("string").alias("value")))
        for r in rules
    ]
    return rows.select(name.alias("dataset"), "row_no", F.inline(F.array_compact(F.array(*found))))


def bad_values(rows: DataFrame, dataset: str, labels: dict[str, list[str]] | None = None, days: list[str] = ()) -> DataFrame:
    """The violations of list columns value by value, as (dataset, row_no, rule, severity, column, value): of each label that isn't among the allowed ones (K29), and of each
    day that is badly written (K6) or doesn't exist (K7). Repeated values count each."""
    listed = lambda c: F.filter(F.transform(F.split(F.coalesce(F.col(c).cast("string"), F.lit("")), "[|]"), lambda x: F.trim(x)), lambda x: x != "")
    line = lambda rule, c, values: F.transform(values, lambda x: F.struct(F.lit(rule).alias("rule"), F.lit(ERROR).alias("severity"), F.lit(c).alias("column"), x.alias("value")))
    found = [line("K29", c, F.filter(listed(c), _outside(allowed))) for c, allowed in (labels or {}).items()]
    for c in days:
        found += [line("K6", c, F.filter(listed(c), lambda x: ~x.rlike(DAY))), line("K7", c, F.filter(listed(c), lambda x: x.rlike(DAY) & F.try_to_date(x).isNull()))]
    return rows.select(F.lit(dataset).alias("dataset"), "row_no", F.inline(F.concat(*found)))


def _outside(allowed: list[str]):
    return lambda x: ~x.isin(allowed)


def repeated(rows: DataFrame, key: str, rule: str, severity: str, dataset: str, first: bool = False) -> DataFrame:
    """Rows whose key came before; value is the row number of the previous one with it, or of the first."""
    own = Window.partitionBy(key).orderBy("row_no")
    before = F.min("row_no").over(Window.partitionBy(key)) if first else F.lag("row_no").over(own)
    hit = rows.filter(F.col(key).isNotNull()).withColumn("before", before).filter("before is not null and before <> row_no")
    return hit.select(F.lit(dataset).alias("dataset"), "row_no", F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), F.lit(key).alias("column"), F.col("before").cast("string").alias("value"))


def single_rows(rows: DataFrame, key: str, dataset: str) -> DataFrame:
    """K48: series of one row."""
    one = rows.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n"), F.min("row_no").alias("row_no")).filter("n = 1")
    return one.select(F.lit(dataset).alias("dataset"), "row_no", F.lit("K48").alias("rule"), F.lit(WARNING).alias("severity"), F.lit(key).alias("column"), F.col(key).cast("string").alias("value"))


def header_violations(columns: list[str], wanted: list[str]) -> list[tuple[str, str]]:
    """K2: (missing or extra, column)."""
    return [("missing", c) for c in wanted if c not in columns] + [("extra", c) for c in columns if c not in wanted]


def file_violations(dataset: str, rows: DataFrame | None, wanted: list[str], spark: SparkSession) -> DataFrame:
    """K1 to K3 in the violations' columns: a missing file (None), another header, no rows. Each stops the checks of what is inside."""
    line = lambda rule, column, value: (dataset, None, rule, ERROR, column, value)
    if rows is None:
        found = [line("K1", None, None)]
    elif wrong := header_violations(rows.columns, wanted):
        found = [line("K2", c, kind) for kind, c in wrong]
    else:
        return rows.agg(F.count("*").alias("n")).filter("n = 0").select(F.lit(dataset).alias("dataset"), F.lit(None).cast("long").alias("row_no"), F.lit("K3").alias("rule"), F.lit(ERROR).alias("severity"), F.lit(None).cast("string").alias("column"), F.lit(None).cast("string").alias("value"))
    return spark.createDataFrame(found, "dataset string, row_no long, rule string, severity string, column string, value string")


def active_rows(roster: DataFrame) -> DataFrame:
    """(rows, active): a blank status counts as active."""
    return roster.agg(F.count("*").alias("rows"), F.count_if(F.trim(F.coalesce(F.col("status").cast("string"), F.lit(""))).isin("", "active")).alias("active"))


def inactive_roster(roster: DataFrame, dataset: str) -> DataFrame:
    """K58: a roster that has rows but no active one."""
    return active_rows(roster).filter("rows > 0 and active = 0").select(F.lit(dataset).alias("dataset"), F.lit(None).cast("long").alias("row_no"), F.lit("K58").alias("rule"), F.lit(ERROR).alias("severity"), F.lit("status").alias("column"), F.col("rows").cast("string").alias("value"))


def gate(found: DataFrame, strict: bool = False) -> DataFrame:
    """(errors, warnings, publish): any error stops a publication, and in strict mode any warning."""
    n = found.agg(F.count_if(F.col("severity") == ERROR).alias("errors"), F.count_if(F.col("severity") == WARNING).alias("warnings"))
    return n.withColumn("publish", (F.col("errors") == 0) & ((F.col("warnings") == 0) | F.lit(not strict)))
