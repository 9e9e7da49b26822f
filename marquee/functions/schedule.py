"""State that follows from dates, always against an explicit `today`: phase, status, rank, spans of days."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column
from pyspark.sql import functions as F

# How many days ahead still count as soon, and each tab's label for each phase, in order of rank.
SOON_DAYS = 14
STATUS_BY_PHASE = {
    "event": {"ended": "終了", "backup": "本日予備日", "last": "本日開催", "opening": "開催中", "ongoing": "開催中", "gap": "本日は休み", "openrun": "開催中", "soon": "まもなく開催", "far": "発売中"},
    "movie": {"ended": "上映終了", "backup": "本日予備日", "last": "本日が最終上映", "opening": "上映中", "ongoing": "上映中", "gap": "本日は上映なし", "openrun": "上映中", "soon": "まもなく公開", "far": "前売り券発売中"},
    "live": {"ended": "終了", "backup": "本日予備日", "last": "本日開催", "opening": "本日開催", "ongoing": "開催中", "gap": "本日は公演なし", "openrun": "開催中", "soon": "まもなく開催", "far": "公演予定"},
}
STATUS_ORDER = {
    "event": ["本日開催", "本日予備日", "まもなく開催", "開催中", "本日は休み", "発売中", "通年予約可", "終了"],
    "movie": ["本日が最終上映", "本日予備日", "まもなく公開", "上映中", "本日は上映なし", "前売り券発売中", "上映終了"],
    "live": ["本日開催", "本日予備日", "まもなく開催", "開催中", "本日は公演なし", "公演予定", "終了"],
}
RANK_FALLBACK = 9007199254740991
TIME_WORDS = {"event": ("開場", "開始"), "movie": ("開場", "上映"), "live": ("開場", "開演")}
WEEKDAYS = ["日", "月", "火", "水", "木", "金", "土"]
SPAN_MAX_DAYS = 8


def phase(today: date) -> Column:
    """Null without any date. A backup day wins over an ended run; listed days replace start and end."""
    t, listed = F.lit(today), F.size("dates") > 0
    s = F.when(listed, F.get("dates", F.lit(0))).otherwise(F.col("start_date"))
    e = F.when(listed, F.element_at("dates", -1)).otherwise(F.col("end_date"))
    return (
        F.when(s.isNull() & e.isNull(), None).when(F.array_contains("backup_date", t), "backup").when(e < t, "ended").when(s > t, F.when(F.datediff(s, t) <= SOON_DAYS, "soon").otherwise("far"))
        .when(e.isNull(), "openrun").when(listed & ~F.array_contains("dates", t), "gap").when(e == t, "last").when(s == t, "opening").otherwise("ongoing")
    )


def _literal_map(pairs) -> Column:
    return F.create_map(*[F.lit(x) for pair in pairs for x in pair])


def status(today: date, declared: Column | None = None) -> Column:
    """The tab's label for the phase, else the declared status."""
    table = _literal_map((f"{tab}/{p}", label) for tab, labels in STATUS_BY_PHASE.items() for p, label in labels.items())
    return F.coalesce(table[F.concat_ws("/", "tab", phase(today))], F.lit(None).cast("string") if declared is None else declared)


def rank(today: date, declared: Column | None = None) -> Column:
    """Place of the status in its tab's table, else the declared rank, else last."""
    table = _literal_map((f"{tab}/{label}", i) for tab, labels in STATUS_ORDER.items() for i, label in enumerate(labels))
    place = table[F.concat_ws("/", "tab", status(today))].cast("bigint")
    return F.coalesce(place, F.lit(None).cast("bigint") if declared is None else declared, F.lit(RANK_FALLBACK))


def next_open_day(today: date) -> Column:
    return F.get(F.filter("dates", lambda d: d >= F.lit(today)), F.lit(0))


def newly_announced(today: date) -> Column:
    return F.coalesce(F.datediff(F.lit(today), "announced_date").between(0, 7), F.lit(False))


def has_ended(today: date) -> Column:
    """The run is over and no backup day is left."""
    t = F.lit(today)
    return F.coalesce(F.col("end_date") < t, F.lit(False)) & ~F.exists("backup_date", lambda d: d >= t)


def effective_date(today: date, range_start: date | None = None) -> Column:
    """The day a row sorts under: its start, but not before the anchor; without a start its end, if that is earlier."""
    anchor = F.lit(range_start or today)
    return F.when(F.col("start_date").isNotNull(), F.greatest("start_date", anchor)).when(F.col("end_date").isNotNull(), F.least("end_date", anchor)).otherwise(anchor)


def dots(d: Column) -> Column:
    return F.concat_ws(".", F.year(d), F.month(d), F.day(d))


def _named(body: Column, d: Column) -> Column:
    return F.concat(body, F.lit("("), F.element_at(F.array(*map(F.lit, WEEKDAYS)), F.dayofweek(d)), F.lit(")"))


def with_weekday(d: Column) -> Column:
    return _named(dots(d), d)


def short_after(d: Column, before: Column) -> Column:
    """A date without the year, and the month, that it shares with the one before."""
    body = F.when(F.year(d) != F.year(before), dots(d)).when(F.month(d) != F.month(before), F.concat_ws(".", F.month(d), F.day(d))).otherwise(F.day(d).cast("string"))
    return _named(body, d)


def span(start: Column, end: Column, days: Column) -> Column:
    """A run in words; null without any date. Of more than eight listed days seven are written."""
    n = F.size(days)
    shown = F.slice(days, 1, F.when(n > SPAN_MAX_DAYS, SPAN_MAX_DAYS - 1).otherwise(F.greatest(n, F.lit(1))))
    body = F.array_join(F.transform(shown, lambda d, i: F.when(i == 0, with_weekday(d)).otherwise(short_after(d, F.get(shown, i - 1)))), "・")
    listed = F.when(n > SPAN_MAX_DAYS, F.concat(body, F.lit("・ほか"), n - (SPAN_MAX_DAYS - 1), F.lit("日"))).otherwise(body)
    return (
        F.when(n > 0, listed).when(start != end, F.concat(with_weekday(start), F.lit("〜"), short_after(end, start))).when(start.isNotNull() & end.isNull(), F.concat(with_weekday(start), F.lit("〜")))
        .when(start.isNotNull(), with_weekday(start)).when(end.isNotNull(), F.concat(F.lit("〜"), with_weekday(end)))
    )


def times(opens: Column, starts: Column, ends: Column, tab: Column) -> Column:
    """Times in the tab's words; unknown ones aren't written."""
    word = lambda i: _literal_map((k, v[i]) for k, v in TIME_WORDS.items())[tab]
    until = F.coalesce(F.concat(F.lit("〜"), ends), F.lit(""))
    run = F.when(starts.isNotNull(), F.concat(word(1), starts, until)).when(ends.isNotNull(), until)
    return F.nullif(F.concat_ws("／", F.concat(word(0), opens), run), F.lit(""))


def display_date(written: Column, span_text: Column, times_text: Column, note: Column) -> Column:
    """Free text wins; else span, times and the note in brackets."""
    built = F.concat_ws(" ", span_text, times_text)
    return F.coalesce(written, F.nullif(F.concat(built, F.coalesce(F.concat(F.lit("（"), note, F.lit("）")), F.lit(""))), F.lit("")))


def preset_range(key: str, t: Column) -> tuple[Column, Column]:
    """(first, last) day of a named range. Months roll over: three months from 30 November end on 2 March."""
    weekday = F.dayofweek(t)  # 1 is Sunday
    if key == "today":
        return t, t
    if key == "weekend":
        return F.when(weekday == 1, t).otherwise(F.date_add(t, 7 - weekday)), F.when(weekday == 1, t).otherwise(F.date_add(t, 8 - weekday))
    if key == "7d":
        return t, F.date_add(t, 6)
    if key == "month":
        return t, F.last_day(t)
    if key == "3m":
        return t, F.date_add(F.add_months(F.trunc(t, "MM"), 3), F.day(t) - 1)
    raise ValueError(key)


PRESETS = ("today", "weekend", "7d", "month", "3m")
