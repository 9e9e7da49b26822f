"""What a card says of a listing, as plain text columns: places, performers, links, sales, backup and next days."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column
from pyspark.sql import functions as F

from marquee.functions import sale, schedule, text

# Words of each tab for the states of a sale, for links and for series, and how many performers are named.
SALE_WORDS = {
    "event": {"before": "受付前", "open": "受付中", "closed": "受付終了"},
    "movie": {"before": "前売り発売前", "open": "前売り発売中", "closed": "前売り終了"},
    "live": {"before": "発売前", "open": "受付中", "closed": "受付終了"},
}
LINK_WORDS = {"event": ("で予約する", "予約ページを開く"), "movie": ("で上映情報を見る", "上映情報を見る"), "live": ("でチケットを見る", "チケットページを開く")}
SERIES_WORDS = {"event": "この巡回展", "movie": "この特集", "live": "このツアー"}
PERFORMERS = 4
NO_PLACE = "-"


def _by_tab(words: dict[str, str], tab: Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in words.items() for x in pair])[tab]


def venue_names(venues: Column, venue: Column | None = None) -> Column:
    """A row's places: the list without blanks and dashes, or without a list the single one."""
    named = lambda v: v.isNotNull() & (v != "") & (v != NO_PLACE)
    listed = F.filter(venues, named)
    one = F.filter(F.array(venue), named) if venue is not None else F.array().cast("array<string>")
    return F.when(F.coalesce(F.size(venues), F.lit(0)) > 0, listed).otherwise(one)


def place_line(names: Column, area: Column, of_chain: Column) -> Column:
    """The places and the area, which isn't written behind a single place that is a chain; without places the area alone."""
    shown = F.array_join(names, "・")
    hidden = area.isNull() | (area == "") | ((F.size(names) == 1) & of_chain)
    return F.when(F.size(names) == 0, F.coalesce(area, F.lit(""))).when(hidden, shown).otherwise(F.concat(shown, F.lit("／"), area))


def performer_line(artists: Column) -> Column:
    """Performers of a shared bill; null for fewer than two."""
    more = F.size(artists) - PERFORMERS
    rest = F.when(more > 0, F.concat(F.lit("　ほか"), more.cast("string"), F.lit("組"))).otherwise("")
    return F.when(F.size(artists) >= 2, F.concat(F.lit("出演："), F.array_join(F.slice(artists, 1, PERFORMERS), "・"), rest))


def link_text(source: Column, tab: Column) -> Column:
    named = F.concat(source, _by_tab({k: v[0] for k, v in LINK_WORDS.items()}, tab))
    return F.when(source.isNotNull() & (source != ""), named).otherwise(_by_tab({k: v[1] for k, v in LINK_WORDS.items()}, tab))


def official_link(official: Column, url: Column) -> Column:
    """The official link, if it is safe and not the main one."""
    return F.when(~official.eqNullSafe(url), text.safe_url(official))


def share_text(title: Column, when: Column, names: Column, area: Column) -> Column:
    where = F.when(F.size(names) > 0, F.array_join(names, "・")).otherwise(area)
    return F.concat(title, F.lit("（"), F.concat_ws(" / ", F.nullif(when, F.lit("")), F.nullif(where, F.lit(""))), F.lit("）"))


def day_and_time(day: Column, time: Column) -> Column:
    return F.when(day.isNotNull(), F.concat_ws(" ", schedule.with_weekday(day), time))


def sale_rows(state: Column, today: date, row: dict[str, Column]) -> tuple[Column, Column]:
    """(lines, urgent) of a ticket sale. `row` has tab, start, start_time, end, end_time, limited (a text), and of the series's other
    rows others_limited and others_before (counts). Null where there is nothing to tell."""
    start, end = day_and_time(row["start"], row["start_time"]), day_and_time(row["end"], row["end_time"])
    opens, closes = sale.opening_days(state, row["start"], today), sale.deadline_days(state, row["end"], today)
    left = lambda n, now: F.when(n.isNull(), "").when(n == 0, f"（{now}）").otherwise(F.concat(F.lit("（あと"), n.cast("string"), F.lit("日）")))
    before, is_open = state == "before", state == "open"
    has_limited = row["limited"].isNotNull() & (row["limited"] != "")
    notes = F.array_compact(
        F.array(
            F.when((row["others_limited"] > 0) & ~has_limited, F.concat(F.lit("他"), row["others_limited"].cast("string"), F.lit("件に限定・追加販売あり"))),
            F.when((row["others_before"] > 0) & ~before, F.concat(F.lit("他"), row["others_before"].cast("string"), F.lit("件が"), _by_tab({k: v["before"] for k, v in SALE_WORDS.items()}, row["tab"]))),
        )
    )
    lines = F.array_compact(
        F.array(
            F.when(before, F.concat(start, F.lit(" 受付開始"), left(opens, "本日"))), F.when(before, F.concat(F.lit("締切 "), end)), F.when(is_open, F.concat(start, F.lit(" より受付中"))),
            F.when(is_open, F.concat(F.lit("締切 "), end, left(closes, "本日開催"))), F.when(has_limited, F.concat(F.lit("限定・追加販売："), row["limited"])),
            F.when(F.size(notes) > 0, F.concat(_by_tab(SERIES_WORDS, row["tab"]), F.lit("："), F.array_join(notes, "／"))),
        )
    )
    silent = ((state == "unknown") & ~has_limited & (row["others_limited"] == 0) & (row["others_before"] == 0)) | ((state == "closed") & (F.size(lines) == 0))
    return F.when(~silent, lines), is_open & closes.isNotNull()


def other_days(today: date) -> tuple[Column, Column]:
    """(the next open day of a row that pauses today, its backup days in words); null where there is none."""
    next_day = F.when(schedule.phase(today) == "gap", schedule.with_weekday(schedule.next_open_day(today)))
    days = F.col("backup_date")
    words = F.array_join(F.transform(days, lambda d, i: F.when(i == 0, schedule.with_weekday(d)).otherwise(schedule.short_after(d, F.get(days, i - 1)))), "・")
    return next_day, F.when(F.size(days) > 0, words)
