"""Ticket sales: instants, state, countdowns and prices. `now` is an instant of the listing's own zone."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

# Labels that close a sale, and texts that stand for no price.
CLOSED_LABELS = ["SOLD OUT", "受付終了", "販売終了", "完売"]
NO_PRICE = ["要問合せ", "要問い合わせ", "要確認", "未定", "-", "—"]
DEADLINE_DAYS, UPCOMING_DAYS, DISCOUNT_TOLERANCE = 7, 14, 2


def instant(day: Column, time: Column, missing: str) -> Column:
    """A day and H:MM as a timestamp; a missing time is `missing`, a short one is padded."""
    return F.try_to_timestamp(F.concat_ws(" ", day.cast("string"), F.lpad(F.coalesce(time, F.lit(missing)), 5, "0")), F.lit("yyyy-MM-dd HH:mm"))


def state(now: datetime, label: str = "onsale_label", start: str = "onsale_start", end: str = "onsale_end", start_time: str = "onsale_time", end_time: str = "onsale_time") -> Column:
    """closed, before, open or unknown."""
    t = F.lit(now.strftime("%Y-%m-%d %H:%M:%S")).cast("timestamp")
    opens = F.when(F.col(start).isNotNull(), instant(F.col(start), F.col(start_time), "00:00"))
    closes = F.when(F.col(end).isNotNull(), instant(F.col(end), F.col(end_time), "23:59"))
    return (
        F.when(F.col(label).isin(CLOSED_LABELS), "closed").when(closes < t, "closed").when(opens > t, "before")
        .when(F.col(label).isNotNull() | opens.isNotNull(), "open").otherwise("unknown")
    )


def deadline_days(state_col: Column, end: Column, today: date) -> Column:
    left = F.datediff(end, F.lit(today))
    return F.when((state_col == "open") & left.between(0, DEADLINE_DAYS), left)


def opening_days(state_col: Column, start: Column, today: date) -> Column:
    left = F.datediff(start, F.lit(today))
    return F.when((state_col == "before") & left.between(0, UPCOMING_DAYS), left)


def price_comparison(official: Column, best: Column, source: Column) -> Column:
    """struct(kind, official, best, source, saved): both prices and a source give a saving if it is positive; the official one
    alone says that others weren't checked. No discount is inferred."""
    both = official.isNotNull() & best.isNotNull() & source.isNotNull()
    saved = F.when(both & (official > best), official - best)
    kind = F.when(both, "compared").when(official.isNotNull(), "official_only")
    return F.struct(kind.alias("kind"), official.alias("official"), F.when(both, best).alias("best"), F.when(both, source).alias("source"), saved.alias("saved"))


def discount_off(official: Column, best: Column, stated: Column) -> Column:
    """Whether a stated per cent differs from the prices' own by more than the tolerance."""
    return F.abs(F.bround((official - best) / official * 100) - stated) > DISCOUNT_TOLERANCE


def price_text(c: Column) -> Column:
    """Null for texts that say nothing."""
    t = F.trim(c)
    return F.when((t != "") & ~t.isin(NO_PRICE), t)
