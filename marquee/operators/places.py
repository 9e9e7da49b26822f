"""Places and series: coordinates from masters, what is on at a place, relatives in a series."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marquee.functions import sale, text
from marquee.operators.search import default_order


def first_per_name(master: DataFrame, name: str, order: str) -> DataFrame:
    """The first row of each name."""
    return master.withColumn("_n", F.row_number().over(Window.partitionBy(name).orderBy(order))).filter("_n = 1").drop("_n")


def venue_enrich(rows: DataFrame, venues: DataFrame) -> DataFrame:
    """Coordinates from a master (venue, vlat, vlng) where a row has none of its own, column by column; a row's first venue counts."""
    own = rows.withColumn("venue", F.get("venues", F.lit(0)))
    return own.join(venues, "venue", "left").withColumns({"lat": F.coalesce("lat", "vlat"), "lng": F.coalesce("lng", "vlng")}).drop("vlat", "vlng")


def theatre_enrich(rows: DataFrame, theatres: DataFrame) -> DataFrame:
    """Both coordinates of a theatre (name, tlat, tlng), for rows with exactly one venue and no latitude."""
    key = F.when((F.size("venues") == 1) & F.col("lat").isNull(), F.get("venues", F.lit(0)))
    out = rows.withColumn("_key", key).join(theatres.withColumnRenamed("name", "_key"), "_key", "left")
    met = F.col("tlat").isNotNull()
    return out.withColumns({"lat": F.when(met, F.col("tlat")).otherwise(F.col("lat")), "lng": F.when(met, F.col("tlng")).otherwise(F.col("lng"))}).drop("tlat", "tlng", "_key")


def place_points(rows: DataFrame, branches: DataFrame, venues: DataFrame, theatres: DataFrame) -> DataFrame:
    """(place, tier, lat, lng): a place's points from the first source that knows it: its chain's branches (chain, lat, lng), the
    venue master (venue, vlat, vlng), the theatre master (name, tlat, tlng), else the first located row that names it. A known chain stops at
    the first tier even if none of its branches is located."""
    listed = rows.filter("lat is not null").select(F.explode("venues").alias("place"), "tab", "row_no", "lat", "lng")
    first = listed.groupBy("place").agg(F.min(F.struct("tab", "row_no", "lat", "lng")).alias("x")).select("place", F.lit(4).alias("tier"), "x.lat", "x.lng")
    tiers = (
        branches.select(F.col("chain").alias("place"), F.lit(1).alias("tier"), "lat", "lng").unionByName(venues.select(F.col("venue").alias("place"), F.lit(2).alias("tier"), F.col("vlat").alias("lat"), F.col("vlng").alias("lng")))
        .unionByName(theatres.select(F.col("name").alias("place"), F.lit(3).alias("tier"), F.col("tlat").alias("lat"), F.col("tlng").alias("lng"))).unionByName(first)
    )
    best = tiers.withColumn("best", F.min("tier").over(Window.partitionBy("place"))).filter("tier = best")
    return best.filter("lat is not null").select("place", "tier", "lat", "lng")


def place_upcoming(rows: DataFrame, today: date, most: int = 8) -> DataFrame:
    """(place, place_no, row_no, more): the first rows at each place in default order, and how many there are beyond."""
    keys = {f"o{i}": c for i, c in enumerate(_plain_order(today))}
    at = rows.select("row_no", F.explode(F.array_distinct("venues")).alias("place"), *[c.alias(k) for k, c in keys.items()])
    # a rank filter alone is cut down before the shuffle; the counts combine before theirs
    first = at.withColumn("place_no", F.row_number().over(Window.partitionBy("place").orderBy(*keys, "row_no"))).filter(F.col("place_no") <= most)
    counts = at.groupBy("place").agg(F.count("*").alias("n"))
    return first.join(counts, "place").select("place", "place_no", "row_no", F.greatest(F.col("n") - most, F.lit(0)).alias("more"))


def _plain_order(today: date):
    from marquee.functions import schedule

    return [schedule.has_ended(today), schedule.effective_date(today), schedule.rank(today), F.coalesce("id", F.lit(0))]


def series_siblings(rows: DataFrame, now: datetime) -> DataFrame:
    """(row_no, sibling, start_date, state, limited): other rows of a row's series, by equi-join on the series."""
    a = rows.filter("series_id is not null").select("row_no", "series_id")
    b = rows.filter("series_id is not null").select("series_id", F.col("row_no").alias("sibling"), "start_date", sale.state(now).alias("state"), F.col("limited_sale").isNotNull().alias("limited"))
    return a.join(b, "series_id").filter("row_no <> sibling").drop("series_id")


def series_highlights(rows: DataFrame, now: datetime) -> DataFrame:
    """(row_no, others, others_limited, others_before) of a row's series without the row: counts by series, joined back; no
    self-join and no window, so that a very large series is split like any skewed join key."""
    some = rows.filter("series_id is not null").select("row_no", "series_id", F.col("limited_sale").isNotNull().cast("int").alias("l"), (sale.state(now) == "before").cast("int").alias("b"))
    totals = some.groupBy("series_id").agg(F.count("*").alias("n"), F.sum("l").alias("ls"), F.sum("b").alias("bs"))
    return some.join(totals, "series_id").select("row_no", (F.col("n") - 1).alias("others"), (F.col("ls") - F.col("l")).alias("others_limited"), (F.col("bs") - F.col("b")).alias("others_before"))


__all__ = ["default_order", "first_per_name", "place_points", "place_upcoming", "series_highlights", "series_siblings", "theatre_enrich", "venue_enrich"]


def chain_branches(theatres: DataFrame, chains: DataFrame) -> DataFrame:
    """Theatres (chain, ...) of known chains (chain)."""
    return theatres.join(chains.select("chain").distinct(), "chain", "left_semi")


def place_cards(rows: DataFrame, venues: DataFrame, branches: DataFrame) -> DataFrame:
    """(place, kind, capacity, branches, resolvable): facts of every place that a row names, from the venue master (venue, kind,
    capacity, vlat), else from its chain (chain: a branch a row); resolvable if either knows it or a row at it has coordinates."""
    named = rows.select(F.explode("venues").alias("place"), F.col("lat").isNotNull().alias("located")).groupBy("place").agg(F.max("located").alias("located"))
    own = branches.groupBy(F.col("chain").alias("place")).agg(F.count("*").alias("branches"))
    known = named.join(venues.withColumnRenamed("venue", "place"), "place", "left").join(own, "place", "left")
    return known.select(
        "place", F.coalesce("kind", F.when(F.col("branches").isNotNull(), "chain")).alias("kind"), "capacity", F.coalesce("branches", F.lit(0)).alias("branches"),
        (F.col("vlat").isNotNull() | F.col("branches").isNotNull() | F.col("located")).alias("resolvable"),
    )


def place_facts(named: DataFrame, venues: DataFrame, theatres: DataFrame, branches: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """(place, facts, site) of places (place): what is said about each, and its site. A venue (venue, kind, capacity, area, url) has its kind's label, its capacity and its
    area; else a theatre (name, area, pref, url) its area and prefecture; else a chain (chain: a located branch a row) the number of its branches; else the text is empty. The
    site is the venue's safe link, else the theatre's. Masters hold a name once (first_per_name)."""
    v = venues.select(F.col("venue").alias("place"), "kind", "capacity", F.col("area").alias("v_area"), F.col("url").alias("v_url"), F.lit(True).alias("is_venue"))
    t = theatres.select(F.col("name").alias("place"), F.col("area").alias("t_area"), F.col("pref").alias("t_pref"), F.col("url").alias("t_url"), F.lit(True).alias("is_theatre"))
    b = branches.groupBy(F.col("chain").alias("place")).agg(F.count("*").alias("n"))
    full = lambda *parts: F.concat_ws("　", *[F.nullif(p, F.lit("")) for p in parts])
    capacity = F.when(F.col("capacity") != 0, F.concat(F.lit("収容 約"), F.format_number("capacity", 0), F.lit("人")))
    facts = F.when(F.col("is_venue"), full(text.label(kinds, F.col("kind")), capacity, F.col("v_area"))).when(F.col("is_theatre"), full(F.col("t_area"), F.col("t_pref"))).when(F.col("n").isNotNull(), F.concat(F.lit("関東の店舗 "), F.col("n").cast("string"), F.lit("件"))).otherwise("")
    link = lambda c: text.safe_url(F.nullif(F.col(c), F.lit("")))
    site = F.when(F.coalesce("v_url", F.lit("")) != "", link("v_url")).otherwise(link("t_url"))
    return named.join(v, "place", "left").join(t, "place", "left").join(b, "place", "left").select("place", facts.alias("facts"), site.alias("site"))


def favoured(rows: DataFrame, favourites: DataFrame, key: str = "uid") -> DataFrame:
    """Rows that are someone's favourite, (user_id, uid)."""
    return rows.join(favourites.select(F.col("uid").alias(key)), key, "left_semi")


def toggled(favourites: DataFrame, log: DataFrame) -> DataFrame:
    """Favourites (user_id, uid) after a log of toggles (user_id, uid): an odd number of them changes the state."""
    odd = log.groupBy("user_id", "uid").agg((F.count("*") % 2 == 1).alias("odd")).filter("odd").select("user_id", "uid")
    both = favourites.distinct().select("user_id", "uid", F.lit(1).alias("n")).union(odd.select("user_id", "uid", F.lit(1)))
    return both.groupBy("user_id", "uid").agg(F.sum("n").alias("n")).filter("n = 1").select("user_id", "uid")
