"""Place rosters: hits and promotion, additions, changes, ageing, quarantine, listing; and the review worklist."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marquee.functions import exact, text

# Days of ageing and review, hits for promotion, length limits, phrases that look like instructions.
CANDIDATE_DAYS, ACTIVE_DAYS, PROMOTE_HITS = 60, 180, 2
NEAR_DAYS, PRICE_DAYS = 21, 14
MAX_LENGTH = {"name": 60, "area": 30, "note": 120, "kind": 20, "month_hint": 20, "venue": 60}
URGENT = ["本日開催", "まもなく開催", "本日が最終上映", "まもなく公開"]
ALL_YEAR = "通年予約可"
SUSPICIOUS = r"(?i)(ignore\s+(all\s+)?previous|disregard\s+the|system\s*prompt|以下の指示|指示を無視|ルールを変更|必ず実行|あなたは)"
CONTROL = r"[\x00-\x1f\x7f]"


def name_key(c: Column) -> Column:
    """The roster's own norm: NFKC, case folded, no blanks."""
    plain = text.either(c, c.rlike(text.COVERED) & ~c.contains("ß"), F.lower(F.translate(c, *_wide())), lambda x: text.plain_any(x, casefold=True))
    return F.regexp_replace(F.trim(plain), r"[ \t\n\r\f\x0b]+", "")


def _wide() -> tuple[str, str]:
    return "".join(chr(c) for c in range(0xFF01, 0xFF5F)) + "　", "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)) + " "


def hits(roster: DataFrame, log: DataFrame) -> DataFrame:
    """The roster after a log of (name, day): last_hit never moves back, hit_count adds up, candidates with enough hits become active."""
    each = log.groupBy("name").agg(F.max("day").alias("_day"), F.count("*").alias("_n"))  # names are normalised once each
    own = exact.with_norms(each, {"_key": (F.col("name"), exact.ROSTER)}).groupBy("_key").agg(F.max("_day").alias("_day"), F.sum("_n").alias("_n"))
    rows = exact.with_norms(roster, {"_key": (F.col("name"), exact.ROSTER)}).join(own, "_key", "left")
    count = F.coalesce("hit_count", F.lit(0)) + F.coalesce("_n", F.lit(0))
    promoted = (F.col("status") == "candidate") & F.col("_n").isNotNull() & (count >= PROMOTE_HITS)
    return rows.withColumns({"last_hit": F.greatest("last_hit", "_day"), "hit_count": count, "status": F.when(promoted, "active").otherwise(F.col("status"))}).select(*roster.columns)


def unknown_hits(roster: DataFrame, log: DataFrame) -> DataFrame:
    known = roster.select(name_key(F.col("name")).alias("_key"))
    return log.withColumn("_key", name_key(F.col("name"))).join(known, "_key", "left_anti").groupBy("_key").agg(F.count("*").alias("n"), F.min("name").alias("name")).select("name", "n")


def add(roster: DataFrame, batch: DataFrame, today: date) -> DataFrame:
    """New candidates of a batch (name, seq, ...): known names are skipped, also inside the batch; the earliest row of a name counts.
    Rows whose url is no http(s) link are left out."""
    rest = [c for c in batch.columns if c not in ("seq",)]
    key = name_key(F.col("name"))
    link = F.trim(F.coalesce(F.col("url"), F.lit(""))) if "url" in batch.columns else F.lit("")
    first = batch.filter((F.trim("name") != "") & ((link == "") | link.rlike(r"(?i)^https?://"))).groupBy(key.alias("_key")).agg(F.min(F.struct("seq", *rest)).alias("x")).select("_key", "x.*").drop("seq")
    new = first.join(roster.select(key.alias("_key")), "_key", "left_anti").drop("_key")
    return new.withColumns({"status": F.lit("candidate"), "first_seen": F.lit(today), "last_hit": F.lit(None).cast("date"), "hit_count": F.lit(0).cast("long")})


def add_rejects(roster: DataFrame, batch: DataFrame) -> DataFrame:
    """(seq, name, reason) of a batch's rows (name, seq, perhaps url) that add() takes nothing from: no name, a bad link, a name that the roster knows, or one that an earlier
    sound row of the batch has."""
    link = F.trim(F.coalesce(F.col("url"), F.lit(""))) if "url" in batch.columns else F.lit("")
    rows = exact.with_norms(batch.select("seq", "name", link.alias("_link")), {"_key": (F.col("name"), exact.ROSTER)})
    reason = F.when(F.trim(F.coalesce("name", F.lit(""))) == "", "no name").when((F.col("_link") != "") & ~F.col("_link").rlike(r"(?i)^https?://"), "bad link")
    rows = rows.withColumn("reason", reason)
    first = rows.filter("reason is null").groupBy("_key").agg(F.min("seq").alias("_first"))
    known = exact.with_norms(roster.select("name"), {"_key": (F.col("name"), exact.ROSTER)}).select("_key", F.lit(True).alias("_known")).distinct()
    told = rows.join(known, "_key", "left").join(first, "_key", "left")
    late = F.when(F.col("_known"), "known").when(F.col("seq") > F.col("_first"), "repeated")
    return told.select("seq", "name", F.coalesce("reason", late).alias("reason")).filter("reason is not null")


def change(roster: DataFrame, changes: DataFrame) -> DataFrame:
    """Apply (name, action, until, note): retire or close; the note is replaced if given."""
    c = changes.select(name_key(F.col("name")).alias("_key"), "action", "until", F.col("note").alias("_note"))
    rows = roster.withColumn("_key", name_key(F.col("name"))).join(c, "_key", "left")
    return rows.withColumns(
        {"status": F.when(F.col("action") == "retire", "retired").otherwise(F.col("status")), "closed_until": F.when(F.col("action") == "close", F.col("until")).otherwise(F.col("closed_until")), "note": F.coalesce("_note", "note")}
    ).select(*roster.columns)


def age(roster: DataFrame, today: date) -> DataFrame:
    """Idle candidates are retired, idle active places (also those without a status) become candidates, which is added to the note;
    retired and undated ones stay."""
    idle = F.datediff(F.lit(today), F.coalesce("last_hit", "first_seen"))
    aged = F.when((F.col("status") == "candidate") & (idle > CANDIDATE_DAYS), "retired").when((F.coalesce("status", F.lit("active")) == "active") & (idle > ACTIVE_DAYS), "candidate")
    rows = roster.withColumn("idle", idle).withColumn("aged", aged)
    if "note" in roster.columns:
        said = F.concat(F.lit(f"（{today} 自動"), F.when(F.col("aged") == "retired", "整理").otherwise("降格"), F.lit(": "), F.col("idle").cast("string"), F.lit("日間ヒットなし）"))
        rows = rows.withColumn("note", F.when(F.col("aged").isNotNull(), F.concat(F.coalesce("note", F.lit("")), said)).otherwise(F.col("note")))
    return rows.withColumn("status", F.coalesce("aged", "status"))


def open_places(roster: DataFrame, today: date, pref: str | None = None, kind: str | None = None) -> DataFrame:
    """Places that are neither retired nor closed for now."""
    out = roster.filter((F.coalesce("status", F.lit("active")) != "retired") & ~F.coalesce(F.col("closed_until") > F.lit(today), F.lit(False)))
    if pref:
        out = out.filter(F.col("pref") == pref)
    return out.filter(F.coalesce("kind", "chain") == kind) if kind else out


def quarantine(rows: DataFrame, column: str, limit: int | None = None) -> DataFrame:
    """`rows` with clean (NFKC, trimmed, without control characters) and reason: why a value is held back, else null."""
    rows = exact.with_norms(rows, {"clean": (F.coalesce(F.col(column), F.lit("")), exact.PLAIN)})
    clean = F.regexp_replace(F.trim("clean"), CONTROL, "")
    most = limit if limit is not None else MAX_LENGTH.get(column)
    reason = F.when(F.col("clean").rlike(SUSPICIOUS), "instruction-like")
    return rows.withColumn("clean", clean).withColumn("reason", reason.when(F.length("clean") > most, "too long") if most else reason)


def review(today: date, columns: list[str] = ()) -> tuple[Column, Column]:
    """(tier, reasons) of a listing row: A to be checked each time, B on the way, C seldom. `columns` names which of status, coupon_note
    and discount_pct the rows have."""
    t = F.lit(today)
    soon = F.date_add(t, NEAR_DAYS)
    say = lambda cond, word, c=None: F.when(cond, F.concat(F.lit(word), c.cast("string")) if c is not None else F.lit(word))
    cell = lambda name: F.nullif(F.trim(F.col(name).cast("string")), F.lit("")) if name in columns else F.lit(None).cast("string")
    status = cell("status")
    priced = F.col("price_official").isNotNull() | F.col("price_best").isNotNull() | cell("discount_pct").isNotNull()
    reasons = F.array_compact(
        F.array(
            say(status.isin(URGENT), "status ", status), say(F.col("end_date") <= soon, "end ", F.col("end_date")), say(F.col("start_date").between(t, soon), "start ", F.col("start_date")),
            say(F.col("onsale_end") <= soon, "deadline ", F.col("onsale_end")), say(F.col("onsale_start") >= t, "on sale ", F.col("onsale_start")),
            say(F.col("onsale_label").isNotNull() & F.col("onsale_end").isNull(), "sale unclear"), say(cell("coupon_note").isNotNull(), "coupon"), say(F.col("is_additional"), "additional"),
            say(priced & ~F.coalesce(F.datediff(t, "price_checked") <= PRICE_DAYS, F.lit(False)), "old price"),
        )
    )
    still = F.coalesce(status == ALL_YEAR, F.lit(False)) | (F.col("start_date").isNull() & F.col("end_date").isNull())
    return F.when(F.size(reasons) > 0, "A").when(still, "C").otherwise("B"), reasons


def without_link(places: DataFrame) -> DataFrame:
    """(places, unknown): how many places there are, and how many of them have no url."""
    return places.agg(F.count("*").alias("places"), F.count_if(F.trim(F.coalesce("url", F.lit(""))) == "").alias("unknown"))


def worklist(rows: DataFrame, today: date, tiers: list[str] = ()) -> DataFrame:
    """What a reviewer needs of each row, and no more; of the given tiers alone, if any are."""
    tier, reasons = review(today, rows.columns)
    rows = rows.filter(tier.isin(list(tiers))) if tiers else rows
    short = lambda c: F.substring(F.col(c).cast("string"), 6, 5)
    rows = exact.with_natural_key(rows, "_natural", F.col("title"), F.get("venues", F.lit(0)), F.col("start_date"))
    return rows.select(
        text.key_uid(F.col("_natural"), 8).alias("uid"), "row_no", tier.alias("tier"), "pref", text.clip(F.col("title"), 24).alias("title"),
        text.clip(F.get("venues", F.lit(0)), 16).alias("venue"), F.concat_ws("~", short("start_date"), short("end_date")).alias("span"), F.col("onsale_end").cast("string").alias("deadline"), F.array_join(reasons, "; ").alias("reasons"),
    )
