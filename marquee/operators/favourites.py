"""Favourites as a store: a log of changes, compacted into a base now and then, and merged with it when read.

A change of (user_id, uid) with a number `seq` either toggles or sets a favourite. Of a pair the last change that sets counts, and the toggles behind it. The base
holds pairs as of a number; changes up to it are in the base already. Changes of one number for a pair are taken in the order set, toggle; a change that
is logged twice under one number is one change.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marquee.sources import publish

PAIR = ["user_id", "uid"]


def merged(base: DataFrame, log: DataFrame, since: int | None = None) -> DataFrame:
    """(user_id, uid): the pairs of `base` (user_id, uid) after the changes of `log` (user_id, uid, seq, action: toggle, add or remove) behind `since`. Changes combine before
    the shuffle: the last setting, and the toggles by number."""
    tail = log if since is None else log.filter(F.col("seq") > since)
    tail = tail.select(*PAIR, "seq", "action").distinct()
    sets = tail.filter("action <> 'toggle'").groupBy(*PAIR).agg(F.max(F.struct("seq", "action")).alias("x")).select(*PAIR, F.col("x.seq").alias("at"), (F.col("x.action") == "add").alias("on"))
    standing = base.select(*PAIR).distinct().withColumn("stood", F.lit(True))
    known = standing.join(sets, PAIR, "full_outer").select(*PAIR, F.coalesce("on", "stood", F.lit(False)).alias("on"), "at")
    toggles = tail.filter("action = 'toggle'").join(sets.select(*PAIR, F.col("at").alias("set_at")), PAIR, "left").filter("set_at is null or seq >= set_at")
    odd = toggles.groupBy(*PAIR).agg((F.count("*") % 2 == 1).alias("odd"))
    both = known.join(odd, PAIR, "full_outer").select(*PAIR, (F.coalesce("on", F.lit(False)) != F.coalesce("odd", F.lit(False))).alias("on"))
    return both.filter("on").select(*PAIR)


def standing(spark: SparkSession, root: str, log: DataFrame) -> DataFrame:
    """The favourites now: the published base and the changes behind it."""
    now = publish.manifest(spark, root)
    if now is None:
        return merged(log.select(*PAIR).limit(0), log)
    return merged(publish.current(spark, root)["favourites"], log, now["facts"]["upto"])


def compact(spark: SparkSession, root: str, log: DataFrame, upto: int, stop: Callable[[str], None] = lambda _: None) -> None:
    """Publish the favourites as of number `upto`, which is behind the one before: base and number become current together."""
    publish.publish(spark, root, {"favourites": standing(spark, root, log.filter(F.col("seq") <= upto))}, facts={"upto": upto}, stop=stop)
