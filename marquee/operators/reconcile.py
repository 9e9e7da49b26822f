"""Two snapshots compared: added, gone, changed, renamed, unexplained; and facts carried from one to the next."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marquee.functions import text
from marquee.operators.search import placed

# Least similarity of a reworded title, and that of one at the same place and date.
LEAST, LEAST_SAME_PLACE = 0.82, 0.45
#: Bits of each half of a title's sketch.
SKETCH = 64
#: Rows of one title that a block has, and rows that are served at a time.
BLOCK, SERVED = 1000, 20_000
#: About the pairs that a task gives.
TASK = 2e7


def last_per_uid(rows: DataFrame, order: str = "row_no", within: list[str] = ()) -> DataFrame:
    """Rows of equal uid (and of equal columns `within`) collapse, the last one stays."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy("uid", *within).orderBy(F.desc(order)))).filter("_n = 1").drop("_n")


def added(prev: DataFrame, cur: DataFrame) -> DataFrame:
    return cur.join(prev.select("uid"), "uid", "left_anti")


def gone(prev: DataFrame, cur: DataFrame) -> DataFrame:
    return prev.join(cur.select("uid"), "uid", "left_anti")


def changed(prev: DataFrame, cur: DataFrame, watch: list[str], quiet: list[str] = ()) -> DataFrame:
    """(uid, column, old, new) of watched columns that differ after a trim; of quiet ones the name alone. A column that one
    side lacks is skipped. Both sides hold a uid once."""
    both = [c for c in [*watch, *quiet] if c in prev.columns and c in cur.columns]
    side = lambda df, tag: df.select("uid", *[F.nullif(F.trim(F.col(c).cast("string")), F.lit("")).alias(f"{tag}_{c}") for c in both])
    lines = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"old_{c}").alias("old"), F.col(f"new_{c}").alias("new")) for c in both])
    each = side(prev, "old").join(side(cur, "new"), "uid").select("uid", F.inline(F.filter(lines, lambda x: ~x["old"].eqNullSafe(x["new"]))))
    hide = F.col("column").isin(list(quiet)) if quiet else F.lit(False)
    return each.select("uid", "column", F.when(~hide, F.col("old")).alias("old"), F.when(~hide, F.col("new")).alias("new"))


def latest_dispositions(log: DataFrame) -> DataFrame:
    """The last record of each uid wins; the maximum combines before the shuffle."""
    rest = [c for c in log.columns if c not in ("uid", "seq")]
    return log.groupBy("uid").agg(F.max(F.struct("seq", *rest)).alias("x")).select("uid", "x.*")


def title_pairs(left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """(a, b, score) of titles that share at least `least` of the shorter one's characters, counted with repetition.

    Titles of few distinct characters meet on their rarest one and on sizes only through it: each side's distinct (character,
    number) tokens, rarest first, cut to the prefix that a partner must touch. Each title also has a sketch of its tokens, a bit of 128 for each; what two sketches share, and
    the tokens that the shorter title hides behind one bit, bounds the shared characters, so of the pairs that meet on a token only those leave the join that
    may reach `least`. Neither loses a pair."""
    a, b = text.character_counts(left, "a", "title"), text.character_counts(right, "b", "title")
    freq = a.select("ch", "nth").union(b.select("ch", "nth")).groupBy("ch", "nth").agg(F.count("*").alias("df"))

    def prefix(side: DataFrame, key: str) -> DataFrame:
        own = Window.partitionBy(key).orderBy("df", "ch", "nth")
        whole = Window.partitionBy(key)
        # the shorter title decides: with its size unknown, a prefix of size - ceil(least * size) + 1 of the shorter one must touch
        keep = F.col("size") - F.ceil(F.lit(least) * F.col("size")) + 1
        bits = side.withColumn("h", F.pmod(F.xxhash64("ch", "nth"), F.lit(2 * SKETCH)).cast("int"))
        half = lambda n: F.bit_or(F.expr(f"if(h div {SKETCH} = {n}, shiftleft(1L, h % {SKETCH}), 0L)")).over(whole).alias(f"s{n}")
        return bits.join(freq, ["ch", "nth"]).withColumn("i", F.row_number().over(own)).select(key, "size", "ch", "nth", (F.col("i") <= keep).alias("head"), half(0), half(1))

    def may_reach(short: str, other: str) -> Column:
        both = F.bit_count(F.col(f"{short}.s0").bitwiseAND(F.col(f"{other}.s0"))) + F.bit_count(F.col(f"{short}.s1").bitwiseAND(F.col(f"{other}.s1")))
        hidden = F.col(f"{short}.size") - F.bit_count(f"{short}.s0") - F.bit_count(f"{short}.s1")
        return both + hidden >= F.ceil(F.lit(least) * F.col(f"{short}.size"))

    x, y = prefix(a, "a"), prefix(b, "b")
    short_a = x.filter("head").alias("x").join(y.alias("y"), ["ch", "nth"]).filter(F.expr("x.size <= y.size") & may_reach("x", "y")).select("a", "b")
    short_b = x.alias("x").join(y.filter("head").alias("y"), ["ch", "nth"]).filter(F.expr("y.size < x.size") & may_reach("y", "x")).select("a", "b")
    found = short_a.union(short_b).distinct()
    score = text.multiset_similarity(F.col("ta"), F.col("tb"))
    named = found.join(left.select("a", F.col("title").alias("ta")), "a").join(right.select("b", F.col("title").alias("tb")), "b")
    return named.select("a", "b", score.alias("score")).filter(F.col("score") >= least)


def keyed_by_place(rows: DataFrame) -> DataFrame:
    """(uid, key) of rows (uid, title, place, day)."""
    return rows.select("uid", F.array("title", F.coalesce("place", F.lit("")), F.coalesce(F.col("day").cast("string"), F.lit(""))).alias("key"))


def rename_candidates(gone_rows: DataFrame, added_rows: DataFrame) -> DataFrame:
    """The same for rows (uid, title, place, day): a key of three parts."""
    return renames_by_key(keyed_by_place(gone_rows), keyed_by_place(added_rows))


def subsets(parts: Column, most: int) -> Column:
    """All sorted subsets of at least two of a key's few distinct parts, each as one text."""
    own = F.array_sort(F.array_distinct(F.filter(parts, lambda x: x != "")))
    masks = F.filter(F.sequence(F.lit(1), F.greatest(F.pow(F.lit(2.0), F.size(own)).cast("int") - 1, F.lit(1))), lambda m: F.bit_count(m) >= 2)
    bit = lambda m, i: F.floor(m / F.pow(F.lit(2.0), i)).cast("int") % 2 == 1
    chosen = F.transform(masks, lambda m: F.array_join(F.filter(own, lambda x, i: bit(m, i)), "\x1f"))
    return F.when((F.size(own) >= 2) & (F.size(own) <= most), chosen).otherwise(F.array().cast("array<string>"))


def _likeness(gone_rows: DataFrame, added_rows: DataFrame, parts: int, save) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """What two rows' likeness consists of: the older rows (a, title), the newer ones (b, title), pairs of titles (ta, tb, score) of at least LEAST, and pairs of rows (a, b, score) below that
    whose rests are shared."""
    g = save(gone_rows.select(F.col("uid").alias("a"), F.coalesce(F.col("key")[0], F.lit("")).alias("title"), F.slice("key", 2, 99).alias("rest")))
    n = save(added_rows.select(F.col("uid").alias("b"), F.coalesce(F.col("key")[0], F.lit("")).alias("title"), F.slice("key", 2, 99).alias("rest")))
    # titles are compared once each, however many rows have them
    once = lambda df, name: df.filter("title <> ''").select(F.col("title").alias(name), "title").distinct()
    alike = save(title_pairs(once(g, "a"), once(n, "b"), LEAST).toDF("ta", "tb", "score"))
    own = F.filter("rest", lambda x: x != "")
    whole = g.filter((F.size(own) >= 2) & (F.size(own) == F.size(F.array_distinct(own)))).select("a", text.numbered_characters(F.col("title")).alias("ta"), F.array_join(F.array_sort(own), "\x1f").alias("shared"))
    met = whole.join(n.select("b", text.numbered_characters(F.col("title")).alias("tb"), "rest").select("b", "tb", F.explode(F.array_distinct(subsets(F.col("rest"), parts))).alias("shared")), "shared")
    same = met.select("a", "b", text.shared_part(F.col("ta"), F.col("tb")).alias("score")).filter((F.col("score") >= LEAST_SAME_PLACE) & (F.col("score") < LEAST))
    return g.select("a", "title"), n.select("b", "title"), alike, same


def _blocks(rows: DataFrame, key: str, title: str, number: str) -> tuple[DataFrame, DataFrame]:
    """Rows of one title in blocks of about BLOCK, told by a hash of their key: (title, how many rows, how many blocks) and (title, number, the block's keys)."""
    counts = rows.groupBy(F.col("title").alias(title)).agg(F.count("*").alias("rows")).withColumn("n", F.ceil(F.col("rows") / BLOCK))
    dealt = rows.withColumnRenamed("title", title).join(counts, title).withColumn(number, F.pmod(F.xxhash64(key), "n"))
    return counts, dealt.groupBy(title, number).agg(F.collect_list(key).alias(f"{key}s"))


def renames_by_key(gone_rows: DataFrame, added_rows: DataFrame, parts: int = 6, save=lambda df: df, digits: int | None = None) -> DataFrame:
    """(prev_uid, uid, score): a similar title, or a somewhat similar one where all else is shared: every non-blank part of the older row's key behind
    the title is one of the newer one's, and there are two at least. Rows are (uid, key), each uid once on a side, the key's first part being the title and all parts normalised; two equal
    parts count once among the shared ones, so a key that repeats a part isn't shared. The newer rows' keys, of at most `parts` parts, are met by their subsets: an
    equi-join of the older row's whole rest with them. Rows with similar titles are paired block by block where two blocks meet, so the shuffles carry blocks and never pairs; blocks are dealt
    to tasks by the pairs that they give, which their bytes don't tell. With `digits` scores are rounded, those of two titles once for all their rows. `save` writes a table and reads it again."""
    g, n, alike, same = _likeness(gone_rows, added_rows, parts, save)
    (many_g, of_g), (many_n, of_n) = _blocks(g, "a", "ta", "i"), _blocks(n, "b", "tb", "j")
    numbers = lambda name: F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias(name)
    shown = F.col("score") if digits is None else F.round("score", digits)
    alike = alike.select("ta", "tb", shown.alias("score"))
    given = alike.join(many_g.select("ta", F.col("rows").alias("of_a")), "ta").join(many_n, "tb").agg(F.sum(F.col("of_a") * F.col("rows"))).first()[0] or 0
    tasks = max(int(g.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(int(given / TASK), 10_000))
    units = alike.join(many_g, "ta").select("ta", "tb", "score", numbers("i")).join(many_n, "tb").select("ta", "tb", "score", "i", numbers("j"))
    met = units.join(of_g, ["ta", "i"]).repartition(tasks, "tb", "j").join(of_n.repartition(tasks, "tb", "j").hint("shuffle_hash"), ["tb", "j"])
    similar = met.select("score", "bs", F.explode("as").alias("a")).select("a", F.explode("bs").alias("b"), "score")
    return similar.union(same.select("a", "b", shown)).select(F.col("a").alias("prev_uid"), F.col("b").alias("uid"), "score")


def _in_order(rows: DataFrame, key: str, save) -> DataFrame:
    """Rows (group, key) with their rank in the group, largest key first: places in one order over range partitions, less the group's first."""
    there = save(placed(rows, [F.col("group").asc(), F.col(key).desc()], save))
    return there.join(there.groupBy("group").agg(F.min("place").alias("first")), "group").select("group", key, (F.col("place") - F.col("first")).alias("rank"))


def _serve(older: pd.DataFrame, newer: pd.DataFrame) -> pd.DataFrame:
    """Each of some older rows (a, tbs) takes the largest newer one (b, title) that is left among the titles tbs; largest a first."""
    left = {t: sorted(bs) for t, bs in newer.groupby("title")["b"]}
    out = []
    for a, tbs in sorted(zip(older["a"], older["tbs"], strict=True), reverse=True):
        best = max((t for t in tbs if left.get(t)), key=lambda t: left[t][-1], default=None)
        if best is not None:
            out.append((a, left[best].pop()))
    return pd.DataFrame(out, columns=["a", "b"])


def _pair_level(g: DataFrame, n: DataFrame, edges: DataFrame, save) -> list[DataFrame]:
    """Greedy pairs (a, b) of free rows whose titles have one score. Titles that all meet all of the others' form a group whose rows are paired by rank. The rest is served in the order of a, SERVED
    rows a time: of each title no more rows are needed then than there are that ask for it."""
    code = lambda c: F.sha2(F.to_json(F.array_sort(F.collect_set(c))), 256)
    met = edges.join(edges.groupBy("ta").agg(code("tb").alias("ha")), "ta").join(edges.groupBy("tb").agg(code("ta").alias("hb")), "tb")
    one = lambda by, c: met.groupBy(by).agg((F.min(c) == F.max(c)).alias(f"whole_{by}"))
    met = save(met.join(one("ta", "hb"), "ta").join(one("tb", "ha"), "tb").select("ta", "tb", F.when(F.col("whole_ta") & F.col("whole_tb"), F.concat("ha", "hb")).alias("group")))
    closed, out = met.filter("group is not null"), []
    if not closed.isEmpty():
        side = lambda rows, key, t: _in_order(rows.join(closed.select(F.col(t).alias("title"), "group").distinct(), "title").select("group", key), key, save)
        out.append(save(side(g, "a", "ta").join(side(n, "b", "tb"), ["group", "rank"]).select("a", "b")))
    asked = met.filter("group is null").groupBy(F.col("ta").alias("title")).agg(F.collect_list("tb").alias("tbs"))
    if not asked.isEmpty():
        pool, wares = save(g.join(asked, "title").select("a", "tbs")), n
        while not pool.isEmpty():
            turn = save(pool.orderBy(F.desc("a")).limit(SERVED))
            wanted = turn.select(F.explode("tbs").alias("title")).groupBy("title").agg(F.count("*").alias("most"))
            ranked = wares.join(wanted, "title").withColumn("i", F.row_number().over(Window.partitionBy("title").orderBy(F.desc("b")))).filter(F.col("i") <= SERVED).filter("i <= most")
            here = F.lit(0).alias("turn")
            found = save(turn.select(here, "a", "tbs").groupBy("turn").cogroup(ranked.select(here, "b", "title").groupBy("turn")).applyInPandas(_serve, "a string, b string"))
            out.append(found)
            last = turn.agg(F.min("a")).first()[0]
            pool, wares = save(pool.filter(F.col("a") < last)), save(wares.join(found.select("b"), "b", "left_anti"))
    return out


def assign_renames(gone_rows: DataFrame, added_rows: DataFrame, save, parts: int = 6) -> DataFrame:
    """What assign() gives over renames_by_key(), in time and space that follow the rows and not their pairs. Scores of similar titles, whose number the titles' lengths bound, are taken
    one after the other, the best first; then the pairs that only their rests make alike, few a row, are assigned as they are."""
    g, n, alike, same = _likeness(gone_rows, added_rows, parts, save)
    taken = None
    for score in sorted((r[0] for r in alike.select("score").distinct().collect()), reverse=True):
        free = lambda df, t: df.select(F.col("title").alias(t)).distinct()
        edges = save(alike.filter(F.col("score") == score).join(free(g, "ta"), "ta", "left_semi").join(free(n, "tb"), "tb", "left_semi").select("ta", "tb"))
        if edges.isEmpty():
            continue
        for pairs in _pair_level(g, n, edges, save):
            own = pairs.select(F.col("a").alias("prev_uid"), F.col("b").alias("uid"), F.lit(score).alias("score"))
            taken = own if taken is None else taken.union(own)
            g, n = g.join(pairs.select("a"), "a", "left_anti"), n.join(pairs.select("b"), "b", "left_anti")
        g, n = save(g), save(n)
    rest = same.join(g.select("a"), "a", "left_semi").join(n.select("b"), "b", "left_semi").select(F.col("a").alias("prev_uid"), F.col("b").alias("uid"), "score")
    last = assign(rest, save)
    return last if taken is None else taken.union(last)


def assign(pairs: DataFrame, save) -> DataFrame:
    """One-to-one pairs, the best first, ties by the larger prev_uid, then uid. Each pass keeps the pairs that are best for
    both sides, which greedy choice would take too, and drops what they use up. `save` writes a table and reads it again."""
    order = F.struct("score", "prev_uid", "uid")
    left, taken = save(pairs), None
    while not left.isEmpty():
        best_prev = left.groupBy("prev_uid").agg(F.max(order).alias("x"))
        best_next = left.groupBy("uid").agg(F.max(order).alias("x"))
        mutual = save(best_prev.select("x").intersect(best_next.select("x")).select("x.prev_uid", "x.uid", "x.score"))
        taken = mutual if taken is None else taken.union(mutual)
        left = save(left.join(mutual.select("prev_uid"), "prev_uid", "left_anti").join(mutual.select("uid"), "uid", "left_anti"))
    return pairs.select("prev_uid", "uid", "score") if taken is None else taken


def unexplained(gone_rows: DataFrame, dispositions: DataFrame, renamed: DataFrame) -> DataFrame:
    """Gone rows without a disposition and without a new name."""
    return gone_rows.join(dispositions.select("uid"), "uid", "left_anti").join(renamed.select(F.col("prev_uid").alias("uid")), "uid", "left_anti")


def summary(prev: DataFrame, cur: DataFrame, changes: DataFrame, dispositions: DataFrame, renamed: DataFrame) -> DataFrame:
    """(previous, current, added, gone, changed, explained, unexplained) in one row; a changed uid counts once."""
    side = lambda df, name: df.select("uid", F.lit(1).alias(name))
    known = side(dispositions, "told").union(renamed.select(F.col("prev_uid").alias("uid"), F.lit(1).alias("told"))).distinct()
    rows = side(prev, "p").join(side(cur, "c"), "uid", "full_outer").join(known, "uid", "left").join(side(changes, "x").distinct(), "uid", "left")
    went = F.col("c").isNull()
    return rows.agg(
        F.count("p").alias("previous"), F.count("c").alias("current"), F.count_if(F.col("p").isNull()).alias("added"), F.count_if(went).alias("gone"), F.count("x").alias("changed"),
        F.count_if(went & F.col("told").isNotNull()).alias("explained"), F.count_if(went & F.col("told").isNull()).alias("unexplained"),
    )


def gate(open_rows: DataFrame, allow: bool = False) -> DataFrame:
    """K60 (unexplained, publish): a disappearance that nobody explained stops a publication, unless allowed."""
    return open_rows.agg(F.count("*").alias("unexplained")).withColumn("publish", (F.col("unexplained") == 0) | F.lit(allow))


def report(parts: dict[str, DataFrame]) -> DataFrame:
    """The parts of a comparison as lines (part, uid, line), the latter in JSON: what the report's file holds."""
    out = None
    for name, df in parts.items():
        line = df.select(F.lit(name).alias("part"), "uid", F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])).alias("line"))
        out = line if out is None else out.union(line)
    return out


def disposition_rejects(log: DataFrame, known: DataFrame, codes: list[str]) -> DataFrame:
    """(uid, seq, reason) of records with an unknown uid or code, or renamed without saying to what."""
    marked = log.join(known.select("uid", F.lit(True).alias("met")), "uid", "left")
    reason = F.when(F.col("met").isNull(), "unknown uid").when(~F.coalesce(F.col("code").isin(codes), F.lit(False)), "unknown code").when((F.col("code") == "renamed") & F.col("to").isNull(), "renamed to nothing")
    return marked.withColumn("reason", reason).filter("reason is not null").select("uid", "seq", "reason")


def place_facts(prev: DataFrame, cur: DataFrame, facts: list[str]) -> DataFrame:
    """(place, facts): each fact's first non-blank value, previous rows first, in row order."""
    both = prev.select("place", F.lit(0).alias("source"), "row_no", *facts).union(cur.select("place", F.lit(1).alias("source"), "row_no", *facts))
    order = F.struct("source", "row_no")
    filled = lambda c: F.nullif(F.trim(F.col(c).cast("string")), F.lit("")).isNotNull()
    first = [F.min(F.when(filled(c), F.struct(order.alias("o"), F.col(c).alias("v"))))["v"].alias(c) for c in facts]
    return both.filter("place is not null").groupBy("place").agg(*first)


def carry_forward(batch: DataFrame, prev: DataFrame, places: DataFrame, always: list[str], by_place: list[str]) -> DataFrame:
    """Fill a batch's blanks: columns of `always` and those that the row asks for (array `carry`) from the previous row of
    uid, or of `carry_from` if given; then `by_place` columns from the facts of the row's place. `filled` names what was filled."""
    columns = sorted({*always, *[c for c in prev.columns if c not in ("uid", "row_no", "place")]})
    old = prev.select(F.col("uid").alias("_key"), *[F.col(c).alias(f"old_{c}") for c in columns])
    rows = batch.withColumn("_key", F.coalesce("carry_from", "uid")).join(old, "_key", "left")
    rows = rows.join(places.select("place", *[F.col(c).alias(f"at_{c}") for c in by_place]), "place", "left")
    blank = lambda c: F.nullif(F.trim(F.col(c).cast("string")), F.lit("")).isNull()
    out, marks = {}, []
    for c in columns:
        asked = F.lit(True) if c in always else F.array_contains(F.coalesce("carry", F.array().cast("array<string>")), c)
        by_uid = F.when(blank(c) & asked, F.col(f"old_{c}"))
        by = F.when(blank(c) & by_uid.isNull(), F.col(f"at_{c}")) if c in by_place else F.lit(None).cast(batch.schema[c].dataType)
        out[c] = F.coalesce(F.when(~blank(c), F.col(c)), by_uid, by)
        kind = F.lit("always") if c in always else F.lit("asked")
        marks.append(F.when(by_uid.isNotNull(), F.concat(kind, F.lit(f":{c}"))).when(by.isNotNull(), F.lit(f"place:{c}")))
    return rows.withColumn("filled", F.array_compact(F.array(*marks))).withColumns(out).select(*batch.columns, "filled")


def carry_misses(batch: DataFrame, prev: DataFrame) -> DataFrame:
    """(uid, wanted) of rows that ask for columns (array `carry`) of a previous row that isn't there."""
    asked = batch.filter(F.size(F.coalesce("carry", F.array().cast("array<string>"))) > 0).select("uid", F.coalesce("carry_from", "uid").alias("wanted"))
    return asked.join(prev.select(F.col("uid").alias("wanted")), "wanted", "left_anti").select("uid", "wanted")


def fill_statistics(filled: DataFrame) -> DataFrame:
    """(kind, n): how many cells were filled always, on request and by place; one pass."""
    kinds = ["always", "asked", "place"]
    count = lambda kind: F.sum(F.size(F.filter("filled", lambda x: x.startswith(f"{kind}:"))))
    sums = filled.agg(*[F.coalesce(count(k), F.lit(0)).alias(k) for k in kinds])
    return sums.select(F.inline(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("n")) for k in kinds])))


def unknown_columns(given: list[str], known: list[str]) -> list[str]:
    """Columns of a batch that the set doesn't have: reported and left out."""
    return [c for c in given if c not in known and not c.startswith("_")]


def unknown_fields(batch: DataFrame, fields: str, known: list[str]) -> DataFrame:
    """(field, n) of a batch whose rows are maps: fields that the set doesn't have, and in how many rows they are."""
    odd = F.array_except(F.map_keys(fields), F.array(*map(F.lit, known)))
    return batch.select(F.explode(F.filter(odd, lambda c: ~c.startswith("_"))).alias("field")).groupBy("field").agg(F.count("*").alias("n"))


def carry_rejects(batch: DataFrame, never: list[str], known: list[str]) -> DataFrame:
    """(uid, column, reason) of requests to carry what must not be, or what doesn't exist. `*` asks for all that may."""
    each = batch.select("uid", F.explode(F.filter(F.transform(F.split("request", "[|]"), lambda x: F.trim(x)), lambda c: (c != "") & (c != "*"))).alias("column"))
    reason = F.when(F.col("column").isin(never), "forbidden").when(~F.col("column").isin(known), "unknown")
    return each.withColumn("reason", reason).filter("reason is not null").distinct()


def append_ids(existing: DataFrame, batch: DataFrame, order: str, save) -> DataFrame:
    """A batch with new_id after the largest id there is, by `order` (unique). Rows are numbered within range partitions, of which the
    driver gets the sizes alone, so that no task numbers all rows. `save` writes a table and reads it again."""
    last = existing.agg(F.max("id")).first()[0] or 0
    return placed(batch, [F.col(order).asc()], save).withColumn("new_id", F.lit(last) + F.col("place")).drop("place")


def previous_rows(prev: DataFrame, uids: DataFrame, names: DataFrame) -> DataFrame:
    """(uid, row) of a snapshot's rows that are asked for by uid or by place, as JSON without blank columns."""
    asked = prev.join(uids.select("uid"), "uid", "left_semi").union(prev.join(names.select("place"), "place", "left_semi").select(prev.columns)).dropDuplicates(["uid"])
    return asked.select("uid", F.to_json(F.struct(*[F.nullif(F.col(c).cast("string"), F.lit("")).alias(c) for c in prev.columns])).alias("row"))
