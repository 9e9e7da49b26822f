"""Benchmark decontamination over a distributed positional inverted index, in DataFrame operations alone.

The index stores a posting (term, k1, k2, pos) for each occurrence of a benchmark term in a document. A window is `width`
consecutive words of an item (all its words if it has fewer). From a window's rarest term to its second rarest the posting
lists are intersected, adjusted by the terms' offsets; where their distance is off by at most `slop`, the remaining terms are looked
up in those documents. If every term stands at its offset it is a phrase match, if within `slop` of it a proximity match.

Words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of the text with A-Z lower-cased. Null text has no words. Documents are told
apart by id and text, so that repeated rows get equal results; their postings are
intersected once. Items of equal text all count; an item
without words matches nothing. Empty tables give no match. Input columns other than those named are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ascii_lower, saved

WIDTH = 10
#: Bytes up to which a saved table of terms, windows or document keys is sent to all executors; beyond, Spark joins by shuffle.
BROADCAST_BYTES = 32 << 20
#: How far a term of a proximity match may stand from its place.
SLOP = 2
NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    return F.filter(F.split(ascii_lower(F.coalesce(text.cast("string"), F.lit(""))), NO_WORD, -1), lambda w: w != "")


def key(docs: DataFrame) -> tuple[Column, Column]:
    """(k1, k2) of a document: its id, and a hash of its text whose last bit tells that the id is null."""
    doc_id = F.col("doc_id").cast("long")
    text = F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))
    return F.coalesce(doc_id, F.lit(-(1 << 63))).alias("k1"), F.shiftleft(text, 1).bitwiseOR(doc_id.isNull().cast("long")).alias("k2")


def id_of(k1: str = "k1", k2: str = "k2") -> Column:
    return F.when(F.col(k2).bitwiseAND(F.lit(1)) == 0, F.col(k1))


def windows(items: DataFrame, width: int = WIDTH) -> DataFrame:
    """(window, item_id, terms): every item's windows, equal ones under one number."""
    w = items.select(F.col("item_id").cast("string").alias("item_id"), words(F.col("text")).alias("w")).filter(F.size("w") > 0)
    last = F.greatest(F.size("w") - width, F.lit(0))
    each = w.select("item_id", F.explode(F.transform(F.sequence(F.lit(0), last), lambda i: F.slice("w", i + 1, width))).alias("terms")).distinct()
    return each.withColumn("window", F.xxhash64(F.array_join("terms", " ")))


def vocabulary(wins: DataFrame) -> DataFrame:
    """(term, word) of the windows' words; term 0 is no word of a text but stands behind the last one of each document."""
    terms = wins.select(F.explode("terms").alias("word")).distinct().select(F.xxhash64("word").alias("term"), "word")
    return saved(terms.union(wins.sparkSession.createDataFrame([(0, "")], "term long, word string")), "terms")


def checked(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """A saved table, marked for broadcast if its rows as they lie in memory take no more than `most` bytes; for wider rows than
    numbers, their strings and arrays are measured."""

    def width(field: T.StructField) -> Column:
        kind, c = field.dataType, F.col(f"`{field.name}`")
        if isinstance(kind, T.ArrayType):
            inner = F.aggregate(c, F.lit(0), lambda n, x: n + F.octet_length(x) + 16) if isinstance(kind.elementType, T.StringType) else F.size(c) * (16 + 8 * len(getattr(kind.elementType, "fields", [])))
            return F.coalesce(inner, F.lit(0)) + 24
        return F.coalesce(F.octet_length(c), F.lit(0)) + 16 if isinstance(kind, T.StringType) else F.lit(8)

    size = df.agg(F.sum(reduce(Column.__add__, [width(f) for f in df.schema], F.lit(16)).cast("long"))).first()[0] or 0
    return F.broadcast(df) if size <= most else df


def build_index(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """The saved postings (term, k1, k2, pos). A document's row of term 0 has its number of words as pos."""
    split = docs.select(*key(docs), F.concat(words(F.col("text")), F.array(F.lit(""))).alias("w"))
    each = split.select("k1", "k2", F.posexplode("w").alias("pos", "word"))
    return saved(each.join(checked(terms), "word").select("term", "k1", "k2", "pos"), "index", compression="zstd")


def rarest_first(index: DataFrame, wins: DataFrame, terms: DataFrame) -> DataFrame:
    """(window, n, order): a window's length, and its (term, offset) pairs from the term with fewest postings on."""
    df = checked(saved(index.groupBy("term").count().withColumnRenamed("count", "df"), "term-counts"))
    flat = wins.select("window", "terms").dropDuplicates(["window"]).select("window", F.posexplode("terms").alias("offset", "word")).join(checked(terms), "word").join(df, "term", "left")
    rank = F.array_sort(F.collect_list(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "offset", "term")))
    return saved(flat.groupBy("window").agg(rank.alias("order")).filter(F.col("order")[0]["df"] > 0).select("window", F.size("order").alias("n"), "order"), "windows")


def cells(pos: Column, slop: int, spread: bool) -> Column:
    """Cells as wide as the slop turn the band join of positions into an equi-join; one side is spread over the cells beside."""
    own = F.floor(pos / (slop + 1))
    return F.explode(F.array(*[own + d for d in (-1, 0, 1)])) if spread and slop else own


def candidates(index: DataFrame, wins: DataFrame, slop: int = 0) -> DataFrame:
    """(window, k1, k2, start, gap): where the two rarest terms of a window stand at their distance, give or take `slop`; gap
    is how far it is off, 0 for a window of one term. start is the place of the window's first word. Postings of repeated rows are
    taken once."""
    rare, second = F.col("order")[0], F.get("order", F.lit(1))
    heads = saved(wins.select("window", rare["term"].alias("term"), rare["offset"].alias("o1"), second["term"].alias("term2"), second["offset"].alias("o2")), "heads")
    start = index.join(checked(heads), "term").select("window", "k1", "k2", (F.col("pos") - F.col("o1")).alias("start"), "term2", "o2").distinct()
    alone = start.filter("term2 is null").select("window", "k1", "k2", "start", F.lit(0).alias("gap"))
    others = saved(heads.select(F.col("term2").alias("term")).filter("term is not null").distinct(), "second-terms")
    seconds = index.join(checked(others), "term", "left_semi")
    lists = seconds.select("k1", "k2", F.col("term").alias("term2"), F.col("pos").alias("pos2")).distinct().withColumn("cell", cells(F.col("pos2"), slop, False))
    pairs = start.filter("term2 is not null").withColumn("want", F.col("start") + F.col("o2")).withColumn("cell", cells(F.col("want"), slop, True))
    met = pairs.join(lists, ["k1", "k2", "term2", "cell"]).withColumn("gap", F.col("pos2") - F.col("want")).filter(F.abs("gap") <= slop)
    best = F.min(F.struct(F.abs("gap").alias("far"), "gap"))["gap"]
    return alone.union(met.groupBy("window", "k1", "k2", "start").agg(best.alias("gap")))


def matches(index: DataFrame, wins: DataFrame, found: DataFrame, slop: int) -> DataFrame:
    """Saved (window, k1, k2, start, n, exact) of candidates all of whose terms stand at their offsets, give or take `slop`; exact
    tells that none is off. The remaining terms' postings are taken from the candidates' documents alone."""
    near = saved(found.join(checked(wins), "window").select("window", "k1", "k2", "start", "gap", "n", "order"), "candidates")
    done = near.filter("n <= 2").select("window", "k1", "k2", "start", "n", (F.col("gap") == 0).alias("exact"))
    rest = near.filter("n > 2").select("window", "k1", "k2", "start", "gap", "n", F.explode(F.slice("order", 3, 1 << 20)).alias("x"))
    rest = rest.select("window", "k1", "k2", "start", "gap", "n", F.col("x.term").alias("term"), (F.col("start") + F.col("x.offset")).alias("want"))
    docs = saved(near.filter("n > 2").select("k1", "k2").distinct(), "candidate-docs")
    lists = index.join(checked(docs), ["k1", "k2"], "left_semi").distinct().withColumn("cell", cells(F.col("pos"), slop, False))
    met = rest.withColumn("cell", cells(F.col("want"), slop, True)).join(lists, ["k1", "k2", "term", "cell"]).filter(F.abs(F.col("pos") - F.col("want")) <= slop)
    at = F.when(F.col("pos") == F.col("want"), F.col("want"))
    whole = met.groupBy("window", "k1", "k2", "start", "gap", "n").agg(F.size(F.collect_set("want")).alias("near"), F.size(F.collect_set(at)).alias("there")).filter("near = n - 2")
    return saved(done.union(whole.select("window", "k1", "k2", "start", "n", ((F.col("gap") == 0) & (F.col("there") == F.col("n") - 2)).alias("exact"))), "phrases")


def match(docs: DataFrame, items: DataFrame, width: int = WIDTH, slop: int = 0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(index, windows, matches): matches are (window, k1, k2, start, n, exact), exact phrases and, with a slop, proximity matches: every
    term within `slop` of where it stands in the phrase, counted from the rarest one."""
    wins = saved(windows(items, width), "windows")
    terms = vocabulary(wins)
    index = build_index(docs, terms)
    order = rarest_first(index, wins, terms)
    return index, wins, matches(index, order, candidates(index, order, slop), slop)


def report(docs: DataFrame, items: DataFrame, width: int = WIDTH, slop: int = 0) -> DataFrame:
    """(doc_id, k1, k2, n_words, n_hit, n_near, items, n_items, contaminated) a row for each document. n_near counts the windows that have
    a proximity match but no exact one; all else is of exact matches."""
    index, wins, found = match(docs, items, width, slop)
    hits = found.filter("exact")
    order = Window.partitionBy("k1", "k2").orderBy("start")
    spans = hits.groupBy("k1", "k2", "start").agg(F.max("n").alias("n"))
    end = F.max(F.col("start") + F.col("n")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    new = F.greatest(F.col("start") + F.col("n") - F.greatest("start", F.coalesce(end, F.col("start"))), F.lit(0))
    hit = spans.withColumn("new", new).groupBy("k1", "k2").agg(F.sum("new").alias("n_hit"))
    near = found.groupBy("k1", "k2", "window").agg(F.max("exact").alias("exact")).groupBy("k1", "k2").agg(F.sum((~F.col("exact")).cast("long")).alias("n_near"))
    own = hits.select("k1", "k2", "window").distinct().join(checked(saved(wins.select("window", "item_id").distinct(), "window-items")), "window")
    items_of = own.groupBy("k1", "k2").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    all_docs = index.filter("term = 0").select("k1", "k2", F.col("pos").cast("long").alias("n_words"))
    return (
        all_docs.join(hit, ["k1", "k2"], "left").join(near, ["k1", "k2"], "left").join(items_of, ["k1", "k2"], "left")
        .select(
            id_of().alias("doc_id"), "k1", "k2", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("n_near", F.lit(0)).alias("n_near"),
            F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        ).withColumn("n_items", F.size("items").cast("long")).withColumn("contaminated", F.col("n_hit") > 0)
    )


def digest(reported: DataFrame) -> DataFrame:
    return reported.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated", "n_near")
