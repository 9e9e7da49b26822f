"""Secret scans with multipart credential linking, in DataFrame operations alone.

Strong spans are found by pattern: assignments, access ids and hex strings. Weak parts (identifiers, short secrets,
endpoints) are kept only where complementary parts lie within a scope of `scope` characters: a secret with an identifier, an
identifier with a secret, an endpoint with both. The interval join goes by buckets as wide as the scope: of each bucket and class
only the first and last start matter, so its rows grow with the parts and never with their pairs.

Positions are code points. Null text counts as empty. Repeated rows get equal spans each. An empty table gives no row.
Input columns named like the outputs are replaced.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, saved
from .decontam import key

SCOPE, MASK = 200, "[secret]"
_SET = r"""["']?\x20*[:=]\x20*["']?"""
#: Kind -> (pattern, whether group 1 must have 12 characters, words of which a matching lower-cased text holds one, class, strong).
KINDS: dict[str, tuple[str, bool, tuple[str, ...], str, bool]] = {
    "assign": (rf"(?i:password|passwd|secret|token|api_?key){_SET}([A-Za-z0-9+/_.=-]+)", True, ("password", "passwd", "secret", "token", "apikey", "api_key"), "secret", True),
    "access": (r"(AKIA[A-Z0-9]{14,})", False, ("akia",), "ident", True),
    "hex": (r"([0-9a-f]{16,})", False, (), "secret", True),
    "ident": (rf"(?i:access[_-]?key(?:[_-]?id)?|client[_-]?id|user(?:_?name)?|login|account(?:[_-]?id)?){_SET}([A-Za-z0-9@._+-]{{3,}})", False, ("access", "client", "user", "login", "account"), "ident", False),
    "weak": (rf"(?i:pass(?:word|wd|phrase)?|pwd|secret|token|api_?key|auth){_SET}([^\s\"'<>,;]{{4,}})", False, ("pass", "pwd", "secret", "token", "api", "auth"), "secret", False),
    "endpoint": (r"(?i:(?:https?|ftp|ssh|mysql|postgres(?:ql)?|redis|mongodb|jdbc:[a-z]+)://)([^\s\"'<>]+)", False, ("://",), "endpoint", False),
}
ORDER = {kind: i for i, kind in enumerate(KINDS)}
NEEDS = {"secret": ["ident"], "ident": ["secret"], "endpoint": ["ident", "secret"]}
SPAN = "array<struct<start:int,kind_no:int,end:int,kind:string>>"


def let(value: Column, use) -> Column:
    """use(value), with the value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def running(values: Column, merge) -> Column:
    """Of an array of ints, merge() of each element and those before it. Blocks of about the root of its length keep the copies
    that appending makes short."""
    scan = lambda xs, first: F.aggregate(xs, F.struct(first.alias("at"), F.array().cast("array<int>").alias("out")), lambda acc, x: let(merge(acc["at"], x), lambda y: F.struct(y.alias("at"), F.concat(acc["out"], F.array(y)).alias("out"))), lambda acc: acc["out"])

    def blocks(xs: Column) -> Column:
        size = F.ceil(F.sqrt(F.size(xs))).cast("int")
        cut = F.transform(F.sequence(F.lit(0), F.ceil(F.size(xs) / size).cast("int") - 1), lambda i: F.slice(xs, i * size + 1, size))
        return let(cut, lambda c: F.flatten(F.zip_with(c, bases(c), scan)))

    def bases(c: Column) -> Column:
        whole = F.transform(c, lambda xs: F.aggregate(xs, F.lit(0), merge))
        return F.concat(F.array(F.lit(0)), scan(F.slice(whole, F.lit(1), F.size(c) - 1), F.lit(0)))

    return let(values, lambda xs: F.when(F.size(xs) == 0, F.array().cast("array<int>")).otherwise(blocks(xs)))


def spans_of(text: Column, low: Column, kind: str) -> Column:
    """Leftmost non-overlapping matches of a kind: lengths between and of the matches add up to their positions."""
    pattern, long_value, words, _, _ = KINDS[kind]
    gaps = F.transform(F.split(text, pattern, -1), lambda s: F.length(s))
    group = lambda m: F.length(F.regexp_extract(m, pattern, 1)) if long_value else F.lit(12)
    matches = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m: F.struct(F.length(m).alias("size"), group(m).alias("value")))

    def spans(found: Column) -> Column:
        steps = F.zip_with(F.slice(gaps, F.lit(1), F.size(found)), found, lambda g, m: g + m["size"])
        span = lambda end, m: F.struct((end - m["size"]).alias("start"), F.lit(ORDER[kind]).alias("kind_no"), end.alias("end"), F.lit(kind).alias("kind"), m["value"].alias("value"))
        kept = F.filter(F.zip_with(running(steps, lambda x, y: x + y), found, span), lambda s: s["value"] >= 12)
        return F.transform(kept, lambda s: s.dropFields("value")).cast(SPAN)

    none = F.array().cast(SPAN)
    hit = reduce(Column.__or__, [low.contains(w) for w in words]) if words else F.lit(True)
    return F.when(hit, let(matches, lambda m: F.when(F.size(m) > 0, spans(m)).otherwise(none))).otherwise(none)


def parts(docs: DataFrame) -> DataFrame:
    """(doc_id, k1, k2, strong, weak): k1 and k2 name a document by its id and text; the spans are sorted arrays."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), *key(docs), F.lower(text).alias("low"))
    found = {k: spans_of(F.col("text"), F.col("low"), k) for k in KINDS}
    pick = lambda strong: F.array_sort(F.concat(*[c for k, c in found.items() if KINDS[k][4] == strong]))
    return base.select("doc_id", "k1", "k2", pick(True).alias("strong"), pick(False).alias("weak"))


def linked(found: DataFrame, scope: int) -> DataFrame:
    """(k1, k2, linked): weak spans that have the parts they need within the scope, by an interval join."""
    kinds = F.create_map(*[F.lit(x) for k, v in KINDS.items() for x in (k, v[3])])
    part = (
        found.filter(F.size("weak") > 0).select("k1", "k2", F.explode(F.concat("weak", "strong")).alias("span"), F.size("strong").alias("_"))
        .select("k1", "k2", "span", kinds[F.col("span.kind")].alias("class"), F.floor(F.col("span.start") / scope).alias("bucket"))
    )
    edges = part.groupBy("k1", "k2", "bucket", "class").agg(F.min("span.start").alias("first"), F.max("span.start").alias("last"))
    # a weak span that begins with a strong one is that one
    own = F.array_sort(F.collect_set("span"))
    begun = part.groupBy("k1", "k2", "bucket", "span.start").agg(F.min("span.kind_no").alias("least"), own.alias("own")).filter(F.col("least") >= ORDER["ident"])
    weak = begun.select("k1", "k2", "bucket", F.explode("own").alias("span")).withColumn("class", kinds[F.col("span.kind")])
    near = weak.select("k1", "k2", "span", "class", F.explode(F.array(F.col("bucket") - 1, F.col("bucket"), F.col("bucket") + 1)).alias("bucket"))
    at = F.col("span.start")
    met = near.join(edges.withColumnRenamed("class", "other"), ["k1", "k2", "bucket"]).filter((F.col("last") >= at - scope) & (F.col("first") <= at + scope) & (F.col("other") != F.col("class")))
    whole = met.groupBy("k1", "k2", "span", "class").agg(F.collect_set("other").alias("others"))
    needs = F.create_map(*[x for k, v in NEEDS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    enough = whole.filter(F.size(F.array_except(needs[F.col("class")], F.col("others"))) == 0)
    return enough.groupBy("k1", "k2").agg(F.collect_list("span").alias("linked"))


def scan(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """(doc_id, k1, k2, strong, spans) a row for each document: strong spans, and those with the linked weak ones, sorted."""
    found = saved(parts(docs), "secrets")
    return found.join(linked(found, scope), ["k1", "k2"], "left").select(
        "doc_id", "k1", "k2", "strong", F.array_sort(F.concat("strong", F.coalesce("linked", F.array().cast(SPAN)))).alias("spans")
    )


def text_of(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def report(scanned: DataFrame) -> DataFrame:
    count = lambda kind: F.size(F.filter("strong", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return scanned.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(text_of(F.col("strong")), 256).alias("base_sha256"), text_of(F.col("spans")).alias("spans"))


def masked(text: Column, spans: Column, mask: str) -> Column:
    """The text with each of its sorted spans as `mask`, overlapping ones together. What lies between them is put together from pieces
    of the text, as to count characters from the front takes as long as the text is."""
    size = 4096
    furthest = running(F.transform(spans, lambda s: s["end"]), lambda x, y: F.greatest(x, y))
    before = lambda f: F.concat(F.array(F.lit(0)), f)

    def between(pieces: Column) -> Column:
        gap = lambda a, b: F.array_join(F.transform(F.sequence(F.floor(a / size), F.floor((b - 1) / size)), lambda k: F.get(pieces, k.cast("int")).substr((F.greatest(a - k * size, F.lit(0)) + 1).cast("int"), (b - F.greatest(a, k * size)).cast("int"))), "")
        # a gap before each span that begins behind all earlier ones, and one behind the last
        cuts = let(furthest, lambda f: F.zip_with(before(f), F.concat(F.transform(spans, lambda s: s["start"]), F.array(F.length(text))), lambda a, b: F.struct(a.alias("a"), b.alias("b"))))
        return F.array_join(F.transform(F.filter(cuts, lambda c: c["a"] <= c["b"]), lambda c: F.when(c["a"] == c["b"], F.lit("")).otherwise(gap(c["a"], c["b"]))), mask)

    return let(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{size}}}"), F.lit(0)), between)


def redact(docs: DataFrame, scope: int = SCOPE, mask: str = MASK) -> DataFrame:
    """`docs` with every span of its text replaced by `mask` (overlapping ones by one) and n_chars, if there, counted anew."""
    k1, k2, spans = fresh(docs, "k1", "k2", "spans")
    found = scan(docs.select("doc_id", "text"), scope).filter(F.size("spans") > 0)
    marked = saved(found.select(F.col("k1").alias(k1), F.col("k2").alias(k2), F.col("spans").alias(spans)).dropDuplicates([k1, k2]), "secret-spans")
    columns = docs.columns
    joined = docs.withColumns(dict(zip((k1, k2), key(docs), strict=True))).join(marked, [k1, k2], "left")
    clean = F.col(spans).isNull()
    out = joined.withColumn("text", F.when(clean, F.col("text")).otherwise(masked(F.col("text"), F.col(spans), mask)))
    if "n_chars" in columns:
        out = out.withColumn("n_chars", F.when(clean, F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return out.select(*[f"`{c}`" for c in columns])
