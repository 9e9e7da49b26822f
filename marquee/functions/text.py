"""Text keys: the search fold, the identity norm, content and natural keys, similarity, highlighting, link checks.

The fold and the norm have a native form, exact for texts of the covered characters, and an Arrow form for any text."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Marks that all count as one dash, and the range of katakana that has hiragana 0x60 below.
DASHES = "ー‐‑‒–—―−－" + "ｰ"  # the last one is added: half-width, which becomes the first one in the compatibility form
KATAKANA = range(0x30A1, 0x30F7)
# Fixed value: characters that the identity norm drops.
DROPPED = r"""[\s　\-‐‑–—―ー~〜:：;；,，.．/／\\|｜'"“”‘’`（）()\[\]「」『』【】〈〉《》〔〕!！?？*＊+＋=＝&＆#＃@＠…·・]+"""
#: What the native fold covers: ASCII, Latin letters with accents, kana, ideographs, full-width ASCII.
COVERED = "^[\\x00-\\x7e\\u00c0-\\u00d6\\u00d8-\\u00f6\\u00f8-\\u00ff\\u3041-\\u3094\\u30a1-\\u30fa\\u30fc\\u3000\\uff01-\\uff5e\\u4e00-\\u9fff]*$"


def _shift() -> tuple[str, str]:
    wide = [chr(c) for c in range(0xFF01, 0xFF5F)] + ["　"]
    plain = [chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)] + [" "]
    kana = [chr(c) for c in KATAKANA]
    soft = [chr(c - 0x60) for c in KATAKANA]
    dash = [c for c in DASHES if c not in wide]
    return "".join(wide + kana + dash), "".join(plain + soft + ["-"] * len(dash))


def either(c: Column, known: Column, native: Column, whole) -> Column:
    """The native form where the text is `known` to it, else the whole one, which gets no other text."""
    return F.when(c.isNull() | known, native).otherwise(whole(F.when(~known, c)))


def _native_fold(c: Column) -> Column:
    return F.lower(F.translate(c, *_shift()))


def fold(c: Column) -> Column:
    """Lower-case, compatibility forms and full width to plain ones, katakana to hiragana, dashes to one."""
    return either(c, c.rlike(COVERED), _native_fold(c), fold_any)


@lru_cache(maxsize=65536)
def _fold_unit(unit: str) -> str:
    out = unicodedata.normalize("NFKC", unit).lower()
    return "".join("-" if ch in DASHES else chr(ord(ch) - 0x60) if ord(ch) in KATAKANA else ch for ch in out)


def _units(text: str) -> list[str]:
    """Characters, a half-width kana with its voiced mark being one."""
    out: list[str] = []
    for ch in text:
        if ch in "ﾞﾟ" and out and "ｦ" <= out[-1][0] <= "ﾝ" and len(out[-1]) == 1:
            out[-1] += ch
        else:
            out.append(ch)
    return out


def fold_text(text: str) -> str:
    return "".join(map(_fold_unit, _units(text)))


def fold_any(c: Column) -> Column:
    """The fold for any text."""

    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in texts:
            yield s.map(fold_text, na_action="ignore")

    return F.pandas_udf(run, "string")(c)


def terms(query: str) -> list[str]:
    """A query's folded terms."""
    return fold_text(query).split()


def has_all_terms(folded: str, query: str) -> Column:
    out = F.lit(True)
    for t in terms(query):
        out = out & F.col(folded).contains(t)
    return out


#: What free text is searched in, of the columns that rows have; arrays are joined.
SEARCHED = ("title", "kana", "venue", "area", "desc", "note", "venues", "artists")


def haystack(rows: DataFrame | None = None, labels: list[Column] | None = None) -> Column:
    """The text that free text is searched in. With `rows`, every column of SEARCHED that they have, then the texts of `labels` (arrays);
    without, the columns of the listing table."""
    if rows is None:
        return F.concat_ws(" ", F.col("title"), F.array_join("venues", " "), F.col("area"), F.array_join("cats", " "))
    kinds = dict(rows.dtypes)
    part = lambda c: F.array_join(c, " ") if kinds[c].startswith("array") else F.col(c)
    return F.concat_ws(" ", *[F.nullif(part(c), F.lit("")) for c in SEARCHED if c in kinds], *[F.nullif(F.array_join(x, " "), F.lit("")) for x in labels or []])


def norm(c: Column) -> Column:
    """Identity norm: fold, then drop blanks, dashes, brackets and punctuation."""
    return either(c, c.rlike(COVERED) & ~c.contains("ß"), F.regexp_replace(_native_fold(c), DROPPED, ""), norm_any)


def norm_text(text: str) -> str:
    return re.sub(DROPPED, "", "".join(chr(ord(ch) - 0x60) if ord(ch) in KATAKANA else ch for ch in unicodedata.normalize("NFKC", text)).casefold())


def norm_any(c: Column) -> Column:
    """The identity norm for any text."""

    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in texts:
            yield s.map(norm_text, na_action="ignore")

    return F.pandas_udf(run, "string")(c)


def plain_any(c: Column, casefold: bool = False) -> Column:
    """The text in NFKC."""

    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in texts:
            yield s.map(lambda t: unicodedata.normalize("NFKC", t).casefold() if casefold else unicodedata.normalize("NFKC", t), na_action="ignore")

    return F.pandas_udf(run, "string")(c)


def content_uid(*parts: Column) -> Column:
    """A short hash of the non-empty parts: h = 33 h + code modulo 2^32 from 5381, in base 36. Codes are UTF-16 units."""
    whole = F.concat_ws("|", *[F.nullif(p.cast("string"), F.lit("")) for p in parts])
    far = lambda c: F.array(F.lit(0xD800) + F.shiftright(c - 0x10000, 10), F.lit(0xDC00) + (c - 0x10000) % 1024)
    codes = F.flatten(F.transform(F.filter(F.split(whole, ""), lambda ch: ch != ""), lambda ch: F.when(F.ascii(ch) > 0xFFFF, far(F.ascii(ch).cast("bigint"))).otherwise(F.array(F.ascii(ch).cast("bigint")))))
    return F.lower(F.conv(F.aggregate(codes, F.lit(5381).cast("bigint"), lambda h, ch: (h * 33 + ch) % (1 << 32)).cast("string"), 10, 36))


def natural_key(title: Column, venues: Column, start: Column) -> Column:
    return F.array(norm(title), F.coalesce(norm(F.get(venues, F.lit(0))), F.lit("")), F.coalesce(start.cast("string"), F.lit("")))


def film_key(title: Column, released: Column, kind: Column, theatre: Column) -> Column:
    """A film's natural key: title, day, way of screening, and the first theatre (of a list cut by `|`) but for new films, whose
    theatres come and go."""
    kind = F.trim(F.coalesce(kind, F.lit("")))
    place = F.when(kind.startswith("new"), F.lit("")).otherwise(F.trim(F.split_part(F.coalesce(theatre, F.lit("")), F.lit("|"), F.lit(1))))
    return F.array(F.coalesce(norm(title), F.lit("")), F.coalesce(norm(released.cast("string")), F.lit("")), norm(kind), norm(place))


def key_uid(key: Column, digits: int = 40) -> Column:
    """SHA-1 over the key's parts; show 8 digits, join on all."""
    return F.substring(F.sha1(F.array_join(key, "\x1f").cast("binary")), 1, digits)


def character_counts(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, ch, nth, size): the multiset of a text's characters as distinct rows, nth numbering equal ones."""
    chars = F.filter(F.split(F.col(text), ""), lambda ch: ch != "")
    each = rows.select(key, F.explode(chars).alias("ch"), F.size(chars).alias("size")).groupBy(key, "size", "ch").agg(F.count("*").alias("n"))
    return each.select(key, "size", "ch", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("nth"))


def multiset_similarity(a: Column, b: Column) -> Column:
    """Shared characters, counted with repetition, over the shorter length; 0 for blank texts. Bounded by the two texts' length."""
    chars = lambda c: F.filter(F.split(c, ""), lambda ch: ch != "")
    times = lambda arr, ch: F.size(F.filter(arr, lambda x: x == ch))
    x, y = chars(a), chars(b)
    both = F.aggregate(F.array_distinct(x), F.lit(0), lambda s, ch: s + F.least(times(x, ch), times(y, ch)))
    short = F.least(F.size(x), F.size(y))
    return F.when(short > 0, both / short).otherwise(F.lit(0.0))


def numbered_characters(c: Column) -> Column:
    """A text's multiset of characters as different texts: each character with how many equal ones stand before it."""
    chars = F.filter(F.split(c, ""), lambda ch: ch != "")
    number = lambda own: F.transform(own, lambda ch, i: F.concat(ch, F.size(F.filter(F.slice(own, 1, i), lambda x: x == ch)).cast("string")))
    return F.transform(F.array(chars), number)[0]


def shared_part(a: Column, b: Column) -> Column:
    """multiset_similarity() of two texts of which these are the numbered characters."""
    short = F.least(F.size(a), F.size(b))
    return F.when(short > 0, F.size(F.array_intersect(a, b)) / short).otherwise(F.lit(0.0))


def mark_text(text: str, wanted: list[str]) -> str:
    """The text with <mark> around what matches the folded terms."""
    units = _units(text) if "ﾞ" in text or "ﾟ" in text else text
    folds = list(map(_fold_unit, units))
    folded = "".join(folds)
    owner = range(len(units)) if len(folded) == len(units) else [i for i, f in enumerate(folds) for _ in f]  # no fold is empty
    spans = []
    for t in wanted:
        at = folded.find(t)
        while at >= 0:
            spans.append((owner[at], owner[at + len(t) - 1] + 1))
            at = folded.find(t, at + len(t))
    out, done, last = [], 0, None
    for start, end in sorted(spans):
        if start > done or last is None:
            out += ["</mark>"] * (last is not None) + [*units[done:start], "<mark>"]
            last = done = start
        out += units[done:end]
        done = max(done, end)
    return "".join([*out, *["</mark>"] * (last is not None), *units[done:]])


def text_slices(column: pa.Array, most: int = 1_000_000) -> Iterator[pa.Array]:
    """A column's texts in slices of that many bytes, or of one text that has more."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    start = 0
    while start < len(ends):
        end = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + most, "right")))
        yield column.slice(start, end - start)
        start = end


def marked(columns: Iterator[pa.Array], wanted: list[str]) -> Iterator[pa.Array]:
    """Columns of texts with their marks, a slice at a time."""
    for column in columns:
        for part in text_slices(column):
            yield pa.array([None if t is None else mark_text(t, wanted) for t in part.to_pylist()], pa.string())


def highlight(c: Column, query: str) -> Column:
    """The text as written, with <mark> around what matches the folded terms."""
    wanted = terms(query)

    def mark(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return marked(columns, wanted)

    return F.arrow_udf(mark, "string")(c)


def safe_url(c: Column) -> Column:
    """The trimmed link if its scheme is http(s), mailto or tel, or if it is a path, else null."""
    u = F.trim(c)
    return F.when(u.rlike(r"(?i)^(https?|mailto|tel):") | (u.rlike(r"^(/|\./|#)") & ~u.startswith("//")), u)


def clip(c: Column, width: int) -> Column:
    flat = F.translate(c, "\t\n\r", "   ")
    return F.when(F.length(flat) > width, F.concat(F.substring(flat, 1, width - 1), F.lit("…"))).otherwise(flat)


def label(table: dict[str, str], c: Column, default: str | None = None) -> Column:
    """A key's label; unknown keys have `default`, or themselves."""
    known = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])[c]
    return F.coalesce(known, c if default is None else F.lit(default))
