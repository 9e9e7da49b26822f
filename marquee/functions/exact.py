"""The text norms as tables of characters: exact on the JVM for nearly every text, and without Python for it.

A norm of a text is that of its characters, one by one, unless a character becomes several, or composes with its neighbours in the compatibility form. Of every
character of the basic plane a rule says which it is, by the norm itself and the Unicode data that Python has: those that become one or none go
into a translation, the others, and characters beyond the plane, are `odd`. with_norms() cuts the rows by whether their texts hold odd characters: the others
are translated, and only rows with odd ones are sent to Python, by a filter and a union.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marquee.functions import text


@dataclass(frozen=True)
class Norm:
    """A norm of whole texts; `single` is what the translation does to one character and `after` what is done to the translated text. `composes` says whether neighbours
    are composed; else only half-width voiced marks join the character before them."""

    name: str
    whole: Callable[[str], str]
    single: Callable[[str], str]
    after: Callable[[Column], Column] = lambda c: c
    composes: bool = True


def roster_text(s: str) -> str:
    """NFKC, trimmed, case folded, without ASCII blanks."""
    return "".join(ch for ch in unicodedata.normalize("NFKC", s).strip(" ").casefold() if ch not in " \t\n\r\f\x0b")


def plain_text(s: str) -> str:
    return unicodedata.normalize("NFKC", s)


SEARCH = Norm("search", text.fold_text, text.fold_text, composes=False)
IDENTITY = Norm("identity", text.norm_text, text.norm_text)
ROSTER = Norm("roster", roster_text, lambda ch: unicodedata.normalize("NFKC", ch).casefold(), lambda c: F.regexp_replace(F.trim(c), r"[ \t\n\r\f\x0b]+", ""))
PLAIN = Norm("plain", plain_text, plain_text)


@cache
def _second() -> frozenset[str]:
    """Characters that may compose with the one before them."""
    out = {chr(c) for c in [*range(0x1161, 0x1176), *range(0x11A7, 0x11C3)]}  # vowels and ends of Hangul syllables
    for code in range(0x110000):
        parts = unicodedata.decomposition(chr(code)).split()
        if len(parts) == 2 and not parts[0].startswith("<"):
            out.add(chr(int(parts[1], 16)))
    return frozenset(out)


@cache
def table(norm: Norm) -> tuple[str, str, str]:
    """(characters that change, what they become: those beyond its length are dropped, odd characters)."""
    changed, dropped, odd = [], [], []
    for code in range(0x10000):
        if 0xD800 <= code < 0xE000:
            continue
        ch = chr(code)
        out = norm.single(ch)
        joins = (unicodedata.combining(ch) > 0 or ch in _second() or any(unicodedata.combining(x) or x in _second() for x in unicodedata.normalize("NFKC", ch))) if norm.composes else ch in "ﾞﾟ"
        if joins or len(out) > 1 or ord(out or " ") > 0xFFFF or code == 0:
            odd.append(ch)
        elif not out:
            dropped.append(ch)
        elif out != ch:
            changed.append((ch, out))
    return "".join(a for a, _ in changed) + "".join(dropped), "".join(b for _, b in changed), "".join(odd)


def covered(norm: Norm, c: Column) -> Column:
    """No odd character; a null text is covered."""
    plain = F.octet_length(c) == F.length(c)
    clean = (F.length(F.translate(c, table(norm)[2], "")) == F.length(c)) & ~c.rlike(r"[\x{10000}-\x{10FFFF}]")
    return F.coalesce(F.when(plain & ~c.contains("\0"), True).otherwise(clean), F.lit(True))


def translated(norm: Norm, c: Column) -> Column:
    """The norm of a covered text."""
    return norm.after(F.translate(c, *table(norm)[:2]))


def by_python(norm: Norm, c: Column) -> Column:
    """The norm of any text."""
    whole = norm.whole

    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in texts:
            yield s.map(whole, na_action="ignore")

    return F.pandas_udf(run, "string")(c)


def with_norms(rows: DataFrame, norms: dict[str, tuple[Column, Norm]]) -> DataFrame:
    """`rows` with a column for each entry: the norm of a text. The rows are read twice, so they should be cheap to read."""
    raw = {out: f"_raw_{i}_{out}" for i, out in enumerate(norms)}
    wide = rows.withColumns({raw[out]: c for out, (c, _) in norms.items()})
    known = F.lit(True)
    for out, (_, norm) in norms.items():
        known = known & covered(norm, F.col(f"`{raw[out]}`"))
    native = wide.filter(known).withColumns({out: translated(norm, F.col(f"`{raw[out]}`")) for out, (_, norm) in norms.items()})
    rest = wide.filter(~known).withColumns({out: by_python(norm, F.col(f"`{raw[out]}`")) for out, (_, norm) in norms.items()})
    return native.union(rest).drop(*raw.values())


def with_natural_key(rows: DataFrame, out: str, title: Column, venue: Column, start: Column) -> DataFrame:
    """The natural key of listings, as text.natural_key has it."""
    told = with_norms(rows, {"_title_norm": (title, IDENTITY), "_venue_norm": (venue, IDENTITY)})
    return told.withColumn(out, F.array("_title_norm", F.coalesce("_venue_norm", F.lit("")), F.coalesce(start.cast("string"), F.lit("")))).drop("_title_norm", "_venue_norm")
