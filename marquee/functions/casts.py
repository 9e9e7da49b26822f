"""Casts of text cells. None of them fails: what can't be read is null (false for a flag, empty for a list)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def txt(c: Column) -> Column:
    return F.nullif(F.trim(c.cast("string")), F.lit(""))


def real(c: Column) -> Column:
    """The numeric prefix."""
    return F.regexp_extract(F.coalesce(c.cast("string"), F.lit("")), r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)", 1).try_cast("double")


def integer(c: Column) -> Column:
    """The integer prefix: '1,200' is 1."""
    return F.regexp_extract(F.coalesce(c.cast("string"), F.lit("")), r"^\s*([+-]?\d+)", 1).try_cast("bigint")


def text_list(c: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(c.cast("string"), F.lit("")), "[|]"), lambda x: F.trim(x)), lambda x: x != "")


def flag(c: Column) -> Column:
    return F.lower(F.trim(F.coalesce(c.cast("string"), F.lit("")))).isin("1", "true", "yes")


def day(c: Column) -> Column:
    """A date written YYYY-MM-DD; other spellings and days that don't exist are null."""
    cell = F.trim(c.cast("string"))
    return F.when(cell.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(cell, "yyyy-MM-dd"))


def day_list(c: Column) -> Column:
    return F.filter(F.transform(text_list(c), lambda x: day(x)), lambda d: d.isNotNull())


CASTS = {"txt": txt, "num": real, "int": integer, "list": text_list, "bool": flag, "date": day, "dates": day_list}
