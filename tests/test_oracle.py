"""Every registered query of the listing operators equals its SQL in DuckDB."""

import glob
import os
import re

import duckdb
import pytest

from marquee.plans import details, upkeep  # noqa: F401
from marquee.plans import queries as plans

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def plain(rows):
    def cell(x):
        return None if x is None else round(float(x), 6) if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)

    return sorted((tuple(map(cell, r)) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(plans.ORACLE))
def test_query_equals_its_sql(spark, duck, name):
    got = plans.QUERIES[name](spark, SF)
    want = duck.sql(plans.ORACLE[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert plain(got.select(*columns).collect()) == plain(want.select(*[duckdb.ColumnExpression(c) for c in columns]).fetchall())


def test_entry_module(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", ["sort_default", "sort_announced", "sort_nearest"])
def test_every_row_has_a_place(spark, duck, name):
    assert plans.QUERIES[name](spark, SF).count() == duck.sql("SELECT count(*) FROM orders").fetchall()[0][0]


def test_new_names_are_given_greedily(spark):
    """The assignment and what it leaves open, against plain loops over the candidates."""
    used: set[tuple[int, str]] = set()
    want = []
    for r in sorted(plans.renamed(spark, SF).select("score", "prev_uid", "uid").collect(), reverse=True):
        if not {(0, r.prev_uid), (1, r.uid)} & used:
            used |= {(0, r.prev_uid), (1, r.uid)}
            want.append((r.prev_uid, r.uid))
    got = [(r.prev_uid, r.uid) for r in plans.QUERIES["rename_assignment"](spark, SF).collect()]
    assert sorted(got) == sorted(want) and want
    left = {r.uid for r in plans.QUERIES["diff_open"](spark, SF).collect()} - {a for a, _ in want}
    assert {r.uid for r in plans.QUERIES["diff_open_renamed"](spark, SF).collect()} == left


def test_highlighted_texts_equal_plain_marks(spark):
    for r in plans.QUERIES["highlight"](spark, SF).join(plans.read(spark, SF, "documents"), "doc_id").collect():
        low = r.text.lower()
        hit = [False] * len(low)
        for term in ("the", "que"):
            for m in re.finditer(term, low):
                hit[m.start() : m.end()] = [True] * len(term)
        marked = "".join("<mark>" * (h and not (i and hit[i - 1])) + c + "</mark>" * (h and not hit[i + 1 : i + 2] == [True]) for i, (c, h) in enumerate(zip(r.text, hit, strict=True)))
        assert r.marked == marked
