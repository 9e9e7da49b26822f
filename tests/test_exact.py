import random

import pytest
from pyspark.sql import functions as F

from marquee.functions import exact, text

PLANE = [chr(c) for c in range(1, 0x10000) if not 0xD800 <= c < 0xE000]


@pytest.mark.parametrize("norm", [exact.SEARCH, exact.IDENTITY, exact.ROSTER, exact.PLAIN], ids=lambda n: n.name)
def test_equals_the_whole_form_over_the_plane(spark, norm):
    """Every character alone and between letters, pairs of neighbours, and random texts."""
    rng = random.Random(4)
    texts = [*PLANE, *(f"a{c}か{c}" for c in PLANE), *("".join(rng.choices(PLANE, k=rng.randint(2, 12))) for _ in range(5000)), *(a + b for a in "aか각ｶΣ" for b in PLANE[::7]), "", "ﾎﾟｽﾀｰ", "𝐢𝐠", "é", "ὈΔΥΣΣΕΎΣ", "İI", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "i long, t string").repartition(8)
    known = rows.filter(exact.covered(norm, F.col("t"))).select("i", exact.translated(norm, F.col("t")).alias("n")).collect()
    assert {r.i for r in known if r.n != (None if texts[r.i] is None else norm.whole(texts[r.i]))} == set()
    assert len(known) > 0.7 * len(PLANE)
    some = rows.filter("i % 11 = 0")
    got = {r.i: r.n for r in exact.with_norms(some, {"n": (F.col("t"), norm)}).collect()}
    assert got == {i: None if t is None else norm.whole(t) for i, t in enumerate(texts) if i % 11 == 0}


def test_natural_keys_are_as_before(spark):
    rows = spark.createDataFrame([(1, "Ａ・B", ["㈱x"], "2026-01-01"), (2, None, [], None), (3, "Straße", ["ﾎﾟ"], None)], "i long, title string, venues array<string>, start string")
    old = rows.select("i", text.natural_key(F.col("title"), F.col("venues"), F.col("start")).alias("k"))
    new = exact.with_natural_key(rows, "k", F.col("title"), F.get("venues", F.lit(0)), F.col("start"))
    assert {r.i: r.k for r in new.collect()} == {r.i: r.k for r in old.collect()} and new.columns == [*rows.columns, "k"]


@pytest.mark.parametrize("name", ["search_and_terms", "facet_filter", "diff_gone"])
def test_no_python_for_stored_norms(spark, name):
    from marquee.plans.queries import QUERIES

    assert "Python" not in QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()


def test_python_gets_odd_rows_only(spark):
    rows = spark.createDataFrame([(i, "plain") for i in range(1000)] + [(1000, "㈱")], "i long, t string")
    seen = spark.sparkContext.accumulator(0)

    def count(s: str) -> str:
        seen.add(1)
        return exact.plain_text(s)

    norm = exact.Norm("counted", count, exact.plain_text)
    assert exact.with_norms(rows, {"n": (F.col("t"), norm)}).filter("n = '(株)'").count() == 1
    assert seen.value == 1
