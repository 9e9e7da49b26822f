import random
from datetime import date

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from marquee.operators import percolate
from marquee.plans import links
from marquee.plans.spec import FilterSpec
from tests.test_percolate import some_searches

WORDS = st.text("aé &=+,%/ｚ横", min_size=1, max_size=6).filter(lambda s: s.strip() == s)
LABELS = st.sets(WORDS.filter(lambda s: "," not in s), max_size=3).map(lambda x: tuple(sorted(x)))


@given(st.sampled_from(sorted(links.TAB_FACETS)), WORDS, LABELS, st.sets(st.sampled_from(["newOnly", "limitedOnly", "onsaleOnly"])), st.dates(), st.sampled_from([{"venue": "武道館"}, {"area": (35.5, 139.25, 10.0)}, {"pref": "東京都"}, {}]), st.sampled_from(["date", "announced"]))
def test_links_round_trip(tab, q, labels, flags, day, place, sort):
    spec = FilterSpec(q, {links.TAB_FACETS[tab][0]: labels} if labels else {}, frozenset(flags), day, day, sort=sort, **place)
    assert links.from_link(links.to_link(tab, spec)) == (tab, spec) == links.from_link("?" + links.to_link(tab, spec))


@pytest.mark.parametrize(("query", "want"), [("", None), ("?", None), ("x", ("event", FilterSpec())), ("tab=odd&from=2026-02-30&to=2026-03-01&map=1,2", ("event", FilterSpec())), ("from=2026-03-02&to=2026-03-01&f=before, onsaleOnly,zz&cats=a,,a", ("event", FilterSpec(facets={"cats": ("a",)}, flags=frozenset({"onsaleOnly"}), start=date(2026, 3, 1), end=date(2026, 3, 2)))), ("map=35,139,1&venue=v&pref=p&tab=live&f=deals&screen=3d", ("live", FilterSpec(area=(35.0, 139.0, 1.0))))])
def test_odd_links(query, want):
    assert links.from_link(query) == want


def test_columns_read_links_alike(spark):
    searches = [(i, q) for i, q in some_searches(random.Random(11), 120) if "%zz" not in q]
    tabs = tuple(links.TAB_FACETS)
    axes = {p: (F.lit(None), tuple(t for t in tabs if f in links.TAB_FACETS[t])) for f, p in links.FACET_PARAM.items()}
    flags = {p: (f, F.lit(True), tuple(t for t in tabs if f in links.TAB_FLAGS[t])) for f, p in links.FLAG_PARAM.items()}
    got = {r.query: r for r in percolate.decode(spark.createDataFrame(searches, "search_id long, query string"), tabs, axes, flags).join(spark.createDataFrame(searches, "search_id long, query string"), "search_id").collect()}
    for q in {q for i, q in searches if i is not None}:
        told = links.from_link(q)
        if told is None:
            assert q not in got
            continue
        tab, spec = told
        r = got[q]
        area = None if r.km is None else (r.lat, r.lng, r.km)
        assert (r.tab, r["first"], r["last"], r.venue, area, r.pref) == (tab, spec.start, spec.end, spec.venue, spec.area, spec.pref), q
        assert set(r.flags) == set(spec.flags) and {f.axis: set(f["values"]) for f in r.facets} == {links.FACET_PARAM[f]: set(v) for f, v in spec.facets.items()} and r.newest == (spec.sort == "announced")
