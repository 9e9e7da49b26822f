import math
import random
from datetime import date, timedelta
from urllib.parse import parse_qsl, urlencode

import pytest
from pyspark.sql import functions as F

from marquee.functions import text
from marquee.operators import percolate
from marquee.sources.adapter import listing
from marquee.sources.scratch import saver

TABS = ("event", "movie", "live")
OWN = {"new": ("newOnly", "fresh", TABS), "onsale": ("onsaleOnly", "open", TABS), "before": ("beforeOnly", "soon", TABS), "deals": ("dealsOnly", "fresh", ("event", "movie"))}
LONG = {s: v[0] for s, v in OWN.items()}


def declared():
    return {"cats": (F.col("cats"), ("event",)), "genre": (F.col("cats"), ("movie", "live"))}, {s: (long, F.col(c), tabs) for s, (long, c, tabs) in OWN.items()}


SCHEMA = "row_no long, tab string, title string, venues array<string>, pref string, lat double, lng double, start_date date, end_date date, dates array<date>, backup_date array<date>, cats array<string>, fresh boolean, open boolean, soon boolean"


def km(a, b, c, d):
    h = math.sin(math.radians(c - a) / 2) ** 2 + math.cos(math.radians(a)) * math.cos(math.radians(c)) * math.sin(math.radians(d - b) / 2) ** 2
    return 2 * 6371.0 * math.atan2(math.sqrt(h), math.sqrt(1 - h))


def plain(rows, searches):
    """Each search against each row, its query string read by the standard library."""

    def day(x):
        try:
            return date.fromisoformat(x) if len(x) == 10 else None
        except (ValueError, TypeError):
            return None

    out = []
    for sid, query in searches:
        pairs = parse_qsl(query.lstrip("?"), keep_blank_values=True)
        p = dict(reversed([x for x in pairs if x[1]]))
        if not pairs:
            continue
        tab = p.get("tab") if p.get("tab") in TABS else "event"
        a, b = day(p.get("from")), day(p.get("to"))
        a, b = (min(a, b), max(a, b)) if a and b else (None, None)
        try:
            circle = [float(x) for x in p["map"].split(",")][:3]
            circle = circle if len(circle) == 3 and all(map(math.isfinite, circle)) and circle[2] > 0 else None
        except (KeyError, ValueError):
            circle = None
        flags = {LONG.get(x.strip(), x.strip()) for x in p.get("f", "").split(",")}
        if "onsaleOnly" in flags:
            flags.discard("beforeOnly")
        for r in rows:
            if r["tab"] != tab or not all(t in (text.fold_text(r["title"] or "")) for t in text.fold_text(p.get("q", "")).split()):
                continue
            if a and not (any(a <= d <= b for d in r["backup_date"]) or (any(a <= d <= b for d in r["dates"]) if r["dates"] else (r["end_date"] or b) >= a and (r["start_date"] or a) <= b)):
                continue
            want = [x.strip() for x in p.get("cats" if tab == "event" else "genre", "").split(",") if x.strip()]
            if want and not set(want) & set(r["cats"]):
                continue
            if any(r[c] is not True for long, c, tabs in OWN.values() if long in flags and tab in tabs):
                continue
            if circle:
                if r["lat"] is None or km(circle[0], circle[1], r["lat"], r["lng"]) > circle[2]:
                    continue
            elif p.get("venue"):
                if p["venue"] not in r["venues"]:
                    continue
            elif p.get("pref") and r["pref"] != p["pref"]:
                continue
            out.append((sid, r["row_no"]))
    return sorted(out, key=str)


def some_rows(rng, n):
    names = ["東京 Ｚｅｐｐ ナイト", "tokyo ぜっぷ live", "ﾌｪｽﾃｨﾊﾞﾙ 横浜", "Café Été", "㈱ロック", "a", "ロック フェス", None, "x" * 300 + "zepp"]
    days = lambda: sorted(date(2026, 1, 1) + timedelta(rng.randrange(400)) for _ in range(rng.choice([0, 0, 1, 3])))
    out = []
    for i in range(n):
        start = rng.choice([None, date(2026, 1, 1) + timedelta(rng.randrange(400))])
        end = rng.choice([None, (start or date(2026, 3, 1)) + timedelta(rng.randrange(-3, 90))])
        spot = rng.choice([None, (35 + rng.random(), 139 + rng.random())])
        out.append({"row_no": i, "tab": rng.choice(TABS), "title": rng.choice(names), "venues": rng.sample(["Zepp", "武道館", "a|b", "O'x"], rng.randrange(3)), "pref": rng.choice([None, "東京都", "神奈川県"]), "lat": spot and spot[0], "lng": spot and spot[1], "start_date": start, "end_date": end, "dates": days(), "backup_date": days()[:1], "cats": rng.sample(["art", "food", "kids"], rng.randrange(3)), **{f: rng.choice([True, False, None]) for f in ("fresh", "open", "soon")}})
    out += [dict(out[0], row_no=-1, start_date=date(1700, 1, 1), end_date=None, dates=[], backup_date=[]), dict(out[0], row_no=-2, start_date=None, end_date=date(2300, 1, 1), dates=[], backup_date=[])]
    return out


def some_searches(rng, n):
    out = []
    for i in range(n):
        p = []
        for k, values in {
            "tab": ["event", "movie", "live", "none"], "q": ["zepp", "ゼップ", "tokyo ぜっぷ", "ろっく　ふぇす", "a", "cafe", "É", "㈱", "フェスティバル", "横"], "pref": ["東京都", "神奈川県"], "venue": ["Zepp", "a|b", "O'x", "none"],
            "map": ["35.5,139.5,20", "35.5,139.5,0", "x,1,2", "35.2,139.9,4000", "35.5,139.5,0.5,9", "89.9,0,30"], "cats": ["art", "art,food", " , "], "genre": ["kids, art", "food"], "f": ["new", "onsale,before", "beforeOnly", "deals", "bogus"], "sort": ["new"],
        }.items():
            if rng.random() < 0.22 + 0.5 * (k == "tab"):
                p.append((k, rng.choice(values)))
        if rng.random() < 0.35:
            a = date(2026, 1, 1) + timedelta(rng.randrange(400))
            p += [("from", str(a)), ("to", str(a + timedelta(rng.randrange(-5, 60))))]
        if rng.random() < 0.1:
            p += [("from", "2026-02-30"), ("to", "2026-3-1")]
        rng.shuffle(p)
        out.append((i, rng.choice(["?", ""]) + urlencode(p)))
    return out + [(None, "tab=event&q=zepp"), (-1, ""), (-2, "?"), (-3, "q=%zz"), (-4, "q=zepp&q=none"), (-5, "tab=live"), (-6, "tab=live")]


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_each_search_against_each_row(spark, seed):
    rng = random.Random(seed)
    rows, searches = some_rows(rng, 150), some_searches(rng, 160)
    frame = spark.createDataFrame([tuple(r[c.split()[0]] for c in SCHEMA.replace(", ", ",").split(",")) for r in rows], SCHEMA).withColumn("folded", text.fold(F.coalesce("title", F.lit(""))))
    got = percolate.matches(frame, spark.createDataFrame(searches, "search_id long, query string"), TABS, *declared(), saver(spark))
    got = sorted(((r.search_id, r.row_no) for r in got.collect()), key=str)
    assert got == plain(rows, searches)
    assert len(got) > 200


def test_blocks_of_days(spark):
    rng = random.Random(3)
    cases = [(a, a + rng.randrange(0, 900)) for a in [0, 1, 7, 65535, *(rng.randrange(60000) for _ in range(60))]]
    cases = [(a, min(b, 65535)) for a, b in cases] + [(0, 65535)]
    probes = [0, 5, 31, 40000, 65535, *(x for a, b in cases for x in (a, b, (a + b) // 2, max(0, a - 1), min(65535, b + 1)))]
    got = spark.createDataFrame(cases, "a int, b int").select("a", "b", percolate.blocks_of(F.col("a"), F.col("b")).alias("blocks")).collect()
    own = {r.d: set(r.blocks) for r in spark.createDataFrame([(d,) for d in set(probes)], "d int").select("d", percolate.blocks_with(F.col("d")).alias("blocks")).collect()}
    for r in got:
        assert len(r.blocks) == len(set(r.blocks)) <= 2 * 17
        for d in own:
            assert len(own[d] & set(r.blocks)) == (r.a <= d <= r.b)


def test_no_search_and_no_row(spark):
    none = spark.createDataFrame([], SCHEMA).withColumn("folded", F.lit(""))
    one = spark.createDataFrame([(1, "q=a"), (2, "tab=live")], "search_id long, query string")
    assert percolate.matches(none, one, TABS, *declared(), saver(spark)).count() == 0
    assert percolate.matches(none, one.limit(0), TABS, *declared(), saver(spark)).count() == 0


def test_no_pair_of_row_and_search_is_shuffled(spark):
    frame = listing(spark, "/root/testdata/sf0.001").withColumn("folded", F.lower("title"))
    asked = spark.createDataFrame([(1, "q=hot"), (2, "venue=Supplier%23000000001")], "search_id long, query string")
    plan = percolate.matches(frame, asked, TABS, {}, {}, saver(spark))._jdf.queryExecution().executedPlan().toString()
    assert plan.index("explode(searches") < min(plan.index("Exchange"), plan.index("Join"))


def test_small_blocks_and_no_table_of_rows(spark, monkeypatch):
    """Several blocks a key, keys alone and together, grams told by pieces: the same pairs; what is written between steps holds no rows."""
    for name, n in {"ROWS": 7, "BLOCK": 3, "FEW": 2, "SOUGHT": 2, "CHECKED": 20}.items():
        monkeypatch.setattr(percolate, name, n)
    rng = random.Random(7)
    rows, searches = some_rows(rng, 60), some_searches(rng, 50)
    rows[0]["venues"], rows[1]["venues"] = ["a\x1fb", "\x1e1"], ["a", "b", ""]
    searches += [(900 + i, urlencode([("tab", t), ("venue", v)])) for i, (t, v) in enumerate((t, v) for t in TABS for v in ("a\x1fb", "\x1e1", "b"))]
    frame = spark.createDataFrame([tuple(r[c.split()[0]] for c in SCHEMA.replace(", ", ",").split(",")) for r in rows], SCHEMA).withColumn("folded", text.fold(F.coalesce("title", F.lit(""))))
    saved = []

    def save(df):
        saved.append(set(df.columns))
        return df.localCheckpoint()

    got = percolate.matches(frame, spark.createDataFrame(searches, "search_id long, query string"), TABS, *declared(), save)
    assert sorted(((r.search_id, r.row_no) for r in got.collect()), key=str) == plain(rows, searches)
    assert not any({"row_no", "folded"} & columns for columns in saved)
