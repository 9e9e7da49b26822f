"""Operators on small tables: searches, reconciliation, rosters, rules, files and streams."""

import json
import random
import re
from datetime import date, datetime

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marquee.functions import geo
from marquee.operators import quality, reconcile, roster, search
from marquee.plans.spec import Facet, FilterSpec, Search, default_flags
from marquee.sources import readers, snapshots
from marquee.sources.adapter import NOW, TODAY, listing
from marquee.streaming import jobs

SF = "/root/testdata/sf0.001"
D = date.fromisoformat


def test_facet_counts_equal_brute_force(spark):
    rows = listing(spark, SF).withColumn("folded", F.lower("title"))
    facets = [Facet("cats", F.col("cats"), ("NONE", "PROMO")), Facet("tab", F.array("tab"))]
    spec = FilterSpec(query="a", facets={"cats": ("PROMO",), "tab": ("live",)}, flags=frozenset({"limitedOnly"}))
    got = {(r.axis, r.value): r.n for r in search.facet_counts(rows, Search(spec, facets, default_flags(TODAY, NOW))).collect()}
    want = {("cats", "NONE"): 0, ("cats", "PROMO"): 0}
    for r in rows.collect():
        if "a" in r.folded and r.limited_sale is not None:
            for value in r.cats if r.tab == "live" else []:
                want["cats", value] = want.get(("cats", value), 0) + 1
            if "PROMO" in r.cats:
                want["tab", r.tab] = want.get(("tab", r.tab), 0) + 1
    assert got == want


def test_specs_are_made_sound():
    flags = default_flags(TODAY, NOW)
    spec = FilterSpec(flags=frozenset({"onsaleOnly", "beforeOnly", "nothing"}), start=D("2026-02-01"), end=D("2026-01-01"), area=(99.0, 0.0, 1.0)).sound(flags)
    assert spec.flags == {"onsaleOnly"} and (spec.start, spec.end) == (D("2026-01-01"), D("2026-02-01")) and spec.area is None
    assert not FilterSpec(start=D("2026-01-01")).active() and FilterSpec(query="x").active()


WORDS = st.text("aé &=,%/ｚ横", min_size=1, max_size=6).filter(lambda s: s.strip() == s and "," not in s)


@given(WORDS, st.sets(WORDS, max_size=3), st.sets(st.sampled_from(["newOnly", "limitedOnly"])), st.dates() | st.none(), WORDS | st.none(), st.sampled_from(["date", "announced"]))
def test_saved_searches_round_trip(q, cats, flags, day, venue, sort):
    spec = FilterSpec(q, {"cats": tuple(sorted(cats))} if cats else {}, frozenset(flags), day, day, venue, (35.5, 139.25, 10.0), "tokyo", sort)
    assert FilterSpec.decode(spec.encode()) == spec and FilterSpec.decode("?" + spec.encode()).encode() == spec.encode()
    assert FilterSpec.decode("from=2026-2-1&area=x&to=2026-02-30").active() is False


def test_orders(spark):
    rows = listing(spark, SF)
    got = [r.row_no for r in search.numbered(rows, search.order_of(FilterSpec(sort="location", here=(35.0, 139.0)), TODAY), 50).orderBy("place").collect()]
    by_km = rows.select("row_no", geo.haversine(F.lit(35.0), F.lit(139.0), F.col("lat"), F.col("lng")).alias("km")).collect()
    assert got == [r.row_no for r in sorted(by_km, key=lambda r: (r.km is None, r.km or 0, r.row_no))][:50]


def test_every_row_has_a_place(spark):
    rows = spark.createDataFrame([(i, i * 37 % 11 if i % 5 else None) for i in range(1000)], "row_no long, v long").repartition(7)
    got = search.placed(rows, [F.desc_nulls_last("v"), F.col("row_no").asc()], lambda df: df.localCheckpoint()).collect()
    want = sorted(((r.row_no, r.v) for r in got), key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))
    assert [(r.row_no, r.v) for r in sorted(got, key=lambda r: r.place)] == want and sorted(r.place for r in got) == list(range(1, 1001))
    assert search.placed(rows.limit(0), [F.col("row_no").asc()], lambda df: df.localCheckpoint()).count() == 0


def greedy(pairs):
    out, used_a, used_b = [], set(), set()
    for s, a, b in sorted(((p[2], p[0], p[1]) for p in pairs), reverse=True):
        if a not in used_a and b not in used_b:
            used_a.add(a)
            used_b.add(b)
            out.append((a, b, s))
    return sorted(out)


@pytest.mark.parametrize("seed", [1, 2])
def test_assignment_equals_greedy_choice(spark, tmp_path, seed):
    import random

    rng = random.Random(seed)
    pairs = sorted({(f"g{rng.randrange(12)}", f"a{rng.randrange(12)}"): rng.choice([0.5, 0.8, 0.9]) for _ in range(60)}.items())
    rows = [(a, b, s) for (a, b), s in pairs]
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    got = reconcile.assign(spark.createDataFrame(rows, "prev_uid string, uid string, score double"), lambda df: df.checkpoint())
    assert sorted(map(tuple, got.select("prev_uid", "uid", "score").collect())) == greedy(rows)


def test_similar_titles_lose_no_pair(spark):
    import random
    from collections import Counter

    rng = random.Random(7)
    titles = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(1, 14))) for _ in range(60)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(titles)], "k long, title string")
    got = {(r.a, r.b): r.score for r in reconcile.title_pairs(df.select(F.col("k").alias("a"), "title"), df.select(F.col("k").alias("b"), "title"), 0.7).collect()}
    score = lambda x, y: sum((Counter(x) & Counter(y)).values()) / min(len(x), len(y))
    want = {(i, j): score(x, y) for i, x in enumerate(titles) for j, y in enumerate(titles) if score(x, y) >= 0.7}
    assert got == pytest.approx(want)


def test_changes_and_dispositions(spark):
    prev = spark.createDataFrame([("a", 1, "x ", "d1", "p"), ("b", 2, "y", "d2", None)], "uid string, row_no long, price string, desc string, only_prev string")
    cur = spark.createDataFrame([("a", 1, "x", "d9", 1), ("b", 2, None, "d2", 2)], "uid string, row_no long, price string, desc string, only_cur int")
    got = reconcile.changed(prev, cur, ["price", "only_prev"], ["desc"]).collect()
    assert sorted(map(tuple, got), key=str) == [("a", "desc", None, None), ("b", "price", "y", None)]
    log = spark.createDataFrame([("a", "ended", None, 1), ("a", "renamed", "n", 2), ("z", "ended", None, 3), ("b", "why", None, 4), ("b", "renamed", None, 5)], "uid string, code string, to string, seq long")
    assert {(r.uid, r.code) for r in reconcile.latest_dispositions(log).filter("uid = 'a'").collect()} == {("a", "renamed")}
    rejects = reconcile.disposition_rejects(log, prev.select("uid"), ["ended", "renamed"])
    assert {(r.seq, r.reason) for r in rejects.collect()} == {(3, "unknown uid"), (4, "unknown code"), (5, "renamed to nothing")}


def test_rosters(spark):
    schema = "name string, status string, first_seen date, last_hit date, hit_count long, closed_until date, note string"
    base = spark.createDataFrame([("Zepp A", "candidate", D("2026-01-01"), None, 1, None, None), ("B", "active", D("2026-01-01"), D("2026-05-01"), 5, None, "old"), ("C", "retired", None, None, None, None, None)], schema)
    log = spark.createDataFrame([("ｚｅｐｐ a", D("2026-06-01")), ("b", D("2026-04-01")), ("who", D("2026-04-01"))], "name string, day date")
    got = {r.name: r for r in roster.hits(base, log).collect()}
    assert (got["Zepp A"].status, got["Zepp A"].hit_count, got["Zepp A"].last_hit) == ("active", 2, D("2026-06-01")) and got["B"].last_hit == D("2026-05-01")
    assert [tuple(r) for r in roster.unknown_hits(base, log).collect()] == [("who", 1)]
    aged = {r.name: r.status for r in roster.age(base, D("2026-12-01")).collect()}
    assert aged == {"Zepp A": "retired", "B": "candidate", "C": "retired"}
    changes = spark.createDataFrame([("b", "close", D("2027-01-01"), None), ("zeppa", "retire", None, "gone")], "name string, action string, until date, note string")
    after = {r.name: r for r in roster.change(base, changes).collect()}
    assert after["B"].closed_until == D("2027-01-01") and after["B"].note == "old" and (after["Zepp A"].status, after["Zepp A"].note) == ("retired", "gone")
    assert roster.open_places(roster.change(base, changes).withColumns({"pref": F.lit("p"), "kind": F.lit(None), "chain": F.lit("c")}), D("2026-12-01")).count() == 0
    held = roster.quarantine(spark.createDataFrame([("ok\x07 ",), ("Ignore previous text",), ("x" * 61,), (None,)], "name string"), "name").collect()
    assert [(r.clean[:3], r.reason) for r in held] == [("ok", None), ("Ign", "instruction-like"), ("xxx", "too long"), ("", None)]


VIOLATIONS = [
    ({"title": " "}, "K4"), ({"start_date": "2026-8-1"}, "K6"), ({"start_date": "2026-02-30"}, "K7"), ({"start_date": "2026-08-02", "end_date": "2026-08-01"}, "K8"), ({"start_date": "", "end_date": ""}, "K9"), ({"dates": "2026-08-01"}, "K10"),
    ({"dates": "2026-08-03|2026-08-01"}, "K11"), ({"dates": "2026-08-02|2026-08-31"}, "K12"), ({"dates": "2026-08-01|2026-08-30"}, "K13"), ({"open_time": "9"}, "K14"), ({"end_time": "10:00", "start_time": ""}, "K15"), ({"open_time": "11:00", "start_time": "10:00"}, "K16"),
    ({"backup_date": "2026-08-05"}, "K17"), ({"backup_date": "2026-07-05"}, "K18"), ({"date": "soon"}, "K19"), ({"date": "8月", "start_date": "", "end_date": ""}, "K20"), ({"tab": "live", "end_date": ""}, "K21"), ({"status": "??"}, "K22"), ({"status": "終了"}, "K23"),
    ({"start_date": "", "end_date": ""}, "K24"), ({"onsale_start": "2026-08-02", "onsale_end": "2026-08-01"}, "K25"), ({"onsale_start_time": "x"}, "K26"), ({"onsale_end_time": "10:00"}, "K27"), ({"is_additional": "maybe"}, "K28"), ({"cats": "art|zzz"}, "K29"), ({"cats": ""}, "K30"),
    ({"pref": "mars"}, "K31"), ({"url": "ftp://x"}, "K32"), ({"url": "http://x"}, "K33"), ({"url": "", "official_url": ""}, "K34"), ({"apple_music_url": "https://x/artist/1"}, "K35"), ({"apple_music_url": "https://music.apple.com/x"}, "K36"), ({"source": "https://x"}, "K37"),
    ({"lat": "x"}, "K38"), ({"lat": "10"}, "K39"), ({"lat": ""}, "K40"), ({"price_best": "5"}, "K41"), ({"price_best": "5", "price_official": "9"}, "K42"), ({"price_best": "10", "price_official": "9"}, "K43"),
    ({"price_best": "50", "price_official": "100", "discount_pct": "40"}, "K44"), ({"price_official": "0"}, "K45"), ({"discount_pct": "40"}, "K46"), ({"price_official": "9"}, "K47"),
]
GOOD = dict(
    title="t", tab="event", start_date="2026-08-01", end_date="2026-08-31", announced_date="", dates="", backup_date="", date="", open_time="", start_time="", end_time="", status="", onsale_start="", onsale_end="", onsale_start_time="", onsale_end_time="",
    is_additional="", cats="art", pref="tokyo", url="https://x", official_url="", apple_music_url="", source="desk", lat="35.5", lng="139.5", price_official="", price_best="", best_source="", discount_pct="", price_condition="", price_checked="",
)


def test_each_rule_finds_its_row(spark):
    rows = [GOOD, *[GOOD | change for change, _ in VIOLATIONS]]
    schema = T.StructType([T.StructField("row_no", T.LongType()), *[T.StructField(c, T.StringType()) for c in GOOD]])
    df = spark.createDataFrame([(i, *r.values()) for i, r in enumerate(rows)], schema)
    rules = quality.raw_rules(df.columns, ["終了"], ["tokyo"], {"cats": ["art", "food"]})
    found: dict[int, set] = {}
    for r in quality.violations(df, rules, "x").collect():
        found.setdefault(r.row_no, set()).add(r.rule)
    assert 0 not in found
    for i, (_, rule) in enumerate(VIOLATIONS, 1):
        assert rule in found[i], (rule, found[i])
    assert {r.id for r in rules} <= {rule for _, rule in VIOLATIONS} | {"K6", "K7"}


def test_grouped_rules_and_gate(spark):
    df = spark.createDataFrame([(1, "a", "s"), (2, "b", "s"), (3, "a", "u"), (4, "a", "u")], "row_no long, id string, series string")
    assert {(r.row_no, r.value) for r in quality.repeated(df, "id", "K5", "W", "x").collect()} == {(3, "1"), (4, "3")}
    assert {(r.row_no, r.value) for r in quality.repeated(df, "id", "K50", "E", "x", first=True).collect()} == {(3, "1"), (4, "1")}
    assert quality.single_rows(df, "series", "x").count() == 0
    assert quality.header_violations(["a", "b"], ["b", "c"]) == [("missing", "c"), ("extra", "a")]
    warned = spark.createDataFrame([("W",)], "severity string")
    assert quality.gate(warned).first().publish and not quality.gate(warned, strict=True).first().publish
    places = spark.createDataFrame([(1, "a", "active", "2026-01-01", "", "", "1"), (2, " ", "odd", "x", "2026-02-30", "", "-1")], "row_no long, name string, status string, first_seen string, last_hit string, closed_until string, hit_count string")
    assert {(r.row_no, r.rule) for r in quality.violations(places, quality.roster_rules(places.columns), "r").collect()} == {(2, r) for r in ("K49", "K55", "K56", "K57")}


def test_csv_edges(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_bytes('﻿id,title ,note\r\n1,"a ""q"" b","two\nlines"\r\n\r\n2,short\r\n3,x,y,extra\r\n4,last,"z"'.encode())
    rows = readers.read_csv(spark, str(path), ["id", "title", "note", "absent"]).orderBy("id").collect()
    assert [tuple(r) for r in rows] == [("1", 'a "q" b', "two\nlines", None), ("2", "short", None, None), ("3", "x", "y", None), ("4", "last", "z", None)]
    typed = readers.typed(readers.read_csv(spark, str(path)), {"id": ("id", "int"), "t": ("title", "txt"), "none": ("zzz", "list")}).orderBy("id").first()
    assert tuple(typed) == (1, 'a "q" b', [])
    readers.write_listing(readers.read_csv(spark, str(path)), str(tmp_path / "out"), ["note", "id"])
    assert readers.read_csv(spark, str(tmp_path / "out")).filter("id = '1'").first().note == "two\nlines"


def test_json_sources(spark, tmp_path):
    (tmp_path / "s.json").write_text(json.dumps({"_comment": "x", "events": [{"name": "a", "url": "u", "role": "r"}], "lives": [{"name": "b", "url": "v"}]}))
    assert sorted(map(tuple, readers.read_directory(spark, str(tmp_path / "s.json")).collect())) == [("events", "a", "u", "r"), ("lives", "b", "v", None)]
    (tmp_path / "l.jsonl").write_text('{"id": 1}\n{bad\n')
    schema = T.StructType([T.StructField("id", T.LongType())])
    loose = readers.read_jsonl(spark, str(tmp_path / "l.jsonl"), schema, strict=False).collect()
    assert sorted((r.id, r._corrupt_record) for r in loose if r.id) == [(1, None)] and any(r._corrupt_record == "{bad" for r in loose)
    with pytest.raises(Exception):
        readers.read_jsonl(spark, str(tmp_path / "l.jsonl"), schema).collect()
    files = spark.createDataFrame([("a", datetime(2026, 8, 1, 20)), ("b", datetime(2026, 8, 1, 20)), ("c", datetime(2026, 8, 1))], "dataset string, modified timestamp")
    manifest = spark.createDataFrame([("b", "2026-07-01"), ("c", "2026-07-01T20:00:00Z")], "dataset string, value string")
    assert {r.dataset: str(r.updated) for r in readers.freshness(files, manifest).collect()} == {"a": "2026-08-02", "b": "2026-07-01", "c": "2026-07-02"}


def test_snapshots(spark, tmp_path):
    path = str(tmp_path)
    assert snapshots.before(spark, path, D("2026-08-01")) is None
    for day, n in (("2026-08-01", 3), ("2026-08-08", 5)):
        snapshots.take(spark.range(n), path, D(day))
    assert snapshots.before(spark, path, D("2026-08-08")).count() == 3 and snapshots.before(spark, path, D("2026-09-01")).count() == 5
    assert snapshots.before(spark, path, D("2026-08-01")) is None
    assert spark.read.parquet(snapshots.next_version(spark.range(2), path + "/t", 1)).count() == 2


def test_streams(spark, tmp_path):
    src, out = tmp_path / "in", str(tmp_path / "out")
    src.mkdir()
    schema = T.StructType([T.StructField(c, T.StringType()) for c in ("uid", "place", "title", "kana", "request", "carry_from")])
    (src / "1.json").write_text("\n".join(json.dumps(r) for r in [{"uid": "a", "place": "p", "request": "title|id"}, {"uid": "n", "place": "p", "carry_from": "b", "request": "*"}]))
    prev = spark.createDataFrame([("a", "old a", "ka"), ("b", "old b", "kb")], "uid string, title string, kana string")
    facts = spark.createDataFrame([("p", "kp")], "place string, kana string")
    for _ in range(2):  # the second run finds nothing new
        jobs.intake(spark, str(src), schema, prev, facts, out, str(tmp_path / "cp"), ["kana"], ["kana"], ["id"]).awaitTermination()
        rows = {r.uid: (r.title, r.kana) for r in spark.read.parquet(out + "/rows").collect()}
        assert rows == {"a": ("old a", "ka"), "n": ("old b", "kb")}
    assert [(r.uid, r["column"], r.reason) for r in spark.read.parquet(out + "/rejects").collect()] == [("a", "id", "forbidden")]
    hits = tmp_path / "hits"
    hits.mkdir()
    lines = [{"hit_id": h, "name": n, "day": d, "seen_at": "2026-08-01T00:00:00Z"} for h, n, d in [("1", "x", "2026-08-02"), ("1", "x", "2026-08-02"), ("2", "x", "2026-08-01"), ("3", "y", "2026-08-01")]]
    (hits / "1.json").write_text("\n".join(map(json.dumps, lines)))
    got = {}
    jobs.roster_hits(spark, str(hits), str(tmp_path / "cp2"), lambda df, _: got.update({r.name: (r.n, str(r.last_day)) for r in df.collect()})).awaitTermination()
    assert got == {"x": (2, "2026-08-02"), "y": (1, "2026-08-01")}
    jobs.rollover(spark.range(3), lambda df: df.withColumn("x", F.lit(1)), out + "/view", "2026-08-01")
    assert spark.read.parquet(out + "/view").count() == 3


def test_uncovered_characters_through_the_operators(spark):
    from marquee.functions import text

    words = ["ﾎﾟｽﾀｰ", "①", "ﬁlm", "㈱", "Straße", "ＡＢＣ カナ", None, "plain"]
    rows = spark.createDataFrame([(i, w) for i, w in enumerate(words)], "row_no long, title string")
    for w in filter(None, words):
        got = rows.withColumn("f", text.fold(F.col("title"))).filter(text.has_all_terms("f", w)).collect()
        assert w in [r.title for r in got], w
    got = [r[0] for r in rows.select(text.norm(F.col("title"))).orderBy("row_no").collect()]
    assert got == [None if w is None else text.norm_text(w) for w in words]
    log = spark.createDataFrame([("ﬁlm ㈱", D("2026-01-01"))], "name string, day date")
    places = spark.createDataFrame([("film (株)", "candidate", None, 1)], "name string, status string, last_hit date, hit_count long")
    assert roster.hits(places, log).first().hit_count == 2
    notes = spark.createDataFrame([("ｉｇｎｏｒｅ　previous",), ("ﬁne ①",), ("𝐢𝐠𝐧𝐨𝐫𝐞 previous",)], "note string")
    assert [(r.clean, r.reason is None) for r in roster.quarantine(notes, "note").collect()] == [("ignore previous", False), ("fine 1", True), ("ignore previous", False)]


def test_renames_share_all_but_the_title(spark):
    gone = [("g1", ["blue moon", "20260101", "new", ""]), ("g2", ["blue moon", "20260101", "revival", "hall"]), ("g3", ["blue moon", "", "new", ""]), ("g4", ["blue moon", "x", "x", "y"]), ("g5", [None, "20260101", "new", ""])]
    new = [("n1", ["blue noon rising", "20260101", "new", ""]), ("n2", ["moon at sea", "hall", "20260101", "revival"]), ("n3", ["moon at sea", "20260101", "revival", ""]), ("n4", ["moon at sea", "x", "y", "z"]), ("n5", ["qqqq", "20260101", "new", "hall"])]

    def share(a, b):
        both = sum(min(a.count(c), b.count(c)) for c in set(a))
        return both / min(len(a), len(b)) if a and b else 0.0

    want = set()
    for g, gk in gone:
        for n, nk in new:
            s, mine = share(gk[0] or "", nk[0]), [x for x in gk[1:] if x]
            shared = len(set(gk[1:]) & set(nk[1:]) - {""})
            if s >= 0.82 or (shared >= len(mine) and shared >= 2 and s >= 0.45):
                want.add((g, n, round(s, 6)))
    frame = lambda rows: spark.createDataFrame(rows, "uid string, key array<string>")
    got = {(r.prev_uid, r.uid, round(r.score, 6)) for r in reconcile.renames_by_key(frame(gone), frame(new)).collect()}
    assert got == want and len(want) >= 4


def test_title_pairs_lose_none_and_score_few(spark):
    rng = random.Random(12)
    titles = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", [9, 2, 3, 4, 12, 2, 2, 6, 7, 1, 1, 4, 2, 7, 8, 2, 1, 6, 6, 9, 3, 1, 2, 1, 2, 1], k=rng.randint(1, 40))) for _ in range(500)]
    titles += [t[::-1] for t in titles[:60]] + ["あ" * 200, "あ" * 160 + "い" * 40, "e", "ee"]
    frame = lambda name: spark.createDataFrame([(t, t) for t in sorted(set(titles))], f"{name} string, title string")

    def share(a, b):
        return sum(min(a.count(c), b.count(c)) for c in set(a)) / min(len(a), len(b))

    got = {(r.a, r.b): round(r.score, 9) for r in reconcile.title_pairs(frame("a"), frame("b"), 0.82).collect()}
    own = sorted(set(titles))
    assert got == {(a, b): round(s, 9) for a in own for b in own if (s := share(a, b)) >= 0.82}


def test_renames_are_assigned_and_paired_by_title(spark, monkeypatch):
    """Equal and tied titles, many rows of each: what plain loops over all pairs give, and no pair in a shuffle."""
    monkeypatch.setattr(reconcile, "SERVED", 7)
    monkeypatch.setattr(reconcile, "BLOCK", 10)
    rng = random.Random(5)
    titles = ["abcdefgh", "abcdefghi", "abcdefghj", "abcdefgx", "mnopqrst", "mnopqrsx", "zzyyxxww", ""]
    make = lambda tag: [(f"{rng.randrange(1 << 40):010x}{tag}", [rng.choice(titles), rng.choice(["p", "q", ""]), rng.choice(["d", "e"])]) for _ in range(90)]
    gone, new = make("g"), make("n")
    frame = lambda rows: spark.createDataFrame(rows, "uid string, key array<string>").persist()
    pairs = reconcile.renames_by_key(frame(gone), frame(new), save=lambda df: df.checkpoint())
    every = sorted(((r.score, r.prev_uid, r.uid) for r in pairs.collect()), reverse=True)
    assert len(every) == len(set(every)) and not re.search(r"keys=\[a#\d+, b#\d+", pairs._jdf.queryExecution().executedPlan().toString())
    used, want = set(), []
    for s, a, b in every:
        if a not in used and b not in used:
            used |= {a, b}
            want.append((a, b, s))
    got = reconcile.assign_renames(frame(gone), frame(new), lambda df: df.checkpoint())
    assert sorted(map(tuple, got.collect())) == sorted(want) and want


def test_blocks_are_dealt_by_their_pairs_and_scores_rounded_before(spark, monkeypatch):
    """Many rows of few titles are few bytes and many pairs: they become many tasks. A score is rounded for two titles, not for each pair of rows."""
    from marquee.plans import queries as plans

    monkeypatch.setattr(reconcile, "TASK", 200, raising=False)
    monkeypatch.setattr(reconcile, "BLOCK", 10)
    frame = lambda tag: spark.createDataFrame([(f"{tag}{i}", ["abcdefg" + "hijk"[i % 2 * 3 :], "", ""]) for i in range(120)], "uid string, key array<string>")
    pairs = reconcile.renames_by_key(frame("g"), frame("n"))
    assert pairs.count() == 120 * 120 and pairs.rdd.getNumPartitions() >= 72
    plan = plans.QUERIES["rename_candidates"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "round(score" in plan and plan.index("Generate explode(bs") < plan.index("round(score")


def test_numbered_characters_give_the_same_similarity(spark):
    from marquee.functions import text

    rows = spark.createDataFrame([(a, b) for a in ("banana", "", "a", "あaあ", "nab an") for b in ("bandana", "", "aaa", "ああい")], "a string, b string")
    one, other = text.multiset_similarity(F.col("a"), F.col("b")), text.shared_part(text.numbered_characters(F.col("a")), text.numbered_characters(F.col("b")))
    assert all(r.x == r.y for r in rows.select(one.alias("x"), other.alias("y")).collect())
