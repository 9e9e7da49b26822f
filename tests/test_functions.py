"""Golden rows of the scalar functions."""

import random
import re
from datetime import date, datetime

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from marquee.functions import casts, geo, sale, schedule, text

D = date.fromisoformat


def listing_rows(spark, rows):
    base = {"row_no": 0, "tab": "event", "start_date": None, "end_date": None, "dates": [], "backup_date": []}
    schema = "row_no long, tab string, start_date date, end_date date, dates array<date>, backup_date array<date>"
    return spark.createDataFrame([tuple((base | {"row_no": i} | r)[k] for k in base) for i, r in enumerate(rows)], schema)


def one(spark, column, row):
    return listing_rows(spark, [row]).select(column.alias("x")).first().x


@pytest.mark.parametrize(("day", "want"), [("2026-08-07", "soon"), ("2026-08-08", "last"), ("2026-08-09", "backup"), ("2026-08-10", "ended"), ("2026-07-01", "far")])
def test_backup_day_sequence(spark, day, want):
    row = {"start_date": D("2026-08-08"), "end_date": D("2026-08-08"), "backup_date": [D("2026-08-09")]}
    assert one(spark, schedule.phase(D(day)), row) == want


def test_phases_of_runs(spark):
    days = [D("2026-08-10"), D("2026-08-11"), D("2026-08-14"), D("2026-08-16")]
    assert one(spark, schedule.phase(D("2026-08-12")), {"dates": days}) == "gap"
    assert one(spark, schedule.next_open_day(D("2026-08-12")), {"dates": days}) == D("2026-08-14")
    assert one(spark, schedule.phase(D("2026-08-12")), {}) is None
    assert one(spark, schedule.phase(D("2026-08-12")), {"start_date": D("2026-08-01")}) == "openrun"
    run = {"start_date": D("2026-08-01"), "end_date": D("2026-08-31")}
    assert [one(spark, schedule.phase(D(d)), run) for d in ("2026-08-01", "2026-08-12", "2026-08-31")] == ["opening", "ongoing", "last"]
    assert one(spark, schedule.status(D("2026-08-01")), run | {"tab": "movie"}) == "上映中"
    assert one(spark, schedule.rank(D("2026-08-01")), {}) == schedule.RANK_FALLBACK


def test_spans(spark):
    span = schedule.span(F.col("start_date"), F.col("end_date"), F.col("dates"))
    cases = [
        ({"start_date": D("2026-08-08"), "end_date": D("2026-08-11")}, "2026.8.8(土)〜11(火)"), ({"start_date": D("2026-08-30"), "end_date": D("2026-09-01")}, "2026.8.30(日)〜9.1(火)"),
        ({"start_date": D("2026-12-30"), "end_date": D("2027-01-02")}, "2026.12.30(水)〜2027.1.2(土)"), ({"start_date": D("2026-08-08")}, "2026.8.8(土)〜"), ({"end_date": D("2026-08-08")}, "〜2026.8.8(土)"),
        ({"start_date": D("2026-08-08"), "end_date": D("2026-08-08")}, "2026.8.8(土)"), ({}, None), ({"dates": [D("2026-08-10"), D("2026-08-11"), D("2026-09-14")]}, "2026.8.10(月)・11(火)・9.14(月)"),
        ({"dates": [D(f"2026-08-{i:02}") for i in range(1, 11)]}, "2026.8.1(土)・2(日)・3(月)・4(火)・5(水)・6(木)・7(金)・ほか3日"),
    ]
    got = listing_rows(spark, [r for r, _ in cases]).select("row_no", span.alias("x")).orderBy("row_no").collect()
    assert [r.x for r in got] == [w for _, w in cases]


def test_presets_roll_over(spark):
    day = lambda key, d: tuple(map(str, spark.range(1).select(*[c.alias(n) for c, n in zip(schedule.preset_range(key, F.lit(D(d))), "ab", strict=True)]).first()))
    assert day("3m", "2026-11-30") == ("2026-11-30", "2027-03-02")
    assert day("weekend", "2026-08-09") == ("2026-08-09", "2026-08-09")
    assert day("weekend", "2026-08-05") == ("2026-08-08", "2026-08-09")
    assert day("month", "2026-02-03") == ("2026-02-03", "2026-02-28") and day("7d", "2026-02-03") == ("2026-02-03", "2026-02-09")
    with pytest.raises(ValueError):
        schedule.preset_range("x", F.lit(D("2026-01-01")))


def test_sale_states(spark):
    rows = [(None, "2026-08-01", None, "10:00", None, "before"), (None, "2026-08-01", None, "9:00", None, "open"), ("完売", None, None, None, None, "closed"), (None, None, "2026-08-01", None, None, "unknown"), (None, None, "2026-07-31", None, None, "closed"), ("抽選", None, None, None, None, "open")]
    df = spark.createDataFrame(rows, "onsale_label string, s string, e string, st string, et string, want string").withColumns({"onsale_start": F.to_date("s"), "onsale_end": F.to_date("e")})
    got = df.select("want", sale.state(datetime(2026, 8, 1, 9, 0), start_time="st", end_time="et").alias("got")).collect()
    assert [r.got for r in got] == [r.want for r in got]


def test_folds_and_norms(spark):
    words = [("ｚｅｐｐ", "zepp"), ("ズーラシア", "ず-らしあ"), ("ずーらしあ", "ず-らしあ"), ("Ａ　ｂ", "a b"), ("ＡＢ－Ｃ", "ab-c")]
    df = spark.createDataFrame([w for w, _ in words], "string").toDF("w")
    assert [r[0] for r in df.select(text.fold(F.col("w"))).collect()] == [w for _, w in words]
    assert [r[0] for r in df.select(text.fold_any(F.col("w"))).collect()] == [w for _, w in words]
    assert text.fold_text("ﾃﾞｨｽﾞﾆｰ") == text.fold_text("ディズニー") and text.terms("横浜　 ロック") == ["横浜", "ろっく"]
    title = spark.createDataFrame([("開創700年記念 特別展「大徳寺」",), ("特別展「大徳寺」―開創700年をめぐって",), (None,)], "t string")
    a, b, none = (r[0] for r in title.select(text.norm(F.col("t"))).collect())
    assert none is None and [r[0] for r in title.select(text.norm_any(F.col("t"))).collect()] == [a, b, None]
    assert spark.range(1).select(text.multiset_similarity(F.lit(a), F.lit(b))).first()[0] >= 0.82


def test_highlights_map_back_to_the_source(spark):
    df = spark.createDataFrame([("Ｚｅｐｐとﾃﾞｨｽﾞﾆｰ",), (None,), ("none",)], "t string")
    assert [r[0] for r in df.select(text.highlight(F.col("t"), "zepp でぃ")).collect()] == ["<mark>Ｚｅｐｐ</mark>と<mark>ﾃﾞｨ</mark>ｽﾞﾆｰ", None, "none"]


def test_highlights_take_a_slice_of_texts_at_a_time(spark):
    column = pa.array(["the " * 200_000, None, "", "x" * 300_000, "Ｔｈｅ"])
    parts = text.marked(iter([column]), ["the"])
    assert next(parts).to_pylist() == ["<mark>the</mark> " * 200_000, None, ""] and next(parts).to_pylist() == ["x" * 300_000, "<mark>Ｔｈｅ</mark>"] and next(parts, None) is None
    assert [len(x) for x in text.text_slices(column, 10)] == [1, 2, 1, 1] and list(text.text_slices(column.slice(0, 0))) == []
    df = spark.createDataFrame([(i, t) for i, t in enumerate(column.to_pylist())], "i int, t string").coalesce(1)
    assert [r[0] for r in df.select(text.highlight(F.col("t"), "the")).collect()] == ["<mark>the</mark> " * 200_000, None, "", "x" * 300_000, "<mark>Ｔｈｅ</mark>"]


def test_marks_cover_whole_characters_once():
    """Terms that meet, overlap or end inside a character's fold, against a flag for each character."""
    rng = random.Random(5)
    for _ in range(3000):
        t = "".join(rng.choice("abcaＡｂ½…ﾃﾞｶﾟ😀 ー㌔") for _ in range(rng.randrange(14)))
        wanted = text.terms("".join(rng.choice("abcで½.か  ") for _ in range(rng.randrange(7))))
        units = text._units(t)
        owner = [i for i, u in enumerate(units) for _ in text.fold_text(u)]
        hit = [False] * len(units)
        for w in wanted:
            for m in re.finditer(re.escape(w), text.fold_text(t)):
                for k in range(*m.span()):
                    hit[owner[k]] = True
        assert text.mark_text(t, wanted) == "".join("<mark>" * (h and not (i and hit[i - 1])) + u + "</mark>" * (h and hit[i + 1 : i + 2] != [True]) for i, (u, h) in enumerate(zip(units, hit, strict=True)))


def test_content_uid(spark):
    h = 5381
    for ch in "abc|Hall 1":
        h = (h * 33 + ord(ch)) % 2**32
    digits, want = "0123456789abcdefghijklmnopqrstuvwxyz", ""
    while h:
        h, r = divmod(h, 36)
        want = digits[r] + want
    assert spark.range(1).select(text.content_uid(F.lit("abc"), F.lit(""), F.lit("Hall 1"))).first()[0] == want


def test_casts(spark):
    df = spark.createDataFrame([(" a ", "12.5円", "1,200", "a| b ||c", "Yes", "2026-02-30", "2026-08-01|x|2026-8-1"), (None, "x", None, None, None, "2026-8-1", "")], "a string, b string, c string, d string, e string, f string, g string")
    x, y = df.select(casts.txt(F.col("a")), casts.real(F.col("b")), casts.integer(F.col("c")), casts.text_list(F.col("d")), casts.flag(F.col("e")), casts.day(F.col("f")), casts.day_list(F.col("g"))).collect()
    assert tuple(x) == ("a", 12.5, 1, ["a", "b", "c"], True, None, [D("2026-08-01")])
    assert tuple(y) == (None, None, None, [], False, None, [])


def test_distances_and_prices(spark):
    km, near, far = spark.range(1).select(geo.haversine(F.lit(35.0), F.lit(139.0), F.lit(36.0), F.lit(139.0)), geo.distance_text(F.lit(3.14159)), geo.distance_text(F.lit(12.6))).first()
    assert abs(km - 111.19) < 0.01 and (near, far) == ("3.1km", "13km")
    off = spark.createDataFrame([(2800, 2380, 15), (2800, 2380, 17), (2800, 2380, 18)], "po long, pb long, pct int").select(sale.discount_off(F.col("po"), F.col("pb"), F.col("pct"))).collect()
    assert [r[0] for r in off] == [False, False, True]
    p = spark.createDataFrame([(10, 8, "s"), (10, 12, "s"), (10, None, None), (None, 8, "s")], "o long, b long, s string").select(sale.price_comparison(F.col("o"), F.col("b"), F.col("s")).alias("p")).collect()
    assert [(r.p.kind, r.p.saved) for r in p] == [("compared", 2), ("compared", None), ("official_only", None), (None, None)]


def test_links(spark):
    links = [("https://a", "https://a"), (" mailto:x ", "mailto:x"), ("javascript:x", None), ("//a", None), ("/a", "/a"), ("./a", "./a"), ("#a", "#a"), ("a/b", None), ("", None), (None, None)]
    got = spark.createDataFrame(links, "u string, want string").select("want", text.safe_url(F.col("u")).alias("got")).collect()
    assert [r.got for r in got] == [r.want for r in got]
