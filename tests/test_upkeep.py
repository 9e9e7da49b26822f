import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from marquee.operators import favourites, search
from marquee.plans import upkeep
from marquee.sources import export, publish
from marquee.streaming import daily

D0 = date(2026, 3, 1)
SF = "/root/testdata/sf0.001"
SCHEMA = "row_no long, tab string, start_date date, end_date date, dates array<date>, backup_date array<date>, announced_date date, onsale_label string, onsale_start date, onsale_end date, onsale_time string"


def test_days_equal_full_views(spark, tmp_path):
    rng = random.Random(6)
    some = lambda p=0.3: None if rng.random() < p else D0 + timedelta(rng.randrange(-20, 90))
    many = lambda: sorted({D0 + timedelta(rng.randrange(-10, 80)) for _ in range(rng.choice([0, 0, 2, 5]))})
    rows = [(i, rng.choice(["event", "movie", "live"]), some(), some(), many(), many()[:1], some(), rng.choice([None, "完売", "advance"]), some(), some(), rng.choice([None, "10:00", "8:30"])) for i in range(120)] + [(999, "event", None, None, [], [], None, None, None, None, None)]
    rows = spark.createDataFrame(rows, SCHEMA).persist()
    path = str(tmp_path / "view")
    days = [D0]
    while (days[-1] - D0).days < 60:
        days.append(days[-1] + timedelta(rng.choice([1, 1, 2, 3, 9])))
    daily.begin(rows, path, days[0])
    computed = 0
    for last, today in zip(days, days[1:], strict=False):
        computed += daily.due(spark, path, last, today).count()
        daily.advance(rows, path, last, today)
        daily.advance(rows, path, last, today)  # again
    for today in days:
        got = sorted(map(tuple, daily.current(spark, path, today).select("row_no", "phase", "status", "rank", "state", "fresh", "next_open").collect()))
        assert got == sorted(map(tuple, daily.view(rows, today).drop("next_change").collect())), today
    assert computed < 0.6 * 121 * (len(days) - 1)


def test_favourites_after_compactions(spark, tmp_path):
    rng = random.Random(7)
    log = [(rng.randrange(4), f"u{rng.randrange(5)}", n, rng.choice(["add", "remove", "toggle", "toggle"])) for n in range(1, 160)]
    log += [log[9], log[20]]  # logged twice
    frame = spark.createDataFrame(log, "user_id long, uid string, seq long, action string")
    root = str(tmp_path / "root")

    def plain(upto=10**9):
        own = set()
        for u, x, _, a in sorted({r for r in log if r[2] <= upto}, key=lambda r: r[2]):
            on = (u, x) not in own if a == "toggle" else a == "add"
            (own.add if on else own.discard)((u, x))
        return own

    now = lambda: {(r.user_id, r.uid) for r in favourites.standing(spark, root, frame).collect()}
    assert now() == plain() and plain()
    for upto in (40, 41, 120):
        favourites.compact(spark, root, frame, upto)
        assert now() == plain() and {(r.user_id, r.uid) for r in publish.current(spark, root)["favourites"].collect()} == plain(upto)
    with pytest.raises(RuntimeError):
        favourites.compact(spark, root, frame, 150, lambda step: (_ for _ in ()).throw(RuntimeError(step)))
    assert now() == plain() and publish.manifest(spark, root)["facts"] == {"upto": 120}


def test_lines_are_those_of_the_list(spark, tmp_path):
    root = str(tmp_path / "out")
    rows = spark.range(50).repartition(4).select(F.concat(F.lit("line "), F.col("id").cast("string")).alias("x"))
    told = export.write_lines(rows, root)
    assert sorted(r.line for r in export.read_lines(spark, root).collect()) == sorted(f"line {i}" for i in range(50)) and len(told["files"]) == 4
    export.write_lines(rows.limit(3), root)
    assert export.read_lines(spark, root).count() == 3
    with open(export.write_lines(rows, root)["files"][0][0].removeprefix("file:"), "a") as f:
        f.write("more")
    with pytest.raises(ValueError, match="not as listed"):
        export.read_lines(spark, root)
    export.write_lines(rows.limit(0), root)
    assert export.read_lines(spark, root).count() == 0


def test_venues_in_japanese_order(spark):
    names = ["横浜", "いけぶくろ", "アリーナ", "ｱﾘｰﾅ", "Zepp", "愛知", "かんだ", "ガーデン", "カフェ", "abc"]
    counts = spark.createDataFrame([(v, 1, "live") for v in names] + [("top", 9, "hall")], "venue string, n long, kind string")
    got = [r.venue for r in search.venue_picker(counts).orderBy("place").collect()]
    assert got[:3] == ["top", "abc", "Zepp"] and got.index("アリーナ") < got.index("いけぶくろ") < got.index("ガーデン") < got.index("カフェ") < got.index("かんだ") < got.index("愛知") < got.index("横浜")
    assert [r.venue for r in search.venue_picker(counts, part="Z", kind="live").collect()] == ["Zepp"] and search.venue_picker(counts, kind="none").count() == 0


def test_a_row_of_blank_cells_stays_in_its_set(spark, tmp_path):
    for name in ("nation", "region", "customer", "supplier", "part", "lineitem"):
        spark.read.parquet(f"{SF}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    orders = spark.read.parquet(f"{SF}/orders.parquet").limit(1)
    # none has lines; the first, by its id, has neither title, day nor place
    orders.select(F.explode(F.array(*[F.lit(4437 * 9 + k).cast("long") for k in range(4)])).alias("o_orderkey"), *[c for c in orders.columns if c != "o_orderkey"]).write.parquet(f"{tmp_path}/orders.parquet")
    got = {r.row_no: (r.title, r.venues, r.start_date, r.lat) for r in upkeep.loaded_sets(spark, str(tmp_path)).filter("tab = 'event'").collect()}
    assert len(got) == 2 and got[0] == ("(event)", 0, None, None)
