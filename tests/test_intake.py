import json

import pytest
from pyspark.sql import functions as F

from marquee.streaming import intake

POLICY = intake.Policy(("title", "venue", "kana", "lat", "desc", "price"), ("kana", "lat"), ("lat",), ("price", "title"), "venue")
PREVIOUS = [("a", 1, "old a", "v", "ka", "1.5", "da", "10"), ("b", 2, "old b", "w", "kb", None, "db", "20")]
BATCHES = [
    [{"uid": "a", "title": "a", "venue": "v", "_carry": "desc|price|bogus", "x": 1}, {"uid": "n", "title": "n", "venue": "v", "_carry": "*", "_carry_from": " b "}, {"uid": "m", "title": "m", "venue": "w", "_carry": "desc", "y": None, "x": 2}],
    [{"uid": "o", "title": "o", "venue": "w", "lat": "9"}, {"uid": "o", "title": "o", "venue": "w", "lat": "9"}, "[1]", "{bad", ""],
    [{"uid": "p", "title": "p", "venue": "w"}, {"uid": "q", "title": None, "venue": None, "desc": " "}],
]


class Stopped(Exception):
    pass


def land(folder, number):
    at = folder / f"{number}"
    at.mkdir(parents=True)
    lines = [x if isinstance(x, str) else json.dumps(x) for x in BATCHES[number]]
    for i, part in enumerate((lines[:1], lines[1:])):
        (at / f"{i}.json").write_text("\n".join(part) + "\n")


def run(spark, root, stop=lambda _: None):
    previous = spark.createDataFrame(PREVIOUS, "uid string, row_no long, title string, venue string, kana string, lat string, desc string, price string")
    intake.stream(spark, f"{root}/in/*", previous, f"{root}/out", f"{root}/progress", POLICY, lambda rows: F.col("fields")["uid"], 40, stop).awaitTermination()


def told(spark, root):
    parts = {p: intake.committed(spark, f"{root}/out", p) for p in ("rows", "rejects", "misses", "fields", "fills")}
    return {p: sorted(map(str, (r.asDict() for r in df.collect()))) for p, df in parts.items()}


@pytest.fixture(scope="module")
def whole(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("whole")
    for n in range(3):
        land(root / "in", n)
        run(spark, root)
    return root, told(spark, root)


def test_what_is_taken(spark, whole):
    root, got = whole
    rows = {r.id: r for r in intake.committed(spark, f"{root}/out").collect()}
    assert sorted(rows) == list(range(41, 48))
    by = {r.uid: r for r in rows.values()}
    assert (by["a"].title, by["a"].kana, by["a"].lat, by["a"].desc, by["a"].price) == ("a", "ka", "1.5", "da", None)
    assert (by["n"].kana, by["n"].lat, by["n"].desc, by["n"].price) == ("kb", "1.5", "db", None)
    assert (by["m"].desc, by["m"].lat) == (None, None)  # w has no lat before
    assert by["p"].lat == "9"  # from a row of an earlier batch
    assert (by["q"].title, by["q"].desc) == (None, None) or by["q"].desc == " "
    assert {r.batch: (r.first_id, r.last_id, r.n) for r in spark.read.parquet(f"{root}/out/ranges").collect()} == {0: (41, 43, 3), 1: (44, 45, 2), 2: (46, 47, 2)}
    assert {(r.uid, r["column"], r.reason) for r in intake.committed(spark, f"{root}/out", "rejects").collect()} == {("a", "price", "forbidden"), ("a", "bogus", "unknown"), (None, "[1]", "no object"), (None, "{bad", "no object")}
    assert [(r.uid, r.wanted) for r in intake.committed(spark, f"{root}/out", "misses").collect()] == [("m", "m")]
    assert {(r.field, r.n) for r in intake.committed(spark, f"{root}/out", "fields").collect()} == {("x", 2), ("y", 1), ("uid", 3), ("uid", 2)}


@pytest.mark.parametrize("step", ["rows", "misses", "fills", "ranges"])
def test_a_batch_that_was_stopped_is_taken_once(spark, tmp_path, whole, step):
    calls = []

    def stop(done):
        calls.append(done)
        if calls.count(step) == 2 and done == step:
            raise Stopped

    land(tmp_path / "in", 0)
    run(spark, tmp_path, stop)
    land(tmp_path / "in", 1)
    with pytest.raises(Exception, match="Stopped"):
        run(spark, tmp_path, stop)
    assert sorted(r.id for r in intake.committed(spark, f"{tmp_path}/out").collect()) == [41, 42, 43] + [44, 45] * (step == "ranges")
    run(spark, tmp_path, stop)
    land(tmp_path / "in", 2)
    run(spark, tmp_path, stop)
    assert told(spark, tmp_path) == whole[1]
