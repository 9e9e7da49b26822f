import os
import time
from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F

from marquee.sources import readers
from marquee.sources.scratch import saver


def test_rows_keep_their_place_over_several_files(spark, tmp_path):
    folder = tmp_path / "set"
    folder.mkdir()
    (folder / "b.csv").write_text('﻿title ,lat\n"two\nlines",1\n,\n"say ""hi""",x\n')
    (folder / "a.csv").write_text("title,lat\nfirst,35.5\n,36\n")
    rows = readers.load_set(spark, str(folder), {"title": ("title", "txt"), "lat": ("lat", "num"), "none": ("none", "txt")}, saver(spark), "event", untitled="?").orderBy("row_no").collect()
    assert [(r.row_no, r.key, r.tab, r.title, r.lat, r.none) for r in rows] == [(0, "event-0", "event", "first", 35.5, None), (1, "event-1", "event", "?", 36.0, None), (2, "event-2", "event", "two\nlines", 1.0, None), (3, "event-3", "event", 'say "hi"', None, None)]
    (tmp_path / "none.csv").write_text("title,lat\n")
    for path in ("none.csv", "missing.csv"):
        with pytest.raises(ValueError, match=path):
            readers.load_set(spark, str(tmp_path / path), {"title": ("title", "txt")}, saver(spark))


def test_freshness_of_two_real_files(spark, tmp_path):
    stamps = {"a": datetime(2026, 8, 1, 20, tzinfo=UTC), "b": datetime(2026, 8, 1, 10, tzinfo=UTC)}
    for name, at in stamps.items():
        (tmp_path / name).mkdir()
        for i, back in enumerate((0, 86_400 * 30)):
            (tmp_path / name / f"{i}.csv").write_text("x\n1\n")
            os.utime(tmp_path / name / f"{i}.csv", (at.timestamp() - back,) * 2)
    times = readers.file_times(spark, {n: str(tmp_path / n) for n in stamps})
    assert "content" not in times._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[-1]
    none = spark.createDataFrame([], "dataset string, value string")
    assert {r.dataset: str(r.updated) for r in readers.freshness(times, none).collect()} == {"a": "2026-08-02", "b": "2026-08-01"}
    assert spark.range(1).select(readers.japan_date(F.current_timestamp())).first()[0] == datetime.fromtimestamp(time.time() + 9 * 3600, UTC).date()


def test_masters(spark, tmp_path):
    (tmp_path / "t.csv").write_text("chain,name,lat\nX,,35\nX,Hall,36\n")
    (tmp_path / "v.csv").write_text("venue,kind,capacity\nDome,live,\"1,200\"\n,live,5\n")
    assert [(r.chain, r.name, r.lat) for r in readers.theatres(readers.read_csv(spark, str(tmp_path / "t.csv"))).collect()] == [("X", readers.NO_NAME, 35.0), ("X", "Hall", 36.0)]
    assert [(r.venue, r.capacity, r.pref) for r in readers.venues(readers.read_csv(spark, str(tmp_path / "v.csv"))).collect()] == [("Dome", 1, None)]
