import json
from datetime import date


from marquee.streaming import jobs, promotion

ROSTER = [("A b", "candidate", 0, None), ("c", "candidate", 1, date(2026, 1, 1)), ("d", "active", 0, None), ("e", "candidate", None, date(2026, 1, 1)), ("f", "retired", 9, None), ("g", "candidate", 0, date(2026, 5, 1))]


def test_each_candidate_is_promoted_once(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    roster = spark.createDataFrame(ROSTER, "name string, status string, hit_count long, last_hit date")
    events = []

    def run():
        hits = spark.readStream.schema(jobs.HIT).json(str(source))
        out = promotion.promotions(hits, roster)
        out.writeStream.outputMode("append").foreachBatch(lambda df, _: events.extend(tuple(r) for r in df.collect())).option("checkpointLocation", str(tmp_path / "progress")).trigger(availableNow=True).start().awaitTermination()

    def land(name, rows):
        lines = [{"hit_id": h, "name": n, "day": d, "seen_at": f"{s}T00:00:00Z"} for h, n, d, s in rows]
        (source / name).write_text("\n".join(map(json.dumps, lines)))
        run()

    land("1.json", [("1", "ａＢ", "2026-01-05", "2026-01-05"), ("1", "ab", "2026-01-05", "2026-01-05"), ("2", "c", "2026-01-06", "2026-01-06"), ("3", "d", "2026-01-06", "2026-01-06"), ("4", "f", "2026-01-06", "2026-01-06"), ("5", "unknown", "2026-01-06", "2026-01-06"), ("6", None, "2026-01-06", "2026-01-06")])
    assert events == [("c", "active", 2, date(2026, 1, 6))]  # a repeated hit promotes nobody
    land("2.json", [("1", "AB", "2026-01-05", "2026-01-06"), ("7", "a b", "2026-01-03", "2026-01-06"), ("8", "c", "2026-01-02", "2026-01-02")])
    assert events[1:] == [("A b", "active", 2, date(2026, 1, 5))]  # a late hit counts and doesn't move the last day back
    land("3.json", [("9", "a b", "2026-01-07", "2026-01-07"), ("10", "c", "2026-01-07", "2026-01-07"), ("11", "unknown", "2026-01-07", "2026-01-07")])
    assert len(events) == 2
    land("4.json", [("12", "d", "2026-03-20", "2026-03-20")])
    land("5.json", [("13", "d", "2026-03-21", "2026-03-21"), ("14", "e", "2026-01-01", "2026-01-01")])
    assert sorted(events[2:]) == [("e", "retired", 0, date(2026, 1, 1))]  # idle for 60 days before the watermark; g isn't
    land("6.json", [("15", "e", "2026-03-21", "2026-03-21"), ("16", "e", "2026-03-21", "2026-03-21")])
    assert len(events) == 3


def test_only_hits_of_candidates_are_kept(spark, tmp_path):
    """Others give no event, so their hits are not written to the state; those of a place reach its own state as one row."""
    source = tmp_path / "in"
    source.mkdir()
    rows = [(f"{name}{n}", name, None if n == 3 else f"2026-01-{n + 1:02}") for name in ("Ａ b", "d", "f", "unknown", "½") for n in range(9)]
    (source / "1.json").write_text("\n".join(json.dumps({"hit_id": h, "name": n, "day": d, "seen_at": "2026-01-10T00:00:00Z"}) for h, n, d in [*rows, *rows]))
    roster = spark.createDataFrame([*ROSTER, ("1⁄2", "candidate", 3, None)], "name string, status string, hit_count long, last_hit date")
    out = promotion.promotions(spark.readStream.schema(jobs.HIT).json(str(source)), roster)
    events = []
    q = out.writeStream.outputMode("append").foreachBatch(lambda df, _: events.extend(tuple(r) for r in df.collect())).option("checkpointLocation", str(tmp_path / "progress")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(events) == [("1⁄2", "active", 12, date(2026, 1, 9)), ("A b", "active", 9, date(2026, 1, 9))]
    kept = [s for p in q.recentProgress for s in p["stateOperators"] if s["operatorName"] == "dedupeWithinWatermark"]
    assert sum(s["numRowsUpdated"] for s in kept) == 18
