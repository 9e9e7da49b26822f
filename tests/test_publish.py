from datetime import date

import pytest
from pyspark.sql import functions as F

from marquee.sources import publish


def gate(tables):
    return tables["listing"].agg(F.count_if("bad").alias("errors")).withColumn("publish", F.col("errors") == 0)


def rows(spark, n, bad=0):
    return spark.range(n).withColumn("bad", F.col("id") < bad)


def seen(spark, root):
    return {k: df.count() for k, df in publish.current(spark, root).items()}, (publish.manifest(spark, root) or {}).get("version")


def test_a_failing_gate_leaves_the_last_good_version(spark, tmp_path):
    root = str(tmp_path / "root")
    assert seen(spark, root) == ({}, None) and not publish.next_run(spark, root, date(2026, 1, 1))
    ok, told = publish.publish(spark, root, {"listing": rows(spark, 3, 1)}, gate)
    assert not ok and told["gate"] == {"errors": 1, "publish": False} and seen(spark, root) == ({}, None)
    assert publish.publish(spark, root, {"listing": rows(spark, 3), "roster": rows(spark, 9)}, gate)[0]
    assert not publish.publish(spark, root, {"listing": rows(spark, 8, 2)}, gate)[0]
    assert seen(spark, root) == ({"listing": 3, "roster": 9}, 1)
    assert publish.publish(spark, root, {"listing": rows(spark, 5)}, gate)[0]
    assert seen(spark, root) == ({"listing": 5, "roster": 9}, 2)


@pytest.mark.parametrize("step", ["listing", "roster", "gate", "move"])
def test_a_writer_that_dies(spark, tmp_path, step):
    root = str(tmp_path / "root")
    publish.publish(spark, root, {"listing": rows(spark, 3), "roster": rows(spark, 9)}, gate)
    before = publish.current(spark, root)

    def stop(done):
        if done == step:
            raise RuntimeError(done)

    with pytest.raises(RuntimeError):
        publish.publish(spark, root, {"listing": rows(spark, 4), "roster": rows(spark, 2)}, gate, stop=stop)
    assert seen(spark, root) == (({"listing": 4, "roster": 2}, 2) if step == "move" else ({"listing": 3, "roster": 9}, 1))
    assert before["listing"].count() == 3  # who began with a version goes on with it
    publish.publish(spark, root, {"listing": rows(spark, 4), "roster": rows(spark, 2)}, gate)
    assert seen(spark, root)[0] == {"listing": 4, "roster": 2}


def test_a_run_begins_with_a_snapshot(spark, tmp_path):
    root = str(tmp_path / "root")
    publish.publish(spark, root, {"listing": rows(spark, 3), "roster": rows(spark, 9), "dispositions": rows(spark, 2)})
    assert publish.next_run(spark, root, date(2026, 1, 8))
    assert seen(spark, root) == ({"listing": 0, "roster": 9, "dispositions": 0, "previous": 3}, 2)
    assert publish.manifest(spark, root)["facts"] == {"taken_at": "2026-01-08", "taken": 3}
    assert publish.current(spark, root)["listing"].columns == ["id", "bad"]
