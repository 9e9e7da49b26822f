from datetime import date

from pyspark.sql import functions as F

from marquee.operators import reconcile
from marquee.plans import queries
from marquee.sources import adapter, landing

A, B, C = date(2026, 1, 1), date(2026, 1, 8), date(2026, 1, 15)


def plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_comparing_landed_snapshots_moves_no_row(spark):
    rows = lambda lo, hi, x: spark.range(lo, hi).select((F.col("id") % 300).cast("string").alias("uid"), F.col("id").alias("row_no"), F.lit(x).alias("x"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        table = landing.land({A: rows(0, 50, "old"), B: rows(0, 500, "a"), C: rows(100, 700, "b").withColumn("extra", F.lit(1))}, buckets=5)
        prev, cur = landing.before(spark, table, C), landing.snapshot(spark, table, C)
        assert (prev.count(), cur.count(), landing.snapshot(spark, table, A).count()) == (300, 300, 50) and landing.before(spark, table, A) is None
        assert {r.uid: r.row_no for r in prev.collect()} == {str(k % 300): k for k in range(500)}
        assert cur.columns == [*prev.columns] and prev.filter("extra is not null").count() == 0
        for df, n in ((reconcile.gone(prev, cur), 0), (reconcile.added(landing.snapshot(spark, table, A), cur).select("uid"), 250), (reconcile.changed(prev, cur, ["x"]), 300)):
            assert "Exchange" not in plan(df) and df.count() == n
        both = prev.join(cur.select("uid", F.lit(1).alias("c")), "uid", "full_outer")
        assert "Exchange" not in plan(both)
        assert "snapshot_date" in plan(prev) and "PartitionFilters: [" in plan(prev) and "SelectedBucketsCount: 5 out of 5" in plan(both)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_snapshots_are_made_of_heads_alone(spark):
    sf = "/root/testdata/sf0.001"
    made = adapter.derived_listing(spark, sf, adapter.head_facts(spark, sf)).select(*adapter.HEADS, "venues")
    assert "collect_set" not in plan(made)
    whole = adapter.derived_listing(spark, sf, adapter.line_facts(spark, sf)).select(*adapter.HEADS, F.slice("venues", 1, 1).alias("venues"))
    assert made.exceptAll(whole).isEmpty() and whole.exceptAll(made).isEmpty() and made.count() == spark.read.parquet(f"{sf}/orders.parquet").count()
    for side in queries.snapshots(spark, sf):
        assert {*side.columns} == {*adapter.HEADS, "venues", "uid"}
