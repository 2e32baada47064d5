import datetime as dt

import pytest
from pyspark.sql import functions as F

from tarnwater.operators import observe
from tarnwater.sources.shared import shared_dir
from tarnwater.streaming import gauges

SCHEMA = "event_id long, ts timestamp, event_type string, value double"
START = dt.datetime(2024, 1, 1)


def row(i, minute, kind, value):
    return (i, None if minute is None else START + dt.timedelta(minutes=minute), kind, value)


def run(spark, folder, batches, **how):
    """Each batch is a file of its own and a run of its own over the same checkpoint."""
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{folder}/in/{i}")
        stream = spark.readStream.schema(SCHEMA).option("recursiveFileLookup", True).parquet(f"{folder}/in")
        gauges.keep_gauges(stream, f"{folder}/table", f"{folder}/checkpoint", **how).awaitTermination()
    return {r.event_type: r for r in gauges.read_gauges(spark, f"{folder}/table").collect()}


def test_gauges_equal_those_of_the_whole_table(spark):
    batches = [[row(i, (i * 37) % 500, "abc"[i % 3 if i % 2 else 0], float(i % 17)) for i in range(300)],
        [row(1000, 900, "a", 5.0), row(1001, 900, "a", 7.0), row(1002, 3, "b", 99.0), row(1003, None, "b", 1.0), row(1004, 1, "new", None), row(1005, 901, "c", None)]]
    got = run(spark, shared_dir(spark, "gauges"), batches)
    whole = spark.createDataFrame([r for b in batches for r in b], SCHEMA)
    want = {r.event_type: r.value for r in observe.gauges(whole.filter("ts IS NOT NULL")).collect()}
    assert {k: r.value for k, r in got.items()} == want and want["a"] == 7.0
    assert {k: (r.n, round(r.total, 6)) for k, r in got.items()} == {r.event_type: (r.n, r.total or 0.0) for r in observe.counters(whole).collect()}


def test_late_rows_are_dropped_and_idle_types_told(spark):
    batches = [[row(1, 0, "a", 1.0), row(2, 10, "b", 2.0)], [row(3, 100, "b", 3.0)], [row(4, 5, "a", 9.0), row(5, 95, "b", 8.0)], [row(6, 101, "b", 4.0)]]
    got = run(spark, shared_dir(spark, "gauges"), batches, late="20 minutes", idle_ms=30 * 60_000, shards=1)
    assert (got["a"].n, got["a"].value, got["a"].idle) == (1, 1.0, True)  # minute 5 came when the watermark stood at 80
    assert (got["b"].n, got["b"].value, got["b"].idle) == (4, 4.0, False)  # minute 95 was in time, but not the latest
    with pytest.raises(ValueError):
        gauges.gauge_updates(spark.createDataFrame([], SCHEMA), idle_ms=1)


def test_sketches_merge_upward(spark):
    events = spark.range(40_000).select(F.timestamp_seconds(F.col("id") * 7).alias("ts"),
        F.when(F.col("id") % 3 == 0, "rare").otherwise("often").alias("event_type"), (F.col("id") % 5000).alias("user_id"),
        (F.col("id") % 1000).cast("double").alias("value"))
    hours = observe.sketches(events)
    assert hours.count() == 2 * 78
    exact = {r.event_type: r for r in events.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("user_id").alias("d"), F.percentile("value", 0.5).alias("p50"), F.percentile("value", 0.99).alias("p99")).collect()}
    days = observe.merge_sketches(hours, [F.date_trunc("day", "window_start").alias("window_start"), F.col("event_type")])
    for table in (hours, days):  # by way of days, or straight from the hours
        got = {r.event_type: r for r in observe.read_sketches(observe.merge_sketches(table, [F.col("event_type")]), (0.5, 0.99)).collect()}
        for k, want in exact.items():
            assert got[k].n == want.n and abs(got[k].users / want.d - 1) < 0.05
            assert abs(got[k].p50 - want.p50) <= 1000 * 0.02 and abs(got[k].p99 - want.p99) <= 1000 * 0.02
    assert observe.read_sketches(observe.merge_sketches(observe.sketches(events.limit(0)), [F.col("event_type")])).count() == 0
