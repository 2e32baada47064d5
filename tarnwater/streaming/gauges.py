"""Counters and gauges of an event stream, kept as state: totals, and the last value by event time, however late its row comes."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..sources.keyed import KeyedTable

#: Shards of one event type: a type that holds most rows is counted by so many tasks, and readers add them up.
SHARDS = 16
OUT = T.StructType([T.StructField("event_type", T.StringType()), T.StructField("shard", T.IntegerType()), T.StructField("n", T.LongType()),
    T.StructField("total", T.DoubleType()), T.StructField("ts", T.TimestampType()), T.StructField("value", T.DoubleType()),
    T.StructField("idle", T.BooleanType())])
STATE = T.StructType([T.StructField("n", T.LongType()), T.StructField("total", T.DoubleType()), T.StructField("ts", T.LongType()), T.StructField("value", T.DoubleType())])


class GaugeState(StatefulProcessor):
    """n and total of all values; time (microseconds) and value of the latest row, of equal times the largest value.

    A row later than the watermark has been dropped by then; one that is merely out of order counts, and becomes the gauge only
    if it is the latest.  With idle_ms, a timer tells when the watermark has passed the latest row by so much.
    """

    def __init__(self, idle_ms: int | None = None) -> None:
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", STATE)

    def _row(self, key: tuple, n: int, total: float, ts: int | None, value: float | None, idle: bool) -> pd.DataFrame:
        return pd.DataFrame({"event_type": [key[0]], "shard": [key[1]], "n": [n], "total": [total], "ts": [pd.NaT if ts is None else pd.Timestamp(ts, unit="us")], "value": [value], "idle": [idle]})

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        n, total, ts, value = self.held.get() if self.held.exists() else (0, 0.0, None, None)
        before = ts
        for part in rows:
            n += len(part)
            total += float(part["value"].sum())  # nulls add nothing
            dated = part.dropna(subset=["us"])
            if len(dated):
                last = int(dated["us"].max())
                if ts is None or last >= ts:
                    values = dated.loc[dated["us"] == last, "value"].dropna()
                    largest = None if values.empty else float(values.max())
                    if ts is None or last > ts or value is None or (largest is not None and largest > value):
                        value = largest if ts is None or last > ts or largest is not None else value
                    ts = last
        self.held.update((n, total, ts, value))
        if self.idle_ms is not None and ts is not None and ts != before:
            if before is not None:
                self.handle.deleteTimer(before // 1000 + self.idle_ms)
            self.handle.registerTimer(ts // 1000 + self.idle_ms)
        yield self._row(key, n, total, ts, value, False)

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:
        yield self._row(key, *self.held.get(), True)

    def close(self) -> None:
        pass


def gauge_updates(events: DataFrame, late: str | None = None, idle_ms: int | None = None, shards: int = SHARDS) -> DataFrame:
    """A stream of the state of each (event_type, shard) that changed, from a stream of events (event_id, ts, event_type, value).

    late: how far behind the latest row a row may be and still count (needed for idle_ms, which works in event time).
    """
    if idle_ms is not None and late is None:
        raise ValueError("timers in event time need a watermark")
    rows = events if late is None else events.withWatermark("ts", late)
    # Microseconds, whatever the session's time zone; the time itself is kept for the watermark alone.
    rows = rows.select("ts", "event_type", F.col("value").cast("double").alias("value"), F.unix_micros("ts").alias("us"), F.pmod(F.xxhash64("event_id"), F.lit(shards)).cast("int").alias("shard"))
    return rows.groupBy("event_type", "shard").transformWithStateInPandas(GaugeState(idle_ms), OUT, "Update", "None" if idle_ms is None else "EventTime")


def keep_gauges(events: DataFrame, table: str, checkpoint: str, **how) -> StreamingQuery:
    """Work through what a stream holds now and keep each state's latest row in a keyed table; a batch that is run again changes nothing."""
    spark = events.sparkSession
    # State that outgrows memory lies on disk and is checkpointed by its changes.
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    kept = KeyedTable(spark, table)
    if not kept.versions():
        kept.create(OUT, ["event_type", "shard"], 16)

    def step(batch: DataFrame, _: int) -> None:
        # a timer's row tells of the state as the input rows of its batch left it
        kept.upsert(batch.groupBy("event_type", "shard").agg(F.max_by(F.struct("n", "total", "ts", "value", "idle"), F.struct("n", "idle")).alias("s")).select("event_type", "shard", "s.*"))

    return gauge_updates(events, **how).writeStream.outputMode("update").foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_gauges(spark: SparkSession, table: str) -> DataFrame:
    """(event_type, n, total, ts, value, idle): the shards of each type put together; idle if all are."""
    rows = KeyedTable(spark, table).read()
    last = F.max(F.struct("ts", "value"))
    return rows.groupBy("event_type").agg(F.sum("n").alias("n"), F.sum("total").alias("total"), last["ts"].alias("ts"), last["value"].alias("value"), F.bool_and("idle").alias("idle"))
