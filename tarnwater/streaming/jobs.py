"""Incremental jobs on Structured Streaming: event rates, and uploads chunked as they arrive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.chunking import chunk_records


def event_rates(events: DataFrame, width: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Counts and mean values by window and type; windows close once the watermark has passed them."""
    grouped = events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean_value"))
    return grouped.select(F.col("w.start").alias("window_start"), "event_type", "n", "mean_value")


def ingest(spark: SparkSession, incoming: str, schema: str, store: str, checkpoint: str, transform: Callable[[DataFrame], DataFrame] = chunk_records, key: str = "chunk_id") -> StreamingQuery:
    """Chunk new record files and append the chunks that the store lacks; a batch that is run again adds nothing."""

    def step(batch: DataFrame, _: int) -> None:
        chunks = transform(batch).dropDuplicates([key])
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(store)
        if p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
            chunks = chunks.join(spark.read.parquet(store).select(key), key, "left_anti")
        chunks.write.mode("append").parquet(store)

    return spark.readStream.schema(schema).json(incoming).writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
