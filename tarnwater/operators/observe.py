"""Counters, gauges, histograms and dashboard rates over an event table (ts, event_type, value, props)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def counters(events: DataFrame) -> DataFrame:
    """(event_type, n, total)."""
    return events.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 6).alias("total"))


def gauges(events: DataFrame) -> DataFrame:
    """(event_type, value): the latest value of each; of equal times the largest."""
    return events.groupBy("event_type").agg(F.max(F.struct("ts", "value"))["value"].alias("value"))


def histogram(events: DataFrame, bounds: tuple[float, ...] = (0.1, 0.5, 1, 5, 10, 50, 100)) -> DataFrame:
    """(event_type, le, n): cumulative counts up to each bound, infinity last."""
    counts = [F.struct(F.lit(float(b)).alias("le"), F.count_if(F.col("value") <= b).alias("n")) for b in bounds]
    return events.groupBy("event_type").agg(F.array(*counts, F.struct(F.lit(float("inf")).alias("le"), F.count("value").alias("n"))).alias("b")).select("event_type", F.explode("b").alias("b")).select("event_type", "b.le", "b.n")


def rates(events: DataFrame, width: str = "5 minutes", seconds: int = 300) -> DataFrame:
    """(window_start, event_type, n, per_second, mean_value) for each window with events."""
    grouped = events.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("s"))
    return grouped.select(F.col("w.start").alias("window_start"), "event_type", "n", F.round(F.col("n") / seconds, 6).alias("per_second"), F.round(F.col("s") / F.col("n"), 6).alias("mean_value"))


def quantiles(events: DataFrame, points: tuple[float, ...] = (0.5, 0.9, 0.99), exact: bool = False) -> DataFrame:
    """(event_type, p50, p90, p99 ...): approximate, in bounded memory for any number of rows; exact ones interpolate and keep
    a count for each distinct value of a type."""
    at = (lambda p: F.percentile("value", p)) if exact else (lambda p: F.percentile_approx("value", p, 10_000))
    return events.groupBy("event_type").agg(*[at(p).alias(f"p{round(p * 100)}") for p in points])


def sketches(events: DataFrame, width: str = "1 hour", precision: int = 14, k: int = 400) -> DataFrame:
    """(window_start, event_type, n, total, users_sketch, value_sketch): what can be stored for each window and added up later.

    users_sketch counts distinct user ids (HyperLogLog, 2^precision cells: about 1 % of error at 14); value_sketch holds quantiles (KLL of
    width k: about 0.7 % of rank error at 400).  Both stay of bounded size for any number of rows, and combine on the map side.
    """
    grouped = events.groupBy(F.window("ts", width)["start"].alias("window_start"), "event_type")
    return grouped.agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"), F.hll_sketch_agg("user_id", precision).alias("users_sketch"), F.kll_sketch_agg_double("value", k).alias("value_sketch"))


def merge_sketches(stored: DataFrame, by: list[Column]) -> DataFrame:
    """Stored sketches put together by other columns (a day, a type, nothing): the same as sketches of all their rows."""
    return stored.groupBy(*by).agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.hll_union_agg("users_sketch").alias("users_sketch"), F.kll_merge_agg_double("value_sketch").alias("value_sketch"))


def read_sketches(merged: DataFrame, points: tuple[float, ...] = (0.5, 0.9, 0.99)) -> DataFrame:
    """merged with users (distinct ids) and p50, p90, p99 ... in place of the sketches."""
    rest = [c for c in merged.columns if c not in ("users_sketch", "value_sketch")]
    return merged.select(*rest, F.hll_sketch_estimate("users_sketch").alias("users"), *[F.kll_sketch_get_quantile_double("value_sketch", F.lit(p)).alias(f"p{round(p * 100)}") for p in points])


def pipeline_totals(pages: DataFrame, records: DataFrame) -> DataFrame:
    """One row of a run's totals from its pages (section, failed) and records (section, is_accepted)."""
    fetched = pages.agg(F.count_if(~F.col("failed")).alias("pages_fetched"), F.count_if("failed").alias("failed_urls"), F.array_join(F.array_sort(F.collect_set("section")), ",").alias("sections"))
    made = records.agg(F.count(F.lit(1)).alias("records_extracted"), F.count_if(F.coalesce("is_accepted", F.lit(False))).alias("records_accepted"), F.count_if(~F.coalesce("is_accepted", F.lit(False))).alias("records_rejected"))
    return fetched.crossJoin(F.broadcast(made))
