"""What the corpus operators share: shared folders, joins that survive hot keys, text streams."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.shared import shared_dir, stored

__all__ = ["ALNUM", "HOT_ROWS", "HOT_SHARE", "LOWER", "columns_of", "hot_join", "input_parts", "keep_documents", "over_batches", "partitions_at_least", "per_worker", "release_shuffles", "shared_dir", "stored", "text_column", "text_udf", "utf8", "whole_groups"]

#: A key is hot when it holds more than this share of all rows, so at most 1/HOT_SHARE keys are hot.
HOT_SHARE = 1 / 1024
#: Keys with fewer rows than this are never worth a path of their own.
HOT_ROWS = 1000


def release_shuffles(spark: SparkSession) -> None:
    """Let Spark's cleaner drop shuffle files of finished jobs before the next large exchange."""
    import gc
    import time

    for _ in range(2):  # the first pass frees the plans, the second what they held
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.3)


def text_column(docs: DataFrame, name: str = "text") -> F.Column:
    return F.coalesce(docs[name].cast("string"), F.lit(""))


def input_parts(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


@contextmanager
def partitions_at_least(spark: SparkSession, n: int) -> Iterator[None]:
    """Plans made inside have so many shuffle partitions at least; the session's own number is put back."""
    name = "spark.sql.shuffle.partitions"
    before = spark.conf.get(name)
    if n > int(before):
        spark.conf.set(name, n)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def hot_join(rows: DataFrame, table: DataFrame, keys: list[str], weight: str, how: str = "left") -> DataFrame:
    """Join rows with table (one row per key, weight = rows it will meet).

    Keys above HOT_SHARE of all rows are at most 1/HOT_SHARE, so they are broadcast; the others are
    joined by a shuffle.  Both inputs should be stored tables, since rows is read twice when a key is hot.
    """
    total = table.agg(F.sum(weight).alias("n")).first()["n"] or 0
    limit = max(HOT_ROWS, int(total * HOT_SHARE))
    hot = table.filter(F.col(weight) > limit)
    if not hot.head(1):
        return rows.join(table, keys, how)
    marked = rows.join(F.broadcast(hot.select(*keys).withColumn("__hot", F.lit(True))), keys, "left")
    warm = marked.filter(F.col("__hot").isNotNull()).drop("__hot").join(F.broadcast(hot), keys, "inner")
    cold = marked.filter(F.col("__hot").isNull()).drop("__hot").join(table.filter(F.col(weight) <= limit), keys, how)
    return warm.select(*cold.columns).unionByName(cold)


def keep_documents(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """Rows of docs whose (doc_id, text) is in kept (doc_id, text_key): one row for each, all columns of docs.

    text_key is xxhash64 of the text, so that rows that share a doc_id are told apart.  Of rows that repeat
    both, one stays.
    """
    from pyspark.sql import Window

    names = docs.columns
    keyed = docs.withColumn("__key", F.xxhash64(text_column(docs)))
    ids = kept.select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__k")).distinct()
    joined = keyed.join(ids, keyed["doc_id"].eqNullSafe(F.col("__id")) & (F.col("__key") == F.col("__k")), "left_semi")
    order = Window.partitionBy("doc_id", "__key").orderBy(*[F.col(f"`{c}`").asc_nulls_last() for c, t in docs.dtypes if c not in ("text",) and not t.startswith(("map", "variant"))])
    return joined.withColumn("__n", F.row_number().over(order)).filter("__n = 1").select(*[f"`{c}`" for c in names])


def columns_of(docs: DataFrame) -> DataFrame:
    """doc_id and text alone, so that extra columns, whatever their names, cannot clash."""
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))


def over_batches(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], Iterable[dict[str, list]]]], schema: T.StructType) -> DataFrame:
    """mapInArrow: make() runs once per task and returns a function from a batch to column lists."""
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in batches:
            if batch.num_rows:
                for out in step(batch):
                    yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) if not isinstance(out[f.name], (pa.Array, pa.ChunkedArray)) else out[f.name] for f in arrow], schema=arrow)

    return df.mapInArrow(run, schema)


def text_udf(make: Callable[[], Callable[[bytes | None], object]], returns: T.DataType) -> Callable:
    """A column function of one string column, row by row in Arrow batches; make() runs once per task."""
    from pyspark.sql.pandas.types import to_arrow_type

    arrow = to_arrow_type(returns)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        step = make()
        for column in batches:
            yield pa.array([step(t) for t in utf8(column)], arrow)

    return F.arrow_udf(run, returns)


def utf8(column: pa.Array) -> list[bytes | None]:
    """The UTF-8 bytes of a string column."""
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def whole_groups(batches: Iterator[pa.RecordBatch], keys: int, rows: int = 1 << 17) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(starts, ends, columns) of runs of whole groups, from batches of whole numbers sorted by their first columns, the keys.

    A group is never cut.  Rows of a long group are held as they come and put together once.
    """
    held: list[np.ndarray] = []
    total = safe = 0

    def cut_points(part: np.ndarray) -> np.ndarray:
        return np.flatnonzero((part[:keys, 1:] != part[:keys, :-1]).any(axis=0)) + 1

    def split(part: np.ndarray):
        cut = cut_points(part)
        return np.concatenate(([0], cut)), np.concatenate((cut, [part.shape[1]])), part

    for batch in batches:
        if not batch.num_rows:
            continue
        part = np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns])
        cut = cut_points(part)
        if len(cut):
            safe = total + int(cut[-1])
        elif held and (held[-1][:keys, -1] != part[:keys, 0]).any():
            safe = total
        held.append(part)
        total += part.shape[1]
        if safe >= rows:
            every = np.concatenate(held, axis=1)
            yield split(every[:, :safe])
            held, total, safe = [every[:, safe:]], total - safe, 0
    if held:
        yield split(np.concatenate(held, axis=1))


def per_worker(key: str, build: Callable[[], object]) -> object:
    """Build once in each Python worker process and keep it for later tasks of the same session."""
    import sys
    import types as _types

    store = sys.modules.setdefault("_tarnwater_worker_cache", _types.ModuleType("_tarnwater_worker_cache")).__dict__
    kept = store.setdefault("entries", {})
    if key not in kept:
        while len(kept) > 3:
            kept.pop(next(iter(kept)))
        kept[key] = build()
    return kept[key]


#: A-Z to a-z, every other byte unchanged.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: A-Z to a-z; of ASCII only letters and digits stay, the rest turns into spaces.
ALNUM = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
