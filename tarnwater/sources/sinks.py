"""Sinks: JSON lines, CSV reports, manifests, index tables, keyed upserts, event logs, resets."""

from __future__ import annotations

from typing import TYPE_CHECKING

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import spread

if TYPE_CHECKING:
    from ..operators.sparse import SparseIndex


def jsonl(df: DataFrame, path: str, sort_keys: bool = True, gzip: bool = False, mode: str = "overwrite") -> None:
    """One JSON object a line, keys in order of name or of columns; non-ASCII text as it is."""
    out = df.select(*sorted(df.columns)) if sort_keys else df
    out.write.mode(mode).option("ignoreNullFields", "false").option("compression", "gzip" if gzip else "none").json(path)


def csv_report(df: DataFrame, path: str, separator: str = ";", mode: str = "overwrite") -> None:
    """A CSV with header; arrays joined by the separator."""
    kinds = dict(df.dtypes)
    df.select(*[(F.array_join(c, separator) if kinds[c].startswith("array") else F.col(c)).alias(c) for c in df.columns]).write.mode(mode).option("header", True).csv(path)


def manifest(df: DataFrame, path: str) -> None:
    """A one-row table as JSON."""
    df.limit(1).coalesce(1).write.mode("overwrite").json(path)


def table(df: DataFrame, path: str, *partition_by: str, mode: str = "overwrite") -> None:
    writer = df.write.mode(mode)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def sparse_index(index: SparseIndex, path: str) -> None:
    """An index' four tables under one folder."""
    for name in ("bags", "docs", "terms", "totals"):
        table(getattr(index, name), f"{path}/{name}")


def load_sparse_index(spark: SparkSession, path: str) -> SparseIndex:
    from ..operators.sparse import SparseIndex

    return SparseIndex(*[spark.read.parquet(f"{path}/{name}") for name in ("bags", "docs", "terms", "totals")])


def events(df: DataFrame, path: str) -> None:
    """Append to the log, a folder for each event type."""
    table(df, path, "event_type", mode="append")


def drop(spark: SparkSession, path: str) -> bool:
    """Delete a folder of any file system; whether there was one."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def clear_session(spark: SparkSession, root: str, session: str) -> bool:
    """Drop one session's partition folder."""
    return drop(spark, f"{root}/upload_session_id={session}")


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, sha256) of every file below a folder: a bundle's manifest."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "length", F.sha2("content", 256).alias("sha256"))


def damaged(spark: SparkSession, path: str, promised: DataFrame) -> DataFrame:
    """(path, fault) of files below a folder that differ from a bundle's checksums (path relative to it, length, sha256): missing, changed or extra."""
    now = relative(checksums(spark, path), path)
    both = promised.select("path", F.col("sha256").alias("was")).join(now.select("path", F.col("sha256").alias("is")), "path", "full")
    fault = F.when(F.col("is").isNull(), "missing").when(F.col("was").isNull(), "extra").when(F.col("is") != F.col("was"), "changed")
    return both.select("path", fault.alias("fault")).filter("fault IS NOT NULL")


def relative(files: DataFrame, root: str) -> DataFrame:
    """files with paths from the root on, so that a bundle may lie elsewhere."""
    start = root.rstrip("/").split("://")[-1].removeprefix("file:") + "/"
    return files.withColumn("path", F.substring_index("path", start, -1))


def export_bundle(spark: SparkSession, root: str, bundle: str) -> DataFrame:
    """Copy a folder to a new one with the checksums of all its files beside it; the checksums."""
    copy(spark, root, f"{bundle}/content")
    held = relative(checksums(spark, f"{bundle}/content"), f"{bundle}/content")
    table(held.coalesce(1), f"{bundle}/checksums")
    return spark.read.parquet(f"{bundle}/checksums")


def restore_bundle(spark: SparkSession, bundle: str, root: str) -> None:
    """Put a bundle's files in place of a folder, if all of them are as promised; else ValueError, and the folder stays as it was."""
    faults = damaged(spark, f"{bundle}/content", spark.read.parquet(f"{bundle}/checksums")).limit(5).collect()
    if faults:
        raise ValueError(f"the bundle is damaged: {', '.join(f'{r.path} {r.fault}' for r in faults)}")
    drop(spark, root)
    copy(spark, f"{bundle}/content", root)


def copy(spark: SparkSession, source: str, target: str) -> None:
    """Copy a folder between any two file systems."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    a, b = jvm.org.apache.hadoop.fs.Path(source), jvm.org.apache.hadoop.fs.Path(target)
    jvm.org.apache.hadoop.fs.FileUtil.copy(a.getFileSystem(conf), a, b.getFileSystem(conf), b, False, True, conf)


def text_files(rows: DataFrame, folder: str, name: str = "name", body: str = "value", tag: str = "") -> None:
    """Each row as a file of its own, `<name>.<task>-<place>-<tag>.txt` in a folder for each task; a line end follows the body.

    Tasks write side by side and at once to their final places, without a commit in the driver for each file: a task that runs again
    writes the same files.  A store that pyarrow does not know is written by Spark, in a folder `<name>` for each row's file.
    """
    import pyarrow as pa
    from pyarrow import fs

    uri = folder if "://" in folder or folder.startswith("file:") else f"file://{folder}"
    try:
        fs.FileSystem.from_uri(uri)
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError):
        named = rows.select(F.col(body).alias("value"), F.regexp_extract(name, "=(.*)$", 1).alias("__id"), F.regexp_extract(name, "^[^=]*", 0).alias("__kind"))
        for kind in [r[0] for r in named.select("__kind").distinct().collect()]:
            named.filter(F.col("__kind") == kind).select("value", F.col("__id").alias(kind)).write.mode("append").partitionBy(kind).option("compression", "none").format("text").save(folder)
        return

    def run(batches):
        from pyspark import TaskContext

        where, path = fs.FileSystem.from_uri(uri)
        task, at = TaskContext.get().partitionId(), 0
        where.create_dir(f"{path}/{task}", recursive=True)
        for batch in batches:
            for own, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with where.open_output_stream(f"{path}/{task}/{own}.{task}-{at}-{tag}.txt", compression=None) as out:
                    out.write((text or "").encode() + b"\n")
                at += 1
        yield pa.RecordBatch.from_arrays([pa.array([at], pa.int64())], names=["n"])

    spread(rows.select(name, body)).mapInArrow(run, "n long").agg(F.sum("n")).collect()
