"""Tables in the folder that a cluster's executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession, label: str) -> str:
    """A new folder under spark.checkpoint.dir; local sessions without the setting get a temporary folder of their own."""
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="tarnwater-"))
        base = sc.getCheckpointDir()
    elif sc.getCheckpointDir() is None:
        sc.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


#: Paths of tables written by each application, for `drop_stored`.
_WRITTEN: dict[str, list[str]] = {}


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage, survives lost executors, empty tables included."""
    path = shared_dir(df.sparkSession, label)
    df.write.parquet(path)
    _WRITTEN.setdefault(df.sparkSession.sparkContext.applicationId, []).append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_stored(spark: SparkSession) -> int:
    """Delete the tables that this application has stored, once no result is read from them any more; how many there were."""
    paths = _WRITTEN.pop(spark.sparkContext.applicationId, [])
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        place = jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(conf).delete(place, True)
    return len(paths)


def spread(df: DataFrame) -> DataFrame:
    """df over all cores, if it comes in fewer partitions than half of them (a small table in one file); else as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() * 2 < cores else df


def files_of(df: DataFrame) -> tuple[tuple[str, int, int], ...]:
    """Path, size and time of each file that df reads; a file that is gone counts with -1."""
    jvm, conf = df.sparkSession.sparkContext._jvm, df.sparkSession.sparkContext._jsc.hadoopConfiguration()
    found = []
    for name in sorted(df.inputFiles()):
        place = jvm.org.apache.hadoop.fs.Path(name)
        system = place.getFileSystem(conf)
        status = system.getFileStatus(place) if system.exists(place) else None
        found.append((name, status.getLen(), status.getModificationTime()) if status else (name, -1, -1))
    return tuple(found)


def few_rows(*columns, rows: int = 64) -> Iterator[tuple]:
    """An Arrow batch's columns a few rows at a time, so that a worker holds the Python objects of these alone."""
    for at in range(0, max(len(columns[0]), 1), rows):
        yield tuple(c.slice(at, rows) for c in columns)
