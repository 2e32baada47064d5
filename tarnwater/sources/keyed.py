"""Keyed tables in a shared folder: upserts and deletes that rewrite the touched buckets alone and take effect all at once.

Rows lie in Parquet folders by a hash of their key.  A version is a small manifest that names the folder of each bucket.  A change
writes new folders for the buckets it touches, then the next manifest; readers see the old version until that file stands, and
a change that fails leaves nothing that anybody reads.  Two changes that start from one version cannot both take effect.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import stored


class Conflict(RuntimeError):
    """Somebody else has committed since the version that a change started from."""


@dataclass(frozen=True)
class Version:
    """number; schema and key of the rows; buckets: how many; folders: bucket to folder, of the buckets that hold rows."""

    number: int
    schema: str
    key: tuple[str, ...]
    buckets: int
    folders: dict[int, str]


class KeyedTable:
    """One row for each key under a path that the driver and all executors share."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        sc = spark.sparkContext
        self._path = sc._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(sc._jsc.hadoopConfiguration())

    # --- Versions ---

    def _manifest(self, number: int) -> str:
        return f"{self.path}/versions/{number:09d}.json"

    def versions(self) -> list[int]:
        """Numbers of the versions that can be read, oldest first."""
        place = self._path(f"{self.path}/versions")
        if not self._fs.exists(place):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(place)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and not n.startswith((".", "_")))

    def version(self, number: int | None = None) -> Version:
        """A version, the latest unless a number is given."""
        have = self.versions()
        if not have or (number is not None and number not in have):
            raise FileNotFoundError(f"{self.path} has no version {'' if number is None else number}")
        text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(self._fs.open(self._path(self._manifest(have[-1] if number is None else number))), "UTF-8")
        m = json.loads(text)
        return Version(m["number"], m["schema"], tuple(m["key"]), m["buckets"], {int(b): f for b, f in m["folders"].items()})

    def _commit(self, version: Version) -> None:
        """Make a version the next one: the whole file is written aside, and moves to its name unless that exists."""
        aside, final = self._path(f"{self.path}/aside/{uuid.uuid4().hex}.json"), self._path(self._manifest(version.number))
        out = self._fs.create(aside)
        out.write(bytearray(json.dumps({"number": version.number, "schema": version.schema, "key": version.key, "buckets": version.buckets, "folders": version.folders}).encode()))
        out.close()
        self._fs.mkdirs(final.getParent())
        if self._fs.exists(final) or not self._fs.rename(aside, final):
            self._fs.delete(aside, False)
            raise Conflict(f"version {version.number} of {self.path} was committed by somebody else")

    # --- Reading ---

    def read(self, number: int | None = None, buckets: list[int] | None = None) -> DataFrame:
        """All rows of a version (default: the latest), or those of some buckets."""
        v = self.version(number)
        return self._rows(v, sorted(v.folders) if buckets is None else buckets)

    def _rows(self, v: Version, buckets: list[int]) -> DataFrame:
        schema = T.StructType.fromJson(json.loads(v.schema))
        folders = [v.folders[b] for b in buckets if b in v.folders]
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{f}" for f in folders]) if folders else self.spark.createDataFrame([], schema)

    def find(self, keys: DataFrame) -> DataFrame:
        """The rows of some keys (their columns): only buckets that hold one of them are read."""
        v = self.version()
        wanted = stored(keys.select(*v.key).distinct(), "keys")
        rows = self._rows(v, self._touched(v, wanted))
        return rows.join(wanted.select(*[F.col(k).alias(f"__{k}") for k in v.key]), self._same(v, rows), "left_semi")

    # --- Changing ---

    def _bucket(self, v: Version) -> Column:
        return F.pmod(F.xxhash64(*v.key), F.lit(v.buckets)).cast("int")

    def _touched(self, v: Version, rows: DataFrame) -> list[int]:
        return sorted(r[0] for r in rows.select(self._bucket(v)).distinct().collect())  # v.buckets numbers at most

    def create(self, schema: T.StructType, key: str | list[str], buckets: int = 64) -> None:
        """Version 0, without rows."""
        key = [key] if isinstance(key, str) else list(key)
        if missing := [k for k in key if k not in schema.fieldNames()]:
            raise ValueError(f"no key column {missing}")
        self._commit(Version(0, schema.json(), tuple(key), buckets, {}))

    def _swap(self, v: Version, rows: DataFrame, touched: list[int]) -> int:
        """Write the new rows of the touched buckets, and commit; the next version's number."""
        if not touched:
            return v.number
        folder = f"rows/{v.number + 1:09d}-{uuid.uuid4().hex}"
        schema = T.StructType.fromJson(json.loads(v.schema))
        # a bucket is one key range of the hash: one task writes it, unless adaptive execution splits it
        parted = rows.select(*schema.fieldNames(), self._bucket(v).alias("__bucket"))
        parted.repartition(min(len(touched), max(1, int(self.spark.conf.get("spark.sql.shuffle.partitions")))), "__bucket").write.partitionBy("__bucket").parquet(f"{self.path}/{folder}")
        place = self._path(f"{self.path}/{folder}")
        held = {int(s.getPath().getName().split("=")[1]) for s in self._fs.listStatus(place) if s.isDirectory() and "=" in s.getPath().getName()}
        folders = {b: f for b, f in v.folders.items() if b not in touched} | {b: f"{folder}/__bucket={b}" for b in held}
        self._commit(Version(v.number + 1, v.schema, v.key, v.buckets, folders))
        return v.number + 1

    def upsert(self, rows: DataFrame, order: str | None = None, based_on: int | None = None) -> int:
        """Rows replace those of the same key; of several rows of one key in `rows`, the one with the largest order stays
        (without order, the largest row).  The new version's number.

        based_on: the version that the change was made from; it fails if there is a newer one.  A null key is a key like others.
        """
        v = self.version()
        if based_on is not None and based_on != v.number:
            raise Conflict(f"based on version {based_on}, the table has {v.number}")
        schema = T.StructType.fromJson(json.loads(v.schema))
        new = rows.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in schema], *([F.col(order).alias("__order")] if order else []))
        rank = [F.desc("__order")] if order else []
        rest = [F.desc(f"`{f.name}`") for f in schema if f.name not in v.key and not isinstance(f.dataType, (T.MapType, T.VariantType))]
        new = new.withColumn("__n", F.row_number().over(Window.partitionBy(*v.key).orderBy(*rank, *rest, *v.key))).filter("__n = 1").select(*schema.fieldNames())
        new = stored(new, "upsert")  # read three times, and it may come from this very table
        touched = self._touched(v, new)
        old = self._rows(v, touched)
        kept = old.join(new.select(*[F.col(k).alias(f"__{k}") for k in v.key]), self._same(v, old), "left_anti")
        return self._swap(v, kept.unionByName(new), touched)

    def _same(self, v: Version, old: DataFrame) -> Column:
        same = F.lit(True)
        for k in v.key:
            same = same & old[k].eqNullSafe(F.col(f"__{k}"))
        return same

    def delete(self, condition: Column, based_on: int | None = None) -> int:
        """Rows for which the condition holds go; buckets without such rows stay as they are.  The new version's number, or
        the old one's if there was none."""
        v = self.version()
        if based_on is not None and based_on != v.number:
            raise Conflict(f"based on version {based_on}, the table has {v.number}")
        gone = F.coalesce(condition, F.lit(False))
        touched = self._touched(v, self._rows(v, sorted(v.folders)).filter(gone))
        return self._swap(v, self._rows(v, touched).filter(~gone), touched)

    def drop(self, keys: DataFrame) -> int:
        """Rows of these keys (their columns) go; the new version's number, or the old one's if there was none."""
        v = self.version()
        wanted = stored(self.find(keys).select(*v.key), "drop")
        touched = self._touched(v, wanted)
        old = self._rows(v, touched)
        return self._swap(v, old.join(wanted.select(*[F.col(k).alias(f"__{k}") for k in v.key]), self._same(v, old), "left_anti"), touched)

    def vacuum(self, keep: int = 2) -> int:
        """Forget all but the newest `keep` versions and delete the folders that none of those names; how many there were.

        Not for use while changes run: their folders belong to no version yet.
        """
        numbers = self.versions()
        for n in numbers[: -max(1, keep)]:
            self._fs.delete(self._path(self._manifest(n)), False)
        named = {f.split("/__bucket=")[0] for n in self.versions() for f in self.version(n).folders.values()}
        place, gone = self._path(f"{self.path}/rows"), 0
        for s in self._fs.listStatus(place) if self._fs.exists(place) else []:
            if f"rows/{s.getPath().getName()}" not in named:
                gone += bool(self._fs.delete(s.getPath(), True))
        return gone
