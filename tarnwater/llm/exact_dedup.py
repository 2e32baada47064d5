"""Exact dedup by an extendible-hash index on shared files, in DataFrame operations alone.

A key is a 64-bit hash of the whole text.  The directory maps the key's first bits to buckets: it starts
with one bucket and doubles while a bucket's distinct bytes exceed its capacity, splitting only overfull
buckets.  Buckets are key ranges.  Texts are compared byte by byte as they are grouped by bucket, hash and text itself: equal ones
meet on the map side first, so that copies do not travel, and a hot text is one row a task.  What is left, one short entry
for each distinct text, goes to the task that owns its bucket; it chains different texts of equal hash and writes the whole bucket
into one file.  Index and directory are Parquet in the shared folder; a lost executor only costs the tasks it ran.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import hot_join, input_parts, keep_documents, partitions_at_least, stored, text_column

#: Directory entries are at most 2**MAX_DEPTH, whatever the input; this bounds what is broadcast (and the prefixes, twice as many).
#: Beyond 32 TB of distinct text buckets exceed BUCKET_BYTES; an owner then still handles entries of some 60 bytes a text.
MAX_DEPTH = 20
#: Doublings that are allowed beyond those that evenly spread keys would need.
SLACK_DEPTH = 4
#: Distinct text bytes a bucket may hold before it is split.
BUCKET_BYTES = 32 << 20


def depth_for(total: int, capacity: int) -> int:
    """The most doublings of a directory for so many distinct bytes."""
    return min(MAX_DEPTH, SLACK_DEPTH + max(0, math.ceil(math.log2(max(1.0, total / capacity)))))


def directory(keys: DataFrame, capacity: int = BUCKET_BYTES, max_depth: int = MAX_DEPTH) -> DataFrame:
    """(slot, depth, bucket) for each used slot of max_depth bits, from keys (h, bytes).

    A slot's bucket is its shortest prefix whose load fits the capacity; at max_depth it stays overfull.  Loads are summed
    on the map side; the prefixes that fit are at most twice the slots, and are broadcast.
    """
    slots = keys.groupBy(F.shiftrightunsigned("h", 64 - max_depth).alias("slot")).agg(F.sum("bytes").alias("load"))
    levels = slots.withColumn("depth", F.explode(F.sequence(F.lit(0), F.lit(max_depth)))).withColumn("prefix", F.expr(f"shiftright(slot, {max_depth} - depth)"))
    fits = levels.groupBy("depth", "prefix").agg(F.sum("load").alias("load")).filter((F.col("load") <= capacity) | (F.col("depth") == max_depth)).select("depth", "prefix")
    local = levels.join(F.broadcast(fits), ["depth", "prefix"]).groupBy("slot").agg(F.min("depth").alias("depth"))
    return local.withColumn("bucket", F.expr(f"shiftleft(1L, depth) + shiftright(slot, {max_depth} - depth)"))


def build_index(docs: DataFrame, key: Callable[[Column], Column] = F.xxhash64, capacity: int = BUCKET_BYTES) -> tuple[DataFrame, DataFrame]:
    """(rows, index): rows are (doc_id, h, sha, bytes), one per document; index is one row per distinct text:
    bucket, h, chain (place among texts of equal hash), sha, n, keep_id (largest doc_id, null if all are null)."""
    text = text_column(docs)
    docs = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text.alias("text")).withColumn("h", key(F.col("text")).cast("long"))
    rows = stored(docs.select("doc_id", "h", F.unhex(F.sha2("text", 256)).alias("sha"), F.octet_length("text").cast("long").alias("bytes")), "exact-rows")
    keys = stored(rows.groupBy("h").agg(F.max("bytes").alias("bytes")), "exact-keys")
    total = keys.agg(F.sum("bytes")).first()[0] or 0
    depth = depth_for(total, capacity)
    slots = stored(directory(keys, capacity, depth), "exact-directory")
    routed = docs.withColumn("slot", F.shiftrightunsigned("h", 64 - depth)).join(F.broadcast(slots.select("slot", "bucket")), "slot")
    owned = routed.groupBy("bucket", "h", "text").agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("keep_id"))
    entries = owned.select("bucket", "h", F.unhex(F.sha2("text", 256)).alias("sha"), "n", "keep_id")
    parts = max(math.ceil(total / capacity), input_parts(docs.sparkSession))
    with partitions_at_least(docs.sparkSession, parts):
        owners = entries.repartition(parts, "bucket")
        chained = owners.withColumn("chain", F.row_number().over(Window.partitionBy("bucket", "h").orderBy("sha")) - 1)
        return rows, stored(chained.select("bucket", "h", "chain", "sha", "n", "keep_id"), "exact-index")


def exact_dedup(docs: DataFrame, key: Callable[[Column], Column] = F.xxhash64, capacity: int = BUCKET_BYTES) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Null text counts as empty; a null doc_id is smaller than any other.  Rows that repeat both text and the
    winning doc_id are all kept here (they are one document); `drop_copies` leaves one of them.  Empty
    tables give no rows; other columns are not read.
    """
    rows, index = build_index(docs, key, capacity)
    found = hot_join(rows, index.select("h", "sha", "n", "keep_id"), ["h", "sha"], "n", "inner")
    return found.select("doc_id", "keep_id", F.col("n").cast("long").alias("group_size"), F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"), F.col("h").alias("text_key"))


def drop_copies(docs: DataFrame, capacity: int = BUCKET_BYTES) -> DataFrame:
    """docs without exact copies: all its columns, one row for each distinct text."""
    return keep_documents(docs, exact_dedup(docs, capacity=capacity).filter("kept").select("doc_id", "text_key"))
