"""Dense retrieval: cosine top-k of query vectors against a corpus of vectors."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import uuid5
from ..sources.shared import stored

#: Query vectors of one pass at most; more take several passes.
MOST_QUERIES = 20_000
#: Vectors scored at once, pairs scored exactly at once, and by how much a score of a matrix product may differ from the exact one.
ROWS, PAIRS, SLACK = 256, 1 << 17, 1e-9


def unit(v: Column) -> Column:
    """The vector in double precision at length one; null for null, empty or zero vectors."""
    d = v.cast("array<double>")
    norm = F.sqrt(F.aggregate(d, F.lit(0.0), lambda a, x: a + x * x))
    return F.when((F.size(d) > 0) & (norm > 0), F.transform(d, lambda x: x / norm))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def build_index(vectors: DataFrame, vid: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(doc, unit, point_id): unit vectors, and a stable version-5 id to upsert by."""
    return vectors.select(F.col(vid).alias("doc"), unit(F.col(vector)).alias("unit"), uuid5(F.col(vid).cast("string")).alias("point_id"))


def search(index: DataFrame, queries: DataFrame, k: int = 10, vector: str = "embedding", within: DataFrame | None = None) -> DataFrame:
    """(qid, doc, score, rank): the k nearest of all vectors for each query; ties by doc.

    A given set of queries is held against every vector once: each task keeps its own best k for each query before the
    shuffle (`near`), and their exact scores decide.  within: (doc, group), with a column group in queries: a
    query is held to the documents of its group, or to none if its group is null.
    """
    held = ["qid", unit(F.col(vector)).alias("q"), *(["group"] if within is not None else [])]
    ask = stored(queries.select(*held).filter("q IS NOT NULL"), "query-vectors")
    rows = index.filter("unit IS NOT NULL").select("doc", "unit")
    if within is not None:
        rows = rows.join(within.select("doc", F.col("group").alias("own")).distinct(), "doc", "left")
    asked = ask.count()
    parts = max(1, -(-asked // MOST_QUERIES))
    found = [near(rows, ask if parts == 1 else ask.filter(F.pmod(F.xxhash64("qid"), F.lit(parts)) == i), k, within is not None) for i in range(parts)]
    scored = reduce(DataFrame.unionByName, found)
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "doc"))
    return scored.withColumn("rank", rank).filter(F.col("rank") <= k)


def near(rows: DataFrame, ask: DataFrame, k: int, grouped: bool) -> DataFrame:
    """(qid, doc, score): of a task's vectors the k nearest of each query, ties by doc.

    Matrix products find the pairs that may be among them, within SLACK; their exact scores, summed in the order of `dot`, decide.  No
    pair beyond these is sorted or shuffled.
    """
    schema = T.StructType([T.StructField("qid", ask.schema["qid"].dataType), T.StructField("doc", rows.schema["doc"].dataType), T.StructField("score", T.DoubleType())])
    held = ask.toArrow()  # MOST_QUERIES at most, as a broadcast would bring them

    def cut(found: pa.Table) -> pa.Table:
        found = found.take(pc.sort_indices(found, sort_keys=[("number", "ascending"), ("score", "descending"), ("doc", "ascending")], null_placement="at_start"))
        number = found.column(0).to_numpy()
        first = np.flatnonzero(np.diff(number, prepend=-1))
        return found.filter(pa.array(np.arange(len(number)) - np.repeat(first, np.diff(np.append(first, len(number)))) < k))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = pc.list_value_length(held.column(1)).to_numpy()
        sides = [(d, np.flatnonzero(size == d), held.column(1).filter(pa.array(size == d)).combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, d)) for d in np.unique(size).tolist()]
        own = np.array(held.column(2).to_pylist(), object) if grouped else None
        low, kept = np.full(held.num_rows, -np.inf), None
        for whole in batches:
            for batch in (whole.slice(i, ROWS) for i in range(0, whole.num_rows, ROWS)):
                length = pc.list_value_length(batch.column(1)).to_numpy()
                for d, numbers, matrix in sides:
                    mine = batch.filter(pa.array(length == d))
                    if not mine.num_rows:
                        continue
                    units = mine.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
                    score = units @ matrix.T
                    if grouped:
                        there = np.array(mine.column(2).to_pylist(), object)
                        score[~((own[numbers] == None)[None, :] | (there[:, None] == own[numbers][None, :]))] = -np.inf  # noqa: E711
                    floor = low[numbers]
                    if len(score) > k:
                        floor = np.maximum(floor, np.partition(score, len(score) - k, axis=0)[len(score) - k])
                    i, j = np.nonzero((score >= floor - SLACK) & (score > -np.inf))
                    for at in range(0, len(i), PAIRS):
                        a, b = i[at : at + PAIRS], j[at : at + PAIRS]
                        exact = np.cumsum(units[a] * matrix[b], axis=1)[:, -1]
                        new = pa.table({"number": numbers[b], "score": exact, "doc": mine.column(0).take(pa.array(a))})
                        kept = cut(new if kept is None else pa.concat_tables([kept, new]))
                    if len(i):
                        number = kept.column(0).to_numpy()
                        full = np.flatnonzero(np.bincount(number, minlength=len(low)) == k)
                        low[full] = kept.column(1).to_numpy()[np.searchsorted(number, full, "right") - 1]
        if kept is not None:
            out = pa.table([held.column(0).take(kept.column("number")), kept.column("doc"), kept.column("score")], names=schema.names)
            yield from out.combine_chunks().to_batches()

    return rows.mapInArrow(run, schema)


def embed(rows: DataFrame, provider: Callable[[list[str]], list[list[float]]], text: str = "index_text", key: str = "chunk_id", batch: int = 16) -> DataFrame:
    """(doc, embedding): vectors of texts from a provider, which workers call with batches of texts.

    The provider is built where it is called (pass a function that connects lazily); a batch that fails is tried text by
    text, and a text that still fails gets null, so one bad row costs no others.
    """
    schema = T.StructType([T.StructField("doc", rows.schema[key].dataType), T.StructField("embedding", T.ArrayType(T.FloatType()))])

    def one(s: str) -> list[float] | None:
        try:
            return provider([s])[0]
        except Exception:
            return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            texts, out = [s or "" for s in part.column(1).to_pylist()], []
            for i in range(0, len(texts), batch):
                try:
                    out += provider(texts[i : i + batch])
                except Exception:
                    out += [one(s) for s in texts[i : i + batch]]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(out, pa.list_(pa.float32()))], names=["doc", "embedding"])

    return rows.select(key, text).mapInArrow(run, schema)


def same_dimension(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """Dimensions in use and their counts: an index is sound if this has one row."""
    return vectors.groupBy(F.size(vector).alias("dimension")).agg(F.count(F.lit(1)).alias("n"))


def upsert(stored: DataFrame, new: DataFrame, key: str = "point_id") -> DataFrame:
    """new replaces stored rows of the same key; of repeated keys in new one row stays."""
    fresh = new.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy("doc"))).filter("__n = 1").drop("__n")
    return stored.join(fresh.select(key), key, "left_anti").unionByName(fresh)


def missing(new: DataFrame, stored: DataFrame, key: str = "point_id") -> DataFrame:
    """Rows of new whose key is not stored yet: what a resumed job still has to do."""
    return new.join(stored.select(key), key, "left_anti")


def delete_session(stored: DataFrame, session: str) -> DataFrame:
    """All but the uploads of a session."""
    return stored.filter(~((F.col("source_type") == "user_upload") & F.col("upload_session_id").eqNullSafe(F.lit(session))))
