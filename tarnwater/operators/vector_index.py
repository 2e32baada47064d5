"""An inverted-file vector index: vectors stored by trained cell, searched in few cells, scored exactly.

Cells are trained by k-means on the sphere, on a bounded sample; every vector is indexed.  A shelf is a folder of neighbouring
cells, so that a search reads only the shelves that it probes (a partition filter of the scan), and within their files the cells
are sorted.  A cell knows its reach, the widest angle between its centre and a vector of it.  So a search can also be exact: after
the nearest cells, the further ones are read whose reach could still hold a better vector than the k-th found.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.shared import stored

#: Vectors that cells are trained on at most, taken by a hash of their id.
SAMPLE_ROWS = 200_000
#: Cells at most, and bytes that their centres may have: what is broadcast.
MOST_CELLS, CENTRE_BYTES = 65_536, 64 << 20
#: Folders of cells at most, and vectors of a file.
SHELVES, FILE_ROWS = 512, 1_000_000
#: Queries of one search at most, and bytes of their vectors or of their angles to all centres: what is broadcast.
MOST_QUERIES, QUERY_BYTES = 20_000, 256 << 20
#: Cells up to which a scan is told their numbers, to pass over row groups; more are passed over in the task.
NAMED_CELLS = 1000


@dataclass
class VectorIndex:
    """vectors: shelf, cell, doc, vector (array<float>), norm.  centres: one row for each cell, of length one; reach: angles."""

    vectors: DataFrame
    centres: np.ndarray
    reach: np.ndarray
    shelf: np.ndarray


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """The rows of a list column without nulls, all of one width."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


def usable(vectors: DataFrame, vid: str, vector: str) -> tuple[DataFrame, int]:
    """(doc, vector, norm) of vectors that have a direction, and their width; null, empty and zero vectors have none."""
    v = F.col(vector).cast("array<float>")
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x))
    rows = vectors.select(F.col(vid).alias("doc"), v.alias("vector"), norm.alias("norm")).filter("norm > 0")
    widths = [r[0] for r in rows.select(F.size("vector")).distinct().limit(3).collect()]
    if len(widths) > 1:
        raise ValueError(f"vectors of several widths: {sorted(widths)}")
    return rows, widths[0] if widths else 0


def train(rows: DataFrame, width: int, cells: int | None = None, seed: int = 1, rounds: int = 8) -> np.ndarray:
    """Centres of length one, about one for each square root of the number of vectors unless cells says how many."""
    n = rows.count()
    cells = max(1, min(cells or math.isqrt(n), MOST_CELLS, CENTRE_BYTES // (8 * max(width, 1)), SAMPLE_ROWS // 4))
    share = F.pmod(F.xxhash64("doc"), F.lit(1 << 30)) < int(min(1.0, SAMPLE_ROWS / max(n, 1)) * (1 << 30))
    sample = rows.filter(share).select(array_to_vector(F.transform("vector", lambda x: x.cast("double"))).alias("features"))
    if cells == 1 or not n:
        return np.eye(1, max(width, 1))
    found = np.array(KMeans(k=cells, seed=seed, maxIter=rounds, distanceMeasure="cosine", initSteps=1).fit(sample).clusterCenters())
    return found / np.linalg.norm(found, axis=1, keepdims=True)


def placed(rows: DataFrame, centres: np.ndarray) -> DataFrame:
    """rows with their nearest cell and the angle to its centre."""
    shared = rows.sparkSession.sparkContext.broadcast(centres)
    schema = T.StructType([*rows.schema.fields, T.StructField("cell", T.IntegerType()), T.StructField("angle", T.DoubleType())])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                near = matrix(batch.column(1), shared.value.shape[1]) @ shared.value.T / batch.column(2).to_numpy()[:, None]
                cell = near.argmax(axis=1)
                angle = np.arccos(np.clip(near[np.arange(len(cell)), cell], -1, 1))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32)), pa.array(angle)], [f.name for f in schema])

    return rows.mapInArrow(place, schema)


def build(vectors: DataFrame, path: str, vid: str = "vec_id", vector: str = "embedding", cells: int | None = None, seed: int = 1) -> VectorIndex:
    """Train, place and store all vectors under path, and open the index.

    A cell or shelf of any share of the vectors is written by as many tasks as it has files of FILE_ROWS vectors.
    """
    spark = vectors.sparkSession
    rows, width = usable(vectors, vid, vector)
    centres = train(rows, width, cells, seed)
    inside = stored(placed(rows, centres), "vector-cells") if width else rows.withColumns({"cell": F.lit(0), "angle": F.lit(0.0)})
    shelves = min(SHELVES, len(centres))
    shelf = (F.col("cell") * shelves / len(centres)).cast("int")
    inside = inside.withColumn("shelf", shelf)
    held = {r.cell: (r.n, r.reach) for r in inside.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("angle").alias("reach")).collect()}
    files = inside.groupBy("shelf").agg(F.ceil(F.count(F.lit(1)) / FILE_ROWS).cast("int").alias("files"))  # a row for each shelf
    dealt = inside.join(F.broadcast(files), "shelf").withColumn("file", F.pmod(F.xxhash64("doc"), F.col("files")).cast("int"))
    dealt.repartition("shelf", "file").sortWithinPartitions("shelf", "cell").select("shelf", "cell", "doc", "vector", "norm").write.partitionBy("shelf").parquet(f"{path}/vectors")
    about = [(c, c * shelves // len(centres), *held.get(c, (0, 0.0)), [float(x) for x in centre]) for c, centre in enumerate(centres)]
    spark.createDataFrame(about, "cell int, shelf int, n long, reach double, centre array<double>").coalesce(1).write.parquet(f"{path}/cells")
    return open_index(spark, path, rows.schema["doc"].dataType)


def open_index(spark: SparkSession, path: str, doc: T.DataType | None = None) -> VectorIndex:
    """An index that `build` has stored; doc is the id's type, for an index that may hold no vector."""
    about = spark.read.parquet(f"{path}/cells").orderBy("cell").collect()
    schema = T.StructType([T.StructField("cell", T.IntegerType()), T.StructField("doc", doc or T.LongType()),
        T.StructField("vector", T.ArrayType(T.FloatType())), T.StructField("norm", T.DoubleType()), T.StructField("shelf", T.IntegerType())])
    vectors = spark.read.schema(schema).parquet(f"{path}/vectors") if doc is not None else spark.read.parquet(f"{path}/vectors")
    return VectorIndex(vectors, np.array([r.centre for r in about]), np.array([r.reach for r in about]), np.array([r.shelf for r in about]))


def probed(index: VectorIndex, units: np.ndarray, wanted: np.ndarray, least: np.ndarray, k: int) -> DataFrame:
    """(query, doc, score): for each query (a row of units), at least its k best in the wanted cells (queries x cells) with a score of least or more.

    Only shelves with a wanted cell are scanned.  A task multiplies the vectors of a cell with the queries that want it and
    passes on what reaches its own k-th best so far, so no pair of a query and a vector becomes a row before.
    """
    cells = np.flatnonzero(wanted.any(axis=0))
    rows = index.vectors.filter(F.col("shelf").isin(sorted(set(index.shelf[cells].tolist()))))
    if len(cells) <= NAMED_CELLS:
        rows = rows.filter(F.col("cell").isin(cells.tolist()))
    shared = rows.sparkSession.sparkContext.broadcast((units, wanted, least))
    schema = T.StructType([T.StructField("query", T.IntegerType()), rows.schema["doc"], T.StructField("score", T.DoubleType())])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, wants, floor = shared.value
        floor = floor.copy()
        for batch in batches:
            cell = batch.column(0).to_numpy()
            order = np.argsort(cell, kind="stable")
            cuts = np.concatenate(([0], np.flatnonzero(np.diff(cell[order])) + 1, [len(order)])) if len(order) else np.zeros(1, np.int64)
            own = matrix(batch.column(2), asked.shape[1])
            norm = batch.column(3).to_numpy()
            found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            for a, b in zip(cuts[:-1], cuts[1:]):
                at = order[a:b]
                q = np.flatnonzero(wants[:, cell[at[0]]])
                if not len(q):
                    continue
                close = own[at] @ asked[q].T / norm[at, None]
                if len(at) > k:  # the k-th best of this cell is a bound for what is worth passing on
                    np.maximum.at(floor, q, np.partition(close, len(at) - k, axis=0)[len(at) - k] - 1e-12)
                r, c = np.nonzero(close >= floor[q])
                found.append((q[c], at[r], close[r, c]))
            if found:
                q, r, s = (np.concatenate(x) for x in zip(*found))
                keep = s >= floor[q]
                yield pa.RecordBatch.from_arrays([pa.array(q[keep].astype(np.int32)), batch.column(1).take(pa.array(r[keep])), pa.array(s[keep])], ["query", "doc", "score"])

    return rows.select("cell", "doc", "vector", "norm").mapInArrow(score, schema)


def best(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "doc"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


def search(index: VectorIndex, queries: DataFrame, k: int = 10, probes: int | None = None, exact: bool = False, vector: str = "embedding") -> DataFrame:
    """(qid, doc, score, rank): the k nearest vectors by cosine for each query (qid, vector); ties by doc.

    probes: cells read for each query, the nearest ones (default: an eighth of them, and four at least).  With exact, further
    cells follow until none can hold a better vector, so the result is that of a scan of all vectors.  Queries without a direction
    return nothing.
    """
    ask, width = usable(queries, "qid", vector)
    if width and index.centres.shape[1] != width:
        if index.vectors.head(1):
            raise ValueError(f"queries have {width} numbers, the index {index.centres.shape[1]}")
        return index.vectors.select(F.lit(None).cast(ask.schema["doc"].dataType).alias("qid"), "doc", F.lit(0.0).alias("score"), F.lit(0).alias("rank")).limit(0)
    if ask.limit(MOST_QUERIES + 1).count() > min(MOST_QUERIES, QUERY_BYTES // (8 * max(width, len(index.centres)))):
        raise ValueError("too many queries for one search: search in batches")
    rows = ask.collect()
    ids = ask.sparkSession.createDataFrame([(i, r.doc) for i, r in enumerate(rows)], T.StructType([T.StructField("query", T.IntegerType()), T.StructField("qid", ask.schema["doc"].dataType)]))
    units = np.array([r.vector for r in rows], np.float64).reshape(len(rows), -1) / np.array([r.norm for r in rows]).reshape(-1, 1) if rows else np.zeros((0, index.centres.shape[1]))
    near = np.clip(units @ index.centres.T, -1, 1) if rows else np.zeros((0, len(index.centres)))
    cells = near.shape[1]
    probes = min(cells, probes or max(4, cells // 8))
    wanted = np.zeros(near.shape, bool)
    if rows:
        np.put_along_axis(wanted, np.argpartition(-near, probes - 1, axis=1)[:, :probes], True, axis=1)
    first = stored(best(probed(index, units, wanted, np.full(len(units), -2.0), k), k), "vector-found")
    if exact and rows:
        least = np.full(len(units), -2.0)
        for r in first.filter(F.col("rank") == k).select("query", "score").collect():
            least[r.query] = r.score
        most = np.cos(np.maximum(0.0, np.arccos(near) - index.reach[None, :]))
        further = ~wanted & (most >= least[:, None] - 1e-9)
        if further.any():
            first = best(first.drop("rank").unionByName(probed(index, units, further, least - 1e-12, k)), k)
    return first.join(F.broadcast(ids), "query").select("qid", "doc", "score", "rank")
