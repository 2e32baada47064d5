"""The question path: route, retrieve from both sides, fuse, boost, rerank, cut, answer."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lexicon import BOTH_SIDE, CATEGORY_TERMS
from ..operators import dense, fusion, routing, sparse
from ..operators.answers import answer
from ..sources.shared import stored

MOST = 50


@dataclass
class Corpus:
    """chunks: chunk_id, title, content, index_text, citation_url, category, record_type, language, source_type, metadata.
    sparse: their BM25 index (doc = chunk_id).  vectors: their unit vectors (doc = chunk_id), if there are any."""

    chunks: DataFrame
    sparse: sparse.SparseIndex
    vectors: DataFrame | None = None


def retrieve(queries: DataFrame, corpus: Corpus, query_vectors: DataFrame | None = None, filters: dict[str, object] | None = None,
    scorer: Callable[[Column, Column], Column] | None = None, mode: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(routed, ranked): all queries with their route; the final rows of those that are to be answered.

    Rejected and ambiguous queries leave before any index is read.  Official and upload queries search their own side;
    queries to both search each side for a few rows and fuse the lists.  mode names the column that says which;
    without it all are official, and the corpus is taken as one side.
    """
    routed = routing.route(queries, mode=mode)
    ask = routed.filter("route = 'retrieval'")
    chunks = routing.metadata_filter(corpus.chunks, filters or {})
    if mode is None:
        lists = _by_category(ask, corpus, chunks, bool(filters), query_vectors)
    else:
        lists = []
        for side, kind in (("official", "official_website"), ("uploads", "user_upload")):
            own = ask.filter(F.col("source_mode").isin(side, "both")).withColumns({c: F.when(F.col("source_mode") == "both", BOTH_SIDE).otherwise(F.col(c)) for c in ("bm25_top_k", "dense_top_k")})
            lists += _side(own, corpus, chunks.filter(F.col("source_type") == kind), query_vectors, f"{side}_")
    # Lists are at most 50 rows a query; stored once, they meet the chunks' texts only as survivors.
    fused = stored(fusion.fuse(lists), "fused").join(corpus.chunks.withColumnRenamed("chunk_id", "doc"), "doc").withColumn("chunk_id", F.col("doc")).join(ask.select("qid", "query", "rerank_top_k", "final_top_k"), "qid")
    boosted = fusion.boost(fused).filter(F.col("rank") <= F.col("rerank_top_k"))
    ranked = fusion.rerank(boosted, None, scorer).filter(F.col("rank") <= F.col("final_top_k"))
    return routed, stored(ranked, "ranked")


def _by_category(asked: DataFrame, corpus: Corpus, chunks: DataFrame, filtered: bool, query_vectors: DataFrame | None) -> list[tuple[str, DataFrame]]:
    """Ranked lists of queries, each within its routed category, from one search of the postings for all of them.

    A sparse list is empty only if no chunk passes the filter, since documents without a common term fill it; then the query
    is searched without the category.  So a category counts if the corpus has chunks of it: four names at most.
    """
    known = sorted(r[0] for r in chunks.filter(F.col("category").isin(*CATEGORY_TERMS)).select("category").distinct().collect())
    if not known:
        return _side(asked, corpus, chunks if filtered else None, query_vectors, "")
    grouped = asked.withColumn("group", F.when(F.col("category_filter").isin(*known), F.col("category_filter")))
    return _side(grouped, corpus, chunks if filtered else None, query_vectors, "", chunks.select(F.col("chunk_id").alias("doc"), F.col("category").alias("group")))


def _side(asked: DataFrame, corpus: Corpus, chunks: DataFrame | None, query_vectors: DataFrame | None, name: str, within: DataFrame | None = None) -> list[tuple[str, DataFrame]]:
    """Ranked lists of one side: vectors first where there are any, then words."""
    allowed = None if chunks is None else chunks.select(F.col("chunk_id").alias("doc"))
    lists = [(f"{name}bm25", fusion.cut(sparse.search(corpus.sparse, asked, MOST, allowed, within), asked, "bm25_top_k", MOST))]
    if corpus.vectors is not None and query_vectors is not None:
        vectors = corpus.vectors if allowed is None else corpus.vectors.join(allowed, "doc", "left_semi")
        own = query_vectors.join(asked.select("qid", *(["group"] if within is not None else [])), "qid")
        near = dense.search(vectors, own, MOST, within=within)
        lists.insert(0, (f"{name}dense", fusion.cut(near, asked, "dense_top_k", MOST)))
    return lists


def answers(queries: DataFrame, corpus: Corpus, generated: DataFrame | None = None, threshold: float = 0.35, **how) -> DataFrame:
    routed, ranked = retrieve(queries, corpus, **how)
    return answer(routed, ranked, generated, threshold)
