"""Retrieved rows in one shape, whatever index they come from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import text
from .kb import DEFAULT_SOURCE

#: Fields of a result and how an absent one is filled: with empty text, from metadata, or left null.
EMPTY = ("chunk_id", "parent_record_id", "title", "content", "index_text", "citation_url")
FROM_METADATA = ("citation_label", "document_id", "upload_session_id", "file_name", "file_type", "page_number")
AS_IS = ("category", "record_type", "language")


def normalize(rows: DataFrame, retriever: str) -> DataFrame:
    """Rows of a ranked list (qid, score, rank, any payload columns) with all 28 result fields.

    Empty text counts as absent.  The list's score also fills its own column, dense_score or bm25_score.
    """
    own = lambda n, kind="string": F.col(n).cast(kind) if n in rows.columns else F.lit(None).cast(kind)
    some = lambda c: F.nullif(c, F.lit(""))
    meta = F.coalesce(F.col("metadata"), F.create_map().cast("map<string,string>")) if "metadata" in rows.columns else F.create_map().cast("map<string,string>")
    score = F.coalesce(own("score", "double"), F.lit(0.0))
    null = F.lit(None).cast("double")
    fields: dict[str, Column] = {n: text(own(n)) for n in EMPTY}
    fields |= {n: F.coalesce(some(own(n)), meta[n]) for n in FROM_METADATA}
    fields |= {"source_type": F.coalesce(some(own("source_type")), F.lit("official_website")), "source_name": F.coalesce(some(own("source_name")), F.lit(DEFAULT_SOURCE))}
    fields |= {n: own(n) for n in AS_IS}
    fields |= {"metadata": meta, "chunk_index": F.coalesce(own("chunk_index", "int"), F.lit(0)), "total_chunks": F.coalesce(own("total_chunks", "int"), F.lit(1)), "retriever": F.lit(retriever), "score": score}
    fields |= {"dense_score": score if retriever == "dense" else null, "bm25_score": score if retriever == "bm25" else null, "rrf_score": null, "boost_score": F.lit(0.0), "final_score": F.lit(0.0), "rank": own("rank", "int")}
    return rows.select("qid", *[c.alias(n) for n, c in fields.items()])
