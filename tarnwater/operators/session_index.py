"""Sparse retrieval within sessions: one grouped index that holds a corpus, with statistics of its own, for each session."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import sparse_tokens
from ..sources.shared import spread, stored
from .sparse import EPSILON, B, K1


@dataclass
class SessionIndex:
    """postings (session, doc, dl, term, tf), docs (session, doc, dl), terms (session, term, df, idf), totals (session, n_docs, avgdl)."""

    postings: DataFrame
    docs: DataFrame
    terms: DataFrame
    totals: DataFrame


def build(docs: DataFrame, session: str = "upload_session_id", doc: str = "chunk_id", body: str = "index_text") -> SessionIndex:
    """Document frequencies, lengths and inverse frequencies of each session's own documents.

    As in a corpus: idf = ln(N - df + .5) - ln(df + .5), and a negative one becomes EPSILON times the session's mean.  Every count
    combines on the map side by (session, term) or session, so a session that holds most rows is spread like any others.  Rows without
    a session belong to none and are left out; a null text has no tokens; rows that repeat an id are one document per length.
    """
    words = spread(docs.filter(F.col(session).isNotNull())).select(F.col(session).alias("session"), F.col(doc).alias("doc"), sparse_tokens(F.col(body)).alias("tokens"))
    rows = words.select("session", "doc", F.size("tokens").cast("long").alias("dl"), F.explode_outer("tokens").alias("term"))
    postings = stored(rows.groupBy("session", "doc", "dl", "term").agg(F.count(F.lit(1)).alias("tf")), "session-postings")
    sized = stored(postings.select("session", "doc", "dl").distinct(), "session-lengths")
    postings = postings.filter("term IS NOT NULL")
    totals = stored(sized.groupBy("session").agg(F.count(F.lit(1)).alias("n_docs"), F.avg("dl").alias("avgdl")), "session-totals")
    df = postings.groupBy("session", "term").agg(F.count(F.lit(1)).alias("df"))
    raw = stored(df.join(totals, "session").select("session", "term", "df", (F.log(F.col("n_docs") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("raw")), "session-terms")
    mean = raw.groupBy("session").agg(F.avg("raw").alias("mean"))
    terms = raw.join(mean, "session").select("session", "term", "df", F.when(F.col("raw") < 0, F.col("mean") * EPSILON).otherwise(F.col("raw")).alias("idf"))
    return SessionIndex(postings, sized, terms, totals)


def search(index: SessionIndex, queries: DataFrame, k: int = 10) -> DataFrame:
    """(session, qid, doc, score, rank): the best k documents of its own session for each query (session, qid, query).

    Ties (to 9 places) go to the smaller id; documents without a common term score zero and may fill the list.  As long as a query
    has no term of negative weight they come after all hits, and the session's first 2k ids hold enough of them; where it has one, the
    session's documents join that query.  A query without tokens, or of a session without documents, returns nothing.
    """
    asked = queries.select("session", "qid", F.explode(sparse_tokens(F.col("query"))).alias("term")).groupBy("session", "qid", "term").agg(F.count(F.lit(1)).alias("qtf"))
    asked = stored(asked.join(index.terms, ["session", "term"], "left"), "session-asked")
    hits = index.postings.join(asked.filter("idf IS NOT NULL"), ["session", "term"]).join(index.totals.select("session", "avgdl"), "session")
    weight = F.col("qtf") * F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    each = asked.groupBy("session", "qid").agg((F.coalesce(F.min("idf"), F.lit(0.0)) < 0).alias("negative"))
    first = index.docs.select("session", "doc").distinct().withColumn("place", F.row_number().over(Window.partitionBy("session").orderBy("doc"))).filter(F.col("place") <= 2 * k)
    fill = each.filter("NOT negative").join(first, "session").unionByName(each.filter("negative").join(index.docs, "session"), allowMissingColumns=True)
    scored = hits.select("session", "qid", "doc", weight.alias("weight")).unionByName(fill.select("session", "qid", "doc", F.lit(0.0).alias("weight")))
    scored = scored.groupBy("session", "qid", "doc").agg(F.sum("weight").alias("score"))
    rank = F.row_number().over(Window.partitionBy("session", "qid").orderBy(F.desc(F.round("score", 9)), "doc"))
    return scored.withColumn("rank", rank).filter(F.col("rank") <= k)
