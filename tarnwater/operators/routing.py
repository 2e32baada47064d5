"""Query routing: which queries to answer, from which sources, and with what budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions.text import any_of, language_any, source_key, text

MIXED_TOKEN = r"(?<![\p{L}\p{N}_])(?=[a-z0-9-]*[a-z])(?=[a-z0-9-]*[0-9])[a-z0-9-]{3,}(?![\p{L}\p{N}_])"


def words(c: Column) -> Column:
    t = source_key(c)
    return F.when(t == "", 0).otherwise(F.size(F.split(t, " ")))


def source_mode(mode: Column) -> Column:
    """official, uploads or both; other names fall back to official."""
    m = F.lower(F.trim(text(mode)))
    return F.when(m.isin("upload", "uploaded", "uploads"), "uploads").when(m.isin("mixed", "official_and_uploaded", "both"), "both").otherwise("official")


def is_ambiguous(q: Column) -> Column:
    return q.isin(*L.AMBIGUOUS_QUERIES) | ((words(q) <= 1) & ~q.isin(*L.SHORT_CODES))


def is_device(q: Column) -> Column:
    """A device word, or a token that mixes letters and digits."""
    return any_of(q, L.CATEGORY_TERMS["devices"]) | q.rlike(MIXED_TOKEN)


def category(q: Column) -> Column:
    """devices first; else the only category whose terms match."""
    hits = {k: any_of(q, v) for k, v in L.CATEGORY_TERMS.items()}
    n = sum((h.cast("int") for h in hits.values()), F.lit(0))
    only = F.when(n == 1, F.coalesce(*[F.when(h, k) for k, h in hits.items()]))
    return F.when(is_device(q), "devices").otherwise(only)


def complexity(query: Column, mode: Column) -> Column:
    """simple, medium or complex."""
    q, n = F.lower(F.trim(text(query))), words(query)
    deep = F.lower(text(mode)).isin("uploaded", "mixed", "official_and_uploaded") | (n >= L.LONG_QUERY_WORDS) | any_of(q, L.COMPLEX_TERMS)
    return F.when(deep, "complex").when(any_of(q, L.MEDIUM_TERMS), "medium").when((n <= L.SHORT_QUERY_WORDS) | any_of(q, L.SIMPLE_TERMS), "simple").otherwise("medium")


def route(queries: DataFrame, query: str = "query", mode: str | None = None) -> DataFrame:
    """Add route, source_mode, category_filter, language_hint, complexity and the four budgets to queries.

    Clarification comes before rejection, rejection before retrieval; competitors are out of scope only in official mode.
    """
    q = source_key(F.col(query))
    m = source_mode(F.col(mode) if mode else F.lit("official"))
    unsafe = any_of(q, L.UNSAFE_TERMS) | ((m == "official") & any_of(q, L.OUT_OF_SCOPE_TERMS))
    to = F.when((q == "") | is_ambiguous(q), "clarification").when(unsafe, "rejection").otherwise("retrieval")
    level = complexity(F.col(query), m)
    out = queries.withColumns({"route": to, "source_mode": m, "category_filter": F.when((to == "retrieval") & (m == "official"), category(q)), "language_hint": language_any(F.col(query)), "complexity": level})
    by_level = dict(zip(("simple", "medium", "complex"), L.MODE_BUDGETS.values(), strict=True))
    std = L.MODE_BUDGETS["standard"]
    both = (max(std[0], L.UPLOAD_BUDGET[0]), max(std[1], L.UPLOAD_BUDGET[1]), L.BOTH_FINAL * 3, L.BOTH_FINAL)
    for i, name in enumerate(("dense_top_k", "bm25_top_k", "rerank_top_k", "final_top_k")):
        own = F.coalesce(*[F.when(F.col("complexity") == k, v[i]) for k, v in by_level.items()])
        out = out.withColumn(name, F.when(F.col("source_mode") == "uploads", L.UPLOAD_BUDGET[i]).when(F.col("source_mode") == "both", both[i]).otherwise(own))
    return out.withColumn("pipeline_mode", F.when(F.col("complexity") == "simple", "fast").when(F.col("complexity") == "medium", "standard").otherwise("deep")).withColumn("rerank_top_k", F.greatest("rerank_top_k", "final_top_k"))


def expand(queries: DataFrame, query: str = "query") -> DataFrame:
    """One row for each variant of a query; without a rewriting model a query is its only variant."""
    return queries.withColumn("variant", F.explode(F.array(F.col(query))))


def source_filter(rows: DataFrame, mode: str, session: str | None = None) -> DataFrame:
    """Official pages, or one session's uploads; both keeps each."""
    official = F.col("source_type") == "official_website"
    uploads = (F.col("source_type") == "user_upload") & (F.col("upload_session_id") == session if session else F.lit(True))
    return rows.filter({"official": official, "uploads": uploads, "both": official | uploads}[mode])


def metadata_filter(rows: DataFrame, wanted: dict[str, object], fallback: bool = True) -> DataFrame:
    """Rows that meet every given field (a list means any of its values); empty expectations are ignored.

    With fallback a missing column is read from metadata, and values compare as text (the sparse side's rule); without,
    only the row's own columns count (the dense side's).
    """
    for name, value in wanted.items():
        if value in (None, "", []):
            continue
        values = [str(v) for v in (value if isinstance(value, list | tuple) else [value])]
        own = F.col(name).cast("string") if name in rows.columns else F.lit(None).cast("string")
        if fallback and "metadata" in rows.columns:
            own = F.coalesce(own, F.col("metadata")[name].cast("string"))
        rows = rows.filter(F.coalesce(own, F.lit("None")).isin(values) if fallback else own.isin(values))
    return rows
