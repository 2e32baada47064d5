"""Retrieval and generation metrics over golden queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import citation_ids, match_text, text

TOP_K = 5


def _expected() -> tuple[Column, Column, Column]:
    """Whether the row meets the expected category, text and citation; nothing expected is met."""
    body = match_text(F.concat_ws(" ", text(F.col("title")), text(F.col("content")), text(F.col("index_text"))))
    tokens = F.coalesce("expected_contains_any", F.array().cast("array<string>"))
    category = F.col("expected_category").isNull() | F.col("category").eqNullSafe(F.col("expected_category"))
    words = (F.size(tokens) == 0) | F.exists(tokens, lambda t: F.contains(body, match_text(t)))
    cited = F.col("expected_citation_contains").isNull() | F.contains(match_text(F.col("citation_url")), match_text(F.col("expected_citation_contains")))
    return category, words, cited


def score_retrieval(golden: DataFrame, results: DataFrame, k: int = TOP_K) -> DataFrame:
    """One row for each golden query: category, text and citation hits, first hit rank and reciprocal rank within the top k.

    golden: qid, query, expected_* and actual_route.  results: qid, rank and the retrieved fields.  A hit has the category
    and the text or the citation; an expected route other than retrieval counts as a hit at rank 1.
    """
    category, words, cited = _expected()
    joined = golden.join(results.filter(F.col("rank") <= k), "qid", "left")
    got = F.col("rank").isNotNull()
    nothing = lambda c: F.first(F.col(c).isNull() if c != "expected_contains_any" else (F.coalesce(F.size(c), F.lit(0)) <= 0))
    names = ["query", "expected_route", "actual_route"]
    scored = joined.groupBy("qid", *names).agg(F.coalesce(F.max(got & category), F.lit(False)).alias("c"), nothing("expected_category").alias("c0"),
        F.coalesce(F.max(got & words), F.lit(False)).alias("t"), nothing("expected_contains_any").alias("t0"), F.coalesce(F.max(got & cited), F.lit(False)).alias("u"),
        nothing("expected_citation_contains").alias("u0"), F.min(F.when(got & category & (words | cited), F.col("rank"))).alias("r"))
    rejected = F.col("expected_route").isNotNull() & (F.col("expected_route") != "retrieval")
    first = F.when(rejected, 1).otherwise(F.col("r"))
    route = F.col("expected_route").isNull() | F.col("expected_route").eqNullSafe(F.col("actual_route"))
    hit = first.isNotNull() | (F.col("expected_route").isNotNull() & route)
    return scored.select("qid", *names, route.alias("route_match"), (F.col("c") | F.col("c0")).alias("category_hit"),
        (F.col("t") | F.col("t0")).alias("text_hit"), (F.col("u") | F.col("u0")).alias("citation_hit"), hit.alias("hit_at_k"), first.alias("first_hit_rank"),
        F.coalesce(1.0 / first, F.lit(0.0)).alias("reciprocal_rank"))


def retrieval_metrics(rows: DataFrame) -> DataFrame:
    """One row of averages over retrieval queries (0 without any); route accuracy over rows that expect a route."""
    mean = lambda c, where: F.coalesce(F.round(F.avg(F.when(where, F.col(c).cast("double"))), 6), F.lit(0.0))
    asked = F.col("actual_route") == "retrieval"
    return rows.agg(F.count(F.lit(1)).alias("total_queries"), F.count_if(asked).alias("retrieval_queries"),
        mean("route_match", F.col("expected_route").isNotNull()).alias("route_accuracy"), mean("hit_at_k", asked).alias("hit_rate"),
        mean("category_hit", asked).alias("category_hit"), mean("text_hit", asked).alias("text_hit"), mean("citation_hit", asked).alias("citation_hit"),
        mean("reciprocal_rank", asked).alias("mrr"), mean("first_hit_rank", asked).alias("average_first_rank"))


def compare_ranks(before: Column, after: Column) -> Column:
    """A missing rank is worse than any."""
    return F.when(before.isNull() & after.isNotNull(), "improvement").when(before.isNotNull() & after.isNull(), "regression").when(after < before, "improvement").when(after > before, "regression").otherwise("unchanged")


def compare(baseline: DataFrame, other: DataFrame) -> DataFrame:
    """(qid, query, baseline_rank, other_rank, result) for each query of the baseline."""
    theirs = other.select("qid", F.col("first_hit_rank").alias("other_rank"))
    return baseline.select("qid", "query", F.col("first_hit_rank").alias("baseline_rank")).join(theirs, "qid", "left").withColumn("result", compare_ranks(F.col("baseline_rank"), F.col("other_rank")))


def score_generation(golden: DataFrame, answers: DataFrame) -> DataFrame:
    """(qid, valid, has_citations, text_hit, citation_hit, fallback) of answers (qid, answer, status, valid, answer_with_sources)."""
    df = golden.join(answers.select("qid", "answer", "status", "valid", "answer_with_sources"), "qid", "left")
    body, tokens = match_text(F.col("answer")), F.coalesce("expected_contains_any", F.array().cast("array<string>"))
    hit = (F.size(tokens) == 0) | F.exists(tokens, lambda t: F.contains(body, match_text(t)))
    cited = F.col("expected_citation_contains").isNull() | F.contains(match_text(F.col("answer_with_sources")), match_text(F.col("expected_citation_contains")))
    return df.select("qid", F.coalesce("valid", F.lit(False)).alias("valid"), (F.size(citation_ids(F.col("answer"))) > 0).alias("has_citations"),
        hit.alias("text_hit"), cited.alias("citation_hit"), (F.col("status") == "fallback").alias("fallback"))


def generation_metrics(rows: DataFrame) -> DataFrame:
    mean = lambda c: F.coalesce(F.round(F.avg(F.col(c).cast("double")), 6), F.lit(0.0))
    return rows.agg(F.count(F.lit(1)).alias("total"), mean("valid").alias("valid"), mean("text_hit").alias("text_hit"), mean("citation_hit").alias("citation_hit"), F.count_if("fallback").alias("fallbacks"))
