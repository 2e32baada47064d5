"""Rank fusion, metadata boosts, reranking, and per-query budgets."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions.text import ARABIC, any_of, matching, query_entities, text, truthy

RRF_K = 60


def fuse(lists: list[tuple[str, DataFrame]], k: int = RRF_K, key: str = "doc") -> DataFrame:
    """Reciprocal rank fusion of ranked lists (qid, key, score, rank).

    (qid, key, rrf_score, <list>_score, rank): a union and one aggregation instead of an outer join.  Ties go to what the
    earlier list ranked first.
    """
    parts = [df.select("qid", key, "rank", "score", F.lit(i).alias("list")) for i, (_, df) in enumerate(lists)]
    both = reduce(DataFrame.unionByName, parts)
    fused = both.groupBy("qid", key).agg(F.sum(1.0 / (F.lit(k) + F.col("rank"))).alias("rrf_score"), F.min(F.struct("list", "rank")).alias("first"),
        *[F.max(F.when(F.col("list") == i, F.col("score"))).alias(f"{name}_score") for i, (name, _) in enumerate(lists)])
    order = Window.partitionBy("qid").orderBy(F.desc("rrf_score"), "first", key)
    return fused.withColumn("rank", F.row_number().over(order)).drop("first")


def cut(ranked: DataFrame, budgets: DataFrame, column: str = "final_top_k", most: int = 50) -> DataFrame:
    """Rows within each query's own budget (qid, column); the constant bound lets top-k be pushed into the window."""
    return ranked.filter(F.col("rank") <= most).join(budgets.select("qid", column), "qid").filter(F.col("rank") <= F.col(column)).drop(column)


def _sum(*parts: Column) -> Column:
    return reduce(lambda a, b: a + b, parts)


def _if(condition: Column, value: float) -> Column:
    return F.when(F.coalesce(condition, F.lit(False)), F.lit(value)).otherwise(F.lit(0.0))


def meta(name: str) -> Column:
    """A metadata field, as text; empty lists and objects are absent."""
    c = F.col("metadata")[name]
    return F.when(~c.isin("", "[]", "{}"), c)


def boost_score(query: Column) -> Column:
    """What a row's fields add to its fused score for the query, at most BOOST_CAP.

    The row has title, content, index_text, category, record_type, language, source_type and metadata map<string,string>.
    """
    q, entities = matching(query), query_entities(query)
    body = matching(F.concat_ws(" ", text(F.col("title")), text(F.col("content")), text(F.col("index_text"))))
    raw = F.lower(F.concat_ws(" ", *[text(F.col(n)) for n in ("title", "content", "index_text")], *[text(meta(n)) for n in ("product_name", "brand", "model", "search_aliases")]))
    title, category, kind = F.lower(text(F.col("title"))), F.lower(text(F.col("category"))), F.lower(text(F.col("record_type")))
    matched = F.size(F.filter(entities, lambda t: F.contains(raw, F.lower(t))))
    titled = F.size(F.filter(entities, lambda t: F.contains(title, F.lower(t))))
    some = F.size(entities) > 0
    entity = F.when(some, _sum(F.least(F.lit(0.18), 0.05 * matched), _if(titled == F.size(entities), 0.12), _if(category == "devices", 0.08))).otherwise(F.lit(0.0))
    tokens = F.filter(F.regexp_extract_all(q, F.lit(r"[\p{L}\p{N}_\x{600}-\x{6ff}-]+"), F.lit(0)), lambda t: F.length(t) > 2)
    upload = F.when(F.col("source_type") == "user_upload", _sum(_if(F.exists(tokens, lambda t: F.contains(body, t)), 0.06), _if(F.exists(tokens, lambda t: t.rlike(r"\p{Nd}") & F.contains(body, t)), 0.04))).otherwise(F.lit(0.0))
    code = F.when(any_of(q, L.CODE_QUERY_TERMS),
        _sum(_if(any_of(kind, L.CODE_RECORD_TYPES), 0.05), _if(truthy(meta("subscription_code")).isNotNull() | truthy(meta("ussd_codes")).isNotNull(), 0.04), _if(body.contains("*") | body.contains("#"), 0.03))).otherwise(F.lit(0.0))
    asks_price = any_of(q, L.PRICE_BOOST_TERMS)
    price = F.when(asks_price,
        _sum(_if(F.coalesce(*[F.col("metadata")[n] for n in ("price_egp", "price_numeric", "monthly_fee_egp", "yearly_fee_egp", "fee")]).isNotNull(), 0.05), _if(any_of(body, L.PRICE_UNITS), 0.03))).otherwise(F.lit(0.0))
    tier = F.lower(text(meta("tier")))
    home = F.when(any_of(q, L.HOME_QUERY_TERMS),
        _sum(_if(category == "we_home", 0.04), _if(kind.isin(*L.PACKAGE_TYPES), 0.04), _if(truthy(meta("product_family")).isNotNull(), 0.02),
            _if((tier != "") & F.contains(q, tier), 0.04),
            _if((q.contains("gb") | q.contains("جيجا")) & (truthy(meta("quota")).isNotNull() | truthy(meta("quota_gb")).isNotNull()), 0.03),
            _if(q.contains("speed") & truthy(meta("speed")).isNotNull(), 0.02))).otherwise(F.lit(0.0))
    named = [matching(meta(n)) for n in ("brand", "product_name")]
    device = F.when(any_of(q, L.DEVICE_QUERY_TERMS),
        _sum(_if(category == "devices", 0.05), *[_if((v != "") & F.contains(q, v), 0.04) for v in named],
            _if(truthy(meta("device_category")).isNotNull(), 0.02), _if(asks_price & F.col("metadata")["price_numeric"].isNotNull(), 0.03))).otherwise(F.lit(0.0))
    hotline = F.when(any_of(q, L.HOTLINE_TERMS), _sum(_if(body.contains("111"), 0.08), _if(category == "faq", 0.02))).otherwise(F.lit(0.0))
    arabic, language = q.rlike(ARABIC), F.lower(text(F.col("language")))
    tongue = _if((arabic & (language == "ar")) | (~arabic & q.rlike("[a-z]") & (language == "en")), 0.01)
    return F.round(F.least(_sum(entity, upload, code, price, home, device, hotline, tongue), F.lit(L.BOOST_CAP)), 6)


def boost(fused: DataFrame, query: str = "query") -> DataFrame:
    """Add boost_score and final_score, and rank anew; ties keep the fused order."""
    scored = fused.withColumn("boost_score", boost_score(F.col(query))).withColumn("final_score", F.col("rrf_score") + F.col("boost_score"))
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("final_score"), F.col("rank"))))


def candidate_text(m: Callable[[str], Column] = meta) -> Column:
    """The labelled text that a reranker reads; absent fields leave no line."""
    first = lambda *names: F.coalesce(*[truthy(m(n)) for n in names])
    fields = [("Title", F.col("title")), ("Category", F.col("category")), ("Record type", F.col("record_type")), ("Language", F.col("language")),
        ("Product family", m("product_family")), ("Tier", m("tier")), ("Package", first("package_name", "normalized_package_name")),
        ("Quota", first("quota", "quota_gb")), ("Speed", m("speed")),
        ("Price/Fee", first("price", "price_egp", "price_numeric", "monthly_fee", "monthly_fee_egp", "yearly_fee", "yearly_fee_egp", "fee")),
        ("Service", F.coalesce(truthy(m("service_name")), F.col("title"))), ("Code", first("subscription_code", "ussd_codes")),
        ("Brand/Product", first("brand", "product_name", "device_name"))]
    lines = [F.when(text(c) != "", F.concat(F.lit(f"{label}: "), c)) for label, c in fields]
    return F.concat_ws("\n", *lines, F.lit("Content:"), F.coalesce(truthy(F.col("content")), truthy(F.col("index_text")), F.lit("")))


def lexical_score(query: Column, candidate: Column) -> Column:
    """The offline scorer: share of the query's distinct tokens that the candidate holds."""
    from ..functions.text import sparse_tokens

    own = F.array_distinct(sparse_tokens(query))
    return F.when(F.size(own) > 0, F.size(F.array_intersect(own, sparse_tokens(candidate))) / F.size(own)).otherwise(F.lit(0.0))


def rerank(rows: DataFrame, top_k: int | None = None, scorer: Callable[[Column, Column], Column] | None = lexical_score, query: str = "query") -> DataFrame:
    """Order by a scorer's value (a column function; a pandas UDF will do); with None, mark the rows as not reranked."""
    if scorer is None:
        out = rows.withColumns({"reranker_score": F.lit(None).cast("double"), "pre_rerank_rank": F.col("rank"), "pre_rerank_score": F.col("final_score")})
    else:
        out = rows.withColumns({"reranker_score": scorer(F.col(query), candidate_text()), "pre_rerank_rank": F.col("rank"), "pre_rerank_score": F.col("final_score")}).withColumn("final_score", F.col("reranker_score"))
        out = out.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("reranker_score"), "pre_rerank_rank")))
    return out if top_k is None else out.filter(F.col("rank") <= top_k)
