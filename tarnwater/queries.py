"""Registered queries over the test tables, one for each operator family, with DuckDB SQL where SQL can say the same."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import lexicon as L
from .functions import parsing as P
from .functions import text as X
from . import page_queries
from .operators import answers, block_index, chunking, dedupe, dense, evaluate, fusion, html, kb, observe, quality, records, results, routing, session_index, sparse, vector_index
from .plans import ask, build, provider_jobs
from .sources import readers, sinks
from .sources.keyed import KeyedTable
from .sources.shared import files_of, shared_dir, spread
from .streaming import gauges

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- SQL fragments ----------------------------------------------------------------------------------------


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def squeeze(c: str) -> str:
    return f"trim(regexp_replace(coalesce({c}, ''), {lit(X.SPACE + '+')}, ' ', 'g'))"


def key(c: str) -> str:
    return f"trim(regexp_replace(lower(coalesce({c}, '')), '[^a-z0-9\\x{{600}}-\\x{{6ff}}]+', ' ', 'g'))"


def tokens(c: str) -> str:
    return f"list_transform(regexp_extract_all(coalesce({c}, ''), {lit(X.SPARSE_TOKEN)}), lambda t: CASE WHEN regexp_full_match(t, '[\\x00-\\x7f]*') THEN lower(t) ELSE t END)"


def any_of(c: str, terms: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains({c}, {lit(x)})" for x in terms) + ")"


BM25 = f"""
toks AS (SELECT doc_id, {tokens('text')} AS ts FROM documents),
dl AS (SELECT doc_id, len(ts) AS dl FROM toks),
post AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(ts) AS term FROM toks) GROUP BY ALL),
tot AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl),
raw AS (SELECT term, count(*) AS df, ln((SELECT n FROM tot) - count(*) + 0.5) - ln(count(*) + 0.5) AS r FROM post GROUP BY term),
idf AS (SELECT term, df, CASE WHEN r < 0 THEN 0.25 * (SELECT avg(r) FROM raw) ELSE r END AS idf FROM raw),
q AS (SELECT item_id AS qid, term, count(*) AS qtf FROM (SELECT item_id, unnest({tokens('text')}) AS term FROM benchmark) GROUP BY ALL),
sc AS (SELECT qid, doc_id AS doc, sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / (SELECT avgdl FROM tot)))) AS score
       FROM q JOIN idf USING (term) JOIN post USING (term) JOIN dl USING (doc_id) GROUP BY ALL)"""


def ranked(source: str, k: int, name: str = "r") -> str:
    """CTEs for the top k of a score table, filled up with zero scores."""
    return f"""
{name}_z AS (SELECT qid, doc_id AS doc, 0.0::DOUBLE AS score FROM (SELECT DISTINCT qid FROM q), (SELECT doc_id FROM {source}_pool ORDER BY doc_id LIMIT {2 * k}) WHERE (qid, doc_id) NOT IN (SELECT (qid, doc) FROM {source})),
{name} AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, doc) AS rank FROM (SELECT * FROM {source} UNION ALL SELECT * FROM {name}_z) QUALIFY rank <= {k})"""


# --- Sparse, dense, fusion ---------------------------------------------------------------------------------


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("query"))


_INDEXES: dict[tuple, tuple[sparse.SparseIndex, tuple]] = {}


def indexed(spark: SparkSession, sf_dir: str, docs: DataFrame, doc: str = "doc_id", body: str = "text") -> sparse.SparseIndex:
    """The corpus' sparse index, built once for each state of the corpus' files in an application; built again if they or its tables have changed."""
    name = (spark.sparkContext.applicationId, doc, body, files_of(docs))
    index, tables = _INDEXES.get(name, (None, None))
    if index is None or files_of(index.postings) != tables:
        index = sparse.build_index(docs, doc, body)
        _INDEXES[name] = index, files_of(index.postings)
    return index


@query(f"WITH {BM25}, sc_pool AS (SELECT doc_id FROM dl), {ranked('sc', 10)} SELECT qid, doc, round(score, 6) AS score, rank FROM r")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best ten documents for each benchmark item."""
    index = indexed(spark, sf_dir, t(spark, sf_dir, "documents"))
    return sparse.search(index, items(spark, sf_dir), 10).select("qid", "doc", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query(f"WITH {BM25}, f AS (SELECT sc.* FROM sc JOIN documents ON doc = doc_id WHERE lang IN ('de', 'fr')), f_pool AS (SELECT doc_id FROM documents WHERE lang IN ('de', 'fr')), {ranked('f', 5)} SELECT qid, doc, round(score, 6) AS score, rank FROM r")
def filtered_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A metadata filter leaves the corpus statistics alone."""
    docs = t(spark, sf_dir, "documents")
    allowed = routing.metadata_filter(docs, {"lang": ["de", "fr"], "source": None}).select(F.col("doc_id").alias("doc"))
    return sparse.search(indexed(spark, sf_dir, docs), items(spark, sf_dir), 5, allowed).select("qid", "doc", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query(f"WITH {BM25} SELECT term, df, round(idf, 6) AS idf FROM idf")
def term_df_idf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return indexed(spark, sf_dir, t(spark, sf_dir, "documents")).terms.select("term", "df", F.round("idf", 6).alias("idf"))


@query(f"SELECT doc_id, len({tokens('text')})::INT AS n_sparse, len(regexp_extract_all(coalesce(text, ''), {lit(X.APPROX_TOKEN)}))::INT AS n_approx FROM documents")
def token_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "documents").select("doc_id", F.size(X.sparse_tokens(F.col("text"))).alias("n_sparse"), X.token_count(F.col("text")).alias("n_approx"))


DENSE = """
e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
ds AS (SELECT a.vec_id AS qid, b.vec_id AS doc, list_cosine_similarity(a.v, b.v) AS score FROM e a, e b WHERE a.vec_id % 20 = 0),
dr AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc) AS rank FROM ds QUALIFY row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc) <= 10)"""


@query(f"WITH {DENSE} SELECT qid, doc, round(score, 6) AS score, rank FROM dr")
def dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stated query set (ids divisible by 20) against all vectors."""
    vectors = t(spark, sf_dir, "embeddings")
    asked = vectors.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), "embedding")
    return dense.search(dense.build_index(vectors), asked, 10).select("qid", "doc", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query(f"""WITH {BM25}, sc_pool AS (SELECT doc_id FROM dl), {ranked('sc', 10)}, {DENSE},
u AS (SELECT qid, doc, rank, score, 0 AS list FROM dr UNION ALL SELECT qid, doc, rank, score, 1 FROM r)
SELECT qid, doc, round(sum(1.0::DOUBLE / (60 + rank)), 6) AS rrf_score, round(max(score) FILTER (list = 0), 6) AS dense_score, round(max(score) FILTER (list = 1), 6) AS bm25_score,
  row_number() OVER (PARTITION BY qid ORDER BY sum(1.0::DOUBLE / (60 + rank)) DESC, min(list * 1000 + rank), doc) AS rank FROM u GROUP BY qid, doc""")
def rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vector list and the word list of the same query ids."""
    vectors, docs = t(spark, sf_dir, "embeddings"), t(spark, sf_dir, "documents")
    near = dense.search(dense.build_index(vectors), vectors.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), "embedding"), 10)
    words = sparse.search(indexed(spark, sf_dir, docs), items(spark, sf_dir), 10)
    fused = fusion.fuse([("dense", near), ("bm25", words)])
    return fused.select("qid", "doc", *[F.round(c, 6).alias(c) for c in ("rrf_score", "dense_score", "bm25_score")], F.col("rank").cast("long").alias("rank"))


# --- Routing ------------------------------------------------------------------------------------------------

_Q = f"regexp_replace(lower(coalesce(query, '')), {lit(X.SPACE + '+')}, ' ', 'g')"
_CORE = "([a-z][a-z0-9-]*[0-9]|[0-9][a-z0-9-]*[a-z])"
_MIXED = f"(^|[^\\p{{L}}\\p{{N}}_])([a-z0-9-]+{_CORE}[a-z0-9-]*|{_CORE}[a-z0-9-]+|[a-z][a-z0-9-]+[0-9]|[0-9][a-z0-9-]+[a-z])($|[^\\p{{L}}\\p{{N}}_])"
ROUTE = f"""
asked AS (SELECT item_id AS qid, text AS query FROM benchmark UNION ALL SELECT 1000000000 + conv_id * 100000 + turn, text FROM conversations WHERE role = 'user'),
n AS (SELECT *, trim({_Q}) AS q FROM asked),
w AS (SELECT *, CASE WHEN q = '' THEN 0 ELSE len(string_split(q, ' ')) END AS words, {any_of('q', L.CATEGORY_TERMS['devices'])} OR regexp_matches(q, {lit(_MIXED)}) AS device,
  {', '.join(f"{any_of('q', v)} AS m_{k}" for k, v in L.CATEGORY_TERMS.items())} FROM n),
routed AS (SELECT qid, query, CASE WHEN q = '' OR q IN ({', '.join(map(lit, L.AMBIGUOUS_QUERIES))}) OR (words <= 1 AND q NOT IN ({', '.join(map(lit, L.SHORT_CODES))})) THEN 'clarification'
    WHEN {any_of('q', L.UNSAFE_TERMS + L.OUT_OF_SCOPE_TERMS)} THEN 'rejection' ELSE 'retrieval' END AS route,
  CASE WHEN device THEN 'devices' WHEN m_faq::INT + m_devices::INT + m_we_home::INT + m_services::INT = 1 THEN CASE WHEN m_faq THEN 'faq' WHEN m_devices THEN 'devices' WHEN m_we_home THEN 'we_home' ELSE 'services' END END AS cat,
  CASE WHEN regexp_matches(query, '[\\x{{600}}-\\x{{6ff}}]') AND regexp_matches(query, '[A-Za-z]') THEN 'mixed' WHEN regexp_matches(query, '[\\x{{600}}-\\x{{6ff}}]') THEN 'ar' WHEN regexp_matches(query, '[A-Za-z]') THEN 'en' END AS language_hint,
  CASE WHEN words >= 18 OR {any_of('q', L.COMPLEX_TERMS)} THEN 'complex' WHEN {any_of('q', L.MEDIUM_TERMS)} THEN 'medium' WHEN words <= 8 OR {any_of('q', L.SIMPLE_TERMS)} THEN 'simple' ELSE 'medium' END AS complexity FROM w)"""


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    talk = t(spark, sf_dir, "conversations").filter("role = 'user'")
    return items(spark, sf_dir).unionByName(talk.select((F.lit(1000000000) + F.col("conv_id") * 100000 + F.col("turn")).alias("qid"), F.col("text").alias("query")))


@query(f"WITH {ROUTE} SELECT qid, route, CASE WHEN route = 'retrieval' THEN cat END AS category_filter, language_hint, complexity, CASE complexity WHEN 'simple' THEN 3 WHEN 'medium' THEN 5 ELSE 8 END AS final_top_k FROM routed")
def route_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routing.route(asked(spark, sf_dir)).select("qid", "route", "category_filter", "language_hint", "complexity", "final_top_k")


@query(f"WITH {BM25}, sc_pool AS (SELECT doc_id FROM dl), {ranked('sc', 50)}, {ROUTE} SELECT r.qid, doc, r.rank, complexity FROM r JOIN routed USING (qid) WHERE route = 'retrieval' AND rank <= CASE complexity WHEN 'simple' THEN 3 WHEN 'medium' THEN 5 ELSE 8 END")
def adaptive_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each query's own budget; rejected and ambiguous ones are never searched."""
    routed = routing.route(items(spark, sf_dir)).filter("route = 'retrieval'")
    found = sparse.search(indexed(spark, sf_dir, t(spark, sf_dir, "documents")), routed, 50)
    return fusion.cut(found, routed).join(routed.select("qid", "complexity"), "qid").select("qid", "doc", F.col("rank").cast("long").alias("rank"), "complexity")


# --- Text -----------------------------------------------------------------------------------------------------


@query(f"""SELECT doc_id, sha256({squeeze('text')}) AS squeezed, sha256({key('text')}) AS keyed, sha256({squeeze('lower(text)')}) AS source_key, sha256({squeeze("translate(lower(text), 'آأإ', 'ااا')")}) AS matching,
  CASE WHEN length({squeeze('text')}) <= 120 THEN {squeeze('text')} ELSE rtrim(substr({squeeze('text')}, 1, 117)) || '...' END AS snippet FROM documents""")
def normalize_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("text")
    return t(spark, sf_dir, "documents").select("doc_id", F.sha2(X.squeeze(c), 256).alias("squeezed"), F.sha2(X.key(c), 256).alias("keyed"),
        F.sha2(X.source_key(c), 256).alias("source_key"), F.sha2(X.matching(c), 256).alias("matching"), X.snippet(c, 120).alias("snippet"))


@query("""SELECT doc_id, CASE WHEN regexp_matches(text, '[\\x{600}-\\x{6ff}]') AND regexp_matches(text, '[A-Za-z]') THEN 'mixed' WHEN regexp_matches(text, '[\\x{600}-\\x{6ff}]') THEN 'ar' WHEN regexp_matches(text, '[A-Za-z]') THEN 'en' END AS any_letter,
  CASE WHEN length(regexp_replace(substr(text, 1, 4000), '[^A-Za-z]', '', 'g')) >= 30 THEN 'en' END AS by_count FROM documents""")
def language_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "documents").select("doc_id", X.language_any(F.col("text")).alias("any_letter"), X.language_threshold(F.col("text")).alias("by_count"))


@query(f"""SELECT doc_id, nullif(regexp_extract(text, {lit(L.BUSINESS_PRICE)}), '') AS price, try_cast(replace(nullif(regexp_extract(text, {lit(L.BUSINESS_PRICE)}, 1), ''), ',', '') AS DOUBLE) / CASE WHEN lower(regexp_extract(text, {lit(L.BUSINESS_PRICE)}, 2)) IN ('pt', 'قرش', 'قروش') THEN 100 ELSE 1 END AS price_egp,
  nullif(regexp_extract(text, {lit(L.MOBILE_QUOTA)}), '') AS quota, nullif(regexp_extract(lower(text), {lit(L.VALID_DAYS)}), '') AS valid_days, len(list_distinct(regexp_extract_all(text, '[\\p{{L}}\\p{{M}}\\p{{N}}_.+-]+@[\\p{{L}}\\p{{M}}\\p{{N}}_-]+(?:\\.[\\p{{L}}\\p{{M}}\\p{{N}}_-]+)+')))::INT AS n_emails FROM documents""")
def extract_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("text")
    return t(spark, sf_dir, "documents").select("doc_id", P.price_business(c)["text"].alias("price"), P.price_business(c)["value"].alias("price_egp"),
        P.quota_mobile(c)["text"].alias("quota"), P.found(F.lower(c), L.VALID_DAYS).alias("valid_days"), F.size(P.emails(c)).alias("n_emails"))


@query()
def extract_codes_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Look-around patterns, which the other engine lacks; tests hold them against plain Python."""
    c = F.col("text")
    return t(spark, sf_dir, "documents").select("doc_id", F.array_join(P.ussd_codes(c), ",").alias("ussd"),
        F.array_join(P.mobile_codes(c), ",").alias("mobile"), F.size(X.query_entities(c)).alias("n_entities"), F.size(P.value_signature(c)).alias("n_values"),
        P.validity(c)["days"].alias("validity_days"), F.array_join(P.dates(c), ",").alias("dates"))


@query(f"""WITH u AS (SELECT page_id, regexp_replace(regexp_replace(trim(coalesce(url, '')), '[?#].*$', ''), '/+$', '') AS u FROM pages),
h AS (SELECT page_id, u, regexp_extract(u, '^([A-Za-z][A-Za-z0-9+.-]*://[^/]*)', 1) AS head FROM u)
SELECT page_id, lower(head) || regexp_replace(substr(u, length(head) + 1), '(?i)/(en|ar)(/|$)', '\\2', 'g') AS canonical, lower(lower(head) || regexp_replace(substr(u, length(head) + 1), '(?i)/(en|ar)(/|$)', '\\2', 'g')) AS pair_key, string_split(u, '/')[-1] AS slug, substr(sha256(u), 1, 12) AS id FROM h""")
def url_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("url")
    return t(spark, sf_dir, "pages").select("page_id", X.url_canonical(c).alias("canonical"), X.url_pair_key(c).alias("pair_key"), X.url_slug(c).alias("slug"), X.short_hash(X.url_plain(c), 12).alias("id"))


# --- Dedupe and relational operators --------------------------------------------------------------------------


@query(f"""SELECT doc_id, lang, source FROM documents QUALIFY row_number() OVER (PARTITION BY coalesce(lang, ''), coalesce(source, ''), {key("string_split(text, chr(10))[1]")}, substr(sha256(substr(coalesce(text, ''), 1, 1200)), 1, 12) ORDER BY doc_id) = 1""")
def dedupe_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = [F.col("lang"), F.col("source"), X.key(F.get(F.split("text", "\n"), F.lit(0))), X.short_hash(F.substring(X.text(F.col("text")), 1, 1200), 12)]
    return dedupe.first_wins(t(spark, sf_dir, "documents"), keys, ["doc_id"]).select("doc_id", "lang", "source")


@query(f"""WITH l AS (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)),
k AS (SELECT doc_id, i - 1 AS line_no, ls[i] AS line, {key('ls[i]')} AS k FROM l)
SELECT doc_id AS doc, line_no::INT AS line_no, sha256(line) AS line_sha FROM k WHERE k <> '' QUALIFY row_number() OVER (PARTITION BY doc_id, k ORDER BY line_no) = 1""")
def line_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedupe.line_dedupe(t(spark, sf_dir, "documents")).select("doc", "line_no", F.sha2("line", 256).alias("line_sha"))


@query("SELECT doc_id, lang FROM documents ANTI JOIN labels USING (doc_id)")
def anti_join_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a resumed job has still to do."""
    return dense.missing(t(spark, sf_dir, "documents").select("doc_id", "lang"), t(spark, sf_dir, "labels"), "doc_id")


@query("SELECT d.doc_id, lang, coalesce(l.quality, -1) AS quality, coalesce(l.toxic, -1) AS toxic FROM documents d LEFT JOIN labels l USING (doc_id)")
def hydrate_left_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    right = t(spark, sf_dir, "labels")
    return t(spark, sf_dir, "documents").select("doc_id", "lang").join(right, "doc_id", "left").select("doc_id", "lang", F.coalesce("quality", F.lit(-1)).alias("quality"), F.coalesce("toxic", F.lit(-1)).alias("toxic"))


@query("""SELECT vec_id AS doc, label AS rev FROM (SELECT vec_id, label, 0 AS new FROM embeddings WHERE vec_id % 3 <> 0 UNION ALL SELECT vec_id, label + 1000, 1 FROM embeddings WHERE vec_id % 3 = 0 OR vec_id % 2 = 0) QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY new DESC) = 1""")
def vector_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a second load replace those of the first with the same point id."""
    v = t(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc"), F.col("label").alias("rev"), X.uuid5(F.col("vec_id").cast("string")).alias("point_id"))
    return dense.upsert(v.filter("doc % 3 <> 0"), v.filter("doc % 3 = 0 OR doc % 2 = 0").withColumn("rev", F.col("rev") + 1000)).select("doc", "rev")


@query("SELECT len(embedding) AS dimension, count(*) AS n FROM embeddings GROUP BY 1")
def vector_dimensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dense.same_dimension(t(spark, sf_dir, "embeddings"))


_H = "sha1(unhex('6ba7b8109dad11d180b400c04fd430c8') || encode(vec_id::VARCHAR))"


@query(f"""WITH h AS (SELECT vec_id, {_H} AS h FROM embeddings)
SELECT vec_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', ((strpos('0123456789abcdef', substr(h, 17, 1)) - 1) % 4 + 1)::INT, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS point_id FROM h""")
def point_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Version-5 ids; tests hold them against Python's uuid."""
    return t(spark, sf_dir, "embeddings").select("vec_id", X.uuid5(F.col("vec_id").cast("string")).alias("point_id"))


@query("SELECT source, lang, count(*) AS n FROM (SELECT source, lang FROM documents UNION ALL SELECT 'pages', NULL FROM pages UNION ALL SELECT role, NULL FROM conversations) GROUP BY ALL")
def union_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [t(spark, sf_dir, "documents").select("source", "lang"), t(spark, sf_dir, "pages").select(F.lit("pages").alias("source")), t(spark, sf_dir, "conversations").select(F.col("role").alias("source"))]
    return dedupe.union_sources(*parts).groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n"))


# --- Chunks -----------------------------------------------------------------------------------------------------


@query(f"""WITH w AS (SELECT doc_id, list_filter(string_split({squeeze('text')}, ' '), lambda x: x <> '') AS ws FROM documents),
c AS (SELECT doc_id, ws, unnest(range(0, len(ws), 128)) AS i FROM w WHERE len(ws) > 0)
SELECT doc_id, (i // 128)::INT AS chunk_index, ceil(len(ws) / 128)::INT AS total_chunks, sha256(array_to_string(list_slice(ws, greatest(i - 16, 0) + 1, i + 128), ' ')) AS chunk_sha FROM c""")
def chunk_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = chunking.word_windows(F.col("text"), 128, 16)
    rows = t(spark, sf_dir, "documents").select("doc_id", pieces.alias("p")).select("doc_id", F.posexplode("p").alias("chunk_index", "chunk"), F.size("p").alias("total_chunks"))
    return rows.select("doc_id", "chunk_index", "total_chunks", F.sha2("chunk", 256).alias("chunk_sha"))


def as_records(docs: DataFrame) -> DataFrame:
    """Documents in the shape of accepted records."""
    empty = F.create_map().cast("map<string,string>")
    return docs.select(F.concat(F.lit("doc-"), F.col("doc_id")).alias("record_id"),
        F.substring(F.get(F.split(X.text(F.col("text")), "\n"), F.lit(0)), 1, 80).alias("title"), X.text(F.col("text")).alias("content"),
        F.lit("document").alias("record_type"), F.col("source").alias("category"), F.col("lang").alias("language"),
        F.concat(F.lit("https://example.com/"), F.col("doc_id")).alias("citation_url"), F.lit("official_website").alias("source_type"), empty.alias("metadata"))


@query()
def chunk_recursive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.chunk_records(as_records(t(spark, sf_dir, "documents"))).select("chunk_id", "parent_record_id", "chunk_index", "total_chunks", F.length("content").alias("chars"))


@query()
def chunk_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.chunk_stats(chunking.chunk_records(as_records(t(spark, sf_dir, "documents"))))


# --- Knowledge base ---------------------------------------------------------------------------------------------


def raw_records(docs: DataFrame) -> DataFrame:
    """Documents as raw JSON: some without text, title, address or type, to be told apart by the build."""
    i = F.col("doc_id")
    fields = F.struct(F.when(i % 7 != 3, F.col("text")).alias("content"), F.when(i % 11 != 5, F.concat(F.lit("Title "), i)).alias("title"),
        F.when(i % 13 != 7, F.concat(F.lit("https://example.com/"), i)).alias("source_url"), F.when(i % 3 != 0, F.lit("service_detail")).alias("record_type"),
        F.col("source").alias("category"), F.col("lang").alias("language"))
    bad = i % 17 == 9
    return docs.select("doc_id", F.when(bad, F.lit("{broken")).otherwise(F.to_json(fields)).alias("raw"), F.lit("web").alias("category_hint"),
        F.concat(F.lit("part-"), i % 3).alias("source_file"), F.when(bad, "invalid JSON").alias("error"), i.alias("line_number"))


_BLANK = f"{squeeze('text')} = ''"
_REASON = f"""CASE WHEN doc_id % 17 = 9 THEN 'malformed_json_line_' || doc_id || ': invalid JSON' WHEN doc_id % 7 = 3 OR {_BLANK} THEN 'empty_content' WHEN doc_id % 13 = 7 THEN 'missing_citation_url' WHEN doc_id % 11 = 5 THEN 'missing_title' END"""
KB = f"kb AS (SELECT doc_id, 'part-' || doc_id % 3 AS source_file, {_REASON} AS reason, CASE WHEN doc_id % 17 = 9 THEN 'web' ELSE lower(source) END AS category, CASE WHEN doc_id % 17 = 9 THEN 'unknown' WHEN doc_id % 3 <> 0 THEN 'service_detail' ELSE 'unknown' END AS record_type, CASE WHEN doc_id % 17 <> 9 THEN lang END AS language FROM documents)"


@query(f"WITH {KB} SELECT doc_id, reason AS rejection_reason, category, record_type, language FROM kb")
def accept_reject(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kb.normalize(raw_records(t(spark, sf_dir, "documents"))).select("doc_id", "rejection_reason", "category", "record_type", "language")


@query(f"WITH {KB} SELECT source_file, count(*) AS input, count(*) FILTER (reason IS NULL) AS accepted, count(reason) AS rejected, count(*) FILTER (reason = 'missing_citation_url') AS missing_citation, count(*) FILTER (reason = 'empty_content') AS empty_content, count(*) FILTER (reason IS NULL AND record_type = 'unknown') AS unknown_type FROM kb GROUP BY ROLLUP (source_file)")
def kb_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kb.manifest(kb.normalize(raw_records(t(spark, sf_dir, "documents"))))


@query(f"WITH {KB}, a AS (SELECT category, coalesce(language, 'unknown') AS language, record_type FROM kb WHERE reason IS NULL) SELECT 'category' AS field, category AS value, count(*) AS n FROM a GROUP BY ALL UNION ALL SELECT 'language', language, count(*) FROM a GROUP BY ALL UNION ALL SELECT 'record_type', record_type, count(*) FROM a GROUP BY ALL")
def kb_distributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kb.distributions(kb.accepted(kb.normalize(raw_records(t(spark, sf_dir, "documents")))))


_CLEANED = f"array_to_string(list_filter(list_transform(string_split_regex(CASE WHEN doc_id % 17 <> 9 AND doc_id % 7 <> 3 THEN coalesce(text, '') ELSE '' END, {lit(X.LINE_END)}), lambda x: {squeeze('x')}), lambda x: x <> ''), chr(10))"


@query(f"""WITH {KB}, f AS (SELECT doc_id, {_CLEANED} AS content, CASE WHEN doc_id % 17 <> 9 AND doc_id % 11 <> 5 THEN 'Title ' || doc_id ELSE 'Untitled Record' END AS title, CASE WHEN doc_id % 17 <> 9 AND doc_id % 13 <> 7 THEN 'https://example.com/' || doc_id END AS url FROM documents)
SELECT source_file, sha256(category || chr(10) || title || chr(10) || content || chr(10) || coalesce(url, '')) AS record_id, CASE WHEN reason IS NULL THEN 'accepted' ELSE 'rejected' END AS status, category, record_type, language, title, length(content)::INT AS content_length, url AS citation_url,
  NULL::DOUBLE AS quality_score, coalesce(reason, '') AS rejection_reason, CASE WHEN record_type = 'unknown' THEN 'missing_record_type' ELSE '' END AS warnings, CASE WHEN url IS NOT NULL THEN 'source_url' ELSE '' END AS metadata_keys FROM kb JOIN f USING (doc_id)""")
def kb_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kb.report(kb.normalize(raw_records(t(spark, sf_dir, "documents"))))


# --- Quality ------------------------------------------------------------------------------------------------------

_TITLE = "substr(string_split(coalesce(text, ''), chr(10))[1], 1, 80)"
_ISSUES = f"""list_filter([CASE WHEN trim({_TITLE}) = '' THEN 'missing_title' END, CASE WHEN lower(trim({_TITLE})) IN ({', '.join(map(lit, quality.NAVIGATION_TITLES))}) THEN 'navigation_title' END,
  CASE WHEN trim(coalesce(text, '')) = '' THEN 'missing_content' END, CASE WHEN length(trim(coalesce(text, ''))) BETWEEN 1 AND 79 THEN 'short_content' END, CASE WHEN doc_id % 13 = 7 THEN 'missing_citation_url' END,
  CASE WHEN coalesce(lang, '') NOT IN ('', 'en', 'ar', 'mixed', 'unknown') THEN 'unexpected_language' END], lambda x: x IS NOT NULL)"""


def with_issues(docs: DataFrame) -> DataFrame:
    title = F.substring(F.get(F.split(X.text(F.col("text")), "\n"), F.lit(0)), 1, 80)
    return docs.withColumn("issues", quality.issues(title, F.col("text"), F.when(F.col("doc_id") % 13 != 7, F.lit("https://example.com")), F.col("lang")))


@query(f"SELECT doc_id, array_to_string({_ISSUES}, ';') AS issues FROM documents")
def qa_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.report(with_issues(t(spark, sf_dir, "documents")), ["doc_id", "issues"]).withColumn("doc_id", F.col("doc_id").cast("long"))


@query(f"SELECT source, issue, count(*) AS n FROM (SELECT source, unnest({_ISSUES}) AS issue FROM documents) GROUP BY GROUPING SETS ((source, issue), (issue))")
def qa_issue_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.issue_counts(with_issues(t(spark, sf_dir, "documents")), "source")


_SCORE = """round(CASE WHEN string_split(coalesce(text, ''), chr(10))[1] <> '' THEN 0.2 ELSE 0 END + 0.15 + CASE WHEN length(coalesce(text, '')) >= 120 THEN 0.35 ELSE 0 END + CASE WHEN lang IS NOT NULL THEN 0.2 ELSE 0 END + CASE WHEN regexp_matches(coalesce(text, ''), '[0-9]') THEN 0.1 ELSE 0 END, 2)"""


def scored(docs: DataFrame) -> DataFrame:
    first = F.get(F.split(X.text(F.col("text")), "\n"), F.lit(0))
    score = records.score_generic(first, F.lit("https://example.com"), F.col("text"), F.col("lang"), X.text(F.col("text")).rlike("[0-9]"))
    return docs.withColumn("quality_score", score).withColumn("is_accepted", F.col("quality_score") >= 0.8).withColumn("content", F.col("text"))


@query(f"SELECT doc_id, {_SCORE}::DOUBLE AS quality_score FROM documents")
def quality_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(t(spark, sf_dir, "documents")).select("doc_id", "quality_score")


@query(f"SELECT count(*) AS records, count(*) FILTER (s >= 0.8) AS accepted, count(*) FILTER (s < 0.8) AS rejected, round(avg(s), 3) AS average_score, count(*) FILTER (length(text) < 80) AS short_content, count(*) FILTER (coalesce(lang, '') = '') AS missing_lang FROM (SELECT *, {_SCORE}::DOUBLE AS s FROM documents)")
def quality_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.summary(scored(t(spark, sf_dir, "documents")), ("lang",))


@query("SELECT source, count(*) AS n FROM documents GROUP BY source")
def count_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.count_by(t(spark, sf_dir, "documents"), "source")


@query(f"SELECT issue AS flag, n, row_number() OVER (ORDER BY n DESC, issue) AS rank FROM (SELECT issue, count(*) AS n FROM (SELECT unnest({_ISSUES}) AS issue FROM documents) GROUP BY issue) QUALIFY rank <= 3")
def top_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.top_flags(with_issues(t(spark, sf_dir, "documents")), 3, "issues").withColumn("rank", F.col("rank").cast("long"))


@query()
def record_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three record normalisers over documents, with scores, flags and acceptance."""
    docs = spread(t(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    base = docs.select(F.get(F.split(X.text(F.col("text")), "\n"), F.lit(0)).alias("title"), F.col("text").alias("content"),
        F.concat(F.lit("https://example.com/"), F.col("doc_id")).alias("citation_url"), F.col("lang").alias("language"), F.lit("prepaid").alias("mobile_category"),
        F.lit("plan").alias("record_type"), F.lit("about").alias("section"), F.col("doc_id").alias("src_ord"))
    row = lambda kind: F.struct("src_ord", F.lit(kind).alias("kind"), "quality_score", "is_accepted", F.concat_ws(";", "quality_flags").alias("flags"), "record_id")
    # The cleanup starts from mobile records, which are normalised once for both.
    mobile = records.cleanup_mobile(records.normalize_mobile(base).withColumn("__mobile", row("mobile")))
    parts = [mobile.select(F.explode(F.array("__mobile", row("cleanup"))).alias("r")), *[df.select(row(kind).alias("r")) for kind, df in (("business", records.normalize_business(base)), ("section", records.normalize_section(base)))]]
    return dedupe.union_sources(*[p.select("r.*") for p in parts])


# --- Pages ----------------------------------------------------------------------------------------------------------


@query()
def page_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.parsed(t(spark, sf_dir, "pages")).select("page_id", "title", "description", "language", F.size("lines").alias("n_lines"), F.size("page.links").alias("n_links"), html.is_useful().alias("useful"))


@query("""WITH a AS (SELECT page_id, url, generate_subscripts(regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 1), 1) AS i, unnest(regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 1)) AS href, unnest(regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 2)) AS link_text FROM pages),
l AS (SELECT page_id, (i - 1)::INT AS position, CASE WHEN href LIKE '/%' THEN regexp_extract(url, '^[a-z]+://[^/]+') || href ELSE href END AS url, link_text FROM a)
SELECT page_id, url, link_text, position FROM l QUALIFY row_number() OVER (PARTITION BY page_id, url ORDER BY position) = 1""")
def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.links(html.parsed(t(spark, sf_dir, "pages"))).select("page_id", "url", "link_text", "position")


@query()
def page_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.table_rows(html.parsed(t(spark, sf_dir, "pages"))).withColumn("data", F.to_json("data"))


@query()
def page_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Public pages: one scored record each."""
    return build.scrape(t(spark, sf_dir, "pages"), "public").select("page_id", "title", "category", "record_type", "language", "quality_score", "is_accepted", "record_id")


# --- Answers and evaluation --------------------------------------------------------------------------------------


def corpus(spark: SparkSession, sf_dir: str) -> ask.Corpus:
    chunks = as_records(t(spark, sf_dir, "documents")).withColumnRenamed("record_id", "chunk_id").withColumn("index_text",
        F.concat_ws("\n", "title", "content")).withColumns({"document_id": F.lit(None).cast("string"), "page_number": F.lit(None).cast("int")})
    return ask.Corpus(chunks, indexed(spark, sf_dir, chunks, "chunk_id", "index_text"))


@query()
def answer_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Route to cited answer for every benchmark item."""
    return ask.answers(items(spark, sf_dir), corpus(spark, sf_dir), threshold=0.0).select("qid", "status", "answer", "n_sources", "valid", "reason", "model_tier")


@query()
def boosted_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, found = ask.retrieve(items(spark, sf_dir), corpus(spark, sf_dir), scorer=fusion.lexical_score)
    return found.select("qid", "chunk_id", "rank", F.round("final_score", 6).alias("final_score"), F.round("boost_score", 6).alias("boost_score"), "pre_rerank_rank")


_KW = "list_filter(regexp_extract_all(lower(query), '\\*?#?[\\p{L}\\p{N}_][\\p{L}\\p{N}_#*,-]*|[\\x{600}-\\x{6ff}]+'), lambda x: length(x) > 1 AND x NOT IN (" + ", ".join(map(lit, L.STOPWORDS)) + "))"


@query(f"""WITH p AS (SELECT b.item_id, b.text AS query, d.text, list_filter(list_transform(string_split_regex(d.text, '[\\r\\n]+'), lambda x: trim(x)), lambda x: x <> '') AS ls FROM benchmark b JOIN documents d ON d.doc_id = b.item_id),
k AS (SELECT *, {_KW} AS kw FROM p),
c AS (SELECT *, list_filter(ls, lambda x: len(list_filter(kw, lambda w: contains(lower(x), w))) > 0 OR regexp_matches(x, {lit(L.IMPORTANT)})) AS chosen FROM k),
w AS (SELECT item_id, trim('Title: T' || chr(10) || 'Category: C' || chr(10) || 'Record type: R' || chr(10) || array_to_string(CASE WHEN len(chosen) > 0 THEN chosen ELSE list_slice(ls, 1, 8) END, chr(10))) AS w FROM c)
SELECT item_id, CASE WHEN length(w) <= 1200 THEN w ELSE rtrim(substr(w, 1, 1197)) || '...' END AS compressed FROM w""")
def compress_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = t(spark, sf_dir, "benchmark").withColumnRenamed("text",
        "query").join(t(spark, sf_dir, "documents").select(F.col("doc_id").alias("item_id"), "text"),
        "item_id").withColumns({"title": F.lit("T"), "category": F.lit("C"), "record_type": F.lit("R")})
    return pairs.select("item_id", answers.compress(F.col("query"), F.col("text")).alias("compressed"))


@query("""WITH c AS (SELECT conv_id, turn, list_sort(list_distinct(list_transform(regexp_extract_all(text, '\\[([0-9]{1,9})\\]', 1), lambda x: x::INT))) AS ids FROM (SELECT conv_id, turn, text || ' [' || turn || '] [' || conv_id % 7 || ']' AS text FROM conversations))
SELECT conv_id, turn, array_to_string(ids, ',') AS cited, array_to_string(list_filter(ids, lambda x: x NOT IN (1, 2, 3)), ',') AS unknown, len(ids) > 0 AND len(list_filter(ids, lambda x: x NOT IN (1, 2, 3))) = 0 AS valid FROM c""")
def citation_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = F.concat(F.col("text"), F.lit(" ["), F.col("turn"), F.lit("] ["), F.col("conv_id") % 7, F.lit("]"))
    source = F.array(*[F.struct(F.lit(i).alias("source_id"), *[F.lit("").alias(n) for n in ("title", "content", "snippet", "aliases")]) for i in (1, 2, 3)])
    rows = t(spark, sf_dir, "conversations").select("conv_id", "turn", F.lit("").alias("query"), marked.alias("answer"), source.alias("sources"))
    checked = answers.validate(rows)
    return checked.select("conv_id", "turn", F.array_join(X.citation_ids(F.col("answer")), ",").alias("cited"), F.array_join("invalid_citation_ids", ",").alias("unknown"), "valid")


EVAL = f"""WITH {BM25}, sc_pool AS (SELECT doc_id FROM dl), {ranked('sc', 5)},
g AS (SELECT item_id AS qid, CASE WHEN item_id % 5 = 0 THEN 'rejection' END AS expected_route, CASE WHEN item_id % 3 = 0 THEN 'src0' END AS cat, regexp_extract(lower(text), '[a-z]{{6,}}') AS word FROM benchmark),
j AS (SELECT g.*, r.rank, source IS NOT DISTINCT FROM cat OR cat IS NULL AS cok, contains(replace(lower(text), ',', ''), word) AS tok FROM g LEFT JOIN r USING (qid) LEFT JOIN documents ON doc = doc_id),
s AS (SELECT qid, expected_route, CASE WHEN expected_route = 'rejection' THEN 1 ELSE min(rank) FILTER (cok) END AS first, coalesce(bool_or(cok AND rank IS NOT NULL), false) OR any_value(cat IS NULL) AS ch, coalesce(bool_or(tok), false) AS th FROM j GROUP BY qid, expected_route)"""


def evaluated(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, bench = t(spark, sf_dir, "documents"), t(spark, sf_dir, "benchmark")
    i = F.col("item_id")
    golden = bench.select(i.alias("qid"), F.col("text").alias("query"), F.when(i % 5 == 0, "rejection").alias("expected_route"),
        F.lit("retrieval").alias("actual_route"), F.when(i % 3 == 0, "src0").alias("expected_category"),
        F.array(F.regexp_extract(F.lower("text"), "[a-z]{6,}", 0)).alias("expected_contains_any"), F.lit(None).cast("string").alias("expected_citation_contains"))
    found = sparse.search(indexed(spark, sf_dir, docs), items(spark, sf_dir), 5).join(docs.select(F.col("doc_id").alias("doc"), F.col("source").alias("category"), F.col("text").alias("content")), "doc")
    return evaluate.score_retrieval(golden, found.withColumns({"title": F.lit(""), "index_text": F.lit(""), "citation_url": F.lit("")}))


@query(EVAL + " SELECT qid, (expected_route IS NULL) AS route_match, ch AS category_hit, th AS text_hit, first::INT AS first_hit_rank, round(coalesce(1.0 / first, 0), 6)::DOUBLE AS reciprocal_rank FROM s")
def eval_per_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluated(spark, sf_dir).select("qid", "route_match", "category_hit", "text_hit", F.col("first_hit_rank").cast("int").alias("first_hit_rank"), F.round("reciprocal_rank", 6).alias("reciprocal_rank"))


@query(EVAL + " SELECT count(*) AS total_queries, count(*) AS retrieval_queries, round(avg(CASE WHEN expected_route IS NOT NULL THEN 0.0 END), 6) AS route_accuracy, round(avg((first IS NOT NULL)::INT), 6) AS hit_rate, round(avg(ch::INT), 6) AS category_hit, round(avg(th::INT), 6) AS text_hit, 1.0::DOUBLE AS citation_hit, round(avg(coalesce(1.0 / first, 0)), 6)::DOUBLE AS mrr, round(avg(first), 6) AS average_first_rank FROM s")
def eval_hit_mrr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.retrieval_metrics(evaluated(spark, sf_dir))


@query(EVAL + ", o AS (SELECT qid, CASE WHEN qid % 4 <> 0 AND first IS NOT NULL THEN greatest(1, first - 1) END AS other FROM s) SELECT CASE WHEN first IS NULL AND other IS NOT NULL THEN 'improvement' WHEN first IS NOT NULL AND other IS NULL THEN 'regression' WHEN other < first THEN 'improvement' WHEN other > first THEN 'regression' ELSE 'unchanged' END AS result, count(*) AS n FROM s JOIN o USING (qid) GROUP BY 1")
def eval_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs of the same queries, the second with ranks moved up and every fourth query lost."""
    base = evaluated(spark, sf_dir)
    other = base.withColumn("first_hit_rank", F.when(F.col("qid") % 4 != 0, F.when(F.col("first_hit_rank").isNotNull(), F.greatest(F.lit(1), F.col("first_hit_rank") - 1)).otherwise(F.lit(None))))
    return evaluate.compare(base, other).groupBy("result").agg(F.count(F.lit(1)).alias("n"))


# --- Events ---------------------------------------------------------------------------------------------------------


@query("SELECT time_bucket(INTERVAL 5 MINUTE, ts) AS window_start, event_type, count(*) AS n, round(count(*) / 300.0, 6)::DOUBLE AS per_second, round(sum(value) / count(*), 6) AS mean_value FROM events GROUP BY 1, 2")
def event_rates_5m(spark: SparkSession, sf_dir: str) -> DataFrame:
    return observe.rates(t(spark, sf_dir, "events"))


@query("SELECT event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1")
def event_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return observe.counters(t(spark, sf_dir, "events")).withColumn("total", F.round("total", 4))


@query("SELECT event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, value DESC) = 1")
def event_gauges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return observe.gauges(t(spark, sf_dir, "events"))


@query("SELECT event_type, le::DOUBLE AS le, count(*) FILTER (value <= le) AS n FROM events, (SELECT unnest([0.1, 0.5, 1, 5, 10, 50, 100, 'inf'::DOUBLE]) AS le) GROUP BY ALL")
def event_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return observe.histogram(t(spark, sf_dir, "events"))


# --- More text, set and window operators ----------------------------------------------------------------------------


@query(f"""SELECT doc_id, sha256(array_to_string(list_filter(list_transform(string_split_regex(coalesce(text, ''), {lit(X.LINE_END)}), lambda x: {squeeze('x')}), lambda x: x <> ''), chr(10))) AS cleaned,
  sha256({squeeze("replace(replace(replace(replace(replace(lower(coalesce(text, '')), ',', ''), 'egp', 'le'), 'جنيه', 'le'), 'قروش', 'pt'), '#550*', '*550#')")}) AS match_text, sha256(regexp_replace(coalesce(text, ''), '[^A-Za-z0-9._-]+', '_', 'g')) AS file_name FROM documents""")
def clean_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("text")
    return t(spark, sf_dir, "documents").select("doc_id", F.sha2(X.clean_text(c), 256).alias("cleaned"), F.sha2(X.match_text(c), 256).alias("match_text"), F.sha2(X.file_name(c), 256).alias("file_name"))


_TOK = "list_distinct(regexp_extract_all(lower(text), '[a-z]+'))"


@query(f"""WITH c AS (SELECT conv_id, turn, {_TOK} AS ws FROM conversations)
SELECT conv_id, turn, array_to_string(list_sort(list_filter(ws, lambda x: x IN ('the', 'of', 'and', 'in', 'to'))), ',') AS common, len(list_filter(ws, lambda x: x NOT IN ('the', 'of', 'and', 'in', 'to')))::INT AS others, len(list_filter(ws, lambda x: x NOT IN ('the', 'of', 'and', 'in', 'to'))) = 0 AS within FROM c""")
def array_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intersection, difference and subset of small sets."""
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0)))
    few = F.array(*map(F.lit, ("the", "of", "and", "in", "to")))
    return t(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(F.array_sort(F.array_intersect(words, few)), ",").alias("common"),
        F.size(F.array_except(words, few)).alias("others"), dedupe.subset(words, few).alias("within"))


@query("""WITH b AS (SELECT conv_id, turn, '[' || turn || '] ' || role || chr(10) || text AS block FROM conversations),
u AS (SELECT *, coalesce(sum(length(block)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM b)
SELECT conv_id AS qid, sha256(string_agg(substr(block, 1, (600 - used)::INT), chr(10) || chr(10) ORDER BY turn)) AS context FROM u WHERE used < 600 GROUP BY conv_id""")
def context_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbered blocks under a running character budget, the last one cut."""
    rows = t(spark, sf_dir, "conversations").select(F.col("conv_id").alias("qid"), F.col("turn").alias("source_id"), F.col("role").alias("citation_label"), F.col("text").alias("content"))
    return answers.context(rows, 600).select("qid", F.sha2("context", 256).alias("context"))


@query(f"""WITH l AS (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)),
k AS (SELECT doc_id, i, ls[i] AS line, {key('ls[i]')} AS k FROM l), p AS (SELECT *, lag(k) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM k)
SELECT doc_id, count(*)::INT AS n_kept, sha256(string_agg(line, chr(10) ORDER BY i)) AS kept FROM p WHERE before IS NULL OR before <> k GROUP BY doc_id""")
def drop_repeated_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines equal (by key) to the one before go."""
    kept = dedupe.drop_repeats(F.split(X.text(F.col("text")), "\n"))
    return t(spark, sf_dir, "documents").select("doc_id", kept.alias("k")).select("doc_id", F.size("k").alias("n_kept"), F.sha2(F.array_join("k", "\n"), 256).alias("kept"))


@query("SELECT vec_id AS doc FROM embeddings WHERE NOT (vec_id % 2 = 0 AND label % 3 = 1)")
def delete_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All but one session's uploads."""
    rows = t(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc"),
        F.when(F.col("vec_id") % 2 == 0, "user_upload").otherwise("official_website").alias("source_type"),
        (F.col("label") % 3).cast("string").alias("upload_session_id"))
    return dense.delete_session(rows, "1").select("doc")


@query("""WITH p AS (SELECT conv_id, turn, string_split(trim(regexp_replace(text, '[ \t\n\r]+', ' ', 'g')), ' ') AS ws FROM conversations),
c AS (SELECT *, unnest(range(0, len(ws), 40)) AS i FROM p)
SELECT 'conv-' || conv_id AS document_id, turn::INT AS page_number, count(*) AS n FROM c GROUP BY ALL""")
def upload_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as uploaded documents of one page a turn: chunks a page, the index running on across pages."""
    words = F.filter(F.split(X.squeeze(F.col("text")), " "), lambda w: w != "")
    rows = t(spark, sf_dir, "conversations").select(F.concat(F.lit("conv-"), F.col("conv_id")).alias("document_id"),
        F.col("turn").cast("int").alias("page_number"), F.explode(chunking.word_windows(F.array_join(words, " "), 40)).alias("chunk"))
    return rows.groupBy("document_id", "page_number").agg(F.count(F.lit(1)).alias("n"))


@query()
def upload_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = t(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct(F.col("turn").cast("int").alias("page_number"), "text"))).alias("pages"))
    docs = turns.select(F.concat(F.lit("conv-"), F.col("conv_id")).alias("document_id"), F.lit("Talk").alias("title"), F.lit("talk.txt").alias("file_name"), F.lit("txt").alias("file_type"), F.lit("").alias("text"), "pages")
    return chunking.chunk_uploads(docs, 64, 8).select("chunk_id", "document_id", "page_number", "chunk_index", "total_chunks")


@query()
def page_downloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.downloads(html.parsed(t(spark, sf_dir, "pages"))).select("page_id", "url", "kind")


@query()
def page_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cards of any content, as corporate sections take them."""
    return html.cards(html.parsed(t(spark, sf_dir, "pages"), "section"), "section")


@query()
def page_people(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.people(html.parsed(t(spark, sf_dir, "pages")))


@query("SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.9), 6) AS p90, round(quantile_cont(value, 0.99), 6) AS p99 FROM events GROUP BY 1")
def event_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exact form; dashboards over large tables take the approximate one."""
    return observe.quantiles(t(spark, sf_dir, "events"), exact=True).select("event_type", *[F.round(c, 6).alias(c) for c in ("p50", "p90", "p99")])


@query()
def both_sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions to official pages and uploads together: each side's list is its own, and all are fused."""
    whole = corpus(spark, sf_dir)
    side = F.when(F.col("category").isin("src0", "src1", "src2"), "user_upload").otherwise("official_website")
    split = ask.Corpus(whole.chunks.withColumn("source_type", side), whole.sparse)
    _, found = ask.retrieve(items(spark, sf_dir).withColumn("mode", F.lit("both")), split, mode="mode")
    return found.select("qid", "chunk_id", "rank", "source_type", F.round("final_score", 6).alias("final_score"))


_TYPES = ("faq", "product", "service_detail", "service_code", "service_fee", "subscription_method", "package", "package_tier", "package_price",
    "yearly_package", "add_on", "payment_channels", "salefny_rule", "renewal_rule", "early_renewal_rule", "hardware", "table_row")


@query("""SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '[\\p{L}\\p{N}_\\x{600}-\\x{6ff}]+|[*#][\\p{L}\\p{N}_*#]+|[\\p{L}\\p{N}_*]+#')) <= 100 OR doc_id % 17 NOT IN (2, 5) AS atomic FROM documents""")
def atomic_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short records and those of 15 types are never split; `service_detail` and `subscription_method` are."""
    kind = F.element_at(F.array(*map(F.lit, _TYPES)), (F.col("doc_id") % 17 + 1).cast("int"))
    rows = t(spark, sf_dir, "documents").select("doc_id", X.text(F.col("text")).alias("content"), F.lit("note").alias("category"), kind.alias("record_type"))
    return rows.select("doc_id", chunking.is_atomic(100).alias("atomic"))


@query("""SELECT doc_id, (len(list_distinct(list_filter(list_transform(regexp_extract_all(coalesce(text, ''), '\\*\\s*\\p{Nd}+(?:\\s*\\*\\s*[\\p{L}\\p{M}\\p{N}_\\x{600}-\\x{6ff}]+)*\\s*#?'), lambda x: regexp_replace(x, '\\s+', '', 'g')), lambda x: x LIKE '%#')))
  + len(regexp_extract_all(coalesce(text, ''), '(?i)\\p{Nd}[\\p{Nd},]*(?:\\.\\p{Nd}+)?[ \\t\\r\\n]*(?:egp|le|pt|gb|mbps|جنيه|قرش|قروش)')))::INT AS n_values,
  CASE WHEN regexp_matches(lower(text), '\\p{Nd}+[ \\t\\r\\n]*(day|days|يوم|أيام|ايام)') THEN regexp_extract(lower(text), '(\\p{Nd}+)[ \\t\\r\\n]*(day|days|يوم|أيام|ايام)', 1)::INT WHEN regexp_matches(lower(text), 'month|شهر') THEN 30 WHEN regexp_matches(lower(text), 'week|أسبوع|اسبوع') THEN 7 WHEN regexp_matches(lower(text), '24 hours|24 ساعة') THEN 1 END AS validity_days FROM documents""")
def value_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("text")
    return t(spark, sf_dir, "documents").select("doc_id", F.size(P.value_signature(c)).alias("n_values"), P.validity(c)["days"].alias("validity_days"))


@query("""SELECT conv_id AS qid, turn::INT AS rank, '' AS chunk_id, role AS title, text AS content, '' AS citation_url, 'talk.txt' AS file_name, CASE WHEN turn % 2 = 0 THEN 'Talk' END AS citation_label, 'official_website' AS source_type, 'Official website' AS source_name, 0 AS chunk_index, 1 AS total_chunks, 'bm25' AS retriever, turn::DOUBLE AS bm25_score, NULL::DOUBLE AS dense_score, 0.0::DOUBLE AS final_score FROM conversations""")
def normalized_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as rows of a ranked list, in the shape that all retrievers share."""
    meta = F.create_map(F.lit("file_name"), F.lit("talk.txt"))
    rows = t(spark, sf_dir, "conversations").select(F.col("conv_id").alias("qid"), F.col("turn").alias("rank"), F.col("turn").cast("double").alias("score"),
        F.col("role").alias("title"), F.col("text").alias("content"), F.lit("").alias("file_name"),
        F.when(F.col("turn") % 2 == 0, "Talk").otherwise("").alias("citation_label"), meta.alias("metadata"))
    return results.normalize(rows, "bm25").select("qid", "rank", "chunk_id", "title", "content", "citation_url", "file_name", "citation_label", "source_type",
        "source_name", "chunk_index", "total_chunks", "retriever", "bm25_score", "dense_score", "final_score")


@query("""WITH g AS (SELECT item_id AS qid, regexp_extract(lower(text), '[a-z]{6,}') AS word FROM benchmark), a AS (SELECT doc_id AS qid, coalesce(text, '') AS answer FROM documents),
s AS (SELECT g.qid, a.qid IS NOT NULL AND g.qid % 2 = 0 AS valid, contains(replace(lower(coalesce(answer, '')), ',', ''), word) AS hit, g.qid % 5 <> 0 OR a.qid % 3 = 0 AS cited, coalesce(a.qid % 3 = 0, false) AS fallback FROM g LEFT JOIN a USING (qid))
SELECT count(*) AS total, round(avg(valid::INT), 6) AS valid, round(avg(hit::INT), 6) AS text_hit, round(avg(coalesce(cited, false)::INT), 6) AS citation_hit, count(*) FILTER (fallback) AS fallbacks FROM s""")
def eval_generation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as answers to the benchmark items of their number; every third is a fallback with its source listed."""
    i = F.col("item_id")
    golden = t(spark, sf_dir, "benchmark").select(i.alias("qid"), F.array(F.regexp_extract(F.lower("text"), "[a-z]{6,}", 0)).alias("expected_contains_any"), F.when(i % 5 == 0, "example.com").alias("expected_citation_contains"))
    d = F.col("doc_id")
    made = t(spark, sf_dir, "documents").select(d.alias("qid"), F.coalesce("text", F.lit("")).alias("answer"),
        F.when(d % 3 == 0, "fallback").otherwise("generated").alias("status"), (d % 2 == 0).alias("valid"),
        F.when(d % 3 == 0, "Sources: https://example.com").otherwise("").alias("answer_with_sources"))
    return evaluate.generation_metrics(evaluate.score_generation(golden, made))


@query("SELECT 'document count ' || count(*) || ', manifest 1' AS warning FROM documents UNION ALL SELECT 'tokenizer v1, manifest v2'")
def index_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index held against a manifest that promises something else."""
    return sparse.check_manifest(indexed(spark, sf_dir, t(spark, sf_dir, "documents")), 1, "v1", "v2")


@query("SELECT page_id, 'p' || page_id || ['.pdf', '.TXT', '.exe', ''][(page_id % 4 + 1)::INT] AS path, page_id * 1000000 AS length FROM pages WHERE page_id % 4 IN (0, 1) AND page_id * 1000000 <= 26214400")
def upload_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of an allowed type and of 25 MB at most."""
    i = F.col("page_id")
    ending = F.element_at(F.array(*map(F.lit, (".pdf", ".TXT", ".exe", ""))), (i % 4 + 1).cast("int"))
    return chunking.admit(t(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("p"), i, ending).alias("path"), (i * 1000000).alias("length")))


@query("SELECT count(*) FILTER (doc_id % 9 <> 0) AS pages_fetched, count(*) FILTER (doc_id % 9 = 0) AS failed_urls, string_agg(DISTINCT source, ',' ORDER BY source) AS sections, count(*) AS records_extracted, count(*) FILTER (doc_id % 4 <> 1) AS records_accepted, count(*) FILTER (doc_id % 4 = 1) AS records_rejected FROM documents")
def pipeline_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    docs = t(spark, sf_dir, "documents")
    return observe.pipeline_totals(docs.select(F.col("source").alias("section"), (d % 9 == 0).alias("failed")), docs.select("source", F.when(d % 4 != 1, True).alias("is_accepted")))


# --- Stored indexes -------------------------------------------------------------------------------------------------


@query(SQL["dense_topk"])
def vector_index_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vectors nearest to every twentieth one, from an inverted-file index: few cells first, then those that could hold better ones."""
    vectors = t(spark, sf_dir, "embeddings")
    index = vector_index.build(vectors, shared_dir(spark, "vector-index"))
    asked = vectors.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), "embedding")
    return vector_index.search(index, asked, 10, exact=True).select("qid", "doc", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query(SQL["bm25_topk"])
def bm25_block_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best ten documents for each benchmark item, from block-max postings."""
    index = block_index.build(indexed(spark, sf_dir, t(spark, sf_dir, "documents")), shared_dir(spark, "block-index"))
    return block_index.search(index, items(spark, sf_dir), 10).select("qid", "doc", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query(f"""WITH toks AS (SELECT conv_id AS s, turn AS d, {tokens('text')} AS ts FROM conversations),
dl AS (SELECT s, d, len(ts) AS dl FROM toks), tot AS (SELECT s, count(*) AS n, avg(dl) AS avgdl FROM dl GROUP BY s),
post AS (SELECT s, d, term, count(*) AS tf FROM (SELECT s, d, unnest(ts) AS term FROM toks) GROUP BY ALL),
raw AS (SELECT s, term, ln(n - count(*) + 0.5) - ln(count(*) + 0.5) AS r FROM post JOIN tot USING (s) GROUP BY s, term, n),
idf AS (SELECT s, term, CASE WHEN r < 0 THEN 0.25 * avg(r) OVER (PARTITION BY s) ELSE r END AS idf FROM raw),
q AS (SELECT s, term, count(*) AS qtf FROM (SELECT s, unnest({tokens('query')}) AS term FROM (SELECT conv_id AS s, arg_max(text, turn) AS query FROM conversations WHERE role = 'user' GROUP BY conv_id)) GROUP BY ALL),
sc AS (SELECT s, d, qtf * idf * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / avgdl)) AS w FROM q JOIN idf USING (s, term) JOIN post USING (s, term) JOIN dl USING (s, d) JOIN tot USING (s)
  UNION ALL SELECT s, d, 0.0 FROM dl WHERE s IN (SELECT s FROM q)),
f AS (SELECT s, d, sum(w) AS score FROM sc GROUP BY ALL)
SELECT s AS session, d AS turn, round(score, 6) AS score, row_number() OVER (PARTITION BY s ORDER BY round(score, 9) DESC, d) AS rank FROM f QUALIFY rank <= 3""")
def session_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation's last question against its own turns, with the conversation's own statistics."""
    talk = t(spark, sf_dir, "conversations")
    asked = talk.filter("role = 'user'").groupBy("conv_id").agg(F.max_by("text", "turn").alias("query")).select(F.col("conv_id").alias("session"), F.col("conv_id").alias("qid"), "query")
    found = session_index.search(session_index.build(talk, "conv_id", "turn", "text"), asked, 3)
    return found.select("session", F.col("doc").alias("turn"), F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


# --- Keyed tables and jobs --------------------------------------------------------------------------------------------


@query("""SELECT vec_id, rev FROM (SELECT vec_id, CASE WHEN vec_id % 3 = 0 OR vec_id % 2 = 0 THEN label + 1000 ELSE label END AS rev, label FROM embeddings) WHERE label % 5 <> 4""")
def keyed_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two upserts and a delete, each a version of a keyed table, read back."""
    rows = t(spark, sf_dir, "embeddings").select("vec_id", F.col("label").alias("rev"), "label")
    table = KeyedTable(spark, shared_dir(spark, "keyed-table"))
    table.create(rows.schema, "vec_id", 16)
    table.upsert(rows.filter("vec_id % 3 <> 0"))
    table.upsert(rows.filter("vec_id % 3 = 0 OR vec_id % 2 = 0").withColumn("rev", F.col("rev") + 1000))
    table.delete(F.col("label") % 5 == 4)
    return table.read().select("vec_id", "rev")


def letters_provider():
    """Vectors of three counts; refuses texts of a length that seven divides, and each batch that holds one."""

    def call(texts: list[str]) -> list[list[float]]:
        if any(len(x) % 7 == 0 for x in texts):
            raise ValueError("seven")
        return [[float(len(x)), float(x.count("e")), float(x.count(" "))] for x in texts]

    return call


@query("""SELECT conv_id * 100000 + turn AS key, CASE WHEN length(text) % 7 <> 0 THEN length(text) || ',' || length(replace(text, 'e', 'ee')) - length(text) || ',' || length(replace(text, ' ', '  ')) - length(text) END AS counts,
  CASE WHEN length(text) % 7 = 0 THEN 'ValueError: seven' END AS error FROM (SELECT conv_id, turn, coalesce(text, '') AS text FROM conversations)""")
def embedding_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A vector for each turn, or its dead letter, from a provider that fails: in two rounds, then once more from the memo alone."""
    rows = t(spark, sf_dir, "conversations").select((F.col("conv_id") * 100000 + F.col("turn")).alias("key"), "text")
    folder = shared_dir(spark, "embedding-job")
    how = {"key": "key", "text": "text", "retries": 0, "delay": 0.0, "buckets": 16}
    provider_jobs.embed(rows, letters_provider, folder, 3, rounds=2, **how)
    found = provider_jobs.embed(rows, letters_provider, folder, 3, **how)
    return found.select("key", F.array_join(F.transform("embedding", lambda x: x.cast("long").cast("string")), ",").alias("counts"), "error")


def tier_provider(odd: int, fails: int):
    """Cites its source unless `odd` divides the prompt's length; fails where `fails` does."""

    def make():
        def call(prompts: list[str]) -> list[str]:
            if any(len(p) % fails == 0 for p in prompts):
                raise RuntimeError("busy")
            return [f"{len(p)} letters" + ("" if len(p) % odd == 0 else " [1]") for p in prompts]

        return call

    return make


@query("""WITH b AS (SELECT item_id AS qid, length(coalesce(text, '')) AS n, item_id % 3 AS k FROM benchmark),
s AS (SELECT *, k = 0 AND n % 5 <> 0 AND n % 2 <> 0 AS small, k <= 1 AND n % 7 <> 0 AND n % 3 <> 0 AS medium, n % 11 <> 0 AND n % 1009 <> 0 AS large FROM b)
SELECT qid, CASE WHEN small OR medium OR large THEN n || ' letters [1]' END AS answer, CASE WHEN small THEN 'small' WHEN medium THEN 'medium' WHEN large THEN 'large' END AS model_tier,
  (CASE WHEN small THEN 1 WHEN medium THEN 2 - (k > 0)::INT ELSE 3 - k END)::BIGINT AS n_attempts FROM s""")
def tiered_generation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items put to model tiers in turn: a tier that fails, or whose answer cites nothing, hands on to the next."""
    source = F.array(F.struct(F.lit(1).alias("source_id"), *[F.lit("").alias(n) for n in ("title", "content", "snippet", "aliases")]))
    every = F.array(*map(F.lit, ("small", "medium", "large")))
    asked_ = t(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.lit("").alias("query"), F.coalesce("text", F.lit("")).alias("prompt"),
        F.slice(every, (F.col("item_id") % 3 + 1).cast("int"), 3).alias("tiers"), source.alias("sources"))
    tiers = {"small": tier_provider(2, 5), "medium": tier_provider(3, 7), "large": tier_provider(1009, 11)}
    given, attempts = provider_jobs.generate(asked_, tiers, retries=0, delay=0.0)
    return asked_.select("qid").join(given, "qid", "left").join(attempts.groupBy("qid").agg(F.count(F.lit(1)).alias("n_attempts")), "qid")


@query("SELECT event_type, count(*) AS n, round(sum(value), 4) AS total, arg_max(value, (ts, value)) AS value FROM events GROUP BY 1")
def streamed_gauges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters and gauges as a stream keeps them in its state: equal to those of the table."""
    events = t(spark, sf_dir, "events")
    folder = shared_dir(spark, "gauges")
    stream = spark.readStream.schema(events.schema).parquet(f"{sf_dir}/events.parquet*")
    gauges.keep_gauges(stream.withColumn("ts", F.col("ts").cast("timestamp")), f"{folder}/table", f"{folder}/checkpoint").awaitTermination()
    return gauges.read_gauges(spark, f"{folder}/table").select("event_type", "n", F.round("total", 4).alias("total"), "value")


@query("SELECT event_type, count(*) AS n, true AS users_close, true AS median_close FROM events GROUP BY 1")
def event_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly sketches merged over all hours, held against exact counts: distinct users within 5 %, the median within 2 % of the ranks."""
    events = t(spark, sf_dir, "events")
    read = observe.read_sketches(observe.merge_sketches(observe.sketches(events), [F.col("event_type")]), (0.48, 0.5, 0.52))
    exact = events.groupBy("event_type").agg(F.countDistinct("user_id").alias("exact_users"), *[F.percentile("value", p).alias(f"exact_{round(p * 100)}") for p in (0.47, 0.53)])
    close = F.abs(F.col("users") - F.col("exact_users")) <= 0.05 * F.col("exact_users")
    return read.join(exact, "event_type").select("event_type", "n", close.alias("users_close"), F.col("p50").between(F.col("exact_47"), F.col("exact_53")).alias("median_close"))


def length_scorer():
    """A reranker of pairs by their lengths; refuses candidates of a length that eleven divides, and each batch that holds one."""

    def call(pairs: list[tuple[str, str]]) -> list[float]:
        if any(len(c) % 11 == 0 for _, c in pairs):
            raise RuntimeError("eleven")
        return [len(q) / (len(q) + len(c) + 1) for q, c in pairs]

    return call


@query(f"""WITH {BM25}, sc_pool AS (SELECT doc_id FROM dl), {ranked('sc', 10)},
p AS (SELECT qid, doc, rank AS before, length(coalesce(b.text, '')) AS nq, length(coalesce(d.text, '')) AS nc FROM r JOIN documents d ON doc = doc_id JOIN benchmark b ON qid = item_id)
SELECT qid, doc, before AS pre_rerank_rank, CASE WHEN nc % 11 <> 0 THEN round(nq / (nq + nc + 1), 6) END::DOUBLE AS reranker_score,
  row_number() OVER (PARTITION BY qid ORDER BY CASE WHEN nc % 11 <> 0 THEN nq / (nq + nc + 1) END DESC NULLS LAST, before) AS rank FROM p""")
def batched_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten documents for each benchmark item through a model that fails for some: those pass with a null score, behind the others."""
    docs = t(spark, sf_dir, "documents")
    found = sparse.search(indexed(spark, sf_dir, docs), items(spark, sf_dir), 10).join(items(spark, sf_dir), "qid").join(docs.select(F.col("doc_id").alias("doc"), "text"), "doc").withColumn("final_score", F.col("score"))
    out = provider_jobs.rerank(found, length_scorer, F.col("text"), key="doc")
    return out.select("qid", "doc", F.col("pre_rerank_rank").cast("long").alias("pre_rerank_rank"), F.round("reranker_score", 6).alias("reranker_score"), F.col("rank").cast("long").alias("rank"))


_ENTITIES = "replace(replace(replace(replace({0}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&amp;', '&')"


@query(f"""SELECT page_id, coalesce(nullif(trim({_ENTITIES.format("regexp_extract(html, '<title>([^<]*)</title>', 1)")}), ''), 'p' || page_id) AS title, NULL::VARCHAR AS error FROM pages""")
def document_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages written out, each as an HTML file, and read back as documents."""
    folder = shared_dir(spark, "documents-html")
    # The tag keeps a file's name from being any page's title.
    files = t(spark, sf_dir, "pages").select(F.concat(F.lit("page_id="), F.coalesce(F.col("page_id").cast("string"), F.lit("none"))).alias("name"), F.coalesce("html", F.lit("")).alias("value"))
    sinks.text_files(files, folder, tag=uuid.uuid4().hex)
    found = readers.html_documents(spark, folder, ending=r"\.txt$")
    number = F.nullif(F.regexp_extract("path", "page_id=(-?[0-9]*)", 1), F.lit("")).cast("long")
    return found.select(number.alias("page_id"), F.when(F.col("title") == F.col("document_id"), F.concat(F.lit("p"), number)).otherwise(F.col("title")).alias("title"), "error")


for _name, (_f, _sql) in page_queries.QUERIES.items():
    query(_sql)(_f)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


