"""Jobs that ask a provider, a service that may fail: embeddings with a memo and dead letters, and answers tier by tier."""

from __future__ import annotations

import math
import time
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.answers import validate
from ..sources.keyed import KeyedTable
from ..sources.shared import stored

MEMO = T.StructType([T.StructField("digest", T.StringType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("made_at", T.TimestampType())])
DEAD = T.StructType([T.StructField("digest", T.StringType()), T.StructField("error", T.StringType()), T.StructField("attempts", T.IntegerType()), T.StructField("made_at", T.TimestampType())])

Answer = tuple[object | None, str | None, int]


def patiently(call: Callable[[list[str]], Sequence], texts: list[str], retries: int, delay: float, batch: int) -> list[Answer]:
    """(result, error, attempts) for each text: batches, tried `retries` more times after growing pauses, then text by text in the same way.

    A reply of the wrong length counts as a failure.  A text that fails alone too keeps its last error, and costs no other text.
    """

    def tries(some: list[str]) -> tuple[list | None, str | None, int]:
        error = None
        for attempt in range(retries + 1):
            try:
                found = list(call(some))
                if len(found) == len(some):
                    return found, None, attempt + 1
                error = f"{len(found)} results for {len(some)} texts"
            except Exception as e:  # whatever a provider raises is its failure, not the job's
                error = f"{type(e).__name__}: {e}"
            if attempt < retries:
                time.sleep(delay * 2**attempt)
        return None, error, retries + 1

    out: list[Answer] = []
    for at in range(0, len(texts), batch):
        some = texts[at : at + batch]
        found, error, n = tries(some)
        if found is not None:
            out += [(f, None, n) for f in found]
        elif len(some) == 1:
            out.append((None, error, n))
        else:
            for s in some:
                one, why, more = tries([s])
                out.append((one[0] if one is not None else None, why, n + more))
    return out


def asked(rows: DataFrame, provider: Callable[[], Callable[[list[str]], Sequence]], result: T.DataType, check: Callable[[object], str | None], retries: int, delay: float, batch: int) -> DataFrame:
    """(key, result, error, attempts) for rows (key, text); provider() runs once a task and gives the function that is called."""
    schema = T.StructType([T.StructField("key", rows.schema[0].dataType), T.StructField("result", result), T.StructField("error", T.StringType()), T.StructField("attempts", T.IntegerType())])
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        call = provider()
        for part in batches:
            got = patiently(call, [s or "" for s in part.column(1).to_pylist()], retries, delay, batch)
            checked = [(r, e or check(r), n) for r, e, n in got]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([None if e else r for r, e, _ in checked], arrow.field("result").type), pa.array([e for _, e, _ in checked], pa.string()), pa.array([n for *_, n in checked], pa.int32())],
                schema=arrow)

    return rows.mapInArrow(run, schema)


def wrong_vector(dimension: int) -> Callable[[object], str | None]:
    def check(v: object) -> str | None:
        if v is None:
            return "no vector"
        if len(v) != dimension:
            return f"dimension {len(v)}, expected {dimension}"
        return None if all(math.isfinite(x) for x in v) else "a number that is not finite"

    return check


def opened(table: KeyedTable, schema: T.StructType, key: str, buckets: int) -> KeyedTable:
    if not table.versions():
        table.create(schema, key, buckets)
    return table


def embed(rows: DataFrame, provider: Callable[[], Callable[[list[str]], Sequence]], folder: str, dimension: int, key: str = "chunk_id",
    text: str = "index_text", batch: int = 16, retries: int = 3, delay: float = 0.5, rounds: int = 1, expires: str | None = None, again: bool = False,
    buckets: int = 64) -> DataFrame:
    """(key, embedding, error): a vector for each row, or why there is none.

    Two keyed tables lie in the folder.  The memo holds a vector for each text's SHA-256: equal texts are asked once, and texts of an
    earlier run not at all, unless older than `expires` (an interval such as '30 days').  Dead letters hold the texts that kept failing;
    they are asked again if `again` says so.  The work is split into rounds by digest, each committed by itself, so a job that is
    killed starts again with what no committed round has.

    Null texts are empty texts; a table without rows calls nothing.
    """
    spark = rows.sparkSession
    memo, dead = opened(KeyedTable(spark, f"{folder}/memo"), MEMO, "digest", buckets), opened(KeyedTable(spark, f"{folder}/dead"), DEAD, "digest", buckets)
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    texts = rows.select(F.sha2(body, 256).alias("digest"), body.alias("text")).dropDuplicates(["digest"])
    fresh = memo.read() if expires is None else memo.read().filter(F.col("made_at") >= F.current_timestamp() - F.expr(f"INTERVAL {expires}"))
    open_ = texts.join(fresh.select("digest"), "digest", "left_anti")
    if not again:
        open_ = open_.join(dead.read().select("digest"), "digest", "left_anti")
    open_ = stored(open_, "embed-open")
    for i in range(rounds):
        part = open_.filter(F.pmod(F.xxhash64("digest"), F.lit(rounds)) == i)
        if not part.head(1):
            continue
        got = stored(asked(part.select("digest", "text"), provider, MEMO["embedding"].dataType, wrong_vector(dimension), retries, delay, batch).withColumnRenamed("key", "digest").withColumn("made_at", F.current_timestamp()), "embed-got")
        good, bad = got.filter("error IS NULL"), got.filter("error IS NOT NULL")
        memo.upsert(good.select("digest", F.col("result").alias("embedding"), "made_at"))
        if bad.head(1):
            dead.upsert(bad.select("digest", "error", "attempts", "made_at"))
        if again:
            done = good.select("digest").join(dead.read().select("digest"), "digest", "left_semi")
            dead.drop(done)
    known = memo.read().select("digest", "embedding", F.lit(None).cast("string").alias("error"))
    failed = dead.read().select("digest", F.lit(None).cast(MEMO["embedding"].dataType).alias("embedding"), "error").join(memo.read().select("digest"), "digest", "left_anti")
    return rows.select(F.col(key).alias("key"), F.sha2(body, 256).alias("digest")).join(known.unionByName(failed), "digest", "left").select("key", "embedding", "error")


def rerank(rows: DataFrame, provider: Callable[[], Callable[[list[tuple[str, str]]], Sequence[float]]], candidate: Column, query: str = "query",
    key: str = "chunk_id", batch: int = 16, retries: int = 0, delay: float = 0.5, top_k: int | None = None) -> DataFrame:
    """rows (qid, key, query, rank, final_score ...) by a model's scores: reranker_score, rerank_error, pre_rerank_rank, pre_rerank_score, and a new rank.

    The model gets batches of (query, candidate text) pairs.  A pair that keeps failing, or whose score is no number, passes
    through with a null score: behind its query's scored rows and in the order it had, so that a model that is down changes no order.
    Only ids and texts reach the workers, and only ids and scores come back.  Rows of one query that repeat a key share a score.
    """
    pairs = stored(rows.select("qid", key, F.coalesce(F.col(query), F.lit("")).alias("q"), F.coalesce(candidate, F.lit("")).alias("c")).dropDuplicates(["qid", key]), "rerank-pairs")
    schema = T.StructType([pairs.schema["qid"], pairs.schema[key], T.StructField("reranker_score", T.DoubleType()), T.StructField("rerank_error", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        call = provider()
        for part in batches:
            got = patiently(call, list(zip(part.column(2).to_pylist(), part.column(3).to_pylist())), retries, delay, batch)
            fine = [(float(s), None) if e is None and s is not None and math.isfinite(s) else (None, e or "no score") for s, e, _ in got]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([s for s, _ in fine], pa.float64()), pa.array([e for _, e in fine], pa.string())], [f.name for f in schema])

    scored = stored(pairs.mapInArrow(run, schema), "rerank-scores")
    out = rows.join(scored, ["qid", key]).withColumns({"pre_rerank_rank": F.col("rank"), "pre_rerank_score": F.col("final_score")})
    out = out.withColumn("final_score", F.coalesce("reranker_score", "final_score"))
    out = out.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc_nulls_last("reranker_score"), "pre_rerank_rank")))
    return out if top_k is None else out.filter(F.col("rank") <= top_k)


def generate(questions: DataFrame, providers: dict[str, Callable[[], Callable[[list[str]], Sequence[str]]]], tiers: str = "tiers", retries: int = 1, delay: float = 0.5, batch: int = 8) -> tuple[DataFrame, DataFrame]:
    """(answers, attempts) of questions (qid, query, prompt, tiers array<string>, sources as `answers.validate` takes them).

    Each question is put to its first tier; those whose call fails, or whose answer fails the grounding check, go on to their next tier.
    answers: qid, answer, model_tier, one row for each question that some tier has answered.  attempts: qid, place, model_tier, outcome
    (ok, the failed check, or the error).  A tier without a provider counts as failed.  There are as many rounds as the longest list
    of tiers, and each asks the provider of every tier in use once for each batch of its own questions.
    """
    left = stored(questions, "generate-open")
    longest = left.agg(F.max(F.size(tiers))).first()[0] or 0
    schema = T.StructType([T.StructField("qid", left.schema["qid"].dataType), T.StructField("place", T.IntegerType()),
        T.StructField("model_tier", T.StringType()), T.StructField("answer", T.StringType()), T.StructField("outcome", T.StringType())])
    every = left.sparkSession.createDataFrame([], schema)
    for place in range(longest):
        now = left.withColumn("model_tier", F.get(tiers, F.lit(place))).filter("model_tier IS NOT NULL")
        parts = [asked(now.filter(F.col("model_tier") == tier).select("qid", "prompt"), provider, T.StringType(), lambda r: None if r else "empty answer", retries, delay, batch).withColumn("t", F.lit(tier)) for tier,
            provider in sorted(providers.items())]
        got = now.filter(~F.col("model_tier").isin(*providers)).select(F.col("qid").alias("key"), F.lit(None).cast("string").alias("result"), F.lit("no provider").alias("error"), F.lit(0).alias("attempts"), F.col("model_tier").alias("t"))
        for part in parts:
            got = got.unionByName(part)
        replies = stored(got.select(F.col("key").alias("qid"), F.col("result").alias("answer"), "error", F.col("t").alias("model_tier")), "generate-replies")
        judged = validate(replies.join(left.select("qid", "query", "sources"), "qid"))
        outcome = F.when(F.col("error").isNotNull(), F.col("error")).otherwise(F.col("reason"))
        round_ = stored(judged.select("qid", F.lit(place).alias("place"), "model_tier", "answer", outcome.alias("outcome")), "generate-round")
        every = every.unionByName(round_)
        left = left.join(round_.filter("outcome = 'ok'").select("qid"), "qid", "left_anti")
        if place + 1 < longest:
            left = stored(left, "generate-open")
    return every.filter("outcome = 'ok'").select("qid", "answer", "model_tier"), every.select("qid", "place", "model_tier", "outcome")
