import os
import time

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnwater.plans import provider_jobs
from tarnwater.sources.keyed import Conflict, KeyedTable
from tarnwater.sources.shared import shared_dir

ROWS = "id long, name string, n int"


@pytest.fixture
def table(spark):
    made = KeyedTable(spark, shared_dir(spark, "keyed"))
    made.create(T.StructType([T.StructField("id", T.LongType()), T.StructField("name", T.StringType()), T.StructField("n", T.IntegerType())]), "id", 8)
    return made


def content(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_upserts_and_deletes_read_back(spark, table):
    assert table.read().count() == 0
    table.upsert(spark.createDataFrame([(i, f"a{i}", 0) for i in range(100)], ROWS))
    table.upsert(spark.createDataFrame([(5, "b5", 1), (5, "c5", 2), (200, "new", 0), (None, "nobody", 0)], ROWS))
    table.upsert(spark.createDataFrame([(None, "somebody", 0)], ROWS))
    rows = {r.id: (r.name, r.n) for r in table.read().collect()}
    assert len(rows) == 102 and rows[5] == ("c5", 2) and rows[200] == ("new", 0) and rows[None] == ("somebody", 0)
    number = table.delete(F.col("id") >= 50)
    assert {r.id for r in table.read().collect()} == {*range(50), None} and number == 4
    assert table.read(1).count() == 100 and table.delete(F.col("id") > 1000) == 4  # an old version still reads, and nothing to delete commits nothing
    assert content(table.find(spark.createDataFrame([(5,), (None,), (77,)], "id long"))) == content(table.read().filter("id = 5 or id is null"))
    assert table.drop(spark.createDataFrame([(5,), (999,)], "id long")) == 5 and table.read().filter("id = 5").count() == 0


def test_only_touched_buckets_are_written_again(spark, table):
    table.upsert(spark.createDataFrame([(i, "a", 0) for i in range(100)], ROWS))
    before = table.version()
    table.upsert(spark.createDataFrame([(3, "b", 0)], ROWS))
    after = table.version()
    assert sum(before.folders[b] != after.folders[b] for b in after.folders) == 1 and len(after.folders) == 8


def test_a_change_that_fails_leaves_the_table_as_it_was(spark, table):
    table.upsert(spark.createDataFrame([(1, "a", 0)], ROWS))
    broken = spark.range(5).select("id", F.raise_error(F.lit("no")).cast("string").alias("name"), F.lit(0).alias("n"))
    with pytest.raises(Exception, match="no"):
        table.upsert(broken)
    assert content(table.read()) == [(1, "a", 0)] and table.versions() == [0, 1]


def test_two_changes_from_one_version_do_not_both_take_effect(spark, table):
    table.upsert(spark.createDataFrame([(1, "a", 0)], ROWS))
    seen = table.version()
    table.upsert(spark.createDataFrame([(2, "b", 0)], ROWS))
    with pytest.raises(Conflict):
        table.upsert(spark.createDataFrame([(3, "c", 0)], ROWS), based_on=seen.number)
    with pytest.raises(Conflict):  # the other one commits while this one writes
        table._swap(seen, spark.createDataFrame([(3, "c", 0)], ROWS), [0])
    assert sorted(r.id for r in table.read().collect()) == [1, 2]


def test_vacuum_keeps_what_is_named(spark, table):
    for i in range(4):
        table.upsert(spark.createDataFrame([(i, "a", i)], ROWS))
    try:
        table._swap(table.version(1), spark.createDataFrame([(9, "x", 9)], ROWS), [0])
    except Conflict:
        pass
    assert table.vacuum(1) >= 1 and table.versions() == [4] and table.read().count() == 4
    with pytest.raises(FileNotFoundError):
        table.read(1)


# --- Jobs ------------------------------------------------------------------------------------------------------------------


def test_failing_batches_are_tried_again_then_text_by_text():
    calls = []

    def call(texts):
        calls.append(list(texts))
        if len(calls) == 1 or "bad" in texts:
            raise RuntimeError("busy")
        return [t.upper() for t in texts]

    start = time.time()
    got = provider_jobs.patiently(call, ["a", "b", "bad", "c"], 1, 0.05, 2)
    assert [g[0] for g in got] == ["A", "B", None, "C"] and got[2][1] == "RuntimeError: busy" and time.time() - start >= 0.1
    assert calls[0] == calls[1] == ["a", "b"] and got[0][2] == 2


def counting(log, dimension=2):
    """A provider that writes a line for each text it is asked, fails each batch with an x, and gives y a vector of the wrong width."""

    def make():
        def call(texts):
            with open(log, "a") as f:
                f.writelines(f"{len(t)}\n" for t in texts)
            if any("x" in t for t in texts):
                raise ValueError("x")
            return [[1.0] * (3 if "y" in t else dimension) for t in texts]

        return call

    return make


def test_embeddings_are_asked_once_and_failures_kept(spark, tmp_path):
    log, folder = tmp_path / "calls", shared_dir(spark, "embed")
    log.write_text("")
    rows = spark.createDataFrame([(1, "one"), (2, "one"), (3, "x"), (4, "y"), (5, None), (6, "two")], "chunk_id long, index_text string")
    job = lambda df, **how: {r.key: (r.embedding, r.error) for r in provider_jobs.embed(df, counting(str(log)), folder, 2, retries=1, delay=0.0, batch=4, buckets=4, **how).collect()}
    first = job(rows, rounds=3)
    assert first[1][0] == first[2][0] == first[5][0] == [1.0, 1.0] and first[3] == (None, "ValueError: x") and first[4] == (None, "dimension 3, expected 2")
    n = len(log.read_text().splitlines())
    assert job(rows, rounds=2) == first and len(log.read_text().splitlines()) == n  # the second run calls nothing
    assert job(rows.unionByName(spark.createDataFrame([(7, "three")], rows.schema)))[7][1] is None and len(log.read_text().splitlines()) == n + 1
    assert job(rows, expires="0 seconds") == first and len(log.read_text().splitlines()) > n + 1
    calm = lambda: lambda texts: [[2.0, 2.0] for _ in texts]
    healed = {r.key: r.error for r in provider_jobs.embed(rows, calm, folder, 2, again=True, buckets=4).collect()}
    assert set(healed.values()) == {None} and KeyedTable(spark, f"{folder}/dead").read().count() == 0


def test_a_killed_job_goes_on_with_what_is_left(spark, tmp_path):
    folder, log = shared_dir(spark, "embed"), tmp_path / "calls"
    log.write_text("")
    rows = spark.createDataFrame([(i, "t" * i) for i in range(1, 21)], "chunk_id long, index_text string")

    def dies():
        def call(texts):
            if any(len(t) == 13 for t in texts):
                os._exit(1)  # not an error of the provider: the worker dies, and with it the job
            return [[0.0, 0.0] for _ in texts]

        return call

    with pytest.raises(Exception):
        provider_jobs.embed(rows, dies, folder, 2, rounds=10, batch=50, retries=0, delay=0.0, buckets=2).count()
    done = KeyedTable(spark, f"{folder}/memo").read().count()
    assert provider_jobs.embed(rows, counting(str(log)), folder, 2, rounds=4, buckets=2).filter("embedding is not null").count() == 20
    assert len(log.read_text().splitlines()) == 20 - done


def test_tiers_take_over_from_each_other(spark):
    source = F.array(F.struct(F.lit(1).alias("source_id"), *[F.lit("router price").alias(n) for n in ("title", "content", "snippet", "aliases")]))
    small = lambda: lambda prompts: [p + " [1]" if "easy" in p else p for p in prompts]  # noqa: E731  forgets its sources

    def medium():
        def call(prompts):
            if any("hard" in p for p in prompts):
                raise RuntimeError("down")
            return [p + " [1]" for p in prompts]

        return call

    large = lambda: lambda prompts: ["yes [7]" if "odd" in p else "yes [1]" for p in prompts]
    rows = [(1, "easy", ["small", "medium", "large"]), (2, "plain", ["small", "medium", "large"]), (3, "hard", ["small", "medium", "large"]),
        (4, "hard odd", ["medium", "large"]), (5, "easy", ["huge", "small"]), (6, "hard", ["medium"]), (7, "x", [])]
    questions = spark.createDataFrame(rows, "qid long, prompt string, tiers array<string>").withColumns({"query": F.lit("what"), "sources": source})
    answers, attempts = provider_jobs.generate(questions, {"small": small, "medium": medium, "large": large}, retries=0, delay=0.0, batch=4)
    assert {r.qid: (r.model_tier, r.answer) for r in answers.collect()} == {1: ("small", "easy [1]"), 2: ("medium", "plain [1]"), 3: ("large", "yes [1]"), 5: ("small", "easy [1]")}
    assert [(r.qid, r.model_tier, r.outcome) for r in attempts.orderBy("qid", "place").collect()] == [
        (1, "small", "ok"), (2, "small", "no citations"), (2, "medium", "ok"), (3, "small", "no citations"), (3, "medium", "RuntimeError: down"), (3, "large", "ok"),
        (4, "medium", "RuntimeError: down"), (4, "large", "unknown citation ids"), (5, "huge", "no provider"), (5, "small", "ok"), (6, "medium", "RuntimeError: down"),
    ]
