import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnwater.operators import block_index, dense, session_index, sparse, vector_index
from tarnwater.sources.shared import shared_dir


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def ranked(df, *names):
    return sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.select(*names).collect())


@pytest.fixture(scope="module")
def vectors(spark):
    r = np.random.default_rng(4)
    centres = r.normal(size=(12, 16))
    points = [(i, [float(x) for x in centres[i % 12 if i % 3 else 0] + r.normal(size=16) * 0.15]) for i in range(1500)]  # a third lies around one centre
    points += [(1500, None), (1501, []), (1502, [0.0] * 16), (1503, points[7][1]), (1504, points[7][1])]
    return spark.createDataFrame(points, "vec_id long, embedding array<float>")


@pytest.fixture(scope="module")
def index(spark, vectors):
    return vector_index.build(vectors, shared_dir(spark, "vectors"), cells=24)


def test_every_vector_with_a_direction_is_indexed(index):
    assert index.vectors.count() == 1502 and index.vectors.select("cell").distinct().count() <= 24
    assert len(index.centres) == 24 and np.allclose(np.linalg.norm(index.centres, axis=1), 1)


def test_exact_search_is_a_scan_of_all(index, vectors):
    asked = vectors.filter("vec_id % 20 = 0 or vec_id >= 1500").select(F.col("vec_id").alias("qid"), "embedding")
    names = ("qid", "doc", "score", "rank")
    assert ranked(vector_index.search(index, asked, 10, probes=2, exact=True), *names) == ranked(dense.search(dense.build_index(vectors), asked, 10), *names)


def test_few_cells_find_most(index, vectors):
    asked = vectors.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), "embedding")
    found = {tuple(r) for r in vector_index.search(index, asked, 10, probes=4).select("qid", "doc").collect()}
    wanted = {tuple(r) for r in dense.search(dense.build_index(vectors), asked, 10).select("qid", "doc").collect()}
    assert len(found & wanted) >= 0.95 * len(wanted)


def test_only_shelves_of_probed_cells_are_read(index, vectors, capsys):
    one = vectors.filter("vec_id = 1").select(F.col("vec_id").alias("qid"), "embedding")
    wanted = np.zeros((1, 24), bool)
    wanted[0, 3] = True
    plan = vector_index.probed(index, np.ones((1, 16)), wanted, np.full(1, -2.0), 3)
    plan.explain("formatted")
    text = capsys.readouterr().out
    assert f"PartitionFilters: [isnotnull(shelf" in text and len({f for f in plan.inputFiles() if f"shelf={index.shelf[3]}/" in f}) < len(index.vectors.inputFiles())
    assert vector_index.search(index, one, 3, probes=1).count() == 3


def test_a_stored_index_is_opened_again_and_widths_must_agree(spark, vectors):
    path = shared_dir(spark, "vectors")
    vector_index.build(vectors, path)
    asked = vectors.filter("vec_id < 3").select(F.col("vec_id").alias("qid"), "embedding")
    assert vector_index.search(vector_index.open_index(spark, path), asked, 5, exact=True).count() == 15
    with pytest.raises(ValueError):
        vector_index.build(spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<float>"), shared_dir(spark, "vectors"))
    with pytest.raises(ValueError):
        vector_index.search(vector_index.open_index(spark, path), spark.createDataFrame([(1, [1.0, 2.0])], "qid long, embedding array<float>"))


def test_an_index_without_vectors(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    found = vector_index.build(empty, shared_dir(spark, "vectors"))
    assert vector_index.search(found, empty.select(F.col("vec_id").alias("qid"), "embedding"), exact=True).count() == 0
    assert vector_index.search(found, spark.createDataFrame([(1, [1.0, 2.0])], "qid long, embedding array<float>"), exact=True).count() == 0


# --- Blocks of postings -------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def texts(spark):
    r = random.Random(6)
    vocabulary = [f"word{i}" for i in range(400)]
    weights = [1 / (i + 3) for i in range(400)]
    some = [(i, " ".join(r.choices(vocabulary, weights, k=r.randrange(1, 12)))) for i in range(900)]
    return spark.createDataFrame([*some, (900, None), (901, ""), (902, "word399 word399")], "doc_id long, text string")


def test_blocks_give_what_all_postings_give(spark, texts):
    whole = sparse.build_index(texts)
    index = block_index.build(whole, shared_dir(spark, "blocks"), shard_docs=40)
    asked = spark.createDataFrame([(i, q) for i, q in enumerate(["word0", "word1 word2 word3", "word399", "word0 word0 word399", "nothing", "", "word17 word5 nothing word200", "word399 word398 word397 word396"])], "qid long, query string")
    for k in (1, 5, 40):
        assert ranked(block_index.search(index, asked, k), "qid", "doc", "score", "rank") == ranked(sparse.search(whole, asked, k), "qid", "doc", "score", "rank")


def test_blocks_are_skipped_and_folders_pruned(spark, texts):
    whole = sparse.build_index(texts)
    index = block_index.build(whole, shared_dir(spark, "blocks"), shard_docs=20)
    terms = sparse.query_terms(spark.createDataFrame([(1, "word0 word399")], "qid long, query string"))
    wanted = block_index.wanted_blocks(index, terms)
    assert "PartitionFilters: [folder" in wanted._jdf.queryExecution().toString() and index.blocks.select("folder").distinct().count() > 30
    read = {r.folder for r in wanted.select("folder").distinct().collect()}
    assert len(read) <= 2
    assert index.blocks.selectExpr("max(size(held))").first()[0] <= 60 and index.blocks.selectExpr("sum(size(held))").first()[0] == whole.postings.count()


# --- Sessions -----------------------------------------------------------------------------------------------------------


def test_sessions_have_statistics_of_their_own(spark, texts):
    rows_of = lambda m: texts.filter(F.col("doc_id") % 3 == m)
    both = texts.filter("doc_id % 3 < 2").withColumn("s", F.concat(F.lit("s"), F.col("doc_id") % 3)).unionByName(spark.createDataFrame([(5000, "word0", None), (5001, "lonely word", "s9")], "doc_id long, text string, s string"))
    asked = [(1, "word1 word2"), (2, "word399 word0"), (3, "")]
    index = session_index.build(both, "s", "doc_id", "text")
    queries = spark.createDataFrame([(f"s{m}", q, t) for m in (0, 1) for q, t in asked] + [("s9", 1, "lonely"), ("s8", 1, "word1"), (None, 1, "word0")], "session string, qid long, query string")
    found = session_index.search(index, queries, 7)
    for m in (0, 1):
        alone = sparse.search(sparse.build_index(rows_of(m)), spark.createDataFrame(asked, "qid long, query string"), 7)
        assert ranked(found.filter(F.col("session") == f"s{m}"), "qid", "doc", "score", "rank") == ranked(alone, "qid", "doc", "score", "rank")
    assert [tuple(r) for r in found.filter("session = 's9'").select("doc", "rank").collect()] == [(5001, 1)]
    assert found.filter("session is null or session = 's8'").count() == 0


def test_terms_in_most_documents_of_a_session(spark):
    docs = spark.createDataFrame([("a", i, t) for i, t in enumerate(["x y", "x z", "x", "x w", "v"])], "s string, doc_id long, text string")
    index = session_index.build(docs, "s", "doc_id", "text")
    asked = spark.createDataFrame([("a", 1, "x")], "session string, qid long, query string")
    plain = sparse.search(sparse.build_index(docs), spark.createDataFrame([(1, "x")], "qid long, query string"), 5)
    assert ranked(session_index.search(index, asked, 5), "doc", "score", "rank") == ranked(plain, "doc", "score", "rank")


# --- Groups in one search ---------------------------------------------------------------------------------------------------


def test_groups_are_searched_in_one_pass(spark, texts):
    whole = sparse.build_index(texts)
    within = texts.filter("doc_id % 4 < 3").select(F.col("doc_id").alias("doc"), F.concat(F.lit("g"), F.col("doc_id") % 4).alias("group"))
    asked = [(i, q, g) for i, (q, g) in enumerate([("word1 word2", "g0"), ("word399", "g1"), ("word5 word0", None), ("nothing", "g2"), ("word7", "g9"), ("nothing", None)])]
    queries = spark.createDataFrame(asked, "qid long, query string, group string")
    got = sparse.search(whole, queries, 6, within=within)
    for i, _, g in asked:
        allowed = None if g is None else within.filter(F.col("group") == g)
        alone = sparse.search(whole, queries.filter(F.col("qid") == i).drop("group"), 6, allowed)
        assert ranked(got.filter(F.col("qid") == i), "doc", "score", "rank") == ranked(alone, "doc", "score", "rank")


def test_groups_of_terms_in_most_documents(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["x y", "x z", "x", "x w", "v", "u"])], "doc_id long, text string")
    whole = sparse.build_index(docs)
    within = docs.select(F.col("doc_id").alias("doc"), (F.col("doc_id") % 2).cast("string").alias("group"))
    queries = spark.createDataFrame([(1, "x", "0"), (2, "v", None), (3, "x", None)], "qid long, query string, group string")
    got = sparse.search(whole, queries, 6, within=within)
    for i, g in ((1, "0"), (2, None), (3, None)):
        alone = sparse.search(whole, queries.filter(F.col("qid") == i).drop("group"), 6, None if g is None else within.filter(F.col("group") == g))
        assert ranked(got.filter(F.col("qid") == i), "doc", "score", "rank") == ranked(alone, "doc", "score", "rank")


def test_groups_of_vectors(spark, vectors):
    index = dense.build_index(vectors)
    within = vectors.select(F.col("vec_id").alias("doc"), (F.col("vec_id") % 3).cast("string").alias("group"))
    asked = vectors.filter("vec_id < 6").select(F.col("vec_id").alias("qid"), "embedding", F.when(F.col("vec_id") % 2 == 0, (F.col("vec_id") % 3).cast("string")).alias("group"))
    got = dense.search(index, asked, 4, within=within)
    free = dense.search(index, asked.filter("group IS NULL").drop("group"), 4)
    assert ranked(got.filter("qid % 2 = 1"), "qid", "doc", "score", "rank") == ranked(free, "qid", "doc", "score", "rank")
    own = dense.search(index.filter("doc % 3 = 1"), asked.filter("qid = 4").drop("group"), 4)
    assert ranked(got.filter("qid = 4"), "doc", "score", "rank") == ranked(own, "doc", "score", "rank")


def test_a_search_shuffles_only_the_best_of_each_task(spark):
    """Counts and scores are made in the row of their document: no exchange of tokens or of (query, document) pairs."""
    docs = spark.range(0, 300, 1, 3).selectExpr("id AS doc_id", "concat('common word', id % 7, ' x', id) AS text")
    index = sparse.build_index(docs)
    assert index.bags.count() == 300
    queries = spark.createDataFrame([(1, "common word3 zebra"), (2, "common x17")], "qid long, query string")
    plan = sparse.search(index, queries, 4)._jdf.queryExecution().executedPlan().toString()
    below = plan[plan.index("MapInArrow") :]
    assert "Exchange" not in below[: below.index("FileScan")]


def test_rows_that_repeat_an_id_are_one_document(spark):
    index = sparse.build_index(spark.createDataFrame([(1, "aa bb"), (1, "aa cc"), (1, "aa"), (2, ""), (3, "dd")], "doc_id long, text string"))
    assert sorted(map(tuple, index.postings.collect())) == [(1, 1, "aa", 1), (1, 2, "aa", 2), (1, 2, "bb", 1), (1, 2, "cc", 1), (3, 1, "dd", 1)]
    assert sorted(map(tuple, index.docs.collect())) == [(1, 1), (1, 2), (2, 0), (3, 1)] and index.bags.count() == 3


def test_dense_search_sorts_no_pairs_and_takes_passes(spark, monkeypatch):
    """Equal vectors rank by id, more queries than one pass holds take several, and only each task's best are exchanged."""
    rng = np.random.default_rng(3)
    vectors = rng.normal(size=(90, 8)).astype(np.float32)
    vectors[40:70] = vectors[7]
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>").repartition(3)
    index, asked = dense.build_index(rows), rows.filter("vec_id % 3 = 1").select(F.col("vec_id").alias("qid"), "embedding")
    pairs = index.select("doc", "unit").crossJoin(asked.select("qid", dense.unit(F.col("embedding")).alias("q"))).select("qid", "doc", dense.dot(F.col("unit"), F.col("q")).alias("score")).collect()
    want = {q: [(r.doc, r.score) for r in sorted((p for p in pairs if p.qid == q), key=lambda p: (-p.score, p.doc))[:6]] for q in {p.qid for p in pairs}}
    monkeypatch.setattr(dense, "MOST_QUERIES", 11)
    found = dense.search(index, asked, 6)
    got = {}
    for r in sorted(found.collect(), key=lambda r: (r.qid, r.rank)):
        got.setdefault(r.qid, []).append((r.doc, r.score))
    assert got == want and "NestedLoop" not in found._jdf.queryExecution().executedPlan().toString()


def test_postings_are_gathered_before_they_are_joined(spark):
    """Only blocks meet their terms' idf, and the largest weight of a block is that of its postings."""
    docs = spark.createDataFrame([(i, " ".join(f"w{j}" for j in range(9) if i % (j + 3) == 0) + " own" * (i % 3) + f" d{i}") for i in range(60)], "doc_id long, text string")
    blocks = block_index.gathered(sparse.build_index(docs), 4, 5.0)
    plan = blocks._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join") < plan.index("collect_list") and plan.count("Generate") >= 1
    rows = blocks.collect()
    assert len(rows) > 60 and all(abs(r.most - max(p.weight for p in r.held)) < 1e-12 for r in rows)
