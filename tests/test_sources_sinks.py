import random

import pytest
from pyspark.sql import functions as F

from tarnwater.operators import chunking, kb, quality
from tarnwater.plans import provider_jobs
from tarnwater.sources import readers, sinks
from tarnwater.sources.shared import shared_dir

SF = "/root/testdata/sf0.001"


def test_titles_keep_references_that_no_semicolon_ends(spark):
    """A title cut off in the middle of a reference is text from there on, as the SQL beside document_source has it."""
    from tarnwater.operators.html import document_title

    cases = {"a &amp;&amp;&amp": "a &&&amp", "b &amp;lt; &lt;c&gt;": "b &lt; <c>", "d &ampx; & &#65;": "d &ampx; & A", "e &quot;x&quot": 'e "x&quot'}
    rows = spark.createDataFrame([(f"<title>{k}</title><p>x",) for k in cases], "html string")
    assert [r[0] for r in rows.select(document_title(F.col("html"))).collect()] == list(cases.values())


def test_html_documents(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    (tmp_path / "one.html").write_text("<html><head><title> One &amp; all </title><script>x()</script></head><body><p> a </p>\n<p>b<br>c</p></body></html>", encoding="utf-8")
    (tmp_path / "deep" / "two.v1.HTM").write_bytes(b"<p>caf\xe9</p>")
    (tmp_path / "three.txt").write_text("<title>no</title>")
    (tmp_path / "four.html").write_text("<title>4</title>" + "x" * 500)
    (tmp_path / "five.html").write_text("")
    got = {r.document_id: (r.title, r.text, r.error) for r in readers.html_documents(spark, f"file://{tmp_path}", most=400).collect()}
    assert got == {
        "one": ("One & all", "One & all\nx()\na\nb\nc", None),
        "two.v1": ("two.v1", "caf�", "not UTF-8"),
        "four": ("four", "", "file of 516 bytes"),
    }


def test_default_golden_queries_are_written_once(spark):
    path = shared_dir(spark, "golden")
    first = {(r.qid, r.query, r.expected_route) for r in readers.golden_queries(spark, path).collect()}
    assert len(first) == 2 and {(r.qid, r.query, r.expected_route) for r in spark.read.schema(readers.GOLDEN).json(path).withColumn("qid", F.xxhash64("query")).collect()} == first
    spark.createDataFrame([("own", None, None, None, None)], readers.GOLDEN).write.mode("append").json(path)
    assert readers.golden_queries(spark, path).count() == 3 and readers.golden_queries(spark).count() == 2


def test_stored_chunks_are_read_as_they_are(spark, tmp_path):
    (tmp_path / "c.jsonl").write_text('{"chunk_id": "a", "content": "x"}\n{"chunk_id": "b"}\n')
    assert [tuple(r) for r in readers.chunks(spark, str(tmp_path / "c.jsonl"), "chunk_id string, content string").orderBy("chunk_id").collect()] == [("a", "x"), ("b", None)]


def test_bundles_are_checked_before_they_take_a_place(spark, tmp_path):
    (tmp_path / "data").mkdir()
    (tmp_path / "data" / "a.txt").write_text("a")
    (tmp_path / "data" / "b.txt").write_text("b")
    root, bundle = f"file://{tmp_path}/data", f"file://{tmp_path}/bundle"
    assert sinks.export_bundle(spark, root, bundle).count() == 2
    (tmp_path / "data" / "a.txt").write_text("changed")
    (tmp_path / "data" / "c.txt").write_text("new")
    promised = spark.read.parquet(f"{bundle}/checksums")
    assert {tuple(r) for r in sinks.damaged(spark, root, promised).collect()} == {("a.txt", "changed"), ("c.txt", "extra")}
    sinks.restore_bundle(spark, bundle, root)
    assert (tmp_path / "data" / "a.txt").read_text() == "a" and not (tmp_path / "data" / "c.txt").exists()
    (tmp_path / "bundle" / "content" / "b.txt").unlink()
    with pytest.raises(ValueError, match="b.txt missing"):
        sinks.restore_bundle(spark, bundle, root)
    assert (tmp_path / "data" / "b.txt").read_text() == "b"


def test_values_within_values_are_read(spark):
    rows = ['{"a": {"b": ["x", {"c": " y  z "}, [], ""], "d": null}, "e": ""}', '[["p", "q"], {"k": "v"}, null]', "plain  text", "[]", '{"n": 5, "t": true}']
    df = spark.createDataFrame([(r,) for r in rows], "v string").select(kb.index_value(F.col("v")).alias("x"))
    assert [r.x for r in df.collect()] == ["a: b: x\nc: y z", "p\nq\nk: v", "plain text", "", "n: 5\nt: true"]


def test_section_summary_of_nothing(spark):
    empty = spark.createDataFrame([], "language string, mobile_category string, record_type string, quality_flags array<string>, is_accepted boolean")
    got = {tuple(r) for r in quality.section_summary(empty, "mobile").collect()}
    assert got == {("total", "records", 0), ("total", "accepted", 0), ("total", "rejected", 0), ("missing", "price", 0), ("missing", "quota", 0), ("missing", "code", 0)}
    rows = spark.createDataFrame([("en", None, "a"), (None, "faq", "a")], "language string, category string, record_type string")
    got = {tuple(r) for r in quality.section_summary(rows, "public", 3, 0).collect()}
    assert {("total", "accepted", 2), ("language", "unknown", 1), ("category", "unknown", 1), ("category", "faq", 1), ("record_type", "a", 2), ("total", "pages_fetched", 3)} <= got


def test_flags_of_a_section_are_ranked(spark):
    rows = spark.createDataFrame([(["a", "b"],), (["b"],), (["c"],)], "quality_flags array<string>").withColumns({"business_category": F.lit("x"), "record_type": F.lit("y"), "is_accepted": F.lit(None).cast("boolean")})
    got = [tuple(r) for r in quality.section_summary(rows, "business").filter("part = 'flag'").orderBy(F.desc("n"), "name").collect()]
    assert got == [("flag", "b", 2), ("flag", "a", 1), ("flag", "c", 1)]


def test_a_reranker_that_is_down_changes_no_order(spark):
    rows = spark.createDataFrame([(1, i, "q", f"t{i}", i, 1.0 / i) for i in range(1, 7)] + [(2, 1, None, None, 1, 1.0)], "qid long, chunk_id long, query string, body string, rank int, final_score double")

    def down():
        def call(pairs):
            raise RuntimeError("down")

        return call

    def odd():
        return lambda pairs: [float(c[1:]) if c and int(c[1:]) % 2 else float("nan") for _, c in pairs]

    got = provider_jobs.rerank(rows, down, F.col("body"), delay=0.0).orderBy("qid", "rank").collect()
    assert [r.chunk_id for r in got] == [1, 2, 3, 4, 5, 6, 1] and {r.rerank_error for r in got} == {"RuntimeError: down"} and got[1].final_score == 0.5
    got = provider_jobs.rerank(rows, odd, F.col("body"), top_k=4).orderBy("qid", "rank").collect()
    assert [(r.chunk_id, r.reranker_score, r.pre_rerank_rank) for r in got if r.qid == 1] == [(5, 5.0, 5), (3, 3.0, 3), (1, 1.0, 1), (2, None, 2)]


# --- The recursive splitter against a plain recursion ---------------------------------------------------------------------


def plain_pieces(s, size, level=0):
    """The text's pieces at one separator after the other, filled up to `size` tokens by reading them again each time."""
    if chunking.n_tokens(s) <= size:
        return [s.strip()]
    while level < len(chunking.SEPARATORS) and chunking.SEPARATORS[level] not in s:
        level += 1
    if level == len(chunking.SEPARATORS):
        words = s.split()
        return [" ".join(words[i : i + size]) for i in range(0, len(words), size)]
    mark, out, held = chunking.SEPARATORS[level], [], None
    for piece in s.split(mark):
        if held is not None and chunking.n_tokens(held + mark + piece) <= size:
            held += mark + piece
            continue
        if held is not None:
            out.append(held.strip())
        held = None
        if chunking.n_tokens(piece) <= size:
            held = piece
        else:
            out += plain_pieces(piece, size, level + 1)
    return [x for x in [*out, *([held.strip()] if held is not None else [])] if x]


def test_recursive_split_of_whole_documents(spark):
    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect() if r.text]
    for size in (64, 512):
        for s in texts:
            s = s.strip()
            want = plain_pieces(s, size)
            assert chunking.split_recursive(s, size, 0) == [x for x in want if x]
            got = chunking.split_recursive(s, size, 10)
            if len(want) > 1:
                words = [x.split() for x in want]
                assert [g.split()[-len(w) :] for g, w in zip(got, words, strict=True)] == words  # each chunk ends in its own words
                for before, own, g in zip(words, words[1:], got[1:]):
                    more = g.split()[: -len(own)]
                    assert more == before[len(before) - len(more) :] and len(more) <= 10


def test_recursive_split_of_odd_texts():
    r = random.Random(8)
    for _ in range(400):
        s = "".join(r.choice(["a", "bc", " ", "\n", "\n\n", ". ", "? ", "! ", "؟ ", "*1#", "ل"]) for _ in range(r.randrange(60)))
        assert chunking.split_recursive(s, 4, 0) == ([x for x in plain_pieces(s.strip(), 4) if x] if s.strip() else [])


def test_python_holds_few_rows_of_a_batch(spark):
    import pyarrow as pa

    from tarnwater.sources.shared import few_rows

    parts = list(few_rows(pa.array(range(150)), pa.array(range(150))))
    assert [len(a) for a, _ in parts] == [64, 64, 22] and [len(a) for (a,) in few_rows(pa.array([], pa.int64()))] == [0]
    rows = spark.range(0, 300, 1, 1).select("id", F.concat(F.lit("row "), "id").alias("text"))
    assert rows.select("id", chunking.recursive(F.col("text"))[0].alias("x")).filter("x <> concat('row ', id) OR x IS NULL").count() == 0


def test_rows_become_files_side_by_side_and_each_is_read_once(spark):
    """A file for each row, without a folder of its own for each, planned in one of the scans for small and for large files."""
    folder = shared_dir(spark, "pages-as-files")
    rows = spark.createDataFrame([(f"page_id={i}", f"<title>t{i}</title>" if i % 3 else "") for i in range(30)] + [("page_id=7", "<title>again</title>")], "name string, value string").repartition(3)
    sinks.text_files(rows, folder, tag="x")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    assert sorted(bytes(r.content).decode() for r in files.select("content").collect()) == sorted(f"{r.value}\n" for r in rows.collect())
    assert len({r.path.rsplit("/", 1)[0] for r in files.select("path").collect()}) <= 3
    found = readers.html_documents(spark, folder, ending=r"\.txt$")
    assert found.rdd.getNumPartitions() == files.rdd.getNumPartitions() and found.count() == 31
    assert {r.title for r in found.filter("title NOT LIKE 'page%'").collect()} == {f"t{i}" for i in range(30) if i % 3} | {"again"}
