"""Sources: JSON lines with quarantine, registries, uploads, pages, vectors, queries."""

from __future__ import annotations

from functools import reduce
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import lexicon as L
from ..functions.text import url_plain


def jsonl(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(source_file, line_number, raw, error): one row for each line that is not blank; bad lines are rows with an error.

    A line is bad if it does not parse or is no object.  Line numbers need the whole file in order, so each file is one
    task: parts of a large table belong in several files.  `jsonl_parallel` splits files and goes without numbers.
    """
    whole = spark.read.text(path, wholetext=True).select(F.regexp_replace(F.input_file_name(), "^.*/", "").alias("source_file"), F.posexplode(F.split("value", "\r\n|\n|\r")).alias("at", "raw"))
    return _quarantined(whole.withColumn("line_number", F.col("at") + 1).drop("at"))


def jsonl_parallel(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """As jsonl, from splits of files of any size; line_number is null."""
    rows = spark.read.text(path).select(F.regexp_replace(F.input_file_name(), "^.*/", "").alias("source_file"), F.col("value").alias("raw"), F.lit(None).cast("int").alias("line_number"))
    return _quarantined(rows)


def _quarantined(rows: DataFrame) -> DataFrame:
    value = F.try_parse_json("raw")
    error = F.when(value.isNull(), "invalid JSON").when(~F.schema_of_variant(value).startswith("OBJECT"), "not an object")
    return rows.filter(F.trim("raw") != "").select("source_file", "line_number", "raw", error.alias("error"))


def jsonl_strict(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Typed rows; a bad line fails the read; a missing path is an empty table."""
    jvm = spark.sparkContext._jvm
    found = jvm.org.apache.hadoop.fs.Path(path)
    if not found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(found):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def registry(config: list[dict] | str | None, defaults: list[dict] | None = None) -> list[dict]:
    """Source configs (path, category, enabled, description) from a list or from a YAML file with a list `sources`.

    Without a config, or where the file does not exist, the defaults: those given, else the lexicon's four.  ValueError for
    anything but a list of mappings.
    """
    if isinstance(config, str):
        if Path(config).exists():
            import yaml

            held = yaml.safe_load(Path(config).read_text(encoding="utf-8")) or {}
            config = held.get("sources") if isinstance(held, dict) else held
            if config is None:
                raise ValueError("sources must be a list of mappings")
        else:
            config = None
    rows = ([{"category": c, "path": p} for c, p in L.DEFAULT_SOURCES] if defaults is None else defaults) if config is None else config
    if not isinstance(rows, list) or not all(isinstance(r, dict) for r in rows):
        raise ValueError("sources must be a list of mappings")
    return [{"path": r["path"], "category": r.get("category", ""), "enabled": bool(r.get("enabled", True)), "description": r.get("description", "")} for r in rows]


def merge_sections(configs: list[dict], sections: list[dict]) -> list[dict]:
    """Source configs with those of built sections (name, path, enabled) put in: a section takes over the configs of its
    category, path and switch, and keeps their description; an enabled section without a config is appended."""
    built = {s["name"]: s for s in sections}
    out = []
    for c in configs:
        s = built.get(c["category"])
        out.append(c if s is None else {**c, "path": s["path"], "enabled": bool(s.get("enabled", True)), "description": c.get("description") or f"{s['name']} records"})
    known = {c["category"] for c in configs}
    return out + [{"path": s["path"], "category": s["name"], "enabled": True, "description": f"{s['name']} records"} for s in sections if s.get("enabled", True) and s["name"] not in known]


def sources(spark: SparkSession, configs: list[dict]) -> DataFrame:
    """Raw rows of all enabled sources, with category_hint; disabled ones are never opened."""
    parts = [jsonl(spark, c["path"]).withColumn("category_hint", F.lit(c["category"])) for c in configs if c["enabled"]]
    empty = spark.createDataFrame([], "source_file string, line_number int, raw string, error string, category_hint string")
    return reduce(DataFrame.unionByName, parts, empty)


def session_chunks(spark: SparkSession, root: str, session: str) -> DataFrame:
    """One session's upload chunks; the session is a partition folder, so others are not listed."""
    return spark.read.parquet(root).filter(F.col("upload_session_id") == session)


def pages(spark: SparkSession, path: str) -> DataFrame:
    """Raw HTML files as (url: the file's path, html): bytes that are no UTF-8 turn into replacement marks."""
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("url"), F.make_valid_utf8(F.col("content").cast("string")).alias("html"))


def html_documents(spark: SparkSession, path: str, most: int = 64 << 20, ending: str = r"\.html?$") -> DataFrame:
    """(path, document_id, title, text, error): each HTML file below a folder of any file system as a document.

    The title is the page's, else the file's name without its ending; the text is every run of text on a line of its own, scripts
    included.  Files of more than `most` bytes are not opened and get an error, as do those that are no UTF-8 (their text has
    replacement marks).  Spark plans the splits by file, and passes over files without a byte.
    """
    from ..operators.html import document_text, document_title

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).filter(F.lower("path").rlike(ending))
    stem = F.regexp_replace(F.regexp_replace("path", "^.*/", ""), r"\.[^.]*$", "")
    # By the listing's sizes, so that each file is planned in one of the two scans.
    small = files.filter(F.col("_metadata.file_size") <= most).withColumn("html", F.make_valid_utf8(F.col("content").cast("string")))
    odd = F.when(~F.is_valid_utf8(F.col("content").cast("string")), "not UTF-8")
    read = small.select("path", stem.alias("document_id"), F.coalesce(F.nullif(document_title(F.col("html")), F.lit("")), stem).alias("title"), document_text(F.col("html")).alias("text"), odd.alias("error"))
    large = files.filter(F.col("_metadata.file_size") > most).select("path", stem.alias("document_id"), stem.alias("title"), F.lit("").alias("text"), F.concat(F.lit("file of "), F.col("length"), F.lit(" bytes")).alias("error"))
    return read.unionByName(large)


def chunks(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Stored chunks, JSON lines or Parquet by the path's ending, as they are: nothing is checked, and a missing field is null."""
    reader = spark.read.schema(schema)
    return reader.json(path) if path.rstrip("/").endswith((".jsonl", ".json", ".jsonl.gz")) else reader.parquet(path)


def text_documents(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file_name"), F.col("value").alias("text"))


GOLDEN = "query string, expected_category string, expected_contains_any array<string>, expected_citation_contains string, expected_route string"


def golden_queries(spark: SparkSession, path: str | None = None) -> DataFrame:
    """Golden queries from JSON lines, numbered by their hash and text; where the path has none yet, a small default set is written there first."""
    rows = [("How much is the cordless phone?", "devices", ["price"], None, None), ("hack my neighbour", None, None, None, "rejection")]
    found = spark.createDataFrame(rows, GOLDEN)
    if path:
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        if not place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
            found.coalesce(1).write.json(path)
        found = spark.read.schema(GOLDEN).json(path)
    return found.withColumn("qid", F.xxhash64("query"))


def manifest(spark: SparkSession, path: str) -> dict:
    """A JSON manifest as a mapping, empty if there is none."""
    import json

    rows = spark.read.text(path, wholetext=True).collect() if Path(path).exists() or "://" in path else []
    return json.loads(rows[0][0]) if rows else {}


def discover(pages_links: DataFrame, seen: DataFrame, allowed) -> DataFrame:
    """(url): links that are allowed and not seen, each once."""
    return pages_links.select(url_plain(F.col("url")).alias("url")).filter(allowed(F.col("url"))).distinct().join(seen.select("url"), "url", "left_anti")


def frontier(links: DataFrame, seeds: DataFrame, max_pages: int, max_depth: int = 10) -> DataFrame:
    """(url, depth): breadth-first over a link table (source, target) from seeds, at most max_pages in order of depth and url.

    Each level is one join and an anti-join with what was reached; levels are checkpointed, so the plan stays flat.
    """
    spark = links.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        raise RuntimeError("set a checkpoint folder that all executors share")
    reached = seeds.select("url").distinct().withColumn("depth", F.lit(0)).checkpoint()
    level, n = reached, reached.count()
    for depth in range(1, max_depth + 1):
        if n >= max_pages:
            break
        step = links.join(level.select(F.col("url").alias("source")), "source").select(F.col("target").alias("url")).distinct()
        level = step.join(reached.select("url"), "url", "left_anti").withColumn("depth", F.lit(depth)).checkpoint()
        added = level.count()
        if not added:
            break
        reached, n = reached.unionByName(level).checkpoint(), n + added
    order = F.row_number().over(Window.orderBy("depth", "url"))
    return reached.orderBy("depth", "url").limit(max_pages).withColumn("ord", order)
