"""First-wins and any-key deduplication, and set operations on rows and arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import key, short_hash, snippet, source_key, text
from ..functions.parsing import source_codes, value_signature


def first_wins(df: DataFrame, keys: list[Column], order: list[Column | str]) -> DataFrame:
    """The earliest row for each key.

    The window shuffles by a digest of the key, and top-1 is pushed below the shuffle, so a hot key costs one row a task.
    """
    digest = F.sha2(F.concat_ws("\x1f", *[text(k) for k in keys]), 256)
    rank = F.row_number().over(Window.partitionBy("__key").orderBy(*order))
    return df.withColumn("__key", digest).withColumn("__n", rank).filter("__n = 1").drop("__key", "__n")


def record_keys(kind: str) -> list[Column]:
    """What makes two records of a section the same."""
    head = {"mobile": ["language", "mobile_category", "record_type", "citation_url"], "business": ["business_category", "record_type", "citation_url"], "section": ["section", "record_type", "citation_url"]}[kind]
    size = 1200 if kind == "mobile" else 1500
    return [F.col(c) for c in head] + [key(F.col("title")), short_hash(F.substring(text(F.col("content")), 1, size), 12)]


def dedupe_records(records: DataFrame, kind: str, order: str = "src_ord") -> DataFrame:
    return first_wins(records, record_keys(kind), [F.col(order)])


def content_key(c: Column) -> Column:
    """Tables and cards are the same if their normalised text is."""
    return short_hash(key(c), 16)


def source_keys() -> Column:
    """The alternative keys of a retrieved row; keys of separators alone do not count."""
    m = lambda n: text(F.col("metadata")[n])
    t = lambda n: text(F.col(n))
    content = F.when(t("content") != "", t("content")).otherwise(t("index_text"))
    pick = lambda *names: F.coalesce(*[F.when(m(n) != "", m(n)) for n in names], t("title"))
    prices = F.concat_ws("|", *[m(n) for n in ("price_numeric", "price_egp", "monthly_fee_egp", "yearly_fee_egp", "quota", "quota_gb", "speed")])
    values, codes = F.array_join(value_signature(content), "|"), F.array_join(source_codes(content), "|")
    join = lambda *cs: F.concat_ws("|", *cs)
    official = F.array(
        t("chunk_id"),
        join(t("citation_url"), t("title"), t("category")),
        F.when(values != "", join(t("citation_url"), t("category"), values)).otherwise(""),
        F.when(codes != "", join(t("citation_url"), t("category"), codes)).otherwise(""),
        join(t("citation_url"), t("title"), source_key(snippet(content, 180))),
        join(t("record_type"), source_key(pick("package_name", "service_name", "product_name")), source_key(prices)),
    )
    uploaded = F.array(t("chunk_id"), join(t("document_id"), t("page_number"), source_key(snippet(content, 220))))
    keys = F.when(F.col("source_type") == "user_upload", uploaded).otherwise(official)
    return F.filter(keys, lambda k: F.regexp_replace(k, r"^\|+|\|+$", "") != "")


def any_key_dedupe(rows: DataFrame, keys: Column, group: str = "qid", order: str = "rank", most: int = 50) -> DataFrame:
    """Greedy: in rank order, a row goes if any of its keys was seen on a kept row of its group.

    Groups are candidate lists, at most `most` rows by construction (cut first), so one array for each is bounded.
    """
    kept = rows.filter(F.col(order) <= most)
    listed = kept.withColumn("__keys", keys).groupBy(group).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col("__keys").alias("k")))).alias("l"))
    start = F.struct(F.array().cast("array<string>").alias("seen"), F.array().cast("array<int>").alias("out"))
    step = lambda a, x: F.when(F.arrays_overlap(a["seen"], x["k"]), a).otherwise(F.struct(F.concat(a["seen"], x["k"]).alias("seen"), F.array_append(a["out"], x["o"].cast("int")).alias("out")))
    chosen = listed.select(group, F.explode(F.aggregate("l", start, step, lambda a: a["out"])).alias(order))
    return kept.join(chosen, [group, order], "left_semi")


def line_dedupe(docs: DataFrame, doc: str = "doc_id", body: str = "text") -> DataFrame:
    """(doc, line_no, line): of lines of a document that are equal by key, the first; blank lines go.

    Lines leave the document only as rows, so a long text is spread like any other rows.
    """
    rows = docs.select(F.col(doc).alias("doc"), F.posexplode(F.split(text(F.col(body)), "\n")).alias("line_no", "line"))
    rows = rows.withColumn("k", key(F.col("line"))).filter("k <> ''")
    first = Window.partitionBy("doc", "k").orderBy("line_no")
    return rows.withColumn("n", F.row_number().over(first)).filter("n = 1").select("doc", "line_no", "line")


def drop_repeats(lines: Column) -> Column:
    """An array without elements equal (by key) to the one kept before."""
    start = F.struct(F.lit("\x00").alias("last"), F.array().cast("array<string>").alias("out"))
    return F.aggregate(lines, start, lambda a, x: F.when(key(x) == a["last"], a).otherwise(F.struct(key(x).alias("last"), F.array_append(a["out"], x).alias("out"))), lambda a: a["out"])


def union_sources(*parts: DataFrame) -> DataFrame:
    """All rows of all parts; columns that a part lacks are null."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def subset(a: Column, b: Column) -> Column:
    return F.size(F.array_except(a, b)) == 0
