"""Knowledge base: raw JSON records to accepted and rejected rows, manifest and report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions.text import clean_text, short_hash, squeeze, text

DEFAULT_SOURCE = "Official website"


def _value(c: Column) -> Column:
    """A JSON value as text; null, "", [] and {} are absent."""
    return F.when(~c.isin("", "[]", "{}", "null"), c)


def _field(name: str | Column) -> Column:
    """A field of the record, else of its structured data."""
    return F.coalesce(_value(F.col("r")[name]), _value(F.col("s")[name]))


def _names(names: tuple[str, ...]) -> Column:
    return F.array(*[F.lit(n) for n in names])


def _own(name: str) -> Column:
    return F.when(squeeze(F.col("r")[name]) != "", squeeze(F.col("r")[name]))


#: Levels of lists and objects within each other that are read; deeper ones stay JSON.
MOST_LEVELS = 4


def index_value(c: Column, levels: int = MOST_LEVELS) -> Column:
    """Lists one item a line, objects `name: value` a line, values within them alike, text by clean_text; empty ones are left out.

    Each level is an expression over the JSON of its items, for the few levels that records have.
    """
    if not levels:
        return clean_text(c)
    inner = lambda x: index_value(x, levels - 1)
    listed = F.filter(F.transform(F.from_json(c, "array<string>"), inner), lambda x: x != "")
    pairs = F.transform(F.map_entries(F.from_json(c, "map<string,string>")), lambda e: F.struct(e["key"].alias("key"), inner(_value(e["value"])).alias("value")))
    named = F.transform(F.filter(pairs, lambda e: e["value"] != ""), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))
    return F.when(c.startswith("["), F.array_join(listed, "\n")).when(c.startswith("{"), F.array_join(named, "\n")).otherwise(clean_text(c))


def parse(raw: DataFrame) -> DataFrame:
    """Add r (fields as text, nested values as JSON) and s (structured_data) to rows with a `raw` JSON object."""
    parsed = raw.withColumn("r", F.coalesce(F.from_json("raw", "map<string,string>"), F.create_map().cast("map<string,string>")))
    return parsed.withColumn("s", F.coalesce(F.from_json(F.col("r")["structured_data"], "map<string,string>"), F.create_map().cast("map<string,string>")))


def normalize(raw: DataFrame, kb_version: str = "kb_v1") -> DataFrame:
    """One row for each raw row (raw, category_hint, source_file, and error for malformed lines), in one pass.

    rejection_reason is the first that holds: malformed JSON, empty content, no citation, no category, no title; accepted
    rows have none.  Nothing is dropped: `accepted` and `rejected` split the result.
    """
    df = parse(raw)
    hint = squeeze(F.col("category_hint"))
    plain = F.translate(F.lower(F.coalesce(_own("category"), hint)), "- ", "__")
    alias = F.create_map(*[F.lit(x) for kv in L.CATEGORY_ALIASES.items() for x in kv])
    df = df.withColumn("category", F.coalesce(alias[plain], plain))
    df = df.withColumn("content", clean_text(F.col("r")["content"]))
    df = df.withColumn("citation_url", F.coalesce(*[_own(n) for n in L.CITATION_FIELDS]))
    df = df.withColumn("title", F.coalesce(*[_own(n) for n in L.TITLE_FIELDS], F.lit(L.UNTITLED)))
    bad = F.col("error").isNotNull()
    reason = F.when(bad, F.concat(F.lit("malformed_json_line_"), F.col("line_number").cast("string"), F.lit(": "), F.col("error"))).when(F.col("content") == "",
        "empty_content").when(F.col("citation_url").isNull(), "missing_citation_url").when(F.col("category") == "",
        "missing_category").when(F.col("title") == L.UNTITLED, "missing_title")
    df = df.withColumn("rejection_reason", reason)
    both = _own("question").isNotNull() & _own("answer").isNotNull()
    guessed = F.when(both, "faq").when(_own("product_name").isNotNull(), "product").when(_own("service_name").isNotNull(),
        "service_detail").when(_field("package_name").isNotNull(),
        F.when(_field("yearly_fee_egp").isNotNull(), "yearly_package").otherwise("package")).otherwise("unknown")
    df = df.withColumn("record_type", F.coalesce(_own("record_type"), guessed)).withColumn("warnings", F.when(_own("record_type").isNull(), F.array(F.lit("missing_record_type"))).otherwise(F.array().cast("array<string>")))
    # Metadata: the common fields and those of the row's category, in order, without absent ones.
    listed = F.create_map(*[x for c, names in L.CATEGORY_METADATA.items() for x in (F.lit(c), _names(names))])
    fields = F.concat(_names(L.COMMON_METADATA), F.coalesce(listed[F.col("category")], F.array().cast("array<string>")))
    kept = F.filter(F.transform(fields, lambda n: F.struct(n.alias("key"), _field(n).alias("value"))), lambda e: e["value"].isNotNull())
    df = df.withColumn("metadata", F.map_from_entries(kept))
    given, doc = _own("record_id"), _own("doc_id")
    made = F.sha2(F.concat_ws("\n", "category", "title", "content", text(F.col("citation_url"))), 256)
    df = df.withColumn("record_id", F.coalesce(given, F.concat(doc, F.lit(":"), short_hash(F.when(F.col("content") != "", F.col("content")).otherwise(F.col("citation_url")))), made))
    df = df.withColumn("language", _own("language")).withColumn("quality_score", F.col("r")["quality_score"].try_cast("double")).withColumn("source_name", F.coalesce(_own("source_name"), F.lit(DEFAULT_SOURCE)))
    labels = F.array(*[F.struct(F.lit(n).alias("n"), F.lit(label).alias("label")) for n, label in L.INDEX_LABELS.items()])
    known = F.transform(F.filter(labels, lambda x: F.map_contains_key("metadata", x["n"])), lambda x: F.struct(x["label"].alias("label"), index_value(F.col("metadata")[x["n"]]).alias("v")))
    labelled = F.array_join(F.transform(F.filter(known, lambda x: x["v"] != ""), lambda x: F.concat(x["label"], F.lit(": "), x["v"])), "\n")
    head = [F.concat(F.lit(f"{label}: "), F.col(n)) for label, n in (("Title", "title"), ("Category", "category"), ("Record type", "record_type"), ("Language", "language"))]
    df = df.withColumn("index_text", F.concat_ws("\n", *head, F.nullif(labelled, F.lit("")), F.concat(F.lit("Content:\n"), F.col("content"))))
    return df.withColumns({"kb_version": F.lit(kb_version), "source_type": F.lit("official_website")}).drop("r", "s")


def accepted(rows: DataFrame) -> DataFrame:
    return rows.filter("rejection_reason IS NULL").drop("rejection_reason", "raw", "error", "line_number")


def rejected(rows: DataFrame) -> DataFrame:
    return rows.filter("rejection_reason IS NOT NULL").select("source_file", F.col("category").alias("category"), "title", "rejection_reason", F.col("raw").alias("raw_record"))


def distributions(rows: DataFrame) -> DataFrame:
    """(field, value, n): counts by category, language (unknown if null) and record type, in one pass."""
    sets = rows.select("category", F.coalesce("language", F.lit("unknown")).alias("language"), "record_type")
    counted = sets.groupingSets([["category"], ["language"], ["record_type"]], "category", "language", "record_type").agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("g"))
    name = F.when(F.col("g") == 3, "category").when(F.col("g") == 5, "language").otherwise("record_type")
    return counted.select(name.alias("field"), F.coalesce("category", "language", "record_type").alias("value"), "n")


def manifest(rows: DataFrame) -> DataFrame:
    """(source_file, input, accepted, rejected, missing_citation, empty_content, unknown_type); a null source_file is the total."""
    reason = F.col("rejection_reason")
    return rows.rollup("source_file").agg(F.count(F.lit(1)).alias("input"), F.count_if(reason.isNull()).alias("accepted"),
        F.count_if(reason.isNotNull()).alias("rejected"), F.count_if(reason == "missing_citation_url").alias("missing_citation"),
        F.count_if(reason == "empty_content").alias("empty_content"), F.count_if(reason.isNull() & (F.col("record_type") == "unknown")).alias("unknown_type"))


def report(rows: DataFrame) -> DataFrame:
    """One flat row for each input row, lists joined by semicolons."""
    return rows.select("source_file", "record_id", F.when(F.col("rejection_reason").isNull(), "accepted").otherwise("rejected").alias("status"), "category",
        "record_type", "language", "title", F.length("content").alias("content_length"), "citation_url", "quality_score",
        text(F.col("rejection_reason")).alias("rejection_reason"), F.concat_ws(";", "warnings").alias("warnings"),
        F.array_join(F.array_sort(F.map_keys("metadata")), ";").alias("metadata_keys"))
