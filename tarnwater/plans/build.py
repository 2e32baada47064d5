"""The offline path: raw records to knowledge base, chunks and indexes; pages to records."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..operators import chunking, dedupe, html, kb, records, sparse
from ..operators import pages as page_records
from ..sources import readers
from ..sources.shared import stored


@dataclass
class Built:
    rows: DataFrame
    chunks: DataFrame
    index: sparse.SparseIndex


def build(spark: SparkSession, configs: list[dict], kb_version: str = "kb_v1") -> Built:
    """All enabled sources to normalised rows (accepted and rejected), chunks of the accepted, and their sparse index."""
    rows = kb.normalize(readers.sources(spark, readers.registry(configs)), kb_version)
    chunks = chunking.chunk_records(kb.accepted(rows))
    return Built(rows, chunks, sparse.build_index(chunks, "chunk_id", "index_text"))


def scrape(pages: DataFrame, kind: str = "mobile", section: str = "", brand: str | None = None) -> DataFrame:
    """Pages (page_id, url, html) to cleaned, scored and deduplicated records of their section.

    kind is mobile, business, section (with the section's name), public or generic (with a name for the category).
    """
    # Stored once: lines, title and description are worked out for a page, not again wherever a record names them.
    parsed = stored(html.parsed(pages, kind, brand).drop("html"), "parsed-pages")
    if kind == "mobile":
        return dedupe.dedupe_records(records.normalize_mobile(page_records.mobile(parsed)), "mobile")
    if kind == "business":
        return dedupe.dedupe_records(records.normalize_business(page_records.business(parsed)), "business")
    if kind == "section":
        return dedupe.dedupe_records(records.normalize_section(page_records.section(parsed, section)), "section")
    return page_records.public(parsed) if kind == "public" else page_records.post_process_generic(page_records.generic(parsed, section))
