"""Benchmark decontamination with an Aho-Corasick automaton over normalised item text."""

from __future__ import annotations

import hashlib
import re
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ALNUM, columns_of, over_batches, per_worker, stored, text_udf, utf8

#: Consecutive item words that count as a leak.
WINDOW = 10
#: Bytes of windows one automaton may hold (a node takes about 40 bytes of a worker's memory); benchmarks with more are
#: scanned in several passes.
AUTOMATON_BYTES = 8 << 20
#: Words of an item that stay in one pass; longer items are cut into pieces that overlap by a window less a word.
PIECE = 2000
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text: bytes | None) -> list[bytes]:
    """Words of a normalised text: A-Z lower-cased, cut at every ASCII byte that is no letter or digit."""
    return (text or b"").translate(ALNUM).split()


def windows_of(text: bytes | None, window: int = WINDOW) -> list[bytes]:
    """The item's windows, words joined by spaces; the whole item if it is shorter; none without words."""
    words = words_of(text)
    if len(words) <= window:
        return [b" ".join(words)] if words else []
    return [b" ".join(words[i : i + window]) for i in range(len(words) - window + 1)]


def automaton(items: list[tuple[str, bytes]], window: int = WINDOW):
    """Patterns are windows between spaces, as latin-1 text so that one character is one byte; a pattern's value
    is its number of words, its length and the items it comes from."""
    import ahocorasick

    owners: dict[bytes, set[str]] = {}
    for item, text in items:
        for w in windows_of(text, window):
            owners.setdefault(w, set()).add(item)
    machine = ahocorasick.Automaton()
    for w, ids in owners.items():
        key = f" {w.decode('latin-1')} "
        machine.add_word(key, (len(key), w.count(b" ") + 1, tuple(ids)))
    if owners:
        machine.make_automaton()
    return machine if owners else None


def scan(text: bytes | None, machine) -> tuple[list[bytes], list[tuple[int, int]], set[str]]:
    """(words, hit word ranges [from, to) merged and in order, items found) of one text."""
    words = words_of(text)
    ranges: list[tuple[int, int]] = []
    items: set[str] = set()
    if machine is None or not words:
        return words, ranges, items
    line = b" " + b" ".join(words) + b" "
    found = [(end + 1 - size, n, ids) for end, (size, n, ids) in machine.iter(line.decode("latin-1"))]
    if found:
        # A match starts with the space before its first word: that space's rank is the word's number.
        spaces = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
        firsts = np.searchsorted(spaces, [f[0] for f in found]).tolist()
        for first, n, ids in sorted((i, n, ids) for i, (_, n, ids) in zip(firsts, found, strict=True)):
            items.update(ids)
            if ranges and first <= ranges[-1][1]:
                ranges[-1] = (ranges[-1][0], max(ranges[-1][1], first + n))
            else:
                ranges.append((first, first + n))
    return words, ranges, items


def source_spans(text: str, ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Hit word ranges as (start, end) code points of the original text: normalising keeps each byte's place."""
    raw = text.encode()
    places = [(m.start(), m.end()) for m in WORD.finditer(raw.translate(ALNUM))]
    at = [(places[a][0], places[b - 1][1]) for a, b in ranges]
    return [(len(raw[:s].decode("utf-8", "ignore")), len(raw[:e].decode("utf-8", "ignore"))) for s, e in at]


def pieces(benchmark: DataFrame, window: int = WINDOW, piece: int = PIECE) -> DataFrame:
    """(item_id, text, bytes): items cut into pieces of at most `piece` words that have the item's windows between them,
    with the bytes of their windows."""
    items = benchmark.select(F.coalesce(benchmark["item_id"].cast("string"), F.lit("")).alias("item_id"), F.coalesce(benchmark["text"].cast("string"), F.lit("")).alias("text"))
    words = items.select("item_id", F.regexp_extract_all("text", F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"), F.lit(0)).alias("words"))
    step, last = piece - window + 1, F.greatest(F.size("words") - window, F.lit(0))
    parts = words.select("item_id", F.explode(F.transform(F.sequence(F.lit(0), last, F.lit(step)), lambda i: F.slice("words", i + 1, piece))).alias("words"))
    parts = parts.withColumn("text", F.array_join("words", " ")).withColumn("n", F.size("words"))
    size = F.octet_length("text") + 2
    return parts.select("item_id", "text", F.when(F.col("n") <= window, size).otherwise(F.ceil((F.col("n") - window + 1) * (size / F.col("n") * window))).cast("long").alias("bytes"))


def benchmark_shards(benchmark: DataFrame, limit: int = AUTOMATON_BYTES, window: int = WINDOW) -> list[DataFrame]:
    """The benchmark's pieces in parts of about `limit` bytes of windows at most; one part for a usual benchmark.

    A part is twice as full as the mean at most if pieces are small beside the limit; parts are made for half of it.
    """
    items = stored(pieces(benchmark, window), "benchmark-pieces")
    size = items.agg(F.sum("bytes")).first()[0] or 0
    parts = 1 if size <= limit else int(-(-2 * size // limit))
    return [items] if parts == 1 else [items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == p) for p in range(parts)]


RESULT = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("ranges", T.ArrayType(T.ArrayType(T.LongType()))), T.StructField("items", T.ArrayType(T.StringType())), T.StructField("text_key", T.LongType())])


def leaks(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, limit: int = AUTOMATON_BYTES) -> DataFrame:
    """(doc_id, n_words, ranges of hit words, items, text_key), one row per document.

    The benchmark's windows are measured first.  Up to `limit` bytes they are one automaton sent to every worker; beyond that
    the documents are scanned once per part and the parts' findings are merged by document.
    """
    spark = docs.sparkSession
    keyed = columns_of(docs).withColumn("text_key", F.xxhash64(F.coalesce("text", F.lit(""))))
    shards = benchmark_shards(benchmark, limit, window)
    if len(shards) > 1:
        # Several scans must agree on which row is which, also when rows repeat.
        keyed = stored(keyed.withColumn("row", F.monotonically_increasing_id()), "leak-rows")
    outs = []
    for shard in shards:
        sent = spark.sparkContext.broadcast([(r["item_id"], r["text"].encode()) for r in shard.toLocalIterator()])
        outs.append(over_batches(keyed, _scanner(sent, window, len(shards) > 1), T.StructType([*RESULT.fields, *[T.StructField("row", T.LongType())] * (len(shards) > 1)])))
    if len(outs) == 1:
        return outs[0]
    both = outs[0]
    for other in outs[1:]:
        both = both.unionByName(other)
    whole = both.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.flatten(F.collect_list("ranges")).alias("ranges"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"), F.first("text_key").alias("text_key"))
    start = F.struct(F.lit(-1).cast("long").alias("end"), F.lit(0).cast("long").alias("n"))
    hits = F.aggregate(F.array_sort("ranges"), start, lambda a, r: F.struct(F.greatest(a["end"], r[1]).alias("end"), (a["n"] + F.greatest(F.lit(0).cast("long"), r[1] - F.greatest(a["end"], r[0]))).alias("n")))
    return whole.withColumn("n_hit", hits["n"]).drop("row")


def _scanner(sent, window: int, with_row: bool):
    name = f"automaton-{uuid.uuid4().hex}"

    def make():
        machine = per_worker(name, lambda: automaton(sent.value, window))

        def step(batch: pa.RecordBatch):
            texts = utf8(batch.column(1))
            n, ranges, items = [], [], []
            for t in texts:
                words, r, i = scan(t, machine)
                n.append(len(words))
                ranges.append([list(x) for x in r])
                items.append(sorted(i))
            yield {"doc_id": batch.column(0), "n_words": n, "ranges": ranges, "items": items, "text_key": batch.column(2)} | ({"row": batch.column(3)} if with_row else {})

        return step

    return make


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, limit: int = AUTOMATON_BYTES) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, text_key.

    Null or wordless texts have no hits; null or wordless items have no windows, a null item_id counts as the
    empty string, and repeated items count once.  Without a benchmark no document is contaminated.
    """
    found = leaks(docs, benchmark, window, limit)
    if "n_hit" not in found.columns:
        found = found.withColumn("n_hit", F.aggregate("ranges", F.lit(0).cast("long"), lambda a, r: a + r[1] - r[0]))
    ids = F.array_join(F.array_sort("items"), ",")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(ids, 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), "text_key")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, limit: int = AUTOMATON_BYTES) -> DataFrame:
    """docs without the rows that hold a benchmark window: a row-wise filter, one scan per benchmark part.

    All columns stay, clean rows are untouched, repeated rows are all kept.
    """
    for shard in benchmark_shards(benchmark, limit, window):
        sent = docs.sparkSession.sparkContext.broadcast([(r["item_id"], r["text"].encode()) for r in shard.toLocalIterator()])
        docs = docs.filter(~text_udf(_finder(sent, window), T.BooleanType())(docs["text"].cast("string")))
    return docs


def _finder(sent, window: int):
    name = f"automaton-{uuid.uuid4().hex}"

    def make():
        machine = per_worker(name, lambda: automaton(sent.value, window))
        return lambda t: bool(scan(t, machine)[1])

    return make


def brute_force(text: str | None, items: list[tuple[str, str]], window: int = WINDOW) -> tuple[int, int, list[str]]:
    """(n_words, n_hit, items) by comparing every window with every place: what the tests hold results against."""
    lower = lambda t: words_of((t or "").encode())
    words, hit, found = lower(text), set(), set()
    for item, body in items:
        own = lower(body)
        size = min(window, len(own))
        for i in range(len(own) - size + 1 if own else 0):
            for j in range(len(words) - size + 1):
                if words[j : j + size] == own[i : i + size]:
                    hit.update(range(j, j + size))
                    found.add(item)
    return len(words), len(hit), sorted(found)


def digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(items).encode()).hexdigest()
