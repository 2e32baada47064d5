"""Language identification by prediction by partial matching (PPM) over bytes.

Each language gets a variable-order context tree (order 3 down to 0) with escape probabilities (method C) from a
bounded sample.  The statistics are then frozen, so the code length of a byte depends on its context node
alone: all nodes' code lengths are tabled, and a text's exact code length under every language is a sum of
table rows, taken for whole texts at once.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import columns_of, over_batches, per_worker, text_udf, utf8

#: The sample: so many documents a language, and so many bytes of all languages together.
SAMPLE_DOCS, SAMPLE_BYTES = 256, 8 << 20
#: Languages learned at most: those with the most rows; names that are longer are no languages.
LANGUAGES, NAME_CHARS = 256, 64
#: Longest context, and bytes the tables of all nodes may take.
ORDER, TABLE_BYTES = 3, 96 << 20
#: Learned document folds are those other than HELD_OUT of FOLDS.
FOLDS, HELD_OUT = 5, 0
UNDETERMINED = "und"
#: Score below which a document is rejected as of no learned language.
MIN_SCORE = 0.5
#: Bytes of a text scored at a time.
CHUNK = 1 << 20


def fold(doc_id: F.Column) -> F.Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(FOLDS))


def training_sample(docs: DataFrame, docs_per_language: int = SAMPLE_DOCS, max_bytes: int = SAMPLE_BYTES) -> dict[str, list[bytes]]:
    """Texts by language: rows of the learned folds with a language and a text, the smallest by a hash of doc_id.

    At most docs_per_language rows of each of the LANGUAGES most frequent languages are chosen from (doc_id, lang) alone;
    then their texts are read and taken in hash order while they fit the language's share of max_bytes.  Of a language whose
    first text is larger than that, the text's first bytes are learned.
    """
    usable = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["lang"].cast("string").alias("lang"), docs["text"].cast("string").alias("text")).filter("lang is not null and text is not null and doc_id is not null").filter(fold(F.col("doc_id")) != HELD_OUT)
    usable = usable.filter(F.length("lang") <= NAME_CHARS)
    counts = {r["lang"]: r["n"] for r in usable.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES).collect()}
    if not counts:
        return {}
    # A hash limit leaves about four times the rows wanted, so that the ranking below sees few.
    share = F.create_map(*[x for k, n in counts.items() for x in (F.lit(k), F.lit(min(1.0, (4.0 * docs_per_language + 64) / n)))])
    spread = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    # A language that is not learned has no share, and its rows go.
    near = usable.select("doc_id", "lang", spread.alias("h")).filter(F.col("h") <= share[F.col("lang")])
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id"))
    chosen = {(r["lang"], r["doc_id"]): r["k"] for r in near.withColumn("k", rank).filter(F.col("k") <= docs_per_language).collect()}
    limit = max_bytes // len(counts)
    texts: dict[str, list[bytes]] = {k: [] for k in counts}
    wanted = usable.filter(F.col("doc_id").isin(sorted({i for _, i in chosen}))).select("lang", "doc_id", F.octet_length("text").alias("size"))
    sizes = sorted(((chosen[r["lang"], r["doc_id"]], r["lang"], r["doc_id"], r["size"]) for r in wanted.collect() if (r["lang"], r["doc_id"]) in chosen))
    taken: dict[str, int] = dict.fromkeys(counts, 0)
    picks = []
    for _, lang, doc, size in sizes:
        if taken[lang] == 0 or taken[lang] + size <= limit:
            taken[lang] += size
            picks.append((lang, doc))
    both = set(picks)
    # No more than the share of any text is sent to the driver; a character may be cut, which costs one context.
    head = F.substring(F.encode("text", "utf-8"), 1, limit)
    for r in usable.filter(F.col("doc_id").isin(sorted({i for _, i in picks}))).select("lang", "doc_id", head.alias("head")).orderBy("doc_id", "head").toLocalIterator():
        if (r["lang"], r["doc_id"]) in both:
            texts[r["lang"]].append(bytes(r["head"]))
    return {k: v for k, v in texts.items() if v}


class Model:
    """Tabled code lengths.  symbol: byte to symbol (0: unseen); node: last `order` symbols to context node;
    bits: (nodes * symbols, languages) code lengths in bits."""

    def __init__(self, langs: list[str], symbol: np.ndarray, node: np.ndarray, bits: np.ndarray, order: int = ORDER):
        self.langs, self.symbol, self.node, self.bits, self.size, self.order = langs, symbol, node, bits, int(symbol.max()) + 1, order

    def lengths(self, text: bytes) -> np.ndarray:
        """Code length of the whole text under each language, in bits."""
        total, past = np.zeros(len(self.langs)), np.zeros(self.order, np.int32)
        raw = np.frombuffer(text, np.uint8)
        for at in range(0, len(raw), CHUNK):
            s = np.concatenate((past, self.symbol[raw[at : at + CHUNK]]))
            n = len(s) - self.order
            context = np.zeros(n, np.int32)
            for back in range(self.order):
                context = context * np.int32(self.size) + s[back : back + n]
            rows = self.node[context] * np.int32(self.size) + s[self.order :]
            total += self.bits[rows].sum(axis=0, dtype=np.float64)
            past = s[n:]
        return total

    def predict(self, text: bytes) -> tuple[str, float]:
        """(language, share of its probability among all, from code lengths per byte damped to 64 bytes at most)."""
        if not self.langs:
            return UNDETERMINED, 0.0
        bits = self.lengths(text)
        best = int(bits.argmin())
        gap = (bits - bits[best]) * min(1.0, 64 / max(1, len(text)))
        return self.langs[best], float(1 / np.exp2(-gap).sum())


def fit(texts: dict[str, list[bytes]], order: int = ORDER, table_bytes: int = TABLE_BYTES) -> Model:
    """Count contexts, choose nodes, and table PPM code lengths with frozen statistics."""
    langs = sorted(texts)
    if not langs:
        return Model([], np.zeros(256, np.int32), np.zeros(1, np.int32), np.zeros((1, 0), np.float32))
    seen = np.zeros(256, bool)
    for own in texts.values():
        for t in own:
            seen[np.frombuffer(t, np.uint8)] = True
    symbol = np.zeros(256, np.int32)
    symbol[seen] = np.arange(1, seen.sum() + 1)
    size = int(seen.sum()) + 1
    # Unseen symbol 0 doubles as the text's start, so that every position has a full context.
    streams = {k: np.concatenate([np.concatenate((np.zeros(order, np.int32), symbol[np.frombuffer(t, np.uint8)])) for t in own]) for k, own in texts.items()}
    grams: dict[tuple[str, int], tuple[np.ndarray, np.ndarray]] = {}
    for lang, s in streams.items():
        for k in range(order + 1):
            key = np.zeros(len(s) - order, np.int64)
            for back in range(k, -1, -1):
                key = key * size + s[order - back : len(s) - back]
            grams[lang, k] = np.unique(key[s[order:] > 0], return_counts=True)
    # Nodes: the root, and contexts seen in any language, frequent ones first, shorter ones always before longer.
    limit = max(2, table_bytes // (size * max(1, len(langs)) * 4))
    contexts: list[tuple[int, int]] = [(0, 0)]
    for k in range(1, order + 1):
        keys = np.concatenate([grams[lang, k][0] // size for lang in langs])
        weight = np.concatenate([grams[lang, k][1] for lang in langs])
        unique, inverse = np.unique(keys, return_inverse=True)
        count = np.bincount(inverse, weight) if len(keys) else np.empty(0)
        ranked = sorted(zip((-count).tolist(), unique.tolist(), strict=True))
        contexts += [(k, c) for n, c in ranked[: max(0, limit - len(contexts))] if n <= -2 or k == 1]
    number = {c: i for i, c in enumerate(contexts)}
    bits = np.zeros((len(contexts), size, len(langs)), np.float32)
    for at, lang in enumerate(langs):
        # Probability of each symbol at the root: order 0 with escape to the uniform distribution over 256 bytes.
        table = np.zeros((len(contexts), size))
        base = np.full(size, 1 / 256)
        below = dict.fromkeys(range(order + 1))
        for k in range(order + 1):
            key, count = grams[lang, k]
            context = key // size
            below[k] = (context, key % size, count)
        for k in range(order + 1):
            context, sym, count = below[k]
            edges = np.concatenate((np.searchsorted(context, np.unique(context)), [len(context)])) if len(context) else np.zeros(1, int)
            where = {int(context[i]): (i, j) for i, j in zip(edges[:-1], edges[1:], strict=True)}
            for order_of, c in [x for x in contexts if x[0] == k]:
                suffix = next(((j, c % size**j) for j in range(k - 1, 0, -1) if (j, c % size**j) in number), (0, 0))
                parent = base if k == 0 else table[number[suffix]]
                i, j = where.get(c, (0, 0))
                if i == j:
                    table[number[order_of, c]] = parent
                    continue
                # Method C: distinct symbols count as escapes; all lower symbols share what the escape leaves.
                total, kinds = count[i:j].sum(), j - i
                row = parent * (kinds / (total + kinds))
                row[sym[i:j]] += count[i:j] / (total + kinds)
                table[number[order_of, c]] = row
        bits[:, :, at] = -np.log2(table)
    node = np.zeros(size**order, np.int32)
    for k, c in contexts:
        if k:
            view = node.reshape(-1, size**k)
            view[:, c] = number[k, c]
    return Model(langs, symbol, node, np.ascontiguousarray(bits.reshape(-1, len(langs))), order)


SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("text_key", T.LongType())])


def identify(docs: DataFrame, sample: dict[str, list[bytes]] | None = None) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score (0 to 1), text_key.

    Null texts and texts without a letter, and all texts when no row has a language, get `und` and score 0.
    A null doc_id is held out of nothing: it counts as not held out, and is never learned from.
    """
    spark = docs.sparkSession
    texts = training_sample(docs) if sample is None else sample
    sent = spark.sparkContext.broadcast(texts)
    keyed = columns_of(docs).withColumn("text_key", F.xxhash64(F.coalesce("text", F.lit("")))).withColumn("letter", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    name = f"ppm-{uuid.uuid4().hex}"

    def make():
        model = per_worker(name, lambda: fit(sent.value))

        def step(batch: pa.RecordBatch):
            langs, scores = [], []
            for t, letter in zip(utf8(batch.column(1)), batch.column(3).to_pylist(), strict=True):
                lang, score = model.predict(t) if letter else (UNDETERMINED, 0.0)
                langs.append(lang)
                scores.append(score)
            yield {"doc_id": batch.column(0), "lang_pred": langs, "score": scores, "text_key": batch.column(2)}

        return step

    found = over_batches(keyed, make, SCHEMA)
    return found.select("doc_id", F.coalesce(fold(F.col("doc_id")) == HELD_OUT, F.lit(False)).alias("held_out"), "lang_pred", "score", "text_key")


def keep_identified(docs: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """docs whose language is determined with min_score at least; the others go.

    A row-wise filter: all columns stay, no row moves, repeated rows are all kept.  Without any labelled row
    there is nothing to learn, and nothing but texts without a letter is rejected.
    """
    texts = training_sample(docs)
    text = docs["text"].cast("string")
    lettered = docs.filter(F.coalesce(text.rlike(r"\p{L}"), F.lit(False)))
    if not texts:
        return lettered
    sent = docs.sparkSession.sparkContext.broadcast(texts)
    name = f"ppm-{uuid.uuid4().hex}"

    def make():
        model = per_worker(name, lambda: fit(sent.value))
        return lambda t: model.predict(t or b"")[1]

    return lettered.filter(text_udf(make, T.DoubleType())(text) >= min_score)
