"""Spelling variants: words of a corpus that one inserted, deleted or replaced letter tells apart, each led to its commonest form.

A positional q-gram inverted index finds the pairs.  It is dealt out in shards: a word is cut into three parts, of which one edit
changes one, so near words share two; they meet in the shard of those two parts and of the shorter word's length.  Within a
shard, each word heap-merges the postings of its own grams at the places that one edit allows, keeps the words that at least
as many of its grams name as one edit must leave, and verifies those letter by letter.  Of all shards in which a pair meets, the
first alone reports it.

A shard that too many words share is cut into slices, and words of one slice visit the later ones.  Nothing is broadcast or
collected; everything is shuffled by word or by shard.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored, text_column

UPPER, LOWERED = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Letters of a gram.  One edit changes at most Q grams of a word, so words need 2 * Q letters.
Q = 2
#: A word whose run's checksum this divides has lost a letter.
LOSS = 31
#: Words of one shard that are indexed together; more are cut into slices.
SHARD_WORDS = 20_000


def observed(run: Column, doc_id: Column, loss: int = LOSS) -> Column:
    """The word that a run stands for: where `loss` divides h = crc32 of `<doc_id>:<run>`, the run without its letter h % length."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run))
    at = (h % F.length(run)).cast("int")
    return F.when(h % loss == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))).otherwise(run)


def vocabulary(docs: DataFrame, shortest: int = 7, fewest: int = 2, loss: int = LOSS) -> DataFrame:
    """(word, n) of words with at least `shortest` letters that occur at least `fewest` times in all texts; counted on the map side first."""
    texts = docs.select(docs["doc_id"].alias("doc_id"), F.translate(text_column(docs), UPPER, LOWERED).alias("text"))
    runs = texts.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(rf"[a-zÀ-ÿ]{{{shortest},}}"), F.lit(0))).alias("run"))
    words = runs.select(observed(F.col("run"), F.col("doc_id"), loss).alias("word")).filter(F.length("word") >= shortest)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= fewest)


def shards(vocab: DataFrame) -> DataFrame:
    """(size, kind, parts, role, word, n): a word in every shard where a near one may meet it.

    Role 0: a word of `size` letters.  Role 1: a word of one letter more, of whose parts the one that kind names takes the letter.
    kind 0, 1, 2: all but the last, the middle, the first third of the letters.
    """
    word = F.col("word")

    def shard(size: Column, role: int) -> list[Column]:
        a, b = F.floor(size / 3).cast("int"), F.floor(size * 2 / 3).cast("int")
        cut = lambda start, length: F.substring(word, start + 1, length)
        parts = (cut(F.lit(0), b), F.concat(cut(F.lit(0), a), cut(b + role, size - b)), cut(a + role, size - a))
        return [F.struct(size.alias("size"), F.lit(k).alias("kind"), p.alias("parts"), F.lit(role).alias("role")) for k, p in enumerate(parts)]

    size = F.length(word)
    return vocab.select(F.explode(F.array(*shard(size, 0), *shard(size - 1, 1))).alias("s"), "word", "n").select("s.*", "word", "n")


def parts_of(word: str, size: int) -> tuple[str, str, str]:
    """What `shards` takes of a word for each kind."""
    a, b, role = size // 3, size * 2 // 3, len(word) - size
    return word[:b], word[:a] + word[b + role :], word[a + role :]


def sliced(rows: DataFrame, limit: int = SHARD_WORDS) -> DataFrame:
    """rows with a slice: shards of over `limit` words are cut by word; longer words visit all slices, those of a slice the later ones (role 2)."""
    shard = ["size", "kind", "parts"]
    crowded = rows.filter("role = 0").groupBy(*shard).agg(F.count(F.lit(1)).alias("held")).filter(F.col("held") > limit)
    crowded = stored(crowded.select(*shard, F.ceil(F.col("held") / limit).cast("int").alias("slices")), "spelling-crowded")
    if not crowded.head(1):
        return rows.withColumn("slice", F.lit(0))
    own = F.pmod(F.xxhash64("word"), F.col("slices")).cast("int")
    visits = F.sequence(F.when(F.col("role") == 1, 0).otherwise(own), F.col("slices") - 1)
    known = rows.join(crowded, shard, "left").withColumn("slices", F.coalesce("slices", F.lit(1)))
    role = F.when((F.col("role") == 0) & (F.col("slice") != own), 2).otherwise(F.col("role")).alias("role")
    return known.withColumn("slice", F.explode(visits)).select(*shard, role, "word", "n", "slice")


def heap_merge(postings: list[list[int]], bound: int) -> list[int]:
    """Numbers that at least `bound` of the sorted lists hold; lists that cannot reach the bound before a number are skipped ahead to it."""
    bound = max(bound, 1)
    if len(postings) < bound:
        return []
    heap = [(p[0], i, 0) for i, p in enumerate(postings)]
    heapify(heap)
    found = []
    while len(heap) >= bound:
        least, popped = heap[0][0], []
        while heap and heap[0][0] == least:
            popped.append(heappop(heap))
        if len(popped) >= bound:
            found.append(least)
            target = least + 1
        else:
            while heap and len(popped) < bound - 1:
                popped.append(heappop(heap))
            if not heap:
                break
            target = max(heap[0][0], least + 1)
        for _, i, k in popped:
            k = bisect_left(postings[i], target, k)
            if k < len(postings[i]):
                heappush(heap, (postings[i][k], i, k))
    return found


def one_edit(a: str, b: str) -> bool:
    """Whether exactly one inserted, deleted or replaced letter tells the words apart; a is not the longer one."""
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[i + 1 :] == b[i + 1 :] and i < len(a) if len(a) == len(b) else len(a) + 1 == len(b) and a[i:] == b[i + 1 :]


class PositionalIndex:
    """Words of one length, by their grams and places."""

    def __init__(self, q: int = Q) -> None:
        self.q, self.postings, self.words = q, {}, []

    def grams(self, word: str) -> list[tuple[int, str]]:
        return [(i, word[i : i + self.q]) for i in range(len(word) - self.q + 1)]

    def add(self, word: str, n: int) -> None:
        for key in self.grams(word):
            self.postings.setdefault(key, []).append(len(self.words))
        self.words.append((word, n))

    def near(self, word: str) -> Iterator[tuple[str, int]]:
        """The words held that are one edit from this one, which is as long or one letter longer: verified candidates above the overlap bound."""
        held = self.postings
        keys = self.grams(word)
        if len(word) > len(self.words[0][0]):
            keys += [(i - 1, g) for i, g in keys if i]
        for i in heap_merge([held[k] for k in keys if k in held], len(word) - 2 * self.q + 1):
            if one_edit(self.words[i][0], word):
                yield self.words[i]


def first_shared(a: str, b: str) -> int | None:
    """The first kind of shard in which the words meet; a is not the longer one."""
    return next((k for k, (x, y) in enumerate(zip(parts_of(a, len(a)), parts_of(b, len(a)))) if x == y), None)


def near_pairs(rows: DataFrame, q: int = Q) -> DataFrame:
    """(word, n, near, near_n): every pair of near words, both ways round and once each; rows as `sliced` gives them."""
    shard = ["size", "kind", "parts", "slice"]

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, waiting, index = None, None, None
        for batch in batches:
            out: list[tuple[str, int, str, int]] = []
            columns = batch.to_pydict()
            for size, kind, parts, part, role, word, n in zip(*(columns[c] for c in (*shard, "role", "word", "n"))):
                key = (parts, size, kind, part)
                if key != now:
                    now, index = key, None
                    waiting = None if role else (word, n)  # most shards hold one word, which needs no index
                    continue
                if index is None:
                    if waiting is None:
                        continue  # no word of the shard's own length
                    index = PositionalIndex(q)
                    index.add(*waiting)
                for other, other_n in index.near(word):
                    if first_shared(other, word) == kind:
                        out += ((word, n, other, other_n), (other, other_n, word, n))
                if role == 0:
                    index.add(word, n)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], ["word", "n", "near", "near_n"])

    return rows.repartition(*shard).sortWithinPartitions(*shard, "role").mapInArrow(match, "word string, n long, near string, near_n long")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of the words in forms (word, form): the last of the forms that follow on each other, by doubling steps."""
    steps = stored(forms.select("word", F.col("form").alias("root")), "spelling-steps")
    while True:
        on = steps.select(F.col("word").alias("root"), F.col("root").alias("further"))
        taken = stored(steps.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "spelling-steps")
        if not taken.filter("moved").head(1):
            return steps
        steps = taken.select("word", "root")


def spelling_variants(docs: DataFrame, shortest: int = 7, fewest: int = 2, share: int = 10, loss: int = LOSS, q: int = Q, limit: int = SHARD_WORDS) -> DataFrame:
    """One row per word: word, form, root, n, n_near, form_n.

    Runs of letters of whole texts, A to Z lower-cased, with the letter lost that `observed` says; words as in `vocabulary`.
    near: exactly one edit apart.  form: the near word of largest n (ties: the smallest), if it occurs at least `share` times as
    often as the word, else null.  Each step to a form multiplies n by `share`, so chains are short and without circles.

    Null texts have no words; a null doc_id is the empty string in the checksum; each of several equal rows counts; empty tables
    give no rows; columns other than doc_id and text are not read.  Words may be of any length of at least 2 * q letters.
    """
    if shortest < 2 * q:
        raise ValueError(f"grams of {q} letters find words of at least {2 * q} letters only")
    if share < 2:
        raise ValueError("share must be 2 or more, so that no form leads back")
    vocab = stored(vocabulary(docs, shortest, fewest, loss), "spelling-words")
    both = near_pairs(sliced(shards(vocab), limit), q).unionByName(vocab.select("word", "n", F.lit(None).cast("string").alias("near"), F.lit(None).cast("long").alias("near_n")))
    best = F.min(F.when(F.col("near").isNotNull(), F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near"))))
    known = both.groupBy("word").agg(F.max("n").alias("n"), F.count("near").alias("n_near"), best.alias("best"))
    formed = F.when(-F.col("best.less") >= share * F.col("n"), F.col("best.near"))
    table = stored(known.select("word", formed.alias("form"), "n", "n_near", F.when(formed.isNotNull(), -F.col("best.less")).alias("form_n")), "spelling-forms")
    ends = roots(table.filter("form is not null"))
    return table.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
