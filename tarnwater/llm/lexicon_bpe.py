"""Byte-pair encoding and decoding with a lexicon of frequent words, compiled into a minimal acyclic transducer.

The words of all texts are counted; the most frequent ones, at most LEXICON_WORDS, are encoded once and compiled: sorted words are
added one after another, states with equal futures are shared as soon as no later word can change them, and ids are written as
near to the start as words agree on them.  The automaton is one file in the shared folder, which Spark hands to every
executor and whose pages all its Python workers map.  A word that the automaton does not hold is merged exactly, by a heap of
adjacent pairs.  Since the lexicon holds the ids that merging gives, it changes speed and nothing else.

Texts are encoded where they are read: nothing but word counts is shuffled.
"""

from __future__ import annotations

import hashlib
import json
import mmap
import re
import unicodedata
import uuid
from array import array
from collections.abc import Callable, Iterable
from heapq import heapify, heappop, heappush
from pathlib import Path

import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import columns_of, over_batches, per_worker, shared_dir, stored, text_column

#: Words of the automaton at most, and letters of such a word at most: what bounds the driver's part and the file.
LEXICON_WORDS, LEXICON_LETTERS = 1 << 16, 64
#: Words whose ids a worker remembers between texts, some 350 bytes each; it starts anew when they are so many.
REMEMBERED = 1 << 18
#: Bytes of a word up to which its pairs are looked through for each merge, which is faster than a heap.
SHORT = 32

#: Fixed values of the vocabulary's splitting rule: endings, runs of letters, single digits, runs of other signs.
ENDINGS = "'s|'t|'re|'ve|'m|'ll|'d"
#: After lower-casing; white space only separates.
ASCII_WORDS = re.compile(rf"{ENDINGS}|[a-z]+|[0-9]|[^\t-\r a-z0-9]+")
#: Letters and numbers given out after Unicode 16, which the splitting rule takes for other signs (hexadecimal).
LATE = (
    "558 58B-58C 88F C5C CDC 208F 209D-209F A7CE-A7CF A7D2 A7D4 A7DD A7E2 A7F1 AB6C-AB6D 107BB-107BF 10940-10959 10EC5-10EC7 10ED9-10EEE 11B0A 11DB0-11DDB 11DE0-11DE9 11DF1 "
    "1246F 12475-1247F 12550-12686 16EA0-16EB8 16EBB-16ED3 16FF2-16FF6 187F8-187FF 18CD6-18CDA 18D09-18D20 18D80-18DF2 18E00-191D2 1B123-1B128 1B168 1D6A6 1DF1F-1DF24 1DF2B-1DF81 "
    "1DF90-1DF96 1DFCD-1DFFF 1E6C0-1E6DE 1E6E0-1E6E2 1E6E4-1E6E5 1E6E7-1E6ED 1E6F0-1E6F4 1E6FE-1E6FF 2B73A-2B73F 2B81E 2CEA2-2CEAD 323B0-33479 3D000-3FC3F"
)
#: Capitals that have got small letters after Unicode 15.1, and the distance to those (hexadecimal).
LATE_CAPITALS = "1C89+1 A7CB-A567 A7CC+1 A7CE+1 A7D2+1 A7D4+1 A7DA+1 A7DC-A641 " + " ".join([f"{c:X}+20" for c in range(0x10D50, 0x10D66)] + [f"{c:X}+1B" for c in range(0x16EA0, 0x16EB9)])


def words_pattern() -> regex.Pattern:
    late = "".join("-".join(rf"\U{int(c, 16):08X}" for c in part.split("-")) for part in LATE.split())
    letter, number = rf"[\p{{L}}--[{late}]]", rf"[\p{{N}}--[{late}]]"
    return regex.compile(rf"{ENDINGS}|{letter}+|{number}|[[^\p{{White_Space}}\p{{L}}\p{{N}}]||[{late}]]+", regex.V1)


WORDS = words_pattern()


def basic_pattern() -> re.Pattern:
    """The same rule for texts of the first 65,536 code points, for the standard library's faster matcher: letters, numbers and spaces by table."""
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x10000)]))
    late = "".join("-".join(rf"\U{int(c, 16):08X}" for c in part.split("-")) for part in LATE.split())

    def listed(kind: str, but: str = "") -> str:
        spans: list[list[int]] = []
        for c in map(ord, regex.findall(rf"[\p{{{kind}}}--[{but}]]" if but else rf"\p{{{kind}}}", every, regex.V1)):
            if spans and spans[-1][1] == c - 1:
                spans[-1][1] = c
            else:
                spans.append([c, c])
        return "".join(rf"\u{a:04X}-\u{b:04X}" for a, b in spans)

    letters, numbers = listed("L", late), listed("N", late)
    return re.compile(rf"{ENDINGS}|[{letters}]+|[{numbers}]|[^{listed('White_Space')}{letters}{numbers}]+")


BASIC_WORDS = basic_pattern()
BEYOND_BASIC = re.compile("[\U00010000-\U0010FFFF]")
#: Small letters for capitals, as far as str.lower() does not do the same: a sigma at a word's end is a sigma like any other.
LOWER_FIRST = {ord("Σ"): "σ"} | {int(c[: -len(step)], 16): chr(int(c[: -len(step)], 16) + int(step, 16)) for c in LATE_CAPITALS.split() for step in re.findall(r"[+-]\w+$", c)}
LOWERED_FIRST = re.compile("[Σ\u1C89\uA7CB-\uA7DC\U00010D50-\U00016EB8]")


def byte_letters() -> list[str]:
    """The letter that stands for each byte: itself where it prints and is no space, else the next unused one from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, spare = [], 256
    for b in range(256):
        out.append(chr(b if b in plain else spare))
        spare += b not in plain
    return out


NO_MERGE, LOW = 1 << 62, (1 << 32) - 1


class Vocabulary:
    """Tokens, merges and special tokens of a vocabulary file in the JSON form of byte-level BPE with word ends.

    Only what such a file says is done: canonical composition, white space as a separator, lower case, no prefix space.
    """

    def __init__(self, content: str) -> None:
        file = json.loads(content)
        model = file["model"]
        if model.get("type", "BPE") != "BPE" or model.get("dropout") or model.get("ignore_merges") or model.get("continuing_subword_prefix") or file.get("decoder"):
            raise ValueError("a byte-level BPE vocabulary with word ends and without decoder is needed")
        self.end = model.get("end_of_word_suffix") or ""
        ids = model["vocab"]
        self.tokens = {i: t for t, i in ids.items()} | {t["id"]: t["content"] for t in file["added_tokens"]}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        #: Two ids in one number to rank and new id in one number, so that the least one is the merge to make.
        self.merges = {ids[a] << 32 | ids[b]: rank << 32 | ids[a + b] for rank, (a, b) in enumerate(pairs)}
        letters = byte_letters()
        self.inner, self.last = [ids[c] for c in letters], [ids[c + self.end] for c in letters]
        self.special = {t["content"]: t["id"] for t in file["added_tokens"]}
        self.cut = re.compile("(" + "|".join(re.escape(s) for s in sorted(self.special, key=lambda s: (-len(s), s))) + ")") if self.special else None

    def pieces(self, text: str) -> Iterable[str]:
        """Special tokens as they stand in the text, and the stretches between them."""
        return self.cut.split(text) if self.cut else [text]

    def merged(self, word: bytes) -> list[int]:
        """The ids of a word: the adjacent pair of lowest rank is merged first, the leftmost of equal ones."""
        ids = [self.inner[b] for b in word]
        ids[-1] = self.last[word[-1]]
        return self._few(ids) if len(ids) <= SHORT else self._many(ids)

    def _few(self, ids: list[int]) -> list[int]:
        get, none = self.merges.get, NO_MERGE
        ways = [get(a << 32 | b, none) for a, b in zip(ids, ids[1:])]
        while ways:
            way = min(ways)
            if way == none:
                break
            i = ways.index(way)
            ids[i] = new = way & LOW
            del ids[i + 1], ways[i]
            if i:
                ways[i - 1] = get(ids[i - 1] << 32 | new, none)
            if i < len(ways):
                ways[i] = get(new << 32 | ids[i + 1], none)
        return ids

    def _many(self, ids: list[int]) -> list[int]:
        """The same by a heap of pairs: n log n steps for n bytes."""
        n = len(ids)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        get, none = self.merges.get, NO_MERGE
        heap = [(way, i) for i in range(n - 1) if (way := get(ids[i] << 32 | ids[i + 1], none)) != none]
        heapify(heap)
        while heap:
            way, i = heappop(heap)
            j = after[i]
            if ids[i] < 0 or j < 0 or get(ids[i] << 32 | ids[j]) != way:
                continue
            ids[i], ids[j] = new, _ = way & LOW, -1
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                if (way := get(new << 32 | ids[k], none)) != none:
                    heappush(heap, (way, i))
            h = before[i]
            if h >= 0 and (way := get(ids[h] << 32 | new, none)) != none:
                heappush(heap, (way, h))
        return [i for i in ids if i >= 0]


def split_words(text: str) -> list[str]:
    """The words that are encoded one by one, of a stretch without special tokens."""
    if text.isascii():
        return ASCII_WORDS.findall(text.lower())
    text = unicodedata.normalize("NFC", text)
    if LOWERED_FIRST.search(text):
        text = text.translate(LOWER_FIRST)
    return (WORDS if BEYOND_BASIC.search(text) else BASIC_WORDS).findall(text.lower())


# --- The transducer -----------------------------------------------------------------------------------------------


class _State:
    __slots__ = ("edges", "final")

    def __init__(self) -> None:
        self.edges: dict[int, list] = {}  # byte to [output, state]; a dict keeps the order in which bytes came
        self.final: tuple[int, ...] | None = None

    def future(self) -> tuple:
        return self.final, *((b, out, id(to)) for b, (out, to) in self.edges.items())


def _agreed(a: tuple[int, ...], b: tuple[int, ...]) -> int:
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return n


def minimal_transducer(entries: Iterable[tuple[bytes, tuple[int, ...]]]) -> _State:
    """The smallest acyclic automaton that turns each word into its ids, from words in strictly rising order.

    Outputs stand as early as possible; finished states are looked up in a register by output, edges and targets.
    """
    register: dict[tuple, _State] = {}
    path, previous = [_State()], b""

    def settle(depth: int) -> None:
        for i in range(len(path) - 1, depth, -1):
            state = register.setdefault(path[i].future(), path[i])
            path[i - 1].edges[previous[i - 1]][1] = state
            path.pop()

    for word, ids in entries:
        if previous >= word and (previous or path[0].final is not None):
            raise ValueError("words must rise")
        shared = next((i for i, (x, y) in enumerate(zip(previous, word)) if x != y), min(len(previous), len(word)))
        settle(shared)
        left = ids
        for i in range(shared):  # outputs that the new word does not share move one state on
            edge = path[i].edges[word[i]]
            n = _agreed(edge[0], left)
            rest, edge[0], left = edge[0][n:], edge[0][:n], left[n:]
            if rest:
                state = path[i + 1]
                for out in state.edges.values():
                    out[0] = rest + out[0]
                if state.final is not None:
                    state.final = rest + state.final
        for b in word[shared:]:
            state = _State()
            path[-1].edges[b] = [left, state]
            path.append(state)
            left = ()
        path[-1].final = left
        previous = word
    settle(0)
    return path[0]


def states_of(start: _State) -> list[_State]:
    """All states that can be reached, the start first."""
    found, order = {id(start)}, [start]
    for state in order:
        for _, to in state.edges.values():
            if id(to) not in found:
                found.add(id(to))
                order.append(to)
    return order


def packed(start: _State) -> bytes:
    """The automaton as one file: sizes; per state its first edge and its final output; per edge target and output; outputs; labels."""
    order = states_of(start)
    number = {id(s): i for i, s in enumerate(order)}
    outputs: dict[tuple[int, ...], int] = {(): 0}
    first, final, target, output, labels = array("i"), array("i"), array("i"), array("i"), bytearray()
    for state in order:
        first.append(len(labels))
        final.append(-1 if state.final is None else outputs.setdefault(state.final, len(outputs)))
        for b, (out, to) in state.edges.items():
            labels.append(b)
            target.append(number[id(to)])
            output.append(outputs.setdefault(out, len(outputs)))
    first.append(len(labels))
    starts, ids = array("i", [0]), array("i")
    for out in outputs:
        ids.extend(out)
        starts.append(len(ids))
    parts = [first, final, target, output, starts, ids]
    return array("i", [len(p) for p in parts]).tobytes() + b"".join(p.tobytes() for p in parts) + bytes(labels)


class Lexicon:
    """A mapped automaton file."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as f:
            self.pages = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        whole = memoryview(self.pages)
        sizes, at = whole[:24].cast("i").tolist(), 24
        views = []
        for n in sizes:
            views.append(whole[at : at + 4 * n].cast("i"))
            at += 4 * n
        self.first, self.final, self.target, self.output, self.starts, self.ids = views
        self.labels = at

    def get(self, word: bytes) -> list[int] | None:
        """The ids of a word, or None if the automaton does not hold it."""
        state, out = 0, []
        first, base, find = self.first, self.labels, self.pages.find
        for i in range(len(word)):
            e = find(word[i : i + 1], base + first[state], base + first[state + 1]) - base
            if e < 0:
                return None
            state = self.target[e]
            if o := self.output[e]:
                out += self.ids[self.starts[o] : self.starts[o + 1]]
        o = self.final[state]
        return None if o < 0 else [*out, *self.ids[self.starts[o] : self.starts[o + 1]]] if o else out


# --- On Spark -------------------------------------------------------------------------------------------------------


def frequent_words(docs: DataFrame, most: int = LEXICON_WORDS) -> list[str]:
    """The most frequent words of all texts, at most `most` of LEXICON_LETTERS letters at most; those of one count class go or stay together."""
    words = F.regexp_extract_all(F.lower(text_column(docs)), F.lit(rf"{ENDINGS}|\p{{L}}+|\p{{N}}|[^\s\p{{L}}\p{{N}}]+"), F.lit(0))
    counts = docs.select(F.explode(words).alias("word")).filter(F.length("word") <= LEXICON_LETTERS).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    counts = stored(counts.select("word", F.floor(F.log2("n") * 16).cast("int").alias("class")), "bpe-words")
    room, least = most, None
    for row in sorted(counts.groupBy("class").count().collect(), key=lambda r: -r["class"]):
        room -= row["count"]
        if room < 0:
            break
        least = row["class"]
    return [] if least is None else [r.word for r in counts.filter(F.col("class") >= least).select("word").collect()]


def publish(spark: SparkSession, content: bytes) -> str:
    """Put a small file into the shared folder and let Spark hand it to all executors, later ones too; its name for SparkFiles."""
    folder, name = shared_dir(spark, "bpe-lexicon"), f"lexicon-{uuid.uuid4().hex}.bin"
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
    out = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(place)
    try:
        for at in range(0, len(content), 1 << 20):
            out.write(bytearray(content[at : at + (1 << 20)]))
    finally:
        out.close()
    spark.sparkContext.addFile(f"{folder}/{name}")
    return name


def compiled(words: Iterable[str], vocabulary: Vocabulary) -> bytes:
    """The automaton file of the words with the ids that merging gives; a word that no text is split into does no harm."""
    entries = {w.encode() for w in words if w}
    return packed(minimal_transducer((w, tuple(vocabulary.merged(w))) for w in sorted(entries)))


SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])


def encode_decode(docs: DataFrame, vocabulary_path: str, keep: bool = False, most: int = LEXICON_WORDS) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_sha256 (of the decimal ids, joined by a space), decoded_sha256 (of the tokens, joined
    by a space, as a vocabulary without decoder gives them).  With keep, ids (array of int) and decoded (string) follow.

    Whole texts; special tokens in a text become their ids; null texts are empty; a null doc_id stays null; repeated rows give
    repeated rows; empty tables give no rows; columns other than doc_id and text are not read.  vocabulary_path is a file that the
    driver can read; its text, some MB, goes to the workers with the automaton.
    """
    spark = docs.sparkSession
    docs = columns_of(docs)
    content = Path(vocabulary_path).read_text(encoding="utf-8")
    shared = spark.sparkContext.broadcast(content)
    name = publish(spark, compiled(frequent_words(docs, most), Vocabulary(content)))
    digest = hashlib.sha256(content.encode()).hexdigest()
    schema = T.StructType(SCHEMA.fields + [T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())]) if keep else SCHEMA

    def make() -> Callable[[pa.RecordBatch], list[dict[str, list]]]:
        vocabulary = per_worker(f"bpe-{digest}", lambda: Vocabulary(shared.value))
        lexicon = per_worker(f"bpe-{name}", lambda: Lexicon(SparkFiles.get(name)))
        known: dict[str, tuple[bytes, bytes]] = per_worker(f"bpe-known-{name}", dict)

        def told(ids: list[int]) -> tuple[bytes, bytes]:
            return " ".join(map(str, ids)).encode(), " ".join([vocabulary.tokens[i] for i in ids]).encode()

        specials = {s: told([i]) for s, i in vocabulary.special.items()}

        def entry(word: str) -> tuple[bytes, bytes]:
            raw = word.encode()
            ids = lexicon.get(raw)
            made = told(vocabulary.merged(raw) if ids is None else ids)
            if len(word) <= LEXICON_LETTERS:
                if len(known) >= REMEMBERED:
                    known.clear()
                known[word] = made
            return made

        def entries_of(text: str) -> list[tuple[bytes, bytes]]:
            out: list[tuple[bytes, bytes]] = []
            for piece in vocabulary.pieces(text):
                if piece in specials:
                    out.append(specials[piece])
                elif piece:
                    words = split_words(piece)
                    found = list(map(known.get, words))
                    if None in found:
                        found = [e or known.get(w) or entry(w) for e, w in zip(found, words)]
                    out += found
            return out

        def step(batch: pa.RecordBatch) -> list[dict[str, list]]:
            out: dict[str, list] = {f.name: [] for f in schema}
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids, decoded = map(b" ".join, zip(*entries)) if (entries := entries_of(text or "")) else (b"", b"")
                row = [doc_id, ids.count(b" ") + 1 if ids else 0, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded).hexdigest()]
                if keep:
                    row += [list(map(int, ids.split())), decoded.decode()]
                for f, value in zip(schema, row):
                    out[f.name].append(value)
            return [out]

        return step

    return over_batches(docs, make, schema)
