"""Substring dedup: windows of consecutive words, partitioned as super-k-mers.

Of each window the minimiser is the smallest hash among its runs of MINI words.  Consecutive windows that share
a minimiser travel to that minimiser's bucket as one packed string.  Equal windows have equal minimisers, so
a bucket sees all places of its windows; it sorts the windows of each minimiser and compares their words.

Frequent windows (a passage, or a whole text, that many documents copy) never reach a bucket: those that are
frequent in some input partition are counted apart, with their smallest doc_id taken over all documents
(combined on the map side), and answered where they are read.
"""

from __future__ import annotations

import hashlib
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import columns_of, over_batches, release_shuffles, stored, utf8

#: Words in a window, and in a minimiser.
WINDOW, MINI = 13, 3
#: A window is hot when one partition holds it in so many of its documents; at most HOT_LIMIT are treated so.
HOT_PARTS, HOT_LIMIT = 24, 20_000
#: Text bytes a bucket is planned for.
BUCKET_BYTES = 12 << 20
#: A packed block: counts of super-k-mers and documents, then columns: document (its place in the block's own list),
#: first word, windows, bytes, minimiser (32 bits of it tell groups of a bucket apart), then the documents' ids and text
#: keys, then the text.
COLUMNS, DOCUMENTS = (("doc", "<i4"), ("first", "<i4"), ("n", "<i2"), ("size", "<i4"), ("mini", "<u4")), (("id", "<i8"), ("key", "<i8"))
NULL_ID = -(1 << 63)
#: Bytes of a line whose words are hashed at once.
SPAN = 1 << 18
#: Windows of one super-k-mer at most (a text of one repeated word has one minimiser throughout).
LONGEST = 1 << 12
#: Text bytes packed at a time.
BLOCK_BYTES = 12 << 20
#: Windows of one minimiser that are held as strings at once; more are compared in parts by a second hash of the window.
HELD_WINDOWS = 400_000
#: Shuffle partitions at most; beyond, a partition holds several buckets and reads them one after the other.
MAX_PARTS = 1 << 16


_P = np.uint64(0xD6E8FEB86659FD93)
_POWERS: list[np.ndarray] = []


def _powers() -> tuple[np.ndarray, np.ndarray]:
    """P**i and P**-i modulo 2**64, for i up to SPAN."""
    if not _POWERS:
        inverse = np.uint64(pow(int(_P), -1, 1 << 64))
        _POWERS.extend(np.multiply.accumulate(np.concatenate(([np.uint64(1)], np.full(SPAN, x, np.uint64)))) for x in (_P, inverse))
    return _POWERS[0], _POWERS[1]


def hashed(line: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, starts, ends) of the words of a line in which single spaces part them.

    A word's hash is a polynomial of its bytes, taken for all words at once from running sums; it is the same
    wherever the word stands.  Words longer than SPAN use XXH64.
    """
    import xxhash

    raw = np.frombuffer(line, np.uint8)
    spaces = np.flatnonzero(raw == 32)
    starts, ends = np.concatenate(([0], spaces + 1)), np.concatenate((spaces, [len(raw)]))
    up, down = _powers()
    out, i = np.empty(len(starts), np.uint64), 0
    while i < len(starts):
        at = int(starts[i])
        j = int(np.searchsorted(ends, at + SPAN, "right"))
        if j <= i:
            out[i] = xxhash.xxh64_intdigest(line[at : int(ends[i])])
            i += 1
            continue
        part = raw[at : int(ends[j - 1])]
        sums = np.concatenate(([np.uint64(0)], np.cumsum((part.astype(np.uint64) + np.uint64(1)) * up[: len(part)], dtype=np.uint64)))
        out[i:j] = (sums[ends[i:j] - at] - sums[starts[i:j] - at]) * down[starts[i:j] - at]
        i = j
    out ^= out >> np.uint64(32)
    out *= np.uint64(0x9FB21C651E98DF25)
    out ^= out >> np.uint64(29)
    return out, starts, ends


def rolling(hashes: np.ndarray, size: int) -> np.ndarray:
    """A mixed hash of each run of size words."""
    n = len(hashes) - size + 1
    out = np.zeros(n, np.uint64)
    for i in range(size):
        out = (out ^ hashes[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


def minimisers(hashes: np.ndarray, window: int = WINDOW, mini: int = MINI) -> np.ndarray:
    """The minimiser of each window: a sliding minimum, doubled up to the span."""
    best, span, want = rolling(hashes, mini), 1, window - mini + 1
    while span < want:
        step = min(span, want - span)
        best = np.minimum(best[:-step], best[step:])
        span += step
    return best


def super_kmers(mins: np.ndarray, usable: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(first, last + 1) windows of each run of equal minimisers; runs also end where
    windows are not usable, and at every LONGEST-th window, which changes no window."""
    n = len(mins)
    breaks = mins[1:] != mins[:-1]
    breaks[LONGEST - 1 :: LONGEST] = True
    if usable is not None:
        breaks |= usable[1:] != usable[:-1]
    cut = np.flatnonzero(breaks) + 1
    first, last = np.concatenate(([0], cut)), np.concatenate((cut, [n]))
    if usable is not None:
        first, last = first[usable[first]], last[usable[first]]
    return first, last


def hot_windows(texts: DataFrame, window: int = WINDOW, limit: int = HOT_LIMIT) -> dict[bytes, int]:
    """{window: smallest doc_id} of the windows that weigh most, exact over all documents.

    A partition names windows that at least 1/HOT_PARTS of its documents (and 32) hold; a window that a third
    of all rows share is named by some partition.  The most frequent `limit` of them are then looked up
    everywhere.  Any choice is exact: windows not named here go to their buckets.
    """
    schema = T.StructType([T.StructField("window", T.BinaryType()), T.StructField("n", T.LongType())])

    def named(batches):
        parts, samples = [], {}
        for batch in batches:
            lines = [b" ".join(t.split()) for t in utf8(batch.column(1)) if t]
            lines = [x for x in lines if x.count(b" ") >= window - 1]
            if not lines:
                continue
            values, counts = np.unique(np.concatenate([np.unique(rolling(hashed(x)[0], window)) for x in lines]), return_counts=True)
            often = counts >= max(32, len(lines) // HOT_PARTS)
            parts.append((values[often], counts[often]))
            wanted = set(values[often].tolist()) - samples.keys()
            for line in lines if wanted else ():
                hashes, starts, ends = hashed(line)
                all_of = rolling(hashes, window)
                for i in np.flatnonzero(np.isin(all_of, np.fromiter(wanted, np.uint64, len(wanted)))).tolist():
                    samples.setdefault(int(all_of[i]), line[starts[i] : ends[i + window - 1]])
                wanted -= samples.keys()
                if not wanted:
                    break
        if parts:
            values, inverse = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
            counts = np.bincount(inverse, np.concatenate([p[1] for p in parts])).astype(np.int64)
            picked = np.argsort(-counts, kind="stable")[:limit].tolist()
            yield pa.RecordBatch.from_arrays([pa.array([samples[int(values[i])] for i in picked], pa.binary()), pa.array(counts[picked])], names=["window", "n"])

    top = texts.mapInArrow(named, schema).groupBy("window").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "window").limit(limit).collect()
    found = {bytes(r["window"]) for r in top}
    if not found:
        return {}
    sent = texts.sparkSession.sparkContext.broadcast(found)
    least_schema = T.StructType([T.StructField("window", T.BinaryType()), T.StructField("doc_id", T.LongType())])

    def make():
        marks = _marks(sent.value, window)

        def step(batch: pa.RecordBatch):
            least: dict[bytes, int] = {}
            for doc, t in zip(batch.column(0).to_pylist(), utf8(batch.column(1)), strict=True):
                line = b" ".join((t or b"").split())
                if line.count(b" ") >= window - 1:
                    hashes, starts, ends = hashed(line)
                    for i in np.flatnonzero(np.isin(rolling(hashes, window), marks)).tolist():
                        w = line[starts[i] : ends[i + window - 1]]
                        if w in sent.value:
                            least[w] = min(least.get(w, doc), doc)
            yield {"window": list(least), "doc_id": list(least.values())}

        return step

    rows = over_batches(texts, make, least_schema).groupBy("window").agg(F.min("doc_id").alias("doc_id")).collect()
    return {bytes(r["window"]): r["doc_id"] for r in rows}


def _marks(windows, window: int) -> np.ndarray:
    return np.sort(np.array([int(rolling(hashed(w)[0], window)[0]) for w in windows], np.uint64))


RANGES = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text_key", T.LongType()), T.StructField("lo", T.IntegerType()), T.StructField("hi", T.IntegerType())])
PACKED = T.StructType([T.StructField("bucket", T.IntegerType()), T.StructField("blob", T.BinaryType()), *RANGES.fields])


def _runs(starts: np.ndarray, window: int) -> list[tuple[int, int]]:
    """Word ranges covered by the windows that start at the sorted starts, merged."""
    cut = np.flatnonzero(starts[1:] - starts[:-1] > window) + 1
    return [(int(p[0]), int(p[-1]) + window) for p in np.split(starts, cut)]


def pack(texts: DataFrame, buckets: int, hot: dict[bytes, int], window: int = WINDOW, mini: int = MINI) -> DataFrame:
    """Super-k-mers by bucket, compressed; and the word ranges already settled by hot windows (bucket null)."""
    sent = texts.sparkSession.sparkContext.broadcast(hot)

    def make():
        import zstandard

        squeeze = zstandard.ZstdCompressor(level=3).compress
        marks = _marks(sent.value, window)

        def blocks(parts: list, texts: list[bytes], ids: np.ndarray, keys: np.ndarray):
            if not parts:
                return
            doc, first, n, start, end, mins = (np.concatenate(c) for c in zip(*parts, strict=True))
            if not len(doc):
                return
            line = b"".join(texts)
            bucket = (mins >> np.uint64(32)) % np.uint64(buckets)
            order = np.argsort(bucket, kind="stable")
            doc, first, n, start, end, mins, bucket = (c[order] for c in (doc, first, n, start, end, mins, bucket))
            cut = np.concatenate(([0], np.flatnonzero(bucket[1:] != bucket[:-1]) + 1, [len(bucket)]))
            for i, j in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                members, place = np.unique(doc[i:j], return_inverse=True)
                columns = dict(zip([c for c, _ in COLUMNS], (place, first[i:j], n[i:j], end[i:j] - start[i:j], mins[i:j] & np.uint64(0xFFFFFFFF)), strict=True))
                raw = [struct.pack("<II", j - i, len(members)), *[columns[c].astype(k).tobytes() for c, k in COLUMNS], ids[members].astype("<i8").tobytes(), keys[members].astype("<i8").tobytes()]
                raw += [line[a:b] for a, b in zip(start[i:j].tolist(), end[i:j].tolist(), strict=True)]
                yield int(bucket[i]), squeeze(b"".join(raw)), None, None, None, None

        def step(batch: pa.RecordBatch):
            ids, keys = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            settled: list[tuple[int, int, int, int]] = []
            texts, parts, at, rows = [], [], 0, []
            for row, t in enumerate(utf8(batch.column(1))):
                line = b" ".join((t or b"").split())
                if line.count(b" ") < window - 1:
                    continue
                hashes, starts, ends = hashed(line)
                usable = None
                if len(marks):
                    doc, mine = int(ids[row]), []
                    for i in np.flatnonzero(np.isin(rolling(hashes, window), marks)).tolist():
                        least = sent.value.get(line[starts[i] : ends[i + window - 1]])
                        if least is not None:
                            usable = np.ones(len(hashes) - window + 1, bool) if usable is None else usable
                            usable[i] = False
                            if least < doc:
                                mine.append(i)
                    if mine:
                        settled += [(doc, int(keys[row]), lo, hi) for lo, hi in _runs(np.array(mine), window)]
                mins = minimisers(hashes, window, mini)
                first, last = super_kmers(mins, usable)
                parts.append((np.full(len(first), row), first, last - first, starts[first] + at, ends[last + window - 2] + at, mins[first]))
                texts.append(line)
                at += len(line)
                if at >= BLOCK_BYTES:
                    rows += blocks(parts, texts, ids, keys)
                    texts, parts, at = [], [], 0
            rows += blocks(parts, texts, ids, keys)
            rows += [(None, None, *x) for x in settled]
            for at in range(0, len(rows), 4096):
                yield dict(zip(("bucket", "blob", "doc_id", "text_key", "lo", "hi"), map(list, zip(*rows[at : at + 4096], strict=True)), strict=True))

        return step

    return over_batches(texts, make, PACKED)


def unpack(blobs: list[bytes]) -> tuple[dict[str, np.ndarray], bytes]:
    """(columns doc_id, key, first, n, offset, size, mini; text) of a bucket."""
    import zstandard

    parts, texts, at = [], [], 0
    for blob in blobs:
        raw = zstandard.ZstdDecompressor().decompress(blob)
        n, n_docs = struct.unpack_from("<II", raw)
        pos, column = 8, {}
        for (name, kind), many in [(c, n) for c in COLUMNS] + [(c, n_docs) for c in DOCUMENTS]:
            column[name] = np.frombuffer(raw, kind, many, pos)
            pos += column[name].nbytes
        column["offset"] = np.cumsum(column["size"], dtype=np.int64) - column["size"] + at
        column["id"], column["key"] = column["id"][column["doc"]], column["key"][column["doc"]]
        texts.append(raw[pos:])
        at += len(texts[-1])
        parts.append(column)
    return {k: np.concatenate([p[k] for p in parts]) for k in parts[0] if k != "doc"}, b"".join(texts)


def repeated(blobs: list[bytes], window: int = WINDOW):
    """(doc, text key, window start) of windows whose words also start in a smaller document, in one bucket."""
    head, text = unpack(blobs)
    order = np.lexsort((head["first"], head["id"], head["mini"]))
    mini, doc = head["mini"][order], head["id"][order]
    cut = np.concatenate(([0], np.flatnonzero(mini[1:] != mini[:-1]) + 1, [len(order)]))
    several = doc[cut[:-1]] != doc[cut[1:] - 1]  # a minimiser of one document cannot repeat in another
    hits = []
    for s, e in zip(cut[:-1][several].tolist(), cut[1:][several].tolist(), strict=True):
        own = order[s:e]
        parts = int(-(-int(head["n"][own].sum()) // HELD_WINDOWS))
        for part in range(parts):
            windows = []
            for r in own.tolist():
                at, size, n = int(head["offset"][r]), int(head["size"][r]), int(head["n"][r])
                line = text[at : at + size]
                words = line.split(b" ")
                chosen = range(n) if parts == 1 else np.flatnonzero(rolling(hashed(line)[0], window)[:n] % np.uint64(parts) == part).tolist()
                d, k, i = int(head["id"][r]), int(head["key"][r]), int(head["first"][r])
                windows += [(b" ".join(words[w : w + window]), d, k, i + w) for w in chosen]
            windows.sort()
            before, least = None, 0
            for w, d, k, i in windows:
                if w != before:
                    before, least = w, d
                elif least < d:
                    hits.append((d, k, i))
    return hits


def removed_ranges(texts: DataFrame, buckets: int, window: int = WINDOW, mini: int = MINI, hot: dict[bytes, int] | None = None) -> DataFrame:
    """(doc_id, text_key, lo, hi): word ranges to remove from texts (doc_id not null, text, text_key)."""
    hot = hot_windows(texts, window) if hot is None else hot
    packed = pack(texts, buckets, hot, window, mini)
    parts = min(buckets, MAX_PARTS)
    place = F.coalesce("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(buckets)).cast("int"))
    dealt = packed.withColumn("to", F.pmod(place, F.lit(parts)).cast("int")).repartitionById(parts, F.col("to")).sortWithinPartitions(F.col("bucket").asc_nulls_first())

    def run(batches):
        bucket, blobs = None, []

        def flush():
            if blobs:
                hits = repeated(blobs, window)
                found: dict[tuple[int, int], list[int]] = {}
                for d, k, i in hits:
                    found.setdefault((d, k), []).append(i)
                rows = [(d, k, lo, hi) for (d, k), starts in found.items() for lo, hi in _runs(np.array(sorted(starts)), window)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True)], names=["doc_id", "text_key", "lo", "hi"])

        for batch in batches:
            col = {n: batch.column(n) for n in batch.schema.names}
            ready = col["bucket"].is_null()
            if batch.num_rows and ready.true_count:
                yield pa.RecordBatch.from_arrays([col[n].filter(ready) for n in ("doc_id", "text_key", "lo", "hi")], names=["doc_id", "text_key", "lo", "hi"])
            for b, blob in zip(col["bucket"].to_pylist(), col["blob"].to_pylist(), strict=True):
                if b is None:
                    continue
                if b != bucket:
                    yield from flush()
                    bucket, blobs = b, []
                blobs.append(blob)
        yield from flush()

    return dealt.drop("to").mapInArrow(run, RANGES)


RESULT = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_text", T.StringType())])


def substring_dedup(docs: DataFrame, window: int = WINDOW, mini: int = MINI, bucket_bytes: int = BUCKET_BYTES, keep_text: bool = True, hot: dict[bytes, int] | None = None) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256 and, with keep_text, kept_text.

    Null texts have no words.  A null doc_id counts as smaller than all others; rows that share a doc_id are
    no copies of each other.  Texts shorter than a window lose nothing.
    """
    base = columns_of(docs).select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("text_key", F.xxhash64("text")).withColumn("id", F.coalesce("doc_id", F.lit(NULL_ID)))
    size = base.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    texts = base.select(F.col("id").alias("doc_id"), "text", "text_key")
    found = removed_ranges(texts, max(1, int(-(-size // bucket_bytes))), window, mini, hot)
    ranges = stored(found.groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("lo", "hi")).alias("ranges")), "spans-ranges")
    release_shuffles(docs.sparkSession)
    marked = base.join(ranges.withColumnRenamed("doc_id", "id"), ["id", "text_key"], "left").select("doc_id", "text", "ranges")
    return finish(marked, keep_text)


def finish(marked: DataFrame, keep_text: bool) -> DataFrame:
    schema = T.StructType([*RESULT.fields[:3], T.StructField("kept_sha256", T.StringType()), *RESULT.fields[3:][: int(keep_text)]])

    def make():
        def step(batch: pa.RecordBatch):
            n_words, n_removed, digest, kept = [], [], [], []
            for t, ranges in zip(utf8(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                words = t.split()
                n = len(words)
                if ranges:
                    gone = np.zeros(n, bool)
                    for r in ranges:
                        gone[r["lo"] : r["hi"]] = True
                    words = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
                n_words.append(n)
                n_removed.append(n - len(words))
                text = b" ".join(words)
                digest.append(hashlib.sha256(text).hexdigest())
                if keep_text:
                    kept.append(text.decode("utf-8", "replace"))
            yield {"doc_id": batch.column(0), "n_words": n_words, "n_removed": n_removed, "kept_sha256": digest} | ({"kept_text": kept} if keep_text else {})

        return step

    return over_batches(marked, make, schema)
