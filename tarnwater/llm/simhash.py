"""SimHash near-duplicates: majority-bit fingerprints of word shingles, compared bit-sliced."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bitslice import BREADTH_FIRST, block_masks, blocks_for, bucket_pairs, large_bucket, small_buckets, spanning
from .candidates import EDGES, bucket_candidates, found_schema, links_in_rounds
from .common import LOWER, columns_of, hot_join, keep_documents, over_batches, stored, utf8, whole_groups
from .components import connected_components

#: Words a shingle, and bits in which linked fingerprints may differ.
SHINGLE, RADIUS = 4, 4
#: Shingle hashes whose bits are counted at a time.
CHUNK = 1 << 16
#: The same for wide fingerprints.
WIDE_CHUNK = 1 << 13


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """Bit i is set if more than half of the shingles' XXH64 values (seed 42) have it; 0 without words."""
    import xxhash

    words = text.translate(LOWER).split()
    if not words:
        return 0
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return digest(joined, 42)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *ends[: -shingle].tolist()]
    stops = (ends[shingle - 1 :] - 1).tolist()
    n, counts = len(starts), np.zeros(64, np.int64)
    for at in range(0, n, CHUNK):
        hashes = np.array([digest(joined[i:j], 42) for i, j in zip(starts[at : at + CHUNK], stops[at : at + CHUNK], strict=True)], np.uint64)
        counts += _ones(hashes)
    return int(np.packbits(counts * 2 > n, bitorder="little").view(np.uint64)[0])


def _ones(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit: byte lanes of eight hashes' bits are summed at once."""
    total = np.zeros(64, np.int64)
    lane = np.uint64(0x0101010101010101)
    for at in range(0, len(hashes), 255 * 64):
        part = hashes[at : at + 255 * 64]
        rows = len(part) // 64 or 1
        # Sums of up to 255 one-bit bytes fit a byte.
        for b in range(8):
            spread = (part >> np.uint64(b)) & lane
            full = spread[: rows * (len(part) // rows)].reshape(rows, -1).sum(axis=0, dtype=np.uint64) if rows <= 255 else None
            total[b::8] += full.view(np.uint8).reshape(-1, 8).sum(axis=0, dtype=np.int64)
            rest = spread[rows * (len(part) // rows) :]
            if len(rest):
                total[b::8] += rest.view(np.uint8).reshape(-1, 8).sum(axis=0, dtype=np.int64)
    return total


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp long, text_key) for each row; null and wordless texts have fingerprint 0."""
    keyed = columns_of(docs).select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("text_key", F.xxhash64("text"))
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("fp", T.LongType()), T.StructField("text_key", T.LongType())])

    def make():
        def step(batch: pa.RecordBatch):
            values = np.array([fingerprint(t or b"", shingle) for t in utf8(batch.column(1))], np.uint64)
            yield {"doc_id": batch.column(0), "fp": pa.array(values.view(np.int64)), "text_key": batch.column(2)}

        return step

    return over_batches(keyed, make, schema)


def bucket_links(dealt: DataFrame, radius: int, masks: list[int]) -> DataFrame:
    """Links (a, b) that span the groups of each bucket of dealt (t, key, rep, fp), sorted by (t, key).

    Members are compared bit-sliced on fp; masks holds for each table t the planes that its key fixes, which need no
    comparing.  A link within radius is final, so each member gets at most one link a bucket, and a dense group never
    turns into all pairs.
    """

    def run(batches):
        for starts, ends, (t, _, rep, fp) in whole_groups(batches, 2):
            values = fp.view(np.uint64)
            for table in np.unique(t[starts]):
                mine = t[starts] == table
                big = mine & (ends - starts > BREADTH_FIRST)
                parts = [small_buckets(values, starts[mine & ~big], ends[mine & ~big], radius, masks[table])]
                for s, e in zip(starts[big].tolist(), ends[big].tolist(), strict=True):
                    i, j = large_bucket(values[s:e], radius, masks[table])
                    parts.append((i + s, j + s))
                for i, j in parts:
                    if len(i):
                        a, b = spanning(i, j)
                        yield pa.RecordBatch.from_arrays([pa.array(rep[a]), pa.array(rep[b])], names=["a", "b"])

    return dealt.mapInArrow(run, EDGES)


def linked(classes: DataFrame, n: int, radius: int = RADIUS, blocks: int | None = None) -> DataFrame:
    """Links (a, b) of representatives that span the groups of classes (fp, rep) within radius of each other.

    Every pair within radius agrees on some choice of blocks and so meets in a bucket.
    """
    masks = block_masks(blocks or blocks_for(n, radius), radius)
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    tables = F.array(*[F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(m).cast("long")).alias("key")) for i, m in enumerate(signed)])
    dealt = classes.select("fp", "rep", F.explode(tables).alias("k")).select("k.t", "k.key", "rep", "fp")
    return bucket_links(dealt.repartition("t", "key").sortWithinPartitions("t", "key"), radius, masks)


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id, text_key.

    component_id is the smallest doc_id reachable over links of at most radius bits, the row's own included;
    nulls are ignored unless a group has nothing else (then null).  Equal fingerprints are one class, so copies
    are never expanded into pairs.  Null or empty texts share fingerprint 0.  Empty tables give no rows.
    """
    rows = stored(fingerprints(docs, shingle), "simhash-rows")
    # A class is named by its fingerprint; representatives of equal doc_id (or none) stay apart that way.
    classes = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")), "simhash-classes")
    links = linked(classes.select("fp", F.col("fp").alias("rep")), classes.count(), radius)
    groups = connected_components(links)
    member = classes.join(groups, classes["fp"] == groups["node"], "left").select("fp", "least", "n", F.coalesce("component", "fp").alias("component"))
    member = stored(member, "simhash-members")
    smallest = member.groupBy("component").agg(F.min("least").alias("component_id"), F.sum("n").alias("group_n"))
    named = stored(hot_join(member, stored(smallest.withColumn("w", F.lit(1)), "simhash-groups"), ["component"], "w", "inner").select("fp", "component_id", "n"), "simhash-names")
    found = hot_join(rows, named, ["fp"], "n", "inner")
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "text_key")


#: Words of a wide fingerprint, whose bits estimate the similarity of two texts' shingles: those that buckets compare,
#: and those by which a link is checked.
WIDE, CHECKED = 4, 16
#: Chance with which a pair at the similarity asked for meets in some table; the slack of the comparisons comes on top.
RECALL = 0.99
#: Mean members of a bucket that the tables' key width aims at.
PER_BUCKET = 64


def differing(similarity: float) -> float:
    """Expected share of differing bits of two texts whose shingle sets have this Jaccard similarity."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def shingle_hashes(text: bytes, shingle: int) -> np.ndarray:
    """The distinct 64-bit hashes of a text's shingles, sorted: the whole text's if it has fewer words, none without words."""
    import xxhash

    tokens = text.translate(LOWER).split()
    if not tokens:
        return np.empty(0, np.uint64)
    joined, digest = b" ".join(tokens), xxhash.xxh64_intdigest
    ends = np.cumsum([len(w) + 1 for w in tokens])
    spans = zip([0, *ends[:-shingle].tolist()], (ends[shingle - 1 :] - 1).tolist(), strict=True) if len(tokens) > shingle else [(0, len(joined))]
    return np.unique(np.array([digest(joined[i:j], 42) for i, j in spans], np.uint64))


def wide_fingerprint(hashes: np.ndarray, words: int = CHECKED) -> np.ndarray:
    """Majority bits of the distinct shingles' hashes and of further mixes of them; zeros without words.

    Where as many hashes have a bit as not, the smallest hash decides: short texts would else look alike.
    """
    if not len(hashes):
        return np.zeros(words, np.uint64)
    twice, first = np.zeros((words, 64), np.int64), None
    for at in range(0, len(hashes), WIDE_CHUNK):
        mixed = np.empty((words, len(hashes[at : at + WIDE_CHUNK])), np.uint64)
        mixed[0] = hashes[at : at + WIDE_CHUNK]
        for k in range(1, words):
            mixed[k] = (mixed[k - 1] ^ (mixed[k - 1] >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
            mixed[k] ^= mixed[k] >> np.uint64(29)
        bits = np.unpackbits(mixed.view(np.uint8).reshape(words, -1, 8), axis=2, bitorder="little")
        first = bits[:, 0].astype(bool) if first is None else first
        # Eight bytes of counts are added at a time; no byte sums more than 255.
        sums = np.add.reduceat(bits.view(np.uint64), np.arange(0, bits.shape[1], 255), axis=1)
        twice += 2 * sums.view(np.uint8).sum(axis=1, dtype=np.int64)
    chosen = (twice > len(hashes)) | ((twice == len(hashes)) & first)
    return np.packbits(chosen, axis=1, bitorder="little").view(np.uint64).ravel()


def tables_for(n: int, similarity: float, words: int = WIDE) -> list[list[int]]:
    """The bits that each table samples from a wide fingerprint: enough tables that a pair at the similarity meets in one
    of them with probability RECALL, keys just wide enough for buckets of PER_BUCKET on average."""
    width = min(24, max(8, int(math.log2(max(2, n) / PER_BUCKET))))
    meet = (1 - differing(similarity)) ** width
    many = math.ceil(math.log(1 - RECALL) / math.log(1 - meet))
    rng = np.random.default_rng(20240607)
    return [sorted(rng.choice(64 * words, width, replace=False).tolist()) for _ in range(many)]


def shingle_sets(keyed: DataFrame, wanted: DataFrame, shingle: int) -> DataFrame:
    """(rep, size, held): the sorted shingle hashes of the text that `one` (doc_id, text_key) names, for each row (rep, one)."""
    own = wanted.select("rep", F.col("one.doc_id").alias("__id"), F.col("one.text_key").alias("__key"))
    texts = keyed.join(own, keyed["doc_id"].eqNullSafe(F.col("__id")) & (keyed["text_key"] == F.col("__key"))).select("rep", "text")
    schema = T.StructType([T.StructField("rep", T.LongType()), T.StructField("size", T.LongType()), T.StructField("held", T.ArrayType(T.LongType(), False))])

    def make():
        def step(batch: pa.RecordBatch):
            sets = [shingle_hashes(t, shingle).view(np.int64) for t in utf8(batch.column(1))]
            yield {"rep": batch.column(0), "size": [len(x) for x in sets], "held": pa.array(sets, pa.list_(pa.field("element", pa.int64(), False)))}

        return step

    return over_batches(texts, make, schema).dropDuplicates(["rep"])


def alike(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose sets have at least this Jaccard similarity; sets whose sizes rule it out are not compared."""
    sizes = sets.select("rep", "size")
    fit = pairs.join(sizes.select(F.col("rep").alias("a"), F.col("size").alias("na")), "a").join(sizes.select(F.col("rep").alias("b"), F.col("size").alias("nb")), "b")
    fit = fit.filter(F.least("na", "nb") >= similarity * F.greatest("na", "nb") - 1e-9)
    both = fit.join(sets.select(F.col("rep").alias("a"), F.col("held").alias("ha")), "a").join(sets.select(F.col("rep").alias("b"), F.col("held").alias("hb")), "b")
    shared = F.size(F.array_intersect("ha", "hb"))
    return both.filter(shared >= similarity * (F.col("na") + F.col("nb") - shared) - 1e-9).select("a", "b")


def similar_documents(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """One row per document: doc_id, component_id (smallest doc_id of its group), text_key.

    Texts are linked when the Jaccard similarity of their sets of word shingles is that high; sets of 64-bit hashes are compared
    whole.  Fingerprints only propose: tables of sampled bits bring texts together whose wide fingerprints differ in few bits; inside
    a bucket fingerprints are compared bit-sliced on their first word and survivors on WIDE words; what is left within the expected
    distance on CHECKED words, two standard deviations allowed, is verified in rounds (see candidates), so that a refused pair
    never stands for another.  So no link is wrong, and few are missed (see the README for how many).  Sets are worked out again for
    texts with a candidate alone, and texts of equal sets are one class.  Nulls, empty texts, repeated rows and null ids are
    treated as by `near_duplicates`.
    """
    names = [f"w{i}" for i in range(CHECKED)]
    keyed = columns_of(docs).select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("text_key", F.xxhash64("text"))
    schema = T.StructType([T.StructField(c, T.LongType()) for c in ("doc_id", "text_key", "set_key", *names)])

    def make():
        import xxhash

        def step(batch: pa.RecordBatch):
            sets = [shingle_hashes(t or b"", shingle) for t in utf8(batch.column(1))]
            wide = np.stack([wide_fingerprint(x) for x in sets]).view(np.int64)
            own = np.array([xxhash.xxh64_intdigest(x.tobytes()) for x in sets], np.uint64).view(np.int64)
            yield {"doc_id": batch.column(0), "text_key": batch.column(2), "set_key": pa.array(own)} | {n: pa.array(np.ascontiguousarray(wide[:, i])) for i, n in enumerate(names)}

        return step

    rows = stored(over_batches(keyed, make, schema), "similar-rows")
    classes = rows.groupBy("set_key", *names).agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", "text_key")).alias("one")).withColumn("rep", F.monotonically_increasing_id())
    classes = stored(classes, "similar-classes")
    tables = tables_for(classes.count(), similarity)
    share = differing(similarity)
    slack = lambda bits: int(bits * share + 2 * math.sqrt(bits * share * (1 - share)))
    dealt_schema = T.StructType([T.StructField("t", T.IntegerType()), T.StructField("key", T.IntegerType()), T.StructField("rep", T.LongType()), *[T.StructField(n, T.LongType()) for n in names[:WIDE]]])

    def deal():
        def step(batch: pa.RecordBatch):
            wide = np.ascontiguousarray(np.stack([batch.column(n).to_numpy() for n in names[:WIDE]], axis=1))
            bits = np.unpackbits(wide.view(np.uint8), axis=1, bitorder="little").astype(np.int32)
            for t, picked in enumerate(tables):
                key = bits[:, picked] @ (1 << np.arange(len(picked), dtype=np.int32))
                yield {"t": np.full(len(key), t, np.int32), "key": key.astype(np.int32), "rep": batch.column("rep"), **{n: batch.column(n) for n in names[:WIDE]}}

        return step

    dealt = over_batches(classes.select("rep", *names[:WIDE]), deal, dealt_schema).repartition("t", "key").sortWithinPartitions("t", "key", *names[:WIDE])

    def near(wide: np.ndarray, starts: np.ndarray, ends: np.ndarray):
        apart = lambda i, j: np.bitwise_count(wide[:, i] ^ wide[:, j]).sum(axis=0, dtype=np.int64)
        for i, j in bucket_pairs(wide[0], starts, ends, slack(64), 0, lambda i, j: apart(i, j) <= slack(64 * WIDE)):
            yield i, j, apart(i, j)

    def run(batches):
        for starts, ends, (_, _, rep, *words) in whole_groups(batches, 2):
            yield from bucket_candidates(near(np.stack(words).view(np.uint64), starts, ends), rep, words, names[:WIDE], starts, ends)

    both = stored(dealt.mapInArrow(run, found_schema(names[:WIDE])).distinct(), "similar-pairs")
    side = lambda c: classes.select(F.col("rep").alias(c), F.array(*names).alias(f"f{c}"))
    apart = F.aggregate(F.zip_with("fa", "fb", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda acc, x: acc + x)
    likely = lambda pairs: pairs.join(side("a"), "a").join(side("b"), "b").filter(apart <= slack(64 * CHECKED)).select("a", "b")
    asked = both.select(F.col("a").alias("rep")).union(both.filter("b IS NOT NULL").select("b")).distinct()
    sets = stored(shingle_sets(keyed, classes.join(asked, "rep", "left_semi").select("rep", "one"), shingle), "similar-sets")
    checked = lambda pairs: alike(stored(likely(pairs), "similar-likely"), sets, similarity)

    def group(words: list[np.ndarray]):
        every = np.stack(words).view(np.uint64)

        def likely_ones():
            for i, j, bits in near(every[:WIDE], np.array([0]), np.array([every.shape[1]])):
                close = np.bitwise_count(every[:, i] ^ every[:, j]).sum(axis=0, dtype=np.int64) <= slack(64 * CHECKED)
                yield i[close], j[close], bits[close]

        return np.arange(every.shape[1]), likely_ones()

    links = links_in_rounds(both, names[:WIDE], checked, group, classes.select(F.col("rep").alias("a"), *names[WIDE:]))
    groups = connected_components(links)
    member = stored(classes.join(groups, classes["rep"] == groups["node"], "left").withColumn("component", F.coalesce("component", "rep")).drop("node", "rep"), "similar-members")
    smallest = stored(member.groupBy("component").agg(F.min("least").alias("component_id"), F.lit(1).alias("w")), "similar-groups")
    named = stored(hot_join(member, smallest, ["component"], "w", "inner").select("set_key", *names, "component_id", "n"), "similar-names")
    return hot_join(rows, named, ["set_key", *names], "n", "inner").select("doc_id", "component_id", "text_key")


def drop_near_duplicates(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """docs with the smallest doc_id of each group of similar texts alone, all columns."""
    found = similar_documents(docs, shingle, similarity)
    return keep_documents(docs, found.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).select("doc_id", "text_key"))
