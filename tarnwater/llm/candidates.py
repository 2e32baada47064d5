"""Candidate pairs that are verified in rounds, so that no refused pair stands for another.

A bucket gives a least spanning forest of its candidate pairs, and apart from it the other pairs or, where these are many,
the members.  The forests of all buckets are verified first.  Then only pairs that the verified links have not put
together yet are verified, all of them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bitslice import forest
from .common import stored
from .components import connected_components

EDGES = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])
#: Candidates a member above which a bucket passes on its members instead of its pairs, and members of a group of those.
DENSE, TOGETHER = 8, 8192
#: Members of a dense group, or of a part of one, that one task holds against each other where it settles their pairs; pairs
#: settled at once; groups of a member that are looked through for one that settles a pair before.
SETTLED, STEP, SEEN = 1024, 4096, 16
#: Members of dense groups that a task gathers before it settles their pairs together.
GATHERED = 8192
#: Pairs held before all but the forest and the pairs of sparse buckets go.
HELD = 1 << 20

Pairs = Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]


def found_schema(columns: list[str]) -> T.StructType:
    """A pair (a, b), of the forest of its bucket or not, or the member a, with its own columns, of the dense group g."""
    fields = [("a", T.LongType()), ("b", T.LongType()), ("tree", T.BooleanType()), ("g", T.LongType()), *[(c, T.LongType()) for c in columns]]
    return T.StructType([T.StructField(*f) for f in fields])


def dense_groups(ids: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """(name, places) of the groups that the members of a dense bucket make, named by their members.

    More than TOGETHER members make a group of each two of their parts, so that any two meet in one.
    """
    order = np.argsort(ids)
    parts = np.array_split(order, -(-2 * len(ids) // TOGETHER)) if len(ids) > TOGETHER else [order]
    sets = [np.concatenate(x) for x in combinations(parts, 2)] if len(parts) > 1 else parts
    return [(int.from_bytes(hashlib.md5(ids[x].tobytes(), usedforsecurity=False).digest()[:8], "little", signed=True), x) for x in sets]


def bucket_candidates(pairs: Pairs, ids: np.ndarray, columns: list[np.ndarray], names: list[str], starts: np.ndarray, ends: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The rows of found_schema for some whole buckets [start, end), from their candidate pairs (i, j, distance).

    Memory grows with the members, not with their pairs.
    """
    size = ends - starts
    bucket = np.repeat(np.arange(len(starts)), size)
    found, paired = np.zeros(len(starts), np.int64), np.zeros(len(ids), bool)
    i = j = apart = tree = np.empty(0, np.int64)

    def pruned():
        # Forests are ordered by distance, then by ids, in every bucket alike, so that buckets choose the same links.
        low, high = np.minimum(ids[i], ids[j]), np.maximum(ids[i], ids[j])
        tree = forest(i, j, np.lexsort((high, low, apart)))
        kept = tree | (found[bucket[i]] <= DENSE * size[bucket[i]])
        return i[kept], j[kept], apart[kept], tree[kept]

    for more in pairs:
        differ = ids[more[0]] != ids[more[1]]
        more = tuple(x[differ] for x in more)
        found += np.bincount(bucket[more[0]], minlength=len(starts))
        paired[more[0]] = paired[more[1]] = True
        i, j, apart = (np.concatenate(x) for x in zip((i, j, apart), more, strict=True))
        if len(i) > HELD:
            i, j, apart, tree = pruned()
    if not len(i):
        return
    i, j, apart, tree = pruned()
    schema = ["a", "b", "tree", "g", *names]
    none = pa.nulls(len(i), pa.int64())
    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(ids[i], ids[j])), pa.array(np.maximum(ids[i], ids[j])), pa.array(tree), none, *[none] * len(names)], names=schema)
    for at in np.flatnonzero(found > DENSE * size).tolist():
        members = np.arange(starts[at], ends[at])[paired[starts[at] : ends[at]]]
        members = members[np.unique(ids[members], return_index=True)[1]]
        for name, places in dense_groups(ids[members]):
            own = members[places]
            yield pa.RecordBatch.from_arrays([pa.array(ids[own]), pa.nulls(len(own), pa.int64()), pa.nulls(len(own), pa.bool_()), pa.array(np.full(len(own), name)), *[pa.array(c[own].astype(np.int64, copy=False)) for c in columns]], names=schema)


def links_in_rounds(
    both: DataFrame,
    names: list[str],
    verified: Callable[[DataFrame], DataFrame],
    pairs: Callable[[list[np.ndarray]], tuple[np.ndarray, Pairs]],
    more: DataFrame | None = None,
    settle: Callable[[list[np.ndarray]], Callable[[np.ndarray, np.ndarray], np.ndarray]] | None = None,
) -> DataFrame:
    """Links (a, b) that span the connected groups of all candidates (both: found_schema) that `verified` accepts.

    pairs gets the columns of a dense group and returns an order of its members and the candidate pairs in that order.  more: further
    columns of the members (by a), with which it can tell more pairs apart before they become rows.  With settle, pairs of dense
    groups never become rows: it gets the columns in order and returns the check of pairs (i, j) that `verified` makes, and only
    links that put members together go on.
    """
    trees = stored(both.filter("tree").select("a", "b").distinct(), "link-trees")
    groups = stored(connected_components(stored(verified(trees), "links-1")), "link-groups")

    def label(df: DataFrame, c: str, name: str) -> DataFrame:
        return df.join(groups.select(F.col("node").alias(c), F.col("component").alias(name)), c, "left").withColumn(name, F.coalesce(name, c))

    def run(table: pa.Table) -> pa.Table:
        ids, own = table["a"].to_numpy(), table["component"].to_numpy()
        order, found = pairs([table[c].to_numpy() for c in held])
        ids, own, out = ids[order], own[order], [np.empty((2, 0), np.int64)]
        for i, j, *_ in found:
            i, j = i[own[i] != own[j]], j[own[i] != own[j]]
            out.append(np.stack([np.minimum(ids[i], ids[j]), np.maximum(ids[i], ids[j])]))
        every = np.concatenate(out, axis=1)
        return pa.table({"a": every[0], "b": every[1]})

    def run_together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tables in gathered(batches, ["g", "p", "q"]):
            ids, own, columns, parts, at = [], [], [], [], 0
            for table in tables:
                mine = [table[c].to_numpy() for c in held]
                order, found = pairs(mine)
                columns.append([c[order] for c in mine])
                ids.append(table["a"].to_numpy()[order])
                own.append(table["component"].to_numpy()[order])
                parts.append((at, found, settled_here(table, order)))
                at += len(order)
            ids, own = np.concatenate(ids), np.concatenate(own)
            check = settle([np.concatenate(c) for c in zip(*columns, strict=True)])
            for i, j in settled(parts, own, check):
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(ids[i], ids[j])), pa.array(np.maximum(ids[i], ids[j]))], names=["a", "b"])

    members = label(both.filter("g IS NOT NULL"), "a", "component")
    mixed = members.groupBy("g").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count(F.lit(1)).alias("n")).filter("lo <> hi").select("g", "n")
    dense = members.join(mixed, "g").select("g", "a", *names, "component", "n")
    held, key, extra = list(names), ["g"], []
    if settle is not None:
        dense, key, extra = in_parts(dense), ["g", "p", "q"], ["p", "q", "part", "before"]
    if more is not None:
        dense, held = dense.join(more, "a"), [*names, *[c for c in more.columns if c != "a"]]
    dense = dense.select("g", "a", *held, "component", *extra)
    dense = dense.groupBy(*key).applyInArrow(run, EDGES) if settle is None else dense.repartition(*key).sortWithinPartitions(*key).mapInArrow(run_together, EDGES)
    rest = label(label(both.filter("NOT tree").select("a", "b").distinct(), "a", "ca"), "b", "cb").filter("ca <> cb").select("a", "b")
    left = (rest if settle is not None else rest.union(dense).distinct()).join(trees, ["a", "b"], "left_anti")
    second = stored(verified(left).union(dense) if settle is not None else verified(left), "links-2")
    return groups.select(F.col("node").alias("a"), F.col("component").alias("b")).filter("a <> b").union(label(label(second, "a", "ca"), "b", "cb").select("ca", "cb"))


def in_parts(dense: DataFrame) -> DataFrame:
    """Members of dense groups (g, a, n: members of g), once for each pair of parts p <= q of their group with theirs, `part`, in it, and
    `before`: those of their groups with a smaller name, the smallest first, SEEN at most."""
    named = dense.groupBy("a").agg(F.slice(F.array_sort(F.collect_set("g")), 1, SEEN).alias("before"))
    parts = F.ceil(F.col("n") / SETTLED)
    dealt = dense.join(named, "a").withColumn("before", F.filter("before", lambda g: g < F.col("g"))).withColumn("part", F.pmod(F.xxhash64("a"), parts))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)))
    return dealt.withColumn("p", F.least("part", "other")).withColumn("q", F.greatest("part", "other")).drop("n", "other")


def settled_here(table: pa.Table, order: np.ndarray) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """Whether a dense group's task settles the pairs (i, j): those between its two parts, or within its one, that no group before it has."""
    part = table["part"].to_numpy()[order]
    one = table["p"][0] == table["q"][0]
    lists = [table["before"][int(k)].as_py() for k in order]
    before = np.full((max(map(len, lists), default=0), len(lists)), np.iinfo(np.int64).max)
    for k, own in enumerate(lists):
        before[: len(own), k] = own

    def here(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        met = np.zeros(len(i), bool)
        for x in before:
            for y in before:
                met |= (x[i] == y[j]) & (x[i] != np.iinfo(np.int64).max)
        return ~met if one else ~met & (part[i] != part[j])

    return here


def gathered(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[list[pa.Table]]:
    """Whole groups, from batches sorted by their keys, about GATHERED rows at a time."""
    now, held, tables, rows = None, [], [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        marks = np.stack([batch.column(batch.schema.get_field_index(k)).to_numpy() for k in keys])
        cuts = np.flatnonzero(np.concatenate(([True], (marks[:, 1:] != marks[:, :-1]).any(axis=0)))).tolist()
        for start, end in zip(cuts, [*cuts[1:], batch.num_rows], strict=True):
            mark = tuple(marks[:, start].tolist())
            if mark != now and held:
                tables.append(pa.Table.from_batches(held))
                rows, held = rows + tables[-1].num_rows, []
                if rows >= GATHERED:
                    yield tables
                    tables, rows = [], 0
            now = mark
            held.append(batch.slice(start, end - start))
    if held:
        tables.append(pa.Table.from_batches(held))
    if tables:
        yield tables


def settled(parts: list[tuple[int, Pairs, Callable]], own: np.ndarray, check: Callable) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Those pairs (i, j) that the check accepts and that put members together whose labels, own, differ till then; own is changed.

    parts: the first member of each dense group, its pairs by their places in it and which of them it settles.  The pairs of all groups are
    checked together, about STEP at once.
    """
    held: list[np.ndarray] = []
    total = 0

    def linked():
        x, y = np.concatenate(held, axis=1)
        apart = own[x] != own[y]
        x, y = x[apart], y[apart]
        ok, links = check(x, y), []
        for a, b in zip(x[ok].tolist(), y[ok].tolist(), strict=True):
            if own[a] != own[b]:
                own[own == own[b]] = own[a]
                links.append((a, b))
        return tuple(np.array(links, np.int64).reshape(-1, 2).T)

    for first, found, here in parts:
        for i, j, *_ in found:
            for at in range(0, len(i), STEP):
                x, y = i[at : at + STEP], j[at : at + STEP]
                apart = own[first + x] != own[first + y]
                x, y = x[apart], y[apart]
                mine = here(x, y)
                held.append(np.stack([x[mine], y[mine]]) + first)
                total += held[-1].shape[1]
                if total >= STEP:
                    yield linked()
                    held, total = [], 0
    if total:
        yield linked()
