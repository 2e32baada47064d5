"""Periodic runs of words: stretches that repeat themselves three times or more, found by divide and conquer on word numbers.

Words are interned: equal words get equal numbers.  A stretch is halved; the runs that cross its middle are found from four
Z-functions (how far the halves agree with themselves and with the whole stretch, forwards and backwards), for every period at
once; then both halves are searched alike.  A candidate that its neighbours still extend was found in a larger stretch, and of
equal intervals the smallest period stays.

Most texts repeat nothing, so stretches are chosen first: in a run, every group of eight words that starts after the first
period has come before, at most a period earlier.  Where such groups do not follow on each other for long enough, there can be
no run; this drops no run, since equal groups always have equal hashes.

A document is one row's work and never leaves its task; Spark deals the documents out.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import columns_of, over_batches, utf8

#: A run has at least so many words, and so many periods.
LEAST_WORDS, LEAST_PERIODS = 24, 3
#: Words of the groups by which stretches are chosen.
GROUP = 8
_FACTOR = np.uint64(0x9E3779B97F4A7C15)

Run = tuple[int, int, int]


def z_function(s: np.ndarray) -> np.ndarray:
    """For each place, how many items from there on agree with the start of s.

    Only places that hold the first item are visited; matches are extended by blocks that double.
    """
    n = len(s)
    z = np.zeros(n, np.int64)
    if not n:
        return z
    z[0] = n
    left = right = 0
    for i in np.flatnonzero(s[1:] == s[0]).tolist():
        i += 1
        k = 0
        if i < right:
            k = int(z[i - left])
            if k < right - i:
                z[i] = k
                continue
            k = right - i
        step = 8
        while i + k < n:
            a, b = s[k : k + step], s[i + k : i + k + step]
            differs = a[: len(b)] != b
            at = int(differs.argmax())
            if differs[at]:
                k += at
                break
            k += len(b)
            step *= 2
        z[i] = k
        left, right = i, i + k
    return z


def crossing(x: np.ndarray, lo: int, mid: int, hi: int, words: int, periods: int) -> list[Run]:
    """(start, end, period) of candidates that cross the middle of x[lo:hi] and have a whole period on one side of it."""
    u, v, whole = x[lo:mid], x[mid:hi], x[lo:hi]
    back, whole_back = u[::-1], whole[::-1]
    out: list[Run] = []
    end = np.full(1, -1, x.dtype)  # no word has this number

    def keep(period: np.ndarray, before: np.ndarray, after: np.ndarray, start: np.ndarray) -> None:
        length = before + after + period
        for i in np.flatnonzero(length >= np.maximum(words, periods * period)).tolist():
            out.append((int(start[i]), int(start[i] + length[i]), int(period[i])))

    # a period to the right of the middle: x[mid - 1 - j] against x[mid + p - 1 - j], and x[mid + j] against x[mid + p + j]
    p = np.arange(1, len(v) + 1)
    after = np.append(z_function(v), 0)[p]
    before = z_function(np.concatenate((back, end, whole_back)))[len(u) + 1 + len(v) - p]
    keep(p, before, after, mid - before)
    # a period to the left: x[mid - 1 - j] against x[mid - p - 1 - j], and x[mid + j] against x[mid - p + j]
    p = np.arange(1, len(u) + 1)
    before = np.append(z_function(back), 0)[p]
    after = z_function(np.concatenate((v, end, whole)))[len(v) + 1 + len(u) - p]
    keep(p, before, after, mid - p - before)
    return out


def runs_between(x: np.ndarray, lo: int, hi: int, words: int, periods: int, ago: np.ndarray | None, found: dict[tuple[int, int], int]) -> None:
    """Add the runs that lie within x[lo:hi] to found: (start, end) to smallest period.

    A stretch is left out if no group of words in it comes again soon enough, or if it lies inside a run of so small a period p
    that no other run fits: runs of periods p and q that overlap in p + q words are one, so that another has under 1.5 p words.
    """
    halves = [(lo, hi)]
    while halves:
        a, b = halves.pop()
        if b - a < words or (ago is not None and (ago[a:b].min(initial=len(x)) > (b - a) // periods)):
            continue
        mid = (a + b) // 2
        inside_left = inside_right = False
        for s, e, p in crossing(x, a, mid, b, words, periods):
            # at a stretch's end a run may go on; then a larger stretch, whose middle it crosses, has reported it
            if (s == 0 or x[s - 1] != x[s - 1 + p]) and (e == len(x) or x[e] != x[e - p]):
                found[s, e] = min(p, found.get((s, e), p))
            if 3 * p <= 2 * words and periods >= 3:
                inside_left, inside_right = inside_left or s <= a, inside_right or e >= b
        halves += [half for half, inside in (((a, mid), inside_left), ((mid, b), inside_right)) if not inside]


def stretches(x: np.ndarray, words: int = LEAST_WORDS, periods: int = LEAST_PERIODS) -> tuple[list[tuple[int, int]], np.ndarray | None]:
    """Stretches that together hold every run whole, none overlapping another; and how long ago each group of words came last (None: not known).

    After a run's first period of q words, each group of GROUP words that starts in it has come q or fewer words earlier.  There
    are at least max(words - q, (periods - 1) * q) - GROUP + 1 such starts in a row, so all starts in a row are searched for one
    scale of q after another.
    """
    n = len(x)
    if n < words:
        return [], None
    if words <= 2 * GROUP or periods < 2:
        return [(0, n)], None
    m = n - GROUP + 1
    h = x.astype(np.uint64) + np.uint64(1)
    key = h[:m].copy()
    with np.errstate(over="ignore"):
        for k in range(1, GROUP):
            key = (key ^ (key >> np.uint64(29))) * _FACTOR + h[k : k + m]
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    if not same.any():
        return [], None
    ago = np.full(m, n, np.int64)
    ago[order[1:][same]] = (order[1:] - order[:-1])[same]
    parts, most = [], 1
    while most <= n:
        # periods above most / 2 and up to most
        least = max(words - most, (periods - 1) * (most // 2 + 1)) - GROUP + 1
        edges = np.flatnonzero(np.diff(np.concatenate(([0], (ago <= most).view(np.int8), [0]))))
        starts, ends = edges[::2], edges[1::2]
        long = ends - starts >= max(least, 1)
        parts += [(max(0, s - most), min(n, e + GROUP)) for s, e in zip(starts[long].tolist(), ends[long].tolist())]
        most *= 2
    joined: list[tuple[int, int]] = []
    for s, e in sorted(parts):
        if joined and s <= joined[-1][1]:
            joined[-1] = (joined[-1][0], max(e, joined[-1][1]))
        else:
            joined.append((s, e))
    return joined, ago


def runs_of(x: np.ndarray, words: int = LEAST_WORDS, periods: int = LEAST_PERIODS) -> list[Run]:
    """(start, length, period) of all runs of x by start, then period: stretches of smallest period p, of at least `words` items
    and `periods` periods, that no neighbour extends."""
    found: dict[tuple[int, int], int] = {}
    parts, ago = stretches(x, words, periods)
    for lo, hi in parts:
        runs_between(x, lo, hi, words, periods, ago, found)
    return sorted((s, e - s, p) for (s, e), p in found.items())


def interned(words: list[bytes]) -> np.ndarray:
    """The same number for the same word, in order of first occurrence."""
    numbers: dict[bytes, int] = {}
    return np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))


def with_echo(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The words that count: where 10 divides h, the checksum of the id, those from a on are the first p of them over and over.

    h = crc32 of the decimal id, g = floor(h / 10), a = g % n, p = 1 + floor((n - a) / (3 + g % 8)).  A null id changes nothing.
    """
    if doc_id is None or not words:
        return words
    h = zlib.crc32(b"%d" % doc_id)
    if h % 10:
        return words
    n, g = len(words), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


def removed(n: int, runs: list[Run]) -> np.ndarray:
    """Which of n words some run contains after its first period."""
    change = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return np.cumsum(change[:-1]) > 0


def strongest(runs: list[Run]) -> Run | None:
    """The run of greatest length / period, compared as whole numbers; ties: smallest start, then period."""
    best = None
    for run in runs:
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


SCHEMA = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("n_runs", T.LongType())]
    + [T.StructField(c, T.LongType()) for c in ("start", "length", "period", "exponent_milli")]
    + [T.StructField("runs_sha256", T.StringType()), T.StructField("collapsed_sha256", T.StringType())]
)
RUNS = T.ArrayType(T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")]))


def periodic_runs(docs: DataFrame, keep_text: bool = False, words: int = LEAST_WORDS, periods: int = LEAST_PERIODS, echo: bool = True) -> DataFrame:
    """One row per document: doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256.

    Words are stretches without ASCII white space, of whole texts, changed as `with_echo` says if `echo`.  start to exponent_milli
    are those of the strongest run, null if there is none.  runs_sha256 digests a line `start,length,period` for each run;
    collapsed_sha256 the kept words joined by one space, without those that repeat a run's first period.  With keep_text, the
    columns runs (array of start, length, period) and collapsed (the text) follow.

    Null texts have no words; repeated rows give repeated rows; a null doc_id stays null and takes no echo; empty tables give
    no rows; columns other than doc_id and text are not read.
    """
    schema = T.StructType(SCHEMA.fields + [T.StructField("runs", RUNS), T.StructField("collapsed", T.StringType())]) if keep_text else SCHEMA

    def make() -> Callable[[pa.RecordBatch], list[dict[str, list]]]:
        def step(batch: pa.RecordBatch) -> list[dict[str, list]]:
            out: dict[str, list] = {f.name: [] for f in schema}
            for doc_id, text in zip(batch.column(0).to_pylist(), utf8(batch.column(1))):
                told = (text or b"").split()
                told = with_echo(told, doc_id) if echo else told
                runs = runs_of(interned(told), words, periods) if len(told) >= words else []
                best = strongest(runs)
                gone = removed(len(told), runs) if runs else None
                kept = b" ".join(told if gone is None else [w for w, g in zip(told, gone.tolist()) if not g])
                row = [doc_id, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None]
                row += [hashlib.sha256("".join(f"{s},{n},{p}\n" for s, n, p in runs).encode()).hexdigest(), hashlib.sha256(kept).hexdigest()]
                if keep_text:
                    row += [[{"start": s, "length": n, "period": p} for s, n, p in runs], kept.decode()]
                for f, value in zip(schema, row):
                    out[f.name].append(value)
            return [out]

        return step

    return over_batches(columns_of(docs), make, schema)
