import hashlib
import random
import zlib

import numpy as np
from hypothesis import example, given, settings
from hypothesis import strategies as st

from tarnwater.llm import periodic

from .conftest import ODD


def brute(x, words=24, periods=3):
    """Every period against every place."""
    found = {}
    for p in range(1, len(x) // periods + 1):
        i = 0
        while i + p < len(x):
            j = i
            while j + p < len(x) and x[j] == x[j + p]:
                j += 1
            if j - i + p >= max(words, periods * p):
                found.setdefault((i, j + p), p)
            i = j + 1
    return sorted((s, e - s, p) for (s, e), p in found.items())


def expected(doc_id, text):
    w = (text or "").encode().split()
    n = len(w)
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = brute(w)
    gone = {i for s, m, p in runs for i in range(s + p, s + m)}
    best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=None)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    return (doc_id, len(runs), *(best or (None, None, None)), best and 1000 * best[1] // best[2], sha("".join(f"{s},{m},{p}\n" for s, m, p in runs).encode()), sha(b" ".join(x for i, x in enumerate(w) if i not in gone)))


blocks = st.lists(st.tuples(st.lists(st.integers(0, 3), min_size=1, max_size=12), st.integers(1, 14)), min_size=1, max_size=6)


@settings(max_examples=400, deadline=None)
@given(blocks)
@example([([0], 200)])
@example([([0] * 30 + [1], 5), ([0] * 30, 1)])
@example([([0, 1] * 15 + [2], 4), ([0, 1] * 15 + [2], 3)])
def test_runs_against_every_period(parts):
    x = [w for block, times in parts for w in block * times]
    assert periodic.runs_of(np.array(x)) == brute(x)


@settings(max_examples=150, deadline=None)
@given(blocks, st.integers(4, 40), st.integers(3, 5))
def test_other_lengths_and_periods(parts, words, periods):
    x = [w for block, times in parts for w in block * times]
    assert periodic.runs_of(np.array(x), words, periods) == brute(x, words, periods)


def test_long_periods_in_long_texts():
    r = random.Random(3)
    for _ in range(20):
        some = [r.randrange(50) for _ in range(r.randrange(1, 400))]
        x = [r.randrange(50) for _ in range(r.randrange(300))] + some * 4 + some[: r.randrange(len(some))] + [r.randrange(50) for _ in range(300)]
        assert periodic.runs_of(np.array(x)) == brute(x)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=60))
def test_z_function(s):
    z = periodic.z_function(np.array(s, dtype=np.int64)).tolist()
    assert z == [next((k for k in range(len(s) - i) if s[k] != s[i + k]), len(s) - i) for i in range(len(s))]


def test_a_million_words_of_one_kind_are_one_run():
    x = np.zeros(1_000_000, np.int64)
    assert periodic.runs_of(x) == [(0, 1_000_000, 1)]


def test_documents_against_every_period(spark, table):
    r = random.Random(5)
    rows = [row[:2] for row in ODD if row[0] not in (6, 7)]
    for i in range(10, 250):  # ids whose checksum 10 divides are among them
        words = [f"w{r.randrange(40)}" for _ in range(r.randrange(160))]
        at = r.randrange(len(words) + 1)
        words[at:at] = [f"w{r.randrange(40)}" for _ in range(r.randrange(1, 9))] * r.choice((1, 1, 4, 9, 30))
        rows.append((i, r.choice((" ", "\n", " \t ")).join(words)))
    assert sum(zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows if i) > 10
    got = sorted(map(tuple, periodic.periodic_runs(table(rows)).collect()), key=str)
    assert got == sorted((expected(*row) for row in rows), key=str) and any(row[1] > 1 for row in got)
    kept = periodic.periodic_runs(table([(1, "a b c " * 20 + "d")]), keep_text=True, echo=False).first()
    assert kept.collapsed == "a b c d" and [tuple(run) for run in kept.runs] == [(0, 60, 3)]


def test_long_and_missing_texts(spark, table):
    got = periodic.periodic_runs(table([row for row in ODD if row[0] in (6, 7, 1)]), echo=False)
    assert sorted((row.doc_id, row.n_runs, row.length, row.exponent_milli) for row in got.collect()) == [(1, 0, None, None), (6, 1, 60_000, 60_000_000), (7, 1, 60_000, 60_000_000)]
    assert periodic.periodic_runs(table([])).count() == 0
