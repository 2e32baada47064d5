import re
import zlib
from collections import Counter, defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st

from tarnwater.llm import spelling

from .conftest import LONG, ODD


def expected(rows, shortest=7, fewest=2, share=10):
    """All words against all words that they become by one edit, in plain Python."""
    n = Counter()
    for doc_id, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate({c: c + 32 for c in range(65, 91)})
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            n[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run] += 1
    n = {w: c for w, c in n.items() if len(w) >= shortest and c >= fewest}
    cuts = defaultdict(set)
    for w in n:
        for i in range(len(w)):
            cuts[w[:i] + w[i + 1 :], i].add(w)
    near = defaultdict(set)
    for (rest, _), some in cuts.items():
        some = some if len(some) > 1 else set()
        for w in some:
            near[w] |= some - {w}
    for (rest, _), some in cuts.items():
        if rest in n:
            near[rest] |= some
            for w in some:
                near[w].add(rest)
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= share * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), None if form[w] is None else n[form[w]]))
    return sorted(out, key=str)


def found(df):
    return sorted(map(tuple, df.collect()), key=str)


WORDS = ["counting", "countin", "countingg", "countinq", "counning", "aaaaaaaaa", "aaaaaaaaaa", "aaaaaaa", "aaaaaaab", "straße", "straßenbahn", "strassenbahn", "straszenbahn", "élévation", "elévation", "élevation", "elevation", "abababab", "babababa", "ababababa", "ÉLÉVATION", "Counting", "short", "w" * 4000, "w" * 3999, "w" * 3999 + "x"]


def crowd(seed: int, docs: int = 60):
    import random

    r = random.Random(seed)
    weights = [200 if i % 5 == 0 else 12 if i % 3 == 0 else 1 for i in range(len(WORDS))]
    return [(i, " ".join(r.choices(WORDS[:-3], weights[:-3], k=120)) + " " + WORDS[-1 - i % 3]) for i in range(docs)]


def test_spelling_variants_against_all_words(spark, table):
    rows = crowd(1) + ODD
    got = found(spelling.spelling_variants(table(rows)))
    assert got == expected(rows) and any(r[1] for r in got) and any(r[4] > 3 for r in got)


def test_chains_of_forms_end_in_one_root(spark, table):
    rows = [(i, " ".join(["abcdefgh"] * 40 + ["abcdefgx"] * (i < 30) * 4 + ["abcdefxx"] * (i < 10)) + (" abcdexxx" if i < 2 else "")) for i in range(100)]
    got = {r[0]: r for r in found(spelling.spelling_variants(table(rows), loss=10**9))}
    assert {w: got[w][2] for w in ("abcdefgx", "abcdefxx", "abcdefgh")} == dict.fromkeys(("abcdefgx", "abcdefxx", "abcdefgh"), "abcdefgh")
    assert got["abcdefxx"][1] == "abcdefgx" and got["abcdexxx"][1] is None


def test_crowded_shards_are_cut_into_slices(spark, table):
    import itertools

    some = ["zqx" + "".join(p) for p in itertools.product("abc", repeat=5)]
    rows = [(i, " ".join(some * 2) + " zqxabcabb zqxaaaaab") for i in range(3)]
    whole = found(spelling.spelling_variants(table(rows)))
    assert whole == expected(rows)
    assert found(spelling.spelling_variants(table(rows), limit=7)) == whole


def test_words_are_the_observed_ones(spark, table):
    rows = [(i, "Umbrellas and umbrellas") for i in range(200)]
    got = found(spelling.spelling_variants(table(rows)))
    assert got == expected(rows) and {len(r[0]) for r in got} == {8, 9}


def test_no_words(spark, table):
    assert found(spelling.spelling_variants(table([]))) == []
    assert found(spelling.spelling_variants(table([(1, None), (2, ""), (3, "a few tiny words"), (4, "漢字漢字漢字漢字 123456789")]))) == []


def test_very_long_text_and_repeated_rows(spark, table):
    rows = [(1, LONG + " elephants" * 20 + " elephant"), (2, "elephant elephant"), (2, "elephant elephant")]
    assert found(spelling.spelling_variants(table(rows))) == expected(rows)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.integers(0, 12), min_size=1, unique=True).map(sorted), max_size=6), st.integers(1, 6))
def test_heap_merge_counts_exactly(lists, bound):
    n = Counter(x for p in lists for x in p)
    assert spelling.heap_merge(lists, bound) == sorted(x for x, c in n.items() if c >= bound)


@settings(max_examples=400, deadline=None)
@given(st.text("ab", min_size=6, max_size=9), st.data())
def test_one_edit_keeps_the_overlap_bound(word, data):
    i = data.draw(st.integers(0, len(word)))
    other = word[:i] + data.draw(st.sampled_from(["a", "b", "c"])) + word[i:] if data.draw(st.booleans()) or i == len(word) else word[:i] + "c" + word[i + 1 :]
    a, b = sorted((word, other), key=len)
    index = spelling.PositionalIndex()
    index.add(a, 1)
    assert [w for w, _ in index.near(b)] == [a] and spelling.first_shared(a, b) is not None and spelling.one_edit(a, b) and not spelling.one_edit(a, a)
