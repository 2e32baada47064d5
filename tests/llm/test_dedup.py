"""Exact dedup, SimHash, similar documents, substring and line dedup, against brute force."""

import hashlib
import itertools
import random

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from tarnwater.llm import bitslice, candidates, common, components, edits, exact_dedup, line_dedup, simhash, substring_dedup

from .conftest import LONG, ODD

WORDS = "the of and to in that is was for it with as his on be at by had not are but from or have".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randint(0, 40)) for _ in range(n))


@pytest.mark.parametrize("key", [F.xxhash64, lambda c: F.length(c).cast("long")], ids=["hash", "collisions"])
def test_exact(table, key):
    rows = ODD + [(i, f"t{i % 7}") for i in range(10, 60)]
    got = exact_dedup.exact_dedup(table(rows), key, capacity=200).collect()
    groups = {}
    for r in rows:
        groups.setdefault(r[1] or "", []).append(r[0])
    low = lambda i: -1 if i is None else i
    want = sorted((low(r[0]), low(max(groups[r[1] or ""], key=low)), len(groups[r[1] or ""]), hashlib.sha256((r[1] or "").encode()).hexdigest()) for r in rows)
    assert sorted((low(r.doc_id), low(r.keep_id), r.group_size, r.text_sha256) for r in got) == want
    assert all(r.kept == (r.doc_id == r.keep_id) for r in got)


def test_exact_directory_splits_only_overfull_buckets(spark):
    keys = spark.createDataFrame([(i << 58, 10) for i in range(-32, 32)], "h long, bytes long")
    rows = exact_dedup.directory(keys, capacity=40, max_depth=6).collect()
    assert {r.depth for r in rows} == {4} and len({r.bucket for r in rows}) == 16
    assert exact_dedup.directory(keys, capacity=10**6, max_depth=6).agg(F.max("depth")).first()[0] == 0


def test_exact_a_bucket_lies_with_one_owner(table):
    rows, index = exact_dedup.build_index(table([(i, f"text {i % 700} " + "x" * 40) for i in range(1400)]), capacity=1000)
    files = index.select("bucket", F.input_file_name().alias("file")).groupBy("bucket").agg(F.countDistinct("file").alias("files"), F.count(F.lit(1)).alias("n")).collect()
    assert len(files) > 30 and {f.files for f in files} == {1} and sum(f.n for f in files) == 700 and max(f.n for f in files) > 5


def test_exact_directory_depth_follows_the_bytes():
    assert exact_dedup.depth_for(0, 32) == 4 and exact_dedup.depth_for(33, 32) == 5 and exact_dedup.depth_for(10**14, 32 << 20) == exact_dedup.MAX_DEPTH


def test_exact_hot_key(table, monkeypatch):
    monkeypatch.setattr("tarnwater.llm.common.HOT_ROWS", 5)
    rows = [(i, "hot") for i in range(40)] + [(100 + i, f"cold {i}") for i in range(20)]
    got = {r.doc_id: (r.keep_id, r.group_size) for r in exact_dedup.exact_dedup(table(rows)).collect()}
    assert got == {**{i: (39, 40) for i in range(40)}, **{100 + i: (100 + i, 1) for i in range(20)}}


def test_drop_copies_keeps_columns_and_one_row(table):
    docs = table(ODD)
    out = exact_dedup.drop_copies(docs)
    assert out.columns == docs.columns
    assert sorted(r.text or "" for r in out.collect()) == sorted({r[1] or "" for r in ODD})


def test_empty_tables(table):
    none = table([(1, "x")]).limit(0)
    assert exact_dedup.exact_dedup(none).count() == 0
    assert simhash.near_duplicates(none).count() == 0
    assert simhash.similar_documents(none).count() == 0
    assert substring_dedup.substring_dedup(none).count() == 0
    assert line_dedup.line_dedup(none).count() == 0


def brute_components(ids, linked):
    up = {i: i for i in range(len(ids))}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(ids)):
        for b in range(a):
            if linked(a, b):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    groups = {}
    for i in range(len(ids)):
        groups.setdefault(find(i), []).append(ids[i])
    return [min((x for x in groups[find(i)] if x is not None), default=None) for i in range(len(ids))]


def fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\n", " ").replace("\t", " ").split(" ")
    words = [w for w in words if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_against_brute_force(table):
    rng = random.Random(3)
    base = [prose(rng, 60) for _ in range(12)]
    rows = list(ODD[:6]) + [(20 + i, b) for i, b in enumerate(base)]
    for i, b in enumerate(base * 4):
        words = b.split()
        words[rng.randrange(len(words))] = "Changed"
        rows.append((100 + i, " ".join(words)))
    got = simhash.near_duplicates(table(rows)).collect()
    prints = [fingerprint(r[1]) for r in rows]
    comp = brute_components([r[0] for r in rows], lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 4)
    want = sorted((str(r[0]), f"{p:016x}", str(c)) for r, p, c in zip(rows, prints, comp, strict=True))
    assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in got) == want


@pytest.mark.parametrize("radius", [0, 1, 3, 4, 6, 17])
def test_bit_slices(radius):
    rng = np.random.default_rng(radius)
    v = rng.integers(0, 1 << 63, 700, dtype=np.uint64)
    for k in range(300, 700):
        v[k] = v[rng.integers(0, 20)] ^ np.uint64(sum(1 << int(b) for b in rng.choice(64, rng.integers(0, radius + 3), replace=False)))
    want = {(i, int(j)) for i in range(700) for j in np.flatnonzero(np.bitwise_count(v[i] ^ v[i + 1 :]) <= radius) + i + 1}
    i, j = bitslice.small_buckets(v, np.array([0, 350]), np.array([350, 700]), radius, 0)
    assert set(zip(i.tolist(), j.tolist(), strict=True)) == {p for p in want if (p[0] < 350) == (p[1] < 350)}
    i, j = bitslice.large_bucket(v, radius, 0)
    pairs = set(zip(i.tolist(), j.tolist(), strict=True))
    assert len(pairs) < 700 and all((min(p), max(p)) in want for p in pairs)
    ids = list(range(700))
    assert brute_components(ids, lambda a, b: (b, a) in pairs or (a, b) in pairs) == brute_components(ids, lambda a, b: (b, a) in want)


def test_every_block_choice_meets_every_near_pair():
    rng = random.Random(1)
    for blocks in (5, 6, 8):
        masks = bitslice.block_masks(blocks, 4)
        for _ in range(300):
            d = sum(1 << b for b in rng.sample(range(64), 4))
            assert any(d & m == 0 for m in masks)
    assert bitslice.blocks_for(10**3, 4) == 5 and bitslice.blocks_for(10**10, 4) > 6


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(1000, 1000 + i) for i in range(1, 50)] + [(2000 + i, 2001 + i) for i in range(40)] + [(7, 7)]
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    nodes = sorted({x for a, b in edges for x in (a, b) if a != b})
    place = {n: i for i, n in enumerate(nodes)}
    links = {(max(place[a], place[b]), min(place[a], place[b])) for a, b in edges if a != b}
    assert got == dict(zip(nodes, brute_components(nodes, lambda a, b: (a, b) in links), strict=True))
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_similar_documents(table):
    rng = random.Random(9)
    base = [prose(rng, 200) for _ in range(15)]
    rows = [(i, b) for i, b in enumerate(base)] + [(None, ""), (50, None), (51, "")]
    for i, b in enumerate(base):
        words = b.split()
        for at in (40, 120):
            words[at] = "edited"
        rows.append((100 + i, " ".join(words)))
    got = {r.doc_id: r.component_id for r in simhash.similar_documents(table(rows)).collect()}
    assert all(got[i] == got[100 + i] == i for i in range(15)) and got[50] == got[51] == 50
    kept = simhash.drop_near_duplicates(table(rows)).collect()
    assert sorted(str(r.doc_id) for r in kept) == sorted(map(str, [*range(15), 50]))


def edited(rng, text, edits):
    words = text.split()
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"edit{rng.randrange(10**6)}"
    return " ".join(words)


def test_similar_documents_are_those_of_the_similarity_asked_for(table):
    """Copies with one to thirty words of two hundred replaced: no link below .8, and nine in ten of those from .8 on."""
    rng = random.Random(12)
    rows = [(i, prose(rng, rng.choice([40, 200, 400]))) for i in range(30)]
    rows += [(100 * k + i, edited(rng, t, rng.randrange(1, max(2, len(t.split()) // 25)))) for k in range(1, 5) for i, t in rows[:30]]
    rows += [(1000, "a b c"), (1001, "A b  c"), (1002, "a b d"), (1003, "x")]
    shingles = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i, t in rows for w in [t.lower().split()]}
    alike = lambda a, b: len(shingles[a] & shingles[b]) >= 0.8 * len(shingles[a] | shingles[b])
    ids = sorted(shingles)
    want = dict(zip(ids, brute_components(ids, lambda a, b: alike(ids[a], ids[b])), strict=True))
    got = {r.doc_id: r.component_id for r in simhash.similar_documents(table(rows)).collect()}
    pairs = [(a, b) for k, a in enumerate(ids) for b in ids[:k]]
    assert not [p for p in pairs if got[p[0]] == got[p[1]] and want[p[0]] != want[p[1]]]
    linked = [p for p in pairs if alike(*p)]
    near = [p for p in pairs if 0.7 <= len(shingles[p[0]] & shingles[p[1]]) / len(shingles[p[0]] | shingles[p[1]]) < 0.8]
    assert len(linked) > 60 and len(near) > 10 and sum(got[a] == got[b] for a, b in linked) >= 0.9 * len(linked)
    assert got[1000] == got[1001] == 1000 and got[1002] == 1002


def brute_spans(rows, window=13):
    split = [(r[0], (r[1] or "").split()) for r in rows]
    least = {}
    low = lambda i: -1 if i is None else i
    for i, w in split:
        for k in range(len(w) - window + 1):
            t = tuple(w[k : k + window])
            least[t] = min(least.get(t, low(i)), low(i))
    out = []
    for i, w in split:
        gone = set()
        for k in range(len(w) - window + 1):
            if least[tuple(w[k : k + window])] < low(i):
                gone.update(range(k, k + window))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((str(i), len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize(("hot", "held", "most"), [(None, 400_000, 1 << 16), ({}, 20, 3)], ids=["hot windows", "buckets alone, over budget"])
def test_substring_dedup(table, monkeypatch, hot, held, most):
    monkeypatch.setattr(substring_dedup, "HELD_WINDOWS", held)
    monkeypatch.setattr(substring_dedup, "MAX_PARTS", most)
    rng = random.Random(4)
    passage, rows = prose(rng, 30), [r for r in ODD if r[0] not in (6, 7)]
    for i in range(80):
        text = prose(rng, rng.randint(1, 60))
        if i % 2:
            words = text.split()
            at = rng.randint(0, len(words))
            text = " ".join(words[:at] + [passage] + words[at:])
        rows.append((200 - i, text))
    rows += [(300, passage.replace(" ", "\t ")), (301, "a " * 40), (302, "a " * 30), (303, prose(rng, 12)), (6, LONG[:3000]), (7, LONG[:2000])]
    got = substring_dedup.substring_dedup(table(rows), bucket_bytes=4000, hot=hot).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in got) == brute_spans(rows)
    assert all(hashlib.sha256(r.kept_text.encode()).hexdigest() == r.kept_sha256 for r in got)


def test_hot_windows_are_exact(table):
    rng = random.Random(8)
    passage = prose(rng, 20)
    docs = table([(i, prose(rng, 5) + " " + passage) for i in range(500, 600)]).selectExpr("doc_id", "text", "xxhash64(text) AS text_key").repartition(2)
    found = substring_dedup.hot_windows(docs)
    assert len(found) == 8 and set(found.values()) == {500}


def test_word_hashes_do_not_depend_on_place(monkeypatch):
    line = b"aa b aa " + b"x" * 300 + b" b " + b"y" * 90 + b" aa"
    whole, starts, ends = substring_dedup.hashed(line)
    monkeypatch.setattr(substring_dedup, "SPAN", 64)
    words = [line[s:e] for s, e in zip(starts, ends, strict=True)]
    assert words == line.split()
    parts = substring_dedup.hashed(line)[0]
    short = [i for i, w in enumerate(words) if len(w) <= 64]
    assert (whole[short] == parts[short]).all() and parts[0] == parts[2] == parts[-1]


def test_line_dedup(table):
    rng = random.Random(6)
    lines = [prose(rng, 25) for _ in range(6)]
    near = lines[0].split()
    near[3] = near[3] + "x"
    near = " ".join(near)
    rows = [(1, "\n".join([lines[0], "", lines[1], lines[1].upper() + " !"])), (2, near + "\n" + lines[2] + "\n\n"), (3, lines[2] + "\n" + lines[3]), (4, None), (4, ""), (None, lines[4]), (5, lines[4] + "\n" + lines[5]), (5, lines[5])]
    got = sorted((str(r.doc_id), r.n_lines, r.n_removed, r.kept_text) for r in line_dedup.line_dedup(table(rows)).collect())
    by = {g[0]: g for g in got if g[0] != "5"}
    assert by == {"1": ("1", 4, 1, "\n".join([lines[0], "", lines[1]])), "2": ("2", 4, 1, lines[2] + "\n\n"), "3": ("3", 2, 1, lines[3]), "4": ("4", 1, 0, ""), "None": ("None", 1, 0, lines[4])}
    assert sorted(g[1] for g in got if g[0] == "5") == [1, 2] and sum(g[2] for g in got if g[0] == "5") == 2  # a copy of line 4, one of line 5


def test_line_dedup_of_odd_rows(table):
    """Nulls, blanks, ties, repeated rows and a very long line: repeated rows lose the same lines."""
    got = sorted((str(r.doc_id), r.n_lines, r.n_removed) for r in line_dedup.line_dedup(table(ODD), keep_text=False).collect())
    want = [("1", 1, 0), ("2", 1, 0), ("2", 1, 0), ("3", 2, 0), ("None", 1, 0), ("None", 1, 0), ("5", 1, 1), ("5", 1, 1), ("6", 1, 0), ("7", 1, 1), ("8", 1, 0)]
    assert got == sorted(want)


def test_numbers_tell_lines_apart(table):
    rows = [(1, "Total sum of this bill here: 5"), (2, "Total sum of this bill here: 81234567890"), (3, "Total sum of this bill here: 6")]
    assert {r.doc_id: r.n_removed for r in line_dedup.line_dedup(table(rows)).collect()} == {1: 0, 2: 0, 3: 1}


def test_line_features_in_bulk_equal_single_ones():
    rng = random.Random(2)
    norms = [line_dedup.normalised(prose(rng, n).encode()) for n in (1, 2, 3, 4, 5, 6, 7, 30, 300)] + [b"a", b"ab", b"abc", b"x x x x x x", b"x", b"a b c d e f g"]
    prints, keys, many = line_dedup.features(norms)
    at = np.cumsum(many) - many
    for k, n in enumerate(norms):
        one = line_dedup.features([n])
        assert (one[0][0] == prints[k]).all() and (one[1] == keys[at[k] : at[k] + many[k]]).all()


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[-1] + 1))
        row = new
    return row[-1]


@pytest.mark.parametrize("lanes", [0, 10**6], ids=["side by side", "one at a time"])
def test_edit_distances(monkeypatch, lanes):
    monkeypatch.setattr(edits, "LANES", lanes)
    rng = random.Random(1)
    pairs = []
    for _ in range(400):
        a = "".join(rng.choice("abcé漢") for _ in range(rng.choice([0, 1, 3, 10, 63, 64, 65, 100, 130])))
        b = list(a)
        for _ in range(rng.randint(0, max(1, len(a) // 3))):
            at = rng.randint(0, len(b))
            b[at : at + rng.randint(0, 1)] = rng.choice(["", "a", "x", "\U0001f600"])
        pairs.append((a, "".join(b)))
    limits = [int(0.2 * max(len(a), len(b))) for a, b in pairs]
    want = [levenshtein(a, b) <= k for (a, b), k in zip(pairs, limits, strict=True)]
    assert edits.within_many([a for a, _ in pairs], [b for _, b in pairs], limits).tolist() == want and 50 < sum(want) < 350
    assert [edits.within_edits(a, b, k) for (a, b), k in zip(pairs, limits, strict=True)] == want


def test_least_spanning_forest():
    rng = np.random.default_rng(1)
    for _ in range(50):
        i, j = rng.integers(0, 40, 90), rng.integers(0, 40, 90)
        i, j = i[i != j], j[i != j]
        order = rng.permutation(len(i))
        up, want = list(range(40)), np.zeros(len(i), bool)

        def root(x, up=up):
            while up[x] != x:
                x = up[x]
            return x

        for e in order.tolist():
            if root(i[e]) != root(j[e]):
                up[root(i[e])], want[e] = root(j[e]), True
        assert (bitslice.forest(i, j, order) == want).all()


def test_whole_groups_are_never_cut():
    import pyarrow as pa

    keys = np.sort(np.random.default_rng(2).integers(0, 60, 5000))
    keys[1000:3500] = keys[1000]
    batches = [pa.RecordBatch.from_arrays([pa.array(keys[a : a + 37]), pa.array(np.arange(a, min(a + 37, 5000)))], names=["k", "v"]) for a in range(0, 5000, 37)]
    groups = [(part[0, s], part[1, s], e - s) for starts, ends, part in common.whole_groups(iter(batches), 1, 100) for s, e in zip(starts, ends, strict=True)]
    cut = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    assert [(k, v, n) for k, v, n in groups] == [(keys[c], c, n) for c, n in zip(cut, np.diff(np.concatenate((cut, [5000]))), strict=True)]


def test_line_dedup_recall_against_all_pairs(table):
    """Lines of 5 to 40 words and copies with words replaced, added or dropped or letters changed, against brute-force edit similarity."""
    rng = random.Random(11)
    lines = []
    for i in range(240):
        words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9))) for _ in range((5, 8, 10, 15, 25, 40)[i % 6])]
        copy, at = list(words), rng.randrange(len(words))
        if i // 6 % 4 == 0:
            copy[at] = "other"
        elif i // 6 % 4 == 1:
            copy.insert(at, "more")
        elif i // 6 % 4 == 2:
            del copy[at]
        else:
            for k in rng.sample(range(len(words)), len(words) // 4):
                copy[k] = copy[k][:-1] + "Q"
        lines += [" ".join(words), " ".join(copy)]
    norms = [line_dedup.normalised(x.encode()).decode() for x in lines]
    close = lambda a, b: edits.within_edits(norms[a], norms[b], int(0.2 * max(len(norms[a]), len(norms[b])) + 1e-9))
    want = brute_components(list(range(len(lines))), close)
    got = {r.doc_id: r.n_removed for r in line_dedup.line_dedup(table(list(enumerate(lines)))).collect()}
    linked = [i for i in range(len(lines)) if want[i] != i]
    assert len(linked) > 200 and sum(got[i] for i in linked) >= 0.97 * len(linked)
    assert all(want[i] != i for i in got if got[i])


@pytest.mark.parametrize("few", [1, 2, 3])
@pytest.mark.parametrize("crowd", [line_dedup.CROWD, 20], ids=["buckets", "crowded buckets"])
def test_line_dedup_recall_by_words_replaced(table, few, crowd):
    """Lines of 8 to 40 words with one, two or three words replaced by letters of equal length; each begins with a common pair
    of words, so that a small limit makes its bucket a crowded one."""
    rng = random.Random(20 + few)
    word = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    rows, n = [], 0
    for _ in range(220):
        words = ["international", "organisation"] + [rng.choice(WORDS) if rng.random() < 0.4 else word(rng.randint(3, 10)) for _ in range(rng.randint(6, 38))]
        copy = list(words)
        for k in rng.sample(range(len(words)), few):
            copy[k] = word(len(copy[k]))
        if line_dedup.similar(" ".join(words), " ".join(copy)):
            rows += [(2 * n, " ".join(words)), (2 * n + 1, " ".join(copy))]
            n += 1
    got = {r.doc_id: r.n_removed for r in line_dedup.line_dedup(table(rows), crowd=crowd, judged=1).collect()}
    assert n > 150 and sum(got[2 * k + 1] for k in range(n)) >= 0.95 * n
    assert not any(got[2 * k] for k in range(n))


@pytest.mark.parametrize(("together", "dense"), [(candidates.TOGETHER, candidates.DENSE), (100, 1), (candidates.TOGETHER, 10**6)], ids=["one group", "parts", "pairs"])
def test_line_dedup_verifies_crowded_buckets(table, monkeypatch, together, dense):
    """A bucket of lines over one template, most of them unlike in edits, loses none of the close pairs among them."""
    monkeypatch.setattr(candidates, "TOGETHER", together)
    monkeypatch.setattr(candidates, "DENSE", dense)
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7))
    template, lines = [word() for _ in range(14)], []
    for _ in range(120):
        words = template + [word() for _ in range(6)]
        copy = list(words)
        copy[-1] = word()
        lines += [" ".join(words), " ".join(copy)]
    rng.shuffle(lines)
    close = lambda a, b: edits.within_edits(lines[a], lines[b], int(0.2 * max(len(lines[a]), len(lines[b])) + 1e-9))
    want = brute_components(list(range(len(lines))), close)
    assert len(set(want)) == 120
    got = {r.doc_id: r.n_removed for r in line_dedup.line_dedup(table(list(enumerate(lines)))).collect()}
    assert got == {i: int(want[i] != i) for i in range(len(lines))}


def test_line_dedup_same_fingerprint_beyond_64_lines(table):
    """Over one set of words in many orders, lines that are close to each other but unlike the first are linked."""
    rng = random.Random(13)
    words, lines = "amber basil cedar delta ember flint grove hazel".split(), []
    for _ in range(60):
        order = rng.sample(words, 8) + rng.sample(words, 8)
        lines += [" ".join(order), " ".join([*order, order[-1]])]
    norms = [x.encode() for x in lines]
    assert len(set(line_dedup.features(norms)[0][:, 0].tolist())) == 1 and len(set(norms)) > 64
    close = lambda a, b: edits.within_edits(lines[a], lines[b], int(0.2 * max(len(lines[a]), len(lines[b])) + 1e-9))
    want = brute_components(list(range(len(lines))), close)
    got = {r.doc_id: r.n_removed for r in line_dedup.line_dedup(table(list(enumerate(lines)))).collect()}
    linked = [i for i in range(len(lines)) if want[i] != i]
    assert len(linked) >= 60 and sum(got[i] for i in linked) >= 0.97 * len(linked)
    assert all(want[i] != i for i in got if got[i])


@pytest.mark.parametrize("n", [6_000, 236_000, 14_000_000], ids=str)
def test_near_pairs_meet_in_tables_of_any_corpus_size(n):
    """Pairs at Jaccard .8 or more meet in the tables that a corpus of n texts gets, and pass the slack of the comparisons."""
    rng, share = random.Random(3), simhash.differing(0.8)
    shingles = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    pairs = []
    while len(pairs) < 300:
        words = prose(rng, rng.choice([60, 120, 250, 500])).split()
        words = [w + rng.choice("abcdefgh") for w in words]
        copy = list(words)
        for _ in range(rng.randint(1, max(1, len(words) // 40))):
            copy[rng.randrange(len(copy))] = "".join(rng.choice("abcdefgh") for _ in range(7))
        a, b = shingles(words), shingles(copy)
        if 0.8 <= len(a & b) / len(a | b) < 1:
            pairs.append([simhash.wide_fingerprint(simhash.shingle_hashes(" ".join(w).encode(), 5)) for w in (words, copy)])
    apart = np.array([a ^ b for a, b in pairs])
    passed = np.ones(len(pairs), bool)
    for words, deviations in ((1, 2), (simhash.WIDE, 2), (simhash.CHECKED, 2)):
        bits = 64 * words
        passed &= np.bitwise_count(apart[:, :words]).sum(axis=1) <= bits * share + deviations * np.sqrt(bits * share * (1 - share))
    differ = np.unpackbits(np.ascontiguousarray(apart[:, : simhash.WIDE]).view(np.uint8), axis=1, bitorder="little")
    met = np.any([~differ[:, picked].any(axis=1) for picked in simhash.tables_for(n, 0.8)], axis=0)
    assert (met & passed).mean() >= 0.95


def test_line_keys_do_not_depend_on_how_many_are_crowded(spark, monkeypatch):
    """More crowded keys than a broadcast holds change the join, not which keys are paired."""
    rows = [(i, i, i, 20, [i % 3, 100 + i % 2, 1000 + i]) for i in range(120)]
    lines = spark.createDataFrame(rows, "line_id long, f0 long, f1 long, size int, keys array<long>")
    want = sorted(map(tuple, line_dedup.dealt_lines(lines, 30, 1).collect()))
    assert len({k for k, *_ in want if k >= 1000 and k < 2000}) == 120
    monkeypatch.setattr(line_dedup, "CROWDED", 1)
    assert sorted(map(tuple, line_dedup.dealt_lines(lines, 30, 1).collect())) == want


@pytest.mark.parametrize("lanes", [0, 10**6], ids=["side by side", "one at a time"])
def test_edit_distances_of_long_texts(monkeypatch, lanes):
    """Pairs about their limits, over many words of 64 rows: giving hopeless ones up changes no answer."""
    monkeypatch.setattr(edits, "LANES", lanes)
    rng, a, b, limits, want = random.Random(31), [], [], [], []
    for n, share in itertools.product((150, 330, 700, 1100), (0.1, 0.2, 0.5, 2)):
        x = "".join(rng.choice("abcdefgh é漢") for _ in range(n))
        y = list(x)
        for _ in range(int(share * n)):
            at = rng.randrange(len(y))
            y[at : at + rng.randint(0, 1)] = rng.choice(["", "a", "x", "\U0001f600"])
        y = "".join(y)
        apart = levenshtein(x, y)
        for limit in (apart - 1, apart, apart // 2, apart + 9):
            a.append(x)
            b.append(y)
            limits.append(limit)
            want.append(apart <= limit)
        assert edits.letters_apart([(x, y)])[0] <= apart
    assert edits.within_many(a, b, limits).tolist() == want and 20 < sum(want) < len(want)
    assert [edits.within_columns(*sorted((x, y), key=len), k) for x, y, k in zip(a, b, limits, strict=True)] == want


def test_hopeless_pairs_are_given_up_early(monkeypatch):
    seen, whole = [], edits.column_least
    monkeypatch.setattr(edits, "column_least", lambda *args: seen.append(args) or whole(*args))
    rng = random.Random(32)
    a, b = ("".join(rng.choice("abcdefghijklmnop") for _ in range(3000)) for _ in range(2))
    assert not edits.within_columns(a, b, 600) and len(seen) < 3000 // edits.CHECKED // 2


@pytest.mark.parametrize("part", [candidates.SETTLED, 50], ids=["one part", "parts"])
def test_pairs_of_dense_groups_never_become_rows(table, monkeypatch, part):
    """Lines over one template, most of them unlike in edits: the rows verified grow with the lines, and every link is found."""
    monkeypatch.setattr(candidates, "SETTLED", part)
    seen, whole = [], line_dedup.verified
    monkeypatch.setattr(line_dedup, "verified", lambda pairs, *args: seen.append(pairs.count()) or whole(pairs, *args))
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7))
    template, lines = [word() for _ in range(14)], []
    for _ in range(150):
        words = template + [word() for _ in range(6)]
        lines += [" ".join(words), " ".join([*words[:-1], word()])]
    rng.shuffle(lines)
    close = lambda a, b: edits.within_edits(lines[a], lines[b], int(0.2 * max(len(lines[a]), len(lines[b])) + 1e-9))
    want = brute_components(list(range(len(lines))), close)
    got = {r.doc_id: r.n_removed for r in line_dedup.line_dedup(table(list(enumerate(lines)))).collect()}
    assert got == {i: int(want[i] != i) for i in range(len(lines))}
    assert len(seen) == 2 and sum(seen) < 20 * len(lines)


@pytest.mark.parametrize("part", [candidates.SETTLED, 9], ids=["one part", "parts"])
def test_a_pair_of_two_dense_groups_is_settled_in_one(spark, monkeypatch, part):
    """Members of several groups and parts: each pair that shares a group is settled by exactly one task."""
    monkeypatch.setattr(candidates, "SETTLED", part)
    sets = {7: range(30), -3: range(10, 50), 12: range(25, 60)}
    rows = [(g, a, len(m)) for g, m in sets.items() for a in m]
    dealt = candidates.in_parts(spark.createDataFrame(rows, "g long, a long, n long")).toArrow()
    tasks = {}
    for row in dealt.to_pylist():
        tasks.setdefault((row["g"], row["p"], row["q"]), []).append(row)
    met = []
    for held in tasks.values():
        group = pa.Table.from_pylist(held, schema=dealt.schema)
        i, j = np.triu_indices(len(held), 1)
        here = candidates.settled_here(group, np.arange(len(held)))(i, j)
        ids = group["a"].to_numpy()
        met += [tuple(sorted((int(ids[x]), int(ids[y])))) for x, y in zip(i[here], j[here], strict=True)]
    assert sorted(met) == sorted({(x, y) for m in sets.values() for x in m for y in m if x < y})


def test_line_keys_reach_their_buckets_packed(spark):
    """Keys cross the shuffle as arrays of a bucket's lines, none lost, and Spark's hash names the pairings."""
    rows = [(i, i, -i, 20, [i % 3, 100 + i % 2, 1000 + i, -2000 - i, i << 40]) for i in range(4000)]
    lines = spark.createDataFrame(rows, "line_id long, f0 long, f1 long, size int, keys array<long>").coalesce(2)
    packed = line_dedup.packed_lines(lines, 10**6, 1).toArrow()
    assert packed.num_rows <= 2 * max(1, 5 * 4000 // line_dedup.BUCKET)
    got = [x for r in packed.to_pylist() for x in zip(r["key"], r["size"], r["line_id"], r["f0"], r["f1"], strict=True)]
    assert sorted(got) == sorted((k, size, i, f0, f1) for i, f0, f1, size, keys in rows for k in keys)
    x, y = np.array([5, -7, 1 << 62, 3]), np.array([-9, 12, -(1 << 62), 3])
    pairs = spark.createDataFrame([(int(min(p)), int(max(p))) for p in zip(x, y, strict=True)], "a long, b long")
    assert line_dedup.pair_hash(x, y).tolist() == [r[0] for r in pairs.selectExpr("xxhash64(a, b)").collect()]


def test_crowded_keys_do_not_depend_on_line_ids(spark):
    """Which lines judge a bucket follows from the lines, not from the numbers that a run gives them."""
    schema = "line_id long, f0 long, f1 long, size int, keys array<long>"
    found = []
    for shift in (0, 7_000, 1 << 33):
        rows = [(shift + i, i * 77, i, 20, [i % 40, 1000 + i]) for i in range(4000)]
        found.append(sorted(map(tuple, line_dedup.crowded_keys(spark.createDataFrame(rows, schema), 100, 8).collect())))
    assert found[0] == found[1] == found[2] and 0 < len(found[0]) < 40


def test_pairs_of_small_dense_groups_are_checked_together():
    """A task's small groups share one check, whole groups are never cut, and what the check refuses stays apart."""
    keys = np.repeat(np.arange(50), 6)
    rows = pa.table({"g": keys, "p": np.zeros(300, np.int64), "q": np.zeros(300, np.int64), "a": np.arange(300)})
    (tables,) = candidates.gathered(iter(rows.to_batches(max_chunksize=7)), ["g", "p", "q"])
    assert [t["a"].to_pylist() for t in tables] == [list(range(6 * k, 6 * k + 6)) for k in range(50)]
    i, j = np.triu_indices(6, 1)
    parts = [(6 * k, iter([(i, j, np.zeros(15))]), lambda x, y: np.ones(len(x), bool)) for k in range(50)]
    calls, own = [], np.arange(300)

    def check(x, y):
        calls.append(len(x))
        return (x // 3) == (y // 3)

    links = [pair for x, y in candidates.settled(parts, own, check) for pair in zip(x.tolist(), y.tolist(), strict=True)]
    assert calls == [50 * 15] and len(links) == 2 * 100
    assert (own == np.repeat(np.arange(100) * 3, 3)).all()


def test_repeated_lines_are_combined_where_they_are_read(spark):
    """Of the lines that repeat in a chunk the first one carries their number and their features, the others none."""
    docs = [(i, "the same line in every text\nline of its own %s" % ("x" * (i + 1)), i) for i in range(30)]
    rows = line_dedup.line_keys(spark.createDataFrame(docs, "id long, text string, row_key long").coalesce(1)).collect()
    assert len(rows) == 60 and sorted(r.n for r in rows) == [0] * 29 + [1] * 30 + [30]
    hot = next(r for r in rows if r.n == 30)
    assert (hot.id, hot.line, len(hot.keys), hot.size) == (0, 0, line_dedup.SAMPLED, 27)
    assert all(r.keys == [] and r.f0 is None and r.key == hot.key for r in rows if not r.n)


@pytest.mark.parametrize("crowd", [line_dedup.CROWD, 40], ids=["one part", "parts"])
def test_lines_that_share_one_common_key_alone_are_compared(spark, crowd):
    """However many lines share a key, all their pairs within radius and of fitting lengths are candidates, once."""
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 62, (30, 2))
    rows, prints = [], []
    for i in range(900):
        f = base[i % 30] ^ (np.int64(1) << rng.integers(0, 62, 2))
        prints.append(f)
        rows.append((i, int(f[0]), int(f[1]), int(rng.integers(40, 90)), [7, 10_000 + i]))
    lines = spark.createDataFrame(rows, "line_id long, f0 long, f1 long, size int, keys array<long>")
    want = set()
    for i, j in itertools.combinations(range(900), 2):
        (x, _, _, s, _), (y, _, _, t, _) = sorted((rows[i], rows[j]), key=lambda r: r[3])
        apart = sum((int(prints[x][k]) ^ int(prints[y][k])).bit_count() for k in (0, 1))
        if apart <= line_dedup.RADIUS + line_dedup.MORE_BITS * (s < line_dedup.BRIEF) and t - s <= int(0.2 * t + 1e-9):
            want.add((i, j))
    assert 2000 < len(want) < 20_000
    dealt = line_dedup.dealt_lines(lines, crowd, 1).collect()
    assert len(dealt) == 900 + 900 * -(-900 // crowd)
    met, groups = [], {}
    for r in line_dedup.candidates(lines, crowd=crowd, judged=1).collect():
        met += [(r.a, r.b)] * (r.g is None)
        if r.g is not None:
            groups.setdefault(r.g, []).append(r.a)
    within = {p for m in groups.values() for p in itertools.combinations(sorted(m), 2)}
    assert set(met) <= want <= set(met) | within and len(met) == len(set(met))


def test_tiles_and_single_pairs_find_the_same(monkeypatch):
    rng = np.random.default_rng(6)
    size = np.sort(rng.integers(30, 70, 700))
    prints = rng.integers(0, 1 << 63, (2, 5), dtype=np.uint64)[:, rng.integers(0, 5, 700)] ^ np.uint64(1) << rng.integers(0, 64, (2, 700)).astype(np.uint64)
    starts, ends = np.array([0, 300, 310]), np.array([300, 310, 700])
    for at in range(3):
        size[starts[at] : ends[at]] = np.sort(size[starts[at] : ends[at]])
    found = []
    for tiled in (0, 20, 10**6):
        monkeypatch.setattr(line_dedup, "TILED", tiled)
        got = list(line_dedup.near_pairs(prints, size, starts, ends, 40, 0.8))
        found.append(sorted(zip(*(np.concatenate(x).tolist() for x in zip(*got, strict=True)), strict=True)))
    assert found[0] == found[1] == found[2] and len(found[0]) > 1000
