"""PII, WARC, decontamination, language, licenses, mixing, and the registered queries."""

import hashlib
import random
import re
import string

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tarnwater.llm import decontam, lang_id, licenses, mixing, pii, warc

from .conftest import LONG, ODD

BASE = {"email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), "card": re.compile(r"[0-9]([\x20-]?[0-9])+"), "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")}


def luhn(s):
    d = [int(c) for c in s if c in string.digits][::-1]
    return sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(d)) % 10 == 0


def brute_pii(text):
    n = lambda s: sum(c in string.digits for c in s)
    ok = {"email": lambda s: True, "ip": lambda s: all(int(x) <= 255 for x in s.split(".")), "card": lambda s: 14 <= n(s) <= 19 and luhn(s), "phone": lambda s: 10 <= n(s) <= 15}
    kinds = list(BASE)
    return sorted([(m.start(), m.end(), k) for k in kinds for m in BASE[k].finditer(text) if ok[k](m.group())], key=lambda x: (x[0], kinds.index(x[2])))


@settings(max_examples=400, deadline=None)
@given(st.text("ab1.2@3-+ ()9_%0é4", max_size=80))
def test_pii_base_is_the_patterns(text):
    assert pii.find(text) == brute_pii(text)


@pytest.mark.parametrize(
    ("text", "found"),
    [
        ("write jo.doe [at] exam-ple [dot] com now", ["jo.doe [at] exam-ple [dot] com"]),
        ("jane at mail dot example dot com ok", ["jane at mail dot example dot com"]),
        ("call +four four two zero seven nine four six zero nine five eight", ["+four four two zero seven nine four six zero nine five eight"]),
        ("раypal@exаmple.com x", ["раypal@exаmple.com"]),
        ("ｊｏ＠example．com", ["ｊｏ＠example．com"]),
        ("x john(at)site.org y", ["john(at)site.org"]),
        ("we met at noon, dot by dot; at last", []),
        ("one two, buckle my shoe", []),
        ("", []),
    ],
)
def test_pii_disguises_map_back(text, found):
    base, every = pii.spans(text)
    assert [text[s:e] for s, e, _ in every] == found and set(base) <= set(every)


def test_pii_a_disguise_that_widens_a_base_span_is_added():
    base, every = pii.spans("ｊoe@example.com!")
    assert base == [(1, 15, "email")] and every == [(0, 15, "email"), (1, 15, "email")]
    assert pii.masked("ｊoe@example.com!") == "<EMAIL>!" and pii.masked("joe@example.com") == "<EMAIL>"


def test_pii_a_megabyte_of_digits_takes_no_second():
    import time

    for text in ("7" * 1_000_000, "1.2.3" + "7" * 1_000_000, "1.2.3.4." * 100_000):
        start = time.time()
        found = pii.ips(text)
        assert time.time() - start < 1 and len(found) == (100_000 if len(text) == 800_000 else 0)


def test_pii_table(table):
    got = pii.find_pii(table(ODD + [(9, "a@b.co 1.2.3.4 +1 (212) 555-0100"), (10, "9" * 100_000 + "@"), (11, "a" * 100_000)])).collect()
    assert len(got) == len(ODD) + 3
    r = next(x for x in got if x.doc_id == 9)
    assert (r.n_email, r.n_ip, r.n_card, r.n_phone, r.spans) == (1, 1, 0, 1, "email:0:6,ip:7:14,phone:15:32")
    assert r.base_sha256 == hashlib.sha256(r.spans.encode()).hexdigest()
    assert pii.masked("x a@b.co y") == "x <EMAIL> y"


PAGES = [(1, "http://a/", "same"), (3, None, "same"), (2, "http://b/\r\nX: y%", "same"), (4, "u", None), (5, "u", ""), (6, "ü", "é\r\n\r\nWARC/1.1\r\n"), (None, "n", "alone"), (7, "l", LONG), (8, "l", LONG + "!"), (9, "t", "tie"), (9, "t2", "tie")]


def test_warc_round_trip(spark):
    pages = spark.createDataFrame([(*p, "x", 1) for p in PAGES], "page_id long, url string, html string, archive string, offset long").repartition(3)
    folder, index = warc.archive_pages(spark, pages)
    back = warc.read_records(index, folder).collect()
    assert len(back) == len(PAGES)
    best = {}
    for i, _, h in PAGES:
        best[h or ""] = max(best.get(h or "", -1), -1 if i is None else i)
    want = []
    for i, u, h in PAGES:
        kind = "response" if (-1 if i is None else i) == best[h or ""] else "revisit"
        want.append((str(i), str(u), len((h or "").encode()), warc.sha1_base32((h or "").encode()), kind, best[h or ""] if kind == "revisit" else None))
    assert sorted((str(r.page_id), str(r.url), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in back) == sorted(want, key=str)
    html = {i: (h or "").encode() for i, _, h in PAGES}
    assert all(bytes(r.payload) == html[r.page_id] for r in back if r.record_type == "response" and r.page_id != 9)
    some = index.filter("page_id IN (1, 7)")
    assert warc.read_records(some, folder).count() == 2
    assert warc.warc_round_trip(pages.limit(0)).count() == 0


def test_warc_small_payloads_are_all_responses(spark):
    pages = spark.createDataFrame([(i, "u", "tiny") for i in range(5)], "page_id long, url string, html string")
    assert {r.record_type for r in warc.warc_round_trip(pages, min_bytes=100).collect()} == {"response"}


def test_warc_reads_are_coalesced():
    rows = [("a", 0, 10), ("a", 10, 10), ("a", 100_000, 10), ("b", 0, 5)]
    assert [(a, s, e, len(g)) for a, s, e, g in warc.coalesced(rows, gap=100)] == [("a", 0, 20, 2), ("a", 100_000, 100_010, 1), ("b", 0, 5, 1)]


@pytest.mark.parametrize("limit", [1 << 20, 200], ids=["one automaton", "several"])
def test_decontamination(spark, table, limit):
    rng = random.Random(7)
    word = lambda: rng.choice(["alpha", "beta", "Gamma", "delta", "é", "x1"])
    items = [(i, " ".join(word() for _ in range(rng.randint(1, 25)))) for i in range(8)] + [(90, None), (91, "?!"), (None, "only here once"), (0, "alpha")]
    rows = list(ODD[:6])
    for i in range(60):
        text = " ".join(word() for _ in range(rng.randint(0, 30)))
        rows.append((100 + i, text + (", " + items[i % 8][1].upper().replace(" ", " -- ") if i % 3 == 0 else "")))
    bench = spark.createDataFrame([(*x, "c") for x in items], "item_id long, text string, doc_id string")
    got = decontam.decontaminate(table(rows), bench, limit=limit).collect()
    named = [("" if i is None else str(i), t) for i, t in items]
    want = []
    for r in rows:
        n, hit, found = decontam.brute_force(r[1], named)
        want.append((str(r[0]), n, hit, len(found), decontam.digest(found), hit > 0))
    assert sorted((str(r.doc_id), r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got) == sorted(want)
    kept = decontam.drop_contaminated(table(rows), bench, limit=limit)
    assert kept.count() == sum(not w[5] for w in want) and kept.columns == table(rows).columns
    assert decontam.decontaminate(table(rows), bench.limit(0)).filter("contaminated").count() == 0


def test_decontamination_offsets():
    text = "Say: ÉTÉ the-cat sat on the mat, by the old door at noon!"
    machine = decontam.automaton([("1", b"the cat sat on the mat by the old door")])
    _, ranges, items = decontam.scan(text.encode(), machine)
    assert [text[s:e] for s, e in decontam.source_spans(text, ranges)] == ["the-cat sat on the mat, by the old door"] and items == {"1"}


def slow_bits(texts, text, size=3):
    """PPM code length by its definition, one byte at a time."""
    from collections import Counter, defaultdict
    from math import log2

    counts = defaultdict(Counter)
    for t in texts:
        padded = [None] * size + list(t)
        for i in range(size, len(padded)):
            for k in range(size + 1):
                counts[tuple(padded[i - k : i])][padded[i]] += 1
    total = 0.0
    padded = [None] * size + list(text)
    for i in range(size, len(padded)):
        p = 1 / 256
        for k in range(size + 1):
            c = counts.get(tuple(padded[i - k : i]))
            if c and (k < 2 or sum(c.values()) >= 2):
                n, kinds = sum(c.values()), len(c)
                p = (c[padded[i]] + kinds * p) / (n + kinds)
        total -= log2(p)
    return total


def test_ppm_tables_equal_the_definition():
    texts = {"aa": [b"abracadabra abracadabra", b"alakazam"]}
    model = lang_id.fit(texts)
    for probe in (b"abracadabra", b"kazam ab", b"a"):
        assert abs(model.lengths(probe)[0] - slow_bits(texts["aa"], probe)) < 1e-3


def test_language(table):
    rng = random.Random(1)
    say = {"en": "the and that with thing house water", "fr": "le la les être maison été garçon", "de": "der die und über straße haus wasser"}
    rows = [(i, " ".join(rng.choice(say[k].split()) for _ in range(40)), k) for i, k in enumerate(["en", "fr", "de"] * 60)]
    rows = [(*r, "s") for r in rows]
    odd = [(1000, None, "en", "s"), (1001, "", "fr", "s"), (1002, "12 34 !", None, None), (None, "der die und", "de", "s"), (1003, LONG, None, "s")]
    got = lang_id.identify(table(rows + odd)).collect()
    assert len(got) == 185 and all(0 <= r.score <= 1 for r in got)
    by = {r.doc_id: r for r in got}
    assert all(by[r[0]].lang_pred == r[2] for r in rows)
    assert {by[i].lang_pred for i in (1000, 1001, 1002)} == {"und"} and by[None].lang_pred == "de"
    import zlib

    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got if r.doc_id is not None)
    kept = lang_id.keep_identified(table(rows + odd))
    assert {r.doc_id for r in kept.collect()} >= {r[0] for r in rows} and not {1000, 1001, 1002} & {r.doc_id for r in kept.collect()}
    unlabelled = table([(1, "some text", None, None), (2, "", None, None)])
    assert [r.lang_pred for r in lang_id.identify(unlabelled).collect()] == ["und", "und"]
    assert lang_id.identify(unlabelled.limit(0)).count() == 0


def test_long_texts_do_not_depend_on_chunks(monkeypatch):
    model = lang_id.fit({"a": [b"some training text of words"], "b": [b"zzz yyy xxx"]})
    whole = model.lengths(b"some words xxx " * 40)
    monkeypatch.setattr(lang_id, "CHUNK", 7)
    assert abs(model.lengths(b"some words xxx " * 40) - whole).max() < 1e-6


def brute_license(text, threshold=0.8):
    words = licenses.words_of((text or "").encode())
    places, labels = [], set()
    for phrase, label in licenses.PHRASES.items():
        p = phrase.encode().split()
        for i in range(len(words) - len(p) + 1):
            if words[i : i + len(p)] == p:
                places.append(i)
                labels.add(label)
    met, score = set(labels), 1.0 if labels else 0.0
    paragraphs = re.split(r"\n[ \t\x0b-\r]*\n", text or "")
    for block in [x for p in paragraphs for x in [*p.split("\n"), p]]:
        own = set(licenses.words_of(block.encode()))
        for label, t in licenses.template_words(licenses.TEMPLATES).items():
            if len(own & t) / len(t) >= threshold - 1e-12:
                met.add(label)
                score = max(score, len(own & t) / len(t))
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels)), ",".join(sorted(met)), score


def test_licenses(table):
    rng = random.Random(2)
    rows = ODD + [(20, "Released under the MIT License."), (21, "cc-by-nc and under the mit license, cc by nc"), (22, "APACHE LICENSE: VERSION 2!")]
    for i, t in enumerate(licenses.TEMPLATES.values()):
        for j in range(4):
            words = [w for w in t.split() if rng.random() > j * 0.08]
            cut = len(words) // 2
            rows.append((100 + 10 * i + j, "intro text\n\n" + " ".join(words[:cut]) + "\n" + " ".join(words[cut:]) + "\n \nmore"))
    got = licenses.scan_licenses(table(rows)).collect()
    want = sorted((str(r[0]), *brute_license(r[1])) for r in rows)
    have = sorted((str(r.doc_id), r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score) for r in got)
    assert [h[:-1] for h in have] == [w[:-1] for w in want] and all(abs(h[-1] - w[-1]) < 1e-9 for h, w in zip(have, want, strict=True))


def test_mixing_fills_budgets(table):
    rng = random.Random(3)
    rows = [(i, " ".join(["w"] * rng.randint(0, 30)), rng.choice(["en", "de", None]), f"src{rng.choice([0, 0, 0, 1, 2, 5])}") for i in range(400)] + [(None, "a b", None, None), (1, "x y", "en", "src0"), (500, None, "fr", "src3")]
    docs = table(rows)
    plan = mixing.MixPlan()
    out = mixing.mix(docs, plan).collect()
    assert len(out) == len(rows) and all(0 <= r.copies <= plan.epochs + 1 for r in out)
    budget = {(r.domain, r.lang, r.source): (r.tokens, r.budget) for r in mixing.leaf_budgets(mixing.mix(docs).groupBy("domain", "lang", "source").agg(F.sum("n_tokens").alias("tokens")), plan).collect()}
    total = sum(t for t, _ in budget.values())
    assert total * 3 // 5 - len(budget) <= sum(b for _, b in budget.values()) <= total * 3 // 5
    for leaf, (tokens, b) in budget.items():
        own = [r for r in out if (r.domain, r.lang, r.source) == leaf]
        used = sum(r.n_tokens * r.copies for r in own)
        longest = max((r.n_tokens for r in own), default=0)
        assert b <= tokens * plan.epochs and b <= used <= b + 2 * longest


def test_mixing_shortage_goes_to_siblings_first(spark):
    plan = mixing.MixPlan(weights={"domain": {"a": 1, "b": 1}}, share=(1, 2), epochs=1)
    leaves = spark.createDataFrame([("a", "x", "s1", 10), ("a", "y", "s2", 1000), ("b", "x", "s3", 1000)], "domain string, lang string, source string, tokens long")
    got = {r.source: r.budget for r in mixing.leaf_budgets(leaves, plan).collect()}
    assert got == {"s1": 10, "s2": 492, "s3": 502}


def test_mixed_documents_keep_columns(table):
    docs = table([(1, "a b c", "en", "src0"), (2, "d", "de", "src1"), (3, None, None, None)])
    out = mixing.mixed_documents(docs)
    assert out.columns == [c for c in docs.columns if c != "copies"] + ["copies"]
    assert mixing.mix(docs.limit(0)).count() == 0


SF = "/root/testdata/sf0.001"


def test_registered_queries_and_pipeline(spark):
    import __spark_entry__
    import corpus_pipeline

    names = __spark_entry__.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 14))
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rest = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, rest, SF)
        assert out.columns == docs.columns and 0 < out.count() <= rest.count()
        rest = out
    assert "copies" in corpus_pipeline.run(spark, SF).columns


def test_pipeline_stages_keep_one_of_each(table, spark):
    """Of exact copies the largest id, of near copies the smallest, no passage of the benchmark; all else stays, with its columns."""
    import corpus_pipeline

    rng = random.Random(21)
    prose = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(n))
    item = max((r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect() if r.text), key=len)
    texts = [prose(200) for _ in range(10)]
    words = texts[1].split()
    far = [*words[:60], *prose(80).split(), *words[140:]]  # half of its shingles are others: no near copy
    rows = [*enumerate(texts), (20, texts[0]), (21, " ".join([*words[:90], "edited", *words[91:]])), (22, " ".join(far)), (23, f"{prose(30)} {item} {prose(30)}")]
    stages, rest = dict(corpus_pipeline.STAGES), table(rows)
    columns, want = rest.columns, {*range(10), 20, 21, 22, 23}
    for name, gone in (("exact", {0}), ("near", {21}), ("benchmark", {23})):
        rest, want = stages[name](spark, rest, SF), want - gone
        assert {r.doc_id for r in rest.collect()} == want and rest.columns == columns, name


def test_pipeline_stages_survive_odd_rows(table, spark):
    import corpus_pipeline

    rest = table(ODD + [(i, f"some plain words number {i} " * 5) for i in range(20, 40)])
    for name, stage in corpus_pipeline.STAGES:
        rest = stage(spark, rest, SF)
        assert rest.count() > 0, name
    empty = table([(1, "x")]).limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0, name


@pytest.mark.parametrize(
    ("text", "kind", "part"),
    [
        ("write to max at firma dot at now", "email", "max at firma dot at"), ("joe at mail dot ru", "email", "joe at mail dot ru"), ("jane at example.com!", "email", "jane at example.com"), ("x at y dot nl", "email", "x at y dot nl"),
        ("max AT firma PUNKT de", "email", "max AT firma PUNKT de"), ("john (a) example (d) com", "email", "john (a) example (d) com"), ("ana arroba casa punto es", "email", "ana arroba casa punto es"),
        ("call plus four nine three zero one two three four five six", "phone", "plus four nine three zero one two three four five six"), ("ruf plus vier neun drei null eins zwei drei vier fünf sechs an", "phone", "plus vier neun drei null eins zwei drei vier fünf sechs"),
        ("host one dot two dot three dot four", "ip", "one dot two dot three dot four"),
    ],
)
def test_disguises_in_four_languages(text, kind, part):
    base, every = pii.spans(text)
    assert not base and [(k, text[s:e]) for s, e, k in every] == [(kind, part)]


@pytest.mark.parametrize("text", ["we look at this point and go", "un deux trois soleil", "three four five", "he is at home. com is no word", "at noon dot your eyes", "at dot at dot", "meet at ten"])
def test_plain_words_are_no_disguise(text):
    assert pii.spans(text) == ([], [])


def test_rewriting_keeps_places():
    """Every rewritten character points at the source characters it stands for, over several rewritings."""
    rng = random.Random(4)
    for _ in range(300):
        text = "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 40)))
        traced, spans = pii.Traced(text), [(c, i, i + 1) for i, c in enumerate(text)]
        for _ in range(3):
            cuts = sorted(rng.sample(range(len(traced.text) + 1), min(4, len(traced.text) + 1)))
            edits = [(a, b, rng.choice(["", "X", "YZ"])) for a, b in zip(cuts[::2], cuts[1::2], strict=False) if a < b]
            out, at = [], 0
            for a, b, new in edits:
                out += spans[at:a] + [(c, spans[a][1], spans[b - 1][2]) for c in new]
                at = b
            spans = out + spans[at:]
            traced = traced.rewrite(edits)
        assert traced.text == "".join(c for c, _, _ in spans)
        assert [traced.source(i, i + 1) for i in range(len(spans))] == [(a, b) for _, a, b in spans]


def test_many_spans_take_one_pass():
    import time

    def seconds(n):
        text = " ".join(f"a{i}@b.de c{i} [at] d dot fr" for i in range(n))
        start = time.perf_counter()
        base, every = pii.spans(text)
        assert len(base) == n and len(every) == 2 * n
        return time.perf_counter() - start

    seconds(200)
    assert seconds(8000) < 12 * max(seconds(2000), 0.05)


def test_language_model_of_lower_order_and_many_names(table):
    model = lang_id.fit({"a": [b"some training text of words"], "b": [b"zzz yyy xxx zzz"]}, order=2)
    assert model.predict(b"zzz yyy")[0] == "b" and model.predict(b"text of words")[0] == "a"
    rows = [(i, f"text number {i}", f"l{i % 700}", "s") for i in range(1500)] + [(5000 + i, "die und der das ist", "de", "s") for i in range(40)] + [(6000, "x", "n" * 500, "s")]
    sample = lang_id.training_sample(table(rows))
    assert len(sample) <= lang_id.LANGUAGES and "de" in sample and all(len(k) <= lang_id.NAME_CHARS for k in sample)
    long = lang_id.training_sample(table([(i, "word " * 5000, "en", "s") for i in range(20)]), max_bytes=1000)
    assert sum(map(len, long["en"])) <= 1000


def test_long_items_are_cut_into_pieces(spark):
    words = [f"w{i}" for i in range(95)]
    bench = spark.createDataFrame([("a", " ".join(words)), ("b", "x, Y"), ("c", None)], "item_id string, text string")
    got = [(r.item_id, r.text) for r in decontam.pieces(bench, 10, 30).collect()]
    whole = {tuple(words[i : i + 10]) for i in range(86)}
    assert {tuple(t.split()[i : i + 10]) for k, t in got if k == "a" for i in range(len(t.split()) - 9)} == whole
    assert all(len(t.split()) <= 30 for _, t in got) and ("b", "x Y") in got
    assert len(decontam.benchmark_shards(bench, 200)) > 1
