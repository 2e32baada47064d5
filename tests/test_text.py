"""Text, parsing and routing expressions against plain Python."""

import hashlib
import random
import re
import uuid

import pytest
from pyspark.sql import functions as F

from tarnwater.functions import parsing as P
from tarnwater.functions import text as X
from tarnwater.operators import dedupe, routing

SAMPLES = ["", None, "  Hello\tWorld \n\n second   line \r\n", "باقة Super 100 جنيه أحمد", "dial *999# or #550* now", "3,100 EGP and 50 PT", "x² Ünï — 12.5 GB",
    "A‎B‏", "line\x85two\x0bthree", "٠١٢٣ items", "Tell me about TP-Link VN020 and DEX 77 dex"]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame([(i, s) for i, s in enumerate(SAMPLES)], "i int, s string")


def apply(rows, f):
    return [r[0] for r in rows.orderBy("i").select(f(F.col("s"))).collect()]


def py(f):
    return [f(s or "") for s in SAMPLES]


def squeeze(s):
    return " ".join(s.split())


def key(s):
    return squeeze(re.sub(r"[^a-z0-9؀-ۿ]+", " ", s.lower()))


@pytest.mark.parametrize(
    ("mine", "plain"),
    [
        (X.squeeze, squeeze),
        (X.key, key),
        (X.source_key, lambda s: squeeze(s.lower())),
        (X.clean_text, lambda s: "\n".join(x for x in map(squeeze, s.splitlines()) if x)),
        (X.clean_line, lambda s: squeeze(s.replace("‎", "").replace("‏", ""))),
        (lambda c: X.snippet(c, 12), lambda s: squeeze(s) if len(squeeze(s)) <= 12 else squeeze(s)[:9].rstrip() + "..."),
        (X.short_hash, lambda s: hashlib.sha256(s.encode()).hexdigest()[:16]),
        (X.uuid5, lambda s: str(uuid.uuid5(uuid.NAMESPACE_DNS, s))),
        (X.token_count, lambda s: len(re.findall(r"[\w؀-ۿ]+|[*#][\w*#]+|[\w*]+#", s)) if "²" not in s else None),
    ],
)
def test_normalisers(rows, mine, plain):
    got, want = apply(rows.na.fill("") if mine is X.uuid5 else rows, mine), py(plain)
    assert [g for g, w in zip(got, want, strict=True) if w is not None] == [w for w in want if w is not None]


def test_matching_and_tokens(rows):
    assert apply(rows, X.matching)[9] == "0123 items" and apply(rows, X.matching)[3] == "باقة super 100 جنيه احمد"
    assert apply(rows, X.sparse_tokens)[4] == ["dial", "*999#", "or", "550", "now"]
    assert apply(rows, X.sparse_tokens)[5] == ["3,100", "egp", "and", "50", "pt"]
    assert apply(rows, X.match_text)[4] == "dial *999# or *550# now" and apply(rows, X.match_text)[5] == "3100 le and 50 pt"


def test_entities_and_languages(rows):
    assert apply(rows, X.query_entities)[10] == ["TP-Link", "VN020", "DEX", "77"]
    assert apply(rows, X.language_any)[3:5] == ["mixed", "en"] and apply(rows, X.language_any)[0] is None
    assert apply(rows, X.language_or_english)[0] == "en"


def test_amounts(rows):
    assert [tuple(x) for x in apply(rows, P.price_mobile)][5] == ("3,100 EGP", 3.1)
    assert [tuple(x) for x in apply(rows, P.price_business)][5] == ("3,100 EGP", 3100.0)
    assert tuple(apply(rows, P.quota_mobile)[6]) == ("12.5 GB", 12800.0, 12.5)
    assert apply(rows, P.ussd_codes)[4] == ["*999#", "#550*"]


def one(spark, text, *columns):
    return spark.createDataFrame([(text,)], "s string").select(*[f(F.col("s")) for f in columns]).first()


def test_codes_inside_longer_ones_go(spark):
    assert one(spark, "use *123# or *123*4# now", P.mobile_codes)[0] == ["*123#", "*123*4#"]
    assert one(spark, "code * 9 9 * x # and *5", P.source_codes)[0] == []
    assert one(spark, "dial * 99 * 1 # ok", P.source_codes)[0] == ["*99*1#"]


def test_validity_and_lines(spark):
    assert tuple(one(spark, "valid for 7 days", P.validity)[0]) == ("7 days", 7) or tuple(one(spark, "valid for 7 days", P.validity)[0]) == ("7 day", 7)
    assert tuple(one(spark, "a weekly pack", P.validity)[0]) == ("weekly", 7) and tuple(one(spark, "none", P.validity)[0]) == (None, None)
    assert one(spark, "Home\nReal line 1\nreal LINE 1\n\nx\nOther", P.without_noise)[0] == "Real line 1\nx\nOther"
    assert one(spark, "a b\nc d e\nA  B", lambda c: F.array_join(P.unique_lines(c), "|"))[0] == "a b|c d e"
    assert one(spark, "Super Kix 100\n5,000 Kix then 900 kix", lambda c: P.kix_units(c, F.lit("Super Kix 100")))[0] == 5000


def test_urls(spark):
    u = "HTTPS://Host.Example/en/Shop/Item-1/?q=1#top"
    got = one(spark, u, X.url_canonical, X.url_pair_key, X.url_other_language, X.url_slug, lambda c: X.url_allowed(c, ("host.example",), (), ("/login",), (".pdf",)))
    assert tuple(got) == ("https://host.example/Shop/Item-1", "https://host.example/shop/item-1", "HTTPS://Host.Example/ar/Shop/Item-1/?q=1#top", "Item-1", True)


ROUTES = [("price?", "clarification", None), ("", "clarification", None), ("111", "retrieval", None), ("how to hack a line", "rejection", None),
    ("is Vodafone better", "rejection", None), ("price of zte router", "retrieval", "devices"), ("what is the balance code", "retrieval", "services"),
    ("model ab12 cost", "retrieval", "devices"), ("we air internet speed", "retrieval", "we_home"), ("*550#", "retrieval", None),
    ("What is the SIM swap cost?", "retrieval", "faq"), ("how to bypass the router", "rejection", None), ("hello", "clarification", None)]


def test_routes(spark):
    df = spark.createDataFrame([(i, q) for i, (q, _, _) in enumerate(ROUTES)], "qid long, query string")
    got = routing.route(df).orderBy("qid").collect()
    assert [(r.route, r.category_filter) for r in got] == [x[1:] for x in ROUTES]
    assert {r.qid: r.final_top_k for r in got}[5] == 3 and got[4].complexity == "complex" and got[4].final_top_k == 8
    both = routing.route(df.withColumn("mode", F.lit("mixed")), mode="mode").filter("qid = 4").first()
    assert both.route == "retrieval" and both.source_mode == "both" and both.final_top_k == 8


def test_metadata_filters(spark):
    df = spark.createDataFrame([(1, "a", {"tier": "gold"}), (2, None, {"category": "b"}), (3, "b", {})], "doc int, category string, metadata map<string,string>")
    ids = lambda d: sorted(r.doc for r in d.collect())
    assert ids(routing.metadata_filter(df, {"category": ["b"], "x": None})) == [2, 3]
    assert ids(routing.metadata_filter(df, {"category": "b"}, fallback=False)) == [3]
    assert ids(routing.metadata_filter(df, {"tier": "gold", "category": "a"})) == [1]


def greedy(rows):
    seen, out = set(), []
    for rank, keys in rows:
        if not set(keys) & seen:
            seen |= set(keys)
            out.append(rank)
    return out


def test_any_key_dedupe_is_greedy(spark):
    data = [(1, ["a", "b"]), (2, ["b", "c"]), (3, ["c", "d"]), (4, ["d"]), (5, []), (6, ["e", "a"])]
    df = spark.createDataFrame([("q", r, k) for r, k in data], "qid string, rank int, keys array<string>")
    got = sorted(r["rank"] for r in dedupe.any_key_dedupe(df, F.col("keys")).collect())
    assert got == greedy(data)


def test_squeeze_lines_and_key_are_those_of_the_plain_patterns(spark):
    """The patterns that pass over plain ASCII give what the stated ones give, and leave single spaces unmatched."""
    rng = random.Random(5)
    letters = "a bZ9\t-\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2003\u2028\u2029\u202f\u205f\u3000\u0663\u0634é😀"
    rows = spark.createDataFrame([("".join(rng.choice(letters) for _ in range(rng.randint(0, 12))),) for _ in range(4000)] + [("plain words only",)], "s string")
    c = F.col("s")
    plain = F.regexp_replace(F.regexp_replace(c, X.SPACE + "+", " "), "^ | $", "")
    keyed = F.trim(F.regexp_replace(F.lower(c), r"[^a-z0-9\x{600}-\x{6ff}]+", " "))
    assert rows.filter((X.squeeze(c) != plain) | (X.lines(c) != F.split(c, X.LINE_END)) | (X.key(c) != keyed)).count() == 0
    assert rows.filter("s = 'plain words only'").filter(c.rlike(X.TO_SQUEEZE) | c.rlike(X.TO_KEY)).count() == 0


def test_lines_get_one_key_each(spark):
    """A line's key, the dearest step of the record normalisers, is made once, and a whole text's only where its start does not tell."""
    one = spark.createDataFrame([("a",)], "t string")
    for c in (P.without_noise(F.col("t")), F.array_join(P.unique_lines(F.col("t"), kind="business"), "|")):
        assert one.select(c.alias("x"))._jdf.queryExecution().analyzed().toString().count(X.TO_KEY) == 1
    odd = ["", None, " - ", "a", "Home", "x\nHome\nX\n\ny", "a b\nA  B\nc\na-b", "word " * 40, "--" * 90 + "word" * 20, "İ" * 60, "عربي " * 30, "a\r\nb\n\rc", "a\x0b b  c  d  e"]
    rows = spark.createDataFrame([(t, other) for t in odd for other in odd], "t string, other string")
    key, other = X.key(F.col("t")), X.key(F.col("other"))
    checks = [X.key_under(F.col("t"), 40) == (F.length(key) < 40), X.key_adds_nothing(F.col("t"), F.col("other")) == ((key == "") | (key == other))]
    checks += [X.lines(F.col("t")) == F.split(X.text(F.col("t")), X.LINE_END), X.squeeze(F.col("t")) == F.trim(F.regexp_replace(X.text(F.col("t")), X.SPACE + "+", " "))]
    assert [rows.filter(~x).count() for x in checks] == [0] * 4 and rows.filter(checks[1]).count() == rows.count()


def test_what_aliases_compare_is_worked_out_once(spark):
    """The title's key is a column, not an expression in each of the alias lists' comparisons."""
    from tarnwater.operators import records

    base = spark.createDataFrame([("Static IP plan", "text", "u")], "title string, content string, citation_url string")
    plan = records.normalize_business(base).select("search_aliases")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("lower(title") <= 3
