"""The pages' parser against the standard library's own, and what its expressions work out once."""

import random
from html.parser import HTMLParser

from pyspark.sql import functions as F

from tarnwater import page_queries
from tarnwater.functions import parsing, text
from tarnwater.operators import html

BITS = ["<p>", "</p>", '<P class="plan card">', "<div class=plan>", '<div aria-hidden="true">', "</div>", "<a href='x'>", '<a href="/q?a=1&amp;b=2#z">', "</a>", "<script>", "</script>", "</SCRIPT >", "if(a<b)", "<br/>",
    "<br />", "<h1>", "</h1>", "<h2 >", "<title>", "</title>", '<meta property="og:title" content="t&eacute;">', "<table>", "<tr>", "<td>", "</td >", "<!-- c -->", "<!doctype html>", "<?pi?>", "<?pi", "<![if x]>", "</>",
    "</ p>", "</3>", "<", "< p", "&amp", "&lt;b&gt;", "&", "&#x", "a\nb", "text  two", "<li>", "<main>", '<a b="1"c="2">', '<a  b="x">', "<a b>", "<a-b>", "<svg/>", "<script/>", "<nav>", '"', ">", '<a href="', "<td"]


class Plain(html.Page):
    goahead = HTMLParser.goahead


def parts_of(page):
    return page.runs, [[getattr(e, n) for n in html.Element.__slots__] for e in page.elements]


def read(kind, markup):
    page = kind(html.KINDS["section"])
    try:
        page.feed(markup)
        page.close()
    except AssertionError as e:
        return str(e)
    return parts_of(page)


def test_any_markup_is_read_as_the_standard_parser_reads_it():
    rng = random.Random(3)
    for _ in range(4000):
        markup = "".join(rng.choice(BITS) for _ in range(rng.randrange(1, 14)))
        assert read(html.Page, markup) == read(Plain, markup), markup


def test_plain_tags_are_read_in_one_step(monkeypatch):
    for name in ("parse_starttag", "parse_endtag"):
        monkeypatch.setattr(HTMLParser, name, None)
    for kind, _, url, page in page_queries.PAGES:
        assert html.parse_page(page, url, html.KINDS[kind])["error"] is None


def test_noise_works_out_a_line_s_key_once(spark):
    plan = spark.range(1).select(parsing.is_noise(F.col("id").cast("string"), "business").alias("n"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("regexp_replace") == 1, plan


def test_first_of_each_key_stays(spark):
    row = spark.range(1).select(text.unique(F.array(*map(F.lit, ["A b", None, " ", "a-B!", "★", "☆", "★ ", "c", "A  b"]))).alias("u"), text.unique(F.lit(None).cast("array<string>")).alias("n")).first()
    assert row.u == ["A b", "★", "☆", "c"] and row.n == []


def test_a_line_before_an_office_or_with_one_is_a_person(spark):
    df = spark.createDataFrame([(["Jane Roe", "CHAIRMAN of all", "x", "12", "مدير عام", "Jane Roe", "Chairman of all"],)], "lines array<string>")
    assert [tuple(p) for p in df.select(html.people_structs().alias("p")).first().p] == [("Jane Roe", "CHAIRMAN of all"), ("CHAIRMAN of all", "x"), ("مدير عام", "Jane Roe"), ("Chairman of all", "")]
