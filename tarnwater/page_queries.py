"""Queries over a catalogue's pages and records, with the rows that they must give.

The table `pages` has no tables, cards, people or downloads, so these pages are made from the table `part`: one of each section for
each part, with its name and size in them.  The expected rows are written out, derived by hand from the rules of each section.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import html, pages, quality, records
from .sources.shared import spread, stored


MOBILE = """<html><head><title>@name@ plans</title><meta name="description" content="Prepaid @name@ plans"></head><body><nav><a href="/menu">Menu</a></nav><main>
<h1>@name@ plan</h1><p>Call all day for @size@ EGP with 10 GB</p><p>home</p>
<table><tr><th>Name</th><th>Price</th></tr><tr><td>@name@ 20</td><td>20 EGP</td></tr><tr><td>@name@ 40</td><td>40 EGP</td><td>new</td></tr></table>
<div class="plan-card"><h3>@name@ extra</h3><p>Adds 5 GB to your @name@ plan when you dial *111# today</p></div></main></body></html>"""
BUSINESS = """<html><body><header><h1>Site</h1></header><main><h1>Shared hosting @name@</h1><p>Host your site with us for 1,200 EGP a year on our servers</p><p>Backup is kept for thirty days</p>
<table><tr><th>Plan</th><th>Fee</th></tr><tr><td>Basic</td><td>@size@ EGP</td></tr></table>
<div class="service-box"><h2>Mail</h2><p>Mailboxes for your whole team</p><p>Spam is filtered out</p><p>Support by phone</p></div>
<h3>Terms and conditions</h3><p>Paid in advance</p></main></body></html>"""
SECTION = """<html><body><main><h1>News</h1><p>We meet for @name@</p><p>Dr Jane Roe</p><p>Chairman</p><a href="/files/report.pdf">Annual report</a><a href="/files/iso.pdf">ISO certificate</a><a href="/files/report.pdf">Again</a>
<div class="news-card"><h3>Prize</h3><p>We won an award for our network in spring</p></div></main></body></html>"""
PUBLIC = """<html><body><main><h1>Spring offer @name@</h1><p>Buy a line for @size@ EGP and get 3 GB for the whole family</p><p>Valid in all our shops and online until the end of May, while stocks last</p></main></body></html>"""
GENERIC = "<html><body><ul><li>One</li><li>Two</li></ul><p>Menu</p><p>Some text on @name@</p></body></html>"
#: (kind, page_id, url, html)
PAGES = (("mobile", 1, "https://h.example/en/mobile/prepaid-@key@", MOBILE), ("business", 2, "https://h.example/web/shared-hosting", BUSINESS),
    ("section", 3, "https://h.example/en/about/news", SECTION), ("public", 4, "https://h.example/en/offers/one", PUBLIC),
    ("generic", 5, "https://h.example/x/@key@", GENERIC))


def filled(column: F.Column) -> F.Column:
    """A template with a part's name, size and key in it."""
    for name, value in (("@name@", F.col("p_name")), ("@size@", F.col("p_size").cast("string")), ("@key@", F.col("p_partkey").cast("string"))):
        column = F.replace(column, F.lit(name), value)
    return column


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_name", "p_size"))


def catalogue(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    """The parsed pages of one section: page_id is ten times the part's key, and the page's number."""
    _, number, url, page = next(p for p in PAGES if p[0] == kind)
    rows = parts(spark, sf_dir).select((F.col("p_partkey") * 10 + number).cast("long").alias("page_id"), filled(F.lit(url)).alias("url"), filled(F.lit(page)).alias("html"))
    return stored(html.parsed(rows, kind).drop("html"), "catalogue")


def values(columns: str, *rows: tuple, key: str = "page_id") -> str:
    """SQL that gives these rows for each part, its name, size and key in place of their names, the key column numbered anew."""

    def literal(v: object) -> str:
        if v is None:
            return "NULL"
        if isinstance(v, bool):
            return str(v).lower()
        if isinstance(v, str):
            return "'" + v.replace("'", "''") + "'"
        return f"{v!r}::DOUBLE" if isinstance(v, float) else f"{v}::BIGINT"

    names = columns.split(", ")
    texts = {n for i, n in enumerate(names) if any(isinstance(r[i], str) for r in rows)}
    shown = [f"replace(replace(replace({n}, '@name@', p_name), '@size@', p_size::VARCHAR), '@key@', p_partkey::VARCHAR) AS {n}" if n in texts else f"(p_partkey * 10 + {n})::BIGINT AS {n}" if n == key else n for n in names]
    return f"SELECT {', '.join(shown)} FROM (VALUES {', '.join('(' + ', '.join(map(literal, r)) + ')' for r in rows)}) AS t({columns}) CROSS JOIN part"


def catalogue_page_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Title, description, language, table rows, cards, terms, people, downloads and links of each page."""
    out = []
    for kind, *_ in PAGES:
        page = catalogue(spark, sf_dir, kind)
        joined = lambda c, f: F.array_join(F.transform(c, f), "|")
        out.append(page.select("page_id", "title", "description", "language", F.size("lines").cast("long").alias("n_lines"),
            joined(html.row_structs(kind), lambda r: F.to_json(r["data"])).alias("tables"), joined(html.card_structs(kind), lambda c: c["title"]).alias("cards"),
            F.array_join(html.term_lines(kind), "|").alias("terms"), joined(html.people_structs(), lambda p: F.concat_ws(": ", p["name"], p["title"])).alias("people"),
            joined(html.download_structs(), lambda d: F.concat_ws(" ", d["kind"], d["url"])).alias("downloads"),
            F.size(html.link_structs()).cast("long").alias("n_links")))
    whole = out[0]
    for part in out[1:]:
        whole = whole.unionByName(part)
    return whole


PARTS_SQL = values(
    "page_id, title, description, language, n_lines, tables, cards, terms, people, downloads, n_links",
    (1, "@name@ plan", "Prepaid @name@ plans", "en", 11, '{"Name":"@name@ 20","Price":"20 EGP"}|{"column_1":"@name@ 40","column_2":"40 EGP","column_3":"new"}', "@name@ extra", "", "", "", 1),
    (2, "Shared hosting @name@", "Host your site with us for 1,200 EGP a year on our servers", "en", 13, '{"Plan":"Basic","Fee":"@size@ EGP"}', "Mail", "Paid in advance", "", "", 0),
    (3, "News", "We won an award for our network in spring", "en", 9, "", "Prize", "", "Dr Jane Roe: Chairman|Chairman: Annual report", "report https://h.example/files/report.pdf|certificate https://h.example/files/iso.pdf", 2),
    (4, "Spring offer @name@", "Buy a line for @size@ EGP and get 3 GB for the whole family", "en", 3, "", "", "", "", "", 0),
    (5, "One", "", "en", 3, "", "", "", "", "", 0),
)


def catalogue_mobile_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.mobile(catalogue(spark, sf_dir, "mobile")).select("page_id", "kind", "title", "mobile_category", "record_type", "language", "content")


_LINES = ["Call all day for @size@ EGP with 10 GB", "Name", "Price", "@name@ 20", "20 EGP", "@name@ 40", "40 EGP", "new", "@name@ extra", "Adds 5 GB to your @name@ plan when you dial *111# today"]
_MOBILE = "\nCategory: Prepaid\nDescription: Prepaid @name@ plans\n"
MOBILE_SQL = values(
    "page_id, kind, title, mobile_category, record_type, language, content",
    (1, "page", "@name@ plan", "prepaid", "package", "en", f"Plan or service: @name@ plan{_MOBILE}Price: @size@ EGP\nQuota: 10 GB\nCodes: *111#\nBenefits:\n" + "\n".join(f"- {x}" for x in _LINES) + "\nDetails:\n" + "\n".join(_LINES)),
    (1, "row", "@name@ 20", "prepaid", "package", "en", f"Plan or service: @name@ 20{_MOBILE}Price: 20 EGP\nDetails:\n@name@ 20 | 20 EGP"),
    (1, "row", "@name@ 40", "prepaid", "package", "en", f"Plan or service: @name@ 40{_MOBILE}Price: 40 EGP\nDetails:\n@name@ 40 | 40 EGP | new"),
    (1, "card", "@name@ extra", "prepaid", "plan", "en", f"Plan or service: @name@ extra{_MOBILE}Quota: 5 GB\nCodes: *111#\nDetails:\n@name@ extra\nAdds 5 GB to your @name@ plan when you dial *111# today"),
)


def catalogue_business_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.business(catalogue(spark, sf_dir, "business")).select("page_id", "kind", "title", "business_category", "business_sub_parent", "record_type", "service_name", "plan_name", "content")


_HEAD = "\nCategory: Hosting Data Center\nDescription: Host your site with us for 1,200 EGP a year on our servers\n"
_BOX = ["Mail", "Mailboxes for your whole team", "Spam is filtered out", "Support by phone"]
_WHOLE = ["Backup is kept for thirty days", "Plan", "Fee", "Basic", "@size@ EGP", *_BOX, "Terms and conditions", "Paid in advance"]
_HOSTING = ("business_hosting_data_center", "Data Infrastructure, VPS & Racks")
BUSINESS_SQL = values(
    "page_id, kind, title, business_category, business_sub_parent, record_type, service_name, plan_name, content",
    (2, "page", "Shared hosting @name@", *_HOSTING, "business_hosting_plan", None, "Shared hosting @name@", f"Service: Shared hosting @name@{_HEAD}Price: 1,200 EGP\nFeatures:\n- Backup is kept for thirty days\n- Mailboxes for your whole team\n- Spam is filtered out\n- Support by phone\n- Terms and conditions\n- Paid in advance\nTerms and conditions:\n- Paid in advance\nDetails:\n" + "\n".join(_WHOLE)),
    (2, "row", "Basic", *_HOSTING, "business_hosting_plan", None, "Basic", f"Service: Basic{_HEAD}Price: @size@ EGP\nDetails:\nBasic | @size@ EGP"),
    (2, "card", "Mail", *_HOSTING, "business_service", "Mail", None, f"Service: Mail{_HEAD}Features:\n- Mailboxes for your whole team\n- Spam is filtered out\n- Support by phone\nDetails:\n" + "\n".join(_BOX)),
)


def catalogue_section_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.section(catalogue(spark, sf_dir, "section"), "about_te").select("page_id", "kind", "title", "topic", "record_type", "content")


_CHILD = "Section: About Te\nTopic: About TE\nTitle: "
SECTION_SQL = values(
    "page_id, kind, title, topic, record_type, content",
    (3, "page", "News", "About TE", "award", f"{_CHILD}News\nDescription: We won an award for our network in spring\nDetails:\nWe meet for @name@\nDr Jane Roe\nChairman\nAnnual report\nISO certificate\nAgain\nPrize\nReport links:\n- Annual report: https://h.example/files/report.pdf\nCertificate links:\n- ISO certificate: https://h.example/files/iso.pdf"),
    (3, "person", "Dr Jane Roe", "About TE", "management_member", f"{_CHILD}Dr Jane Roe\nChairman"),
    (3, "person", "Chairman", "About TE", "management_member", f"{_CHILD}Chairman\nAnnual report"),
    (3, "card", "Prize", "About TE", "award", f"{_CHILD}Prize\nPrize\nWe won an award for our network in spring"),
    (3, "link", "Annual report", "About TE", "downloadable_report", f"{_CHILD}Annual report\nhttps://h.example/files/report.pdf"),
    (3, "link", "ISO certificate", "About TE", "iso_certificate", f"{_CHILD}ISO certificate\nhttps://h.example/files/iso.pdf"),
)


def catalogue_public_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Public and generic pages: one record each."""
    one = pages.public(catalogue(spark, sf_dir, "public")).select("page_id", "title", "category", "record_type", "language", "content", "quality_score",
        "is_accepted", F.array_join("quality_flags", ";").alias("flags"), F.concat_ws(";", F.array_join("prices", ","), F.array_join("quotas", ",")).alias("amounts"))
    other = pages.post_process_generic(pages.generic(catalogue(spark, sf_dir, "generic"), "shops")).select("page_id", "title", "category", "record_type",
        "language", "content", "quality_score", "is_accepted", F.array_join("quality_flags", ";").alias("flags"), F.lit("").alias("amounts"))
    return one.unionByName(other)


PUBLIC_SQL = values(
    "page_id, title, category, record_type, language, content, quality_score, is_accepted, flags, amounts",
    (4, "Spring offer @name@", "offers", "package_or_offer", "en", "Title: Spring offer @name@\nDescription: Buy a line for @size@ EGP and get 3 GB for the whole family\nDetails:\nValid in all our shops and online until the end of May, while stocks last", 0.9, True, "public_site_scrape;short_content", "@size@ EGP;3 GB"),
    (5, "One", "shops", "detail", "en", "One\nTwo\nSome text on @name@", 0.65, True, "", ""),
)

_GREAT = "Great plan at @size@ EGP with 10 GB valid for 30 days, dial *111# to join and enjoy all of it every single month of the year now"
#: (kind, id, title, content, citation_url, category, record_type)
RECORDS = (
    ("mobile", 1, "Plan", _GREAT, "u", "prepaid", "plan"), ("mobile", 2, "", "short", None, "other", "odd"),
        ("mobile", 3, "Super Kix 25", "Each plan costs ٢٥ جنيه and holds 2,500 Kix\nhome\n1 Kix = 1 MB for every site you may like", "u", "control_plans", "plan"),
    ("business", 4, "Business Value", "Fee of @size@ EGP monthly for 300 minutes", "u", "business_mobile_services", "business_plan"), ("business", 5, "Empty", "Nothing here", "u", "business", "detail"),
    ("section", 6, "History", "Our house was founded on 3 May 1854 and moved in 1926 to the place where it stands to this day, by the river", "u", None, "history_milestone"), ("section", 7, "Short", "Too short", "u", None, "award"),
)


def catalogue_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raw records above for each part; id is ten times the part's key, and the record's number."""
    names = ("kind", "id", "title", "content", "citation_url", "category", "record_type")
    one = F.array(*[F.struct(*[(F.lit(v) if v is not None else F.lit(None).cast("string")).alias(n) for n, v in zip(names, r)]) for r in RECORDS])
    rows = parts(spark, sf_dir).withColumn("r", F.explode(one)).select("p_partkey", "p_name", "p_size", "r.*")
    return rows.withColumns({"id": (F.col("p_partkey") * 10 + F.col("id")).cast("long"), "title": filled(F.col("title")), "content": filled(F.col("content"))}).select(*names)


def catalogue_record_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each section's normaliser over a catalogue's records; the third mobile record after its cleanup too."""
    raw = catalogue_rows(spark, sf_dir).withColumn("language", F.lit("en"))
    mobile = records.normalize_mobile(raw.filter("kind = 'mobile'").withColumn("mobile_category", F.col("category")))
    business = records.normalize_business(raw.filter("kind = 'business'").withColumn("business_category", F.col("category")))
    section = records.normalize_section(raw.filter("kind = 'section'").withColumns({"section": F.lit("about"), "topic": F.lit("us")}))
    cleaned = records.cleanup_mobile(mobile.filter("id % 10 = 3").withColumn("expected_language", F.lit("en"))).withColumn("kind", F.lit("cleanup"))
    pick = lambda df, fact: df.select("kind", "id", "record_type", "quality_score", "is_accepted", "rejection_reason", fact.cast("string").alias("fact"), F.array_join("search_aliases", "|").alias("aliases"))
    parts = [pick(mobile, F.concat_ws(",", F.col("price_egp").cast("string"), F.col("quota_gb").cast("string"), F.col("validity_days").cast("string"), F.array_join("ussd_codes", " "))),
        pick(business, F.concat_ws(",", F.col("price_egp").cast("string"), F.col("monthly_fee_egp").cast("string"), F.col("minutes").cast("string"))),
        pick(section, F.array_join("dates", ",")),
        pick(cleaned, F.concat_ws(",", F.col("kix_units").cast("string"), F.array_join("consumption_rules", ";"), F.array_join("quality_flags", ";")))]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


SCORES_SQL = values(
    "kind, id, record_type, quality_score, is_accepted, rejection_reason, fact, aliases",
    # title .18, address .12, length .28, price .1, quota .1, code .12
    ("mobile", 1, "plan", 0.9, True, "", "@size@.0,10.0,30,*111#", "Plan"),
    ("mobile", 2, "detail", 0.0, False, "wrong category", "", ""),
    # title .18, address .12, length of 50 to 119 characters .12, price .1, quota (1 MB) .1
    ("mobile", 3, "plan", 0.62, True, "", "25.0,0.001,", "Super Kix 25"),
    # .55, address .1, title .1, a fact .12, no noise left .05; rebuilt content below 160 characters.  The line `home` went before.
    ("cleanup", 3, "plan", 0.92, True, "", "2500,1 Kix = 1 MB for every site you may like,kix_units_extracted;consumption_rules_extracted;quota_from_consumption_rule_removed", "Super Kix 25|Super Kix|سوبر كيكس 25|سوبر كيكس|WE Super Kix|كود Super Kix 25|باقة Super Kix 25"),
    # title .18, address .12, a useful fact .24, aliases .05
    ("business", 4, "business_plan", 0.59, True, "", "@size@.0,@size@.0,300", "Business Value|WE Business Value|business value plan|corporate value plan|mobile services"),
    ("business", 5, "detail", 0.35, False, "missing useful text", "", "Empty|business"),
    # Years count from 1900; a day stands behind its month.
    ("section", 6, "history_milestone", 1.0, True, "", "1926", "History|about|us"),
    ("section", 7, "award", 0.65, False, "short content", "", "Short|about|us"),
    key="id",
)


def catalogue_cleanup_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the cleanup did to the mobile records: the second has no address, the third has Kix units and a misread quota."""
    raw = catalogue_rows(spark, sf_dir).filter("kind = 'mobile'").withColumnRenamed("category", "mobile_category").withColumns({"language": F.lit("en"), "expected_language": F.lit("en")})
    return quality.cleanup_summary(records.cleanup_mobile(records.normalize_mobile(raw)))


CLEANUP_SQL = "SELECT 3 * n AS records, 2 * n AS accepted, 0::BIGINT AS ui_noise_removed, n AS kix_units_extracted, 0::BIGINT AS partial_code_replaced, n AS quota_from_consumption_rule_removed, n AS possible_issues FROM (SELECT count(*) AS n FROM part)"

def catalogue_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mobile and business summaries of the catalogue's records."""
    raw = catalogue_rows(spark, sf_dir).withColumn("language", F.lit("en"))
    mobile = stored(records.normalize_mobile(raw.filter("kind = 'mobile'").withColumn("mobile_category", F.col("category"))), "catalogue")
    business = stored(records.normalize_business(raw.filter("kind = 'business'").withColumn("business_category", F.col("category"))), "catalogue")
    parts_ = [quality.section_summary(df, kind, 5, 1).filter("part <> 'flag'").withColumn("kind", F.lit(kind)) for kind, df in (("mobile", mobile), ("business", business))]
    return parts_[0].unionByName(parts_[1]).select("kind", "part", "name", "n")


#: (kind, part, name, records of each part, records besides), by the records above.
SUMMARIES = (
    ("mobile", "total", "records", 3, 0), ("mobile", "total", "accepted", 2, 0), ("mobile", "total", "rejected", 1, 0), ("mobile", "total", "pages_fetched", 0, 5), ("mobile", "total", "failed_urls", 0, 1),
    ("mobile", "missing", "price", 1, 0), ("mobile", "missing", "quota", 1, 0), ("mobile", "missing", "code", 2, 0),
    ("mobile", "language", "en", 3, 0), ("mobile", "mobile_category", "prepaid", 1, 0), ("mobile", "mobile_category", "other", 1, 0),
        ("mobile", "mobile_category", "control_plans", 1, 0), ("mobile", "record_type", "plan", 2, 0), ("mobile", "record_type", "detail", 1, 0),
    ("business", "total", "records", 2, 0), ("business", "total", "accepted", 1, 0), ("business", "total", "rejected", 1, 0), ("business", "total", "pages_fetched", 0, 5), ("business", "total", "failed_urls", 0, 1),
    ("business", "missing", "price", 1, 0), ("business", "missing", "quota", 1, 0), ("business", "missing", "terms", 2, 0),
    ("business", "business_category", "business_mobile_services", 1, 0), ("business", "business_category", "business", 1, 0), ("business", "record_type", "business_plan", 1, 0), ("business", "record_type", "detail", 1, 0),
)
SUMMARIES_SQL = f"SELECT kind, part, name, (each * n + besides)::BIGINT AS n FROM (VALUES {', '.join(map(str, SUMMARIES))}) AS t(kind, part, name, each, besides), (SELECT count(*) AS n FROM part)"

def catalogue_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = [html.table_rows(catalogue(spark, sf_dir, kind), kind) for kind in ("mobile", "business")]
    return both[0].unionByName(both[1]).select("page_id", F.col("table_index").cast("long").alias("table_index"), F.col("row_index").cast("long").alias("row_index"), F.to_json("data").alias("data"), "row_text")


TABLES_SQL = values(
    "page_id, table_index, row_index, data, row_text",
    (1, 0, 1, '{"Name":"@name@ 20","Price":"20 EGP"}', "@name@ 20 | 20 EGP"),
    (1, 0, 2, '{"column_1":"@name@ 40","column_2":"40 EGP","column_3":"new"}', "@name@ 40 | 40 EGP | new"),
    (2, 0, 1, '{"Plan":"Basic","Fee":"@size@ EGP"}', "Basic | @size@ EGP"),
)


def catalogue_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = [html.cards(catalogue(spark, sf_dir, kind), kind) for kind in ("mobile", "business", "section")]
    return every[0].unionByName(every[1]).unionByName(every[2]).withColumn("card_no", F.col("card_no").cast("long"))


CARDS_SQL = values(
    "page_id, card_no, card_title, card_text",
    (1, 0, "@name@ extra", "@name@ extra\nAdds 5 GB to your @name@ plan when you dial *111# today"),
    (2, 0, "Mail", "\n".join(_BOX)),
    (3, 0, "Prize", "Prize\nWe won an award for our network in spring"),
)


def catalogue_people(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.people(catalogue(spark, sf_dir, "section"))


PEOPLE_SQL = values("page_id, name, role", (3, "Dr Jane Roe", "Chairman"), (3, "Chairman", "Annual report"))


def catalogue_downloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.downloads(catalogue(spark, sf_dir, "section"))


DOWNLOADS_SQL = values("page_id, url, link_text, kind", (3, "https://h.example/files/report.pdf", "Annual report", "report"), (3, "https://h.example/files/iso.pdf", "ISO certificate", "certificate"))

QUERIES = {f.__name__: (f, sql) for f,
    sql in ((catalogue_page_parts, PARTS_SQL), (catalogue_mobile_records, MOBILE_SQL), (catalogue_business_records, BUSINESS_SQL),
        (catalogue_section_records, SECTION_SQL), (catalogue_public_records, PUBLIC_SQL), (catalogue_record_scores, SCORES_SQL),
        (catalogue_cleanup_summary, CLEANUP_SQL), (catalogue_summaries, SUMMARIES_SQL), (catalogue_tables, TABLES_SQL), (catalogue_cards, CARDS_SQL),
        (catalogue_people, PEOPLE_SQL), (catalogue_downloads, DOWNLOADS_SQL))}
