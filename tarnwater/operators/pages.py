"""Parsed pages to raw records of each section: mobile, business, corporate sections, public and generic pages.

A page's rows, cards, people and links travel inside its row until one explode makes records of them, so a page
is parsed once and never joined with its children.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions import parsing as P
from ..functions.text import any_of, joined_hash, key, language_any, language_expected, language_public, short_hash, text, unique, url_canonical, url_slug
from . import html, records
from .dedupe import first_wins

EMPTY = "array<string>"


def filled(c: Column) -> Column:
    return F.coalesce(F.size(c), F.lit(0)) > 0


def labelled(arabic: Column, *parts: tuple[str, Column] | tuple[str, Column, int]) -> Column:
    """Labelled lines in the record's language: (label, value), or (label, items, most) for a list, one item a line.

    Absent values leave no line.  Items of `details` stand bare, others behind a dash.
    """
    out = []
    for name, value, *most in parts:
        label = F.when(arabic, F.lit(L.LABELS[name][0])).otherwise(F.lit(L.LABELS[name][1]))
        if most:
            shown = F.slice(value, 1, most[0])
            body = F.array_join(shown if name == "details" else F.transform(shown, lambda x: F.concat(F.lit("- "), x)), "\n")
            out.append(F.when(filled(value), F.concat(label, F.lit(":\n"), body)))
        else:
            out.append(F.when(text(value) != "", F.concat(label, F.lit(": "), value)))
    return F.trim(F.concat_ws("\n", *out))


def useful_lines() -> Column:
    return F.filter("lines", lambda x: (x != F.col("title")) & (x != F.col("description")))


def record(kind: str, at: Column, title: Column, content: Column, record_type: Column, features: Column | None = None, terms: Column | None = None) -> Column:
    """One raw record inside its page."""
    none = F.array().cast(EMPTY)
    return F.struct(F.lit(kind).alias("kind"), at.cast("int").alias("at"), title.alias("title"), content.alias("content"), record_type.alias("record_type"),
        (none if features is None else features).alias("features"), (none if terms is None else terms).alias("terms_and_conditions"))


def exploded(df: DataFrame, every: Column, *page_columns: str) -> DataFrame:
    """One row for each record of the array, with the page's columns; pages without lines have none."""
    seen = df.filter(F.size("lines") > 0).select("page_id", F.col("url").alias("citation_url"), "description", "language", *page_columns, F.explode(every).alias("x"))
    rows = seen.select("page_id", "citation_url", "description", "language", *page_columns, "x.*")
    return rows.withColumns({"src_ord": F.struct("page_id", "at"), "normalized_title": key(F.col("title")),
        "short_summary": F.coalesce(F.nullif(F.col("description"), F.lit("")), F.substring("content", 1, 240)), "search_aliases": F.array("title")})


def initial_capitals(c: Column) -> Column:
    return F.initcap(F.replace(c, F.lit("_"), F.lit(" ")))


# --- Mobile -------------------------------------------------------------------------------------------------


def mobile_content(title: Column, body: Column, shown: Column, features: Column | None = None, terms: Column | None = None) -> Column:
    none = F.array().cast(EMPTY)
    return labelled(F.col("language") == "ar", ("plan", title), ("category", initial_capitals(F.col("mobile_category"))), ("description", F.col("description")),
        ("price", P.price_mobile(body)["text"]), ("quota", P.quota_mobile(body)["text"]), ("codes", F.array_join(P.ussd_codes(body), ", ")),
        ("benefits", none if features is None else features, 12), ("terms", none if terms is None else terms, 12), ("details", shown, 80))


def mobile(df: DataFrame) -> DataFrame:
    """Records of mobile pages: one for the page, if its category is known, and one for each table row and card.

    The page's language is expected to be the one that its address names, else English.
    """
    named = F.lower(F.regexp_extract("url", r"(?i)/(en|ar)(?:/|$)", 1))
    whole = F.array_join("lines", "\n")
    df = df.withColumns({"expected_language": F.when(named != "", named).otherwise("en"), "mobile_category": records.mobile_category(F.col("url"))})
    df = df.withColumn("language", language_expected(whole, F.col("expected_language")))
    category, useful = F.col("mobile_category"), useful_lines()
    benefits, terms = F.slice(useful, 1, 10), html.term_lines("mobile")
    page = record("page", F.lit(0), F.col("title"), mobile_content(F.col("title"), whole, useful, benefits, terms), records.mobile_type(category, F.col("title"), whole, F.lit(False)), benefits, terms)
    row = lambda r, i: record("row", i + 1000, r["first"], mobile_content(r["first"], r["row_text"], F.array(r["row_text"])), records.mobile_type(category, r["first"], r["row_text"], F.lit(True)))
    card = lambda c: record("card", c["card_no"] + 100000, c["title"], mobile_content(c["title"], c["text"], c["lines"]), records.mobile_type(category, c["title"], c["text"], F.lit(False)))
    pages = F.filter(F.array(page), lambda x: category != "unknown")
    return exploded(df, F.concat(pages, F.transform(html.row_structs("mobile"), row), F.transform(html.card_structs("mobile"), card)), "mobile_category", "expected_language")


# --- Business -----------------------------------------------------------------------------------------------


def business_mapping(url: Column) -> Column:
    """(category, heading) that the last part of a business address stands for."""
    pairs = [(slug, category) for category, slugs in L.BUSINESS_PAGES.items() for slug in slugs]
    pair = lambda x: F.struct(F.lit(x[0]).alias("category"), F.lit(x[1]).alias("heading"))
    known = F.create_map(*[v for slug, category in pairs for v in (F.lit(slug), pair(category))])
    return F.coalesce(known[F.lower(url_slug(url))], pair(L.BUSINESS_DEFAULT))


def business_features(shown: Column) -> Column:
    """Lines of some length that name no price."""
    return F.slice(unique(F.filter(shown, lambda x: (F.length(x) >= 15) & ~x.rlike(L.BUSINESS_PRICE))), 1, 30)


def business_content(title: Column, body: Column, shown: Column, features: Column | None = None, terms: Column | None = None) -> Column:
    none = F.array().cast(EMPTY)
    label = initial_capitals(F.replace(F.col("business_category"), F.lit("business_"), F.lit("")))
    return labelled(F.col("language") == "ar", ("service", title), ("category", label), ("description", F.col("description")),
        ("price", P.price_business(body)["text"]), ("allowance", P.quota_business(body)), ("features", none if features is None else features, 18),
        ("terms", none if terms is None else terms, 18), ("details", shown, 80))


def business(df: DataFrame) -> DataFrame:
    """Records of business pages: always one for the page, one for each table row and card."""
    mapped = business_mapping(F.col("url"))
    df = df.withColumns({"business_category": mapped["category"], "business_sub_parent": mapped["heading"]})
    whole, category, useful = F.array_join("lines", "\n"), F.col("business_category"), useful_lines()
    features, terms = business_features(useful), html.term_lines("business")
    page = record("page", F.lit(0), F.col("title"), business_content(F.col("title"), whole, useful, features, terms), records.business_type(category, F.col("title"), whole, F.lit(False)), features, terms)
    row = lambda r, i: record("row", i + 1000, r["first"], business_content(r["first"], r["row_text"], F.array(r["row_text"])), records.business_type(category, r["first"], r["row_text"], F.lit(True)))
    card = lambda c: record("card", c["card_no"] + 100000, c["title"], business_content(c["title"], c["text"], c["lines"], business_features(c["lines"])),
        records.business_type(category, c["title"], c["text"], F.lit(False)), business_features(c["lines"]))
    out = exploded(df, F.concat(F.array(page), F.transform(html.row_structs("business"), row), F.transform(html.card_structs("business"), card)), "business_category", "business_sub_parent")
    kind = F.col("record_type")
    return out.withColumns({"benefits": F.col("features"),
        "service_name": F.when(kind.isin("business_service", "business_solution", "business_connectivity_service"), F.col("title")),
        "plan_name": F.when(kind.isin("business_plan", "business_package", "business_voice_plan", "business_hosting_plan"), F.col("title"))})


# --- Corporate sections -------------------------------------------------------------------------------------


def first_of(c: Column, ladder: tuple, otherwise: str) -> Column:
    """The value of the first entry (words, value) any of whose words c contains."""
    return reduce(lambda rest, step: F.when(any_of(c, step[0]), step[1]).otherwise(rest), reversed(ladder), F.lit(otherwise))


def section_topic(section: Column, title: Column, url: Column) -> Column:
    low = F.lower(F.concat_ws(" ", title, url))
    return F.when(section == L.SUSTAINABILITY, first_of(low, L.SUSTAINABILITY_TOPICS, L.SUSTAINABILITY_TOPIC)).otherwise(first_of(low, L.ABOUT_TOPICS, L.ABOUT_TOPIC))


def section_type(section: Column, title: Column, body: Column, url: Column) -> Column:
    """The record type of a section page or card, from words in title, address and the text's first 1,200 characters."""
    low = F.lower(F.concat_ws(" ", title, F.substring(body, 1, 1200), url))
    has = lambda *words: any_of(low, words)
    report = low.rlike("report|تقرير")
    green = F.when(has("iso") & low.rlike("certificate|certification|شهادة"), "iso_certificate").when(has("esms"), "esms_policy").when(report & has("climate"),
        "climate_report").when(report, "sustainability_report").when(has("climate"), "climate_change_overview").when(has("quality"),
        "corporate_quality_overview").when(has("ftth", "project"), "project_overview").otherwise("sustainability_overview")
    about = F.when(has("board", "director", "عضو"), "board_member").when(has("management", "chief", "تنفيذي"), "management_member").when(has("museum"),
        "museum_overview").when(has("history") | body.rlike(L.DATE), "history_milestone").when(has("award"), "award").when(has("strategy"),
        "corporate_strategy").when(has("press"), "press_release").when(has("tv"), "tv_ad")
    about = about.when(has("career", "training"), "career_training_overview").when(has("contact") | body.rlike(L.EMAIL) | body.rlike(L.PHONE),
        "contact_information").when(has("mission", "vision"), "mission_vision").otherwise("about_overview")
    return F.when(section == L.SUSTAINABILITY, green).otherwise(about)


def link_list(label: str, links: Column) -> Column:
    body = F.array_join(F.transform(F.slice(links, 1, 20), lambda x: F.concat(F.lit("- "), x["text"], F.lit(": "), x["url"])), "\n")
    return F.when(filled(links), F.concat(F.lit(f"{label}:\n"), body))


def section(df: DataFrame, name: str) -> DataFrame:
    """Records of a corporate section's pages: one for the page; one for each person, special card, report and certificate."""
    whole, url = F.array_join("lines", "\n"), F.col("url")
    path = F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://[^/]*(/.*)$", 1)
    named = F.when(url.contains("/ar/") | path.startswith("/Corporate-Sustainability"), "ar").when(url.contains("/en/"), "en")
    df = df.withColumns({"language": F.coalesce(named, language_any(whole)), "section": F.lit(name), "section_name": initial_capitals(F.lit(name)),
        "topic": section_topic(F.lit(name), F.col("title"), url), "__links": html.download_structs()})
    of = lambda kind: F.filter("__links", lambda x: x["kind"] == kind)
    df = df.withColumns({"report_links": of("report"), "download_links": of("other"), "certificate_links": of("certificate"),
        "people": html.people_structs() if name == L.ABOUT else F.array().cast("array<struct<name:string,title:string>>"), "dates": P.dates(whole),
        "emails": P.emails(whole), "phones": P.phones(whole)})
    df = df.withColumn("doc_id", short_hash(F.concat_ws("|", F.col("section"), url_canonical(url, True)), 64))
    head = labelled(F.col("language") == "ar", ("section", F.col("section_name")), ("topic", F.col("topic")), ("title", F.col("title")), ("description", F.col("description")), ("details", useful_lines(), 140))
    content = F.concat_ws("\n", head, link_list("Report links", F.col("report_links")), link_list("Download links", F.col("download_links")), link_list("Certificate links", F.col("certificate_links")))
    page = record("page", F.lit(0), F.col("title"), content, section_type(F.lit(name), F.col("title"), whole, url))
    child = lambda title, body: F.trim(F.concat_ws("\n", F.concat(F.lit("Section: "), F.col("section_name")), F.concat(F.lit("Topic: "), F.col("topic")), F.concat(F.lit("Title: "), title), body))
    titled = lambda t: F.coalesce(F.nullif(t, F.lit("")), F.col("title"))
    person = lambda p, i: record("person", i + 1000, titled(p["name"]), child(titled(p["name"]), p["title"]), F.when(F.col("topic") == "Board of Directors", "board_member").otherwise("management_member"))
    card = lambda c: record("card", c["card_no"] + 100000, titled(c["title"]), child(titled(c["title"]), c["text"]), section_type(F.lit(name), c["title"], c["text"], url))
    special = F.filter(F.transform(html.card_structs("section"), card), lambda x: x["record_type"].isin(*L.SPECIAL_CARDS))
    link = lambda kind: lambda x, i: record("link", i + 10_000_000, titled(x["text"]), child(titled(x["text"]), x["url"]), F.lit(kind))
    filed = F.concat(F.transform("report_links", link("downloadable_report")), F.transform("certificate_links", link("iso_certificate")))
    own = ("section", "section_name", "topic", "doc_id", "report_links", "download_links", "certificate_links", "dates", "emails", "phones")
    rows = exploded(df, F.concat(F.array(page), F.transform("people", person), special, filed), *own)
    suffix = F.when(F.col("kind") == "person", "person").otherwise(F.col("record_type"))
    whole_id = joined_hash(F.col("doc_id"), F.col("title"), short_hash(F.col("content"), 16))
    rows = rows.withColumn("record_id", F.when(F.col("kind") == "page", whole_id).otherwise(joined_hash(F.col("doc_id"), suffix, F.col("title"), short_hash(F.col("content"), 16))))
    rows = rows.withColumn("search_aliases", F.array("title", "topic", "section_name"))
    return first_wins(rows, [F.col("page_id"), F.col("record_id")], ["at"])


# --- Public and generic pages -------------------------------------------------------------------------------


def public_type(url: Column, body: Column) -> Column:
    head = F.substring(body, 1, 2000)
    low = F.lower(F.concat_ws(" ", url, head))
    return F.when(body.rlike(L.USSD), "service_detail").when(body.rlike(L.BUSINESS_PRICE) | body.rlike(L.PUBLIC_QUOTA),
        "package_or_offer").when(any_of(low, ("faq", "question")) | head.contains("سؤال"), "faq").when(any_of(low, ("/branch", "store locator")),
        "branch_info").otherwise("public_page")


def public(df: DataFrame, least: int = 120) -> DataFrame:
    """One record for each public page whose content has at least so many characters, scored and with its codes and amounts."""
    df = df.filter(F.size("lines") > 0).withColumn("title", F.coalesce(F.nullif(F.col("title"), F.lit("")), F.lit(L.PUBLIC_UNTITLED)))
    url, shown = F.col("url"), F.slice(useful_lines(), 1, 120)
    content = F.trim(F.concat_ws("\n", F.concat(F.lit("Title: "), F.col("title")),
        F.when(F.col("description") != "", F.concat(F.lit("Description: "), F.col("description"))), F.lit("Details:"),
        F.when(filled(shown), F.array_join(shown, "\n"))))
    df = df.withColumn("content", content).filter(F.length("content") >= least)
    body, size = F.col("content"), F.length("content")
    found = lambda pattern: F.array_sort(F.array_distinct(P.matches(body, pattern)))
    facts = body.rlike(L.USSD) | body.rlike(L.BUSINESS_PRICE) | body.rlike(L.PUBLIC_QUOTA)
    score = F.lit(0.5) + records.points((url != "", 0.15), (F.col("title") != L.PUBLIC_UNTITLED, 0.15), (size >= 300, 0.1), (facts, 0.1))
    flags = records.flags(F.array(F.lit("public_site_scrape")), (size < 300, "short_content"), (F.col("description") == "", "missing_meta_description"))
    canonical = url_canonical(url, True)
    return df.select("page_id", url.alias("citation_url"), "title", "description", "content", language_public(body, url).alias("language"),
        first_of(F.lower(url), L.PUBLIC_CATEGORIES, L.PUBLIC_CATEGORY).alias("category"), public_type(url, body).alias("record_type"),
        found(L.USSD).alias("ussd_codes"), found(L.BUSINESS_PRICE).alias("prices"), found(L.PUBLIC_QUOTA).alias("quotas"),
        F.least(F.round(score, 3), F.lit(0.99)).alias("quality_score"), flags.alias("quality_flags"), F.lit(True).alias("is_accepted"),
        short_hash(canonical, 64).alias("doc_id"), short_hash(F.concat_ws("\n", canonical, "title", "content"), 64).alias("record_id"))


def generic(df: DataFrame, section_name: str) -> DataFrame:
    """One raw record for each page of a section without a parser of its own, and an error record for each page that failed."""
    url, raw = F.col("url"), F.array_join("lines", "\n")
    good = F.col("page.error").isNull() & (F.size("lines") > 0)
    rows = F.filter(F.col("page.rows"), lambda r: F.size(r["cells"]) > 0)
    made = {
        "category": F.lit(section_name), "record_type": F.lit("detail"), "content": F.when(good, raw).otherwise(""),
            "title": F.when(good, F.col("title")).otherwise(url), "features": F.when(good, F.slice("lines", 2, 24)).otherwise(F.array().cast(EMPTY)),
        "n_tables": F.size(F.array_distinct(F.transform(rows, lambda r: r["table_index"]))), "n_lists": F.size("page.lists"),
            "search_aliases": F.when(good, F.array("title")).otherwise(F.array().cast(EMPTY)), "language": F.when(good, F.col("language")),
        "quality_flags": F.when(good, F.array().cast(EMPTY)).otherwise(F.array(F.lit("extraction_failed"))), "error": F.col("page.error"),
        "doc_id": F.when(good, joined_hash(F.lit(section_name), url)).otherwise(joined_hash(F.lit("error"), url)),
            "record_id": F.when(good, joined_hash(F.lit(section_name), url, short_hash(raw, 16))).otherwise(joined_hash(F.lit("error"), url, F.col("page.error"))),
    }
    return df.filter(good | F.col("page.error").isNotNull()).select("page_id", url.alias("citation_url"), "description", *[c.alias(n) for n, c in made.items()])


def post_process_generic(rows: DataFrame) -> DataFrame:
    """Content cleaned, index text, flags, score and acceptance of generic records; error records stay rejected."""
    cleaned = F.array_join(P.unique_lines(F.col("content"), kind="generic"), "\n")
    score = records.points((F.col("title") != "", 0.2), (F.col("citation_url") != "", 0.15), (F.length("content") >= 120, 0.35),
        (filled(F.col("features")) | (text(F.col("description")) != "") | (F.col("n_tables") > 0) | (F.col("n_lists") > 0), 0.2),
        (filled(F.col("search_aliases")), 0.1))
    failed = F.col("error").isNotNull()
    df = rows.withColumn("__noise", ~failed & (cleaned != F.trim("content"))).withColumn("content", cleaned)
    index = F.concat_ws("\n", *[F.nullif(text(c), F.lit("")) for c in (F.col("title"), F.col("description"), F.col("content"), F.array_join("search_aliases", " "))])
    df = df.withColumns({"quality_score": F.when(failed, 0.0).otherwise(F.round(F.least(score, F.lit(1.0)), 2)),
        "index_text": F.when(failed, "").otherwise(index), "quality_flags": records.flags(F.col("quality_flags"), (F.col("__noise"), "ui_noise_removed"))})
    reason = F.when(failed, F.col("error")).when(F.col("quality_score") >= 0.45, "").otherwise("missing useful text")
    return df.withColumn("is_accepted", ~failed & (F.col("quality_score") >= 0.45)).withColumn("rejection_reason", reason).drop("__noise")
