"""Cleaning, fact extraction, aliases, ids and quality scores of scraped records."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions import parsing as P
from ..functions.text import any_of, joined_hash, key, key_adds_nothing, key_under, squeeze, text, unique, url_slug

ARRAY = "array<string>"


def with_defaults(df: DataFrame, schema: dict[str, str]) -> DataFrame:
    """Every column of schema, null (or an empty array) where df lacks it."""
    for name, kind in schema.items():
        if name not in df.columns:
            df = df.withColumn(name, (F.array() if kind == ARRAY else F.lit(None)).cast(kind))
    return df


RECORD = {
    "title": "string", "description": "string", "content": "string", "citation_url": "string", "language": "string", "expected_language": "string",
        "record_type": "string", "mobile_category": "string", "business_category": "string", "section": "string", "topic": "string", "plan_name": "string",
        "service_name": "string",
    "price": "string", "price_egp": "double", "monthly_fee": "string", "monthly_fee_egp": "double", "annual_fee_egp": "double",
        "installation_fee_egp": "double", "implementation_fee_egp": "double", "quota": "string", "quota_mb": "double", "quota_gb": "double", "validity": "string",
        "validity_days": "int", "units": "int", "minutes": "int", "sms": "int",
    "ussd_codes": ARRAY, "benefits": ARRAY, "features": ARRAY, "terms_and_conditions": ARRAY, "search_aliases": ARRAY, "quality_flags": ARRAY, "subscription_code": "string", "dial_code": "string",
}


def some(c: Column) -> Column:
    return F.when(text(c) != "", c)


def flags(existing: Column, *tests: tuple[Column, str]) -> Column:
    """The existing flags and those whose test holds, unique."""
    return unique(F.concat(F.coalesce(existing, F.array().cast(ARRAY)), F.filter(F.array(*[F.when(F.coalesce(c, F.lit(False)), name) for c, name in tests]), lambda x: x.isNotNull())))


def points(*tests: tuple[Column, float]) -> Column:
    """The sum of the values whose test holds."""
    return reduce(lambda a, b: a + b, [F.when(F.coalesce(c, F.lit(False)), F.lit(v)).otherwise(F.lit(0.0)) for c, v in tests])


def filled(c: Column) -> Column:
    return F.coalesce(F.size(c), F.lit(0)) > 0


def normalize_mobile(records: DataFrame) -> DataFrame:
    """Facts from title, description and content where the record has none; ids; score, flags, acceptance."""
    df = with_defaults(records, RECORD)
    df = df.withColumns({"title": squeeze(F.col("title")), "description": squeeze(F.col("description")), "content": F.array_join(P.unique_lines(F.col("content"), kind="navigation"), "\n")})
    body = F.concat_ws("\n", "title", "description", "content")
    df = df.withColumn("__p", P.price_mobile(body)).withColumn("__q", P.quota_mobile(body)).withColumn("__v", P.validity(body))
    df = df.withColumns({"record_type": F.coalesce(F.nullif(F.replace(key(F.col("record_type")), F.lit(" "), F.lit("_")), F.lit("")), F.lit("detail")), "mobile_category": F.replace(key(F.col("mobile_category")), F.lit(" "), F.lit("_")), "ussd_codes": unique(F.concat(F.coalesce("ussd_codes", F.array().cast(ARRAY)), P.ussd_codes(body))), "price": F.coalesce(some(F.col("price")), F.col("__p.text")), "price_egp": F.coalesce("price_egp", "__p.value"), "quota": F.coalesce(some(F.col("quota")), F.col("__q.text")), "quota_mb": F.coalesce("quota_mb", "__q.mb"), "quota_gb": F.coalesce("quota_gb", "__q.gb"), "validity": F.coalesce(some(F.col("validity")), F.col("__v.text")), "validity_days": F.coalesce("validity_days", "__v.days")}).drop("__p",
        "__q", "__v")
    plan = F.col("record_type").isin("plan", "package", "add_on")
    df = df.withColumns({"plan_name": F.coalesce(F.nullif(squeeze(F.col("plan_name")), F.lit("")), F.when(plan, F.col("title"))),
        "monthly_fee": F.coalesce(some(F.col("monthly_fee")), F.when(F.col("record_type") == "plan", F.col("price"))),
        "monthly_fee_egp": F.coalesce("monthly_fee_egp", F.when(F.col("record_type") == "plan", F.col("price_egp"))),
        "dial_code": F.coalesce(some(F.col("dial_code")), F.get("ussd_codes", F.lit(0))),
        "subscription_code": F.coalesce(some(F.col("subscription_code")), F.get("ussd_codes", F.lit(0))), "benefits": unique(F.col("benefits")),
        "terms_and_conditions": unique(F.col("terms_and_conditions"))})
    df = df.withColumn("features", unique(F.concat(F.coalesce("features", F.array().cast(ARRAY)), F.col("benefits")))).withColumn("search_aliases",
        unique(F.concat(F.array("title", "plan_name", "service_name"), F.coalesce("search_aliases", F.array().cast(ARRAY)))))
    df = df.withColumn("short_summary", F.coalesce(some(F.col("description")), F.substring("content", 1, 240))).withColumn("normalized_title", key(F.col("title")))
    return mobile_ids(score_mobile(df))


def mobile_ids(df: DataFrame) -> DataFrame:
    doc = joined_hash(F.col("language"), F.col("mobile_category"), F.col("record_type"), F.col("citation_url"), key(F.col("title")))
    return df.withColumn("doc_id", doc).withColumn("record_id", F.sha2(F.concat_ws("|", F.col("doc_id"), F.sha2(text(F.col("content")), 256)), 256))


def score_mobile(df: DataFrame) -> DataFrame:
    """quality_score, quality_flags, rejection_reason, is_accepted: from .45 points without a reason to reject."""
    size = F.length("content")
    known = F.col("record_type").isin(*L.MOBILE_TYPES)
    score = points((F.col("title") != "", 0.18), (some(F.col("citation_url")).isNotNull(), 0.12), (size >= 120, 0.28), (size.between(50, 119), 0.12),
        (F.col("price_egp").isNotNull(), 0.1), (F.col("quota_mb").isNotNull() | F.col("quota_gb").isNotNull(), 0.1), (filled(F.col("ussd_codes")), 0.12),
        (filled(F.col("benefits")) | filled(F.col("features")), 0.08), (filled(F.col("terms_and_conditions")), 0.08), (some(F.col("description")).isNotNull(), 0.06))
    fact = F.col("price_egp").isNotNull() | F.col("quota_mb").isNotNull() | filled(F.col("ussd_codes")) | filled(F.col("benefits")) | filled(F.col("terms_and_conditions")) | some(F.col("description")).isNotNull()
    lacking = (F.col("title") == "") | some(F.col("citation_url")).isNull() | ~fact
    reason = F.when(~F.col("mobile_category").isin(*L.MOBILE_CATEGORIES), "wrong category").when(lacking, "missing required useful fields").when(key_under(F.col("content"), 40), "empty or navigation-only content").otherwise("")
    df = df.withColumn("__s", score).withColumn("rejection_reason", reason).withColumn("is_accepted", (F.col("rejection_reason") == "") & (F.col("__s") >= 0.45))
    df = df.withColumn("quality_flags",
        flags(F.col("quality_flags"), (~F.col("mobile_category").isin(*L.MOBILE_CATEGORIES), "wrong_category"), (~known, "unknown_record_type"),
            (F.col("title") == "", "missing_title"), (some(F.col("citation_url")).isNull(), "missing_citation_url"), (size < 50, "thin_content"),
            (~F.col("is_accepted"), "rejected_low_quality")))
    return df.withColumn("record_type", F.when(known, F.col("record_type")).otherwise("detail")).withColumn("quality_score", F.round(F.least("__s", F.lit(1.0)), 2)).drop("__s")


def cleanup_mobile(records: DataFrame) -> DataFrame:
    """A second pass: noise out, codes and units normalised, misread quotas reset, content and index text rebuilt."""
    df = with_defaults(records, RECORD)
    before = F.concat_ws("\n", *[text(F.col(n)) for n in ("title", "plan_name", "service_name", "description", "content")])
    df = df.withColumn("original_content", F.col("content")).withColumn("__clean", P.without_noise(F.col("content"))).withColumn("__all", F.concat_ws("\n", before, "__clean"))
    noisy = F.col("__clean") != F.trim(text(F.col("content")))
    df = df.withColumn("__noisy", noisy).withColumn("description", P.without_noise(F.col("description")))
    slug = title_from_url()
    for name in ("title", "plan_name", "service_name"):
        df = df.withColumn(name, F.when((text(F.col(name)) != "") & P.is_noise(text(F.col(name))), slug).otherwise(F.col(name)))
    df = df.withColumn("__codes", P.mobile_codes(F.col("__all")))
    partial = F.exists("ussd_codes", lambda o: F.exists("__codes", lambda n: (o != n) & F.contains(n, o)))
    kix = (F.col("mobile_category") == "control_plans") & F.col("__all").rlike(r"(?i)\bkix\b|كيكس")
    df = df.withColumns({"__partial": partial, "kix_units": F.when(kix, P.kix_units(F.col("__all"), F.col("title"))), "consumption_rules": F.when(kix, P.consumption_rules(F.col("__all"))).otherwise(F.array().cast(ARRAY))})
    reset = kix & (text(F.col("quota")).rlike(r"(?i)\b1\s*MBs?\b|1\s*ميجا") | filled(F.col("consumption_rules")))
    had = F.coalesce(F.col("quota"), F.col("quota_mb").cast("string"), F.col("quota_gb").cast("string")).isNotNull()
    found = filled(F.col("__codes"))
    df = df.withColumn("quality_flags",
        flags(F.col("quality_flags"), (F.col("__noisy"), "ui_noise_removed"),
            (found & (F.col("__codes") != F.coalesce("ussd_codes", F.array().cast(ARRAY))), "subscription_code_normalized"),
            (found & F.col("__partial"), "partial_code_replaced"), (found, "subscription_code_extracted"), (F.col("kix_units").isNotNull(), "kix_units_extracted"),
            (filled(F.col("consumption_rules")), "consumption_rules_extracted"), (reset & had, "quota_from_consumption_rule_removed")))
    for name in ("quota", "quota_mb", "quota_gb"):
        df = df.withColumn(f"__{name}", F.when(~F.coalesce(reset, F.lit(False)), F.col(name)))
    df = df.drop("quota", "quota_mb", "quota_gb").withColumnsRenamed({"__quota": "quota", "__quota_mb": "quota_mb", "__quota_gb": "quota_gb"})
    df = df.withColumns({"ussd_codes": F.when(found, F.col("__codes")).otherwise(F.col("ussd_codes")),
        "subscription_code": F.when(found, F.get("__codes", F.lit(0))).otherwise(F.col("subscription_code")),
        "dial_code": F.when(found, F.get("__codes", F.lit(0))).otherwise(F.col("dial_code"))})
    df = df.withColumn("__name", mobile_name()).withColumn("__low", F.lower("__name")).withColumn("search_aliases", mobile_aliases(F.col("__name"), F.col("__low")))
    df = df.withColumn("content", rebuilt_content()).withColumn("index_text",
        F.concat_ws("\n", "title", "plan_name", "service_name", F.array_join("search_aliases", "\n"), "content", "subscription_code",
            F.array_join("ussd_codes", " "), "price", "monthly_fee", F.concat(F.col("kix_units").cast("string"), F.lit(" Kix"))))
    return mobile_ids(score_cleanup(df)).drop("__all", "__clean", "__noisy", "__codes", "__partial", "__name", "__low")


def title_from_url() -> Column:
    """The words of the address' last part, each with a capital; where it names nothing, the description's start."""
    slug = F.trim(F.translate(url_slug(F.col("citation_url")), "-_", "  "))
    words = F.transform(F.split(slug, " +"), lambda w: F.when(w.isin(*L.UPPER_SLUGS), F.upper(w)).otherwise(F.initcap(w)))
    stand_in = F.coalesce(F.nullif(F.substring(squeeze(F.col("description")), 1, 80), F.lit("")), F.lit("Mobile record"))
    return F.when((slug == "") | slug.isin(*L.EMPTY_SLUGS), stand_in).otherwise(F.array_join(words, " "))


def display_name() -> Column:
    """The first of plan, service and title that is no noise line, else what the address says."""
    names = [squeeze(F.col(n)) for n in ("plan_name", "service_name", "title")]
    return F.coalesce(*[F.when((n != "") & ~P.is_noise(n), n) for n in names], title_from_url())


def category_label(arabic: Column) -> Column:
    """A mobile category's name in the record's language; others as they are."""
    own = text(F.col("mobile_category"))
    return F.coalesce(*[F.when(own == k, F.when(arabic, ar).otherwise(en)) for k, (en, ar) in L.MOBILE_LABELS.items()], F.nullif(own, F.lit("")), F.lit("Mobile"))


def rebuilt_content() -> Column:
    """Labelled lines of what the record knows, in its language; absent fields leave no line, and noise lines go."""
    ar = F.coalesce(F.col("language") == "ar", F.lit(False))
    label = lambda a, e: F.when(ar, F.lit(a)).otherwise(F.lit(e))
    line = lambda a, e, v: F.when(text(v) != "", F.concat(label(a, e), F.lit(": "), v))
    items = lambda a, e, v: F.when(filled(v), F.concat(label(a, e), F.lit(":\n"), F.array_join(F.transform(v, lambda x: F.concat(F.lit("- "), x)), "\n")))
    name = display_name()
    held = unique(F.concat(F.array("subscription_code"), F.coalesce("ussd_codes", F.array().cast(ARRAY))))
    codes = F.array_join(held, ", ")
    kind = F.col("record_type").startswith("service")
    head = F.concat(F.when(ar, F.when(kind, "الخدمة").otherwise("الباقة")).otherwise(F.when(kind, "Service").otherwise("Plan")), F.lit(": "), name)
    return P.without_noise(F.concat_ws("\n", head, line("الفئة", "Category", category_label(ar)),
        line("السعر", "Price", F.coalesce(some(F.col("monthly_fee")), F.col("price"))),
        line("الوحدات", "Units", F.concat(F.format_number("kix_units", 0), F.lit(" Kix"))), line("السعة", "Quota", F.col("quota")),
        line("الصلاحية", "Validity", F.col("validity")), line("الأكواد", "Codes", codes), line("كود الاشتراك", "Subscription code", F.col("subscription_code")),
        line("الوصف", "Description", F.col("description")), items("المميزات", "Benefits", F.slice(unique(F.concat(F.col("benefits"), F.col("features"))), 1, 20)),
        items("قواعد الاستخدام", "Usage rules", F.col("consumption_rules")),
        items("الشروط والأحكام", "Terms and conditions", F.slice("terms_and_conditions", 1, 30))))


def score_cleanup(df: DataFrame) -> DataFrame:
    size, cited = F.length("content"), some(F.col("citation_url")).isNotNull()
    df, noise = df.withColumn("__n", F.exists(F.split("content", "\n"), lambda x: P.is_noise(x))), F.col("__n")
    issue = F.when(~cited, "no citation URL").when(key_under(F.col("content"), 50), "missing useful content").when(noise, "possible UI noise remaining").otherwise("")
    fact = F.col("price_egp").isNotNull() | F.col("monthly_fee_egp").isNotNull() | filled(F.col("ussd_codes")) | F.col("kix_units").isNotNull() | some(F.col("quota")).isNotNull() | filled(F.col("benefits")) | filled(F.col("terms_and_conditions"))
    score = F.lit(0.55) + points((cited, 0.1), (some(F.col("title")).isNotNull(), 0.1), (size >= 160, 0.08), (fact, 0.12), (~noise, 0.05), (F.col("possible_issue") != "", -0.08))
    df = df.withColumn("possible_issue", issue)
    bad = (F.col("possible_issue") != "") & (size < 100)
    return df.withColumns({"quality_score": F.round(F.greatest(F.lit(0.0), F.least(score, F.lit(0.98))), 2),
        "rejection_reason": F.when(bad, F.col("possible_issue")).otherwise(""), "is_accepted": ~bad,
        "quality_flags": flags(F.col("quality_flags"), (~cited, "no_citation_url"),
            (~F.col("language").eqNullSafe(F.col("expected_language")), "language_mismatch"), (noise, "possible_ui_noise_remaining"),
            (F.exists("ussd_codes", lambda c: c.rlike(r"^[#*][0-9]{2,3}$")), "possible_partial_code"), (bad, "rejected_low_quality"))}).drop("__n")


def business_aliases(title_key: Column) -> Column:
    """Title and names, what the title's words stand for, the category's name, and the record's own aliases; 30 at most."""
    extra = F.flatten(F.array(*[F.when(any_of(title_key, words), F.array(*map(F.lit, more))).otherwise(F.array().cast(ARRAY)) for words, more in L.BUSINESS_ALIASES]))
    category = F.replace(F.replace(F.col("business_category"), F.lit("business_"), F.lit("")), F.lit("_"), F.lit(" "))
    return F.slice(unique(F.concat(F.array("title", "service_name", "plan_name"), extra, F.array(category), F.coalesce("search_aliases", F.array().cast(ARRAY)))), 1, 30)


def mobile_name() -> Column:
    """The first of title, plan and service name that is no noise line."""
    return F.coalesce(*[F.when((text(F.col(n)) != "") & ~P.is_noise(text(F.col(n))), F.col(n)) for n in ("title", "plan_name", "service_name")], F.lit(""))


def mobile_aliases(name: Column, low: Column) -> Column:
    """The record's names, what its name's words (low: in lower case) stand for, and its own aliases; 20 at most."""
    extra = []
    for words, number, more in L.MOBILE_ALIASES:
        suffix = F.coalesce(F.concat(F.lit(" "), P.found(name, number, 1)), F.lit("")) if number else F.lit("")
        extra.append(F.when(low.contains(words), F.array(*[F.replace(F.lit(x), F.lit("{}"), suffix) for x in more])).otherwise(F.array().cast(ARRAY)))
    return F.slice(unique(F.concat(F.array(name, "title", "plan_name", "service_name"), F.flatten(F.array(*extra)), F.coalesce("search_aliases", F.array().cast(ARRAY)))), 1, 20)


def normalize_business(records: DataFrame, categories: tuple[str, ...] = ()) -> DataFrame:
    """As for mobile records, with thousands commas, allowances and the four fees; accepted unless there is a reason."""
    df = with_defaults(records, RECORD)
    cleaned = F.array_join(P.unique_lines(F.col("content"), kind="business"), "\n")
    df = df.withColumns({"title": squeeze(F.col("title")), "description": squeeze(F.col("description")), "__noise": cleaned != text(F.col("content")),
        "content": cleaned, "record_type": F.coalesce(F.nullif(F.replace(key(F.col("record_type")), F.lit(" "), F.lit("_")), F.lit("")), F.lit("detail")),
        "business_category": F.coalesce(F.nullif(F.replace(key(F.col("business_category")), F.lit(" "), F.lit("_")), F.lit("")), F.lit("business"))})
    body = F.concat_ws("\n", "title", "description", "content")
    df = df.withColumn("__p", P.price_business(body)).withColumns({"price": F.coalesce(some(F.col("price")), F.col("__p.text")), "price_egp": F.coalesce("price_egp", "__p.value")}).drop("__p")
    fee = lambda n, pattern: F.coalesce(F.col(n), P.fee_if(body, pattern, F.col("price_egp")))
    df = df.withColumns({"monthly_fee_egp": fee("monthly_fee_egp", "month|شهر"), "annual_fee_egp": fee("annual_fee_egp", "annual|year|سنو"),
        "installation_fee_egp": fee("installation_fee_egp", "install|تركيب"), "implementation_fee_egp": fee("implementation_fee_egp", "implementation|setup"),
        "quota": F.coalesce(some(F.col("quota")), P.quota_business(body)), "units": F.coalesce("units", P.allowance(body, "units?")),
        "minutes": F.coalesce("minutes", P.allowance(body, "minutes?")), "sms": F.coalesce("sms", P.allowance(body, "SMS"))})
    # Within `unique` nothing is worked out once for several uses, so what the aliases compare is a column.
    df, k = df.withColumn("__k", key(F.col("title"))), F.col("__k")
    df = df.withColumn("search_aliases", business_aliases(k))
    df = df.withColumn("index_text",
        F.concat_ws("\n", some(F.col("title")), some(F.col("service_name")), some(F.col("plan_name")), F.array_join("search_aliases", "\n"), "price", "quota",
            F.col("units").cast("string"), F.col("minutes").cast("string"), F.col("sms").cast("string"), "content"))
    size, useful = F.length("content"), some(F.col("price")).isNotNull() | F.col("price_egp").isNotNull() | some(F.col("quota")).isNotNull() | F.coalesce("units",
        "minutes",
        "sms").isNotNull() | filled(F.col("features")) | filled(F.col("benefits")) | filled(F.col("terms_and_conditions")) | some(F.col("description")).isNotNull()
    score = points((F.col("title") != "", 0.18), (some(F.col("citation_url")).isNotNull(), 0.12), (size >= 160, 0.28), (size.between(70, 159), 0.14), (useful, 0.24), (filled(F.col("search_aliases")), 0.05))
    wrong = ~F.col("business_category").isin(*categories) if categories else F.lit(False)
    empty = key_adds_nothing(F.col("content"), F.col("title"))
    reason = F.when(wrong, "wrong category").when(~F.coalesce(useful, F.lit(False)), "missing useful text").when(empty, "empty or navigation-only content").otherwise("")
    df = df.withColumn("__s", score).withColumn("__r", reason).withColumn("rejection_reason", F.when((F.col("__r") == "") & (F.col("__s") >= 0.45), "").otherwise(F.col("__r"))).withColumn("is_accepted", F.col("rejection_reason") == "")
    df = df.withColumn("quality_flags",
        flags(F.col("quality_flags"), (F.col("__noise"), "ui_noise_removed"), (wrong, "wrong_category"), (F.col("title") == "", "missing_title"),
            (some(F.col("citation_url")).isNull(), "missing_citation_url"), (size < 70, "thin_content"), (F.col("__r") == "missing useful text", "missing_useful_fact"),
            ((F.col("__r") != "") | (F.col("__s") < 0.45), "rejected_low_quality")))
    doc = joined_hash(F.col("business_category"), F.col("record_type"), F.col("citation_url"), k)
    return df.withColumn("quality_score", F.round(F.least("__s", F.lit(1.0)), 2)).withColumn("doc_id", doc).withColumn("record_id", F.sha2(F.concat_ws("|", "doc_id", F.sha2("content", 256)), 256)).drop("__s", "__r", "__k", "__noise")


def normalize_section(records: DataFrame, least: int = 80) -> DataFrame:
    """Section pages: a score of 1 less what is missing."""
    df = with_defaults(records, RECORD | {"people": ARRAY, "dates": ARRAY, "report_links": ARRAY, "download_links": ARRAY, "certificate_links": ARRAY})
    cleaned = F.array_join(P.unique_lines(F.col("content"), kind=""), "\n")
    df = df.withColumns({"title": squeeze(F.col("title")), "description": squeeze(F.col("description")), "__noise": cleaned != text(F.col("content")),
        "content": cleaned, "dates": F.when(filled(F.col("dates")), F.col("dates")).otherwise(P.dates(F.col("content")))})
    df = df.withColumn("search_aliases", unique(F.concat(F.array("title", "section", "topic"), F.coalesce("search_aliases", F.array().cast(ARRAY)))))
    df = df.withColumn("index_text", F.concat_ws("\n", *[some(F.col(n)) for n in ("title", "section", "topic", "record_type")], F.array_join("search_aliases", " "), F.array_join("dates", " "), F.array_join("people", " "), "content"))
    cited, size = some(F.col("citation_url")).isNotNull(), F.length("content")
    df, nav = df.withColumn("__nav", key_adds_nothing(F.col("content"), F.col("title"))), F.col("__nav")
    tongue = some(F.col("language")).isNull()
    score = F.lit(1.0) + points((~cited, -0.35), (F.col("title") == "", -0.2), (size < least, -0.35), (tongue, -0.1), (nav, -0.35))
    reason = F.when(~cited, "missing citation_url").when(size < least, "short content").when(nav, "navigation-only content").otherwise("")
    df = df.withColumn("__s", score).withColumn("rejection_reason", reason).withColumn("is_accepted", F.col("rejection_reason") == "")
    df = df.withColumn("quality_flags",
        flags(F.col("quality_flags"), (F.col("__noise"), "ui_noise_removed"), (~cited, "missing_citation"), (F.col("title") == "", "missing_title"),
            (size < least, "short_content"), (tongue, "language_missing"), (F.col("language") == "ar", "arabic_detected"), (F.col("language") == "en", "english_detected"),
            (F.col("language") == "mixed", "mixed_language"), (filled(F.col("report_links")), "report_links_found"),
            (filled(F.col("download_links")) | filled(F.col("certificate_links")), "download_links_found"), (filled(F.col("people")), "people_cards_found"),
            (filled(F.col("dates")), "timeline_found"), (nav, "navigation_noise_detected"),
            ((F.col("__s") < 0.45) | (F.col("rejection_reason") != ""), "rejected_low_quality")))
    doc = joined_hash(F.col("section"), F.col("citation_url"), F.col("topic"))
    return df.withColumn("quality_score", F.round(F.greatest(F.lit(0.0), F.least("__s", F.lit(1.0))), 2)).withColumn("doc_id", doc).withColumn("record_id",
        joined_hash(F.col("doc_id"), F.col("record_type"), F.col("title"), F.sha2("content", 256))).drop("__s", "__noise", "__nav")


def score_public(title: Column, description: Column, content: Column, details: Column) -> Column:
    """Public pages: .5 and what they have, .99 at most."""
    return F.least(F.lit(0.5) + points((text(title) != "", 0.15), (F.length(text(content)) >= 500, 0.15), (text(description) != "", 0.1), (details, 0.1)), F.lit(0.99))


def score_generic(title: Column, url: Column, content: Column, language: Column, facts: Column) -> Column:
    return F.round(points((text(title) != "", 0.2), (text(url) != "", 0.15), (F.length(text(content)) >= 120, 0.35), (language.isNotNull(), 0.2), (facts, 0.1)), 2)


def business_type(category: Column, title: Column, body: Column, table_row: Column) -> Column:
    """The record type a business category implies."""
    low, priced = F.lower(F.concat_ws(" ", title, body)), body.rlike(L.BUSINESS_PRICE)
    plan = table_row | priced
    return F.when(category.contains("hosting"), F.when(plan, "business_hosting_plan").otherwise("business_service")).when(category.contains("voice"),
        F.when(table_row | low.contains("plan"), "business_voice_plan").otherwise("business_service")).when(category.contains("connectivity"),
        "business_connectivity_service").when(category.contains("mobile"),
        F.when(plan, "business_plan").when(low.rlike("m2m|fleet|smart"), "business_solution").otherwise("business_service")).when(category.contains("digital"),
        F.when(plan, "business_package").otherwise("business_solution")).when(category.contains("wholesale"), "business_service").otherwise("detail")


def mobile_type(category: Column, title: Column, body: Column, table_row: Column) -> Column:
    """The record type of a mobile page, row or card."""
    low, priced = F.lower(F.concat_ws(" ", title, body)), table_row | body.rlike(L.MOBILE_PRICE)
    return (
        F.when(any_of(low, ("terms", "conditions", "rules", "الشروط")), "terms")
        .when(category == "value_added_services", F.when(body.rlike(L.USSD), "service_code").otherwise("service_detail"))
        .when(any_of(low, ("benefit", "مميزات")), "benefit")
        .when(category == "mobile_internet", F.when(priced, "package").otherwise("detail"))
        .when(category.isin("control_plans", "postpaid"), "plan")
        .when(category == "prepaid", F.when(priced, "package").otherwise("plan"))
        .otherwise("detail")
    )


def mobile_category(url: Column) -> Column:
    """From the address' words."""
    u = F.lower(text(url))
    return (
        F.when(u.contains("mobile-call-services"), "value_added_services")
        .when(any_of(u, ("nitro", "mifi")), "mobile_internet")
        .when(any_of(u, ("we-gold", "postpaid")), "postpaid")
        .when(any_of(u, ("control", "super-kix", "tazbeet", "we-club")), "control_plans")
        .when(any_of(u, ("prepaid", "12pt", "agda3")), "prepaid")
        .otherwise("unknown")
    )
