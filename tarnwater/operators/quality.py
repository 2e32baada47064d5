"""Quality reports: issues, flags, distributions and totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import text

#: Titles that are navigation, not content.  Fixed values.
NAVIGATION_TITLES = ("home", "personal", "business", "contact us", "login", "my account", "search", "back to top")
LANGUAGES = ("", "en", "ar", "mixed", "unknown")


def occurrences(c: Column, word: str) -> Column:
    return ((F.length(c) - F.length(F.replace(c, F.lit(word), F.lit("")))) / len(word)).cast("int")


def issues(title: Column, content: Column, citation: Column, language: Column, malformed: Column | None = None) -> Column:
    """The names of a record's issues, in order; a malformed row has that one alone."""
    t, c = F.trim(text(title)), F.trim(text(content))
    low = F.lower(text(content))
    tests = [(t == "", "missing_title"), (F.lower(t).isin(*NAVIGATION_TITLES), "navigation_title"), (c == "", "missing_content"),
        ((c != "") & (F.length(c) < 80), "short_content"), (F.trim(text(citation)) == "", "missing_citation_url"),
        (~text(language).isin(*LANGUAGES), "unexpected_language"),
        ((occurrences(low, "login") > 3) | (occurrences(low, "my account") > 3), "possible_navigation_noise")]
    found = F.filter(F.array(*[F.when(test, name) for test, name in tests]), lambda x: x.isNotNull())
    return found if malformed is None else F.when(malformed, F.array(F.lit("malformed_json"))).otherwise(found)


def issue_counts(rows: DataFrame, by: str, issues_column: str = "issues") -> DataFrame:
    """(by, issue, n): each group's counts, and totals where by is null."""
    return rows.select(by, F.explode(issues_column).alias("issue")).groupingSets([[by, "issue"], ["issue"]], by, "issue").agg(F.count(F.lit(1)).alias("n"))


def count_by(rows: DataFrame, column: str) -> DataFrame:
    return rows.groupBy(F.coalesce(F.col(column).cast("string"), F.lit("unknown")).alias(column)).agg(F.count(F.lit(1)).alias("n"))


def top_flags(rows: DataFrame, n: int = 20, column: str = "quality_flags") -> DataFrame:
    """(flag, n, rank): the most frequent flags; ties by name."""
    counted = rows.select(F.explode(column).alias("flag")).groupBy("flag").agg(F.count(F.lit(1)).alias("n"))
    return counted.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), "flag"))).filter(F.col("rank") <= n)


def summary(rows: DataFrame, missing: tuple[str, ...] = ("price_egp", "quota", "ussd_codes")) -> DataFrame:
    """One row: totals, acceptance, mean score (0 without rows), records that lack each of the fields."""
    lacking = [F.count_if(F.col(c).isNull() | F.col(c).cast("string").isin("", "[]")).alias(f"missing_{c}") for c in missing]
    return rows.agg(F.count(F.lit(1)).alias("records"), F.count_if("is_accepted").alias("accepted"), F.count_if(~F.col("is_accepted")).alias("rejected"),
        F.coalesce(F.round(F.avg("quality_score"), 3), F.lit(0.0)).alias("average_score"), F.count_if(F.length("content") < 80).alias("short_content"), *lacking)


def report(rows: DataFrame, columns: list[str]) -> DataFrame:
    """A flat report: arrays as text joined by semicolons, nulls as empty text."""
    kinds = dict(rows.dtypes)
    return rows.select(*[(F.array_join(c, ";") if kinds[c].startswith("array") else text(F.col(c))).alias(c) for c in columns])


def cleanup_summary(rows: DataFrame) -> DataFrame:
    """What the cleanup pass did: one count for each of its flags, and records with an issue left."""
    names = ("ui_noise_removed", "kix_units_extracted", "partial_code_replaced", "quota_from_consumption_rule_removed")
    return rows.agg(F.count(F.lit(1)).alias("records"), F.count_if("is_accepted").alias("accepted"),
        *[F.count_if(F.array_contains("quality_flags", n)).alias(n) for n in names], F.count_if(text(F.col("possible_issue")) != "").alias("possible_issues"))


#: What a section's summary counts: its category column, the most frequent flags shown, and what records may lack.
SECTIONS = {
    "mobile": ("mobile_category", 20, {"price": ("price", "price_egp"), "quota": ("quota", "quota_mb", "quota_gb"), "code": ("ussd_codes",)}, ("language", "mobile_category", "record_type")),
    "business": ("business_category", 30, {"price": ("price", "price_egp"), "quota": ("quota", "quota_mb", "quota_gb"), "terms": ("terms_and_conditions",)}, ("business_category", "record_type")),
    "public": ("category", 0, {}, ("category", "record_type", "language")),
}


def section_summary(rows: DataFrame, kind: str, pages_fetched: int | None = None, failed_urls: int | None = None) -> DataFrame:
    """(part, name, n) of a section's records: part total (records, accepted, rejected, pages), missing (price, quota, codes or terms),
    flag (the most frequent ones; ties by name), and a part for each distribution, whose null is the name 'unknown'.

    A field is missing if none of its columns holds a value; columns that the records do not have hold none.  Public records are all
    accepted.  Counts combine on the map side; a section without records has totals of zero and nothing else.
    """
    _, most, lacks, spread = SECTIONS[kind]
    have = set(rows.columns)
    holds = lambda c: F.col(c).isNotNull() & ~F.col(c).cast("string").isin("", "[]", "{}")

    def without(columns: tuple[str, ...]) -> Column:
        found = [holds(c) for c in columns if c in have]
        some = F.lit(False)
        for f in found:
            some = some | f
        return ~some

    accepted = F.lit(True) if kind == "public" else F.coalesce(F.col("is_accepted"), F.lit(False))
    counts = {("total", "records"): F.count(F.lit(1)), ("total", "accepted"): F.count_if(accepted), ("total", "rejected"): F.count_if(~accepted)}
    counts |= {("total", k): F.lit(v).cast("long") for k, v in (("pages_fetched", pages_fetched), ("failed_urls", failed_urls)) if v is not None}
    counts |= {("missing", k): F.count_if(without(c)) for k, c in lacks.items()}
    one = rows.agg(F.array(*[F.struct(F.lit(part).alias("part"), F.lit(name).alias("name"), c.cast("long").alias("n")) for (part, name), c in counts.items()]).alias("all"))
    out = one.select(F.explode("all").alias("x")).select("x.*")
    sets = rows.select(*[F.coalesce(F.col(c).cast("string"), F.lit("unknown")).alias(c) for c in spread])
    each = sets.groupingSets([[c] for c in spread], *spread).agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("g"))
    full = (1 << len(spread)) - 1
    part = F.coalesce(*[F.when(F.col("g") == full - (1 << (len(spread) - 1 - i)), c) for i, c in enumerate(spread)])
    out = out.unionByName(each.select(part.alias("part"), F.coalesce(*spread).alias("name"), "n").filter("name IS NOT NULL"))
    if most and "quality_flags" in have:
        out = out.unionByName(top_flags(rows, most).select(F.lit("flag").alias("part"), F.col("flag").alias("name"), "n"))
    return out
