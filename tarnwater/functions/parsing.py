"""Domain values out of text: codes, prices, quotas, validity, contacts.  All are Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicon as L
from .text import bound, key, lines, squeeze, text, unique, unique_keyed

EMPTY = "array<string>"


def matches(c: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text(c), F.lit(pattern), F.lit(group))


def found(c: Column, pattern: str, group: int = 0) -> Column:
    """The first match, null if there is none."""
    return F.when(text(c).rlike(pattern), F.regexp_extract(text(c), pattern, group))


def ascii_digits(c: Column) -> Column:
    """Arabic-Indic and Persian digits as ASCII ones, which casts read."""
    return F.translate(c, "٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹", "01234567890123456789")


def ussd_codes(c: Column) -> Column:
    """Star and hash codes, first seen first."""
    return F.array_distinct(matches(c, L.USSD))


def mobile_codes(c: Column) -> Column:
    """Codes of two digits or more; a code inside a longer one goes; shortest first."""
    codes = F.filter(F.array_distinct(matches(c, L.MOBILE_CODE)), lambda x: F.length(F.regexp_replace(x, "[^0-9]", "")) >= 2)
    ranked = F.transform(F.array_sort(F.transform(codes, lambda x, i: F.struct((-F.length(x)).alias("n"), i.alias("i"), x.alias("x")))), lambda s: s["x"])
    kept = F.aggregate(ranked, F.array().cast(EMPTY), lambda acc, x: F.when(F.exists(acc, lambda y: (y != x) & F.contains(y, x)), acc).otherwise(F.array_append(acc, x)))
    return F.reverse(kept)


def source_codes(c: Column) -> Column:
    """Codes that end in a hash, without white space, distinct and sorted."""
    return F.array_sort(F.array_distinct(F.filter(F.transform(matches(c, L.SOURCE_CODE), lambda x: F.regexp_replace(x, r"\s+", "")), lambda x: x.endswith("#"))))


def value_signature(c: Column) -> Column:
    """Codes, then amounts with a unit."""
    return F.concat(source_codes(c), matches(c, L.VALUE))


def _amount(number: Column, unit: Column) -> Column:
    value = ascii_digits(number).try_cast("double")
    return F.when(F.lower(unit).isin(*L.SUBUNITS), F.round(value / 100, 3)).otherwise(value)


def price_mobile(c: Column) -> Column:
    """(text, value) of the first price; a comma is a decimal point; piastres count in hundredths."""
    return F.struct(found(c, L.MOBILE_PRICE).alias("text"), _amount(F.translate(found(c, L.MOBILE_PRICE, 1), ",", "."), found(c, L.MOBILE_PRICE, 2)).alias("value"))


def price_business(c: Column) -> Column:
    """(text, value) of the first price; commas part thousands."""
    return F.struct(found(c, L.BUSINESS_PRICE).alias("text"), _amount(F.translate(found(c, L.BUSINESS_PRICE, 1), ",", ""), found(c, L.BUSINESS_PRICE, 2)).alias("value"))


def prices_business(c: Column) -> Column:
    return unique(matches(c, L.BUSINESS_PRICE))


def quota_mobile(c: Column) -> Column:
    """(text, mb, gb) of the first data quota."""
    value, unit = ascii_digits(F.translate(found(c, L.MOBILE_QUOTA, 1), ",", ".")).try_cast("double"), F.lower(found(c, L.MOBILE_QUOTA, 2))
    giga = unit.isin(*L.GIGABYTES)
    return F.struct(found(c, L.MOBILE_QUOTA).alias("text"), F.when(giga, F.round(value * 1024, 3)).otherwise(value).alias("mb"), F.when(giga, value).otherwise(F.round(value / 1024, 3)).alias("gb"))


def quota_business(c: Column) -> Column:
    return found(c, L.BUSINESS_QUOTA)


def validity(c: Column) -> Column:
    """(text, days): days as written, else monthly 30, weekly 7, 24 hours 1."""
    t = F.lower(text(c))
    has = lambda *terms: t.rlike("|".join(terms))
    days = found(t, L.VALID_DAYS)
    label = F.coalesce(days, F.when(has("month", "شهر"), "monthly").when(has("week", "أسبوع", "اسبوع"), "weekly").when(has("24 hours", "24 ساعة"), "24 hours"))
    number = F.coalesce(ascii_digits(found(t, L.VALID_DAYS, 1)).try_cast("int"), F.when(label == "monthly", 30).when(label == "weekly", 7).when(label == "24 hours", 1))
    return F.struct(label.alias("text"), number.alias("days"))


def allowance(c: Column, unit: str) -> Column:
    """Whole number before a unit such as units?, minutes? or SMS."""
    return ascii_digits(F.translate(found(c, rf"(?i)(\p{{Nd}}[\p{{Nd}},]*)\s*{unit}", 1), ",", "")).try_cast("int")


def fee_if(c: Column, pattern: str, price: Column) -> Column:
    """The price where the text names that kind of fee."""
    return F.when(F.lower(text(c)).rlike(pattern), price)


def kix_units(c: Column, title: Column) -> Column:
    """The first unit count of 100 or more, after the title's own mention when it names its price."""
    t, number = F.lower(text(c)), found(title, r"(?i)super\s*kix\s*([0-9]+)", 1)
    at = F.instr(t, F.concat(F.lit("super kix "), number))
    rest = F.when(F.coalesce(at, F.lit(0)) > 0, F.substring(text(c), at, F.length(text(c)))).otherwise(text(c))
    first = lambda x: F.get(F.filter(F.transform(matches(x, L.KIX_UNITS, 1), lambda v: ascii_digits(F.translate(v, ",", "")).cast("int")), lambda v: v >= 100), F.lit(0))
    return F.coalesce(first(rest), first(c))


def consumption_rules(c: Column) -> Column:
    return unique(F.filter(F.transform(lines(c), lambda x: F.regexp_replace(squeeze(x), "^[-* ]+", "")), lambda x: x.rlike(L.CONSUMPTION)))


def emails(c: Column) -> Column:
    return F.array_sort(F.array_distinct(matches(c, L.EMAIL)))


def phones(c: Column) -> Column:
    return F.array_sort(F.array_distinct(F.transform(matches(c, L.PHONE), squeeze)))


def dates(c: Column) -> Column:
    return F.array_sort(F.array_distinct(matches(c, L.DATE)))


# --- Lines ---------------------------------------------------------------------------------------------------


def _keys(phrases: tuple[str, ...]) -> list[str]:
    """The phrases as `key` makes them, for comparison with keys of lines."""
    return [" ".join("".join(ch if ch.isascii() and ch.isalnum() or "؀" <= ch <= "ۿ" else " " for ch in p.lower()).split()) for p in phrases]


def is_noise(line: Column, kind: str = "cleanup", k: Column | None = None) -> Column:
    """Whether a line is navigation.  kind: of pages mobile, business, section, public or generic; of content cleanup.  k: its key, if known."""
    if kind in ("mobile", "public"):
        low = F.lower(F.trim(line))
        listed = low.isin("", *(L.MOBILE_NOISE if kind == "mobile" else L.PUBLIC_NOISE)) | ((F.length(low) <= 2) & ~low.rlike(r"^\p{Nd}+$"))
        return listed | low.startswith(L.MOBILE_NOISE_STARTS[0]) | low.startswith(L.MOBILE_NOISE_STARTS[1]) if kind == "mobile" else listed
    phrases = {"business": L.BUSINESS_NOISE, "section": L.SECTION_NOISE, "generic": L.GENERIC_NOISE, "cleanup": L.NOISE_PHRASES, "navigation": L.NAVIGATION_HINTS, "": ()}[kind]
    listed = lambda k: k.isin("", *_keys(phrases))
    if kind in ("business", "section"):
        both = lambda k: listed(k) | ((F.length(k) <= 2) & ~k.rlike(r"\p{Nd}"))
        return bound(key(line), both) if k is None else both(k)
    return listed(key(line) if k is None else k)


def kept_lines(c: Column, kind: str = "cleanup") -> Column:
    """Lines squeezed, blanks and noise dropped, as array<struct<x, k>> with their keys, which are made once for each."""
    keyed = F.transform(F.filter(F.transform(lines(c), squeeze), lambda x: x != ""), lambda x: F.struct(x.alias("x"), key(x).alias("k")))
    return F.filter(keyed, lambda e: ~is_noise(e["x"], kind, e["k"]))


def without_noise(c: Column) -> Column:
    """Lines squeezed; blanks, noise and a line equal to the one before it (by key) dropped."""
    # A line that is dropped has the key of the one before it, so that the neighbour's key decides as the last kept one's would.
    fresh = lambda es: F.filter(es, lambda e, i: (e["k"] == "") | ~e["k"].eqNullSafe(F.get(es, i - 1)["k"]))
    return F.array_join(bound(kept_lines(c), lambda es: F.transform(fresh(es), lambda e: e["x"])), "\n")


def unique_lines(c: Column, most: int = 1 << 20, kind: str = "cleanup") -> Column:
    """Lines squeezed, noise dropped, the first of each key kept, at most `most`."""
    return F.slice(unique_keyed(kept_lines(c, kind)), 1, most)
