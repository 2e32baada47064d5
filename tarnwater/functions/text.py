"""Text functions as Catalyst expressions: each takes columns and returns a column.

Emptiness: null, "" and empty arrays are absent, 0 and false are present (`present`); `truthy` also
counts 0 and false as absent.  Classes in patterns are spelled out, since \\w and \\s differ between regex engines.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicon as L

SPACE = r"[\s\x0b\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
LINE_END = r"\r\n|[\n\r\x0b\x0c\x{1c}-\x{1e}\x{85}\x{2028}\x{2029}]"
#: What Spark's expressions use for the two above.  Java tests the members of a class one by one, so printable ASCII, most of any
#: text, is ruled out by a first range; a single plain space stays as it is, and no second alternative is tried at each character.
BLANK = rf"[[^!-~]&&{SPACE}]"
TO_SQUEEZE = rf"{BLANK}(?:(?<! )|{BLANK}){BLANK}*+"
LINE_SPLIT = r"[[^ -~]&&[\n\r\x0b\x0c\x{1c}-\x{1e}\x{85}\x{2028}\x{2029}]](?:(?<=\r)\n)?+"
#: In a key most characters are letters: they are ruled out first.
NO_KEY = r"[[^a-z]&&[^0-9\x{600}-\x{6ff}]]"
TO_KEY = rf"{NO_KEY}(?:(?<! )|{NO_KEY}){NO_KEY}*+"
ARABIC = r"[\x{600}-\x{6ff}]"
WORD_CHARS = r"[\p{L}\p{N}_\x{600}-\x{6ff}]"
SPARSE_TOKEN = r"\*[\p{L}\p{N}_*#]+#?|\p{Nd}[\p{Nd},]*(?:\.\p{Nd}+)?|[\p{L}\p{N}_\x{600}-\x{6ff}]+"
APPROX_TOKEN = r"[\p{L}\p{N}_\x{600}-\x{6ff}]+|[*#][\p{L}\p{N}_*#]+|[\p{L}\p{N}_*]+#"


def text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def present(c: Column) -> Column:
    """Null for empty strings, the value otherwise."""
    return F.when(c.cast("string") != "", c)


def truthy(c: Column) -> Column:
    """Null for empty strings, zeros and false."""
    return F.when(~c.cast("string").isin("", "0", "0.0", "false"), c)


def first_present(*columns: Column) -> Column:
    """The first value that is not blank."""
    return F.coalesce(*[F.when(squeeze(c) != "", c) for c in columns], F.lit(None).cast("string"))


def squeeze(c: Column) -> Column:
    """Runs of white space to one space, none at the ends."""
    return F.trim(F.regexp_replace(text(c), TO_SQUEEZE, " "))


def lines(c: Column) -> Column:
    return F.split(text(c), LINE_SPLIT)


def clean_text(c: Column) -> Column:
    """Each line squeezed, blank lines dropped."""
    return F.array_join(F.filter(F.transform(lines(c), squeeze), lambda x: x != ""), "\n")


def clean_line(c: Column) -> Column:
    """Squeezed, without left-to-right and right-to-left marks."""
    return squeeze(F.translate(text(c), "‎‏", ""))


def key(c: Column) -> Column:
    """Lower case; all but a-z, 0-9 and Arabic to single spaces."""
    return F.trim(F.regexp_replace(F.lower(text(c)), TO_KEY, " "))


def key_under(c: Column, n: int) -> Column:
    """Whether the key has fewer than n characters: a longer text is read only so far as that needs."""
    # The key of a text's start is a start of its key.
    return F.when(F.length(key(F.substring(text(c), 1, 8 * n))) >= n, F.lit(False)).otherwise(F.length(key(c)) < n)


def key_adds_nothing(c: Column, other: Column) -> Column:
    """Whether the key is empty or that of other, read only so far as that needs."""
    longer = F.length(key(F.substring(text(c), F.lit(1), F.length(text(other)) + 64))) > F.length(key(other))
    return F.when(longer, F.lit(False)).otherwise((key(c) == "") | (key(c) == key(other)))


def source_key(c: Column) -> Column:
    return squeeze(F.lower(text(c)))


def matching(c: Column) -> Column:
    """Arabic-Indic digits to ASCII, lower case, alef forms to the bare one, squeezed."""
    return squeeze(F.translate(F.lower(F.translate(text(c), "٠١٢٣٤٥٦٧٨٩", "0123456789")), "آأإ", "ااا"))


def match_text(c: Column) -> Column:
    """Evaluation's form: digits and units alike in both languages, codes with their hash at the end."""
    t = F.translate(F.lower(F.translate(text(c), "٠١٢٣٤٥٦٧٨٩", "0123456789")), ",", "")
    for old, new in (("egp", "le"), ("جنيه", "le"), ("قروش", "pt"), ("#550*", "*550#")):
        t = F.replace(t, F.lit(old), F.lit(new))
    return squeeze(t)


def snippet(c: Column, n: int = 500) -> Column:
    """Squeezed; longer texts end in three dots at n characters."""
    t = squeeze(c)
    return F.when(F.length(t) <= n, t).otherwise(F.concat(F.rtrim(F.substring(t, 1, max(0, n - 3))), F.lit("...")))


def any_of(c: Column, terms: tuple[str, ...]) -> Column:
    """Whether c contains any of the terms."""
    return reduce(lambda a, b: a | b, [c.contains(t) for t in terms]) if terms else F.lit(False)


def sparse_tokens(c: Column) -> Column:
    """Tokens of the sparse index: codes, numbers, words; ASCII tokens lower-cased."""
    return F.transform(F.regexp_extract_all(text(c), F.lit(SPARSE_TOKEN), F.lit(0)), lambda t: F.when(t.rlike(r"^[\x00-\x7f]*$"), F.lower(t)).otherwise(t))


def token_count(c: Column) -> Column:
    return F.size(F.regexp_extract_all(text(c), F.lit(APPROX_TOKEN), F.lit(0)))


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is worked out once, wherever f names it, lambdas included."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def unique(values: Column) -> Column:
    """Squeezed, blanks dropped, first of each key kept."""
    cleaned = F.filter(F.transform(F.coalesce(values, F.array().cast("array<string>")), squeeze), lambda x: x != "")
    # Keys are made once for each value, before the fold compares them.
    return unique_keyed(F.transform(cleaned, lambda x: F.struct(x.alias("x"), key(x).alias("k"))))


def unique_keyed(values: Column) -> Column:
    """The first x of each key of array<struct<x, k: its key>>, squeezed and not blank; an empty key stands for the lower-cased x."""
    keyed = F.transform(values, lambda e: F.struct(e["x"].alias("x"), F.when(e["k"] == "", F.lower(e["x"])).otherwise(e["k"]).alias("k")))
    # Where a key first stands decides; a fold would copy what it has kept for each value.
    kept = lambda es, ks: F.filter(es, lambda e, i: F.array_position(ks, e["k"]) == i + 1)
    return bound(keyed, lambda es: bound(F.transform(es, lambda e: e["k"]), lambda ks: F.transform(kept(es, ks), lambda e: e["x"])))


def language_any(c: Column) -> Column:
    """ar, en, mixed, or null without letters of either."""
    ar, en = text(c).rlike(ARABIC), text(c).rlike("[A-Za-z]")
    return F.when(ar & en, "mixed").when(ar, "ar").when(en, "en")


def language_or_english(c: Column) -> Column:
    return F.coalesce(language_any(c), F.lit("en"))


def count_of(c: Column, char_class: str) -> Column:
    return F.length(F.regexp_replace(text(c), f"[^{char_class}]", ""))


def language_url_first(c: Column, url: Column) -> Column:
    """The language named in the URL path, else by letters."""
    named = F.lower(F.regexp_extract(text(url), r"(?i)/(en|ar)(?:/|$)", 1))
    return F.when(named != "", named).otherwise(language_any(c))


def language_threshold(c: Column, least: int = 30, span: int = 4000) -> Column:
    """By counts of letters in the text's first characters; a language counts from `least` letters."""
    head = F.substring(text(c), 1, span)
    ar, en = count_of(head, r"\x{600}-\x{6ff}") >= least, count_of(head, "A-Za-z") >= least
    return F.when(ar & en, "mixed").when(ar, "ar").when(en, "en")


def language_public(c: Column, url: Column, least: int = 30, span: int = 4000) -> Column:
    """The language that the URL names, else the one whose letters prevail among the first characters, else unknown."""
    head = F.substring(text(c), 1, span)
    ar, en = count_of(head, r"\x{600}-\x{6ff}"), count_of(head, "A-Za-z")
    return F.when(text(url).contains("/ar/"), "ar").when(text(url).contains("/en/"), "en").when(ar > F.greatest(F.lit(least), en), "ar").when(en > least, "en").otherwise("unknown")


def language_expected(c: Column, expected: Column, least: int = 100, strong: int = 200, span: int = 4000) -> Column:
    """The expected language unless the other one prevails among the first characters: Arabic over English from `least`
    letters, English over Arabic from `strong` and three times as many."""
    head = F.substring(text(c), 1, span)
    ar, en = count_of(head, r"\x{600}-\x{6ff}"), count_of(head, "A-Za-z")
    open_ = F.when(ar > F.greatest(F.lit(30), en), "ar").when(en > 30, "en").otherwise(expected)
    return F.when(expected == "en", F.when(ar > F.greatest(F.lit(least), en), "ar").otherwise("en")).when(expected == "ar", F.when(en > F.greatest(F.lit(strong), ar * 3), "en").otherwise("ar")).otherwise(open_)


# --- Ids ---------------------------------------------------------------------------------------------------


def short_hash(c: Column, n: int = 16) -> Column:
    return F.substring(F.sha2(text(c), 256), 1, n)


def joined_hash(*columns: Column, n: int = 64) -> Column:
    return short_hash(F.concat_ws("|", *[text(c) for c in columns]), n)


def chunk_id(parent: Column, index: Column, content: Column) -> Column:
    return F.concat_ws(":", parent, F.lit("chunk"), index.cast("string"), short_hash(F.concat_ws(":", parent, index.cast("string"), content)))


def uuid5(name: Column, namespace: str = "6ba7b810-9dad-11d1-80b4-00c04fd430c8") -> Column:
    """Version 5 UUID of a name (the DNS namespace unless given)."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), F.encode(name, "utf-8")))
    nibble = F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)
    part = lambda a, n: F.substring(h, a, n)
    return F.concat(part(1, 8), F.lit("-"), part(9, 4), F.lit("-5"), part(14, 3), F.lit("-"), F.lower(F.hex(nibble)), part(18, 3), F.lit("-"), part(21, 12))


# --- URLs --------------------------------------------------------------------------------------------------


def url_plain(url: Column) -> Column:
    """Without query and fragment; no slash at the end."""
    return F.regexp_replace(F.regexp_replace(F.trim(text(url)), r"[?#].*$", ""), r"/+$", "")


def url_canonical(url: Column, keep_language: bool = False) -> Column:
    """Lower-case scheme and host, no language segment (unless kept), query or fragment."""
    u = url_plain(url)
    head = F.regexp_extract(u, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/]*)", 1)
    rest = F.substring(u, F.length(head) + 1, F.length(u))
    rest = rest if keep_language else F.regexp_replace(rest, r"(?i)/(en|ar)(/|$)", "$2")
    return F.concat(F.lower(head), rest)


def url_pair_key(url: Column) -> Column:
    """The same for a page's language versions."""
    return F.lower(url_canonical(url))


def url_other_language(url: Column) -> Column:
    """The other language's address, null if the URL names none."""
    u = text(url)
    return F.when(u.rlike(r"/en(/|$)"), F.regexp_replace(u, r"/en(/|$)", "/ar$1")).when(u.rlike(r"/ar(/|$)"), F.regexp_replace(u, r"/ar(/|$)", "/en$1"))


def url_slug(url: Column) -> Column:
    return F.element_at(F.split(url_plain(url), "/"), -1)


def url_file_name(url: Column, n: int = 12) -> Column:
    """A safe file name: the URL's characters, and a hash."""
    return F.concat(F.substring(F.regexp_replace(F.regexp_replace(text(url), r"^[a-z]+://", ""), "[^A-Za-z0-9._-]+", "_"), 1, 120), F.lit("_"), short_hash(url, n))


def file_name(c: Column) -> Column:
    return F.regexp_replace(text(c), "[^A-Za-z0-9._-]+", "_")


def url_allowed(url: Column, hosts: tuple[str, ...], allow: tuple[str, ...] = (), deny: tuple[str, ...] = (), extensions: tuple[str, ...] = ()) -> Column:
    """Host in the list, any allowed part (if listed), no denied part or file extension."""
    u = F.lower(text(url))
    host = F.regexp_extract(u, r"^[a-z][a-z0-9+.-]*://([^/:?#]*)", 1)
    ok = (reduce(lambda a, b: a | b, [(host == h) | host.endswith("." + h) for h in hosts]) if hosts else F.lit(True)) & ~any_of(u, deny)
    ok = ok & any_of(u, allow) if allow else ok
    return ok & ~reduce(lambda a, b: a | b, [url_plain(u).endswith(x) for x in extensions]) if extensions else ok


# --- Queries -----------------------------------------------------------------------------------------------


def query_keywords(c: Column) -> Column:
    """Tokens longer than one character that are no stop-words."""
    found = F.regexp_extract_all(F.lower(text(c)), F.lit(r"\*?#?[\p{L}\p{N}_][\p{L}\p{N}_#*,-]*|[\x{600}-\x{6ff}]+"), F.lit(0))
    return F.filter(found, lambda t: (F.length(t) > 1) & ~t.isin(*L.STOPWORDS))


def query_entities(c: Column) -> Column:
    """Capitalised words, mixed tokens of letters and digits, whole numbers and device names; unique ignoring case."""
    q = text(c)
    bound = r"(?<![\p{L}\p{N}_])%s(?![\p{L}\p{N}_])"
    capitals = F.filter(F.regexp_extract_all(q, F.lit(bound % r"[A-Z][A-Za-z0-9-]{2,}"), F.lit(0)), lambda t: ~t.isin(*L.IGNORED_CAPITALS))
    mixed = F.regexp_extract_all(q, F.lit(bound % r"(?=[A-Za-z0-9-]*[A-Za-z])(?=[A-Za-z0-9-]*[0-9])[A-Za-z0-9-]{3,}"), F.lit(0))
    numbers = F.regexp_extract_all(q, F.lit(bound % r"\p{Nd}+"), F.lit(0))
    named = F.filter(F.array(*[F.when(F.lower(q).contains(n.lower()), n) for n in L.DEVICE_NAMES]), lambda x: x.isNotNull())
    start = F.array().cast("array<string>")
    return F.aggregate(F.concat(capitals, mixed, numbers, named), start, lambda acc, t: F.when(F.exists(acc, lambda x: F.lower(x) == F.lower(t)), acc).otherwise(F.array_append(acc, t)))


def citation_ids(c: Column) -> Column:
    """Distinct numbers in square brackets, ascending."""
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(text(c), F.lit(r"\[([0-9]{1,9})\]"), F.lit(1)), lambda x: x.cast("int"))))


def visible_text(c: Column) -> Column:
    """What a reader should see: no label or type lines, no inline labels, squeezed."""
    kept = F.filter(F.transform(F.split(text(c), r"[\r\n]+"), lambda x: F.trim(F.translate(x, "﻿", ""))),
        lambda x: (x != "") & ~F.lower(x).isin(*L.TYPE_WORDS) & ~reduce(lambda a, b: a | b, [F.lower(x).startswith(p) for p in L.LABEL_PREFIXES]))
    joined = F.array_join(F.transform(kept, lambda x: squeeze(F.regexp_replace(x, r"^\*\s+(\*[0-9][^ ]*#?)", "$1"))), " ")
    plain = F.regexp_replace(joined, r"(?i)\b(?:Title|Category|Record type|Language|Source|Content|Metadata|Source type)\s*:\s*", "")
    plain = F.regexp_replace(plain, r"\b(service_detail|eligibility|service_fee|subscription_method)\b", "")
    return F.regexp_replace(squeeze(plain), "^[ -]+|[ -]+$", "")
