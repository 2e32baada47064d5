"""Personal data with offsets that survive disguise.

The base scan finds plain identifiers.  Then transducers rewrite the text: homoglyphs and full-width forms to
ASCII, spelled digits to digits, at/dot disguises to @ and dots.  Each rewritten character remembers the
source span it came from, so identifiers found in the rewritten text map back to the original.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import ALNUM, columns_of, over_batches

KINDS = ("email", "ip", "card", "phone")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: A run of digits is tried from its first one alone: where that fails, so do the others.
DOTTED = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
#: Look-alikes of ASCII letters in Cyrillic and Greek, and other at and dot signs.  Fixed values.
HOMOGLYPHS = dict(zip("асеорхуіјѕԁһԛԝАВЕЅІЈКМНОРСТХУΑΒΕΖΗΙΚΜΝΟΡΤΥΧοανρ﹫。․", "aceopxyijsdhqwABESIJKMHOPCTXYABEZHIKMNOPTYXoavp@..", strict=True))
HOMOGLYPHS |= {chr(c + 0xFEE0): chr(c) for c in range(0x21, 0x7F)}
INVISIBLE = frozenset("​‌‍⁠﻿­")
#: Spelled digits in English, German, French and Spanish.  Fixed values.
SPELLED = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "zwo": "2", "drei": "3", "vier": "4", "fünf": "5", "fuenf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}
#: Words for the signs in addresses and numbers, in the same languages.  Fixed values.
AT_WORDS, DOT_WORDS, PLUS_WORDS, BRACKET_AT, BRACKET_DOT = ("at", "ät", "arroba", "arobase"), ("dot", "punkt", "point", "punto"), ("plus", "más"), ("a", "@"), ("d", ".", "p")

#: Endings that may follow a spelled dot: `dot` stands before any two letters, the other words, which prose uses, before
#: endings that are no words.  Fixed values.
GENERIC_ENDS = ("com", "org", "net", "edu", "gov", "info", "biz", "app", "dev", "io", "co")
COUNTRY_ENDS = ("de", "fr", "es", "uk", "eu", "ru", "nl", "pl", "ch", "se", "dk", "fi", "cz", "pt", "br", "cn", "jp", "kr", "ca", "au", "nz", "mx", "gr", "hu", "ro", "ua", "tr")


def _any(words) -> str:
    return "(?:" + "|".join(re.escape(w) for w in sorted(words, key=lambda w: (-len(w), w))) + ")"


ODD = re.compile("[" + re.escape("".join(HOMOGLYPHS)) + "".join(INVISIBLE) + "]")
_DIGIT, _PART, _EDGE = _any(SPELLED), r"[\x20-]{1,2}", r"(?![^\W_])"
# A run of spelled and written digits, four at least; dots between them may be spelled, and a plus before them.
WORD_DIGITS = re.compile(rf"(?i)(?<![^\W_])(?:{_any(PLUS_WORDS)}[\x20-]+)?{_DIGIT}(?:(?:{_PART}{_any(DOT_WORDS)})?{_PART}(?:{_DIGIT}|[0-9]+)){{3,}}{_EDGE}")
ONE_WORD = re.compile(rf"(?i)({_DIGIT}){_EDGE}|([0-9]+)|({_any(DOT_WORDS)}){_EDGE}|({_any(PLUS_WORDS)}){_EDGE}|([\x20-]+)")
# Bracketed signs are disguises wherever they stand between name characters.
AT = re.compile(rf"(?i)(?<=[a-z0-9])\x20?[\[({{<]\x20?{_any(AT_WORDS + BRACKET_AT)}\x20?[\])}}>]\x20?(?=[a-z0-9])")
DOT = re.compile(rf"(?i)(?<=[a-z0-9])\x20?[\[({{<]\x20?{_any(DOT_WORDS + BRACKET_DOT)}\x20?[\])}}>]\x20?(?=[a-z0-9])")
# Bare words only as name at name dot ending; the dot may be written where the sign is spelled, and the other way round.
_NAME, _SIGN = r"[a-z0-9_%+-]{1,64}", rf"(?:\.|\x20{_any(DOT_WORDS)}\x20)"
BARE_AT = re.compile(rf"(?i)\x20{_any(AT_WORDS)}\x20|\x20?@\x20?")
BARE_HOST = re.compile(rf"(?i)[a-z0-9-]{{1,63}}(?:{_SIGN}[a-z0-9-]{{1,63}}){{0,4}}(?:\.[a-z]{{2,24}}|\x20dot\x20(?:[a-z]{{2}}|{_any(GENERIC_ENDS)})|\x20{_any(DOT_WORDS[1:])}\x20{_any(GENERIC_ENDS + COUNTRY_ENDS)})(?![a-z0-9])")
BARE_NAME = re.compile(rf"(?i)(?<![a-z0-9._%+-]){_NAME}(?:{_SIGN}{_NAME}){{0,4}}\Z")
#: Characters before a sign in which its name may stand.
NAME_SPAN = 400
BARE_PART = re.compile(rf"(?i)\x20{_any(DOT_WORDS)}\x20")
BRACKETS = re.compile(r"(?i)[\[({<]\x20?(?:[a-zäá]{1,8}|@|\.)\x20?[\])}>]")
DIGIT_WORDS, SIGN_WORDS = frozenset(w.encode() for w in SPELLED), frozenset(w.encode() for w in AT_WORDS + DOT_WORDS)


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = ord(d) - 48
        total += v if i % 2 == 0 else v * 2 - 9 * (v > 4)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost, non-overlapping: an address begins where the name characters before an @ begin."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            out.append((start, found.end()))
            free = found.end()
        else:
            free = max(free, at)  # no later name reaches back over an @
        at = text.find("@", max(at + 1, free))
    return out


def ips(text: str) -> list[tuple[int, int]]:
    """Runs of dotted numbers, cut into fours from the left."""
    out = []
    for run in DOTTED.finditer(text):
        parts, at = run.group().split("."), run.start()
        for i in range(0, len(parts) - 3, 4):
            size = sum(map(len, parts[i : i + 4])) + 3
            if all(len(p := x.lstrip("0")) <= 3 and int(p or 0) <= 255 for x in parts[i : i + 4]):
                out.append((at, at + size))
            at += size + 1
    return out


def cards(text: str) -> list[tuple[int, int]]:
    out = []
    for run in CARD.finditer(text):
        if run.end() - run.start() >= 14:
            digits = run.group().replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append(run.span())
    return out


def phones(text: str) -> list[tuple[int, int]]:
    return [run.span() for run in PHONE.finditer(text) if 10 <= sum("0" <= c <= "9" for c in run.group()) <= 15]


def find(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of all plain identifiers, by start, then kind as listed."""
    out = [(s, e, "email") for s, e in emails(text)] if "@" in text else []
    if DIGIT.search(text):
        out += [(s, e, "ip") for s, e in ips(text)] + [(s, e, "card") for s, e in cards(text)]
        if "+" in text:
            out += [(s, e, "phone") for s, e in phones(text)]
    return sorted(out, key=lambda x: (x[0], KINDS.index(x[2])))


class Traced:
    """A text with, for each character, the source span it stands for."""

    def __init__(self, text: str, starts: list[int] | range | None = None, ends: list[int] | range | None = None):
        self.text = text
        self.starts = range(len(text)) if starts is None else starts
        self.ends = range(1, len(text) + 1) if ends is None else ends

    def rewrite(self, edits: list[tuple[int, int, str]]) -> Traced:
        """Replace [start, end) by text for each edit, in order and without overlap."""
        if not edits:
            return self
        text, starts, ends, at = [], [], [], 0
        for s, e, new in edits:
            text += (self.text[at:s], new)
            starts += [*self.starts[at:s], *[self.starts[s]] * len(new)]
            ends += [*self.ends[at:s], *[self.ends[e - 1]] * len(new)]
            at = e
        text.append(self.text[at:])
        starts += self.starts[at:]
        ends += self.ends[at:]
        return Traced("".join(text), starts, ends)

    def source(self, start: int, end: int) -> tuple[int, int]:
        return self.starts[start], self.ends[end - 1]


def homoglyphs(t: Traced) -> Traced:
    """Look-alikes to ASCII, but only in words that also hold ASCII letters or digits; invisible marks go."""
    edits = []
    for m in ODD.finditer(t.text):
        c = m.group()
        near = t.text[max(0, m.start() - 2) : m.end() + 2]
        if c in INVISIBLE:
            edits.append((m.start(), m.end(), ""))
        elif ord(c) >= 0xFF01 or any(x.isascii() and x.isalnum() or x in "@." for x in near):
            edits.append((m.start(), m.end(), HOMOGLYPHS[c]))
    return t.rewrite(edits)


def spelled_digits(t: Traced) -> Traced:
    """Runs of four or more spelled or written digits to digits; a run keeps no separators but spelled dots and a plus."""
    edits = []
    for m in WORD_DIGITS.finditer(t.text):
        digits = "".join(SPELLED[w.lower()] if w else d or ("." if dot else "+" if plus else "") for w, d, dot, plus, _ in ONE_WORD.findall(m.group()))
        edits.append((m.start(), m.end(), digits))
    return t.rewrite(edits)


def signs(t: Traced, bare: bool = True) -> Traced:
    """at and dot disguises to @ and dots; bare ones too, if there are such words."""
    if BRACKETS.search(t.text):
        t = t.rewrite(sorted([(*m.span(), "@") for m in AT.finditer(t.text)] + [(*m.span(), ".") for m in DOT.finditer(t.text)]))
    edits, free = [], 0
    for m in BARE_AT.finditer(t.text) if bare else ():
        # The host decides; the name before the sign is looked for only where a host stands behind it.
        if m.start() >= free and (host := BARE_HOST.match(t.text, m.end())):
            lo = max(free, m.start() - NAME_SPAN)
            name = BARE_NAME.search(t.text[lo : m.start()])
            if name:
                edits += [(*p.span(), ".") for p in BARE_PART.finditer(t.text, lo + name.start(), m.start())]
                edits += [(*m.span(), "@"), *[(*p.span(), ".") for p in BARE_PART.finditer(t.text, m.end(), host.end())]]
                free = host.end()
    return t.rewrite(edits)


def apart(found: list[tuple[int, int, str]], base: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Those of the found spans, sorted by start, that no base span of their kind overlaps, or that hold more than the base spans they
    overlap and all of those: one pass over both."""
    own = {k: [x for x in base if x[2] == k] for k in KINDS}
    at, out = dict.fromkeys(KINDS, 0), []
    for a, b, kind in found:
        spans_, i = own[kind], at[kind]
        while i < len(spans_) and spans_[i][1] <= a:
            i += 1
        at[kind] = i
        within = i
        while within < len(spans_) and spans_[within][0] < b and a <= spans_[within][0] and spans_[within][1] <= b:
            within += 1
        if (within == len(spans_) or spans_[within][0] >= b) and (a, b, kind) not in spans_[i:within]:
            out.append((a, b, kind))
    return out


def spans(text: str) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """(base, all): all is base plus what the transducers uncover and no base span of the kind overlaps."""
    base = find(text)
    traced = Traced(text)
    if not text.isascii() and ODD.search(text):
        traced = homoglyphs(traced)
    # Words tell which transducers have work.
    words = frozenset(traced.text.lower().encode("utf-8", "surrogatepass").translate(ALNUM).split())
    if not DIGIT_WORDS.isdisjoint(words):
        traced = spelled_digits(traced)
    traced = signs(traced, not SIGN_WORDS.isdisjoint(words))
    if traced.text is text or traced.text == text:
        return base, base
    extra = apart([(*traced.source(s, e), kind) for s, e, kind in find(traced.text)], base)
    return base, sorted(base + extra, key=lambda x: (x[0], KINDS.index(x[2]), x[1]))


def joined(found: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in found)


SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), *[T.StructField(f"n_{k}", T.LongType()) for k in KINDS], T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType()), T.StructField("n_disguised", T.LongType())])


def find_pii(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, base counts by kind, base_sha256, spans (all, kind:start:end), n_disguised.

    Null and empty texts have no spans.  Rows are independent: repeated rows and clashing columns do not
    matter, empty tables give no rows.
    """

    def make():
        def step(batch: pa.RecordBatch):
            out: dict[str, list] = {f.name: [] for f in SCHEMA.fields[1:]}
            for t in batch.column(1).to_pylist():
                base, every = spans(t or "")
                for k in KINDS:
                    out[f"n_{k}"].append(sum(x[2] == k for x in base))
                out["base_sha256"].append(hashlib.sha256(joined(base).encode()).hexdigest())
                out["spans"].append(joined(every))
                out["n_disguised"].append(len(every) - len(base))
            yield {"doc_id": batch.column(0), **out}

        return step

    return over_batches(columns_of(docs), make, SCHEMA)


def masked(text: str, mark: str = "<{}>") -> str:
    """The text with every span, disguised ones included, replaced by its kind."""
    out, at = [], 0
    for s, e, kind in spans(text)[1]:
        if s >= at:
            out += (text[at:s], mark.format(kind.upper()))
        at = max(at, e)  # a wider span goes on where a narrower one ends
    return "".join(out) + text[at:]
