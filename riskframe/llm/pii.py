"""Personal data in whole texts, disguised or not, with offsets of the source.

Transducers rewrite a text where something in it is disguised: homoglyphs and full-width characters become
ASCII letters and digits, zero-width characters go, runs of spelled digits ("four one double five") become
digits and at/dot disguises become "@" and ".". Each rewritten piece keeps its place in the source, so an
identifier found in the rewritten text is mapped back to the source characters that it came from. Only
identifiers that touch a rewritten piece are added; those of the text as it stands always stay.

Null and empty texts have no spans. Repeated rows each get their own result. Texts of any length are scanned whole,
in time that grows with their length. Spans that begin together are ordered by kind. An empty table has an empty
result; find() reads doc_id and text alone, redact() passes columns of any name through.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from functools import lru_cache

from pyspark.sql import DataFrame

from riskframe.llm.spans import Span, joined, scan, sha256

KINDS = ("email", "ip", "card", "phone")

DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
# From the start of a run of digits only, and without going back in it: linear on long runs.
DOTTED = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++)+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOUBLED = tuple(d * 2 - 9 * (d > 4) for d in range(10))

# Look-alikes of ASCII letters.
LOOKALIKES = dict(
    zip(
        "аеорсухіјѕһԁԛԝɡңкмтвнАВЕКМНОРСТУХІЈЅαονρικτυχΑΒΕΖΗΙΚΜΝΟΡΤΥΧ",
        "aeopcyxijshdqwgnkmtbhABEKMHOPCTYXIJSaovpiktuxABEZHIKMNOPTYX",
        strict=True,
    )
)
INVISIBLE = "​‌‍⁠﻿­"
# The digits 0 to 9 in the languages of the corpus.
NUMBER_WORDS = (
    "zero one two three four five six seven eight nine",
    "null eins zwei drei vier fünf sechs sieben acht neun",
    "zéro un deux trois quatre cinq six sept huit neuf",
    "cero uno dos tres cuatro cinco seis siete ocho nueve",
)
DIGITS = {w: str(n) for words in NUMBER_WORDS for n, w in enumerate(words.split())}
DIGITS |= {"oh": "0", "plus": "+", "más": "+", "dot": ".", "point": ".", "punkt": ".", "punto": "."}
TIMES = {"double": 2, "triple": 3}
AT, DOT = "at|arobase|arroba", "dot|punkt|punto|point"


def look_alike(char: str) -> str | None:
    """The ASCII character that a character stands for, if it is a disguise: digits of any script, styled letters, full width."""
    if char in INVISIBLE:
        return ""
    if char in LOOKALIKES:
        return LOOKALIKES[char]
    if (digit := unicodedata.digit(char, None)) is not None:
        return str(digit)
    plain = unicodedata.normalize("NFKC", char)
    return plain if len(plain) == 1 and plain.isascii() and plain.isprintable() and not plain.isspace() else None


#: Where characters with a plain form stand in Unicode: scripts with digits of their own, forms, styled letters, enclosed ones.
BLOCKS = ((0x80, 0x2E80), (0xFE00, 0x10000), (0x104A0, 0x104AA), (0x1D400, 0x1D800), (0x1F100, 0x1F200))
PLAIN = {c: p for a, b in BLOCKS for c in map(chr, range(a, b)) if (p := look_alike(c)) is not None}


@lru_cache(10_000)
def any_of(chars: str) -> re.Pattern:
    """Finds characters of a text's own: a class of all in PLAIN is slow to search for."""
    return re.compile(f"[{chars}]")


def spelled_patterns(words: str) -> tuple[list[str], re.Pattern, re.Pattern]:
    """The words of a language, a run of two that may begin an identifier, and whole runs."""
    word = "|".join(words.split())
    more = f"{word}|oh|double|triple|{DOT}"
    hint = re.compile(rf"(?i:\b(?:{word})[\s-]+(?:{more})\b)")
    run = re.compile(rf"(?i:\b(?:(?:plus|más)[\s-]+)?(?:(?:double|triple)[\s-]+)?(?:{word})(?:[\s-]+(?:{more})){{2,}}\b)")
    return words.split(), hint, run


SPELLED = [spelled_patterns(words) for words in NUMBER_WORDS]
IN_BRACKETS = re.compile(rf"(?ai:[\[({{<]\s*({AT}|{DOT})\s*[\])}}>])")
AT_IN_BRACKETS = re.compile(rf"(?ai:[\[({{<]\s*(?:{AT})\b)")
# A bare "at" counts only where a spelled or bracketed dot follows the next word.
BARE_AT = re.compile(rf"(?ai:(?<=[a-z0-9_%+-])\s+(?:{AT})\s+(?=[a-z0-9-]+(?:\s+(?:{DOT})\s+|\s*[\[({{<]\s*(?:{DOT})\s*[\])}}>]\s*)[a-z0-9-]))")
BARE_DOT = re.compile(rf"(?ai:(?<=[a-z0-9_%+-])\s+(?:{DOT})\s+(?=[a-z0-9-]))")
DOT_HINT, AT_WORDS = DOT.split("|"), AT.split("|")


def luhn(digits: str) -> bool:
    d = list(map(int, digits))
    return (sum(d[-1::-2]) + sum([DOUBLED[x] for x in d[-2::-2]])) % 10 == 0


def plain_spans(text: str) -> list[Span]:
    """The identifiers of the text as it stands, leftmost and non-overlapping within a kind, by start and kind."""
    spans: list[Span] = []
    at, free = text.find("@"), 0
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL_CHARS:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            free = m.end()
            spans.append((start, 0, free))
        at = text.find("@", max(at + 1, free))
    for m in DOTTED.finditer(text):
        parts = m[0].split(".")
        starts = [m.start()]
        for part in parts:
            starts.append(starts[-1] + len(part) + 1)
        for i in range(0, len(parts) - 3, 4):
            if all(len(p := part.lstrip("0")) <= 3 and int(p or 0) <= 255 for part in parts[i : i + 4]):
                spans.append((starts[i], 1, starts[i + 4] - 1))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                spans.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= sum(map(str.isdigit, m[0])) <= 15:
                spans.append((m.start(), 3, m.end()))
    spans.sort()
    return spans


def spelled(run: str) -> str:
    """The characters that a run of spelled digits stands for."""
    out, times = [], 1
    for word in re.split(r"[\s-]+", run.lower()):
        if word in TIMES:
            times = TIMES[word]
        else:
            out.append(DIGITS[word] * times)
            times = 1
    return "".join(out)


def rewrites(text: str) -> list[tuple[int, int, str]]:
    """What the transducers change: (start, end, replacement), apart from one another, by start."""
    found: list[tuple[int, int, str]] = []
    if not text.isascii() and (odd := PLAIN.keys() & set(text)):
        found = [(m.start(), m.end(), PLAIN[m[0]]) for m in any_of("".join(sorted(odd))).finditer(text)]
    if found:  # words may be spelled with look-alikes: the rest works on text of the same length
        chars = list(text)
        for start, _, plain in found:
            if len(plain) == 1:
                chars[start] = plain
        text = "".join(chars)
    low = text.lower()
    more: list[tuple[int, int, str]] = []
    for words, hint, run in SPELLED:
        if any(w in low for w in words) and hint.search(text):
            more += [(m.start(), m.end(), spelled(m[0])) for m in run.finditer(text)]
    if any(w in low for w in DOT_HINT) or AT_IN_BRACKETS.search(text):
        free = 0
        for m in IN_BRACKETS.finditer(text):
            start, end = m.span()
            while start > free and text[start - 1].isspace():
                start -= 1
            while end < len(text) and text[end].isspace():
                end += 1
            free = end
            more.append((start, end, "@" if m[1].lower() in AT_WORDS else "."))
        bare_at = [(m.start(), m.end(), "@") for m in BARE_AT.finditer(text)]
        # Without an "@" or a number a bare dot makes no identifier.
        if bare_at or "@" in text or any(x[2] != "." for x in more):
            more += bare_at + [(m.start(), m.end(), ".") for m in BARE_DOT.finditer(text)]
    if more:
        more.sort(key=lambda x: (x[0], -x[1]))
        kept, free = [], 0
        for x in more:
            if x[0] >= free:
                kept.append(x)
                free = x[1]
        starts = [x[0] for x in kept]
        found = [x for x in found if not (i := bisect_right(starts, x[0])) or kept[i - 1][1] <= x[0]] + kept
        found.sort()
    return found


def disguised_spans(text: str) -> list[Span]:
    """The identifiers that show only in the rewritten text, as spans of the source."""
    pieces = rewrites(text)
    if not pieces:
        return []
    out, starts, sources, at, size = [], [], [], 0, 0  # starts: of the rewritten pieces in the new text
    for start, end, plain in pieces:
        out += [text[at:start], plain]
        size += start - at
        starts.append(size)
        sources.append((size + len(plain), start, end))
        size += len(plain)
        at = end
    out.append(text[at:])

    def source(place: int, end: bool) -> int:
        i = bisect_right(starts, place - end) - 1
        if i < 0:
            return place
        new_end, old_start, old_end = sources[i]
        if place - end < new_end:
            return old_end if end else old_start
        return old_end + place - new_end

    spans = []
    for start, kind, end in plain_spans("".join(out)):
        i = bisect_right(starts, end - 1) - 1
        touched = i >= 0 and (sources[i][0] > start or starts[i] >= start)
        if touched:
            spans.append((source(start, False), kind, source(end, True)))
    return spans


def all_spans(text: str) -> tuple[list[Span], list[Span]]:
    """The plain spans, and those with the disguised ones."""
    plain = plain_spans(text)
    more = disguised_spans(text)
    return plain, sorted({*plain, *more}) if more else plain


def find(docs: DataFrame) -> DataFrame:
    """doc_id, the number of plain spans of each kind, base_sha256 of them, and spans: all, as kind:start:end."""

    def rows_of():
        def rows(columns: list) -> list[list]:
            out: list[list] = [columns[0], [], [], [], [], [], []]
            for text in columns[1]:
                plain, spans = all_spans(text or "")
                counts = [0, 0, 0, 0]
                for _, kind, _ in plain:
                    counts[kind] += 1
                said = joined(plain, KINDS)
                for x, value in zip(out[1:], (*counts, sha256(said), said if spans is plain else joined(spans, KINDS)), strict=True):
                    x.append(value)
            return out

        return rows

    return scan(docs.withColumn("doc_id", docs["doc_id"].cast("long")), ("doc_id", "text"), "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string", rows_of)


def redacted_text(text: str) -> str:
    """The text with each stretch of overlapping spans replaced by the kind of its first one in brackets."""
    _, spans = all_spans(text)
    if not spans:
        return text
    parts, at, until, kind = [], 0, -1, 0
    for start, k, end in [*spans, (len(text) + 1, 0, 0)]:
        if start >= until:
            if until >= 0:
                parts.append(f"[{KINDS[kind].upper()}]")
                at = until
            if start <= len(text):
                parts.append(text[at:start])
                kind = k
        until = max(until, end)
    return "".join(parts) + text[at:]


def redact(docs: DataFrame) -> DataFrame:
    """docs with personal data in text replaced by placeholders and n_chars, where there is one, of the new text.

    Null texts stay null; all columns stay.
    """
    columns = docs.columns
    place = columns.index("text")
    size = columns.index("n_chars") if "n_chars" in columns else None

    def rows_of():
        def rows(values: list) -> list[list]:
            values[place] = [t and redacted_text(t) for t in values[place]]
            if size is not None:
                values[size] = [n if t is None else len(t) for n, t in zip(values[size], values[place], strict=True)]
            return values

        return rows

    return scan(docs, tuple(f"`{c}`" for c in columns), ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields), rows_of)
