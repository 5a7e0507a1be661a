"""Personal data in texts, also where it is disguised, with spans in the source text.

Base spans come from patterns on the source text as it is. Then a chain of transducers rewrites a
disguised text and keeps, for every character it writes, the source span that the character came
from: homoglyphs and full-width forms become the ASCII they look like, invisible characters go,
runs of spelled digits become digits, and at/dot disguises become ``@`` and ``.``. The same
patterns run on what comes out; a match is mapped back to the source and counts if a rewritten
character takes part in it and it overlaps no span of its kind. Texts with nothing to rewrite skip
the chain.

Offsets are code points, end exclusive. Edge cases: null and empty texts hold nothing; a match that
fails its test (parts of an address, checksum, number of digits) is dropped and not tried anew;
rows that repeat a document are scanned each; whole texts are scanned, however long; extra columns are not read by :func:`find` and kept by :func:`redact`.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from array import array

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sumloom.llm.common import table

KINDS = ("email", "ip", "card", "phone")

# The patterns of the four kinds.
_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DIGIT = re.compile("[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _emails(text: str):
    """Matches of _EMAIL, found from the at signs: the pattern itself would try every letter."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _EMAIL.match(text, start) if start < at else None
        done = m.end() if m else at + 1
        if m:
            yield start, done
        at = text.find("@", done)


def spans_of(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind index) of all matches that pass their tests, by start, then kind."""
    found = [(a, b, 0) for a, b in _emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        if "." in text:
            found += [(m.start(), m.end(), 1) for m in _IP.finditer(text) if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m[0].split("."))]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 12:
                digits = m[0].replace(" ", "").replace("-", "")
                if 12 <= len(digits) <= 19 and luhn(digits):
                    found.append((m.start(), m.end(), 2))
        if "+" in text:
            found += [(m.start(), m.end(), 3) for m in _PHONE.finditer(text) if 9 <= len(_DIGIT.findall(m[0])) <= 15]
    found.sort(key=lambda x: (x[0], x[2]))
    return found


# Characters that look like ASCII ones, by script.
_LOOKS = {
    "АВЕКМНОРСТХУІЈЅ": "ABEKMHOPCTXYIJS", "авекмнорстхуіјѕһԁԛԝ": "abekmhopctxyijshdqw",
    "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧ": "ABEZHIKMNOPTYX", "αορνικτυχ": "aopviktux", "ոսց": "nug",
    "․。｡․∙⋅": "......", "‐‑‒–—−﹣": "-------", "＋﹢": "++", "＠﹫": "@@", "    ": "    ",
}
_GLYPH = {a: b for xs, ys in _LOOKS.items() for a, b in zip(xs, ys, strict=True)}
# Characters that are not seen.
_UNSEEN = frozenset("​‌‍⁠﻿­᠎")
# Digits in words, English, German, French, Spanish.
_SPELLED = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}
_ONE = "|".join(sorted(_SPELLED, key=len, reverse=True))
#: Four or more in a row; shorter runs are words.
_RUN = re.compile(rf"(?<![^\W_])(?:(?:{_ONE}|[0-9])(?:\x20(?:dot|punkt|punto)\x20|[\x20,.-]{{1,2}})){{3,}}(?:{_ONE}|[0-9])(?![^\W_])", re.I)
#: Runs that hold numbers of several figures, of any length; they count if they are of a kind as a whole.
_MIXED = re.compile(rf"(?<![^\W_])(?:(?:{_ONE}|[0-9]+)(?:\x20(?:dot|punkt|punto)\x20|[\x20,.-]{{1,2}}))+(?:{_ONE}|[0-9]+)(?![^\W_])", re.I)
_MIXED_PART = re.compile(rf"{_ONE}|[0-9]+", re.I)
_WORD_NEXT = re.compile(rf"[0-9](?:\x20(?:dot|punkt|punto)\x20|[\x20,.-]{{1,2}})(?:{_ONE})(?![^\W_])", re.I)
_NUMBER = re.compile(r"(?<=[\x20,.-])[0-9]")
_WORD_BEFORE = re.compile(rf"(?:{_ONE})(?:\x20(?:dot|punkt|punto)\x20|[\x20,.-]{{1,2}})\Z", re.I)
_SIGN = re.compile(r"(?:\+|(?<![^\W_])plus[\x20-])\Z", re.I)
#: A run holds one of these at least.
_TELLING = frozenset(_SPELLED) - {"un", "oh"}
_FLAT = str.maketrans(",.-", "   ")
_PART = re.compile(r"\.|dot|punkt|punto", re.I)
_WORD_DIGIT = re.compile(rf"{_ONE}|[0-9]", re.I)
_PLUS = re.compile(r"(?<![^\W_])plus[\x20-](?=[0-9])", re.I)
_BRACKETED_AT = re.compile(r"[\x20]{0,2}[\[({<][\x20]?(?:at|@|arroba|ät)[\x20]?[\])}>][\x20]{0,2}", re.I)
_BRACKETED_DOT = re.compile(r"[\x20]{0,2}[\[({<][\x20]?(?:dot|punkt|point|punto|\.)[\x20]?[\])}>][\x20]{0,2}", re.I)
_NAME, _LABEL, _SPELLED_DOT, _ENDING = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+", "[A-Za-z0-9-]+", r"\x20(?:dot|punkt|punto)\x20", r"[A-Za-z]{2,24}(?![A-Za-z0-9-])"
#: Words that a spoken dot follows in plain texts, unless one of the common endings comes next.
_NO_HOST = rf"(?:the|this|that|these|those|a|an|each|every|any|some|one|which|what|no|another|my|our|your|his|her|its|their|polka){_SPELLED_DOT}(?!(?:com|org|net|edu|gov|info|example|test|co|io|ai|eu|uk|us|de|fr|es)(?![A-Za-z0-9-]))"
#: Bare words count only in the frame of an address: name at host dot domain, or a spaced @ with plain dots.
_BARE = re.compile(rf"{_NAME}(?:(?P<at>\x20(?:at|arroba)\x20(?!{_NO_HOST})|\x20?@\x20?){_LABEL}(?:(?:{_SPELLED_DOT}|\.){_LABEL})*{_SPELLED_DOT}(?:{_LABEL}\.)*{_ENDING}|(?P<sign>\x20?@\x20){_LABEL}(?:\.{_LABEL})*\.{_ENDING})", re.I)
_BARE_DOT = re.compile(_SPELLED_DOT, re.I)
#: A text without any of these holds no at/dot disguise.
_HINTS = ("dot", "punkt", "punto", "point", "at)", "at]", "at}", "at>", "at )", "at ]", "at }", "at >", "@)", "@]", "@}", "@>", "@ ", "arroba", "ät", "[.", "(.", "{.", "<.")
#: Compatibility forms of ASCII letters: mathematical, circled, raised, ligatures and others.
_FORMS = "".join(c for c in map(chr, range(0x80, 0x10000)) if (x := unicodedata.normalize("NFKC", c)).isascii() and x.isalpha())
#: Those beyond U+FFFF as ranges: a set of single ones has no fast search.
_ODD = re.compile("[" + re.escape("".join(_GLYPH) + "".join(_UNSEEN) + _FORMS) + "！-～٠-٩۰-۹\U0001d400-\U0001d7ff\U0001f110-\U0001f149]")


class Tape:
    """A text with the source span of each of its characters, and which of them were rewritten: nine
    bytes a character beside the text."""

    __slots__ = ("text", "start", "end", "new")

    def __init__(self, text: str, start: array, end: array, new: bytearray):
        self.text, self.start, self.end, self.new = text, start, end, new

    @classmethod
    def of(cls, text: str) -> Tape:
        n = len(text)
        return cls(text, array("i", range(n)), array("i", range(1, n + 1)), bytearray(n))

    def rewrite(self, edits: list[tuple[int, int, str]]) -> Tape:
        """Replace [a, b) by a string, for edits in order that don't overlap. One character stands for
        the whole of what it replaces; several share it in equal steps where there are enough."""
        if not edits:
            return self
        text, start, end, new, at = [], array("i"), array("i"), bytearray(), 0
        for a, b, put in edits:
            text.append(self.text[at:a] + put)
            start += self.start[at:a]
            end += self.end[at:a]
            new += self.new[at:a]
            start += array("i", [self.start[a]]) * len(put)
            end += array("i", [self.end[b - 1]]) * len(put)
            new += b"\1" * len(put)
            if not put and new:
                new[-1] = 1
            at = b
        text.append(self.text[at:])
        return Tape("".join(text), start + self.start[at:], end + self.end[at:], new + self.new[at:])


def _characters(tape: Tape) -> Tape:
    edits = []
    for m in _ODD.finditer(tape.text):
        c = m[0]
        put = "" if c in _UNSEEN else _GLYPH.get(c) or unicodedata.normalize("NFKC", c)
        if len(put) == 1 and not put.isascii() and put.isdecimal():
            put = str(unicodedata.decimal(put))
        edits.append((m.start(), m.end(), put))
    return tape.rewrite(edits)


def _joined_digits(text: str, inner: list[re.Match]) -> list[tuple[int, int, str]]:
    """Edits that write the parts of a run as digits."""
    edits = []
    for i, m in enumerate(inner):
        gap = inner[i + 1].start() if i + 1 < len(inner) else m.end()
        # A dot between words stays: it may part an address.
        between = text[m.end() : gap]
        edits.append((m.start(), gap, _SPELLED.get(m[0].lower(), m[0]) + ("." if _PART.search(between) else "")))
    return edits


def _is_mixed(text: str) -> bool:
    """Does a spelled digit stand beside a figure? Asked from the figures, which are few."""
    return bool(_WORD_NEXT.search(text)) or any(_WORD_BEFORE.search(text[max(m.start() - 20, 0) : m.start()]) for m in _NUMBER.finditer(text))


def _digits(tape: Tape) -> Tape:
    edits = []
    for run in _RUN.finditer(tape.text):
        inner = list(_WORD_DIGIT.finditer(tape.text, run.start(), run.end()))
        if sum(len(m[0]) > 1 for m in inner) >= 4:
            edits += _joined_digits(tape.text, inner)
    tape, some = tape.rewrite(edits), bool(edits)
    if _is_mixed(tape.text):
        edits = []
        for run in _MIXED.finditer(tape.text):
            inner = list(_MIXED_PART.finditer(tape.text, run.start(), run.end()))
            if not any(m[0].lower() in _SPELLED for m in inner):
                continue
            made = _joined_digits(tape.text, inner)
            put = "".join(x[2] for x in made)
            put = "+" + put if _SIGN.search(tape.text[max(run.start() - 6, 0) : run.start()]) else put
            if any(b - a == len(put) for a, b, _ in spans_of(put)):
                edits += made
        tape, some = tape.rewrite(edits), some or bool(edits)
    return tape.rewrite([(m.start(), m.end(), "+") for m in _PLUS.finditer(tape.text)]) if some else tape


def _at_and_dot(tape: Tape) -> Tape:
    edits = [(m.start(), m.end(), "@") for m in _BRACKETED_AT.finditer(tape.text)]
    edits += [(m.start(), m.end(), ".") for m in _BRACKETED_DOT.finditer(tape.text)]
    if edits:
        edits.sort()
        kept = edits[:1]
        for x in edits[1:]:
            if x[0] >= kept[-1][1]:
                kept.append(x)
        tape = tape.rewrite(kept)
    edits = []
    for m in _BARE.finditer(tape.text):
        at = "at" if m["at"] else "sign"
        edits.append((m.start(at), m.end(at), "@"))
        edits += [(d.start(), d.end(), ".") for d in _BARE_DOT.finditer(tape.text, m.end(at), m.end())]
    return tape.rewrite(edits)


def _disguised(text: str) -> bool:
    if not text.isascii() and _ODD.search(text):
        return True
    low = text.lower()
    return any(x in low for x in _HINTS) or not _TELLING.isdisjoint(low.translate(_FLAT).split())


def find(text: str | None) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(base spans, all spans) of a text, each (start, end, kind index)."""
    if not text:
        return [], []
    base = spans_of(text)
    if not _disguised(text):
        return base, base
    tape = _at_and_dot(_digits(_characters(Tape.of(text))))
    added = []
    if 1 in tape.new:
        for a, b, kind in spans_of(tape.text):
            if 1 in tape.new[a:b]:
                s, e = tape.start[a], tape.end[b - 1]
                while s < e and text[s] == " ":
                    s += 1
                while e > s and text[e - 1] == " ":
                    e -= 1
                if not any(x < e and s < y for x, y, k in base if k == kind):
                    added.append((s, e, kind))
    return base, sorted([*base, *added], key=lambda x: (x[0], x[2]))


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in spans)


_OUT = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"


def _scan(batches):
    for batch in batches:
        counts: tuple[list[int], ...] = ([], [], [], [])
        sha, spans = [], []
        for text in batch.column("text"):
            base, every = find(text.as_py())
            for k in range(4):
                counts[k].append(sum(x[2] == k for x in every))
            sha.append(hashlib.sha256(joined(base).encode()).hexdigest())
            spans.append(joined(every))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), *(pa.array(x, pa.int64()) for x in counts), pa.array(sha, pa.string()), pa.array(spans, pa.string())], names=[x.split()[0] for x in _OUT.split(", ")])


def scan(docs: DataFrame) -> DataFrame:
    """Counts of all spans by kind, a digest of the base spans, and all spans of each document."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_scan, _OUT)


def _mask(batches):
    for batch in batches:
        out = []
        for text in batch.column("text"):
            text, (_, every) = text.as_py(), find(text.as_py())
            if every:
                parts, at = [], 0
                for a, b, k in every:
                    if a >= at:
                        parts += [text[at:a], f"<{KINDS[k]}>"]
                    at = max(at, b)
                text = "".join(parts) + text[at:]
            out.append(text)
        i = batch.schema.get_field_index("text")
        yield batch.set_column(i, batch.schema.field(i), pa.array(out, batch.schema.field(i).type))


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every span replaced by its kind in angle brackets; overlapping ones by the first's."""
    return docs.mapInArrow(_mask, docs.schema)


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
