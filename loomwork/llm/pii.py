"""Personal data with exact places: plain identifiers and disguised ones.

Plain identifiers are found in the source.  Disguises are then rewritten by a
transducer: it replaces lookalike characters, spelled digits and words for @ and
the dot, and remembers which source characters each normalised character came from.
The same detectors run over the normalised text, and what they find across a
rewritten place is mapped back to source characters.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of local part, @ and domain, in linear time: from each @ back to the start of its run."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end()
            done = domain.end()
        at = text.find("@", max(at + 1, done))


def luhn(digits: str) -> bool:
    """Whether the last digit is the check digit of the others."""
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        if k % 2:
            n = n * 2 - 9 * (n > 4)
        total += n
    return total % 10 == 0


def plain(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the identifiers that stand in a text undisguised, by start, then kind."""
    out = [("email", *s) for s in _emails(text)]
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14 and 14 <= len(d := _NOT_DIGIT.sub("", m[0])) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                out.append(("phone", *m.span()))
    return _sorted(out)


def _sorted(spans: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


# Letters of other scripts that look like Latin ones.
_LOOKALIKES = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "һ": "h",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X",
    "օ": "o", "ո": "n", "ս": "u", "հ": "h", "ց": "g", "զ": "q", "Ꭺ": "A", "Ᏼ": "B", "Ꮯ": "C", "Ꭰ": "D", "Ꭼ": "E", "Ꮐ": "G", "Ꮋ": "H",
    "Ꭻ": "J", "Ꮶ": "K", "Ꮮ": "L", "Ꮇ": "M", "Ꮲ": "P", "Ꮪ": "S", "Ꭲ": "T", "Ꮩ": "V", "Ꮃ": "W", "Ꮓ": "Z",
    "ο": "o", "α": "a", "ν": "v", "ι": "i", "κ": "k", "ρ": "p", "Α": "A", "Β": "B", "Ε": "E", "Ο": "O", "Τ": "T",
    "․": ".", "。": ".", "‐": "-", "‑": "-", "–": "-", " ": " ", " ": " ", " ": " ",
}
#: Characters without width, which disappear.
_NOTHING = "­​‌‍⁠﻿"


#: Letter-like, circled and mathematical letters: their compatibility forms are plain letters.
_STYLED = (range(0x2100, 0x2150), range(0x24B6, 0x24EA), range(0x1D400, 0x1D7CE))


def _characters() -> dict[int, str]:
    """Replacements of single characters: lookalikes, styled and full-width forms and the decimal digits of all scripts."""
    table = {ord(k): v for k, v in _LOOKALIKES.items()}
    for c in (c for r in _STYLED for c in r):
        form = unicodedata.normalize("NFKC", chr(c))
        if len(form) == 1 and (form := _LOOKALIKES.get(form, form)).isascii() and form.isalpha():
            table[c] = form
    table |= {c: chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)}
    table |= {c: str(d) for c in range(0x80, 0x1FC00) if (d := unicodedata.decimal(chr(c), None)) is not None}
    return table | {ord(c): "" for c in _NOTHING}


_CHARACTERS = _characters()
_UNUSUAL = re.compile("[^\x00-\x7f\xc0-\xff]")
_LOOKS = re.compile("[" + "".join(map(re.escape, map(chr, sorted(_CHARACTERS)))) + "]")

# Words for the digits in the four languages, and for @ and the dot.
_DIGITS = {
    "zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}
_AT_WORDS = "at|arobase|arroba"
_DOT_WORDS = "dot|punkt|point|punto"
_PLUS_WORDS = "plus|más"

_OPEN, _CLOSE = r"[\[({<]", r"[\])}>]"
_AT = rf"(?:[ ]?{_OPEN}[ ]?(?:{_AT_WORDS}|@)[ ]?{_CLOSE}[ ]?|[ ]+(?:{_AT_WORDS})[ ]+|[ ]+@[ ]+)"
_DOT = rf"(?:[ ]?{_OPEN}[ ]?(?:{_DOT_WORDS}|\.)[ ]?{_CLOSE}[ ]?|[ ]+(?:{_DOT_WORDS})[ ]+)"
_NAME = r"[A-Za-z0-9_%+-]+"
#: An address is names, an at-sign and labels.  They are matched one after the other: names that no at-sign follows are passed over as a whole.
_NAMES = re.compile(rf"(?<![A-Za-z0-9._%+-]){_NAME}(?:(?:{_DOT}|\.){_NAME})*", re.IGNORECASE)
_SIGN = re.compile(_AT, re.IGNORECASE)
_DOT_AT = re.compile(rf"(?<=[ ])(?:{_DOT_WORDS})[ ]+(?:{_AT_WORDS})\Z", re.IGNORECASE)
_LABELS = re.compile(rf"[A-Za-z0-9-]+(?:(?:{_DOT}|\.)[A-Za-z0-9-]+)+", re.IGNORECASE)
_HALF = re.compile(rf"(?<![A-Za-z0-9._%+-]){_NAME}(?:\.{_NAME})*@[A-Za-z0-9-]+(?:(?:{_DOT}|\.)[A-Za-z0-9-]+)*{_DOT}[A-Za-z0-9-]+", re.IGNORECASE)
_PART = re.compile(rf"(?P<at>{_AT})|(?P<dot>{_DOT})", re.IGNORECASE)
_BRACKETED = re.compile(rf"{_OPEN}[ ]?(?:{_AT_WORDS}|@|{_DOT_WORDS}|\.)[ ]?{_CLOSE}", re.IGNORECASE)
#: Dots between groups of digits.
_DOTTED = re.compile(rf"(?<=[0-9]){_DOT}(?=[0-9])", re.IGNORECASE)
#: Stands in every match of the three patterns that gets edits: a bare word for @ counts only beside a disguised dot.
_MAY_DISGUISE = re.compile(rf"{_BRACKETED.pattern}|[ ](?:{_DOT_WORDS})[ ]|[ ]@[ ]", re.IGNORECASE)
# Last labels of addresses that are written out in words only.
_LAST = frozenset("com org net edu gov mil int info biz io ai co me tv eu uk us de fr es it nl pl pt ch at be se no dk fi ie ca au nz jp cn in br mx ar ru example test invalid".split())

_NUMBER = "|".join(sorted(_DIGITS, key=len, reverse=True))
_SPELLED_DIGIT, _STEP = rf"\b(?:{_NUMBER})\b", rf"(?:[ ,-]+|[ ]*\.[ ]*|{_DOT})"
_SPELLED = re.compile(rf"(?:\b(?:{_PLUS_WORDS})[ -]+|\+[ ]?)?\b(?:{_SPELLED_DIGIT}|[0-9]+)(?:{_STEP}(?:{_SPELLED_DIGIT}|[0-9]+))*", re.IGNORECASE)
#: Stands in every match of _SPELLED that is of use: no identifier is one word, so a spelled digit has a neighbour.
_MAY_SPELL = re.compile(rf"{_SPELLED_DIGIT}{_STEP}(?:{_SPELLED_DIGIT}|[0-9])|[0-9]{_STEP}{_SPELLED_DIGIT}", re.IGNORECASE)
_SPELLED_PART = re.compile(rf"(?P<plus>\b(?:{_PLUS_WORDS})[ -]+)|(?P<digit>{_SPELLED_DIGIT})|(?P<dot>{_DOT})|(?P<gap>[ ,-]+)", re.IGNORECASE)

Edit = tuple[int, int, str]


class Rewritten:
    """A text after edits (start, end, replacement) that don't overlap, with the way back to its source."""

    def __init__(self, text: str, edits: list[Edit]):
        self.edits = sorted(edits)
        out, self._new, self._old, at, size = [], [], [], 0, 0
        for start, end, new in self.edits:
            out += [text[at:start], new]
            size += start - at
            self._new.append((size, size + len(new)))
            self._old.append((start, end))
            size += len(new)
            at = end
        self.text = "".join([*out, text[at:]])
        self._starts = [a for a, _ in self._new]

    def touches(self, start: int, end: int) -> bool:
        """Whether a span of the new text has an edited place in it."""
        k = bisect_right(self._starts, start) - 1
        return any(a < end and b > start or start < a < end for a, b in self._new[max(k, 0) : bisect_right(self._starts, end) + 1])

    def source(self, start: int, end: int) -> tuple[int, int]:
        """The span of the source that a span of the new text came from."""
        return self._back(start, False), self._back(end, True)

    def _back(self, place: int, is_end: bool) -> int:
        k = bisect_right(self._starts, place - is_end) - 1
        if k < 0:
            return place
        (_, new_end), (old_start, old_end) = self._new[k], self._old[k]
        if place < new_end or is_end and place == new_end:
            return old_end if is_end else old_start
        return old_end + place - new_end


def _character_edits(text: str) -> list[Edit]:
    if text.isascii() or not _UNUSUAL.search(text):
        return []
    return [(m.start(), m.end(), _CHARACTERS[ord(m[0])]) for m in _LOOKS.finditer(text)]


def _addresses(text: str) -> Iterator[tuple[int, int]]:
    """Spans of names, a disguised at-sign and labels, from left to right and apart, in linear time."""
    at = 0
    while names := _NAMES.search(text, at):
        at = names.end()
        if (sign := _SIGN.match(text, at)) and (labels := _LABELS.match(text, sign.end())):
            at = labels.end()
            yield names.start(), at
        elif word := _DOT_AT.search(text, names.start() + 1, at):
            at = word.start()  # "dot at": the dot may be the name


def _address_edits(text: str) -> list[Edit]:
    if not _MAY_DISGUISE.search(text):
        return []
    out = [(*m.span(), ".") for m in _DOTTED.finditer(text)]
    for start, end in [*_addresses(text), *(m.span() for m in _HALF.finditer(text))]:
        parts, whole = list(_PART.finditer(text, start, end)), text[start:end]
        bare_at = next((p for p in parts if p["at"] and not _BRACKETED.search(p[0]) and "@" not in p[0]), None)
        if bare_at and not _BRACKETED.search(whole):
            # "meet at example.com" is no address, nor is every "at ... dot ..."
            if not any(p["dot"] for p in parts) or re.split(r"[ .]+", whole)[-1].lower() not in _LAST:
                continue
        out += [(*p.span(), "@" if p["at"] else ".") for p in parts]
    return _apart(out)


def _apart(edits: list[Edit]) -> list[Edit]:
    out: list[Edit] = []
    for e in sorted(set(edits)):
        if not out or e[0] >= out[-1][1]:
            out.append(e)
    return out


def _digit_edits(text: str) -> list[Edit]:
    if not _MAY_SPELL.search(text):
        return []
    out = []
    for m in _SPELLED.finditer(text):
        parts = list(_SPELLED_PART.finditer(text, m.start(), m.end()))
        if not any(p["digit"] for p in parts):
            continue
        for p in parts:
            new = "+" if p["plus"] else _DIGITS[p[0].lower()] if p["digit"] else "." if p["dot"] else ""
            out.append((*p.span(), new))
    return out


def disguised(text: str, found: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Identifiers that only a normalised text shows, as spans of the source.

    The detectors run after each rewriting, so that a later one hides nothing.  Of
    spans of one kind that overlap the longest counts; those that overlap found ones
    of their kind count only if they hold them and more.
    """
    steps: list[Rewritten] = []
    now, shown = text, set()
    for edits in (_character_edits, _address_edits, _digit_edits):
        made = edits(now)
        if not made:
            continue
        steps.append(Rewritten(now, made))
        now = steps[-1].text
        for kind, start, end in plain(now):
            touched = False
            for step in reversed(steps):
                touched = touched or step.touches(start, end)
                start, end = step.source(start, end)
            if touched:
                shown.add((kind, start, end))
    known = {k: _Apart() for k in KINDS}
    for kind, start, end in found:
        known[kind].add(start, end)
    taken = {k: _Apart() for k in KINDS}
    for kind, start, end in sorted(shown, key=lambda s: (s[1] - s[2], s)):
        longer = all(start <= a and b <= end and (a, b) != (start, end) for a, b in known[kind].over(start, end))
        if longer and not taken[kind].over(start, end):
            taken[kind].add(start, end)
    return _sorted([(k, start, end) for k, spans in taken.items() for start, end in spans])


class _Apart:
    """Spans that don't overlap, in order."""

    def __init__(self) -> None:
        self._starts: list[int] = []
        self._ends: list[int] = []

    def add(self, start: int, end: int) -> None:
        k = bisect_right(self._starts, start)
        self._starts.insert(k, start)
        self._ends.insert(k, end)

    def over(self, start: int, end: int) -> list[tuple[int, int]]:
        """The spans that overlap one."""
        first, last = bisect_right(self._ends, start), bisect_left(self._starts, end)
        return list(zip(self._starts[first:last], self._ends[first:last], strict=True))

    def __iter__(self) -> Iterator[tuple[int, int]]:
        return iter(zip(self._starts, self._ends, strict=True))


_OUT = "doc_id long, base array<struct<kind:string,start:int,end:int>>, added array<struct<kind:string,start:int,end:int>>"


def _searched(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    def rows(spans: list[tuple[str, int, int]]) -> list[dict]:
        return [{"kind": k, "start": a, "end": b} for k, a, b in spans]

    for batch in batches:
        base = [plain(t or "") for t in batch["text"]]
        added = [disguised(t or "", b) for t, b in zip(batch["text"], base, strict=True)]
        yield pd.DataFrame({"doc_id": batch["doc_id"], "base": [rows(b) for b in base], "added": [rows(a) for a in added]})


def personal_data(documents: DataFrame) -> DataFrame:
    """doc_id, base and added: the plain and the disguised identifiers of every row, as kind, start and end in code points.

    Whole texts are searched; a null text counts as empty.  A null doc_id stays
    null and repeated rows give repeated rows.  Columns other than doc_id and text
    are not read.  An empty table gives an empty result.
    """
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInPandas(_searched, _OUT)


def digest(found: DataFrame) -> DataFrame:
    """Counts and digests of personal_data: n_* and base_sha256 of the plain identifiers, spans of all."""
    order = F.array(*[F.lit(k) for k in KINDS])

    def joined(spans: F.Column) -> F.Column:
        keyed = F.transform(spans, lambda s: F.struct(s["start"].alias("a"), F.array_position(order, s["kind"]).alias("k"), s["end"].alias("b"), s["kind"].alias("kind")))
        text = F.transform(F.array_sort(keyed), lambda s: F.concat_ws(":", s["kind"], s["a"].cast("string"), s["b"].cast("string")))
        return F.array_join(text, ",")

    def count(kind: str) -> F.Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(kind) for kind in KINDS]
    return found.select(
        "doc_id", *counts, F.sha2(joined(F.col("base")), 256).alias("base_sha256"),
        joined(F.concat("base", "added")).alias("spans"), F.size("added").cast("long").alias("n_disguised"),
    )
