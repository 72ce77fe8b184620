"""Personal data, plain and disguised, with offsets into the text as it stands.

Plain spans are found on the text itself. Then transducers rewrite the text: look-alike letters and digits become the plain ones,
invisible characters vanish, spelled digits become digits, and spelled or bracketed "at" and "dot", in any case, become ``@`` and ``.``:
either of them in addresses, "dot" also between the numbers of an ip. Each keeps, for every character it writes, where that character
came from. What is found in the rewritten text is mapped back through these
offsets and added unless a plain span of its kind already holds it. All searches are linear in the text.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_right
from functools import lru_cache

from pyspark.sql import DataFrame

from panelstone.llm.common import arrow_map, pick

KINDS = ("email", "ip", "card", "phone")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")

# Letters of other scripts that look like Latin ones.
LOOKALIKES = dict(
    zip("аеорсухіјѕԁһԛԝвкмнтгпАВЕКМНОРСТХІЈЅαορνικτυχΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "aeopcyxijsdhqwbkmhtrnABEKMHOPCTXIJSaopviktuxABEZHIKMNOPTYX", strict=True)
)
INVISIBLE = "​‌‍⁠﻿­"
DIGIT_WORDS = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "fuenf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
}
DIGIT_WORDS |= {unicodedata.normalize("NFD", word): digit for word, digit in DIGIT_WORDS.items()}
# Address suffixes that make a bare "at ... dot ..." an address rather than prose.
SUFFIXES = frozenset("com org net edu gov info biz io dev app example test de fr es uk it nl at ch eu us ca".split())
# A run of at least four number words: shorter ones are ordinary prose.
_SPELLED_WORD = "|".join(sorted(DIGIT_WORDS, key=len, reverse=True))
_SPELLED = re.compile(rf"\b(?:plus[ -])?(?:{_SPELLED_WORD})(?:[ ,-]{{1,2}}(?:{_SPELLED_WORD})){{3,}}\b", re.IGNORECASE)
_SPELLED_PART = re.compile(rf"plus|{_SPELLED_WORD}|[ ,-]+", re.IGNORECASE)
_AT, _DOT = "[Aa][Tt]", "[Dd][Oo][Tt]"
_MARK_AT = rf"(?: ?[\[({{<] ?(?:{_AT}|@) ?[\])}}>] ?| {_AT} )"
_MARK_DOT = rf"(?: ?[\[({{<] ?(?:{_DOT}|\.) ?[\])}}>] ?| {_DOT} )"
_BRACKETED = re.compile(rf"[\[({{<] ?(?:{_AT}|@|{_DOT}|\.) ?[\])}}>]")
_BARE_DOT = re.compile(rf" {_DOT} ")
# An address with any of its marks spelled or bracketed; the bare word "at" counts only where a "dot" follows the next word.
_ADDRESS = re.compile(
    rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{{1,64}}(?:{_MARK_AT}|@)(?P<domain>[A-Za-z0-9-]{{1,63}}(?:(?:{_MARK_DOT}|\.)[A-Za-z0-9-]{{1,63}})+)"
)
_NUMBERS = re.compile(rf"(?<![0-9])[0-9]+(?:(?:{_MARK_DOT}|\.)[0-9]+){{3}}")
_MARK = re.compile(rf"({_MARK_AT})|({_MARK_DOT})")


@lru_cache(maxsize=1)
def single_forms() -> dict[int, str]:
    """Characters written as one plain ASCII letter, digit or sign: compatibility forms by rule, look-alikes by table."""
    plain = {}
    for low, high in ((0xFF01, 0xFF5F), (0x1D400, 0x1D800), (0x2460, 0x24EB), (0x0660, 0x066A), (0x06F0, 0x06FA), (0x2010, 0x2016), (0x3002, 0x3003)):
        for code in range(low, high):
            form = unicodedata.normalize("NFKC", chr(code))
            value = unicodedata.decimal(chr(code), None)
            form = str(value) if value is not None else "-" if 0x2010 <= code < 0x2016 else "." if code == 0x3002 else form
            if len(form) == 1 and form.isascii() and form.isprintable():
                plain[code] = form
    return plain | {ord(x): y for x, y in LOOKALIKES.items()} | {ord(x): "" for x in INVISIBLE}


@lru_cache(maxsize=1)
def odd_characters() -> frozenset[str]:
    return frozenset(map(chr, single_forms()))


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Found from the ``@``: the name part is all of the name characters before it that no earlier match holds."""
    out, done = [], 0
    if "@" in text:
        for m in _DOMAIN.finditer(text):
            start = m.start()
            while start > done and text[start - 1] in _LOCAL:
                start -= 1
            if start < m.start():
                out.append((start, m.end()))
                done = m.end()
    return out


def ips(text: str) -> list[tuple[int, int]]:
    small = lambda x: len(y := x.lstrip("0")) < 3 or (len(y) == 3 and int(y) <= 255)
    return [m.span() for m in _IP.finditer(text) if all(map(small, m.groups()))]


def cards(text: str) -> list[tuple[int, int]]:
    out = []
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = "".join(_DIGIT.findall(m.group()))
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append(m.span())
    return out


def phones(text: str) -> list[tuple[int, int]]:
    if "+" not in text:
        return []
    return [m.span() for m in _PHONE.finditer(text) if 10 <= len(_DIGIT.findall(m.group())) <= 15]


FIND = {"email": emails, "ip": ips, "card": cards, "phone": phones}


def plain_spans(text: str) -> list[tuple[int, int, str]]:
    """Spans of the plain forms by start, then kind as listed."""
    if not _DIGIT.search(text) and "@" not in text:
        return []
    found = [(start, k, end, kind) for k, kind in enumerate(KINDS) for start, end in FIND[kind](text)]
    return [(start, end, kind) for start, _, end, kind in sorted(found)]


class Rewritten:
    """A text and, for each of its characters, the first and the end offset of what it stands for in the source."""

    def __init__(self, text: str):
        self.text, self.first, self.end = text, range(len(text)), range(1, len(text) + 1)

    def replace(self, edits: list[tuple[int, int, str]]) -> None:
        """Apply disjoint edits in order; every character written stands for the whole stretch it replaces."""
        text, first, end, at = [], [], [], 0
        for a, b, new in [*edits, (len(self.text), len(self.text), "")]:
            text.append(self.text[at:a]), first.extend(self.first[at:a]), end.extend(self.end[at:a])
            if new:
                text.append(new), first.extend([self.first[a]] * len(new)), end.extend([self.end[b - 1]] * len(new))
            at = b
        self.text, self.first, self.end = "".join(text), first, end

    def source(self, start: int, stop: int) -> tuple[int, int]:
        return self.first[start], self.end[stop - 1]


def look_alikes(r: Rewritten) -> bool:
    if r.text.isascii():
        return False
    if odd_characters().isdisjoint(r.text):
        return False
    odd, forms = odd_characters(), single_forms()
    r.replace([(i, i + 1, forms[ord(x)]) for i, x in enumerate(r.text) if x in odd])
    return True


def spelled_digits(r: Rewritten) -> bool:
    edits = []
    # The inner words of a run of four stand between separators, so splitting at these shows one of them.
    if DIGIT_WORDS.keys().isdisjoint(r.text.lower().replace("-", " ").replace(",", " ").split()):
        return False
    for m in _SPELLED.finditer(r.text):
        for part in _SPELLED_PART.finditer(r.text, m.start(), m.end()):
            word = part.group().lower()
            edits.append((*part.span(), "+" if word == "plus" else DIGIT_WORDS.get(word, "")))
    if edits:
        r.replace(edits)
    return bool(edits)


def address_marks(text: str) -> list[tuple[int, int, str]]:
    edits = []
    for m in _ADDRESS.finditer(text):
        marks = list(_MARK.finditer(text, m.start(), m.end()))
        at = marks[0] if marks and marks[0].group(1) else None
        if at and at.group().strip().isalpha():
            if len(marks) == 1 or text[marks[-1].end() : m.end()].lower() not in SUFFIXES:
                continue
        elif not at:
            # After a plain address the bare word "dot" may go on with the sentence.
            end = m.end()
            while marks and marks[-1].group().strip().isalpha():
                whole = len(marks) > 1 or "." in text[m.start("domain") : marks[-1].start()]
                if not whole or text[marks[-1].end() : end].rpartition(".")[2].lower() in SUFFIXES:
                    break
                end = marks.pop().start()
        edits += [(*x.span(), "@" if x.group(1) else ".") for x in marks]
    return edits


def ip_marks(text: str) -> list[tuple[int, int, str]]:
    return [(*x.span(), ".") for m in _NUMBERS.finditer(text) for x in _MARK.finditer(text, m.start(), m.end())]


def spelled_marks(r: Rewritten) -> bool:
    if not _BRACKETED.search(r.text) and not ("dot" in r.text.lower() and _BARE_DOT.search(r.text)):
        return False
    changed = False
    for marks in (address_marks, ip_marks):
        if edits := marks(r.text):
            r.replace(edits)
            changed = True
    return changed


def all_spans(text: str) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """Plain spans, and these with the disguised ones added."""
    base = plain_spans(text)
    r = Rewritten(text)
    if not any([step(r) for step in (look_alikes, spelled_digits, spelled_marks)]):
        return base, base
    held: dict[str, list[tuple[int, int]]] = {k: [(a, b) for a, b, kind in base if kind == k] for k in KINDS}
    found = [(start, KINDS.index(kind), end, kind) for start, end, kind in base]
    for start, stop, kind in plain_spans(r.text):
        a, b = r.source(start, stop)
        if not _holds(held[kind], a, b):
            found.append((a, KINDS.index(kind), b, kind))
    return base, [(start, end, kind) for start, _, end, kind in sorted(found)]


def _holds(spans: list[tuple[int, int]], a: int, b: int) -> bool:
    """Does one of the disjoint, ordered spans hold ``a:b``?"""
    i = bisect_right(spans, (a, float("inf")))
    return i > 0 and spans[i - 1][1] >= b


def written(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def find_pii(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_disguised`` for every row.

    The counts and the digest are of the plain spans; ``spans`` lists all of them as ``kind:start:end`` in code points, end exclusive.
    A null or empty text has no spans. Rows are independent: repeated rows repeat their results, null ids stay null, an empty table
    gives an empty result.
    """
    rows = pick(df, doc_id=id_col, text=text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()

    def work(cols):
        out = {x: [] for x in ("doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans", "n_disguised")}
        for doc_id, text in zip(cols["doc_id"], cols["text"], strict=True):
            base, every = all_spans(text or "")
            counts = [sum(k == x[2] for x in base) for k in KINDS]
            digest = hashlib.sha256(written(base).encode()).hexdigest()
            for name, value in zip(out, (doc_id, *counts, digest, written(every), len(every) - len(base)), strict=True):
                out[name].append(value)
        return out

    return arrow_map(rows, work, f"doc_id {kind}, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string, n_disguised long")


def mask(text: str | None) -> str | None:
    """The text with every span replaced by its kind in brackets; overlapping spans become one, named after the first."""
    if not text:
        return text
    merged: list[list] = []
    for start, end, kind in all_spans(text)[1]:
        if merged and start < merged[-1][1]:
            merged[-1][1] = max(end, merged[-1][1])
        else:
            merged.append([start, end, kind])
    out, at = [], 0
    for start, end, kind in merged:
        out += [text[at:start], f"[{kind}]"]
        at = end
    return "".join([*out, text[at:]])


def mask_pii(df: DataFrame, text_col: str = "text", length_col: str | None = None) -> DataFrame:
    """``df`` with masked texts; ``length_col``, if named, gets the new number of characters. All rows and columns stay.

    Null and empty texts stay as they are, a null text with its old length.
    """
    names = df.columns

    def work(cols):
        cols = {x: cols[x] for x in names}
        cols[text_col] = [mask(t) for t in cols[text_col]]
        if length_col:
            cols[length_col] = [old if t is None else len(t) for old, t in zip(cols[length_col], cols[text_col], strict=True)]
        return cols

    return arrow_map(df, work, df.schema)
