"""Personal data with offset-preserving deobfuscation.

Base identifiers (e-mail, IP, card, phone) are found in the text as it is.  Then
transducers rewrite disguises - look-alike letters and digits, invisible characters,
spelled digits, "at" and "dot" - and keep, for each character of the rewritten text, the
source span it came from.  Identifiers found in the rewritten text are mapped back; those
that rest on a rewritten character are added, unless they overlap a base span that they
do not enclose.

Defined cases: a null text counts as an empty one; rows repeat in the result as they do
in the input; other columns are ignored.  Whole texts are searched; every scan is linear.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_right

from pyspark.sql import DataFrame, functions as F

KINDS = ("email", "ip", "card", "phone")

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def _luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        x = int(c) * (1 + k % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def identifiers(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base identifiers, leftmost and without overlap in each kind."""
    found = []
    if "@" in text:
        free = 0
        for m in _DOMAIN.finditer(text):
            s = at = m.start()
            while s > free and text[s - 1] in _LOCAL:
                s -= 1
            if s < at:
                found.append((s, m.end(), "email"))
                free = m.end()
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            found.append((m.start(), m.end(), "ip"))
    for m in _CARD.finditer(text):
        d = _digits(m[0])
        if 12 <= len(d) <= 19 and _luhn(d):
            found.append((m.start(), m.end(), "card"))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_digits(m[0])) <= 15:
                found.append((m.start(), m.end(), "phone"))
    return sorted(found, key=lambda x: (x[0], KINDS.index(x[2])))


# Cyrillic and Greek letters that look like a Latin one, and what they look like.
LOOKALIKES = dict(zip("аеорсухіјѕԁһվАВЕКМНОРСТХІЈЅαοιρνυκΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "aeopcyxijsdhuABEKMHOPCTXIJSaoipvukABEZHIKMNOPTYX", strict=True))
INVISIBLE = "­​‌‍⁠﻿"
DOTS = "。｡․·"
DASHES = "‐‑‒–—−"
SPACES = "      "
SPELLED = {"zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9", "oh": "0"}


def _char_table() -> dict[str, str]:
    table = LOOKALIKES | dict.fromkeys(INVISIBLE, "") | dict.fromkeys(DOTS, ".") | dict.fromkeys(DASHES, "-") | dict.fromkeys(SPACES, " ")
    table |= {chr(c): chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)}  # full-width forms
    for c in range(0x660, 0x10000):  # decimal digits of any script
        if (d := unicodedata.decimal(chr(c), None)) is not None and c not in range(0xFF01, 0xFF5F):
            table[chr(c)] = str(d)
    return table


_CHARS = _char_table()
_CHAR = re.compile("[" + "".join(map(re.escape, _CHARS)) + "]")
_WORD = "|".join(SPELLED)
_SPELLED_RUN = re.compile(rf"(?<![A-Za-z0-9])(?:plus[\x20-]+)?(?:{_WORD}|[0-9]+)(?:[\x20,.-]{{1,2}}(?:{_WORD}|dot|point|[0-9]+))*[\x20,.-]{{1,2}}(?:{_WORD}|[0-9]+)(?![A-Za-z0-9])", re.I)
_SPELLED_ANY = re.compile(rf"(?<![A-Za-z])(?:{_WORD})[\x20,.-]{{1,2}}(?:{_WORD}|dot|point)(?![A-Za-z])", re.I)
_TOKEN = re.compile(rf"{_WORD}|dot|point|plus|[0-9]+|[\x20,.-]+", re.I)
_BRACKETED = re.compile(r"[\x20]{0,2}[\[({<][\x20]{0,2}(at|@|dot|\.)[\x20]{0,2}[\])}>][\x20]{0,2}", re.I)
_BARE = re.compile(r"(?<=[A-Za-z0-9._%+-])(\x20at\x20|\x20@\x20|@)([A-Za-z0-9-]+(?:(?:\x20dot\x20|\x20\.\x20|\.)[A-Za-z0-9-]+)+)", re.I)
_NUMBER_DOT = re.compile(r"(?<=[0-9])\x20(?:dot|point)\x20(?=[0-9])", re.I)
# Top-level domains that may end a bare "at ... dot ..." address.
ENDINGS = frozenset("com org net edu gov mil int info biz io ai co dev app me tv uk de fr es it nl eu us ca au jp cn in br ru ch at be se no dk fi pl pt example test".split())
_BARE_DOT = re.compile(r"\x20(?:dot|\.)\x20", re.I)


class Rewritten:
    """A text with its source offsets: pieces of (place in the text, source start, source end, kept as it is)."""

    def __init__(self, text: str):
        self.text = text
        self.at, self.frm, self.to, self.plain = [0], [0], [len(text)], [True]

    def _piece(self, i: int) -> int:
        return bisect_right(self.at, i) - 1

    def source(self, start: int, end: int) -> tuple[int, int]:
        """The source span of text[start:end]."""
        a, b = self._piece(start), self._piece(end - 1)
        s = self.frm[a] + (start - self.at[a] if self.plain[a] else 0)
        e = self.frm[b] + (end - self.at[b]) if self.plain[b] else self.to[b]
        return s, e

    def touched(self, start: int, end: int) -> bool:
        """Whether anything in text[start:end] was rewritten or left out."""
        a, b = self._piece(start), self._piece(end - 1)
        s, e = self.source(start, end)
        return not all(self.plain[a : b + 1]) or e - s != end - start

    def replace(self, edits: list[tuple[int, int, str]]) -> None:
        """Applies (start, end, replacement) in order of place, without overlap."""
        if not edits:
            return
        out, at, frm, to, plain, n, i = [], [], [], [], [], 0, 0

        def keep(i: int, j: int) -> None:
            nonlocal n
            while i < j:
                p = self._piece(i)
                stop = min(j, self.at[p + 1] if p + 1 < len(self.at) else len(self.text))
                at.append(n)
                plain.append(self.plain[p])
                frm.append(self.frm[p] + (i - self.at[p] if self.plain[p] else 0))
                to.append(self.frm[p] + stop - self.at[p] if self.plain[p] else self.to[p])
                out.append(self.text[i:stop])
                n += stop - i
                i = stop

        for s, e, new in edits:
            keep(i, s)
            if new:
                a, b = self.source(s, e)
                at.append(n)
                frm.append(a)
                to.append(b)
                plain.append(False)
                out.append(new)
                n += len(new)
            i = e
        keep(i, len(self.text))
        self.text = "".join(out)
        self.at, self.frm, self.to, self.plain = at, frm, to, plain


def _number_edits(text: str) -> list[tuple[int, int, str]]:
    """Spelled digits of a run, and the words for dot and plus inside it."""
    edits = []
    for run in _SPELLED_RUN.finditer(text):
        if not re.search(_WORD, run[0], re.I) or sum(len(m[0]) if m[0][0].isdigit() else m[0].lower() in SPELLED for m in _TOKEN.finditer(run[0])) < 4:
            continue
        dotted = len(re.findall("dot|point", run[0], re.I)) == 3  # as in an address of four parts
        for m in _TOKEN.finditer(run[0]):
            word, s, e = m[0].lower(), run.start() + m.start(), run.start() + m.end()
            if word in SPELLED:
                edits.append((s, e, SPELLED[word]))
            elif word in ("dot", "point"):
                edits.append((s, e, "."))
            elif word == "plus":
                edits.append((s, e, "+"))
            elif "," in word:
                edits.append((s, e, " "))
            elif dotted and word.isspace():
                edits.append((s, e, ""))
    return edits


def _tighten(text: str) -> list[tuple[int, int, str]]:
    """No blanks around dots between digits, after spelled numbers were rewritten; none after a plus."""
    edits = [(m.start(), m.end(), ".") for m in re.finditer(r"(?<=[0-9])\x20?\.\x20?(?=[0-9])", text) if len(m[0]) > 1]
    edits += [(m.start(), m.end(), "") for m in re.finditer(r"(?<=\+)[\x20-](?=[0-9])", text)]
    return sorted(edits)


def _address_edits(text: str) -> list[tuple[int, int, str]]:
    return [(m.start(), m.end(), "@" if m[1].lower() in ("at", "@") else ".") for m in _BRACKETED.finditer(text)]


def _bare_edits(text: str) -> list[tuple[int, int, str]]:
    """Bare " at " and " dot ", where both stand as in an address."""
    edits = []
    for m in _BARE.finditer(text):
        dots = [d.span() for d in _BARE_DOT.finditer(text, m.start(2), m.end(2))]
        if not dots or re.split(r"[\x20.]+", m[2])[-1].lower() not in ENDINGS:
            continue
        if m[1] != "@":
            edits.append((m.start(1), m.end(1), "@"))
        edits += [(s, e, ".") for s, e in dots]
    return edits


def deobfuscated(text: str) -> Rewritten | None:
    """The rewritten text, None if no transducer has anything to rewrite."""
    r = Rewritten(text)
    if not text.isascii():
        r.replace([(m.start(), m.end(), _CHARS[m[0]]) for m in _CHAR.finditer(text)])
    low = r.text.lower() if len(r.text.lower()) == len(r.text) else r.text
    if _BRACKETED.search(low):
        r.replace(_address_edits(r.text))
    if " dot " in low or " . " in low:
        r.replace(_bare_edits(r.text))
    if _NUMBER_DOT.search(low):
        r.replace([(m.start(), m.end(), ".") for m in _NUMBER_DOT.finditer(r.text)])
    if _SPELLED_ANY.search(low):
        r.replace(_number_edits(r.text))
        r.replace(_tighten(r.text))
    return None if len(r.plain) == 1 and r.plain[0] else r


def spans(text: str) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """Base spans, and all spans: the base ones and those that deobfuscation adds."""
    base = identifiers(text)
    if (r := deobfuscated(text)) is None:
        return base, base
    added = []
    for s, e, kind in identifiers(r.text):
        if r.touched(s, e):
            a, b = r.source(s, e)
            if all(b <= x or a >= y or (a <= x and y <= b and k == kind and (a, b) != (x, y)) for x, y, k in base):
                added.append((a, b, kind))
    return base, sorted({*base, *added}, key=lambda x: (x[0], KINDS.index(x[2]), x[1]))


def joined(found: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{s}:{e}" for s, e, kind in found)


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_<kind> (base spans), base_spans, spans (all) and n_added."""

    def find(batches):
        import pyarrow as pa

        for batch in batches:
            counts, base, every, added = [], [], [], []
            for text in batch.column(1).to_pylist():
                b, a = spans(text or "")
                counts.append([sum(x[2] == k for x in b) for k in KINDS])
                base.append(joined(b))
                every.append(joined(a))
                added.append(len(a) - len(b))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array([c[k] for c in counts], pa.int64()) for k in range(len(KINDS))), pa.array(base, pa.string()), pa.array(every, pa.string()), pa.array(added, pa.int64())],
                names=["doc_id", *(f"n_{k}" for k in KINDS), "base_spans", "spans", "n_added"],
            )

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(find, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_spans string, spans string, n_added long")


def digest(spans_text: str) -> str:
    return hashlib.sha256(spans_text.encode()).hexdigest()
