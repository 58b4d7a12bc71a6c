"""Personal data with exact places, also where it is disguised.

Plain identifiers are found by fixed patterns in the text itself. Disguised ones are
found by transducers that rewrite the text and remember, for every character written, which
source characters it stands for:

* look-alike letters, full-width and other decimal digits, typographic dashes, dots and spaces
  become ASCII, invisible characters go;
* spelled digits become digits, and white space, a comma or another sign between two of them goes; "plus"
  before one becomes "+";
* "at" and "dot", bracketed with white space of any kind and length around them, or as words between
  spaces, become "@" and ".".

The same patterns then run on the rewritten text, and matches that hold something
rewritten are mapped back to source spans. Such a span is added unless it is equal to or inside
a plain one of its kind; one that only holds or overlaps plain ones stands beside them. To leave ordinary prose alone, an "at" without brackets counts only in an
address whose dots are disguised too, and a disguised address must end in letters. A spaced
dot before a capitalised word ends a sentence where the address is whole without it, and
always after such an "at". No test is made beforehand: what can be rewritten is, in every text.

Texts are scanned whole, row by row, with nothing shuffled. Null texts count as empty;
texts without findings give zero counts and empty span lists; repeated rows are scanned
one by one; an empty table gives an empty result. Only the columns asked for are read,
others may have any name.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from array import array
from bisect import bisect_right
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W

KINDS = ("email", "ip", "card", "phone")

# fixed patterns of the plain findings
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
# a match can only begin where a run of digits does; saying so keeps long runs linear
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

_DIGIT = re.compile("[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = ord(c) - 48
        if i % 2:
            n = 2 * n - 9 if n > 4 else 2 * n
        total += n
    return total % 10 == 0


def _valid(kind: str, found: str) -> bool:
    if kind == "ip":
        return all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in found.split("."))
    if kind == "email":
        return True
    digits = "".join(_DIGIT.findall(found))
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits)
    return 9 <= len(digits) <= 15


def _emails(text: str, passed: Callable[[int, int], bool] | None = None) -> list[tuple[int, int]]:
    """What EMAIL.finditer gives; looks only where an @ stands. Those ``passed`` over take up nothing."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        m = EMAIL.match(text, start) if start < at else None
        if m and not (passed and passed(*m.span())):
            out.append(m.span())
            end = m.end()
        at = text.find("@", max(end, at + 1))
    return out


def base_spans(text: str, passed: Callable[[int, int], bool] | None = None) -> list[Span]:
    """Plain findings, by kind and place."""
    out: list[Span] = [("email", a, b) for a, b in _emails(text, passed)]
    if not _DIGIT.search(text):
        return out
    for kind, pattern in (("ip", IP), ("card", CARD), ("phone", PHONE)):
        out += [(kind, m.start(), m.end()) for m in pattern.finditer(text) if _valid(kind, m.group())]
    return out


#: Latin letters and the Cyrillic and Greek letters that look like them (fixed values)
LOOKALIKES = {
    "a": "а", "c": "с", "d": "ԁ", "e": "е", "h": "һ", "i": "іι", "j": "ј", "k": "κ", "l": "ӏ", "o": "оο",
    "p": "рρ", "q": "ԛ", "s": "ѕ", "u": "υ", "v": "νѵ", "w": "ԝ", "x": "хχ", "y": "уγ",
    "A": "АΑ", "B": "ВΒ", "C": "СϹ", "E": "ЕΕ", "H": "НΗ", "I": "ІΙ", "J": "Ј", "K": "КΚ", "M": "МΜ",
    "N": "Ν", "O": "ОΟ", "P": "РΡ", "S": "Ѕ", "T": "ТΤ", "X": "ХΧ", "Y": "УΥ", "Z": "Ζ",
    "@": "﹫", ".": "․。｡﹒", "-": "‐‑‒–—−﹣", "+": "﹢",
}
INVISIBLE = "­​‌‍⁠﻿"
DIGITS = ("zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine")

_LETTER = {other: letter for letter, others in LOOKALIKES.items() for other in others}


@lru_cache(maxsize=4096)
def _plain(c: str) -> str | None:
    """What a non-ASCII character is rewritten to; null: it stays."""
    if c in _LETTER:
        return _LETTER[c]
    if c in INVISIBLE:
        return ""
    if "！" <= c <= "～":
        return chr(ord(c) - 0xFEE0)
    kind = unicodedata.category(c)
    if kind == "Nd":
        return str(unicodedata.decimal(c))
    if kind == "Zs":
        return " "
    if "MATHEMATICAL" in unicodedata.name(c, "") and kind in ("Lu", "Ll"):
        return unicodedata.normalize("NFKC", c)
    return None


class Rewritten:
    """A text and, per character, the source span it stands for and whether it was rewritten.

    ``how``: 0 as it was, 1 rewritten, 2 an "at" without brackets, 3 a dot without them.
    """

    def __init__(self, text: str):
        self.text = text
        self.start = array("q", range(len(text)))
        self.end = array("q", range(1, len(text) + 1))
        self.how = bytearray(len(text))

    def replace(self, edits: list[tuple[int, int, str, int]]) -> None:
        """Apply (start, end, replacement of at most one character, how), in order."""
        parts, start, end, how, at = [], array("q"), array("q"), bytearray(), 0
        for a, b, new, kind in edits:
            parts += [self.text[at:a], new]
            start += self.start[at:a]
            end += self.end[at:a]
            how += self.how[at:a]
            if new:
                start.append(self.start[a])
                end.append(self.end[b - 1])
                how.append(kind)
            elif how:  # what goes is marked on its neighbour
                how[-1] = max(how[-1], kind)
            at = b
        parts.append(self.text[at:])
        self.text = "".join(parts)
        self.start = start + self.start[at:]
        self.end = end + self.end[at:]
        self.how = how + self.how[at:]


_NUMBER = "|".join(DIGITS)
_SPELLED = re.compile(rf"(?:{_NUMBER})(?![a-z])")
_NOT_ASCII = re.compile(r"[^\x00-\x7f]")
#: an opening bracket, the word or sign, the closing one; white space around is taken by ``_bracketed``
_BRACKETED = re.compile(r"[\[({<]\s*(at|@|dot|\.)\s*[\])}>]", re.I)
#: between two spelled digits: white space of any kind and length, with one sign at most
_GAP = re.compile(r"(?=[\s,;/-])\s*[,;/-]?\s*")
_BARE = re.compile(r"(?<=[A-Za-z0-9]) +(at|@|dot|\.) +(?=[A-Za-z0-9])", re.I)
_BEGINS = re.compile(r"\.[A-Z][a-z]")


def _ascii_lower(text: str) -> str:
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if c.isascii() else c for c in text)


def _number_words(text: str) -> list[tuple[int, int, str]]:
    low = _ascii_lower(text)
    out = []
    if not any(w in low for w in DIGITS):
        return out
    for m in _SPELLED.finditer(low):
        a = m.start()
        if a == 0 or not low[a - 1].isalpha():
            out.append((a, m.end(), str(DIGITS.index(m.group()))))
    return out


def _bracketed(text: str) -> Iterator[tuple[int, int, str]]:
    """Bracketed signs with all white space around them; each character is looked at a few times at most."""
    end = 0
    for m in _BRACKETED.finditer(text):
        a, b = m.span()
        while a > end and text[a - 1].isspace():
            a -= 1
        while b < len(text) and text[b].isspace():
            b += 1
        # white space alone may lie between two signs: it is the first one's
        yield max(a, end), b, m.group(1).lower()
        end = b


def _bare(text: str) -> Iterator[tuple[int, int, str]]:
    for m in _BARE.finditer(text):
        yield m.start(), m.end(), m.group(1).lower()


def rewrite(text: str) -> Rewritten | None:
    """The text rewritten; null where there is nothing to rewrite."""
    out = None
    if not text.isascii():
        edits = []
        for m in _NOT_ASCII.finditer(text):
            new = _plain(m.group())
            if new is not None:
                edits.append((m.start(), m.end(), new, 1))
        if edits:
            out = Rewritten(text)
            out.replace(edits)
    numbers = _number_words(out.text if out else text)
    if numbers:
        out = out or Rewritten(text)
        edits, last = [], None
        for a, b, digit in numbers:
            gap = out.text[last:a] if last is not None else None
            if gap is not None and _GAP.fullmatch(gap):
                edits.append((last, a, "", 1))
            elif re.search(r"(?i)(?<![a-z])plus $", out.text[max(0, a - 6) : a]):
                edits.append((a - 5, a, "+", 1))
            edits.append((a, b, digit, 1))
            last = b
        out.replace(edits)
    for signs, weak in ((_bracketed, {}), (_bare, {"at": 2, ".": 3})):
        edits = [
            (a, b, "@" if found in ("at", "@") else ".", weak.get(found, 1))
            for a, b, found in signs(out.text if out else text)
        ]
        if edits:
            out = out or Rewritten(text)
            out.replace(edits)
    return out


def _end(out: Rewritten, a: int, b: int) -> int:
    """Where an address ends that a sentence may follow."""
    at = out.text.index("@", a)
    for i in range(at, b):
        if out.how[i] == 3 and _BEGINS.match(out.text, i):
            if out.how[at] == 2 or EMAIL.fullmatch(out.text, a, i):
                return i
    return b


def _trusted(kind: str, out: Rewritten, a: int, b: int) -> bool:
    how = out.how[a:b]
    if not any(how):
        return False
    if kind != "email":
        return True
    found = out.text[a:b]
    at = found.index("@")
    if not re.search(r"\.[A-Za-z]{2,}$", found):
        return False
    if how[at] == 2:
        return all(how[i] for i in range(at, len(found)) if found[i] == ".")
    return True


def added_spans(text: str, base: list[Span]) -> list[Span]:
    """Disguised findings that are not inside a plain one of their kind.

    Those of one kind never overlap, as their places in the rewritten text do not.
    """
    out = rewrite(text)
    if out is None:
        return []

    def passed(a: int, b: int) -> bool:
        """An "at" that does not count leaves what follows to the next sign."""
        return out.how[out.text.index("@", a)] == 2 and not _trusted("email", out, a, _end(out, a, b))

    # of each kind, plain findings come by place and do not overlap
    plain = {kind: [(a, b) for k, a, b in base if k == kind] for kind in KINDS}
    found = []
    for kind, a, b in base_spans(out.text, passed):
        if kind == "email":
            b = _end(out, a, b)
        if _trusted(kind, out, a, b):
            a, b = out.start[a], out.end[b - 1]
            near = bisect_right(plain[kind], a, key=lambda s: s[0]) - 1
            if near < 0 or plain[kind][near][1] < b:
                found.append((kind, a, b))
    return found


def ordered(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1], s[2]))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def find(text: str | None) -> tuple[list[Span], list[Span]]:
    """Plain spans and all spans, each by kind and place."""
    if not text:
        return [], []
    base = base_spans(text)
    more = added_spans(text, base)
    return base, ordered(base + more) if more else base


FOUND = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_base long"


def _report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in W.batches(batch, "text"):
            rows = [find(t) for t in part.column("text").to_pylist()]
            counts = [
                pa.array([sum(s[0] == kind for s in every) for _, every in rows], pa.int64()) for kind in KINDS
            ]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"),
                    *counts,
                    pa.array([hashlib.sha256(joined(base).encode()).hexdigest() for base, _ in rows], pa.string()),
                    pa.array([joined(every) for _, every in rows], pa.string()),
                    pa.array([len(base) for base, _ in rows], pa.int64()),
                ],
                [c.split()[0] for c in FOUND.split(", ")],
            )


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (all spans), base_sha256, spans, n_base of every row."""
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")
    ).mapInArrow(_report, FOUND)


def masked(text: str | None) -> str | None:
    """The text with each span replaced by its kind in brackets; overlapping spans as one."""
    if not text:
        return text
    _, spans = find(text)
    if not spans:
        return text
    parts, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            parts += [text[at:a], f"[{kind}]"]
        at = max(at, b)
    return "".join(parts) + text[at:]


def mask(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with the spans in ``text_col`` replaced; all other columns as they are."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.batches(batch, text_col):
                at = part.schema.get_field_index(text_col)
                texts = [masked(t) for t in part.column(at).to_pylist()]
                arrays = list(part.columns)
                arrays[at] = pa.array(texts, part.schema.field(at).type)
                yield pa.RecordBatch.from_arrays(arrays, part.schema.names)

    return docs.mapInArrow(rows, docs.schema)
