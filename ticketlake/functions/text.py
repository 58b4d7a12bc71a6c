"""Text expressions of the canonical ticket and of its cleaned-up text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unicode white space as a character class (Java's \s knows only the ASCII part)
# and, for trimming, as the characters themselves.
SPACE = r"[\s\x1c-\x1f\x85\p{Z}]"
_INK = r"[^\s\x1c-\x1f\x85\p{Z}]"
SPACE_CHARS = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())

MAX_CHARS = 2000
TAIL_CHARS = 200
SNIPPET_CHARS = 200
CUT_MARK = "\n[...]\n"


def strip(col: Column) -> Column:
    """Drop Unicode white space at both ends (``trim`` knows only U+0020)."""
    return F.btrim(col, F.lit(SPACE_CHARS))


def is_blank(col: Column) -> Column:
    """True when ``strip`` would leave nothing; stops at the first visible character."""
    return ~F.regexp_like(col, F.lit(_INK))


def squeeze(col: Column) -> Column:
    """Every run of white space becomes one space; none is left at the ends."""
    return F.trim(F.regexp_replace(col, rf"{SPACE}++", " "))


def none_if_empty(col: Column) -> Column:
    return F.nullif(col, F.lit(""))


def merge_subject_body(subject: Column, body: Column) -> Column:
    """Subject, blank line, body; just the one that is there when the other is blank."""
    return F.concat_ws("\n\n", none_if_empty(strip(subject)), none_if_empty(strip(body)))


def flat_text(subject: Column, body: Column) -> Column:
    """``squeeze(merge_subject_body(...))`` in a single regex pass.

    Squeezing removes whatever the merge would have stripped, so the joined
    raw parts give the same text.
    """
    return squeeze(F.concat_ws(" ", subject, body))


def cap_length(col: Column, max_chars: int = MAX_CHARS) -> Column:
    """Texts over ``max_chars`` keep their head and their last 200 characters."""
    head = F.substring(col, 1, max_chars - TAIL_CHARS)
    tail = F.right(col, F.lit(TAIL_CHARS))
    return F.when(
        F.length(col) > max_chars, F.concat(head, F.lit(CUT_MARK), tail)
    ).otherwise(col)


def shorten(col: Column, n: int, mark: str = "...") -> Column:
    """First ``n`` characters, with a mark when something was cut."""
    return F.when(
        F.length(col) > n, F.concat(F.substring(col, 1, n), F.lit(mark))
    ).otherwise(col)


def snippet(col: Column, n: int = SNIPPET_CHARS) -> Column:
    return shorten(col, n)


def language_code(col: Column) -> Column:
    """Two lower-case letters of an already stripped language tag."""
    return F.substring(F.lower(col), 1, 2)


def ticket_id(file: Column, row_index: Column) -> Column:
    """Stable 48-bit id: the first 12 hex digits of md5("file:row")."""
    digest = F.md5(F.concat(file, F.lit(":"), row_index.cast("string")))
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("bigint")


def sample_label(ticket: Column, subject: Column) -> Column:
    """Browser entry: ``id - subject``, the subject cut at 60 characters."""
    name = shorten(strip(F.coalesce(subject, F.lit(""))), 60)
    return F.concat(ticket.cast("string"), F.lit(" - "), name)
