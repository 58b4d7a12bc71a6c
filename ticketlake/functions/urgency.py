"""Urgency: keyword signals mixed with a classifier score."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import URGENCY_HIGH, URGENCY_MEDIUM, URGENCY_WORDS

# Word edges spelled out: what Java's \b means depends on the JDK in use.
_NOT_AFTER = r"(?<![\p{L}\p{N}_])"
_NOT_BEFORE = r"(?![\p{L}\p{N}_])"


def _words(entry: str) -> list[str]:
    return re.split(r"\W+", entry)


def _may_overlap(a: Sequence[str], b: Sequence[str]) -> bool:
    """True when a match of ``a`` and a match of ``b`` can share words of a text."""
    for shift in range(1 - len(b), len(a)):
        lo, hi = max(0, shift), min(len(a), shift + len(b))
        if list(a[lo:hi]) == list(b[lo - shift : hi - shift]):
            return True
    return False


# entries up to which all pairs are looked at for overlaps; table rows that are broadcast
_PAIRS = 200
_BROADCAST_ROWS = 100_000


def split_lexicon(lexicon: Sequence[str]) -> tuple[list[str], list[str]]:
    """Entries one alternation can find, and entries that need a search of their own.

    An alternation consumes what it matched, so an entry sharing words with
    another one ("locked", "locked out") could be hidden by it.
    """
    parts = {entry: _words(entry) for entry in lexicon}
    alone = [
        e
        for e in lexicon
        if any(e != o and _may_overlap(parts[e], parts[o]) for o in lexicon)
    ]
    return [e for e in lexicon if e not in alone], alone


def signals(text: Column, lexicon: Sequence[str] = URGENCY_WORDS) -> Column:
    """Lexicon entries found as whole words, each once, in lexicon order.

    A few overlapping entries are searched one by one; many are looked up (``indexed_signals``).
    """
    lowered = F.lower(text)
    if len(lexicon) > SEARCHED and all(map(indexable, lexicon)):
        together, alone = split_lexicon(lexicon) if len(lexicon) <= _PAIRS else ([], lexicon)
        if len(alone) > SEARCHED:
            return indexed_signals(text, list(dict.fromkeys(lexicon)))
    together, alone = split_lexicon(lexicon)

    def pattern(entries: Sequence[str]) -> str:
        # looking at the first letter before the word edge rules most places out
        initials = "".join(sorted({re.escape(e[0]) for e in entries}))
        body = "|".join(re.escape(e).replace(r"\ ", " ") for e in entries)
        return f"(?=[{initials}]){_NOT_AFTER}(?:{body}){_NOT_BEFORE}"

    found = []
    if together:
        found.append(
            F.regexp_extract_all(lowered, F.lit(pattern(together)), F.lit(0))
        )
    if alone:
        found.append(
            F.array_compact(
                F.array(
                    *(
                        F.when(F.regexp_like(lowered, F.lit(pattern([e]))), F.lit(e))
                        for e in alone
                    )
                )
            )
        )
    hits = found[0] if len(found) == 1 else F.concat(*found)
    return F.array_intersect(F.array(*(F.lit(e) for e in lexicon)), hits)


#: what a word is, and entries beyond which overlapping ones are looked up instead of searched one by one
_WORD = r"[\p{L}\p{N}_]+"
SEARCHED = 8


def indexable(entry: str) -> bool:
    """Whether an entry begins and ends with a word, so that it can only match whole runs of words."""
    return bool(re.fullmatch(r"\w(.*\w)?", entry, re.S))


def word_runs(text: Column, most: int) -> Column:
    """Distinct runs of up to ``most`` words in lower case, each with what stands between its words.

    Runs of k words come from those of k - 1, so a text is read once, whatever is looked up in them.
    """
    lowered = F.lower(text)
    words = F.regexp_extract_all(lowered, F.lit(_WORD), F.lit(0))
    between = F.split(lowered, _WORD, -1)  # one more than there are words

    def longer(p: Column, runs_before: Column, k: int) -> Column:
        rest = F.greatest(F.size(p["w"]) - k, F.lit(0))
        return F.transform(
            F.slice(runs_before, F.lit(1), rest),
            lambda run, i: F.concat(run, F.get(p["b"], i + k), F.get(p["w"], i + k)),
        )

    def runs(p: Column) -> Column:
        out = [p["w"]]
        for k in range(1, most):
            out.append(longer(p, out[-1], k))
        return F.array_distinct(F.concat(*out))

    # bound once: what a lambda refers to would else be worked out for each element
    return F.transform(F.array(F.struct(words.alias("w"), between.alias("b"))), runs)[0]


def indexed_signals(text: Column, lexicon: Sequence[str]) -> Column:
    """What ``signals`` finds, for entries that are ``indexable``: a hash lookup per run of words.

    The cost of a text does not depend on the number of entries, nor on how they overlap.
    """
    most = max(len(_words(e)) for e in lexicon)
    hits = F.filter(word_runs(text, most), lambda run: run.isin(list(lexicon)))
    place = F.array(*map(F.lit, lexicon))
    ordered = F.array_sort(F.transform(hits, lambda e: F.struct(F.array_position(place, e).alias("at"), e.alias("entry"))))
    return F.transform(ordered, lambda x: x["entry"])


def table_signals(rows: DataFrame, lexicon: DataFrame, most: int, id_col: str = "ticket_id", text_col: str = "text") -> DataFrame:
    """(id, signals_found) of rows in which entries of a lexicon table are found, in the order of ``ord``.

    ``lexicon`` has ``entry`` (in lower case, of up to ``most`` words) and ``ord``; it may hold any number of
    entries. Only runs of words that are entries go on: by broadcast where the lexicon is counted to be
    small, by shuffle of the distinct runs beyond. Rows without a hit are left out; those that share an id
    are one.
    """
    runs = rows.select(id_col, F.explode(word_runs(F.col(text_col), most)).alias("entry"))
    entries = lexicon.groupBy("entry").agg(F.min("ord").alias("ord"))
    small = entries.limit(_BROADCAST_ROWS + 1).count() <= _BROADCAST_ROWS
    found = runs.join(F.broadcast(entries) if small else entries, "entry").select(id_col, F.struct("ord", "entry").alias("hit"))
    ordered = F.array_sort(F.collect_set("hit"))  # bounded by a text's words
    return found.groupBy(id_col).agg(F.transform(ordered, lambda x: x["entry"]).alias("signals_found"))


def signal_score(found: Column) -> Column:
    """One hit scores 0.5, two or more 1.0."""
    return F.least(F.size(found) * F.lit(0.5), F.lit(1.0))


def urgency_score(signal: Column, classifier: Column) -> Column:
    """Even mix; where there is no classifier score the signal decides alone."""
    return F.coalesce(F.lit(0.5) * signal + F.lit(0.5) * classifier, signal)


def urgency_level(score: Column) -> Column:
    return (
        F.when(score >= URGENCY_HIGH, "high")
        .when(score >= URGENCY_MEDIUM, "medium")
        .when(score.isNotNull(), "low")
    )
