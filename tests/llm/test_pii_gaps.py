"""Disguises with wide gaps, against a slow independent normaliser."""

import random
import re
import time

import pytest

from ticketlake.llm import pii


@pytest.mark.parametrize("text,kind,found", [
    ("mail joe (     at     ) example (dot) com now", "email", "joe (     at     ) example (dot) com"),
    ("joe      (at)\texample\n[\n dot ]  com", "email", "joe      (at)\texample\n[\n dot ]  com"),
    ("call plus one, two, three, four, five, six, seven, eight, nine, zero!", "phone", "plus one, two, three, four, five, six, seven, eight, nine, zero"),
    ("plus one  two \n three-four / five six;seven eight nine", "phone", "plus one  two \n three-four / five six;seven eight nine"),
    ("four one one one, one one one one, one one one one, one one one one", "card", "four one one one, one one one one, one one one one, one one one one"),
])
def test_wide_gaps(text, kind, found):
    _, spans = pii.find(text)
    assert [(k, text[a:b]) for k, a, b in spans] == [(kind, found)]


def slow(text):
    """Mails with bracketed signs, by one substitution and a search; places by counting what went."""
    at = re.compile(r"\s*[\[({<]\s*(at|@|dot|\.)\s*[\])}>]\s*", re.I)
    plain, places, end = "", [], 0
    for m in at.finditer(text):
        plain += text[end : m.start()]
        places += range(end, m.start())
        plain += "@" if m.group(1).lower() in ("at", "@") else "."
        places.append((m.start(), m.end()))
        end = m.end()
    plain += text[end:]
    places += range(end, len(text))
    first = lambda p: p if isinstance(p, int) else p[0]
    last = lambda p: p + 1 if isinstance(p, int) else p[1]
    out = []
    for m in pii.EMAIL.finditer(plain):
        own = places[m.start() : m.end()]
        if any(not isinstance(p, int) for p in own) and re.search(r"\.[A-Za-z]{2,}$", m.group()):
            out.append(("email", first(own[0]), last(own[-1])))
    return out


def test_random_brackets_equal_a_slow_normaliser():
    rng = random.Random(3)
    pieces = ["joe", "x.y", "example", "com", "org", "[at]", "( at )", "(@)", "{dot}", "<\tdot\n>", "(.)", " ", "    ", "\n", ";", "!", "("]
    some = 0
    for _ in range(9000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randint(1, 12)))
        base, spans = pii.find(text)
        added = [s for s in spans if s not in base]
        want = [s for s in slow(text) if not any(k == "email" and a <= s[1] and s[2] <= b for k, a, b in base)]
        assert added == want, text
        some += bool(want)
    assert some > 100


def test_long_gaps_take_linear_time():
    def timed(n):
        text = "joe (" + " " * n + "at) x" + " " * n + "( " * (n // 10) + "one" + " " * n + "two" + ", " * n
        start = time.process_time()
        pii.find(text)
        return time.process_time() - start

    timed(1000)
    assert timed(400_000) < 6 * timed(100_000) + 0.1
