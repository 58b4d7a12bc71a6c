"""The tokeniser against regular expressions, at several slice sizes."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from ticketlake.llm import words as W


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


@pytest.fixture(params=[5, 64, 1 << 21])
def slices(request, monkeypatch):
    monkeypatch.setattr(W, "SLICE", request.param)


def random_texts(seed, n=300):
    rng = random.Random(seed)
    letters = "ab C\n\t.é9Z日 \x1f"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(n)]
    return [*texts, None, "", "   ", "x" * 300]


@pytest.mark.parametrize(
    "separators, pattern, lower",
    [
        (W.SPACES, r"[^\x20\x09-\x0D]+", False),
        (W.SPACES, r"[^\x20\x09-\x0D]+", True),
        (W.PUNCTUATION, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", True),
    ],
)
def test_split(slices, separators, pattern, lower):
    texts = random_texts(1)
    found = W.split(pa.array(texts), separators, lower)
    hashes = {}
    for i, text in enumerate(texts):
        want = re.findall(pattern, lowered(text or "") if lower else text or "")
        part = slice(found.first[i], found.first[i + 1])
        got = [bytes(found.data[a:b]).decode() for a, b in zip(found.start[part], found.end[part])]
        assert [lowered(w) if lower else w for w in got] == want
        for word, value in zip(want, found.hash[part].tolist()):
            assert hashes.setdefault(word, value) == value
    assert len(set(hashes.values())) == len(hashes)


def test_sliced_and_large_arrays():
    texts = pa.array(["a b", None, "c d e", "f"])
    whole = W.split(texts).hash
    assert (W.split(texts.cast(pa.large_string())).hash == whole).all()
    assert (W.split(texts[2:]).hash == whole[2:]).all()
    assert len(W.split(pa.array([], pa.string())).hash) == 0


def test_grams_and_spans_agree_on_equal_runs():
    found = W.split(pa.array(["a b c d", "x b c d", "b c"]))
    three = W.grams(found.hash, 3)
    inside = W.inside(found, 3)
    assert inside.tolist() == [True, True, False, False, True, True, False, False]
    assert three[1] == three[5] and three[0] != three[4]
    runs = W.spans(found.hash, np.array([1, 5, 8, 2]), np.array([3, 7, 10, 4]))
    assert runs[0] == runs[1] == runs[2] != runs[3]


def test_batches_cover_all_rows():
    rows = pa.RecordBatch.from_arrays([pa.array(["a" * n for n in (3, 0, 50, 7, 7)] + [None])], ["text"])
    parts = list(W.batches(rows, "text", 10))
    assert [t for p in parts for t in p.column("text").to_pylist()] == rows.column("text").to_pylist()
    assert len(parts) > 2
