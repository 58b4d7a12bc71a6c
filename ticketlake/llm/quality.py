"""Text quality by supervised subword embeddings.

Every word, pair of neighbouring words (equal ones share one feature, whatever the word) and
character n-gram is hashed to one of ``BUCKETS`` vectors. A document is the average of
its features' vectors; a softmax over two outputs gives the class. Vectors and
outputs are learnt together by stochastic gradient descent in numpy, on at most
``PER_CLASS`` labelled documents of each class (a bound on the sample, chosen by hashed id).
The log odds are then shifted from the sample's class shares to those of all labels.

As the average and the outputs are linear, scoring needs one number per bucket: the
vectors times the difference of the two outputs. It scans whole texts without a shuffle.

Null and empty texts have no features; their score is that of the bias alone. Without labels of
both classes nothing can be learnt: the score is then the share of label 1 (0.5
without any labels). Repeated rows are scored one by one, an empty table gives an
empty result. Only id and text are read of the documents, and id and label of the labels.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .training import in_one_task, log_odds, prior_shift, remainder, sample, sigmoid

BUCKETS, DIMS, GRAMS = 1 << 18, 16, (3, 4)
PER_CLASS, EPOCHS, RATE = 2500, 6, 4.0
#: a document is kept (predicted 1) from this score on
CUT = 0.3

_SAME = W.mix(np.array([12345], np.uint64))[0]


def features(texts: pa.Array) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Buckets of all features, in arrays of text order, and where each text's begin in them."""
    shift = np.uint64(64 - BUCKETS.bit_length() + 1)
    found = W.split(texts, W.SPACES)
    out, starts = [W.mix(found.hash + np.uint64(1)) >> shift], [found.first]
    pairs = W.grams(found.hash, 2)
    if len(pairs):
        pairs[found.hash[1:] == found.hash[:-1]] = _SAME
        ok = W.inside(found, 2)
        out.append(pairs[ok] >> shift)
        starts.append(np.searchsorted(np.flatnonzero(ok), found.first))
    strings = [t or "" for t in texts.to_pylist()]
    points = np.frombuffer("".join(strings).encode("utf-32-le"), np.uint32).astype(np.uint64)
    first = np.cumsum([0] + [len(s) for s in strings])
    points = W.mix(points + np.uint64(1))
    for n in GRAMS:
        hashes = W.grams(points, n)
        last = np.maximum(first[1:] - n + 1, first[:-1])
        ok = np.ones(len(hashes), bool)
        for a, b in zip(last.tolist(), first[1:].tolist()):
            ok[a:b] = False
        out.append(hashes[ok] >> shift)
        starts.append(np.searchsorted(np.flatnonzero(ok), first))
    return out, starts


@dataclass
class Model:
    weight: np.ndarray
    bias: float

    def logits(self, texts: pa.Array) -> np.ndarray:
        n_texts = len(texts)
        total, count = np.zeros(n_texts), np.zeros(n_texts)
        for buckets, start in zip(*features(texts)):
            sums = np.append(0.0, np.cumsum(self.weight[buckets], dtype=np.float64))
            total += sums[start[1:]] - sums[start[:-1]]
            count += np.diff(start)
        return total / np.maximum(count, 1) + self.bias


def train(texts: list[str], labels: np.ndarray, shift: float, seed: int = 7) -> Model:
    """Vectors and outputs by gradient descent, one document at a time."""
    rng = np.random.default_rng(seed)
    # a few large arrays, which are given back as a whole, and not one per document
    parts, sizes = [], []
    for at in range(0, len(texts), 100):
        part = pa.array(texts[at : at + 100], pa.string())
        buckets, starts = features(part)
        found = []
        for i in range(len(part)):
            own = np.concatenate([b[s[i] : s[i + 1]] for b, s in zip(buckets, starts)]).astype(np.int32)
            which, n = np.unique(own, return_counts=True)
            found.append((which, (n / max(1, len(own))).astype(np.float32)))
            sizes.append(len(which))
        parts.append(tuple(np.concatenate(x) for x in zip(*found)))
    every_which, every_share = (np.concatenate(x) for x in zip(*parts))
    del parts
    ends = np.cumsum([0, *sizes])
    vectors = rng.uniform(-1 / DIMS, 1 / DIMS, (BUCKETS, DIMS)).astype(np.float32)
    outputs, bias = np.zeros((2, DIMS), np.float32), np.zeros(2, np.float32)
    steps, done = EPOCHS * len(texts), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(len(texts)):
            rate = RATE * (1 - done / steps)
            done += 1
            own = slice(ends[i], ends[i + 1])
            which, share = every_which[own], every_share[own]
            hidden = share @ vectors[which]
            scores = outputs @ hidden + bias
            p = np.exp(scores - scores.max())
            p /= p.sum()
            p[labels[i]] -= 1
            back = outputs.T @ p
            outputs -= rate * 0.1 * np.outer(p, hidden)
            bias -= rate * 0.01 * p
            # shares are tiny; the step is scaled by their size as in a normalised gradient
            vectors[which] -= np.outer(share * (rate / max(1e-6, float(share @ share) ** 0.5)), back)
    weight = vectors @ (outputs[1] - outputs[0])
    return Model(weight.astype(np.float32), float(bias[1] - bias[0]) + shift)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality") -> Model:
    learn = remainder(F.col("doc_id"), 5) != 0
    rows, counts = sample(docs, labels, label, learn, PER_CLASS)
    constant = Model(np.zeros(BUCKETS, np.float32), log_odds(counts))
    if not counts.all():
        return constant

    def work(texts: list[str], marks: np.ndarray) -> Model:
        if len(np.unique(marks)) < 2:
            return constant
        return train(texts, marks, prior_shift(counts, marks))

    return in_one_task(rows, work)


def score(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with ``__score``, the probability of label 1."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = docs.columns

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            for part in W.batches(batch, text_col, 1 << 20):
                value = sigmoid(own.logits(part.column(names.index(text_col))))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(value)], [*names, "__score"])

    return docs.mapInArrow(rows, docs.withColumn("__score", F.lit(0.0)).schema)


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return score(rows, fit(docs, labels)).select(
        "doc_id",
        (remainder(F.col("doc_id"), 5) == 0).alias("held_out"),
        F.col("__score").alias("score"),
        (F.col("__score") >= CUT).cast("int").alias("predicted"),
    )
