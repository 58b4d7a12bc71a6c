"""Toxicity by weak supervision: many voters, a generative label model, a linear classifier.

Voters are made from the learnable labelled documents: lexicon voters (a word occurs) and pattern
voters (words that begin with certain letters occur once, or several times), picked
because they fire more often in documents marked toxic. Each may be wrong, and many say the same.

The label model is generative: a hidden class makes each voter fire with a rate of its
own, given the class. Rates and the class share are estimated by expectation
maximisation over the votes, started from the voters' rates by label. What voters
share beyond the class, their correlation within the classes, is estimated from the
same votes; a voter's evidence is divided by how many others it repeats, so ten copies of a
voter count as one. The posterior of the hidden class is the training label.

A logistic classifier over word and word-beginning counts is then trained on the
posteriors, in numpy, and scores whole texts, far beyond what the voters cover.

Training takes at most ``PER_CLASS`` documents of each class, chosen by hashed id. Null
and empty texts have no features; their score is that of the bias alone. Without
labels of both classes nothing can be learnt: the score is then the share of label 1.
Repeated rows are scored one by one, an empty table gives an empty result. Only id and
text are read of the documents, and id and label of the labels.
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

PER_CLASS = 2500
#: lengths of the word beginnings, in bytes
BEGINNINGS = (4, 5, 6, 7, 8)
#: voters, features of the classifier, documents a feature must occur in
VOTERS, FEATURES, LEAST = 200, 6000, 4
#: z-score of the difference between the classes from which a feature is used
SURE = 3.0
#: a document is toxic (predicted 1) from this score on
CUT = 0.3


def word_features(texts: pa.Array) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Hashes of words and word beginnings, and the text of each, one pair of arrays per kind."""
    found = W.split(texts, W.PUNCTUATION, lower=True)
    text = found.text_of()
    hashes, texts_of = [W.mix(found.hash + np.uint64(3))], [text]
    length = found.end - found.start
    begun = np.zeros(len(text), np.uint64)
    letters = W.letters(True)
    for n in range(1, max(BEGINNINGS) + 1):
        long = length >= n
        place = np.where(long, found.start + n - 1, 0)
        begun = begun * np.uint64(W._ODD) + letters[found.data[place]] if len(text) else begun
        if n in BEGINNINGS:
            hashes.append(W.mix(begun[long] + np.uint64(n)))
            texts_of.append(text[long])
    return hashes, texts_of


def counted(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """text, feature, occurrences: each feature of each text once."""
    hashes, of = word_features(texts)
    return _counted(np.concatenate(hashes), np.concatenate(of))


def _counted(hashes: np.ndarray, text: np.ndarray):
    order = np.lexsort((hashes, text))
    hashes, text = hashes[order], text[order]
    new = np.ones(len(order), bool)
    new[1:] = (np.diff(hashes) != 0) | (np.diff(text) != 0)
    at = np.flatnonzero(new)
    return text[at], hashes[at], np.diff(np.append(at, len(order)))


@dataclass
class LabelModel:
    """Rates at which voters fire by class, the class share, and each voter's weight.

    A voter that does not fire abstains; that none fires is a vote of its own, the last.
    """

    share: float
    rates: np.ndarray  # 2 x voters
    weights: np.ndarray

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        evidence = votes @ (self.weights * np.log(self.rates[1] / self.rates[0]))
        return sigmoid(evidence + np.log(self.share / (1 - self.share)))


def with_silence(votes: np.ndarray) -> np.ndarray:
    return np.append(votes, ~votes.any(1, keepdims=True), axis=1).astype(np.float64)


def _rates(votes: np.ndarray, p: np.ndarray) -> np.ndarray:
    low = ((1 - p) @ votes + 0.5) / ((1 - p).sum() + 1)
    high = (p @ votes + 0.5) / (p.sum() + 1)
    return np.clip(np.stack([low, high]), 1e-4, 1 - 1e-4)


def _correlation(votes: np.ndarray, p: np.ndarray, rates: np.ndarray) -> np.ndarray:
    """Correlations of the voters within the classes; what chance explains is zero."""
    rest = votes - np.outer(p, rates[1]) - np.outer(1 - p, rates[0])
    spread = np.sqrt((rest**2).mean(0)) + 1e-9
    out = (rest.T @ rest) / len(votes) / np.outer(spread, spread)
    np.fill_diagonal(out, 0)
    return np.where(np.abs(out) > 3 / np.sqrt(len(votes)), out, 0)


def label_model(votes: np.ndarray, start: np.ndarray, rounds: int = 10) -> LabelModel:
    """Estimated from ``votes`` (documents x voters), begun at the class weights ``start``.

    The class share is that of ``start``; rates and correlations follow the posterior.
    """
    p = start.astype(float)
    model = LabelModel(float(p.mean()), _rates(votes, p), np.ones(votes.shape[1]))
    for _ in range(rounds):
        model.rates = _rates(votes, p)
        repeated = _correlation(votes, p, model.rates)[:-1, :-1] ** 2
        # silence excludes all other votes, so it repeats none of them
        model.weights = np.append(1 / (1 + repeated.sum(1)), 1.0)
        p = model.posterior(votes)
    return model


@dataclass
class Model:
    keys: np.ndarray  # sorted feature hashes
    weight: np.ndarray
    bias: float

    def logits(self, texts: pa.Array) -> np.ndarray:
        out = np.full(len(texts), self.bias)
        if not len(self.keys):
            return out
        bits = self.bits
        kept, of = [], []
        for hashes, text in zip(*word_features(texts)):
            near = np.flatnonzero(bits[hashes >> np.uint64(44)])
            at = np.searchsorted(self.keys, hashes[near])
            at[at == len(self.keys)] = 0
            hit = self.keys[at] == hashes[near]
            kept.append(at[hit].astype(np.uint64))
            of.append(text[near[hit]])
        text, key, n = _counted(np.concatenate(kept), np.concatenate(of))
        np.add.at(out, text, self.weight[key.astype(np.int64)] * np.log1p(n))
        return out

    @property
    def bits(self) -> np.ndarray:
        """A table that turns most features away before the search."""
        if getattr(self, "_bits", None) is None:
            self._bits = np.zeros(1 << 20, bool)
            self._bits[self.keys >> np.uint64(44)] = True
        return self._bits


def _logistic(rows, cols, values, n_docs, n_features, target, rounds=300, penalty=1e-4):
    """Weights and bias by full-batch Adam on the cross entropy with soft targets."""
    w, b = np.zeros(n_features), 0.0
    m, v, mb, vb = np.zeros(n_features), np.zeros(n_features), 0.0, 0.0
    for step in range(1, rounds + 1):
        z = np.bincount(rows, values * w[cols], minlength=n_docs) + b
        error = (sigmoid(z) - target) / n_docs
        g = np.bincount(cols, values * error[rows], minlength=n_features) + penalty * w
        gb = error.sum()
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        c, d = 1 - 0.9**step, 1 - 0.999**step
        w -= 0.05 * (m / c) / (np.sqrt(v / d) + 1e-8)
        b -= 0.05 * (mb / c) / (np.sqrt(vb / d) + 1e-8)
    return w, b


def _covering(fires: np.ndarray, precise: np.ndarray) -> np.ndarray:
    """Up to VOTERS voters, best first; documents that have voters already count less."""
    seen, chosen = np.zeros(len(fires)), []
    while len(chosen) < min(VOTERS, fires.shape[1]):
        worth = ((1 / (1 + seen) ** 2) @ fires) * precise
        worth[chosen] = -1
        chosen.append(int(np.argmax(worth)))
        seen += fires[:, chosen[-1]]
    return np.array(chosen, np.int64)


def _scaled(z: np.ndarray, target: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """a (1 to 8) and c for which sigmoid(a z + c) fits the target best, by Newton steps."""
    a, c = 1.0, 0.0
    for _ in range(rounds):
        p = sigmoid(a * z + c)
        v = p * (1 - p)
        g = np.array([((p - target) * z).sum(), (p - target).sum()])
        h = np.array([[(v * z * z).sum(), (v * z).sum()], [(v * z).sum(), v.sum()]]) + np.eye(2) * 1e-3
        da, dc = np.linalg.solve(h, g)
        a, c = float(np.clip(a - da, 1.0, 8.0)), float(np.clip(c - dc, -20.0, 20.0))
    return a, c


def train(texts: list[str], labels: np.ndarray, shift: float) -> Model:
    n_docs = len(texts)
    parts = []
    for at in range(0, n_docs, 100):
        text, key, n = counted(pa.array(texts[at : at + 100], pa.string()))
        parts.append(((text + at).astype(np.int32), key, np.minimum(n, 60000).astype(np.uint16)))
    rows, keys, n = (np.concatenate(x) for x in zip(*parts))
    distinct, cols = np.unique(keys, return_inverse=True)
    toxic = labels == 1
    by_class = np.stack(
        [np.bincount(cols[toxic[rows] == k], minlength=len(distinct)) for k in (False, True)]
    ).astype(float)
    rate = (by_class + 0.5) / (np.array([[(~toxic).sum()], [toxic.sum()]]) + 1)
    # information of "occurs" about the class: a z-score of the rates' difference
    mean = rate.mean(0)
    z = (rate[1] - rate[0]) / np.sqrt(mean * (1 - mean) * (1 / (toxic.sum() + 1) + 1 / ((~toxic).sum() + 1)))
    z[by_class.sum(0) < LEAST] = 0

    # voters: a feature occurs at least once, twice, three times
    good = np.argsort(-z)[: VOTERS * 4]
    place = np.full(len(distinct), -1)
    place[good] = np.arange(len(good))
    mine = place[cols] >= 0
    table = np.zeros((n_docs, len(good)), np.uint16)
    table[rows[mine], place[cols[mine]]] = n[mine]
    votes = np.concatenate([table >= k for k in (1, 2, 3)], 1).astype(np.float32)
    fired = np.stack([votes[~toxic].sum(0), votes[toxic].sum(0)])
    precise = (fired[1] + 0.5) / (fired.sum(0) + 1)
    able = np.flatnonzero((fired.sum(0) >= LEAST) & (precise > 0.8))
    chosen = able[_covering(votes[toxic][:, able], precise[able])]
    if len(chosen):
        votes = with_silence(votes[:, chosen] > 0)
        target = label_model(votes, np.where(toxic, 0.95, 0.05)).posterior(votes)
    else:
        target = labels.astype(float)

    # features of the classifier: those that tell the posterior classes apart most
    top = np.argsort(-np.abs(z), kind="stable")[:FEATURES]
    top = np.sort(top[np.abs(z[top]) >= SURE])
    place = np.full(len(distinct), -1)
    place[top] = np.arange(len(top))
    mine = place[cols] >= 0
    w, b = _logistic(
        rows[mine], place[cols[mine]], np.log1p(n[mine].astype(float)), n_docs, len(top), target
    )
    # regularised weights are too timid; the scale that fits the posteriors best is kept
    z = np.bincount(rows[mine], np.log1p(n[mine].astype(float)) * w[place[cols[mine]]], minlength=n_docs)
    scale, offset = _scaled(z + b, target)
    return Model(distinct[top], w * scale, b * scale + offset + shift)


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> Model:
    learn = remainder(F.col("doc_id"), 4) != 2
    rows, counts = sample(docs, labels, label, learn, PER_CLASS)
    constant = Model(np.zeros(0, np.uint64), np.zeros(0), log_odds(counts))
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
            for part in W.batches(batch, text_col, 1 << 21):
                value = sigmoid(own.logits(part.column(names.index(text_col))))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(value)], [*names, "__score"])

    return docs.mapInArrow(rows, docs.withColumn("__score", F.lit(0.0)).schema)


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return score(rows, fit(docs, labels)).select(
        "doc_id",
        (remainder(F.col("doc_id"), 4) == 2).alias("held_out"),
        F.col("__score").alias("score"),
        (F.col("__score") >= CUT).cast("int").alias("predicted"),
    )
