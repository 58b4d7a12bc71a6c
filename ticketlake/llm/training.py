"""Bounded, reproducible samples of labelled documents, and the held-out split."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def remainder(doc_id: Column, divisor: int) -> Column:
    """crc32 of the id as text, modulo ``divisor``; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % divisor


def sample(docs: DataFrame, labels: DataFrame, label: str, learn: Column, per_class: int,
           id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, np.ndarray]:
    """doc_id, text, label (0/1) to learn from, and the class counts behind them.

    At most ``per_class`` documents of each class, those with the smallest hashed ids;
    ``learn`` says, over ``doc_id``, which ids labels may be learnt from. A document with
    several labels counts by the smallest; null labels and texts are left out.
    """
    known = (
        labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
        .where("doc_id IS NOT NULL AND label IN (0, 1)")
        .where(learn)
        .groupBy("doc_id")
        .agg(F.min("label").alias("label"))
    )
    counts = np.zeros(2, np.int64)
    for row in known.groupBy("label").count().collect():  # two rows
        counts[row["label"]] = row["count"]
    chosen = None
    for value in (0, 1):
        part = known.where(F.col("label") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        chosen = part if chosen is None else chosen.unionByName(part)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = (
        texts.where("text IS NOT NULL")
        .join(F.broadcast(chosen), "doc_id")  # 2 * per_class rows at most
        .dropDuplicates(["doc_id"])
        .select("doc_id", "text", "label")
    )
    return rows, counts


def in_one_task(rows: DataFrame, learn: Callable[[list[str], np.ndarray], object]):
    """What ``learn`` makes of the texts and labels of a bounded sample, in id order.

    It runs in a task of its own, so a lost executor repeats it and the driver only gets
    the model.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b for b in batches if b.num_rows]
        texts: list[str] = []
        labels = np.zeros(0, np.int64)
        if parts:
            table = pa.Table.from_batches(parts).sort_by("doc_id")
            texts = table.column("text").to_pylist()
            labels = table.column("label").to_numpy().astype(np.int64)
            del table
        del parts
        model = pickle.dumps(learn(texts, labels))
        yield pa.RecordBatch.from_arrays([pa.array([model], pa.binary())], ["model"])

    made = rows.repartition(1).mapInArrow(work, "model binary").first()
    return pickle.loads(made["model"]) if made else learn([], np.zeros(0, np.int64))


def prior_shift(counts: np.ndarray, labels: np.ndarray) -> float:
    """What turns log odds learnt on a sample by class into those of the whole."""
    taken = np.bincount(labels, minlength=2)
    return float(np.log((counts[1] + 1) / (counts[0] + 1)) - np.log((taken[1] + 1) / (taken[0] + 1)))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def log_odds(counts: np.ndarray) -> float:
    """Of label 1, from counts by label; 0 without any."""
    return float(np.log(counts[1] + 1e-9) - np.log(counts[0] + 1e-9))
