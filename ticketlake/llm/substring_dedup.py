"""Duplicate passages by Relative Lempel-Ziv parsing against indexed blocks.

Every document is parsed against all documents with smaller ids. The reference is
indexed by blocks that the content itself fixes: each window of ``WINDOW`` words has an
anchor, its run of ``ANCHOR`` words with the smallest hash, and the consecutive windows
with one anchor form a block. Two equal windows always have equal anchors, so a block is
found under its anchor wherever it stands.

1. A block that occurs, as a whole, in a smaller document is a piece of a factor.
   Runs of such pieces are the factors; one row per block decides them, about a fifth
   of the words.
2. A factor may go on for some windows beyond its last whole block. So at the
   factors' boundaries, that is under anchors with differing blocks, the first
   document of each differing block contributes its single windows, and these are
   compared one by one.
3. The union of both covers exactly the words of windows that also start in a document
   with a smaller id.

Each task first settles what it can among its own documents (only the smallest
document of equal blocks is compared further), so a passage that a third of all
documents share reaches the shuffle once per batch. Texts are never shuffled whole but
for documents that have something to compare or remove.

Null and empty texts have no words; texts shorter than a window lose nothing. A row
with a null id is no reference and loses nothing. Rows that repeat an id are one
document and must hold one text. Empty tables give empty results. Only the id and the
text column are read, other columns may have any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import stage
from . import words as W
from .common import likely

#: words in a window; words in an anchor
WINDOW, ANCHOR = 13, 5


def anchors(found: W.Words, width: int, anchor: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of all windows that lie in one text, and the place of each one's anchor."""
    hashes = W.grams(found.hash, anchor)
    n = len(found.hash) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    span = width - anchor + 1
    least, have = hashes, 1
    while have < span:  # sliding minimum, doubling its reach
        step = min(have, span - have)
        least = np.minimum(least[: len(least) - step], least[step:])
        have += step
    least = least[:n]
    at = np.zeros(n, np.int64)
    for j in reversed(range(span)):
        at[hashes[j : j + n] == least] = j
    start = np.flatnonzero(W.inside(found, width))
    return start, start + at[start]


def blocks(found: W.Words, width: int, anchor: int):
    """first window, number of windows, anchor hash and content hash of each block."""
    start, at = anchors(found, width, anchor)
    if not len(start):
        none = np.zeros(0, np.int64)
        return none, none, none.view(np.uint64), none.view(np.uint64)
    text = np.searchsorted(found.first, start, side="right")
    new = np.ones(len(start), bool)
    new[1:] = (np.diff(at) != 0) | (np.diff(text) != 0)
    begin = np.flatnonzero(new)
    count = np.diff(np.append(begin, len(start)))
    first = start[begin]
    key = W.spans(found.hash, at[begin], at[begin] + anchor)
    content = W.spans(found.hash, first, first + count + width - 1)
    return first, count, key, content


def _settled(ids: np.ndarray, *keys: np.ndarray) -> np.ndarray:
    """Whether an equal key stands in a smaller document of the same batch."""
    order = np.lexsort((ids, *keys))
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = np.logical_or.reduce([np.diff(k[order]) != 0 for k in keys])
    group = np.cumsum(new) - 1
    smallest = ids[order[new]]
    out = np.empty(len(order), bool)
    out[order] = ids[order] > smallest[group]
    return out


def _own_keys(ids: np.ndarray, places: np.ndarray, keys: np.ndarray, settled: np.ndarray) -> np.ndarray:
    """Keys under which settled rows meet nothing and are spread evenly."""
    apart = W.mix(ids.astype(np.uint64) * np.uint64(W._ODD) + places.astype(np.uint64) + np.uint64(1))
    return np.where(settled, apart, keys)


ROWS = "key long, content long, doc_id long, start int, n int, settled boolean"


def _block_rows(width: int, anchor: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.batches(batch, "text"):
                found = W.split(part.column("text"))
                first, count, key, content = blocks(found, width, anchor)
                text = np.searchsorted(found.first, first, side="right") - 1
                ids = part.column("doc_id").to_numpy()[text]
                place = first - found.first[text]
                settled = _settled(ids, content, key)
                yield _table(_own_keys(ids, place, key, settled), content, ids, place, count, settled)

    return rows


def _table(key, content, ids, place, count, settled) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [
            pa.array(key.view(np.int64)),
            pa.array(content.view(np.int64)),
            pa.array(ids, pa.int64()),
            pa.array(place.astype(np.int32)),
            pa.array(count.astype(np.int32)),
            pa.array(settled),
        ],
        ["key", "content", "doc_id", "start", "n", "settled"],
    )


def _window_rows(width: int):
    """Single windows of the blocks asked for (column ``asked``: structs of start and n)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.batches(batch, "text"):
                found = W.split(part.column("text"))
                asked = part.column("asked")
                lists = asked.flatten()
                of = np.repeat(np.arange(len(part)), np.diff(asked.offsets.to_numpy()))
                begin = lists.field("start").to_numpy().astype(np.int64)
                count = lists.field("n").to_numpy().astype(np.int64)
                text = np.repeat(of, count)
                place = np.repeat(begin - (np.cumsum(count) - count), count) + np.arange(count.sum())
                at = place + found.first[text]
                key = W.spans(found.hash, at, at + width)
                ids = part.column("doc_id").to_numpy()[text]
                settled = _settled(ids, key)
                key = _own_keys(ids, place, key, settled)
                yield _table(key, key, ids, place, np.ones(len(key)), settled)

    return rows


def spans(docs: DataFrame, width: int = WINDOW, anchor: int = ANCHOR,
          id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, spans (start, end in words): what stands in windows of smaller documents.

    One row for each document that has any; the spans may overlap.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where(
        "doc_id IS NOT NULL"
    )
    by_key, by_block = Window.partitionBy("key"), Window.partitionBy("key", "content")
    parsed = (
        texts.mapInArrow(_block_rows(width, anchor), ROWS)
        .withColumn("smallest", F.min("doc_id").over(by_block))
        .withColumn("differ", F.min("content").over(by_key) != F.max("content").over(by_key))
        .withColumn("found", F.col("settled") | (F.col("doc_id") > F.col("smallest")))
        .where("found OR differ")
        .select("doc_id", "start", "n", "found")
    )
    parsed = stage(parsed, "factors")
    asked = (
        parsed.where("NOT found")
        .groupBy("doc_id")
        .agg(F.collect_list(F.struct("start", "n")).alias("asked"))
    )
    asked = stage(asked, "boundaries")
    with_text = likely(texts, asked, "doc_id").where("__likely").select("doc_id", "text").dropDuplicates(["doc_id"])
    single = (
        with_text.join(asked, "doc_id")
        .mapInArrow(_window_rows(width), ROWS)
        .withColumn("smallest", F.min("doc_id").over(by_key))
        .where("settled OR doc_id > smallest")
        .select("doc_id", "start", "n")
    )
    end = (F.col("start") + F.col("n") + F.lit(width - 1)).alias("end")
    return (
        parsed.where("found")
        .select("doc_id", "start", "n")
        .unionByName(single)
        .groupBy("doc_id")
        .agg(F.collect_list(F.struct("start", end)).alias("spans"))
    )


KEPT = "doc_id long, n_words long, n_removed long, kept string"


def _remover(digest: bool):
    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.batches(batch, "text"):
                removed, totals, kept = [], [], []
                texts = part.column("text").to_pylist()
                for text, cut in zip(texts, part.column("spans").to_pylist()):
                    own = (text or "").encode().split()
                    totals.append(len(own))
                    if cut:
                        change = np.zeros(len(own) + 1, np.int32)
                        np.add.at(change, [s["start"] for s in cut], 1)
                        np.add.at(change, [s["end"] for s in cut], -1)
                        own = list(compress(own, np.cumsum(change[:-1]) == 0))
                    removed.append(totals[-1] - len(own))
                    left = b" ".join(own)
                    kept.append(hashlib.sha256(left).hexdigest() if digest else left.decode())
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        pa.array(totals, pa.int64()),
                        pa.array(removed, pa.int64()),
                        pa.array(kept, pa.string()),
                    ],
                    ["doc_id", "n_words", "n_removed", "kept"],
                )

    return remove


def remove(docs: DataFrame, cut: DataFrame, digest: bool = False,
           id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, kept: the words left, joined by a space, or their SHA-256."""
    cut = stage(cut, "spans")
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    flagged = likely(texts, cut, "doc_id")
    some = flagged.where("__likely").drop("__likely").join(cut, "doc_id", "left")
    none = flagged.where("NOT __likely").drop("__likely").withColumn(
        "spans", F.lit(None).cast(cut.schema["spans"].dataType)
    )
    return some.unionByName(none).mapInArrow(_remover(digest), KEPT)


SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS n, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
places AS (SELECT n, doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13),
windows AS (SELECT n, doc_id, i, sha256(array_to_string(w[i:i + 12], ' ')) AS h FROM places),
dups AS (
  SELECT n, i FROM windows JOIN (SELECT h, min(doc_id) AS first FROM windows GROUP BY h) USING (h)
  WHERE doc_id > first),
gone AS (SELECT DISTINCT n, unnest(range(i, i + 13)) AS i FROM dups),
every AS (SELECT n, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS word FROM d),
kept AS (
  SELECT n, count(*) AS n_kept, string_agg(word, ' ' ORDER BY i) AS kept
  FROM every ANTI JOIN gone USING (n, i) GROUP BY n)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n_kept, 0))::BIGINT AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (n)
"""
