"""Benchmark passages in documents: a prefix-filtered set join with position checks.

An item's windows are its runs of ``WINDOW`` words (a shorter item is one window).
A window can only occur where all its shingles of three words do, so one shingle is
enough to find it: each window is indexed under its rarest shingle, by counts over
all documents - the prefix of a set join that asks for full containment. At every
place of a document that holds an indexed shingle, the shingle's offset in the window
fixes where the window would start and end; both must lie in the document, and all
its words are then compared.

The items go to the tasks as blocks of at most ``BLOCK`` windows, one pass over the
documents per block, so a larger benchmark takes more passes and not more memory.
Documents are neither shuffled nor collected.

Null and empty texts have no words and no hits; items without words match nothing.
Repeated items are one window with several ids, repeated documents are judged one by
one. Empty tables give empty results or no hits. Columns of the documents keep their
names and values; the three added ones begin with ``__``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import stage
from . import words as W

#: words in a window, words in a shingle, windows in a block
WINDOW, SHINGLE, BLOCK = 10, 3, 100_000

ADDED = "__n_words long, __spans array<struct<start: long, end: long>>, __items array<string>"


def _split(texts: pa.Array) -> W.Words:
    return W.split(texts, W.PUNCTUATION, lower=True)


def windows(items: DataFrame, id_col="item_id", text_col="text", width: int = WINDOW) -> DataFrame:
    """item (string), words (hashes) of the distinct windows of each item."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = _split(batch.column("text"))
            ids, rows = [], []
            for i, item in enumerate(batch.column("item").to_pylist()):
                own = found.hash[found.first[i] : found.first[i + 1]].view(np.int64)
                n = len(own)
                for at in range(max(1, n - width + 1) if n else 0):
                    ids.append(item)
                    rows.append(own[at : at + width])
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.string()), pa.array(rows, pa.list_(pa.int64()))], ["item", "words"]
            )

    named = items.select(F.col(id_col).cast("string").alias("item"), F.col(text_col).alias("text"))
    return named.mapInArrow(cut, "item string, words array<long>").distinct()


class Block:
    """Windows of one block: their words, items and shingles."""

    def __init__(self, rows: pa.Table, width: int):
        lists = rows.column("words").to_pylist()
        items = rows.column("item").to_pylist()
        by_words: dict[tuple, list] = {}
        for key, item in zip(map(tuple, lists), items):
            by_words.setdefault(key, []).append(item)
        self.items = list(by_words.values())
        self.length = np.array([len(k) for k in by_words], np.int64)
        self.words = np.zeros((len(by_words), width), np.uint64)
        for i, key in enumerate(by_words):
            self.words[i, : len(key)] = np.array(key, np.int64).view(np.uint64)
        # every shingle of every window: (window, offset, hash)
        where, offset, value = [], [], []
        for n in np.unique(self.length):
            own = np.flatnonzero(self.length == n)
            size = min(SHINGLE, int(n))
            for at in range(int(n) - size + 1):
                rolled = _rolled(self.words[own, at : at + size])
                where.append(own)
                offset.append(np.full(len(own), at))
                value.append(rolled)
        join = lambda xs, kind: np.concatenate(xs) if xs else np.zeros(0, kind)
        self.where, self.offset = join(where, np.int64), join(offset, np.int64)
        self.value = join(value, np.uint64)
        self.sizes = sorted({min(SHINGLE, int(n)) for n in self.length})
        self.distinct = np.unique(self.value)

    def index(self, counts: np.ndarray) -> None:
        """Keep of each window its rarest shingle; ``counts`` is by ``distinct``."""
        count = counts[np.searchsorted(self.distinct, self.value)]
        order = np.lexsort((self.value, count, self.where))
        firsts = np.ones(len(order), bool)
        firsts[1:] = np.diff(self.where[order]) != 0
        chosen = order[firsts]
        chosen = chosen[np.argsort(self.value[chosen], kind="stable")]
        self.where, self.offset, self.value = self.where[chosen], self.offset[chosen], self.value[chosen]
        self.distinct, self.at = np.unique(self.value, return_index=True)
        self.at = np.append(self.at, len(self.value))


def _rolled(columns: np.ndarray) -> np.ndarray:
    """The hash ``words.grams`` gives for each row."""
    rows, width = columns.shape
    out = np.full(rows, np.uint64(width))
    for j in range(width):
        out = out * np.uint64(W._ODD) + columns[:, j]
    return W.mix(out)


class Finder:
    """Places of a sorted set of hashes; a bit table turns most places away first."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.bits = np.zeros(1 << 20, bool)
        self.bits[keys >> np.uint64(44)] = True

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in ``hashes`` that hold a key, and which one."""
        if not len(self.keys):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        near = np.flatnonzero(self.bits[hashes >> np.uint64(44)])
        at = np.searchsorted(self.keys, hashes[near])
        at[at == len(self.keys)] = 0
        hit = self.keys[at] == hashes[near]
        return near[hit], at[hit]


def _places(found: W.Words, sizes: list[int], finder: Finder):
    for size in sizes:
        places, keys = finder.find(W.grams(found.hash, size))
        keep = W.inside(found, size)[places]
        yield places[keep], keys[keep]


def shingle_counts(docs: DataFrame, block: Block, text_col: str) -> np.ndarray:
    """How often each of the block's shingles occurs in all documents."""
    shared = docs.sparkSession.sparkContext.broadcast((block.distinct, block.sizes))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, sizes = shared.value
        finder, total = Finder(keys), np.zeros(len(keys), np.int64)
        for batch in batches:
            for part in W.batches(batch, "text"):
                for _, which in _places(_split(part.column("text")), sizes, finder):
                    total += np.bincount(which, minlength=len(keys))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["shingle", "n"])

    rows = (
        docs.select(F.col(text_col).alias("text"))
        .mapInArrow(count, "shingle long, n long")
        .groupBy("shingle")
        .agg(F.sum("n").alias("n"))
        .toArrow()  # a row per shingle of the block at most
    )
    out = np.zeros(len(block.distinct), np.int64)
    out[rows.column("shingle").to_numpy()] = rows.column("n").to_numpy()
    shared.unpersist()
    return out


def occurrences(found: W.Words, block: Block, finder: Finder) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """window, first word, text of each occurrence of a window."""
    out = []
    text_of = found.text_of()
    for places, keys in _places(found, block.sizes, finder):
        n = block.at[keys + 1] - block.at[keys]
        for lo in range(0, len(places), 1 << 18):
            part = slice(lo, lo + (1 << 18))
            place = np.repeat(places[part], n[part])
            nth = np.arange(len(place)) - np.repeat(np.cumsum(n[part]) - n[part], n[part])
            entry = np.repeat(block.at[keys[part]], n[part]) + nth
            window = block.where[entry]
            start = place - block.offset[entry]
            text = text_of[place]
            fits = (start >= found.first[text]) & (start + block.length[window] <= found.first[text + 1])
            start, window, text = start[fits], window[fits], text[fits]
            same = np.ones(len(start), bool)
            for j in range(block.words.shape[1]):
                ask = same & (j < block.length[window])
                same[ask] = found.hash[start[ask] + j] == block.words[window[ask], j]
            out.append((window[same], start[same], text[same]))
    if not out:
        return (np.zeros(0, np.int64),) * 3
    return tuple(np.concatenate(x) for x in zip(*out))


def _merged(start: np.ndarray, end: np.ndarray) -> list[dict]:
    """Union of the spans, in order, touching ones joined."""
    out: list[dict] = []
    for a, b in sorted(zip(start.tolist(), end.tolist())):
        if out and a <= out[-1]["end"]:
            out[-1]["end"] = max(out[-1]["end"], b)
        else:
            out.append({"start": a, "end": b})
    return out


def _marker(shared, text_col: str):
    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared.value
        finder = Finder(block.distinct)
        for batch in batches:
            for part in W.batches(batch, text_col):
                found = _split(part.column(text_col))
                window, start, text = occurrences(found, block, finder)
                spans = part.column("__spans").to_pylist()
                items = part.column("__items").to_pylist()
                order = np.argsort(text, kind="stable")
                window, start, text = window[order], start[order], text[order]
                texts, at = np.unique(text, return_index=True)
                for i, lo, hi in zip(texts.tolist(), at.tolist(), [*at[1:].tolist(), len(text)]):
                    begin = start[lo:hi] - found.first[i]
                    stop = begin + block.length[window[lo:hi]]
                    old = spans[i]
                    spans[i] = _merged(
                        np.append(begin, [s["start"] for s in old]).astype(np.int64),
                        np.append(stop, [s["end"] for s in old]).astype(np.int64),
                    )
                    own = {x for w in set(window[lo:hi].tolist()) for x in block.items[w] if x is not None}
                    items[i] = sorted(own | set(items[i]))
                arrays = [part.column(c) for c in part.schema.names if c not in ("__n_words", "__spans", "__items")]
                names = [c for c in part.schema.names if c not in ("__n_words", "__spans", "__items")]
                arrays += [
                    pa.array(np.diff(found.first), pa.int64()),
                    pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                    pa.array(items, pa.list_(pa.string())),
                ]
                yield pa.RecordBatch.from_arrays(arrays, names + ["__n_words", "__spans", "__items"])

    return mark


def mark(docs: DataFrame, items: DataFrame, text_col="text", id_col="item_id",
         item_text_col="text", width: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """``docs`` with __n_words, __spans (words inside windows, merged) and __items (their item ids)."""
    known = stage(windows(items, id_col, item_text_col, width), "windows")
    n_blocks = max(1, -(-known.count() // block))
    known = known.withColumn("block", F.pmod(F.xxhash64("item", "words"), F.lit(n_blocks)))
    out = docs.withColumns(
        {
            "__n_words": F.lit(0).cast("long"),
            "__spans": F.expr("CAST(array() AS array<struct<start: long, end: long>>)"),
            "__items": F.expr("CAST(array() AS array<string>)"),
        }
    )
    for number in range(n_blocks):
        if number:
            out = stage(out, "marked")
        own = Block(known.where(F.col("block") == number).toArrow(), width)  # about `block` rows
        own.index(shingle_counts(docs, own, text_col))
        shared = docs.sparkSession.sparkContext.broadcast(own)
        out = out.mapInArrow(_marker(shared, text_col), out.schema)
    return out


def digest(marked: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    hit = F.aggregate("__spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return marked.select(
        F.col(id_col).alias("doc_id"),
        F.col("__n_words").alias("n_words"),
        hit.alias("n_hit"),
        F.size("__items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("__items"), ",").cast("binary"), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
    )


SQL = """
WITH d AS (
  SELECT row_number() OVER () AS n, doc_id, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
  FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
  FROM benchmark),
cut AS (
  SELECT item_id, w, least(10, len(w)) AS m, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i
  FROM b WHERE len(w) > 0),
windows AS (
  SELECT DISTINCT item_id, m, array_to_string(w[i:i + m - 1], ' ') AS win FROM cut),
widths AS (SELECT DISTINCT m FROM windows),
places AS (
  SELECT n, m, w, unnest(range(1, len(w) - m + 2)) AS i FROM d, widths WHERE len(w) >= m),
found AS (
  SELECT p.n, p.i, p.m, v.item_id
  FROM (SELECT n, i, m, array_to_string(w[i:i + m - 1], ' ') AS win FROM places) p JOIN windows v USING (m, win)),
hits AS (
  SELECT n, count(DISTINCT x) AS n_hit FROM (SELECT n, unnest(range(i, i + m)) AS x FROM found) GROUP BY n),
ids AS (
  SELECT n, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
  FROM (SELECT DISTINCT n, item_id::VARCHAR AS id FROM found) GROUP BY n)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hits USING (n) LEFT JOIN ids USING (n)
"""
