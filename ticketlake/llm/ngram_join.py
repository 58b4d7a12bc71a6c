"""Similarity self-join of word n-gram sets (Jaccard), by token-combination prefixes.

Let n be a set's size and t the threshold. A partner shares at least ceil(t n) of the
tokens, so it misses fewer than p = n - ceil(t n) + 1 of them. With any order of
tokens that all sets share, the first k shared tokens of two similar sets then lie
within the first p + k - 1 tokens of both: the extended prefix. Here k is 2.

1. Screen. Tokens of a third of the hash range are counted over all documents. A set with p
   tokens that occur nowhere else has no partner: rarest first, its whole prefix
   is unique. This leaves few documents, which alone take part in what follows.
2. Equal sets become one class, represented by its smallest document.
3. The extended prefixes are indexed. Tokens that occur in many sets come last in the order,
   so they are in a prefix only where a set has little else; a bit table of fixed size
   tells them, as any fixed order of tokens is right. Members of a token's list are
   verified against the list's centre, the document whose tokens have the longest lists,
   and what links is joined to components; pairs within a component need no further
   work, which settles groups of any number of near copies in linear time.
4. Between components, rare tokens (lists up to ``RARE``) are indexed singly and frequent ones
   by combinations of two: two similar sets share two tokens of their prefixes, so a rare
   one or two frequent ones. Documents with more than ``WIDE`` open frequent tokens would have
   too many combinations; their tokens are indexed singly, for all.
5. Candidates are verified on the whole sets, and the links joined to components.

Before sets are moved, pairs must pass a bound: each set carries the parities of its tokens in
1,024 bits, and two sets differ in at least as many tokens as their parities differ.

So every link between different components is found; no list, group or pair is
dropped at any size. Sets are held as 64-bit token hashes.

Null and empty texts: an empty set, linked with nothing. Texts with fewer words than a
shingle are one token. A row with a null id gets its size and no component. Rows
that repeat an id are one document and must hold one text. An empty table gives an
empty result. Only the id and text column are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import stage
from . import words as W
from .common import among
from .components import components

RARE, WIDE = 64, 64
#: one in SCREEN tokens, by hash, takes part in the screen
SCREEN = 3
#: bytes of text worked on at once
PIECE = 1 << 21
#: bits of the table of frequent tokens
FREQUENT_BITS = 1 << 25
#: columns of 64 parity bits
PARITIES = [f"b{i}" for i in range(16)]
FULL = "doc_id long, n long, near long, sig_a long, sig_b long, tokens array<long>, " + ", ".join(
    f"{b} long" for b in PARITIES
)


def token_sets(found: W.Words, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct tokens of all texts, text by text and ascending; first token of each text; sizes."""
    n_texts = len(found.first) - 1
    tokens = W.grams(found.hash, width)
    text = found.text_of()
    ok = W.inside(found, width)
    tokens, text = tokens[ok], text[: len(ok)][ok]
    count = np.diff(found.first)
    short = np.flatnonzero((count > 0) & (count < width))
    if len(short):
        tokens = np.append(tokens, W.spans(found.hash, found.first[short], found.first[short + 1]))
        text = np.append(text, short)
    order = np.argsort(tokens)
    kind = np.uint16 if n_texts < 1 << 16 else np.int64
    order = order[np.argsort(text[order].astype(kind), kind="stable")]
    tokens, text = tokens[order], text[order]
    new = np.ones(len(tokens), bool)
    new[1:] = (np.diff(tokens) != 0) | (np.diff(text) != 0)
    tokens, text = tokens[new], text[new]
    size = np.bincount(text, minlength=n_texts)
    return tokens, np.cumsum(size) - size, size


def _lists(tokens: np.ndarray, first: np.ndarray, size: np.ndarray) -> pa.Array:
    offsets = np.append(first, first[-1] + size[-1]) if len(first) else np.zeros(1)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(tokens.view(np.int64)))


def parities(tokens: np.ndarray, size: np.ndarray) -> list[np.ndarray]:
    """For each text, in 64-bit columns, whether an odd number of its tokens falls on a bit."""
    width = 64 * len(PARITIES)
    at = np.repeat(np.arange(len(size)), size) * width + (tokens % np.uint64(width)).astype(np.int64)
    odd = np.bincount(at, minlength=len(size) * width).astype(np.uint8) & 1
    packed = np.packbits(odd.reshape(len(size), width), axis=1).view(np.int64)
    return [np.ascontiguousarray(packed[:, i]) for i in range(len(PARITIES))]


def _sampled(width: int):
    """doc_id, n and the screened tokens of each text."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.batches(batch, "text", PIECE):
                tokens, first, size = token_sets(W.split(part.column("text"), W.SPACES, True), width)
                of = np.repeat(np.arange(len(size)), size)
                keep = tokens % np.uint64(SCREEN) == 0
                tokens, of = tokens[keep], of[keep]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(tokens.view(np.int64)),
                        part.column("doc_id").take(pa.array(of)),
                        pa.array(size[of], pa.int64()),
                    ],
                    ["token", "doc_id", "n"],
                )

    return rows


def _full(width: int):
    """doc_id, n, near, signature, tokens and parities.

    ``near`` is the smallest document of the batch with an equal set; only that one has tokens.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.batches(batch, "text", PIECE):
                tokens, first, size = token_sets(W.split(part.column("text"), W.SPACES, True), width)
                one = W.spans(tokens, first, first + size)
                two = W.spans(W.mix(tokens + np.uint64(7)), first, first + size)
                ids = part.column("doc_id").to_pylist()
                best: dict = {}
                for i, key in enumerate(zip(one.tolist(), two.tolist())):
                    if ids[i] is not None and (key not in best or ids[i] < ids[best[key]]):
                        best[key] = i
                near = [None if d is None else ids[best[key]] for d, key in zip(ids, zip(one.tolist(), two.tolist()))]
                held = np.zeros(len(ids), bool)
                held[list(best.values())] = True
                keep = np.repeat(held, size)
                kept = np.where(held, size, 0)
                lists = _lists(tokens[keep], np.cumsum(kept) - kept, kept)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        pa.array(size, pa.int64()),
                        pa.array(near, pa.int64()),
                        pa.array(one.view(np.int64)),
                        pa.array(two.view(np.int64)),
                        lists,
                        *[pa.array(b) for b in parities(tokens, size)],
                    ],
                    ["doc_id", "n", "near", "sig_a", "sig_b", "tokens", *PARITIES],
                )

    return rows


def _frequent_bits(tokens: DataFrame) -> np.ndarray:
    """A packed bit table that has a bit for each token in more than RARE sets."""
    bucket, place = "bitmap_bucket_number(bit)", "bitmap_bit_position(bit)"
    rows = (
        tokens.groupBy("token")
        .agg(F.count("*").alias("c"))
        .where(F.col("c") > RARE)
        .select((F.pmod("token", F.lit(FREQUENT_BITS)) + 1).alias("bit"))
        .groupBy(F.expr(bucket).alias("bucket"))
        .agg(F.expr(f"bitmap_construct_agg({place})").alias("bits"))
        .toArrow()  # at most FREQUENT_BITS / 32768 rows of 4 KB
    )
    out = np.zeros((FREQUENT_BITS // 32768, 4096), np.uint8)
    for bucket, bits in zip(rows.column("bucket").to_pylist(), rows.column("bits").to_pylist()):
        out[bucket - 1] = np.frombuffer(bits, np.uint8)
    return out.reshape(-1)


def _prefixes(shared):
    """id, n and the first ``q`` tokens of each set, frequent ones last."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for batch in (b.slice(at, 500) for b in batches for at in range(0, b.num_rows, 500)):
            lists = batch.column("tokens")
            tokens = lists.flatten().to_numpy()
            size = np.diff(lists.offsets.to_numpy())
            of = np.repeat(np.arange(len(size)), size)
            place = tokens & (FREQUENT_BITS - 1)
            frequent = (bits[place >> 3] >> (place & 7)) & 1
            order = np.argsort(of * 2 + frequent, kind="stable")
            rank = np.arange(len(tokens)) - np.repeat(np.cumsum(size) - size, size)
            keep = rank < np.repeat(batch.column("q").to_numpy(), size)
            of = of[keep]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").take(pa.array(of)), batch.column("n").take(pa.array(of)), pa.array(tokens[order][keep])],
                ["id", "n", "token"],
            )

    return rows


class Threshold:
    """Jaccard >= num / den, over one half."""

    def __init__(self, num: int, den: int):
        if not den < 2 * num <= 2 * den:
            raise ValueError("the threshold must be over 1/2 and at most 1")
        self.num, self.den = num, den

    def shared(self, n: Column) -> Column:
        """Tokens that a partner of a set of n tokens shares at least."""
        return F.floor((n * self.num + (self.den - 1)) / self.den)

    def prefix(self, n: Column) -> Column:
        return n - self.shared(n) + 1

    def extended(self, n: Column) -> Column:
        """Length of the prefix that holds the first two shared tokens."""
        return F.least(self.prefix(n) + 1, n)

    def near(self, n: Column, m: Column) -> Column:
        """Whether the sizes allow a link."""
        return F.least(n, m) * self.den >= F.greatest(n, m) * self.num

    def possible(self, a: str, b: str) -> Column:
        """Whether sizes and parities (columns prefixed by ``a`` and ``b``) allow a link."""
        n, m = F.col(f"{a}n"), F.col(f"{b}n")
        differ = sum((F.bit_count(F.col(f"{a}{x}").bitwiseXOR(F.col(f"{b}{x}"))) for x in PARITIES), F.lit(0))
        return self.near(n, m) & (differ * (self.den + self.num) <= (n + m) * (self.den - self.num))


def _prefixed(rows: DataFrame, prefix: str, keep: tuple[str, ...] = ()) -> DataFrame:
    return rows.select(*[F.col(c).alias(c if c in keep else prefix + c) for c in rows.columns])


def _likely(pairs: DataFrame, sets: DataFrame, limit: Threshold) -> DataFrame:
    """The pairs (a_id, b_id) that sizes and parities allow."""
    some = sets.where("size(tokens) > 0").select(F.col("doc_id").alias("id"), "n", *PARITIES)
    return (
        pairs.join(_prefixed(some, "a_"), "a_id")
        .join(_prefixed(some, "b_"), "b_id")
        .where(limit.possible("a_", "b_"))
        .select("a_id", "b_id")
    )


def _similar(pairs: DataFrame, sets: DataFrame, limit: Threshold) -> DataFrame:
    """The pairs (a_id, b_id) whose whole sets are similar; few pairs, so few sets are moved."""
    ids = pairs.select(F.col("a_id").alias("id")).unionByName(pairs.select(F.col("b_id").alias("id")))
    held = sets.where("size(tokens) > 0").select(F.col("doc_id").alias("id"), "n", "tokens")
    whole = stage(among(held, ids, "id"), "whole")
    both = F.size(F.array_intersect("a_tokens", "b_tokens"))
    return (
        pairs.join(_prefixed(whole, "a_"), "a_id")
        .join(_prefixed(whole, "b_"), "b_id")
        .where(both * limit.den >= (F.col("a_n") + F.col("b_n") - both) * limit.num)
        .select("a_id", "b_id")
    )


def _crossing(rows: DataFrame, limit: Threshold) -> DataFrame:
    """Pairs under one key that sizes and parities allow; rows: key, comp, alone, id, n, parities.

    Documents that have no link yet (``alone``) meet all others, each pair once. The
    rest are paired by component first, so members of one component never meet,
    however many.
    """
    both = lambda a, b: _prefixed(a, "a_", ("key",)).join(_prefixed(b, "b_", ("key",)), "key")
    possible = limit.possible("a_", "b_")
    once = ~F.col("b_alone") | (F.col("a_id") < F.col("b_id"))
    meet = both(rows.where("alone"), rows).where(once & possible)
    grouped = rows.where("NOT alone")
    comps = grouped.select("key", "comp").distinct()
    pairs = both(comps, comps).where("a_comp < b_comp")
    apart = (
        pairs.join(_prefixed(grouped, "a_", ("key",)), ["key", "a_comp"])
        .join(_prefixed(grouped, "b_", ("key",)), ["key", "b_comp"])
        .where(possible)
    )
    return meet.select("a_id", "b_id").unionByName(apart.select("a_id", "b_id"))


def _in_order(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a_id", "b_id").alias("a_id"), F.greatest("a_id", "b_id").alias("b_id")).distinct()


def _classes(sets: DataFrame) -> DataFrame:
    """near, rep: the smallest document of all with an equal set, for each batch's smallest."""
    firsts = sets.where("doc_id = near").select("near", "sig_a", "sig_b")
    smallest = firsts.groupBy("sig_a", "sig_b").agg(F.min("near").alias("rep"))
    return firsts.join(smallest, ["sig_a", "sig_b"]).select("near", "rep")


def _links(sets: DataFrame, classes: DataFrame, limit: Threshold) -> DataFrame:
    """Links (a, b) between representatives, enough to connect what is connected."""
    n = F.col("n")
    held = sets.where("n > 0 AND size(tokens) > 0").select(
        F.col("doc_id").alias("id"), "n", limit.extended(n).cast("int").alias("q"), "tokens"
    )
    frequent = _frequent_bits(held.select(F.explode("tokens").alias("token")))
    shared = sets.sparkSession.sparkContext.broadcast(frequent)  # 4 MB
    posted = held.mapInArrow(_prefixes(shared), "id long, n long, token long").join(
        classes.where("near = rep").select(F.col("rep").alias("id")), "id", "left_semi"
    )
    posted = stage(posted, "prefixes")
    lists = posted.groupBy("token").agg(F.count("*").alias("c")).where("c > 1")
    listed = stage(posted.join(lists, "token"), "lists")

    central = listed.groupBy("id").agg(F.sum("c").alias("weight"))
    centres = (
        listed.select("token", "id")
        .join(central, "id")
        .groupBy("token")
        .agg(F.max_by("id", F.struct("weight", -F.col("id"))).alias("hub"))
    )
    stars = (
        listed.join(centres, "token")
        .where("id <> hub")
        .groupBy("id", "hub")
        .agg(F.count("*").alias("m"), F.min("n").alias("n"))
        .where(F.col("m") * 16 >= limit.prefix(n))  # centres of chance lists are left to step 4
        .select(F.col("hub").alias("a_id"), F.col("id").alias("b_id"))
    )
    likely = stage(_likely(_in_order(stars), sets, limit), "likely")
    linked = stage(_similar(likely, sets, limit), "links")

    comp = components(linked.toDF("a", "b"))
    placed = listed.join(comp, "id", "left").select(
        F.col("token").alias("key"),
        "id",
        "n",
        "c",
        F.coalesce("component", "id").alias("comp"),
        F.col("component").isNull().alias("alone"),
    )
    open_lists = (
        placed.groupBy("key")
        .agg(F.min("comp").alias("low"), F.max("comp").alias("high"))
        .where("low < high")
        .select("key")
    )
    placed = stage(placed.join(open_lists, "key", "left_semi"), "open")
    frequent = placed.where(F.col("c") > RARE)
    widths = frequent.groupBy("id").agg(F.count("*").alias("f")).where(F.col("f") > WIDE).select("id")
    wide = stage(frequent.join(widths, "id", "left_semi").select("key").distinct(), "wide")

    own = ["id", "n", "comp", "alone"]
    combined = (
        frequent.join(wide, "key", "left_anti")
        .groupBy(*own)
        .agg(F.array_sort(F.collect_list("key")).alias("t"))
        .withColumn("i", F.explode(F.sequence(F.lit(1), F.size("t"))))
        .withColumn("second", F.explode(F.slice("t", F.col("i") + 1, F.size("t"))))
        .select(F.xxhash64(F.element_at("t", F.col("i")), "second").alias("key"), *own)
    )
    single = placed.where(F.col("c") <= RARE).select("key", *own)
    single = single.unionByName(frequent.join(wide, "key", "left_semi").select("key", *own))
    bits = sets.where("size(tokens) > 0").select(F.col("doc_id").alias("id"), *PARITIES)
    keyed = stage(single.unionByName(combined).join(bits, "id"), "keyed")
    pairs = stage(_in_order(_crossing(keyed, limit)), "pairs")
    return linked.unionByName(_similar(pairs, sets, limit)).toDF("a", "b")


def join(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100,
         id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (smallest linked doc_id) of every row.

    ``width`` words make a shingle; sets with Jaccard >= num / den link.
    """
    limit = Threshold(num, den)
    every = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    texts = every.where("doc_id IS NOT NULL")
    n = F.col("n")
    alone = (
        texts.mapInArrow(_sampled(width), "token long, doc_id long, n long")
        .groupBy("token")
        .agg(F.count("*").alias("c"), F.min("doc_id").alias("doc_id"), F.min("n").alias("n"))
        .where("c = 1")
        .groupBy("doc_id")
        .agg(F.count("*").alias("unique"), F.min("n").alias("n"))
        .where(F.col("unique") >= limit.prefix(n))
        .select("doc_id", "n")
    )
    alone = stage(alone, "alone")
    rest = texts.select("doc_id").distinct().join(alone, "doc_id", "left_anti")
    rest = among(texts, stage(rest, "rest"), "doc_id").dropDuplicates(["doc_id"])
    sets = stage(rest.select("doc_id", "text").mapInArrow(_full(width), FULL), "sets")

    classes = stage(_classes(sets), "classes")
    comp = components(_links(sets, classes, limit))
    empty = F.col("n") == 0
    placed = (
        sets.select("doc_id", "n", "near")
        .join(classes, "near")
        .join(comp.withColumnRenamed("id", "rep"), "rep", "left")
        .select("doc_id", "n", F.when(empty, F.col("doc_id")).otherwise(F.coalesce("component", "rep")).alias("component_id"))
    )
    known = placed.unionByName(alone.select("doc_id", "n", F.col("doc_id").alias("component_id")))
    without = every.where("doc_id IS NULL").mapInArrow(_full(width), FULL)
    return (
        texts.select("doc_id")
        .join(known, "doc_id")
        .unionByName(without.select("doc_id", "n", F.col("doc_id").alias("component_id")))
        .select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    )


SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
tokens AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS token
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM tokens GROUP BY doc_id),
pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared
  FROM tokens a JOIN tokens b ON a.token = b.token AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM pairs JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
  WHERE 100 * shared >= 90 * (x.n + y.n - shared)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(doc_id, other) AS (
  SELECT doc_id, doc_id FROM d
  UNION
  SELECT r.doc_id, e.b FROM reach r JOIN edges e ON e.a = r.other)
SELECT d.doc_id, coalesce(s.n, 0)::BIGINT AS n_shingles, c.component_id
FROM d LEFT JOIN sizes s USING (doc_id)
JOIN (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id) c USING (doc_id)
"""
