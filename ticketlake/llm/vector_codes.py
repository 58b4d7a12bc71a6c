"""Product codes for vectors: integer k-means per part, nearest entries found by a GNAT.

Components become integers, floor(1024 * x), and vectors are cut into four equal parts. Each part
has a codebook of up to 256 entries. A codebook is indexed by a geometric near-neighbour
access tree: a node holds up to ``ARITY`` split entries, each remaining entry goes to the child of
its nearest split, and for each pair of split i and child j the node stores the range of
distances from i to the entries of j, i's own split included. A query's distance to split i rules
out child j as a whole where the triangle inequality puts everything in it strictly beyond the best
entry found so far. Square roots and differences are rounded so that this bound is never too
high, and what is left is compared by exact integer squared distances, ties to the lower index. So
the result is that of comparing all entries.

Arithmetic is exact at any size: where all squared distances stay below 2**53, doubles hold
them exactly and a batch is a few matrix products; beyond, Python integers are used.
Sums travel in limbs of 40 bits, so no sum overflows.

Rounds are jobs: a task adds up its own vectors per entry and sends the sums, at most one
row per codebook number, whatever its number of rows; the driver holds codebooks only (256 times the
dimension). Nothing else is collected and vectors are never shuffled, so equal
vectors, however many, stay where they are read.

Rows whose vector is null or holds null or non-finite components are dropped. Vectors shorter than
the longest, empty ones included, count as followed by zeros, as does a length that four
does not divide. Codebooks start from the smallest ids, nulls last, ties by vector; a repeated row
counts as often as it is there. Errors beyond a long are null. An empty table gives an empty result. Only
the id, vector and label columns are read, so others may have any name.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass, field
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import stage
from .common import as_small

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: split entries of a node, entries in a leaf, rows worked on at once
ARITY, LEAF, ROWS = 8, 8, 8192
#: squared distances below this are exact in doubles
EXACT = 1 << 53
LIMB = 40
MAX_LONG = (1 << 63) - 1


def usable(vector: Column) -> Column:
    """Neither null nor with a null or non-finite component."""
    whole = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return vector.isNotNull() & F.forall(vector, whole)


# --- integers ---------------------------------------------------------------------------------


def _integers(x: np.ndarray, width: int) -> np.ndarray:
    """floor(1024 * x), filled up to PARTS * width columns: doubles, or Python integers where they are large."""
    full = np.zeros((len(x), PARTS * width))
    full[:, : x.shape[1]] = x
    with np.errstate(over="ignore"):
        out = np.floor(full * SCALE)
    if _small(out, width):
        return out
    exact = [[math.floor(Fraction(v) * SCALE) for v in row] for row in full.tolist()]
    return np.array(exact, dtype=object).reshape(full.shape)


def _small(x: np.ndarray, width: int) -> bool:
    """Whether squared distances between such parts, and twice their products, stay below EXACT."""
    most = float(np.abs(x).max()) if x.size else 0.0
    return 8 * max(1, width) * most * most < EXACT


def _as_python(x: np.ndarray) -> np.ndarray:
    if x.dtype == object:
        return x
    return np.array([[int(v) for v in row] for row in x.tolist()], dtype=object).reshape(x.shape)


def _squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows of ``a`` to all rows of ``b`` (a few split entries)."""
    return (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a.dot(b.T)


_root = np.frompyfunc(lambda v: math.isqrt(v), 1, 1)


def _low(squared: np.ndarray) -> np.ndarray:
    """At most the square root."""
    if squared.dtype == object:
        return _root(squared)
    return np.nextafter(np.sqrt(squared), 0)


def _high(squared: np.ndarray) -> np.ndarray:
    """At least the square root."""
    if squared.dtype == object:
        return _root(squared) + 1
    return np.nextafter(np.sqrt(squared), np.inf)


def _bound(squared: np.ndarray) -> np.ndarray:
    """What a difference of doubles must exceed to be, unrounded, more than the square root.

    One step above ``_high``: a rounded difference is at most one part in 2**53 too large.
    """
    high = _high(squared)
    return high if high.dtype == object else np.nextafter(high, np.inf)


# --- the tree ---------------------------------------------------------------------------------


@dataclass
class Node:
    """Split entries, the range of distances from split i (row) to child j (column), and the children."""

    splits: np.ndarray
    low: np.ndarray | None = None
    high: np.ndarray | None = None
    children: list[Node | None] = field(default_factory=list)


def _spread(entries: np.ndarray, at: np.ndarray) -> list[int]:
    """ARITY places in ``at``: the first, then each time the one farthest from those taken."""
    taken = [0]
    far = _squared(entries[at], entries[at[:1]])[:, 0]
    while len(taken) < ARITY:
        far[taken] = -1
        taken.append(int(np.argmax(far)))
        far = np.minimum(far, _squared(entries[at], entries[at[taken[-1:]]])[:, 0])
    return taken


def build(entries: np.ndarray, at: np.ndarray | None = None) -> Node:
    """The tree over the rows ``at`` of ``entries``; all of them by default."""
    at = np.arange(len(entries)) if at is None else at
    if len(at) <= LEAF:
        return Node(at)
    taken = sorted(_spread(entries, at))
    splits, rest = at[taken], np.delete(at, taken)
    to_splits = _squared(entries[rest], entries[splits])
    nearest = np.argmin(to_splits, axis=1)
    between = _squared(entries[splits], entries[splits])
    low, high = between.copy(), between.copy()  # a child holds its own split
    for j in range(len(splits)):
        own = to_splits[nearest == j]
        if len(own):
            low[:, j] = np.minimum(low[:, j], own.min(0))
            high[:, j] = np.maximum(high[:, j], own.max(0))
    groups = [rest[nearest == j] for j in range(len(splits))]
    return Node(splits, _low(low), _high(high), [build(entries, g) if len(g) else None for g in groups])


class Search:
    """Nearest entries of many queries at once; ``compared`` counts the distances that were looked at."""

    def __init__(self, entries: np.ndarray, queries: np.ndarray):
        self.entries, self.queries = entries, queries
        n = len(queries)
        self.index = np.zeros(n, np.int64)
        # the first entry is as good a start as any
        self.best = _squared(queries, entries[:1])[:, 0]
        self.compared = 0

    def _offer(self, rows: np.ndarray, found: np.ndarray, entry: np.ndarray) -> None:
        """Exact comparison; of equal distances the lower index stays."""
        have = self.best[rows]
        better = ((found < have) | ((found == have) & (entry < self.index[rows]))).astype(bool)
        self.best[rows[better]] = found[better]
        self.index[rows[better]] = entry[better]

    def run(self, node: Node, rows: np.ndarray) -> None:
        squared = _squared(self.queries[rows], self.entries[node.splits])
        self.compared += squared.size
        # splits are in ascending order, so the first of equals is the lowest
        at = np.argmin(squared, axis=1)
        self._offer(rows, squared[np.arange(len(rows)), at], node.splits[at])
        if node.low is None:
            return
        near, far, best = _low(squared), _high(squared), _bound(self.best[rows])[:, None]
        out = np.zeros(squared.shape, bool)
        for i in range(len(node.splits)):
            out |= (near[:, i, None] - node.high[i] > best).astype(bool)
            out |= (node.low[i] - far[:, i, None] > best).astype(bool)
        for j, child in enumerate(node.children):
            left = np.flatnonzero(~out[:, j]) if child else ()
            if len(left):
                self.run(child, rows[left])


@dataclass
class Codebooks:
    """Entries per part, as doubles or Python integers, and their trees."""

    width: int
    entries: list[np.ndarray]

    def __post_init__(self):
        self.trees = [build(e) for e in self.entries]

    def assign(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest entry of each part and its squared distance, n x PARTS each."""
        index, squared = [], []
        for part, (entries, tree) in enumerate(zip(self.entries, self.trees)):
            own = vectors[:, part * self.width : (part + 1) * self.width]
            if own.dtype != entries.dtype:
                own, entries = _as_python(own), _as_python(entries)
                tree = build(entries)
            search = Search(entries, own)
            if self.width:
                search.run(tree, np.arange(len(own)))
            index.append(search.index)
            squared.append(search.best)
        return np.stack(index, 1), np.stack(squared, 1)

    def numbers(self) -> list[list[list[int]]]:
        """Part, entry, component."""
        return [[[int(v) for v in row] for row in entries] for entries in self.entries]

    def sha256(self) -> str:
        flat = ",".join(str(v) for part in self.numbers() for row in part for v in row)
        return hashlib.sha256(flat.encode()).hexdigest()


def codebooks(numbers: list[list[list[int]]], width: int) -> Codebooks:
    """Codebooks of Python integers, kept as doubles where those are exact."""
    books = []
    for part in numbers:
        exact = np.array(part, dtype=object).reshape(len(part), width)
        within = all(abs(v) < EXACT for row in part for v in row)  # larger ones may not fit a double at all
        floats = exact.astype(np.float64) if within else None
        books.append(floats if within and _small(floats, width) else exact)
    return Codebooks(width, books)


# --- rounds -----------------------------------------------------------------------------------


def _vectors(batch: pa.RecordBatch, width: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and integers of a batch, some rows at a time; rows of one length and size together."""
    column = batch.column("vector")
    offsets = column.offsets.to_numpy().astype(np.int64)
    values = column.values.to_numpy(zero_copy_only=False)
    sizes = np.diff(offsets)
    for size in np.unique(sizes):
        every = np.flatnonzero(sizes == size)
        for lo in range(0, len(every), ROWS):
            at = every[lo : lo + ROWS]
            x = values[offsets[at][:, None] + np.arange(size)].astype(np.float64).reshape(len(at), size)
            large = 8.0 * max(1, width) * (np.abs(x).max(1, initial=0) * SCALE + 1) ** 2 >= EXACT
            for pick in (~large, large):  # a few large rows do not slow the others down
                if pick.any():
                    yield at[pick], _integers(x[pick], width)


def _limbs(value: int) -> Iterator[tuple[int, int]]:
    sign, value, limb = (-1 if value < 0 else 1), abs(value), 0
    while value:
        yield limb, sign * (value & ((1 << LIMB) - 1))
        value >>= LIMB
        limb += 1


SUMS = "part int, entry int, place int, limb int, value long"


def _add_up(shared):
    """Each task's sums per part, entry and place; place -1 counts the vectors."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books: Codebooks = shared.value
        width = books.width
        counts = np.zeros((PARTS, ENTRIES), np.int64)
        sums = np.zeros((PARTS, ENTRIES, width), object)
        for batch in batches:
            for _, x in _vectors(batch, width):
                index, _ = books.assign(x)
                for part in range(PARTS):
                    own = x[:, part * width : (part + 1) * width]
                    entry = index[:, part]
                    counts[part] += np.bincount(entry, minlength=ENTRIES)
                    if x.dtype == object:
                        np.add.at(sums[part], entry, own)
                    else:  # exact: ROWS times components below 2**26
                        for place in range(width):
                            found = np.bincount(entry, own[:, place], ENTRIES)
                            sums[part][:, place] += found.astype(np.int64)
        out = []
        for part, entry in zip(*np.nonzero(counts)):
            out.append((int(part), int(entry), -1, 0, int(counts[part, entry])))
            for place, value in enumerate(sums[part, entry]):
                out += [(int(part), int(entry), place, limb, v) for limb, v in _limbs(int(value))]
        if out:
            names = [c.split()[0] for c in SUMS.split(", ")]
            kinds = [pa.int32()] * 4 + [pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)

    return rows


def _kept(vectors: DataFrame, id_col: str, vector_col: str, label_col: str | None) -> DataFrame:
    kind = vectors.schema[vector_col].dataType.simpleString()
    vector = F.col(vector_col) if kind in ("array<float>", "array<double>") else F.col(vector_col).cast("array<double>")
    columns = [F.col(id_col).cast("long").alias("vec_id"), vector.alias("vector")]
    if label_col:
        columns.append(F.col(label_col).alias("label"))
    return vectors.select(*columns).where(usable(F.col("vector")))


def fit(vectors: DataFrame, rounds: int = ROUNDS, id_col: str = "vec_id", vector_col: str = "embedding") -> Codebooks:
    """Codebooks after ``rounds`` rounds over all usable rows."""
    kept = _kept(vectors, id_col, vector_col, None)
    longest = kept.agg(F.max(F.size("vector"))).first()[0] or 0
    width = -(-longest // PARTS)
    first = kept.orderBy(F.asc_nulls_last("vec_id"), "vector").limit(ENTRIES).collect()  # ENTRIES rows at most
    start = []
    for row in first:
        start += _integers(np.array([row["vector"]], np.float64).reshape(1, -1), width).tolist()
    numbers = [
        [[int(v) for v in row[part * width : (part + 1) * width]] for row in start] for part in range(PARTS)
    ]
    for _ in range(rounds if first else 0):
        shared = kept.sparkSession.sparkContext.broadcast(codebooks(numbers, width))
        sums = kept.select("vector").mapInArrow(_add_up(shared), SUMS)
        found = sums.groupBy("part", "entry", "place", "limb").agg(F.sum("value").alias("value")).collect()
        total: dict[tuple[int, int, int], int] = {}
        for r in found:  # a row per codebook number and limb
            key = (r["part"], r["entry"], r["place"])
            total[key] = total.get(key, 0) + (r["value"] << (LIMB * r["limb"]))
        for (part, entry, place), count in total.items():
            if place < 0:
                numbers[part][entry] = [total.get((part, entry, p), 0) // count for p in range(width)]
        shared.unpersist()
    return codebooks(numbers, width)


def _encode(shared):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books: Codebooks = shared.value
        for batch in batches:
            code, error = [None] * batch.num_rows, [None] * batch.num_rows
            for at, x in _vectors(batch, books.width):
                index, squared = books.assign(x)
                for i, own, sums in zip(at.tolist(), index.tolist(), squared.tolist()):
                    code[i] = "".join(f"{v:02x}" for v in own)
                    total = sum(map(int, sums))
                    error[i] = total if total <= MAX_LONG else None
            names = [n for n in batch.schema.names if n != "vector"]
            yield pa.RecordBatch.from_arrays(
                [batch.column(n) for n in names] + [pa.array(code, pa.string()), pa.array(error, pa.int64())],
                [*names, "code", "error"],
            )

    return rows


def encode(vectors: DataFrame, books: Codebooks, id_col: str = "vec_id", vector_col: str = "embedding",
           label_col: str | None = "label") -> DataFrame:
    """vec_id, label, code and error of every usable row."""
    kept = _kept(vectors, id_col, vector_col, label_col)
    shared = kept.sparkSession.sparkContext.broadcast(books)
    label = f"label {vectors.schema[label_col].dataType.simpleString()}, " if label_col else ""
    columns = ["vec_id", "label", "vector"] if label_col else ["vec_id", "vector"]
    return kept.select(*columns).mapInArrow(_encode(shared), f"vec_id long, {label}code string, error long")


def decode(code: str, books: Codebooks) -> list[int]:
    """The integers a code stands for, fillers included."""
    numbers = books.numbers()
    return [v for part in range(PARTS) for v in numbers[part][int(code[2 * part : 2 * part + 2], 16)]]


def compress(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 and label of every usable row."""
    books = fit(vectors, id_col=id_col, vector_col=vector_col)
    coded = stage(encode(vectors, books, id_col, vector_col, label_col), "codes")
    total = F.sum(F.col("error").cast("decimal(20,0)"))
    fits = (F.count("error") == F.count("*")) & (total <= F.lit(MAX_LONG))
    sums = coded.groupBy("label").agg(F.when(fits, total).cast("long").alias("label_error"))
    sums = sums.withColumnRenamed("label", "name")
    return (
        coded.join(as_small(sums), F.col("label").eqNullSafe(F.col("name")), "left")
        .withColumn("codebooks_sha256", F.lit(books.sha256()))
        .select("vec_id", "code", "error", "label_error", "codebooks_sha256", "label")
    )


def _sql() -> str:
    def nearest(name: str, books: str) -> str:
        return f"""
{name} AS MATERIALIZED (
  SELECT n, part, arg_min(entry, (squared, entry)) AS entry, min(squared) AS squared
  FROM (SELECT p.n, p.part, b.entry,
               list_sum(list_transform(list_zip(p.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS squared
        FROM parts p JOIN {books} b USING (part)) GROUP BY n, part)"""

    steps = []
    for r in range(ROUNDS):
        steps.append(nearest(f"near{r}", f"book{r}"))
        steps.append(
            f"""
sums{r} AS (
  SELECT part, entry, place, sum(x)::BIGINT AS s, count(*) AS c
  FROM (SELECT part, entry, unnest(v) AS x, generate_subscripts(v, 1) AS place FROM near{r} JOIN parts USING (n, part))
  GROUP BY part, entry, place),
moved{r} AS (
  SELECT part, entry, list((s - ((s % c) + c) % c) // c ORDER BY place) AS v FROM sums{r} GROUP BY part, entry),
book{r + 1} AS MATERIALIZED (
  SELECT part, entry, coalesce(m.v, b.v) AS v FROM book{r} b LEFT JOIN moved{r} m USING (part, entry))"""
        )
    steps.append(nearest("final", f"book{ROUNDS}"))
    return f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS n, vec_id, label,
         list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS MATERIALIZED (
  SELECT n, part, v[part * len(v) // {PARTS} + 1 : (part + 1) * len(v) // {PARTS}] AS v
  FROM kept CROSS JOIN range({PARTS}) AS r(part)),
book0 AS MATERIALIZED (SELECT part, n - 1 AS entry, v FROM parts WHERE n <= {ENTRIES}),{",".join(steps)},
digest AS (
  SELECT sha256(string_agg(x::VARCHAR, ',' ORDER BY part, entry, place)) AS codebooks_sha256
  FROM (SELECT part, entry, unnest(v) AS x, generate_subscripts(v, 1) AS place FROM book{ROUNDS})),
coded AS (
  SELECT n, string_agg(lpad(to_hex(entry), 2, '0'), '' ORDER BY part) AS code, sum(squared)::BIGINT AS error
  FROM final GROUP BY n)
SELECT vec_id, lower(code) AS code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256, label
FROM kept JOIN coded USING (n) CROSS JOIN digest
"""


SQL = _sql()
