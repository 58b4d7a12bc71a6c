"""Near-duplicate vectors by cross-polytope hashing with verified pairs.

A hash rotates the vector (three rounds of random signs and a fast Hadamard transform) and takes
the nearest corner of the cross-polytope: the largest coordinate and its sign. A table's
code is several such corners. A vector stands in its own bucket of each table and also
asks the buckets that it missed most narrowly. The number of corners follows the number of
vectors (``shape``), so that buckets of unlike vectors stay small; tables and probes go with
it so that a pair at a cosine of 0.9 meets with a probability of 0.9996 or more (measured
at 64 dimensions). Everything that meets is verified in double precision.

Equal vectors are one class, compared once and counted with their number. A bucket is
worked on in cells of about ``CELL`` by ``CELL`` vectors, so a bucket that holds a third of all
vectors is many small tasks. A cell emits no pairs: per vector it emits the number
of links and one edge towards its group, and a link is counted in the first bucket only in
which its two vectors meet. Components come from these edges.

Vectors that are null, empty, zero, or hold null or non-finite components link with
nothing, not even with equal ones; vectors of different lengths do not link. Rows that
repeat an id are one vector and must hold one value; each is returned. Null ids are returned
without links and component. An empty table gives an empty result. Only the id
and vector columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import stage
from . import words as W
from .components import components

#: vectors on each side of a cell; coordinates looked at for probes; vectors in a bucket
CELL, RANKS, CROWD = 1024, 4, 64
THRESHOLD = 0.9


@dataclass(frozen=True)
class Shape:
    hashes: int
    tables: int
    probes: int


# one table meets with probability 0.66, 0.50 and 0.39 at a cosine of 0.9
SHAPES = (Shape(2, 8, 4), Shape(3, 12, 8), Shape(4, 16, 16))


def shape(vectors: int, dim: int) -> Shape:
    """The first of SHAPES whose buckets hold at most CROWD unlike vectors on average, or the last."""
    corners = 2 << max(1, (dim - 1).bit_length())
    return next((s for s in SHAPES if vectors <= CROWD * corners**s.hashes), SHAPES[-1])


def _hadamard(x: np.ndarray) -> np.ndarray:
    h = 1
    while h < x.shape[1]:
        y = x.reshape(len(x), -1, 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], 2).reshape(len(x), -1)
        h *= 2
    return x / np.sqrt(x.shape[1])


def unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)  # so that no square over- or underflows
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def codes(x: np.ndarray, own: Shape = SHAPES[0]) -> np.ndarray:
    """Unit vectors to codes, n x tables x (1 + probes); the first is a vector's own bucket."""
    tables, probes, hashes = own.tables, own.probes, own.hashes
    n, dim = x.shape
    size = 1 << max(1, (dim - 1).bit_length())
    padded = np.zeros((n, size))
    padded[:, :dim] = x
    signs = np.random.default_rng(dim)
    ranks = min(RANKS, size)
    combos = np.stack(np.meshgrid(*[range(ranks)] * hashes, indexing="ij"), -1).reshape(-1, hashes)
    out = np.zeros((n, tables, 1 + probes), np.int32)
    for t in range(tables):
        cost, code = np.zeros((n, len(combos))), np.zeros((n, len(combos)), np.int64)
        for h in range(hashes):
            y = padded
            for _ in range(3):
                y = _hadamard(y * signs.choice([-1.0, 1.0], size))
            far = np.abs(y)
            top = np.argsort(-far, axis=1, kind="stable")[:, :ranks]
            value = np.take_along_axis(far, top, 1)
            corner = top * 2 + (np.take_along_axis(y, top, 1) > 0)
            cost += ((value[:, :1] - value) ** 2)[:, combos[:, h]]
            code = code * (2 * size) + corner[:, combos[:, h]]
        order = np.argsort(cost, axis=1, kind="stable")[:, : 1 + probes]
        found = np.take_along_axis(code, order, 1) % (2**31 - 1)
        out[:, t, : found.shape[1]] = found
        out[:, t, found.shape[1] :] = found[:, :1]
    return out


def _by_length(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Length, places and values of the vectors of each length."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    offsets = column.offsets.to_numpy().astype(np.int64)
    values = column.values.to_numpy(zero_copy_only=False)
    sizes = np.diff(offsets)
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        yield int(size), at, values[offsets[at][:, None] + np.arange(size)]


def _buckets(code: np.ndarray, size: int) -> np.ndarray:
    """Bucket keys of n x tables x probes codes."""
    table = np.arange(code.shape[1], dtype=np.uint64)[None, :, None]
    key = (np.uint64(size) << np.uint64(40)) + (table << np.uint64(32)) + code.astype(np.uint64)
    return W.mix(key).view(np.int64)


def _own_buckets(own: Shape):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for size, _, x in _by_length(batch.column("embedding")):
                for lo in range(0, len(x), 500):
                    key = _buckets(codes(unit(x[lo : lo + 500]), own), size)
                    base = np.zeros(key.shape, bool)
                    base[:, :, 0] = True
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(key.reshape(-1)), pa.array(base.reshape(-1))], ["bucket", "base"]
                    )

    return rows


MEMBERS = "bucket long, place int, base boolean, id long, copies long, codes binary, vector binary"


def _members(own: Shape):
    each = own.tables * (1 + own.probes)

    def binary(rows: np.ndarray) -> pa.Array:
        """Each row of bytes, ``each`` times."""
        n, width = rows.shape
        ends = pa.py_buffer((np.arange(n * each + 1) * width).astype(np.int32))
        return pa.Array.from_buffers(
            pa.binary(), n * each, [None, ends, pa.py_buffer(np.repeat(rows, each, 0).tobytes())]
        )

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, copies = batch.column("id").to_numpy(), batch.column("copies").to_numpy()
            for size, at, x in _by_length(batch.column("embedding")):
                x = np.ascontiguousarray(x)
                for lo in range(0, len(at), 200):
                    part = slice(lo, lo + 200)
                    code = codes(unit(x[part]), own)
                    n = len(code)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(_buckets(code, size).reshape(-1)),
                            pa.array(np.tile(np.arange(each, dtype=np.int32), n)),
                            pa.array(np.tile(np.arange(each) % (1 + own.probes) == 0, n)),
                            pa.array(np.repeat(ids[at[part]], each)),
                            pa.array(np.repeat(copies[at[part]], each)),
                            binary(np.ascontiguousarray(code).view(np.uint8).reshape(n, -1)),
                            binary(np.ascontiguousarray(x[part]).view(np.uint8).reshape(n, -1)),
                        ],
                        [c.split()[0] for c in MEMBERS.split(", ")],
                    )

    return rows


def _first_meeting(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For pairs of code tables: table * 2**32 + code of the first bucket in which they meet."""
    own_a, own_b = a[:, :, 0], b[:, :, 0]
    none = np.int64(1) << 40
    at_a = np.where((b == own_a[:, :, None]).any(2), own_a, none)
    at_b = np.where((a == own_b[:, :, None]).any(2), own_b, none)
    best = np.minimum(at_a, at_b)
    table = np.argmax(best < none, axis=1)
    return (table.astype(np.int64) << 32) + best[np.arange(len(best)), table]


def _groups(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest place connected with each place."""
    label = np.arange(n)
    while True:
        before = label.copy()
        least = np.minimum(label[i], label[j])
        np.minimum.at(label, i, least)
        np.minimum.at(label, j, least)
        label = label[label]
        if (label == before).all():
            return label


def _cell(rows: pa.Table, dtype: np.dtype, threshold: float, own: Shape):
    """id, links, other of the vectors of one cell that have links."""
    role = rows.column("role").to_numpy()
    query, target = np.flatnonzero(role != 1), np.flatnonzero(role != 2)
    if not len(query) or not len(target) or len(role) < 2:
        return None
    ids = rows.column("id").to_numpy()
    base = rows.column("base").to_numpy(zero_copy_only=False)
    vectors = np.frombuffer(b"".join(rows.column("vector").to_pylist()), dtype).reshape(len(ids), -1)
    x = unit(vectors)
    copies = rows.column("copies").to_numpy()
    code = np.frombuffer(b"".join(rows.column("codes").to_pylist()), np.int32)
    code = code.reshape(len(ids), own.tables, 1 + own.probes).astype(np.int64)
    table = int(rows.column("place")[0].as_py()) // (1 + own.probes)
    links = np.zeros(len(ids), np.int64)
    ends_q, ends_t = [], []
    for lo in range(0, len(query), 512):
        q = query[lo : lo + 512]
        near = x[q] @ x[target].T >= threshold
        i, j = np.nonzero(near)
        i, j = q[i], target[j]
        keep = (ids[i] != ids[j]) & (~base[i] | (ids[i] < ids[j]))
        i, j = i[keep], j[keep]
        if not len(i):
            continue
        ends_q.append(i)
        ends_t.append(j)
        for a in range(0, len(i), 1 << 16):
            p, r = i[a : a + (1 << 16)], j[a : a + (1 << 16)]
            here = (np.int64(table) << 32) + code[r, table, 0]  # a target stands in its own bucket
            first = _first_meeting(code[p], code[r]) == here
            np.add.at(links, p[first], copies[r[first]])
            np.add.at(links, r[first], copies[p[first]])
    if not ends_q:
        return None
    i, j = np.concatenate(ends_q), np.concatenate(ends_t)
    _, same = np.unique(ids, return_inverse=True)  # a vector may be here as query and as target
    group = _groups(int(same.max()) + 1, same[i], same[j])
    firsts = np.zeros(len(group), np.int64)
    firsts[same] = ids
    some = np.unique(np.append(i, j))
    return ids[some], links[some], firsts[group[same[some]]]


def _linked(dtype: np.dtype, threshold: float, own: Shape):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def worked(table: pa.Table, last: bool):
            """The cells of rows in cell order; the last one waits for more rows."""
            cell = table.column("cell").to_numpy()
            edges = np.flatnonzero(np.diff(cell)) + 1
            bounds = [0, *edges.tolist(), *([len(cell)] if last else [])]
            out = [
                _cell(table.slice(a, b - a), dtype, threshold, own)
                for a, b in zip(bounds[:-1], bounds[1:])
                if b - a > 1
            ]
            out = [x for x in out if x]
            rest = [] if last else table.slice(bounds[-1]).combine_chunks().to_batches()
            parts = [np.concatenate(x) for x in zip(*out)] if out else [np.zeros(0, np.int64)] * 3
            return pa.RecordBatch.from_arrays([pa.array(x) for x in parts], ["id", "links", "other"]), rest

        for batch in batches:
            held.append(batch)
            if batch.num_rows and held[0].column("cell")[0] != batch.column("cell")[-1]:
                done, held = worked(pa.Table.from_batches(held), False)
                yield done
        if held:
            yield worked(pa.Table.from_batches(held), True)[0]

    return rows


def dedup(rows: DataFrame, threshold: float = THRESHOLD, id_col: str = "vec_id",
          vector_col: str = "embedding") -> DataFrame:
    """vec_id, n_links, component_id, kept of every row."""
    kind = rows.schema[vector_col].dataType.elementType.simpleString()
    dtype = np.dtype(np.float64 if kind == "double" else np.float32)
    vectors = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast(f"array<{'double' if kind == 'double' else 'float'}>").alias("embedding"))
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    usable = vectors.where(
        F.col("id").isNotNull()
        & F.col("embedding").isNotNull()
        & F.forall("embedding", finite)
        & F.exists("embedding", lambda c: c != 0)
    )
    signed = usable.withColumns(
        {"sig_a": F.xxhash64("embedding"), "sig_b": F.xxhash64(F.lit(1), "embedding")}
    )
    named = stage(signed.select("id", "sig_a", "sig_b").distinct(), "vectors")
    classes = stage(
        named.groupBy("sig_a", "sig_b").agg(F.min("id").alias("rep"), F.count("*").alias("copies")), "classes"
    )
    reps = (
        usable.dropDuplicates(["id"])
        .join(classes.select(F.col("rep").alias("id"), "copies"), "id")
        .select("id", "copies", "embedding")
    )
    reps = stage(reps, "representatives")
    found = reps.agg(F.count("*").alias("n"), F.max(F.size("embedding")).alias("dim")).first()
    own = shape(found["n"], found["dim"] or 1)
    sizes = (
        reps.select("embedding")
        .mapInArrow(_own_buckets(own), "bucket long, base boolean")
        .groupBy("bucket")
        .agg(F.count("*").alias("all"), F.count_if("base").alias("own"))
        .where(F.col("all") > CELL)
        .select("bucket", F.ceil(F.col("own") / CELL).alias("nt"), F.ceil(F.col("all") / CELL).alias("nq"))
    )
    members = reps.mapInArrow(_members(own), MEMBERS).join(stage(sizes, "large"), "bucket", "left")
    spread = F.xxhash64("id", F.lit(2))
    t, q = F.pmod(spread, F.greatest("nt", F.lit(1))), F.pmod(spread, "nq")
    every = lambda n: F.sequence(F.lit(0).cast("long"), F.greatest(n, F.lit(1).cast("long")) - 1)
    cell = lambda role, t, q: F.struct(F.lit(role).alias("role"), t.alias("t"), q.alias("q"))
    # role 0: query and target, 1: target, 2: query
    as_query = F.transform(every("nt"), lambda x: cell(2, x, q))
    as_target = F.transform(every("nq"), lambda x: cell(1, t, x))
    zero = F.lit(0).cast("long")
    cells = (
        F.when(F.col("nq").isNull(), F.when(F.col("base"), F.array(cell(0, zero, zero))).otherwise(F.array(cell(2, zero, zero))))
        .when(F.col("base"), F.concat(as_query, as_target))
        .otherwise(as_query)
    )
    dealt = (
        members.withColumn("at", F.explode(cells))
        .select(F.xxhash64("bucket", "at.t", "at.q").alias("cell"), "at.role", "place", "base", "id", "copies", "codes", "vector")
        .repartition("cell")
        .sortWithinPartitions("cell")
    )
    found = stage(dealt.mapInArrow(_linked(dtype, threshold, own), "id long, links long, other long"), "links")
    counts = found.groupBy("id").agg(F.sum("links").alias("links"))
    comp = components(found.select(F.col("id").alias("a"), F.col("other").alias("b")))
    known = (
        named.join(classes, ["sig_a", "sig_b"])
        .join(counts.withColumnRenamed("id", "rep"), "rep", "left")
        .join(comp.withColumnRenamed("id", "rep"), "rep", "left")
        .select(
            "id",
            (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"),
            F.coalesce("component", "rep").alias("component"),
        )
    )
    component = F.coalesce("component", "id")
    return (
        vectors.select("id")
        .join(known, "id", "left")
        .select(
            F.col("id").alias("vec_id"),
            F.coalesce("links", F.lit(0).cast("long")).alias("n_links"),
            component.alias("component_id"),
            F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"),
        )
    )


SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.9),
counts AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a),
reach(vec_id, other) AS (
  SELECT vec_id, vec_id FROM embeddings
  UNION
  SELECT r.vec_id, l.b FROM reach r JOIN links l ON l.a = r.other)
SELECT e.vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, e.vec_id = component_id AS kept
FROM embeddings e LEFT JOIN counts USING (vec_id)
JOIN (SELECT vec_id, min(other) AS component_id FROM reach GROUP BY vec_id) USING (vec_id)
"""
