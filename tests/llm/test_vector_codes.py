"""Product codes against a brute-force k-means over Python integers."""

import hashlib
import math
import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from ticketlake.llm import vector_codes as V


def brute(rows, rounds=4):
    """(vec_id, label) rows with code, error, label_error, sha, in plain Python."""
    kept = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    width = -(-max((len(r[1]) for r in kept), default=0) // 4)
    whole = [[math.floor(Fraction(x) * 1024) for x in r[1]] + [0] * (4 * width - len(r[1])) for r in kept]
    first = sorted(range(len(kept)), key=lambda i: (kept[i][0] is None, kept[i][0] or 0, kept[i][1]))[:256]
    books = [[whole[i][p * width : (p + 1) * width] for i in first] for p in range(4)]

    def nearest(p):
        out = []
        for v in whole:
            own = v[p * width : (p + 1) * width]
            out.append(min((sum((a - b) ** 2 for a, b in zip(own, e)), i) for i, e in enumerate(books[p])))
        return out

    for _ in range(rounds):
        for p in range(4):
            groups = {}
            for (_, i), v in zip(nearest(p), whole):
                groups.setdefault(i, []).append(v[p * width : (p + 1) * width])
            for i, own in groups.items():
                books[p][i] = [sum(c) // len(own) for c in zip(*own)]
    found = [nearest(p) for p in range(4)] if kept else []
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    errors = [sum(found[p][n][0] for p in range(4)) for n in range(len(kept))]
    sums = {}
    for r, e in zip(kept, errors):
        sums[r[2]] = sums.get(r[2], 0) + e
    fit = lambda x: x if x <= V.MAX_LONG else None
    return sorted(
        (
            (r[0], "".join(f"{found[p][n][1]:02x}" for p in range(4)), fit(errors[n]), fit(sums[r[2]]), sha, r[2])
            for n, r in enumerate(kept)
        ),
        key=repr,
    )


def compressed(spark, rows, kind="float"):
    frame = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, label int")
    for name in ("vector", "code", "error", "name", "part", "entry"):
        frame = frame.withColumn(name, F.lit("other"))
    return sorted((tuple(r) for r in V.compress(frame.repartition(3)).collect()), key=repr)


def as_floats(rows):
    return [(i, v and [x if x is None else float(np.float32(x)) for x in v], k) for i, v, k in rows]


def test_nearest_entries_with_ties():
    rng = np.random.default_rng(4)
    for size, spread in ((1, 3), (9, 2), (256, 2), (256, 400)):
        entries = rng.integers(-spread, spread + 1, (size, 6)).astype(float)
        queries = rng.integers(-spread, spread + 1, (500, 6)).astype(float)
        squared = ((queries[:, None] - entries[None]) ** 2).sum(2)
        for kind in (float, object):
            e, q = (entries, queries) if kind is float else (V._as_python(entries), V._as_python(queries))
            search = V.Search(e, q)
            search.run(V.build(e), np.arange(len(q)))
            assert (search.index == squared.argmin(1)).all()  # argmin takes the first of equals
            assert (search.best == squared.min(1)).all()


def test_subtrees_are_ruled_out():
    rng = np.random.default_rng(5)
    centres = rng.integers(-8000, 8000, (16, 4))
    entries = (centres[:, None] + rng.integers(-50, 50, (16, 16, 4))).reshape(-1, 4).astype(float)
    queries = entries[rng.integers(0, 256, 1000)] + rng.integers(-20, 20, (1000, 4))
    search = V.Search(entries, queries)
    search.run(V.build(entries), np.arange(1000))
    assert search.compared < 1000 * 256 / 3
    assert (search.index == ((queries[:, None] - entries[None]) ** 2).sum(2).argmin(1)).all()


def test_codes_equal_brute_force(spark):
    rng = random.Random(9)
    rows = [(i, [rng.gauss(0, 0.2) for _ in range(8)], rng.choice((None, 1, 2))) for i in range(400)]
    assert compressed(spark, rows) == brute(as_floats(rows))
    grid = [(rng.randint(0, 500), [rng.randint(-2, 2) / 1024 for _ in range(8)], 1) for _ in range(300)]
    assert compressed(spark, grid) == brute(grid)


def test_odd_vectors(spark):
    inf, nan = float("inf"), float("nan")
    rows = [
        (1, [0.5, -0.25, 0.1, 0.0, 1.0], 1), (1, [0.5, -0.25, 0.1, 0.0, 1.0], 1), (None, [0.1] * 5, None), (3, [], None),
        (4, None, 1), (5, [1.0, None, 0.0, 0.0, 0.0], 1), (6, [nan] * 5, 1), (7, [inf, 0.0, 0.0, 0.0, 0.0], 1), (8, [-inf], 2),
        (9, [0.25], 2), (10, [1e30, -1e30, 3e38, 1e-45, 0.0], 3), (11, [0.0] * 5, 2), (12, [0.3] * 4 + [2e7], 4),
    ]
    assert compressed(spark, rows) == brute(as_floats(rows))
    wide = [(1, [1e308, 0.1, 5e-324], 1), (2, [0.2], 1), (3, [-1e308], 2)]
    assert compressed(spark, wide, "double") == brute(wide)


@pytest.mark.parametrize("rows", [[], [(1, None, 1)], [(1, [], 1), (2, [], None)]])
def test_nothing_to_code(spark, rows):
    assert compressed(spark, rows) == brute(rows)


def test_decode(spark):
    rows = [(i, [i / 7, -i / 3, 0.5, i * 0.01], 0) for i in range(40)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    books = V.fit(frame)
    for r in V.encode(frame, books).collect():  # fewer rows than entries: every vector is its own entry
        assert V.decode(r["code"], books) == [math.floor(Fraction(x) * 1024) for x in rows[r["vec_id"]][1]]
        assert r["error"] == 0
