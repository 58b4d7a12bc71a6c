"""Sketched quantiles against exact ranks."""

import bisect
import random

import pytest

from ticketlake.operators import sketches as sk

PROBS = [0.0, 0.05, 0.25, 0.5, 0.75, 0.95, 1.0]


def _within(values, q, p, error):
    below, upto = bisect.bisect_left(values, q) / len(values), bisect.bisect_right(values, q) / len(values)
    return below - error <= p <= upto + error


@pytest.mark.parametrize("error", [0.05, 0.01])
def test_ranks_of_merged_runs(spark, error):
    rng = random.Random(15)
    rows = [(rng.choice("aab"), run, rng.choice([rng.random(), rng.gauss(50, 9), 7.0])) for run in range(5) for _ in range(4000)]
    rows += [("a", 0, None), ("none", 0, None)]
    frame = spark.createDataFrame(rows, "g string, run int, v double").repartition(8)
    kept = sk.sketches(frame, "v", ["g", "run"], error)
    assert kept.count() == 10
    found = sk.sketched_quantiles(sk.merged_sketches(kept, ["g"]), PROBS).collect()
    assert {r["g"] for r in found} == {"a", "b"}
    for r in found:
        values = sorted(v for g, _, v in rows if g == r["g"] and v is not None)
        assert r["n"] == len(values)
        assert all(_within(values, q, p, error) for q, p in zip(r["q"], PROBS))
    every = sk.sketched_quantiles(sk.merged_sketches(kept), PROBS).first()
    values = sorted(v for _, _, v in rows if v is not None)
    assert every["n"] == 20_000 and all(_within(values, q, p, error) for q, p in zip(every["q"], PROBS))


def test_size_follows_the_error():
    assert sk.size_for(0.5) < sk.size_for(0.01) < sk.size_for(0.001) <= 65_535
    assert 2.296 / sk.size_for(0.01) ** 0.9021 <= 0.005
    for error in (0, 1, 1e-6):
        with pytest.raises(ValueError):
            sk.size_for(error)


def test_few_values_are_exact(spark):
    frame = spark.createDataFrame([(float(i),) for i in range(50)], "v double")
    found = sk.sketched_quantiles(sk.sketches(frame, "v"), [0.0, 1.0]).first()
    assert list(found["q"]) == [0.0, 49.0] and found["n"] == 50
    assert sk.sketches(frame.limit(0), "v", ["v"]).count() == 0
