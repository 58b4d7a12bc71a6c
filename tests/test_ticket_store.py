"""Loads merged into a bucketed store against one big load."""

import random

import pytest

from ticketlake.operators.dedup import dedup_by_version
from ticketlake.sources.ticket_store import TicketStore

SCHEMA = "ticket_id long, subject string, body string, version string, file string, row_index long"


def _rows(n, seed):
    rng = random.Random(seed)
    versions = ["v5", "v4", "v3", "de_norm", "de_norm_50_5_2", None]
    return [
        (i, rng.choice(["a", "b", "", None]), rng.choice([f"text {rng.randrange(n // 4)}", "hot", "", None]), rng.choice(versions), f"f{seed}", i)
        for i in range(n)
    ]


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_loads_equal_one_big_load(spark, tmp_path):
    store = TicketStore(spark, str(tmp_path), buckets=8)
    loads = [spark.createDataFrame(_rows(120, s), SCHEMA) for s in (3, 1, 2)]
    every = None
    for load in loads:
        every = load if every is None else every.unionByName(load)
        got = store.add(load)
        assert got.columns == load.columns
        want = dedup_by_version(every, ["file", "row_index"])
        assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
    again = TicketStore(spark, str(tmp_path), buckets=8)  # as a new session finds it
    assert again.tickets().count() == got.count()
    assert sorted(p.name for p in tmp_path.glob("load=*")) == ["load=000000", "load=000001", "load=000002"]


def test_only_the_new_load_is_shuffled(spark, tmp_path):
    store = TicketStore(spark, str(tmp_path), buckets=8)
    store.add(spark.createDataFrame(_rows(100, 1), SCHEMA))
    before = _plan(dedup_by_version(spark.createDataFrame(_rows(100, 2), SCHEMA), store.tie)).count("Exchange hashpartitioning")
    plan = _plan(store.merged(spark.createDataFrame(_rows(100, 2), SCHEMA)))
    # the load's own dedup and one more to the store's buckets; none above the stored scan
    assert plan.count("Exchange hashpartitioning") == before + 1
    assert "Bucketed: true" in plan
    stored = plan[: plan.index("Bucketed: true")].splitlines()
    assert not any("Exchange" in line for line in stored[-4:])


def test_a_load_that_fails_is_not_seen(spark, tmp_path):
    store = TicketStore(spark, str(tmp_path), buckets=4)
    with pytest.raises(ValueError):
        store.tickets()
    first = store.add(spark.createDataFrame(_rows(40, 1), SCHEMA)).count()
    (tmp_path / "load=000001").mkdir()  # no _SUCCESS
    assert store.tickets().count() == first
