"""Label maps as tables: the same targets as the built-in lookups, and what checks find."""

import pytest
from pyspark.sql import functions as F

from ticketlake import jobs, schemas as sc
from ticketlake.functions import labels
from ticketlake.operators import mappings as mp

QUEUES = [(1, "Technical Support"), (2, "Billing and Payments"), (3, None), (4, "Nowhere"), (5, "technical support"), (6, "Nowhere")]


@pytest.mark.parametrize("limit", [mp.BROADCAST_ROWS, 0])
def test_same_targets_as_the_lookups(spark, limit):
    key, former = "spark.sql.autoBroadcastJoinThreshold", spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set(key, -1)  # only what is marked is broadcast
    try:
        _same_targets(spark, limit)
    finally:
        spark.conf.set(key, former)


def _same_targets(spark, limit):
    rows = spark.createDataFrame(QUEUES, "ticket_id long, queue string")
    out = mp.apply_map(rows, F.col("queue"), mp.as_table(spark, sc.QUEUE_TOPICS), "topic", "Other", limit)
    assert out.columns == ["ticket_id", "queue", "topic"]
    assert out.where(~F.col("topic").eqNullSafe(labels.queue_topic(F.col("queue")))).count() == 0 and out.count() == 6
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert ("BroadcastHashJoin" in plan) == (limit > 0) and "NestedLoop" not in plan
    priorities = spark.createDataFrame([(i, p) for i, p in enumerate([" High ", "URGENT", "weird", None, "low", ""])], "ticket_id long, priority string")
    out = mp.apply_map(priorities, mp.folded(F.col("priority")), mp.as_table(spark, sc.PRIORITY_URGENCY), "urgency", limit=limit)
    assert out.where(~F.col("urgency").eqNullSafe(labels.priority_urgency(F.col("priority")))).count() == 0


def test_repeated_entries_multiply_nothing(spark):
    table = spark.createDataFrame([("a", "x"), ("a", "x"), ("a", "w"), ("b", "y"), (None, "z")], "label string, target string")
    rows = spark.createDataFrame([("a",), ("b",), ("c",), (None,)], "q string")
    got = {r["q"]: r["t"] for r in mp.apply_map(rows, F.col("q"), table, "t", "none").collect()}
    assert got == {"a": "w", "b": "y", "c": "none", None: None}
    assert [(r["label"], r["targets"]) for r in mp.conflicts(table.where("label IS NOT NULL")).collect()] == [("a", ["w", "x"])]


def test_gaps_both_ways(spark):
    table = spark.createDataFrame([("a", "x"), ("b", "y")], "label string, target string")
    rows = spark.createDataFrame([("a",), ("c",), ("c",), (None,)], "q string")
    got = sorted(tuple(r) for r in mp.gaps(rows, F.col("q"), table, "queue").collect())
    assert got == [("queue", "unmapped", "c", 2), ("queue", "unused", "b", 0)]
    names = mp.names_of(spark, ["x", "z"])
    assert sorted(tuple(r) for r in mp.uncovered(table, names, "topic").collect()) == [("topic", "unknown", "y"), ("topic", "unreached", "z")]


def test_job_writes_findings_and_stops(spark, tmp_path):
    path = lambda name: str(tmp_path / name)
    mp.as_table(spark, sc.QUEUE_TOPICS).write.parquet(path("good"))
    spark.createDataFrame([("Post Room", "Mail")], "label string, target string").write.parquet(path("bad"))
    jobs.main(["check-maps", "--queue-topics", path("good"), "--out", path("none")])
    assert {r["side"] for r in spark.read.schema("side string").json(path("none")).collect()} <= {"unreached"}
    mp.as_table(spark, {"low": "low"}).write.parquet(path("levels"))
    with pytest.raises(mp.MapError):
        jobs.main(["check-maps", "--queue-topics", path("good"), "--priority-urgencies", path("levels"), "--out", path("none")])
    with pytest.raises(mp.MapError):
        jobs.main(["check-maps", "--queue-topics", path("bad"), "--out", path("found")])
    found = spark.read.json(path("found")).collect()
    assert {(r["side"], r["name"]) for r in found} == {("unknown", "Mail"), *(("unreached", t) for t in sc.TOPICS)}
