"""Plans: no Python in the built-in paths, single shuffles, no cross joins."""

import re

import pytest

from ticketlake.operators.canonical import clean_text
from ticketlake.operators.dedup import dedup_by_version
from ticketlake.plans import evaluate, profile
from ticketlake.registry import views
from ticketlake.registry.oracle import ORACLE
from ticketlake.registry.queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"
PYTHON = re.compile("ArrowEvalPython|BatchEvalPython|MapInPandas|FlatMapGroups")


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _final_plan(df):
    df.collect()
    return _plan(df).split("== Initial Plan ==")[0]


def _exchanges(plan):
    return len(re.findall(r"(?<!Broadcast)(?<!Reused)Exchange hashpartitioning", plan))


def test_prepare_is_one_shuffle_without_python(spark):
    df = clean_text(dedup_by_version(views.valid(spark, SF_DIR), ["ticket_id"]))
    plan = _plan(df)
    assert _exchanges(plan) == 1 and not PYTHON.search(plan)


def test_cleaning_needs_no_shuffle(spark):
    plan = _plan(views.prepared(spark, SF_DIR))
    assert not re.search(r"Exchange \w", plan) and not PYTHON.search(plan)


def test_scans_read_only_what_a_report_needs(spark):
    plan = _plan(profile.queue_inspection(views.view(spark, SF_DIR, "tickets_raw")))
    assert "ReadSchema: struct<doc_id:bigint>" in plan


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_no_query_needs_a_cross_join(spark, name):
    plan = _plan(QUERIES[name](spark, SF_DIR))
    assert not re.search("CartesianProduct|NestedLoopJoin", plan)


@pytest.mark.parametrize("report", ["bucket_quality", "length_bucket_actions"])
def test_bucket_reports_read_the_frame_once(spark, report):
    df = evaluate.REPORTS[report](evaluate.fold(views.frame(spark, SF_DIR)))
    # the quartile subquery reuses the folded rows
    assert "ReusedExchange" in _final_plan(df)


def test_counts_are_combined_before_the_shuffle(spark):
    f = evaluate.fold(views.frame(spark, SF_DIR))
    for df in (evaluate.action_path_cube(f), evaluate.topic_confusion(f), profile.kpis(views.valid(spark, SF_DIR))):
        plan = _plan(df)
        assert "partial_count(1)" in plan
        # cubes and totals expand the counted pairs, not the rows
        assert plan.index("Expand") < plan.index("partial_count(1)") if "Expand" in plan else True
