"""Folds kept over runs against one evaluation of all results."""

import random
import re

import pytest

from ticketlake import jobs
from ticketlake.plans import evaluate as ev
from ticketlake.registry import views
from ticketlake.schemas import RESULT, TOPICS, URGENCY_LEVELS
from ticketlake.sources import tables

SF_DIR = "/root/testdata/sf0.001"
FILTERS = [{}, {"actions": ["FORWARD", "CLARIFY"], "topics": TOPICS[:3]}, {"urgencies": ["high"]}]


def _results(spark, n, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        tools = rng.choice([None, [], ["forward"], ["missing_info", "clarify"], ["missing_info", "__fallback__"]])
        rows.append(
            (
                seed * 1000 + i, "s", rng.choice(TOPICS), rng.choice([None, rng.random() / 4]), None, rng.choice(URGENCY_LEVELS), 0.1,
                rng.choice(["FORWARD", "ESCALATE", "CLARIFY", "FAQ"]), "x", "why", [], None, tools, rng.choice([None, 0.5, rng.random()]),
                rng.randint(1, 300), (rng.choice([None, "IT Support", "Billing and Payments", "odd"]), rng.choice([None, "low", "high", "odd"]), None),
            )
        )
    return spark.createDataFrame(rows, RESULT)


def _plain(df):
    return [tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect()]


@pytest.fixture(scope="module")
def runs(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("folds"))
    parts = {f"0{i}": _results(spark, 60, i) for i in (1, 2, 3)}
    for name, part in parts.items():
        ev.store_folds(part, path, name)
    ev.store_folds(parts["01"], path, "01")  # again: replaces, adds nothing
    return path, parts


NAMES = ["headline_kpis", "topic_confusion", "bucket_quality", "margin_stats", "runtime_box", "length_by_action"]


@pytest.mark.parametrize("filters", FILTERS, ids=["all", "actions", "urgencies"])
def test_reports_of_merged_folds(spark, runs, filters):
    path, parts = runs
    whole = parts["01"].unionByName(parts["02"]).unionByName(parts["03"])
    want = ev.evaluate(whole, *(filters.get(k) for k in ("actions", "topics", "urgencies")))
    got = ev.reports_of_folds(spark, path, names=NAMES, **filters)
    assert list(got) == [n for n in [*ev.REPORTS, *ev.RUNTIME_REPORTS] if n in NAMES]
    for name in NAMES:
        assert sorted(map(repr, _plain(got[name]))) == sorted(map(repr, _plain(want[name]))), name


def test_some_runs(spark, runs):
    path, parts = runs
    got = ev.reports_of_folds(spark, path, ["02"], names=["headline_kpis"])["headline_kpis"]
    assert _plain(got) == _plain(ev.headline_kpis(ev.fold(ev.eval_frame(parts["02"]))))


def test_sketches_of_all_runs(spark, runs):
    path, parts = runs
    got = {r["tool_path"]: r for r in ev.sketched_runtimes(spark, path).collect()}
    want = ev.evaluate(parts["01"].unionByName(parts["02"]).unionByName(parts["03"]))["runtime_box"].collect()
    for r in want:  # few values: the ends are exact
        assert (got[r["tool_path"]]["n"], got[r["tool_path"]]["q"][0], got[r["tool_path"]]["q"][-1]) == (r["n"], r["min"], r["max"])


def test_jobs(spark, tmp_path):
    rows = _results(spark, 30, 5)
    ev.store_folds(_results(spark, 30, 4), f"{tmp_path}/folds", "a")
    tables.write_results(rows, f"{tmp_path}/b")
    jobs.main(["evaluate", "--results", f"{tmp_path}/b", "--out", f"{tmp_path}/out", "--folds", f"{tmp_path}/folds", "--run-name", "b"])
    jobs.main(["report", "--folds", f"{tmp_path}/folds", "--out", f"{tmp_path}/faq", "--runs", "b", "--actions", "FAQ"])
    assert spark.read.json(f"{tmp_path}/faq/headline_kpis").first()["n"] == rows.where("action = 'FAQ'").count() > 0


def test_a_report_folds_no_more_than_it_reads(spark):
    plan = ev.topic_confusion(ev.fold_for(ev.topic_confusion, views.frame(spark, SF_DIR)))._jdf.queryExecution().executedPlan().toString()
    searches = "regexp_extract_all|regexp_replace|zs_score"  # of signals and of texts, and the score join
    assert not re.search(searches, plan)
    every = ev.topic_confusion(ev.fold(views.frame(spark, SF_DIR)))._jdf.queryExecution().executedPlan().toString()
    assert re.search(searches, every) and plan.count("Scan parquet") < every.count("Scan parquet")
