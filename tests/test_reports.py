import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from ticketlake.operators import quantiles as qt
from ticketlake.operators import tables as tb
from ticketlake.plans import evaluate as ev
from ticketlake.plans import profile as pf
from ticketlake.schemas import RESULT


def _result(i=1, topic="Billing", urgency="low", action="FORWARD", queue="Billing and Payments", priority="low",
            tools=("forward",), margin=0.2, length=100, runtime=1.0, questions=()):
    return (i, "a snippet", topic, margin, None, urgency, 0.1, action, "FORWARD_BILLING", "why", list(questions), None,
            None if tools is None else list(tools), runtime, length, (queue, priority, None))


def _frame(spark, *results):
    return ev.eval_frame(spark.createDataFrame(list(results), RESULT))


def _one(df):
    (r,) = df.collect()
    return r


def test_frame_maps_labels_and_flattens(spark):
    rows = _frame(
        spark, _result(1), _result(2, queue="Arts & Entertainment/Movies", priority="critical"),
        _result(3, queue=None, priority=None, tools=("missing_info", "clarify"), questions=("a", "b")),
        _result(4, priority="very_low", tools=()), _result(5, tools=None),
    ).orderBy("ticket_id").collect()
    assert [r.mapped_topic for r in rows] == ["Billing", "Other", None, "Billing", "Billing"]
    assert [r.mapped_urgency for r in rows] == ["low", "high", None, "low", "low"]
    assert [r.tool_path for r in rows] == ["forward", "forward", "missing_info -> clarify", "(none)", "(none)"]
    assert rows[2].n_clarifications == 2 and len(rows[0]) == 17


def test_urgency_agreement(spark):
    f = _frame(spark, _result(1, urgency="low"), _result(2, urgency="medium"), _result(3, urgency="high"), _result(4, priority="odd"))
    r = _one(ev.urgency_agreement(ev.fold(f)))
    assert (r.n, r.n_comparable, r.n_exact, r.n_within_1) == (4, 3, 1, 2)
    assert r.exact_pct == pytest.approx(100 / 3)


def test_distributions_and_fallbacks(spark):
    f = _frame(
        spark, _result(1), _result(2), _result(3, action="ESCALATE", tools=("missing_info", "__loop_break__")),
        _result(4, action="CLARIFY", tools=("missing_info", "__fallback__"), questions=("q",)),
    )
    assert [(r.action, r.n, r.pct) for r in ev.action_distribution(ev.fold(f)).collect()] == [
        ("FORWARD", 2, 50.0), ("CLARIFY", 1, 25.0), ("ESCALATE", 1, 25.0)]
    assert [(r.action, r.n) for r in ev.action_shares(ev.fold(f)).collect()] == [
        ("FORWARD", 2), ("ESCALATE", 1), ("CLARIFY", 1), ("FAQ", 0), ("CLAIM", 0)]
    r = _one(ev.fallback_rate(ev.fold(f)))
    assert (r.n_fallback, r.n_loop_break, r.fallback_pct) == (1, 1, 25.0)
    top = ev.top_tool_paths(ev.fold(f), 2).collect()
    assert [(t.tool_path, t.n, t.n_more) for t in top] == [("forward", 2, 1), ("missing_info -> __fallback__", 1, 1)]
    cover = {r.action: (r.n, r.n_asking, r.mean_questions) for r in ev.question_coverage(ev.fold(f)).collect()}
    assert cover["CLARIFY"] == (1, 1, 1.0) and cover["FORWARD"] == (2, 0, 0.0)


def test_confusion_matrix_is_dense_and_adds_up(spark):
    f = _frame(
        spark, _result(1), _result(2, topic="Claims"), _result(3, topic="Other", queue="IT Support"),
        _result(4, queue=None), _result(5, queue="Total"),
    )
    rows = ev.topic_confusion(ev.fold(f)).collect()
    assert [r.mapped_topic for r in rows] == ["Policy", "Claims", "Billing", "Technical", "Other", "Total"]
    assert [tuple(r)[2:] for r in rows] == [
        (0, 0, 0, 0, 0, 0), (0, 0, 0, 0, 0, 0), (0, 1, 1, 0, 0, 2), (0, 0, 0, 0, 1, 1), (0, 0, 1, 0, 0, 1), (0, 1, 2, 0, 1, 4)]
    cells = ev.topic_confusion(ev.fold(f), margins=False).collect()
    assert len(cells) == 5 and sum(sum(tuple(r)[2:]) for r in cells) == 4


def test_null_labels_do_not_look_like_totals(spark):
    df = spark.createDataFrame([("a", None), ("a", "x"), (None, "x")], "r string, c string")
    got = {(r.r, r.c, r.r_total, r.c_total): r.n for r in tb.pair_cube(df, "r", "c").collect()}
    assert got[(None, None, 1, 1)] == 3
    assert got[("a", None, 0, 0)] == 1 and got[("a", None, 0, 1)] == 2
    assert got[(None, None, 1, 0)] == 1 and got[(None, "x", 0, 0)] == 1


def test_empty_results(spark):
    f = ev.eval_frame(spark.createDataFrame([], RESULT))
    made = {n: r(ev.fold(f)) for n, r in ev.REPORTS.items()} | {n: r(ev.runtimes(f)) for n, r in ev.RUNTIME_REPORTS.items()}
    for name, report in made.items():
        rows = report.collect()
        assert all(v in (None, 0, 0.0, "Total") or isinstance(v, (str, int)) for r in rows for v in r), name
    assert _one(ev.topic_agreement(ev.fold(f))).exact_pct is None
    assert ev.margin_histogram(f).count() == 0 and ev.length_quantiles(ev.fold(f)).count() == 0


def test_length_buckets(spark):
    f = _frame(spark, *(_result(i, length=10 * i, action="FAQ" if i > 6 else "CLAIM", margin=None if i == 1 else i / 10) for i in range(1, 9)))
    q = _one(ev.length_quantiles(ev.fold(f)))
    assert tuple(q) == (10, 27, 45, 62, 76, 80)
    rows = ev.bucket_quality(ev.fold(f)).collect()
    assert [(r.bucket, r.bucket_label, r.n) for r in rows] == [
        ("short", "short (<=27)", 2), ("medium", "medium (28-62)", 4), ("long", "long (>62)", 2)]
    assert rows[0].mean_margin == pytest.approx(0.2) and rows[1].mean_margin == pytest.approx(0.45)
    acts = {r.bucket: (r.CLAIM, r.FAQ, r.total) for r in ev.length_bucket_actions(ev.fold(f)).collect()}
    assert acts == {"short": (2, 0, 2), "medium": (4, 0, 4), "long": (0, 2, 2), "Total": (6, 2, 8)}


def test_equal_lengths_leave_the_upper_buckets_empty(spark):
    f = _frame(spark, *(_result(i, length=50) for i in range(4)))
    assert [r.n for r in ev.bucket_quality(ev.fold(f)).collect()] == [4, 0, 0]


def test_runtime_reports(spark):
    f = _frame(spark, *(_result(i, runtime=None if i == 9 else float(i), tools=("faq",) if i % 2 else ("claim",)) for i in range(10)))
    r = _one(ev.runtime_stats(ev.runtimes(f)))
    assert (r.n, r.total, r.mean, r.slowest, r.p50) == (9, 36.0, 4.0, 8.0, 4.0) and r.p95 == pytest.approx(7.6)
    assert [(x.tool_path, x.n) for x in ev.runtime_by_path(ev.runtimes(f)).collect()] == [("claim", 5), ("faq", 4)]
    assert [(x.tool_path, x.min, x.median, x.max) for x in ev.runtime_box(ev.runtimes(f)).collect()] == [("claim", 0, 4, 8), ("faq", 1, 4, 7)]


def test_disagreements_and_filters(spark):
    f = _frame(spark, *(_result(i, topic="Claims", urgency="high" if i % 2 else "low") for i in range(20)))
    rows = ev.disagreements(f, 3).collect()
    assert [(r.focus, r.ticket_id) for r in rows] == [("topic", 0), ("topic", 1), ("topic", 2), ("urgency", 1), ("urgency", 3), ("urgency", 5)]
    assert tuple(_one(ev.disagreement_counts(ev.fold(f)))) == (20, 10)
    assert ev.disagreements(f, 10, cut=4).first().snippet == "a sn"
    assert ev.disagreements(f, 10, cut=None).count() == 20
    assert ev.filtered(f, actions=["FAQ"]).count() == 0
    assert ev.filtered(f, ["FORWARD"], ["Claims"], ["high"]).count() == 10
    k = _one(ev.headline_kpis(ev.fold(f)))
    assert (k.n, k.topic_pct, k.urgency_pct, k.n_fallback) == (20, 0.0, 50.0, 0)


def test_evaluate_gives_every_report(spark):
    rows = spark.createDataFrame([_result(i, action="FAQ" if i % 3 else "CLAIM") for i in range(9)], RESULT)
    out = ev.evaluate(rows, actions=["FAQ"])
    assert set(out) == {"frame", "margin_histogram", "disagreements", *ev.REPORTS, *ev.RUNTIME_REPORTS}
    assert _one(out["fallback_rate"]).n == 6 == out["frame"].count() == _one(out["runtime_stats"]).n
    # one pass each: folding, folding the runtimes, the histogram; the examples take two short ones
    single = out["margin_histogram"]._jdf.queryExecution().optimizedPlan().toString()
    assert single.count("LogicalRDD") + single.count("LocalRelation") == 1
    folded = [out[n]._jdf.queryExecution().optimizedPlan().toString() for n in (*ev.REPORTS, *ev.RUNTIME_REPORTS)]
    assert not any("LogicalRDD" in p or "LocalRelation" in p for p in folded)


# --- quantiles and histograms --------------------------------------------------------


@pytest.mark.parametrize("shape", ["spread", "ties", "one", "skewed", "single"])
def test_exact_quantiles_match_numpy(spark, shape):
    rng = random.Random(5)
    values = {
        "spread": [rng.gauss(0, 1) for _ in range(3000)],
        "ties": [float(rng.randint(0, 4)) for _ in range(3000)],
        "one": [2.5] * 100,
        "skewed": [0.0] * 2000 + [10.0 ** rng.uniform(-8, 8) for _ in range(1500)],
        "single": [7.0],
    }[shape]
    probs = [0.0, 0.01, 0.25, 0.5, 0.75, 0.95, 1.0]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double")
    for fn in (qt.exact_quantiles, qt.bounded_quantiles):
        assert np.allclose(_one(fn(df, "v", probs)).q, np.quantile(values, probs))


def test_exact_quantiles_per_group_with_a_null_group(spark):
    rng = random.Random(6)
    rows = [(rng.choice(["a", "a", "a", "b", None]), rng.expovariate(1)) for _ in range(2000)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r.g: r.q for r in qt.exact_quantiles(df, "v", [0.1, 0.5, 0.9], ["g"], steps=6).collect()}
    for g in ("a", "b", None):
        assert np.allclose(got[g], np.quantile([v for k, v in rows if k == g], [0.1, 0.5, 0.9]))


@pytest.mark.parametrize("folded", [False, True])
def test_histogram_bins(spark, folded):
    def histogram(df):
        return qt.histogram(qt.value_weights(df, "v"), "v", 5, weight="_n") if folded else qt.histogram(df, "v", 5)

    df = spark.createDataFrame([(v,) for v in [0, 1, 2, 3, 10, 10, None]], "v int")
    rows = histogram(df).collect()
    assert [(r.bin, r.lower, r.upper, r.n) for r in rows] == [(0, 0, 2, 2), (1, 2, 4, 2), (2, 4, 6, 0), (3, 6, 8, 0), (4, 8, 10, 2)]
    same = spark.createDataFrame([(3,), (3,)], "v int")
    assert [(r.bin, r.lower, r.upper, r.n) for r in histogram(same).collect()] == [(0, 3, 3, 2)]
    assert histogram(same.limit(0)).count() == 0


# --- profile --------------------------------------------------------------------------


def _sample(spark):
    rows = [
        (1, "en", "v5", "IT Support", "low", "Incident", "abcd"),
        (2, "en", "v5", "IT Support", " HIGH", "Request", "ab"),
        (3, "de", "v4", "Pets", "odd", None, "abcdefgh"),
        (4, "de", "v4", None, None, None, "abcdef"),
        (5, "en", "v3", "Billing and Payments", "critical", "Request", "abcdef"),
    ]
    df = spark.createDataFrame(rows, "ticket_id long, language string, version string, queue string, priority string, type string, text string")
    return df.withColumn("subject", F.col("text"))


def test_profile_figures(spark):
    out = {k: [tuple(r) for r in v.collect()] for k, v in pf.profile(_sample(spark)).items()}
    assert out["kpis"] == [(5, 2, 3, 4, 2)]
    assert out["languages"] == [("de",), ("en",)]
    assert out["language_distribution"] == [("en", 3, 60.0), ("de", 2, 40.0)]
    assert out["priority_distribution"] == [("low", 1, 2), ("critical", 1, 5), (" HIGH", 1, None), ("odd", 1, None)]
    assert out["priority_inspection"] == [
        (None, 1, "(missing)"), (" HIGH", 1, "high"), ("critical", 1, "high"), ("low", 1, "low"), ("odd", 1, "UNMAPPED")]
    assert [r[1:3] for r in out["urgency_shares"]] == [("high", 2), ("medium", 0), ("low", 1)]
    assert out["unmapped_priorities"] == [("odd", 1)]
    assert out["queue_inspection"] == [
        ("Billing", None, 1, 1, 1, None), ("Billing", "Billing and Payments", 0, 1, 1, 0),
        ("Technical", None, 1, 2, 1, None), ("Technical", "IT Support", 0, 2, 1, 0),
        ("Other", None, 1, 1, 1, None), ("Other", "Pets", 0, 1, 1, 1)]
    assert [r[1:] for r in out["topic_shares"]] == [
        ("Policy", 0, 0.0), ("Claims", 0, 0.0), ("Billing", 1, 25.0), ("Technical", 2, 50.0), ("Other", 1, 25.0)]
    assert out["unmapped_queues"] == [("Pets", 1, 0)]
    assert out["queue_coverage"] == [(3, 2)]
    assert out["top_queues"][0] == ("IT Support", 2, 50.0, 0)
    assert out["mapping_coverage"] == [("Technical", 2, 1, 1, 50.0), ("Billing", 1, 1, 1, 25.0), ("Other", 1, 1, 0, 25.0)]
    lengths = [4, 2, 8, 6, 6]
    assert out["length_summary"][0][:2] == (5, statistics.mean(lengths))
    assert np.allclose(out["length_summary"][0][2:], np.quantile(lengths, [0, 0.25, 0.5, 0.75, 0.95, 1]))
    assert {r[0]: r[1:] for r in out["length_box"]}["de"] == (6.0, 6.5, 7.0, 7.5, 8.0)
    assert len(out["length_histogram"]) == 40 and sum(r[3] for r in out["length_histogram"]) == 5
    assert out["type_distribution"] == [("Request", 2, pytest.approx(200 / 3)), ("Incident", 1, pytest.approx(100 / 3))]
    assert out["version_distribution"] == [("v4", 2, 40.0), ("v5", 2, 40.0), ("v3", 1, 20.0)]
    assert out["sample_browser"][0] == (1, "1 - abcd")


def test_profile_reports_take_rows_or_folded_rows(spark):
    df = _sample(spark)
    for name, make in pf.REPORTS.items():
        if name != "sample_browser":
            assert make(df).collect() == make(pf.fold(df)).collect(), name


def test_profile_of_some_languages(spark):
    assert _one(pf.profile(_sample(spark), ["de"])["kpis"]).n == 2


def test_queues_beyond_the_limit_are_counted(spark):
    df = spark.createDataFrame([(f"q{i:02}",) for i in range(13)], "queue string")
    rows = pf.unmapped_queues(df).collect()
    assert [r.queue for r in rows] == [f"q{i:02}" for i in range(10)] and {r.n_more for r in rows} == {3}
