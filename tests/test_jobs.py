import csv
import json
import os

from pyspark.sql import functions as F

from ticketlake import jobs
from ticketlake.operators.canonical import filter_languages
from ticketlake.plans import decide, evaluate, prepare
from ticketlake.plans.score import score_urgency
from ticketlake.registry import views
from ticketlake.schemas import FILE_VERSIONS, PREPARED, RESULT, TOPICS
from ticketlake.sources import tables
from ticketlake.storage import clear, shared_folder, stage, staged_run

SF_DIR = "/root/testdata/sf0.001"


def _ticket_folder(folder):
    """All five files: shared copies, one reject and one French ticket per file."""
    for name, version in FILE_VERSIONS.items():
        body = "text" if version == "v3" else "body"
        rows = [
            {"subject": f"{version} {i}", body: f"line one\nline  {i}", "language": "en", "queue": f"q{i % 3}"}
            for i in range(20)
        ]
        rows.append({"subject": "same", body: "everywhere", "language": "en", "queue": version})
        rows.append({"subject": f"fr {version}", body: "bonjour", "language": "fr", "queue": "q0"})
        rows.append({"subject": " ", body: "", "language": "en", "queue": "q0"})
        with open(os.path.join(folder, name), "w", newline="") as f:
            out = csv.DictWriter(f, list(rows[0]))
            out.writeheader()
            out.writerows(rows)


def test_prepare_job(spark, tmp_path):
    _ticket_folder(tmp_path)
    out = prepare.prepare(spark, str(tmp_path), f"{tmp_path}/sample", f"{tmp_path}/rejected", n=40)
    sample = out.sample.collect()
    assert len(sample) == 40 == len({r.ticket_id for r in sample})
    assert set(PREPARED.names) | {"sample_order"} == set(out.sample.columns)
    assert {r.language for r in sample} <= {"en", "de"}
    assert all("\n" not in r.text and "  " not in r.text and r.text_length == len(r.text) for r in sample)
    # 100 own tickets, one shared, two "fr" tickets of the German files
    whole = prepare.prepare(spark, str(tmp_path), f"{tmp_path}/all", f"{tmp_path}/rejected", n=1000).sample
    assert whole.count() == 103
    shared = whole.where("subject = 'same'").collect()
    assert [r.version for r in shared] == ["v5"]
    rejects = tables.read_rejects(spark, f"{tmp_path}/rejected").collect()
    assert sorted((r.file, r.row_index) for r in rejects) == sorted((n, 22) for n in FILE_VERSIONS)
    total = [r for r in out.counts.collect() if r.is_total]
    assert [(r.n_valid, r.n_rejected) for r in total] == [(110, 5)]
    assert {r.status for r in out.coverage.collect()} == {"known"}
    assert sum(r.n for r in out.versions.collect()) == sum(r.n for r in out.languages.collect()) == 40
    assert out.queues.count() == 4 and out.lengths.first().n == 40


def test_score_decide_evaluate_jobs(spark, tmp_path):
    tickets = views.prepared(spark, SF_DIR)
    scored = score_urgency(tickets, F.lit(0.7)).join(views.topics(spark, SF_DIR), "ticket_id")
    out = decide.run(scored, views.step_log(spark, SF_DIR), f"{tmp_path}/results", f"{tmp_path}/errors")
    back = tables.read_results(spark, f"{tmp_path}/results")
    assert back.count() + out.errors.count() == scored.count()
    assert sum(r.n for r in out.actions.collect()) == back.count()
    reports = evaluate.evaluate(back)
    assert reports["topic_agreement"].first().n == back.count()
    # null fields are written out, texts are not escaped
    (part, *_) = [p for p in os.listdir(tmp_path / "results") if p.endswith(".json")]
    record = json.loads((tmp_path / "results" / part).read_text().splitlines()[0])
    assert set(record) == set(RESULT.names)


def test_results_from_a_json_array(spark, tmp_path):
    rows = [
        {"ticket_id": 1, "topic": "Claims", "urgency": "low", "action": "CLAIM", "next_step": "x",
         "text_snippet": "ä", "ground_truth": {"queue": "IT Support", "priority": None, "type": None}},
        {"ticket_id": 2, "topic": "Other", "urgency": "low", "action": "FAQ", "next_step": "x", "tools_used": ["faq"]},
    ]
    (tmp_path / "r.json").write_text(json.dumps(rows, indent=2, ensure_ascii=False))
    frame = evaluate.eval_frame(tables.read_results(spark, str(tmp_path / "r.json"), as_array=True))
    got = frame.orderBy("ticket_id").collect()
    assert [(r.tool_path, r.mapped_topic, r.snippet, r.n_clarifications) for r in got] == [
        ("(none)", "Technical", "ä", 0), ("faq", None, "", 0)]


def test_staged_tables_are_stored(spark):
    df = stage(spark.range(5), "ids")
    assert f"{shared_folder(spark)}/ticketlake/ids-" in df.inputFiles()[0]
    assert sorted(r.id for r in df.collect()) == list(range(5))
    folder = df.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]
    assert os.path.isdir(folder)
    clear(spark)
    assert not os.path.exists(folder)


def test_resolve_rejects_nothing_silently(spark):
    scored = views.scored(spark, SF_DIR)
    results, errors = decide.resolve(scored, views.step_log(spark, SF_DIR), views.view(spark, SF_DIR, "runtimes"))
    assert results.count() + errors.count() == scored.count()
    assert results.where("runtime_seconds is null").count() == 0
    assert errors.count() > 0


def test_language_filter_keeps_only_targets(spark):
    kept = filter_languages(views.valid(spark, SF_DIR))
    assert {r.language for r in kept.select("language").distinct().collect()} == {"en", "de"}


def test_command_line_jobs(spark, tmp_path):
    _ticket_folder(tmp_path)
    at = lambda name: f"{tmp_path}/out/{name}"
    jobs.main(["prepare", "--folder", str(tmp_path), "--out", at("sample"), "--rejected-out", at("rejected"),
               "--reports-out", at("summary"), "--n", "30"])
    assert {r.status for r in spark.read.json(at("summary/coverage")).collect()} == {"known"}
    ids = spark.read.parquet(at("sample")).select("ticket_id")
    vector = F.transform(F.sequence(F.lit(1), F.lit(5)), lambda i: F.sin(i * (F.col("ticket_id") % 17)).cast("float"))
    ids.select("ticket_id", vector.alias("embedding")).write.parquet(at("vectors"))
    unit = [(t, [1.0 if i == j else 0.0 for j in range(5)]) for i, t in enumerate(TOPICS)]
    spark.createDataFrame(unit, "topic string, anchor array<float>").write.parquet(at("anchors"))
    ids.select("ticket_id", F.lit(0.4).alias("zs_score")).write.parquet(at("zs"))
    jobs.main(["score", "--sample", at("sample"), "--vectors", at("vectors"), "--anchors", at("anchors"),
               "--classifier-scores", at("zs"), "--out", at("scored"), "--n", "20"])
    scored = spark.read.parquet(at("scored"))
    assert scored.count() == 20 and scored.where("urgency is null or topic is null").count() == 0
    (tmp_path / "system.txt").write_text("Route tickets.")
    assert "text" not in scored.columns
    jobs.main(["requests", "--scored", at("scored"), "--sample", at("sample"), "--system", str(tmp_path / "system.txt"),
               "--out", at("requests")])
    assert spark.read.parquet(at("requests")).count() == 20
    reply = F.lit('{"thought": "t", "tool": "faq", "args": {"reasoning": "how-to"}}')
    scored.limit(12).select("ticket_id", F.lit(1).alias("turn"), F.lit(1).alias("attempt"), reply.alias("raw_json")).write.json(at("steps"))
    jobs.main(["decide", "--scored", at("scored"), "--steps", at("steps"), "--out", at("results"), "--errors-out", at("errors")])
    results = tables.read_results(spark, at("results"))
    assert results.where("action = 'FAQ' and reasoning = 'how-to'").count() == 12 and results.count() == 20
    jobs.main(["evaluate", "--results", at("results"), "--out", at("reports")])
    assert spark.read.json(at("reports/fallback_rate")).first().n_fallback == 8
    jobs.main(["evaluate", "--results", at("results"), "--out", at("some"), "--actions", "FAQ", "CLAIM"])
    assert spark.read.json(at("some/fallback_rate")).first().n >= 12
    jobs.main(["profile", "--sample", at("sample"), "--out", at("stats"), "--languages", "en"])
    assert spark.read.json(at("stats/kpis")).first().n_languages == 1


def _written(spark, path, rows, schema="ticket_id long, turn int, attempt int, raw_json string"):
    spark.createDataFrame(rows, schema).write.mode("overwrite").json(path)
    return path


def test_a_conversation_goes_round(spark, tmp_path):
    """Requests, an invalid answer, a retry, the helper, its answer, the follow-up, a decision."""
    at = lambda name: f"{tmp_path}/{name}"
    ids = (1, 2, 3)
    spark.createDataFrame([(i, f"text {i}") for i in ids], "ticket_id long, text string").write.parquet(at("sample"))
    scored = spark.createDataFrame(
        [(i, "Other", 0.1, "low", 0.0, f"text {i}", 6, "q", "p", "t") for i in ids],
        "ticket_id long, topic string, topic_margin double, urgency string, urgency_score double, text_snippet string, "
        "text_length int, queue string, priority string, type string")
    scored.withColumn("topic_all_scores", F.create_map(F.lit("Other"), F.lit(0.1))).write.parquet(at("scored"))
    for name in ("system", "check"):
        (tmp_path / f"{name}.txt").write_text(name)
    texts = ["--scored", at("scored"), "--sample", at("sample")]
    jobs.main(["requests", *texts, "--system", at("system.txt"), "--out", at("requests")])
    helper = '{"thought": "vague", "tool": "missing_info", "args": {"z": 1.0, "a": [2, {"y": 1, "b": 2}]}}'
    faq = '{"thought": "t", "tool": "faq", "args": {"reasoning": "r"}}'
    log = [(1, 1, 1, '{"tool": "faq"}'), (2, 1, 1, helper), (3, 1, 1, faq)]
    jobs.main(["retries", "--requests", at("requests"), "--steps", _written(spark, at("log1"), log), "--out", at("retries")])
    (retry,) = spark.read.parquet(at("retries")).collect()
    assert (retry.ticket_id, retry.attempt, len(retry.messages)) == (1, 2, 4)

    log += [(1, 1, 2, helper)]
    jobs.main(["checks", *texts, "--steps", _written(spark, at("log2"), log), "--system", at("check.txt"), "--out", at("checks")])
    checks = spark.read.parquet(at("checks")).collect()
    assert sorted((c.ticket_id, c.turn) for c in checks) == [(1, 1), (2, 1)]
    answers = _written(spark, at("answers"), [(i, '{"is_actionable": false, "missing_aspects": ["order"]}') for i in (1, 2)],
                       "ticket_id long, raw_json string")
    jobs.main(["completeness", "--answers", answers, "--out", at("parsed")])
    assert spark.read.parquet(at("parsed")).where("was_valid").count() == 2

    spark.read.parquet(at("requests")).unionByName(spark.read.parquet(at("retries"))).write.parquet(at("sent"))
    jobs.main(["follow-ups", "--requests", at("sent"), "--steps", at("log2"), "--answers", answers, *texts, "--out", at("next")])
    follow = {r.ticket_id: r for r in spark.read.parquet(at("next")).collect()}
    assert sorted(follow) == [1, 2] and {(r.turn, r.attempt) for r in follow.values()} == {(2, 1)}
    # the step is repeated as it was received
    assert follow[2].messages[-2].content == helper.replace(": ", ":").replace(", ", ",")
    assert len(follow[1].messages) == 6

    clarify = '{"thought": "t", "tool": "clarify", "args": {"reasoning": "r", "clarification_questions": ["Which order?"]}}'
    log += [(1, 2, 1, clarify), (2, 2, 1, helper)]
    _written(spark, at("log3"), log)
    jobs.main(["follow-ups", "--requests", at("next"), "--steps", at("log3"), "--answers", answers, *texts, "--out", at("none")])
    assert spark.read.parquet(at("none")).count() == 0
    jobs.main(["decide", "--scored", at("scored"), "--steps", at("log3"), "--out", at("results"), "--errors-out", at("errors")])
    got = {r.ticket_id: (r.action, r.tools_used) for r in tables.read_results(spark, at("results")).collect()}
    assert got == {1: ("CLARIFY", ["missing_info", "clarify"]), 2: ("CLARIFY", ["missing_info", "__loop_break__"]), 3: ("FAQ", ["faq"])}


def test_every_decision_error_is_written(spark, tmp_path):
    at = lambda name: f"{tmp_path}/{name}"
    bad = '{"thought": "t", "tool": "faq", "args": {"faq_topic": 7}}'
    good = '{"thought": "t", "tool": "faq", "args": {}}'
    rows = spark.range(120).select(
        F.col("id").alias("ticket_id"), F.lit("Policy").alias("topic"), F.lit(0.5).alias("topic_margin"),
        F.create_map(F.lit("Policy"), F.lit(0.5)).alias("topic_all_scores"), F.lit("low").alias("urgency"),
        F.lit(0.0).alias("urgency_score"), F.lit("x").alias("text_snippet"), F.lit(1).alias("text_length"),
        *(F.lit("v").alias(c) for c in ("queue", "priority", "type")))
    rows.write.parquet(at("scored"))
    spark.range(120).select(
        F.col("id").alias("ticket_id"), F.lit(1).alias("turn"), F.lit(1).alias("attempt"),
        F.when(F.col("id") < 70, bad).otherwise(good).alias("raw_json")).write.json(at("log"))
    jobs.main(["decide", "--scored", at("scored"), "--steps", at("log"), "--out", at("results"), "--errors-out", at("errors")])
    errors, results = spark.read.json(at("errors")), tables.read_results(spark, at("results"))
    assert (errors.count(), results.count()) == (70, 50)
    assert errors.where("decision_error IS NULL").count() == 0
    assert errors.select("ticket_id").intersect(results.select("ticket_id")).count() == 0


def test_a_run_clears_its_own_tables_only(spark):
    outside = stage(spark.range(3), "outside")
    with staged_run(spark):
        inside = stage(spark.range(3), "inside").inputFiles()[0].removeprefix("file://")
        assert os.path.exists(inside)
    assert not os.path.exists(inside) and outside.count() == 3
    clear(spark)
