"""Spark entry points: ``spark-submit -m``-style jobs over stored tables.

    python -m ticketlake.jobs prepare  --folder F --out SAMPLE --rejected-out R --reports-out S --n 5000
    python -m ticketlake.jobs check-maps --queue-topics MAP --out FINDINGS [--priority-urgencies MAP]
    python -m ticketlake.jobs score-texts --sample SAMPLE --model package.module:factory --store STORE --out C [--vectors]
    python -m ticketlake.jobs score    --sample SAMPLE --vectors V --anchors A --classifier-scores C --out SCORED
    python -m ticketlake.jobs requests --scored SCORED --sample SAMPLE --system prompt.txt --out REQUESTS
    python -m ticketlake.jobs retries  --requests REQUESTS --steps LOG --out MORE
    python -m ticketlake.jobs checks   --scored SCORED --sample SAMPLE --steps LOG --system check.txt --out CHECKS
    python -m ticketlake.jobs follow-ups --requests REQUESTS --steps LOG --answers ANSWERS --scored SCORED --sample SAMPLE --out MORE
    python -m ticketlake.jobs completeness --answers ANSWERS --out PARSED
    python -m ticketlake.jobs decide   --scored SCORED --steps LOG --out RESULTS --errors-out ERRORS
    python -m ticketlake.jobs evaluate --results RESULTS --out REPORTS
    python -m ticketlake.jobs report   --folds FOLDS --out REPORTS [--runs .. --actions .. --topics .. --urgencies ..]
    python -m ticketlake.jobs profile  --sample SAMPLE --out REPORTS

Tables are Parquet; step log, helper answers, results and errors are JSON Lines. A
conversation goes round: ``requests`` (or ``follow-ups``), model, ``retries`` until
valid, then for tickets whose step called the helper ``checks``, model,
``follow-ups``, model; at any time ``decide`` resolves what is recorded. Master,
resources and ``spark.checkpoint.dir`` come from the cluster's configuration.
"""

from __future__ import annotations

import argparse
from importlib import import_module
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .functions.scorers import text_classifier, text_embedder

from .operators.mappings import check, names_of, uncovered
from .operators.requests import (
    completeness_requests,
    first_requests,
    follow_up_requests,
    retry_requests,
)
from .operators.reuse import ScoreStore, score_texts
from .operators.sampling import head
from .operators.steps import awaiting_helper, completeness, pick_attempts, validate_steps
from .plans import decide, evaluate, prepare, profile
from .plans.score import score
from .schemas import HELPER_LOG, STEP_LOG, TOPICS, URGENCY_LEVELS
from .sources.tables import read_prepared, read_results
from .storage import stage, staged_run


def _save(reports: dict[str, DataFrame], out: str) -> None:
    """One JSON Lines folder per report; a report goes through one task, its making does not."""
    for name, df in reports.items():
        df.repartition(1).write.mode("overwrite").json(f"{out}/{name}")


def _prepare(spark: SparkSession, a: argparse.Namespace) -> None:
    done = prepare.prepare(spark, a.folder, a.out, a.rejected_out, a.n, a.seed)
    tables = ("coverage", "counts", "languages", "versions", "queues", "lengths")
    _save({name: getattr(done, name) for name in tables}, a.reports_out)


def _score(spark: SparkSession, a: argparse.Namespace) -> None:
    tickets = read_prepared(spark, a.sample)
    if a.n is not None:
        tickets = head(tickets, a.n)
    score(
        tickets,
        spark.read.parquet(a.vectors),
        spark.read.parquet(a.anchors),
        spark.read.parquet(a.classifier_scores),
    ).write.mode("overwrite").parquet(a.out)


def _score_texts(spark: SparkSession, a: argparse.Namespace) -> None:
    """Model scores (or vectors) of a sample; texts the store knows do not meet the model."""
    module, _, factory = a.model.partition(":")

    def load():
        return getattr(import_module(module), factory)()

    vectors = a.vectors
    kind = T.ArrayType(T.FloatType()) if vectors else T.DoubleType()
    model = (text_embedder if vectors else text_classifier)(a.model, load)
    score_texts(
        read_prepared(spark, a.sample),
        model,
        kind,
        ScoreStore(spark, a.store, a.model.replace(":", "."), kind),
        score_col="embedding" if vectors else "zs_score",
    ).write.mode("overwrite").parquet(a.out)


def _check_maps(spark: SparkSession, a: argparse.Namespace) -> None:
    """Write where the maps and what they are for do not meet.

    Not every topic needs a queue of its own; a target nobody knows, or a level that no priority
    leads to, fails the job.
    """
    topics = spark.read.parquet(a.queue_topics)
    found = uncovered(topics, names_of(spark, TOPICS), "topic")
    if a.priority_urgencies:
        levels = spark.read.parquet(a.priority_urgencies)
        found = found.unionByName(uncovered(levels, names_of(spark, URGENCY_LEVELS), "urgency"))
    check(found, a.out, (F.col("side") == "unknown") | (F.col("field") == "urgency"))


def _with_text(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """Scored tickets with what a request says about them; texts come from the sample."""
    scored = spark.read.parquet(a.scored).select("ticket_id", "topic", "urgency")
    return read_prepared(spark, a.sample).select("ticket_id", "text").join(scored, "ticket_id")


def _steps(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    return stage(validate_steps(spark.read.schema(STEP_LOG).json(a.steps)), "steps")


def _answers(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    return stage(completeness(spark.read.schema(HELPER_LOG).json(a.answers)), "answers")


def _requests(spark: SparkSession, a: argparse.Namespace) -> None:
    system = Path(a.system).read_text(encoding="utf-8")
    sent = first_requests(_with_text(spark, a), system)
    sent.write.mode("overwrite").parquet(a.out)


def _retries(spark: SparkSession, a: argparse.Namespace) -> None:
    again = retry_requests(spark.read.parquet(a.requests), _steps(spark, a))
    again.write.mode("overwrite").parquet(a.out)


def _checks(spark: SparkSession, a: argparse.Namespace) -> None:
    system = Path(a.system).read_text(encoding="utf-8")
    called = awaiting_helper(pick_attempts(_steps(spark, a)))
    asked = completeness_requests(_with_text(spark, a), system)
    asked.join(called, "ticket_id").write.mode("overwrite").parquet(a.out)


def _follow_ups(spark: SparkSession, a: argparse.Namespace) -> None:
    sent = follow_up_requests(
        spark.read.parquet(a.requests),
        pick_attempts(_steps(spark, a)),
        _answers(spark, a),
        _with_text(spark, a),
    )
    sent.write.mode("overwrite").parquet(a.out)


def _completeness(spark: SparkSession, a: argparse.Namespace) -> None:
    _answers(spark, a).write.mode("overwrite").parquet(a.out)


def _decide(spark: SparkSession, a: argparse.Namespace) -> None:
    runtimes = spark.read.parquet(a.runtimes) if a.runtimes else None
    done = decide.run(
        spark.read.parquet(a.scored),
        spark.read.schema(STEP_LOG).json(a.steps),
        a.out,
        a.errors_out,
        runtimes,
    )
    done.actions.show()  # one row per action


def _evaluate(spark: SparkSession, a: argparse.Namespace) -> None:
    results = read_results(spark, a.results, a.array)
    if a.folds:
        evaluate.store_folds(results, a.folds, a.run_name)
    reports = evaluate.evaluate(results, a.actions, a.topics, a.urgencies)
    reports.pop("frame")
    _save(reports, a.out)


def _report(spark: SparkSession, a: argparse.Namespace) -> None:
    _save(evaluate.reports_of_folds(spark, a.folds, a.runs, a.actions, a.topics, a.urgencies), a.out)


def _profile(spark: SparkSession, a: argparse.Namespace) -> None:
    sample = read_prepared(spark, a.sample)
    _save(profile.profile(sample, a.languages), a.out)


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="ticketlake.jobs")
    jobs = parser.add_subparsers(required=True)

    def job(name, run, *required):
        sub = jobs.add_parser(name)
        sub.set_defaults(run=run)
        for option in required:
            sub.add_argument(f"--{option}", required=True)
        return sub

    p = job("prepare", _prepare, "folder", "out", "rejected-out", "reports-out")
    p.add_argument("--n", type=int, required=True)
    p.add_argument("--seed", type=int, default=42)
    p = job("score", _score, "sample", "vectors", "anchors", "classifier-scores", "out")
    p.add_argument("--n", type=int)
    p = job("check-maps", _check_maps, "queue-topics", "out")
    p.add_argument("--priority-urgencies", help="table of label and target")
    p = job("score-texts", _score_texts, "sample", "model", "store", "out")
    p.add_argument("--vectors", action="store_true", help="the model gives vectors, not scores")
    job("requests", _requests, "scored", "sample", "system", "out")
    job("retries", _retries, "requests", "steps", "out")
    job("checks", _checks, "scored", "sample", "steps", "system", "out")
    job("follow-ups", _follow_ups, "requests", "steps", "answers", "scored", "sample", "out")
    job("completeness", _completeness, "answers", "out")
    p = job("decide", _decide, "scored", "steps", "out", "errors-out")
    p.add_argument("--runtimes")
    p = job("evaluate", _evaluate, "results", "out")
    p.add_argument("--array", action="store_true", help="files hold one JSON array each")
    p.add_argument("--folds", help="also keep the run's folds here, for the report job")
    p.add_argument("--run-name", default="1", help="name of the run there")
    report = job("report", _report, "folds", "out")
    report.add_argument("--runs", nargs="+", help="names of the runs; all by default")
    for values in ("actions", "topics", "urgencies"):
        for sub in (p, report):
            sub.add_argument(f"--{values}", nargs="+", help="only results with one of these")
    p = job("profile", _profile, "sample", "out")
    p.add_argument("--languages", nargs="+")
    return parser


def main(argv: list[str] | None = None) -> None:
    args = _parser().parse_args(argv)
    spark = SparkSession.builder.appName("ticketlake").getOrCreate()
    with staged_run(spark):
        args.run(spark, args)


if __name__ == "__main__":
    main()
