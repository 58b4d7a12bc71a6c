"""Decide: scored tickets and response logs -> result records."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.decisions import assemble_results, decide
from ..operators.steps import fold_turns, pick_attempts, validate_steps
from ..operators.tables import value_counts
from ..sources.tables import read_results, write_results
from ..storage import stage


@dataclass
class Decided:
    results: DataFrame
    errors: DataFrame
    actions: DataFrame


def resolve(
    scored: DataFrame, step_log: DataFrame, runtimes: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """(results, tickets whose step had unusable arguments)."""
    steps = stage(validate_steps(step_log), "steps")
    folded = fold_turns(pick_attempts(steps))
    decided = stage(decide(scored, folded), "decided")
    errors = decided.where(F.col("decision_error").isNotNull()).select(
        "ticket_id", "tools_used", "decision_error"
    )
    return assemble_results(decided, runtimes), errors


def run(
    scored: DataFrame,
    step_log: DataFrame,
    out: str,
    errors_out: str,
    runtimes: DataFrame | None = None,
) -> Decided:
    """Write result records and the tickets without one; return both with action counts.

    Every scored ticket is in exactly one of ``out`` and ``errors_out``.
    """
    results, errors = resolve(scored, step_log, runtimes)
    write_results(results, out)
    write_results(errors, errors_out)
    spark = scored.sparkSession
    done = read_results(spark, out)
    actions = value_counts(done, "action").orderBy(F.desc("n"), "action")
    return Decided(done, spark.read.schema(errors.schema).json(errors_out), actions)
