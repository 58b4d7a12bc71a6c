"""Requests for the next model call, rendered as columns.

Prompt texts and example exchanges are content and come from the caller.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import (
    COMPLETENESS_FORMAT,
    FIRST_TURN_FORMAT,
    FOLLOW_UP_FORMAT,
    MAX_ATTEMPTS,
    MESSAGE,
    RETRY_FORMAT,
)
from .steps import awaiting_helper


def first_turn(text: Column, topic: Column, urgency: Column) -> Column:
    return F.format_string(FIRST_TURN_FORMAT, text, topic, urgency)


def follow_up(
    text: Column,
    topic: Column,
    urgency: Column,
    tool: Column,
    result: Column,
    turn: Column,
) -> Column:
    """Message after a helper call; ``turn`` is the turn it opens."""
    return F.format_string(
        FOLLOW_UP_FORMAT, text, topic, urgency, tool, result, turn.cast("int")
    )


def completeness_check(text: Column, topic: Column, urgency: Column) -> Column:
    return F.format_string(COMPLETENESS_FORMAT, text, topic, urgency)


def helper_result(is_actionable: Column, missing_aspects: Column) -> Column:
    """A helper's answer as the JSON text quoted in the follow-up."""
    return F.to_json(
        F.struct(
            is_actionable.alias("is_actionable"),
            missing_aspects.alias("missing_aspects"),
        )
    )


def step_json(thought: Column, tool: Column, args_json: Column) -> Column:
    """A valid step as the JSON text it is replayed with, its arguments as received."""
    head = F.to_json(F.struct(thought.alias("thought"), tool.alias("tool")))
    return F.concat(
        F.substring(head, F.lit(1), F.length(head) - 1), F.lit(',"args":'), args_json, F.lit("}")
    )


def retry_message(errors: Column) -> Column:
    """Message that names what was wrong with the last response."""
    return F.format_string(RETRY_FORMAT, F.array_join(errors, "; "))


def message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def seed_messages(
    system: str, examples: Sequence[tuple[str, str]] = ()
) -> Column:
    """Constant prefix of a conversation: the system text, then example exchanges."""
    turns = [message("system", F.lit(system))]
    for asked, answered in examples:
        turns.append(message("user", F.lit(asked)))
        turns.append(message("assistant", F.lit(answered)))
    return F.array(*turns).cast(f"array<{MESSAGE.simpleString()}>")


def first_requests(
    scored: DataFrame, system: str, examples: Sequence[tuple[str, str]] = ()
) -> DataFrame:
    """Request table of turn 1: ticket_id, turn, attempt, messages."""
    opening = first_turn(F.col("text"), F.col("topic"), F.col("urgency"))
    return scored.select(
        "ticket_id",
        F.lit(1).alias("turn"),
        F.lit(1).alias("attempt"),
        F.concat(
            seed_messages(system, examples), F.array(message("user", opening))
        ).alias("messages"),
    )


def completeness_requests(scored: DataFrame, system: str) -> DataFrame:
    """Request table of the helper: ticket_id, messages."""
    question = completeness_check(F.col("text"), F.col("topic"), F.col("urgency"))
    return scored.select(
        "ticket_id",
        F.concat(seed_messages(system), F.array(message("user", question))).alias(
            "messages"
        ),
    )


def retry_requests(requests: DataFrame, steps: DataFrame) -> DataFrame:
    """Next attempt for every invalid response: the same messages, extended.

    ``requests`` is the table sent, ``steps`` its validated responses, both by
    (ticket_id, turn, attempt).
    """
    failed = steps.where((F.size("errors") > 0) & (F.col("attempt") < MAX_ATTEMPTS)).select(
        "ticket_id", "turn", "attempt", "raw_json", "errors"
    )
    return requests.join(failed, ["ticket_id", "turn", "attempt"]).select(
        "ticket_id",
        "turn",
        (F.col("attempt") + 1).alias("attempt"),
        F.concat(
            "messages",
            F.array(
                message("assistant", F.col("raw_json")),
                message("user", retry_message(F.col("errors"))),
            ),
        ).alias("messages"),
    )


def follow_up_requests(
    requests: DataFrame, picks: DataFrame, answers: DataFrame, scored: DataFrame
) -> DataFrame:
    """Next turn for tickets whose step called the helper.

    ``requests`` is the table that was sent for the picked attempts, ``answers``
    the parsed completeness table, one row per ticket. Which turn is followed up
    comes from the trace so far (``awaiting_helper``).
    """
    called = picks.join(awaiting_helper(picks), ["ticket_id", "turn"]).select(
        "ticket_id", "turn", "attempt", "thought", "tool", "args_json"
    )
    return (
        requests.join(called, ["ticket_id", "turn", "attempt"])
        .join(
            answers.select("ticket_id", "is_actionable", "missing_aspects"), "ticket_id"
        )
        .join(scored.select("ticket_id", "text", "topic", "urgency"), "ticket_id")
        .select(
            "ticket_id",
            (F.col("turn") + 1).alias("turn"),
            F.lit(1).alias("attempt"),
            F.concat(
                "messages",
                F.array(
                    message(
                        "assistant",
                        step_json(F.col("thought"), F.col("tool"), F.col("args_json")),
                    ),
                    message(
                        "user",
                        follow_up(
                            F.col("text"),
                            F.col("topic"),
                            F.col("urgency"),
                            F.col("tool"),
                            helper_result(
                                F.col("is_actionable"), F.col("missing_aspects")
                            ),
                            F.col("turn") + 1,
                        ),
                    ),
                ),
            ).alias("messages"),
        )
    )
