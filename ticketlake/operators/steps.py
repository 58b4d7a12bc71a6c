"""Recorded model responses: validation, attempts, and the fold over turns.

Input is a step log ``(ticket_id, turn, attempt, raw_json)`` and a completeness
log ``(ticket_id, raw_json)``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import none_if_empty, strip
from ..schemas import (
    FALLBACK_MARK,
    HELPER_TOOLS,
    LOOP_BREAK_MARK,
    MAX_ATTEMPTS,
    MAX_TURNS,
    TERMINAL_TOOLS,
    TOOLS,
)

# Wording of validation errors, "location: message".
E_JSON = ": Invalid JSON"
E_OBJECT = ": Input should be an object"
E_MISSING = "%s: Field required"
E_STRING = "%s: Input should be a valid string"
E_ARGS = "args: Input should be an object"
E_TOOL = "tool: Input should be {} or '{}'".format(
    ", ".join(f"'{t}'" for t in TOOLS[:-1]), TOOLS[-1]
)
E_QUESTION_LIST = ": Value error, clarification_questions must be a list"
E_NO_QUESTION = (
    ": Value error, clarify tool requires at least one non-empty "
    "clarification_question in args; the customer needs something to answer."
)
D_REASONING = "reasoning: Input should be a valid string"
D_QUESTIONS = "clarification_questions: Input should be a list of strings"
D_FAQ = "faq_topic: Input should be a valid string"


def json_document(raw: Column) -> Column:
    """``raw`` as a variant if it is exactly one JSON document, else null.

    The parser ignores what follows the first value, so the text is parsed
    inside brackets and inside braces: no trailing text can close both.
    """
    listed = F.try_parse_json(F.concat(F.lit("["), raw, F.lit("]")))
    boxed = F.try_parse_json(F.concat(F.lit('{"x":'), raw, F.lit("}")))
    single = F.try_variant_get(listed, "$[1]", "variant").isNull()
    return F.when(
        listed.isNotNull() & single, F.try_variant_get(boxed, "$.x", "variant")
    )


def _kind(value: Column) -> Column:
    """STRING, OBJECT, ARRAY, BOOLEAN, VOID (JSON null), a number type; null if absent."""
    return F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0)


def _field(doc: str, name: str) -> Column:
    return F.try_variant_get(F.col(doc), f"$.{name}", "variant")


def _is_text(value: Column) -> Column:
    return _kind(value) == "STRING"


def _text(value: Column) -> Column:
    return F.try_variant_get(value, "$", "string")


def _items(value: Column) -> Column:
    return F.try_variant_get(value, "$", "array<variant>")


def validate_steps(log: DataFrame) -> DataFrame:
    """Add the typed content of every response, or what is wrong with it.

    New columns: errors (empty when the step is valid), thought, tool,
    args_json, and for the decision: reasoning, questions, faq_topic,
    args_error (a valid step whose arguments have the wrong type). Stage the
    result before filtering it: a filter on ``errors`` would be pushed below the
    parsing and repeat it for every rule.
    """
    doc = log.withColumn("_doc", json_document(F.col("raw_json")))
    parts = (
        doc.withColumn("_kind", _kind(F.col("_doc")))
        .withColumn("_thought", _field("_doc", "thought"))
        .withColumn("_tool", _field("_doc", "tool"))
        .withColumn("_args", _field("_doc", "args"))
        .withColumn("_reason", _field("_args", "reasoning"))
        .withColumn("_asked", _field("_args", "clarification_questions"))
        .withColumn("_faq", _field("_args", "faq_topic"))
        .withColumn("_asked_kind", _kind(F.col("_asked")))
        .withColumn("_asked_items", _items(F.col("_asked")))
        .withColumn("tool", F.when(_is_text(F.col("_tool")), _text(F.col("_tool"))))
    )
    is_object = F.col("_kind") == "OBJECT"
    field_errors = F.array_compact(
        F.array(
            F.when(F.col("_thought").isNull(), E_MISSING % "thought").when(
                ~_is_text(F.col("_thought")), E_STRING % "thought"
            ),
            F.when(F.col("_tool").isNull(), E_MISSING % "tool").when(
                F.col("tool").isNull() | ~F.col("tool").isin(TOOLS), E_TOOL
            ),
            F.when(
                F.col("_args").isNotNull() & (_kind(F.col("_args")) != "OBJECT"),
                E_ARGS,
            ),
        )
    )
    asks_something = F.exists(
        F.col("_asked_items"),
        lambda q: F.coalesce(_is_text(q) & (strip(_text(q)) != ""), F.lit(False)),
    )
    question_error = F.when(
        F.col("tool") == "clarify",
        F.when(
            F.col("_asked").isNotNull() & (F.col("_asked_kind") != "ARRAY"),
            E_QUESTION_LIST,
        ).when(~F.coalesce(asks_something, F.lit(False)), E_NO_QUESTION),
    )
    checked = parts.withColumn(
        "errors",
        F.when(F.col("_doc").isNull(), F.array(F.lit(E_JSON)))
        .when(~is_object, F.array(F.lit(E_OBJECT)))
        .when(F.size(field_errors) > 0, field_errors)
        .otherwise(F.array_compact(F.array(question_error))),
    )
    all_text = F.forall(F.col("_asked_items"), _is_text)
    args_error = F.array_join(
        F.array_compact(
            F.array(
                F.when(
                    F.col("_reason").isNotNull() & ~_is_text(F.col("_reason")),
                    D_REASONING,
                ),
                F.when(
                    F.col("_asked").isNotNull()
                    & ~((F.col("_asked_kind") == "ARRAY") & all_text),
                    D_QUESTIONS,
                ),
                F.when(
                    F.col("_faq").isNotNull()
                    & ~_kind(F.col("_faq")).isin("STRING", "VOID"),
                    D_FAQ,
                ),
            )
        ),
        "; ",
    )
    valid = F.size("errors") == 0
    return checked.select(
        *log.columns,
        "errors",
        F.when(valid, F.col("tool")).alias("tool"),
        F.when(valid, _text(F.col("_thought"))).alias("thought"),
        # the text as received: keys in their order, numbers as written
        F.when(
            valid, F.coalesce(F.get_json_object("raw_json", "$.args"), F.lit("{}"))
        ).alias("args_json"),
        F.when(valid, _text(F.col("_reason"))).alias("reasoning"),
        F.when(valid, F.transform("_asked_items", _text)).alias("questions"),
        F.when(valid, _text(F.col("_faq"))).alias("faq_topic"),
        F.when(valid, none_if_empty(args_error)).alias("args_error"),
    )


STEP_FIELDS = [
    "tool",
    "thought",
    "args_json",
    "reasoning",
    "questions",
    "faq_topic",
    "args_error",
]


def pick_attempts(steps: DataFrame, limit: int = MAX_ATTEMPTS) -> DataFrame:
    """One row per (ticket, turn): its first valid attempt out of ``limit``.

    Columns: attempt and the step fields, all null when no attempt was valid;
    n_attempts counts the attempts looked at.
    """
    looked_at = steps.where(F.col("attempt").between(1, limit))
    valid = F.size("errors") == 0
    step = F.when(valid, F.struct("attempt", *STEP_FIELDS))
    return (
        looked_at.groupBy("ticket_id", "turn")
        .agg(
            F.min_by(step, F.when(valid, F.col("attempt"))).alias("_s"),
            F.count("*").alias("n_attempts"),
        )
        .select(
            "ticket_id",
            "turn",
            "n_attempts",
            *(F.col("_s")[c].alias(c) for c in ["attempt", *STEP_FIELDS]),
        )
    )


def _trace(tools: Column) -> Column:
    """Tools of turns 1.. (null = failed turn) -> recorded trace with marks."""
    marks = F.transform(
        tools,
        lambda tool, i: F.when(tool.isNull(), F.lit(FALLBACK_MARK))
        .when(
            tool.isin(HELPER_TOOLS)
            & F.coalesce(F.array_contains(F.slice(tools, 1, i), tool), F.lit(False)),
            F.lit(LOOP_BREAK_MARK),
        )
        .otherwise(tool),
    )
    goes_on = F.transform(marks, lambda m: m.isin(HELPER_TOOLS))
    stop = F.array_position(goes_on, F.lit(False))
    return F.when(stop > 0, F.slice(marks, 1, stop.cast("int"))).otherwise(
        F.concat(marks, F.array(F.lit(FALLBACK_MARK)))
    )


def fold_turns(picks: DataFrame, limit: int = MAX_TURNS) -> DataFrame:
    """One row per ticket: tools_used and the step that ended it, if a tool did.

    ``picks`` has (ticket_id, turn, tool) and any of the other step fields; a
    turn without a row counts as failed. Only the first ``limit`` turns are looked
    at, one slot each, so a ticket never gathers more steps.
    """
    carried = [c for c in picks.columns if c not in ("ticket_id", "turn", "tool")]
    step = F.struct("tool", *carried)
    slots = [
        F.first(F.when(F.col("turn") == k, step), ignorenulls=True).alias(f"_t{k}")
        for k in range(1, limit + 1)
    ]
    folded = (
        picks.where(F.col("turn").between(1, limit))
        .groupBy("ticket_id")
        .agg(*slots)
        .withColumn("_steps", F.array(*(f"_t{k}" for k in range(1, limit + 1))))
        .withColumn("tools_used", _trace(F.transform("_steps", lambda s: s["tool"])))
    )
    ended = F.element_at("tools_used", -1).isin(TERMINAL_TOOLS)
    last = F.when(ended, F.get("_steps", F.size("tools_used") - 1))
    return folded.withColumn("_last", last).select(
        "ticket_id",
        "tools_used",
        F.col("_last")["tool"].alias("tool"),
        *(F.col("_last")[c].alias(c) for c in carried),
    )


def awaiting_helper(picks: DataFrame) -> DataFrame:
    """ticket_id, turn: tickets whose last recorded turn called a helper that may still answer.

    That is, every turn so far called a helper, none of them twice, and the next
    turn is within the limit and has no attempt yet.
    """
    slots = [
        F.first(F.when(F.col("turn") == k, F.col("tool")), ignorenulls=True).alias(f"_t{k}")
        for k in range(1, MAX_TURNS + 1)
    ]
    last = F.col("turn")
    trace = F.col("_trace")
    return (
        picks.where(F.col("turn").between(1, MAX_TURNS))
        .groupBy("ticket_id")
        .agg(F.max("turn").alias("turn"), *slots)
        .withColumn("_trace", _trace(F.array(*(f"_t{k}" for k in range(1, MAX_TURNS + 1)))))
        .where(
            (last < MAX_TURNS)
            & (F.size(trace) == last + 1)
            & F.get(trace, last.cast("int") - 1).isin(HELPER_TOOLS)
            & (F.element_at(trace, -1) == FALLBACK_MARK)
        )
        .select("ticket_id", "turn")
    )


def trace_counters(tools: Column) -> list[Column]:
    """Total, helper and terminal calls, and the two marks, as 0/1 flags."""

    def count_in(names: list[str]) -> Column:
        return F.size(F.filter(tools, lambda t: t.isin(names)))

    return [
        F.size(tools).alias("n_total"),
        count_in(HELPER_TOOLS).alias("n_helper"),
        count_in(TERMINAL_TOOLS).alias("n_terminal"),
        F.array_contains(tools, FALLBACK_MARK).cast("int").alias("is_fallback"),
        F.array_contains(tools, LOOP_BREAK_MARK).cast("int").alias("is_loop_break"),
    ]


def completeness(log: DataFrame) -> DataFrame:
    """Parse completeness responses: is_actionable, missing_aspects, was_valid.

    A response of the wrong shape counts as actionable with nothing missing.
    Booleans may come as true/false, 1/0, or their usual spellings.
    """
    doc = (
        log.withColumn("_doc", json_document(F.col("raw_json")))
        .withColumn("_flag", _field("_doc", "is_actionable"))
        .withColumn("_list", _field("_doc", "missing_aspects"))
        .withColumn("_flag_kind", _kind(F.col("_flag")))
        .withColumn("_items", _items(F.col("_list")))
    )
    spelled = F.lower(_text(F.col("_flag")))
    number = F.try_variant_get(F.col("_flag"), "$", "double")
    flag = (
        F.when(
            F.col("_flag_kind") == "BOOLEAN",
            F.try_variant_get(F.col("_flag"), "$", "boolean"),
        )
        .when(
            F.col("_flag_kind") == "STRING",
            F.when(spelled.isin("true", "t", "yes", "y", "on", "1"), True).when(
                spelled.isin("false", "f", "no", "n", "off", "0"), False
            ),
        )
        .otherwise(F.when(number == 1, True).when(number == 0, False))
    )
    list_ok = F.col("_list").isNull() | F.coalesce(
        (_kind(F.col("_list")) == "ARRAY") & F.forall(F.col("_items"), _is_text),
        F.lit(False),
    )
    parsed = doc.withColumn("_ok", flag).withColumn(
        "was_valid",
        F.coalesce(_kind(F.col("_doc")) == "OBJECT", F.lit(False))
        & F.col("_ok").isNotNull()
        & list_ok,
    )
    none = F.array().cast("array<string>")
    return parsed.select(
        *log.columns,
        "was_valid",
        F.when(F.col("was_valid"), F.col("_ok")).otherwise(True).alias("is_actionable"),
        F.when(
            F.col("was_valid"), F.coalesce(F.transform("_items", _text), none)
        )
        .otherwise(none)
        .alias("missing_aspects"),
    )
