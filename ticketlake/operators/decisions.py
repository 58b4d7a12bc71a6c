"""From a folded trace to a decision, a next step and a result record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.labels import next_step
from ..functions.text import none_if_empty, snippet, strip
from ..schemas import (
    FALLBACK_MARK,
    FALLBACK_QUESTIONS,
    FALLBACK_REASONS,
    LOOP_BREAK_MARK,
    NO_REASONING,
    TOPICS,
)

NO_QUESTION = "a clarify step that asks nothing"
MAX_REASONING = 200
MAX_QUESTIONS = 2


def fallback_action(topic: Column, urgency: Column) -> Column:
    """High urgency escalates; then Claims, then Other have actions of their own."""
    return (
        F.when(urgency == "high", "ESCALATE")
        .when(topic == "Claims", "CLAIM")
        .when(topic == "Other", "CLARIFY")
        .otherwise("FORWARD")
    )


def fallback_decision(topic: Column, urgency: Column) -> Column:
    """STRUCT(action, reasoning, questions, faq_topic) used when no step decided."""

    def made(action: str) -> Column:
        asked = FALLBACK_QUESTIONS if action == "CLARIFY" else []
        return F.struct(
            F.lit(action).alias("action"),
            F.lit(FALLBACK_REASONS[action]).alias("reasoning"),
            F.array(*(F.lit(q) for q in asked)).cast("array<string>").alias("questions"),
            F.lit(None).cast("string").alias("faq_topic"),
        )

    action = fallback_action(topic, urgency)
    return (
        F.when(action == "ESCALATE", made("ESCALATE"))
        .when(action == "CLAIM", made("CLAIM"))
        .when(action == "CLARIFY", made("CLARIFY"))
        .otherwise(made("FORWARD"))
    )


def kept_questions(questions: Column, n: int = MAX_QUESTIONS) -> Column:
    """Blank questions dropped, then the first ``n``."""
    none = F.array().cast("array<string>")
    return F.slice(
        F.filter(F.coalesce(questions, none), lambda q: strip(q) != ""),
        1,
        n,
    )


def step_decision(
    tool: Column,
    reasoning: Column,
    questions: Column,
    faq_topic: Column,
    max_reasoning: int = MAX_REASONING,
) -> Column:
    """STRUCT(action, reasoning, questions, faq_topic) of a terminal step.

    Reasons are cut at ``max_reasoning`` characters.
    """
    reason = none_if_empty(F.substring(reasoning, 1, max_reasoning))
    return F.struct(
        F.upper(tool).alias("action"),
        F.coalesce(reason, F.lit(NO_REASONING)).alias("reasoning"),
        kept_questions(questions).alias("questions"),
        faq_topic.alias("faq_topic"),
    )


def with_text_figures(df: DataFrame) -> DataFrame:
    """Replace ``text`` by text_snippet and text_length, all that results keep of it.

    Done before any join, so that no shuffle carries whole texts.
    """
    return (
        df.withColumn("text_snippet", snippet(F.col("text")))
        .withColumn("text_length", F.length("text"))
        .drop("text")
    )


def decide(scored: DataFrame, folded: DataFrame) -> DataFrame:
    """Scored tickets (ticket_id, text, topic, urgency, ...) with their decision.

    The text is reduced to text_snippet and text_length. Tickets without any recorded step take the fallback. ``decision_error`` is
    set, and the decision left null, where a valid step carried arguments no
    decision can be built from.
    """
    marks = F.array(F.lit(FALLBACK_MARK))
    if "text" in scored.columns:
        scored = with_text_figures(scored)
    joined = scored.join(folded, "ticket_id", "left").withColumn(
        "tools_used", F.coalesce("tools_used", marks)
    )
    last = F.element_at("tools_used", -1)
    by_rule = last.isin(FALLBACK_MARK, LOOP_BREAK_MARK)
    asked = kept_questions(F.col("questions"))
    error = F.when(
        ~by_rule,
        F.coalesce(
            F.col("args_error"),
            F.when(
                (F.col("tool") == "clarify") & (F.size(asked) == 0),
                NO_QUESTION,
            ),
        ),
    )
    decision = F.when(
        by_rule, fallback_decision(F.col("topic"), F.col("urgency"))
    ).when(
        F.col("decision_error").isNull(),
        step_decision(
            F.col("tool"), F.col("reasoning"), F.col("questions"), F.col("faq_topic")
        ),
    )
    own = [c for c in scored.columns]
    return (
        joined.withColumn("decision_error", error)
        .withColumn("_d", decision)
        .select(
            *own,
            "tools_used",
            "decision_error",
            F.col("_d.action").alias("action"),
            F.col("_d.reasoning").alias("reasoning"),
            F.col("_d.questions").alias("clarification_questions"),
            F.col("_d.faq_topic").alias("faq_topic"),
        )
        .withColumn("next_step", next_step(F.col("action"), F.col("topic")))
    )


def assemble_results(decided: DataFrame, runtimes: DataFrame | None = None) -> DataFrame:
    """Result records of all tickets with a decision.

    ``runtimes`` is (ticket_id, runtime_seconds), from the response log; several
    calls of a ticket are summed.
    """
    done = decided.where(F.col("decision_error").isNull())
    if runtimes is not None:
        spent = runtimes.groupBy("ticket_id").agg(
            F.sum("runtime_seconds").alias("runtime_seconds")
        )
        done = done.join(spent, "ticket_id", "left")
    else:
        done = done.withColumn("runtime_seconds", F.lit(None).cast("double"))
    return done.select(
        "ticket_id",
        "text_snippet",
        "topic",
        "topic_margin",
        "topic_all_scores",
        "urgency",
        "urgency_score",
        "action",
        "next_step",
        "reasoning",
        "clarification_questions",
        "faq_topic",
        "tools_used",
        "runtime_seconds",
        "text_length",
        F.struct("queue", "priority", "type").alias("ground_truth"),
    )


def comparison_view(results: DataFrame, cut: int = 120) -> DataFrame:
    """Prediction next to the labels, one row per ticket; snippets cut at ``cut`` characters."""
    declared = F.array(*(F.lit(t) for t in TOPICS))
    ranked = F.array_sort(
        F.transform(
            F.map_entries("topic_all_scores"),
            lambda e: F.struct(
                (-e["value"]).alias("neg"),
                F.array_position(declared, e["key"]).alias("ord"),
                e["key"].alias("topic"),
            ),
        )
    )
    top = F.array_join(
        F.transform(
            F.slice(ranked, 1, 3),
            lambda r: F.format_string("%s=%.2f", r["topic"], -r["neg"]),
        ),
        ", ",
    )
    return results.select(
        "ticket_id",
        F.substring("text_snippet", 1, cut).alias("snippet"),
        "topic",
        "topic_margin",
        top.alias("top_scores"),
        "urgency",
        "urgency_score",
        "action",
        "next_step",
        F.col("ground_truth.queue").alias("queue"),
        F.col("ground_truth.priority").alias("priority"),
        F.col("ground_truth.type").alias("type"),
        F.array_join("tools_used", " -> ").alias("tools"),
        "reasoning",
        "clarification_questions",
    )
