"""The driver's tables seen as tickets, anchors, scores and response logs.

Each view exists once as SQL text that both engines run (`SQL`), and as the
DataFrame built from it. Frames further down the line (`prepared`, `scored`,
`results`, ...) are built with the library's own operators.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.canonical import canonicalise, clean_text, valid_rows
from ..operators.decisions import assemble_results, decide
from ..operators.steps import fold_turns
from ..plans.evaluate import eval_frame
from ..plans.score import one_score, score, score_topics, with_signals, with_urgency

# Words that occur in the documents; the built-in lexicon does not.
LEXICON = ["the", "and", "under", "der", "und", "que", "para"]

SQL = {
    "tickets_raw": """
SELECT doc_id AS ticket_id,
       CASE WHEN doc_id % 50 = 7 OR doc_id % 10 = 1 THEN '' ELSE substr(text, 1, 30) END AS subject,
       CASE WHEN doc_id % 50 = 7 THEN '' ELSE substr(text, 31) END AS body,
       CASE WHEN doc_id % 40 = 9 THEN '   '
            WHEN doc_id % 25 = 3 THEN concat(upper(lang), '-XX') ELSE lang END AS language,
       CASE CAST(substr(source, 4) AS INT) % 5 WHEN 0 THEN 'v5' WHEN 1 THEN 'v4' WHEN 2 THEN 'v3'
            WHEN 3 THEN 'de_norm_50_5_2' ELSE 'de_norm' END AS version,
       CASE doc_id % 8 WHEN 0 THEN 'Technical Support' WHEN 1 THEN 'Billing and Payments'
            WHEN 2 THEN 'Returns and Exchanges' WHEN 3 THEN 'Sales and Pre-Sales'
            WHEN 4 THEN 'Customer Service' WHEN 5 THEN 'IT Support'
            WHEN 6 THEN 'Home & Garden/Landscaping' END AS queue,
       CASE doc_id % 9 WHEN 0 THEN 'low' WHEN 1 THEN ' High ' WHEN 2 THEN 'medium'
            WHEN 3 THEN 'critical' WHEN 4 THEN 'normal' WHEN 5 THEN 'very_low'
            WHEN 6 THEN 'weird-value' WHEN 7 THEN 'URGENT' END AS priority,
       CASE doc_id % 4 WHEN 0 THEN 'Incident' WHEN 1 THEN 'Request' WHEN 2 THEN 'Problem' END AS type
FROM {documents}
""",
    "topic_anchors": """
SELECT CAST(vec_id AS INT) AS topic_ord,
       CASE vec_id WHEN 0 THEN 'Policy' WHEN 1 THEN 'Claims' WHEN 2 THEN 'Billing'
                   WHEN 3 THEN 'Technical' ELSE 'Other' END AS topic,
       embedding AS anchor
FROM {embeddings} WHERE vec_id < 5
""",
    "zs_scores": """
SELECT doc_id AS ticket_id, ((doc_id * 37) % 101) / 1e2 AS zs_score FROM {documents} WHERE doc_id % 29 <> 3
UNION ALL
SELECT doc_id AS ticket_id, 0.75 AS zs_score FROM {documents} WHERE doc_id % 23 = 5
""",
    "agent_steps": """
SELECT conv_id AS ticket_id, turn + 1 AS turn,
       CASE (conv_id * 7 + turn * 3) % 8
            WHEN 0 THEN 'missing_info' WHEN 3 THEN 'missing_info' WHEN 1 THEN 'forward'
            WHEN 2 THEN 'escalate' WHEN 4 THEN 'clarify' WHEN 5 THEN 'faq'
            WHEN 6 THEN 'claim' END AS tool,
       CASE WHEN conv_id % 6 = 1 THEN '' WHEN conv_id % 6 = 2 THEN NULL ELSE text END AS reasoning,
       CASE WHEN (conv_id * 7 + turn * 3) % 8 = 4 THEN array(' ', text, role, 'more')
            WHEN conv_id % 3 = 0 THEN array(role) END AS questions,
       CASE WHEN (conv_id * 7 + turn * 3) % 8 = 5 THEN role END AS faq_topic,
       CASE WHEN conv_id % 17 = 5 THEN 'faq_topic: Input should be a valid string' END AS args_error
FROM {conversations}
""",
    "runtimes": """
SELECT event_id AS ticket_id, value AS runtime_seconds, event_type AS tool_path FROM {events}
UNION ALL
SELECT event_id AS ticket_id, value / 4 AS runtime_seconds, event_type AS tool_path FROM {events} WHERE event_id % 19 = 6
""",
    "order_priorities": """
SELECT o_orderkey AS ticket_id, substr(o_orderpriority, 3) AS priority FROM {orders}
""",
    # which response shape a conversation turn stands for; four attempts per turn,
    # one more than are looked at
    "log_shapes": """
SELECT conv_id AS ticket_id, CAST(floor(turn / 4) AS INT) + 1 AS turn,
       CAST(turn % 4 AS INT) + 1 AS attempt,
       CAST((conv_id * 5 + turn * 3) % 14 AS INT) AS shape, role, text
FROM {conversations}
""",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    sql = SQL[name]
    source = sql[sql.index("{") + 1 : sql.index("}")]
    return spark.sql(sql, **{source: table(spark, sf_dir, source)})


def canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canonicalise(view(spark, sf_dir, "tickets_raw"))


def valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return valid_rows(canonical(spark, sf_dir))


def prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Valid tickets of every language with their cleaned text."""
    return clean_text(valid(spark, sf_dir))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One vector per ticket; some are null."""
    present = F.when(F.col("vec_id") % 31 != 4, F.col("embedding"))
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("ticket_id"), present.alias("embedding")
    )


def topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ticket_id, topic, topic_margin, topic_all_scores of every vector."""
    return score_topics(vectors(spark, sf_dir), view(spark, sf_dir, "topic_anchors"))


def urgent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prepared tickets with signals_found, urgency_score and urgency."""
    found = with_signals(prepared(spark, sf_dir), LEXICON)
    joined = found.join(one_score(view(spark, sf_dir, "zs_scores")), "ticket_id", "left")
    return with_urgency(joined, F.col("zs_score")).drop("zs_score")


def scored(spark: SparkSession, sf_dir: str, keep_text: bool = True) -> DataFrame:
    """Prepared tickets with topic and urgency; Other where there is no vector."""
    return score(
        prepared(spark, sf_dir),
        vectors(spark, sf_dir),
        view(spark, sf_dir, "topic_anchors"),
        view(spark, sf_dir, "zs_scores"),
        LEXICON,
        keep_text,
    )


def folded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fold_turns(view(spark, sf_dir, "agent_steps"))


def decided(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decide(scored(spark, sf_dir, keep_text=False), folded(spark, sf_dir))


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assemble_results(
        decided(spark, sf_dir), view(spark, sf_dir, "runtimes")
    )


def frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    return eval_frame(results(spark, sf_dir))


def step_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Responses as JSON text, made from conversation turns in 14 shapes."""

    def step(tool: str | None = None, thought="text", args: str | None = None) -> str:
        fields = []
        if thought:
            fields.append(f"'thought', {thought}")
        if tool:
            fields.append(f"'tool', '{tool}'")
        if args:
            fields.append(f"'args', named_struct({args})")
        return f"to_json(named_struct({', '.join(fields)}))"

    asked = "'clarification_questions'"
    shapes = [
        step("forward", args="'reasoning', text"),
        step("missing_info"),
        step("clarify", args=f"'reasoning', role, {asked}, array(' ', text, role)"),
        step("clarify", args=f"{asked}, array(' ', '')"),
        step("clarify", args=f"{asked}, text"),
        step("forward", thought=None),
        step("reboot"),
        "concat('{\"thought\": ', to_json(named_struct('t', text)), ', \"tool\": \"faq\", \"args\": null}')",
        f"concat({step('faq')}, ' ', role)",
        f"concat('[', {step('faq')}, ']')",
        step("faq", thought="ticket_id", args="'reasoning', text"),
        step("faq", args="'reasoning', text, 'faq_topic', role"),
        step("escalate", args="'urgent', true"),
        step("claim", args="'reasoning', text, 'faq_topic', ticket_id"),
    ]
    cases = " ".join(f"WHEN {i} THEN {s}" for i, s in enumerate(shapes))
    return view(spark, sf_dir, "log_shapes").select(
        "ticket_id", "turn", "attempt", F.expr(f"CASE shape {cases} END").alias("raw_json")
    )


def helper_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Completeness responses made from events, in six shapes."""
    shape = """
CASE event_id % 6
  WHEN 0 THEN props
  WHEN 1 THEN to_json(named_struct('is_actionable', false, 'missing_aspects', array(event_type, props)))
  WHEN 2 THEN to_json(named_struct('is_actionable', value > 20))
  WHEN 3 THEN to_json(named_struct('is_actionable', 'No', 'missing_aspects', array(event_type)))
  WHEN 4 THEN concat('{"is_actionable": false, "missing_aspects": [', props, ']}')
  ELSE concat('{"is_actionable": 0, "missing_aspects": ["', event_type, '"]} ', event_type)
END
"""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("ticket_id"), F.expr(shape).alias("raw_json")
    )
