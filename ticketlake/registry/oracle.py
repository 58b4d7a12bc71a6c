"""SQL counterparts of the registered queries, in DuckDB's dialect.

Written from the semantics, not from the Spark plans: windows where the library
aggregates, quantile_cont where it selects ranks, and so on.
"""

from __future__ import annotations

from ..operators import steps as st
from ..schemas import (
    ACTION_STEPS,
    ACTIONS,
    FALLBACK_QUESTIONS,
    FALLBACK_REASONS,
    FILE_VERSIONS,
    FORWARD_STEPS,
    GERMAN_ONLY_FILES,
    PRIORITY_DISPLAY,
    PRIORITY_URGENCY,
    QUEUE_TOPICS,
    TOPIC_DESCRIPTIONS,
    TOPICS,
    URGENCY_DISPLAY,
    VERSION_RANKS,
)
from .views import LEXICON, SQL

ORACLE: dict[str, str] = {}

_W = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]"


def _q(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _strip(col: str) -> str:
    return rf"regexp_replace({col}, '^{_W}+|{_W}+$', '', 'g')"


def _case(col: str, table: dict, default: str = "NULL") -> str:
    arms = " ".join(
        f"WHEN {_q(k)} THEN {_q(v) if isinstance(v, str) else v}"
        for k, v in table.items()
    )
    return f"CASE {col} {arms} ELSE {default} END"


def _queue_topic(col: str) -> str:
    return f"CASE WHEN {col} IS NOT NULL THEN {_case(col, QUEUE_TOPICS, _q('Other'))} END"


def _priority_urgency(col: str) -> str:
    return _case(f"lower({_strip(col)})", PRIORITY_URGENCY)


def _next_step(action: str, topic: str) -> str:
    return f"CASE WHEN {action} = 'FORWARD' THEN {_case(topic, FORWARD_STEPS)} ELSE {_case(action, ACTION_STEPS)} END"


def _pct(part: str, whole: str) -> str:
    return f"round({part} * 100.0::DOUBLE / nullif({whole}, 0), 6)"


def _values(names: list[str]) -> str:
    return "(VALUES " + ", ".join(f"({i}, {_q(n)})" for i, n in enumerate(names)) + ")"


_word = r"(^|[^\p{L}\p{N}_])%s($|[^\p{L}\p{N}_])"
_SIGNALS = (
    "list_filter(["
    + ", ".join(
        f"CASE WHEN regexp_matches(lower(text), {_q(_word % w)}) THEN {_q(w)} END"
        for w in LEXICON
    )
    + "], lambda x: x IS NOT NULL)"
)

# --- shared CTEs, each with the ones it needs ---------------------------------

_CTE: dict[str, tuple[list[str], str]] = {}


def _cte(name: str, needs: list[str], sql: str) -> None:
    _CTE[name] = (needs, sql)


for _name, _sql in SQL.items():
    _source = _sql[_sql.index("{") + 1 : _sql.index("}")]
    _cte(
        _name,
        [],
        _sql.replace("{" + _source + "}", _source).replace("array(", "list_value("),
    )

_cte(
    "canonical",
    ["tickets_raw"],
    f"""
SELECT ticket_id, subject, body, substr(lower(tag), 1, 2) AS language, version, queue,
       priority, type,
       CASE WHEN tag = '' THEN 'language: must not be empty'
            WHEN subject = '' AND body = '' THEN 'subject and body cannot both be empty' END AS error
FROM (SELECT ticket_id, version, {_strip("coalesce(subject, '')")} AS subject,
             {_strip("coalesce(body, '')")} AS body,
             {_strip("coalesce(nullif(language, ''), 'unknown')")} AS tag,
             nullif(queue, '') AS queue, nullif(priority, '') AS priority,
             nullif(type, '') AS type
      FROM tickets_raw)
""",
)
_cte("valid", ["canonical"], "SELECT * EXCLUDE (error) FROM canonical WHERE error IS NULL")
_cte(
    "prepared",
    ["valid"],
    rf"""
SELECT * EXCLUDE (flat), CAST(length(text) AS INT) AS text_length
FROM (SELECT *, CASE WHEN length(flat) > 2000
                     THEN substr(flat, 1, 1800) || chr(10) || '[...]' || chr(10) || right(flat, 200)
                     ELSE flat END AS text
      FROM (SELECT *, {_strip(f"regexp_replace(merged, '{_W}+', ' ', 'g')")} AS flat
            FROM (SELECT *, CASE WHEN subject <> '' AND body <> '' THEN subject || chr(10) || chr(10) || body
                                 WHEN subject <> '' THEN subject ELSE body END AS merged
                  FROM valid)))
WHERE flat <> ''
""",
)
_cte(
    "deduped",
    ["valid"],
    f"""
SELECT * FROM valid
QUALIFY row_number() OVER (PARTITION BY subject, body
                           ORDER BY {_case('version', VERSION_RANKS, '0')} DESC, ticket_id) = 1
""",
)
_cte(
    "topics",
    ["topic_anchors"],
    """
SELECT ticket_id, sims, s1 - s2 AS topic_margin, s1,
       CASE WHEN s1 - s2 < 0.01 AND s1 < 0.45 THEN 'Other' ELSE best END AS topic
FROM (SELECT vec_id AS ticket_id, map_from_entries(list((topic, s))) AS sims,
             max(topic) FILTER (WHERE r = 1) AS best,
             max(s) FILTER (WHERE r = 1) AS s1, max(s) FILTER (WHERE r = 2) AS s2
      FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, topic_ord) AS r
            FROM (SELECT e.vec_id, a.topic, a.topic_ord,
                         list_cosine_similarity(e.embedding::DOUBLE[], a.anchor::DOUBLE[]) AS s
                  FROM embeddings e CROSS JOIN topic_anchors a WHERE e.vec_id % 31 <> 4))
      GROUP BY vec_id)
UNION ALL
SELECT vec_id, NULL, NULL, NULL, 'Other' FROM embeddings WHERE vec_id % 31 = 4
""",
)
_cte(
    "urgent",
    ["prepared", "zs_scores"],
    f"""
SELECT *, CASE WHEN urgency_score >= 0.66 THEN 'high' WHEN urgency_score >= 0.33 THEN 'medium'
               ELSE 'low' END AS urgency
FROM (SELECT *, CASE WHEN zs_score IS NULL THEN signal ELSE 0.5::DOUBLE * signal + 0.5::DOUBLE * zs_score END AS urgency_score
      FROM (SELECT *, least(len(signals_found) * 0.5::DOUBLE, 1.0::DOUBLE) AS signal
            FROM (SELECT p.*, z.zs_score, {_SIGNALS} AS signals_found
                  FROM prepared p
                  LEFT JOIN (SELECT ticket_id, max(zs_score) AS zs_score FROM zs_scores GROUP BY ticket_id) z
                  USING (ticket_id))))
""",
)
_cte(
    "scored",
    ["urgent", "topics"],
    """
SELECT u.*, coalesce(t.topic, 'Other') AS topic, t.topic_margin, t.sims
FROM urgent u LEFT JOIN topics t USING (ticket_id)
""",
)


def _nth(field: str, turn: int) -> str:
    return f"max({field}) FILTER (WHERE turn = {turn})"


# only one helper exists, so the second turn always ends the loop
_cte(
    "folded",
    ["agent_steps"],
    f"""
SELECT ticket_id, tools_used,
       CASE WHEN ended = 1 THEN t1 WHEN ended = 2 THEN t2 END AS tool,
       CASE WHEN ended = 1 THEN reasoning1 WHEN ended = 2 THEN reasoning2 END AS reasoning,
       CASE WHEN ended = 1 THEN questions1 WHEN ended = 2 THEN questions2 END AS questions,
       CASE WHEN ended = 1 THEN faq1 WHEN ended = 2 THEN faq2 END AS faq_topic,
       CASE WHEN ended = 1 THEN err1 WHEN ended = 2 THEN err2 END AS args_error
FROM (SELECT *,
             CASE WHEN t1 IS NULL THEN '__fallback__' WHEN t1 <> 'missing_info' THEN t1
                  WHEN t2 IS NULL THEN 'missing_info -> __fallback__'
                  WHEN t2 = 'missing_info' THEN 'missing_info -> __loop_break__'
                  ELSE 'missing_info -> ' || t2 END AS tools_used,
             CASE WHEN t1 <> 'missing_info' THEN 1
                  WHEN t1 = 'missing_info' AND t2 <> 'missing_info' THEN 2 END AS ended
      FROM (SELECT ticket_id, {_nth('tool', 1)} AS t1, {_nth('tool', 2)} AS t2,
                   {_nth('reasoning', 1)} AS reasoning1, {_nth('reasoning', 2)} AS reasoning2,
                   {_nth('questions', 1)} AS questions1, {_nth('questions', 2)} AS questions2,
                   {_nth('faq_topic', 1)} AS faq1, {_nth('faq_topic', 2)} AS faq2,
                   {_nth('args_error', 1)} AS err1, {_nth('args_error', 2)} AS err2
            FROM agent_steps GROUP BY ticket_id))
""",
)


def _fallback_action(topic: str, urgency: str) -> str:
    return (
        f"CASE WHEN {urgency} = 'high' THEN 'ESCALATE' WHEN {topic} = 'Claims' THEN 'CLAIM' "
        f"WHEN {topic} = 'Other' THEN 'CLARIFY' ELSE 'FORWARD' END"
    )


_asked_by_rule = "[" + ", ".join(_q(x) for x in FALLBACK_QUESTIONS) + "]"
_cte(
    "decided",
    ["scored", "folded"],
    f"""
SELECT *, {_next_step('action', 'topic')} AS next_step
FROM (SELECT * EXCLUDE (raw_reasoning, questions, raw_faq),
             CASE WHEN decision_error IS NOT NULL THEN NULL WHEN by_rule THEN fb
                  ELSE upper(tool) END AS action,
             CASE WHEN decision_error IS NOT NULL THEN NULL WHEN by_rule THEN {_case('fb', FALLBACK_REASONS)}
                  ELSE coalesce(nullif(substr(raw_reasoning, 1, 200), ''), 'No reasoning provided.') END AS reasoning,
             CASE WHEN decision_error IS NOT NULL THEN NULL
                  WHEN by_rule THEN CASE WHEN fb = 'CLARIFY' THEN {_asked_by_rule} ELSE [] END
                  ELSE list_filter(coalesce(questions, []), lambda x: trim(x) <> '')[1:2] END AS clarification_questions,
             CASE WHEN decision_error IS NULL AND NOT by_rule THEN raw_faq END AS faq_topic
      FROM (SELECT *, CASE WHEN NOT by_rule THEN args_error END AS decision_error,
                   {_fallback_action('topic', 'urgency')} AS fb
            FROM (SELECT s.*, coalesce(f.tools_used, '__fallback__') AS tools_used, f.tool,
                         f.reasoning AS raw_reasoning, f.questions, f.faq_topic AS raw_faq, f.args_error,
                         coalesce(f.tools_used, '__fallback__') LIKE '%\\_\\_' ESCAPE '\\' AS by_rule
                  FROM scored s LEFT JOIN folded f USING (ticket_id))))
""",
)
_cte(
    "results",
    ["decided", "runtimes"],
    """
SELECT d.*, r.runtime_seconds,
       CASE WHEN length(d.text) > 200 THEN substr(d.text, 1, 200) || '...' ELSE d.text END AS text_snippet
FROM decided d LEFT JOIN (SELECT ticket_id, sum(runtime_seconds) AS runtime_seconds FROM runtimes GROUP BY ticket_id) r
  USING (ticket_id) WHERE d.decision_error IS NULL
""",
)
_cte(
    "frame",
    ["results"],
    f"""
SELECT ticket_id, topic AS predicted_topic, urgency AS predicted_urgency, topic_margin, action,
       next_step, replace(tools_used, ' -> ', '|') AS tools_used, tools_used AS tool_path,
       CAST(len(clarification_questions) AS INT) AS n_clarifications, runtime_seconds, text_length,
       queue AS gt_queue, priority AS gt_priority, {_queue_topic('queue')} AS mapped_topic,
       {_priority_urgency('priority')} AS mapped_urgency, text_snippet AS snippet, reasoning
FROM results
""",
)
_cte(
    "buckets",
    ["frame"],
    """
SELECT f.*, q25, q75,
       CASE WHEN text_length <= q25 THEN 'short' WHEN text_length <= q75 THEN 'medium' ELSE 'long' END AS bucket
FROM frame f CROSS JOIN (SELECT quantile_cont(text_length, 0.25) AS q25,
                                quantile_cont(text_length, 0.75) AS q75 FROM frame)
""",
)


def _event_shape(i: int, sql: str) -> str:
    return f"CASE WHEN event_id % 6 = {i} THEN {sql} END"


def _with(sql: str, *needs: str) -> str:
    done: list[str] = []

    def add(name: str) -> None:
        for n in _CTE[name][0]:
            add(n)
        if name not in done:
            done.append(name)

    for n in needs:
        add(n)
    if not done:
        return sql.strip()
    parts = ",\n".join(f"{n} AS ({_CTE[n][1].strip()})" for n in done)
    return f"WITH {parts}\n{sql.strip()}"


def _oracle(name: str, needs: list[str], sql: str) -> None:
    ORACLE[name] = _with(sql, *needs)


# --- prepare --------------------------------------------------------------------

_oracle(
    "ticket_ids",
    [],
    "SELECT doc_id, ('0x' || substr(md5(source || ':' || doc_id), 1, 12))::BIGINT AS ticket_id FROM documents",
)
_oracle(
    "canonical_reject_split",
    ["canonical"],
    """
SELECT * EXCLUDE (error), CASE WHEN error IS NULL THEN 1 ELSE 0 END AS is_valid,
       coalesce(error, '') AS error FROM canonical
""",
)
_oracle(
    "load_counts",
    ["canonical"],
    """
SELECT version, CAST(grouping(version) AS INT) AS is_total,
       count(*) FILTER (WHERE error IS NULL) AS n_valid,
       count(*) FILTER (WHERE error IS NOT NULL) AS n_rejected
FROM canonical GROUP BY ROLLUP (version)
""",
)
_oracle("clean_text", ["prepared"], "SELECT ticket_id, text, text_length FROM prepared")
_oracle(
    "text_length_default",
    ["prepared"],
    "SELECT ticket_id, CAST(length(text) AS INT) AS text_length FROM prepared",
)
_oracle(
    "merged_text",
    ["valid"],
    """
SELECT ticket_id, CASE WHEN subject <> '' AND body <> '' THEN subject || chr(10) || chr(10) || body
                       ELSE subject || body END AS merged FROM valid
""",
)
_oracle(
    "dedup_version",
    ["deduped"],
    "SELECT ticket_id, subject, body, version, language FROM deduped",
)
_oracle(
    "language_filter",
    ["deduped"],
    "SELECT ticket_id, language, version FROM deduped WHERE language IN ('en', 'de')",
)


def _key(seed: str) -> str:
    return f"md5(ticket_id || ':{seed}')"


_oracle(
    "stratified_sample",
    ["prepared"],
    f"""
SELECT ticket_id, queue, text_length, {_key('42:order')} AS sample_order
FROM (SELECT *, row_number() OVER (ORDER BY picked DESC, CASE WHEN picked THEN '' ELSE {_key('42:fill')} END, ticket_id) AS place
      FROM (SELECT *, queue IS NOT NULL
                   AND row_number() OVER (PARTITION BY queue ORDER BY {_key('42')}, ticket_id)
                       <= 300 // (SELECT count(DISTINCT queue) FROM prepared) AS picked
            FROM prepared))
WHERE place <= 300
""",
)
_oracle(
    "unstratified_sample",
    ["prepared"],
    f"""
SELECT ticket_id, queue, text_length, {_key('42:order')} AS sample_order
FROM prepared ORDER BY {_key('42')}, ticket_id LIMIT 300
""",
)
_oracle(
    "sample_head",
    ["prepared"],
    f"SELECT ticket_id, text_length FROM prepared ORDER BY {_key('42:order')}, ticket_id LIMIT 25",
)
_oracle(
    "random_ticket",
    ["prepared"],
    f"SELECT ticket_id, text FROM prepared ORDER BY {_key('7:one')}, ticket_id LIMIT 1",
)

# --- sources ----------------------------------------------------------------------

_by_version = {v: name for name, v in FILE_VERSIONS.items()}
_german = ", ".join(_q(n) for n in GERMAN_ONLY_FILES)
_cte(
    "ingested",
    ["tickets_raw"],
    f"""
SELECT file, row_index, ('0x' || substr(md5(file || ':' || row_index), 1, 12))::BIGINT AS ticket_id,
       {_strip('subject')} AS subject, {_strip('body')} AS body,
       CASE WHEN file IN ({_german}) THEN 'de' ELSE {_strip('language')} END AS tag,
       version, queue, priority, type
FROM (SELECT *, {_case('version', _by_version)} AS file,
             row_number() OVER (PARTITION BY version ORDER BY ticket_id) - 1 AS row_index
      FROM tickets_raw)
""",
)
_oracle(
    "csv_roundtrip",
    ["ingested"],
    """
SELECT file, row_index, ticket_id, subject, body, substr(lower(tag), 1, 2) AS language, version,
       queue, priority, type,
       CASE WHEN tag = '' THEN 'language: must not be empty'
            WHEN subject = '' AND body = '' THEN 'subject and body cannot both be empty'
            ELSE '' END AS error
FROM ingested
""",
)
_v4 = next(n for n, v in FILE_VERSIONS.items() if v == "v4")
_oracle(
    "csv_ragged_rows",
    [],
    f"""
SELECT row_index, ('0x' || substr(md5('{_v4}:' || row_index), 1, 12))::BIGINT AS ticket_id, subject,
       CASE WHEN kind = 0 THEN '' ELSE 'body' END AS body,
       CASE WHEN kind < 2 THEN 'un' ELSE lang END AS language,
       CASE WHEN kind >= 2 THEN 'q' END AS queue, CASE WHEN kind >= 2 THEN 't' END AS type,
       CASE WHEN kind = 3 THEN 'row has more cells than the header' ELSE '' END AS error
FROM (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS row_index, doc_id % 4 AS kind, lang,
             {_strip("text || ', x'")} AS subject
      FROM documents)
""",
)
_oracle(
    "file_coverage",
    ["tickets_raw"],
    f"""
SELECT file, CASE WHEN file = 'other.csv' THEN 'unknown' WHEN version = 'v5' OR n IS NULL THEN 'missing' ELSE 'known' END AS status
FROM (SELECT * FROM (VALUES {', '.join(f"({_q(n)}, {_q(v)})" for n, v in FILE_VERSIONS.items())}, ('other.csv', NULL)) f(file, version))
LEFT JOIN (SELECT version, count(*) AS n FROM tickets_raw GROUP BY version) USING (version)
""",
)
_oracle(
    "rejects_roundtrip",
    ["canonical"],
    "SELECT version AS file, ticket_id AS row_index, error FROM canonical WHERE error IS NOT NULL",
)
_oracle(
    "prepared_roundtrip",
    ["prepared"],
    "SELECT ticket_id, language, version, text, text_length FROM prepared",
)
_oracle(
    "results_roundtrip",
    ["results"],
    """
SELECT ticket_id, text_snippet, topic, round(topic_margin, 6) AS topic_margin, action,
       array_to_string(clarification_questions, '|') AS clarification_questions, tools_used,
       round(runtime_seconds, 6) AS runtime_seconds, queue FROM results
""",
)

# --- score -------------------------------------------------------------------------

_oracle(
    "topic_scores",
    ["topics"],
    "SELECT ticket_id, "
    + ", ".join(f"round(sims['{t}'], 6) AS {t.lower()}" for t in TOPICS)
    + " FROM topics",
)
_oracle(
    "topic_margin",
    ["topics"],
    "SELECT ticket_id, topic, round(topic_margin, 6) AS topic_margin FROM topics",
)
_oracle(
    "topic_fallback",
    ["topics"],
    """
SELECT topic, count(*) AS n, count(*) FILTER (WHERE topic_margin < 0.01 AND s1 < 0.45) AS n_unsure
FROM topics GROUP BY topic
""",
)
_oracle(
    "topic_display",
    ["topics"],
    """
SELECT t.ticket_id, string_agg(r.topic, ', ' ORDER BY r.s DESC, r.topic_ord) AS top,
       CASE WHEN any_value(t.topic_margin) < 0.01 THEN 'weak separation' ELSE 'confident' END AS confidence
FROM topics t JOIN (
    SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, topic_ord) AS r
    FROM (SELECT e.vec_id, a.topic, a.topic_ord,
                 list_cosine_similarity(e.embedding::DOUBLE[], a.anchor::DOUBLE[]) AS s
          FROM embeddings e CROSS JOIN topic_anchors a)) r
  ON t.ticket_id = r.vec_id AND r.r <= 3 AND t.topic_margin IS NOT NULL
GROUP BY t.ticket_id
""",
)
_oracle(
    "urgency_signals",
    ["urgent"],
    """
SELECT ticket_id, CAST(len(signals_found) AS INT) AS n_signals,
       array_to_string(signals_found, '|') AS signals_found FROM urgent
""",
)
_oracle(
    "urgency_level",
    ["urgent"],
    "SELECT ticket_id, round(urgency_score, 6) AS urgency_score, urgency FROM urgent",
)
def _letters(text: str) -> str:
    return "[" + ", ".join(f"(length({text}) - length(replace({text}, '{c}', '')))::DOUBLE" for c in "eanti") + "]"


_oracle(
    "embedded_topics",
    [],
    f"""
SELECT ticket_id, CASE WHEN s1 - s2 < 0.01 AND s1 < 0.45 THEN 'Other' ELSE best END AS topic,
       round(s1 - s2, 6) AS topic_margin
FROM (SELECT doc_id AS ticket_id, max(topic) FILTER (WHERE r = 1) AS best,
             max(s) FILTER (WHERE r = 1) AS s1, max(s) FILTER (WHERE r = 2) AS s2
      FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY s DESC, ord) AS r
            FROM (SELECT d.doc_id, a.topic, a.ord, list_dot_product(d.v, a.v)
                    / (greatest(sqrt(list_dot_product(d.v, d.v)), 1e-12) * sqrt(list_dot_product(a.v, a.v))) AS s
                  FROM (SELECT doc_id, {_letters('text')} AS v FROM documents) d
                  CROSS JOIN (SELECT topic, ord, {_letters('description')} AS v
                              FROM (VALUES {', '.join(f"({i}, {_q(t)}, {_q(TOPIC_DESCRIPTIONS[t])})" for i, t in enumerate(TOPICS))}) a(ord, topic, description)) a))
      GROUP BY doc_id)
""",
)
_oracle(
    "scorer_udf",
    [],
    "SELECT doc_id AS ticket_id, (length(text) % 101) / 1e2 AS score FROM documents",
)

_said = """SELECT 'd' || doc_id AS ticket_id, text FROM documents
  UNION ALL SELECT 'c-' || conv_id || '-' || turn, text FROM conversations"""
_oracle("scores_per_text", [], f"SELECT ticket_id, (length(text) % 101) / 1e2 AS score FROM ({_said})")
_oracle(
    "scores_from_store",
    [],
    f"""
SELECT count(*) AS n, round(sum((length(text) % 101) / 1e2), 6) AS total,
       (SELECT count(DISTINCT text) FROM documents) AS n_first_run,
       count(DISTINCT text) - (SELECT count(DISTINCT text) FROM documents) AS n_second_run
FROM ({_said})
""",
)

# --- decide --------------------------------------------------------------------------

_oracle(
    "render_requests",
    ["scored"],
    """
SELECT ticket_id,
       concat('Ticket: ', text, chr(10), 'Topic: ', topic, chr(10), 'Urgency: ', urgency, chr(10), 'Turn: 1') AS first_turn,
       concat('Ticket: ', text, chr(10), 'Pre-classified topic: ', topic, chr(10), 'Urgency: ', urgency) AS completeness,
       concat('Ticket: ', text, chr(10), 'Topic: ', topic, chr(10), 'Urgency: ', urgency, chr(10),
              'Previous tool: missing_info returned {"is_actionable":',
              CASE WHEN text_length > 100 THEN 'true' ELSE 'false' END,
              ',"missing_aspects":["', topic, '","', urgency, '"]}', chr(10), 'Turn: 2') AS follow_up
FROM scored
""",
)
_oracle(
    "seeded_requests",
    ["scored"],
    """
SELECT ticket_id, 1 AS turn, 1 AS attempt, 6 AS n_messages,
       'system,user,assistant,user,assistant,user' AS roles,
       concat('Ticket: ', text, chr(10), 'Topic: ', topic, chr(10), 'Urgency: ', urgency, chr(10), 'Turn: 1') AS last_content
FROM scored
""",
)

_ERRORS = {
    3: st.E_NO_QUESTION,
    4: st.E_QUESTION_LIST,
    5: st.E_MISSING % "thought",
    6: st.E_TOOL,
    7: st.E_STRING % "thought" + "; " + st.E_ARGS,
    8: st.E_JSON,
    9: st.E_OBJECT,
    10: st.E_STRING % "thought",
}
_TOOLS = {
    0: "forward",
    1: "missing_info",
    2: "clarify",
    11: "faq",
    12: "escalate",
    13: "claim",
}


def _by_shape(table: dict[int, str], default: str = "NULL", quote: bool = True) -> str:
    arms = " ".join(
        f"WHEN {k} THEN {_q(v) if quote else v}" for k, v in table.items()
    )
    return f"CASE shape {arms} ELSE {default} END"


_cte(
    "steps",
    ["log_shapes"],
    f"""
SELECT ticket_id, turn, attempt, {_by_shape(_TOOLS)} AS tool,
       CASE WHEN shape IN ({', '.join(map(str, _TOOLS))}) THEN text END AS thought,
       {_by_shape(_ERRORS, "''")} AS errors,
       {_by_shape({0: 'text', 2: 'role', 11: 'text', 13: 'text'}, quote=False)} AS reasoning,
       CASE WHEN shape = 2 THEN ' |' || text || '|' || role ELSE '' END AS questions,
       {_by_shape({11: 'role', 13: 'CAST(ticket_id AS VARCHAR)'}, quote=False)} AS faq_topic,
       {_by_shape({13: st.D_FAQ})} AS args_error
FROM log_shapes
""",
)
_oracle("step_validation", ["steps"], "SELECT * FROM steps")
_oracle(
    "retry_messages",
    ["steps"],
    """
SELECT ticket_id, turn, attempt,
       'Your previous response failed validation: ' || errors || '. Fix the specific issue above and respond with valid JSON of the form {"thought": "...", "tool": "...", "args": {...}}.' AS retry
FROM steps WHERE errors <> ''
""",
)
_cte(
    "picks",
    ["steps"],
    """
SELECT ticket_id, turn, min(attempt) FILTER (WHERE errors = '') AS attempt,
       min_by(tool, attempt) FILTER (WHERE errors = '') AS tool,
       min_by(thought, attempt) FILTER (WHERE errors = '') AS thought, count(*) AS n_attempts
FROM steps WHERE attempt BETWEEN 1 AND 3 GROUP BY ticket_id, turn
""",
)
_oracle(
    "attempt_pick",
    ["picks"],
    "SELECT ticket_id, turn, attempt, tool, n_attempts FROM picks",
)
_cte(
    "answers",
    [],
    """
SELECT event_id AS ticket_id, CASE WHEN event_id % 6 IN (1, 2, 3) THEN 1 ELSE 0 END AS was_valid,
       CASE event_id % 6 WHEN 1 THEN 0 WHEN 2 THEN CAST(value > 20 AS INT) WHEN 3 THEN 0 ELSE 1 END AS is_actionable,
       CASE event_id % 6 WHEN 1 THEN [event_type, props] WHEN 3 THEN [event_type] ELSE [] END AS aspects
FROM events
""",
)
_oracle(
    "missing_info_default",
    ["answers"],
    """
SELECT ticket_id, was_valid, is_actionable, array_to_string(aspects, '|') AS missing_aspects FROM answers
""",
)
_oracle(
    "retry_requests",
    ["steps"],
    """
SELECT ticket_id, turn, attempt + 1 AS attempt, 'system,user,assistant,user' AS roles,
       'Your previous response failed validation: ' || errors || '. Fix the specific issue above and respond with valid JSON of the form {"thought": "...", "tool": "...", "args": {...}}.' AS asked
FROM steps WHERE errors <> '' AND attempt < 3
""",
)
_oracle(
    "completeness_requests",
    ["scored"],
    """
SELECT ticket_id, 'CHECK' AS system,
       concat('Ticket: ', text, chr(10), 'Pre-classified topic: ', topic, chr(10), 'Urgency: ', urgency) AS asked
FROM scored
""",
)
# with one helper, only a ticket that has called it in its single turn so far goes on
_oracle(
    "follow_up_requests",
    ["picks", "answers", "scored"],
    """
SELECT ticket_id, 2 AS turn, 1 AS attempt, 'system,user,assistant,user' AS roles,
       '{"thought":' || to_json(thought)::VARCHAR || ',"tool":"missing_info","args":{}}' AS said,
       concat('Ticket: ', text, chr(10), 'Topic: ', topic, chr(10), 'Urgency: ', urgency, chr(10),
              'Previous tool: missing_info returned {"is_actionable":',
              CASE WHEN is_actionable = 1 THEN 'true' ELSE 'false' END,
              ',"missing_aspects":', to_json(aspects)::VARCHAR, '}', chr(10), 'Turn: 2') AS asked
FROM (SELECT ticket_id, max(turn) AS last, any_value(tool) FILTER (WHERE turn = 1) AS tool,
             any_value(thought) FILTER (WHERE turn = 1) AS thought
      FROM picks WHERE turn BETWEEN 1 AND 4 GROUP BY ticket_id)
JOIN answers USING (ticket_id) JOIN scored USING (ticket_id)
WHERE last = 1 AND tool = 'missing_info'
""",
)
_oracle(
    "agent_trace_fold",
    ["folded"],
    "SELECT ticket_id, tools_used, tool, reasoning FROM folded",
)
_oracle(
    "trace_counters",
    ["folded"],
    """
SELECT ticket_id, CAST(len(parts) AS INT) AS n_total,
       CAST(len(list_filter(parts, lambda x: x = 'missing_info')) AS INT) AS n_helper,
       CAST(len(list_filter(parts, lambda x: x IN ('forward', 'escalate', 'clarify', 'faq', 'claim'))) AS INT) AS n_terminal,
       CAST(list_contains(parts, '__fallback__') AS INT) AS is_fallback,
       CAST(list_contains(parts, '__loop_break__') AS INT) AS is_loop_break
FROM (SELECT ticket_id, string_split(tools_used, ' -> ') AS parts FROM folded)
""",
)
_oracle(
    "decision_fallback",
    ["scored"],
    f"""
SELECT ticket_id, action, {_case('action', FALLBACK_REASONS)} AS reasoning,
       CASE WHEN action = 'CLARIFY' THEN {_q('|'.join(FALLBACK_QUESTIONS))} ELSE '' END AS questions
FROM (SELECT ticket_id, {_fallback_action('topic', 'urgency')} AS action FROM scored)
""",
)
_oracle(
    "next_step", ["decided"], "SELECT ticket_id, topic, action, next_step FROM decided"
)
_oracle(
    "decision_errors",
    ["decided"],
    "SELECT ticket_id, tools_used, decision_error FROM decided WHERE decision_error IS NOT NULL",
)
_oracle(
    "snippet",
    [],
    """
SELECT doc_id AS ticket_id,
       CASE WHEN length(text) > 200 THEN substr(text, 1, 200) || '...' ELSE text END AS snippet
FROM documents
""",
)
_oracle(
    "assemble_results",
    ["results"],
    """
SELECT ticket_id, text_snippet, topic, round(topic_margin, 6) AS topic_margin,
       round(sims['Claims'], 6) AS claims_score, urgency, round(urgency_score, 6) AS urgency_score,
       action, next_step, reasoning,
       array_to_string(clarification_questions, '|') AS clarification_questions, faq_topic,
       tools_used, runtime_seconds, text_length, queue, priority, type
FROM results
""",
)
_oracle(
    "comparison",
    ["results"],
    f"""
SELECT ticket_id, substr(text_snippet, 1, 120) AS snippet, topic, round(topic_margin, 6) AS topic_margin,
       top_scores, urgency, round(urgency_score, 6) AS urgency_score, action,
       next_step, queue, priority, type, tools_used AS tools, reasoning,
       array_to_string(clarification_questions, '|') AS clarification_questions
FROM results LEFT JOIN (
  SELECT ticket_id, string_agg(printf('%s=%.2f', topic, s), ', ' ORDER BY s DESC, ord) AS top_scores
  FROM (SELECT ticket_id, topic, ord, s, row_number() OVER (PARTITION BY ticket_id ORDER BY s DESC, ord) AS r
        FROM (SELECT ticket_id, t.topic, t.ord, sims[t.topic] AS s FROM results CROSS JOIN {_values(TOPICS)} t(ord, topic)
              WHERE topic_margin IS NOT NULL))
  WHERE r <= 3 GROUP BY ticket_id) USING (ticket_id)
""",
)

# --- label maps -------------------------------------------------------------------------

_explicit = ", ".join(_q(x) for x in QUEUE_TOPICS)
_oracle(
    "queue_topic_map",
    ["tickets_raw"],
    f"""
SELECT ticket_id, queue, {_queue_topic('queue')} AS mapped_topic,
       CASE WHEN queue IN ({_explicit}) THEN 1 ELSE 0 END AS is_explicit FROM tickets_raw
""",
)
_oracle(
    "priority_urgency_map",
    ["tickets_raw", "order_priorities"],
    f"""
SELECT *, CASE mapped_urgency WHEN 'low' THEN 0 WHEN 'medium' THEN 1 WHEN 'high' THEN 2 END AS ordinal
FROM (SELECT ticket_id, priority, {_priority_urgency('priority')} AS mapped_urgency
      FROM (SELECT * FROM order_priorities UNION ALL SELECT ticket_id, priority FROM tickets_raw))
""",
)

# --- evaluate -----------------------------------------------------------------------------

_oracle(
    "evaluation_frame",
    ["frame"],
    "SELECT * REPLACE (round(topic_margin, 6) AS topic_margin) FROM frame",
)


def _shares(name: str, source: str, col: str, where: str = "true") -> None:
    _oracle(
        name,
        [source],
        f"""
SELECT {col}, count(*) AS n, {_pct('count(*)', 'sum(count(*)) OVER ()')} AS pct
FROM {source} WHERE {where} GROUP BY {col}
""",
    )


def _dense(name: str, source: str, col: str, expr: str, values: list[str]) -> None:
    _oracle(
        name,
        [source],
        f"""
SELECT CAST(o.ord AS INT) AS ord, o.{col}, count(f.v) AS n,
       coalesce({_pct('count(f.v)', 'sum(count(f.v)) OVER ()')}, 0) AS pct
FROM {_values(values)} o(ord, {col}) LEFT JOIN (SELECT {expr} AS v FROM {source}) f ON f.v = o.{col}
GROUP BY o.ord, o.{col}
""",
    )


def _top(name: str, source: str, col: str, k: int, where: str = "true", pct: bool = True) -> None:
    share = f", {_pct('count(*)', 'sum(count(*)) OVER ()')} AS pct" if pct else ""
    _oracle(
        name,
        [source],
        f"""
SELECT * FROM (
  SELECT {col}, count(*) AS n{share},
         greatest((SELECT count(DISTINCT {col}) FROM {source} WHERE {where}) - {k}, 0) AS n_more
  FROM {source} WHERE {where} AND {col} IS NOT NULL GROUP BY {col})
ORDER BY n DESC, {col} LIMIT {k}
""",
    )


_shares("action_dist", "frame", "action")
_dense("action_shares", "frame", "action", "action", ACTIONS)
_top("tool_path_top10", "frame", "tool_path", 10)
_oracle(
    "fallback_rate",
    ["frame"],
    f"""
SELECT *, {_pct('n_fallback', 'n')} AS fallback_pct, {_pct('n_loop_break', 'n')} AS loop_break_pct
FROM (SELECT count(*) AS n, count(*) FILTER (WHERE contains(tool_path, '__fallback__')) AS n_fallback,
             count(*) FILTER (WHERE contains(tool_path, '__loop_break__')) AS n_loop_break FROM frame)
""",
)
_oracle(
    "action_path_cube",
    ["frame"],
    """
SELECT action, tool_path, CAST(grouping(action) AS INT) AS action_total,
       CAST(grouping(tool_path) AS INT) AS tool_path_total, count(*) AS n
FROM frame GROUP BY CUBE (action, tool_path)
""",
)
_oracle(
    "question_coverage",
    ["frame"],
    f"""
SELECT action, count(*) AS n, count(*) FILTER (WHERE n_clarifications > 0) AS n_asking,
       round(avg(n_clarifications), 6) AS mean_questions,
       {_pct('count(*) FILTER (WHERE n_clarifications > 0)', 'count(*)')} AS asking_pct
FROM frame GROUP BY action
""",
)
_ordinal = "CASE {} WHEN 'low' THEN 0 WHEN 'medium' THEN 1 WHEN 'high' THEN 2 END"
_gap = f"abs({_ordinal.format('predicted_urgency')} - {_ordinal.format('mapped_urgency')})"
_oracle(
    "urgency_agreement",
    ["frame"],
    f"""
SELECT *, {_pct('n_exact', 'n_comparable')} AS exact_pct, {_pct('n_within_1', 'n_comparable')} AS within_1_pct
FROM (SELECT count(*) AS n, count(mapped_urgency) AS n_comparable,
             count(*) FILTER (WHERE predicted_urgency = mapped_urgency) AS n_exact,
             count(*) FILTER (WHERE {_gap} <= 1) AS n_within_1 FROM frame)
""",
)
_oracle(
    "topic_agreement",
    ["frame"],
    f"""
SELECT *, {_pct('n_exact', 'n_comparable')} AS exact_pct, {_pct('n_specific_exact', 'n_specific')} AS specific_pct
FROM (SELECT count(*) AS n, count(mapped_topic) AS n_comparable,
             count(*) FILTER (WHERE predicted_topic = mapped_topic) AS n_exact,
             count(*) FILTER (WHERE mapped_topic <> 'Other') AS n_specific,
             count(*) FILTER (WHERE mapped_topic <> 'Other' AND predicted_topic = mapped_topic) AS n_specific_exact
      FROM frame)
""",
)
_oracle(
    "margin_stats",
    ["frame"],
    f"""
SELECT count(topic_margin) AS n, round(avg(topic_margin), 6) AS mean_margin,
       round(min(topic_margin), 6) AS min_margin, round(max(topic_margin), 6) AS max_margin,
       count(*) FILTER (WHERE topic_margin < 0.01) AS n_low,
       {_pct('count(*) FILTER (WHERE topic_margin < 0.01)', 'count(topic_margin)')} AS low_pct
FROM frame WHERE mapped_topic IS NOT NULL
""",
)


def _matrix(
    name: str, source: str, row: str, col: str, rows: list[str], cols: list[str], margins: bool = True
) -> None:
    cells = ", ".join(f"count(*) FILTER (WHERE f.{col} = {_q(c)}) AS {_ident(c)}" for c in cols)
    total = ", count(f.hit) AS total" if margins else ""
    match = f"o.{row} = 'Total' OR f.{row} = o.{row}" if margins else f"f.{row} = o.{row}"
    _oracle(
        name,
        [source],
        f"""
SELECT CAST(o.ord AS INT) AS ord, o.{row}, {cells}{total}
FROM {_values([*rows, 'Total'] if margins else rows)} o(ord, {row})
LEFT JOIN (SELECT {row}, {col}, 1 AS hit FROM {source} WHERE {row} IS NOT NULL) f ON {match}
GROUP BY o.ord, o.{row}
""",
    )


def _ident(name: str) -> str:
    return f'"{name}"'


_matrix("urgency_confusion", "frame", "mapped_urgency", "predicted_urgency", URGENCY_DISPLAY, URGENCY_DISPLAY)
_matrix("topic_confusion", "frame", "mapped_topic", "predicted_topic", TOPICS, TOPICS)
_matrix("topic_confusion_cells", "frame", "mapped_topic", "predicted_topic", TOPICS, TOPICS, False)
_oracle(
    "topic_recall",
    ["frame"],
    f"""
SELECT mapped_topic, count(*) AS n, count(*) FILTER (WHERE predicted_topic = mapped_topic) AS n_correct,
       {_pct('count(*) FILTER (WHERE predicted_topic = mapped_topic)', 'count(*)')} AS recall_pct
FROM frame WHERE mapped_topic IS NOT NULL GROUP BY mapped_topic
""",
)


def _histogram(name: str, source: str, col: str, bins: int) -> None:
    _oracle(
        name,
        [source],
        f"""
SELECT CAST(g.bin AS INT) AS bin, round(lo + g.bin * w, 6) AS lower, round(lo + (g.bin + 1) * w, 6) AS upper,
       count(h.b) AS n
FROM range({bins}) g(bin)
CROSS JOIN (SELECT min({col})::DOUBLE AS lo, (max({col})::DOUBLE - min({col})::DOUBLE) / {bins} AS w FROM {source})
LEFT JOIN (SELECT least(floor(({col}::DOUBLE - lo) / w), {bins - 1}) AS b
           FROM {source} CROSS JOIN (SELECT min({col})::DOUBLE AS lo,
                                            (max({col})::DOUBLE - min({col})::DOUBLE) / {bins} AS w FROM {source})
           WHERE {col} IS NOT NULL) h ON h.b = g.bin
GROUP BY g.bin, lo, w
""",
    )


_histogram("margin_histogram", "frame", "topic_margin", 30)
_probs = {"min": 0.0, "p25": 0.25, "median": 0.5, "p75": 0.75, "p95": 0.95, "max": 1.0}
_oracle(
    "length_quantiles",
    ["frame"],
    "SELECT "
    + ", ".join(
        f"CAST(floor(quantile_cont(text_length, {p})) AS INT) AS {_ident(n)}"
        for n, p in _probs.items()
    )
    + " FROM frame",
)
_oracle(
    "length_by_action",
    ["frame"],
    "SELECT action, round(avg(text_length), 6) AS mean_length, count(*) AS n FROM frame GROUP BY action",
)
_matrix("length_bucket_action", "buckets", "bucket", "action", ["short", "medium", "long"], ACTIONS)
_oracle(
    "bucket_quality",
    ["buckets"],
    f"""
SELECT CAST(o.ord AS INT) AS ord, o.bucket,
       CASE o.bucket WHEN 'short' THEN 'short (<=' || floor(c.q25)::INT || ')'
                     WHEN 'medium' THEN 'medium (' || (floor(c.q25)::INT + 1) || '-' || floor(c.q75)::INT || ')'
                     ELSE 'long (>' || floor(c.q75)::INT || ')' END AS bucket_label,
       c.q25, c.q75, count(b.ticket_id) AS n, count(mapped_topic) AS n_topic,
       count(*) FILTER (WHERE predicted_topic = mapped_topic) AS n_topic_exact,
       count(mapped_urgency) AS n_urgency,
       count(*) FILTER (WHERE predicted_urgency = mapped_urgency) AS n_urgency_exact,
       round(avg(topic_margin), 6) AS mean_margin,
       {_pct('count(*) FILTER (WHERE predicted_topic = mapped_topic)', 'count(mapped_topic)')} AS topic_pct,
       {_pct('count(*) FILTER (WHERE predicted_urgency = mapped_urgency)', 'count(mapped_urgency)')} AS urgency_pct
FROM {_values(['short', 'medium', 'long'])} o(ord, bucket)
CROSS JOIN (SELECT DISTINCT q25, q75 FROM buckets) c
LEFT JOIN buckets b ON b.bucket = o.bucket
GROUP BY o.ord, o.bucket, c.q25, c.q75
""",
)
_oracle(
    "runtime_stats",
    ["runtimes"],
    """
SELECT count(runtime_seconds) AS n, round(sum(runtime_seconds), 6) AS total,
       round(avg(runtime_seconds), 6) AS mean, max(runtime_seconds) AS slowest,
       round(quantile_cont(runtime_seconds, 0.5), 6) AS p50,
       round(quantile_cont(runtime_seconds, 0.95), 6) AS p95
FROM runtimes
""",
)
_oracle(
    "runtime_by_path",
    ["runtimes"],
    """
SELECT tool_path, round(avg(runtime_seconds), 6) AS mean, count(runtime_seconds) AS n
FROM runtimes WHERE runtime_seconds IS NOT NULL GROUP BY tool_path
""",
)
_oracle(
    "runtime_box",
    ["runtimes"],
    """
SELECT tool_path, count(*) AS n, round(avg(runtime_seconds), 6) AS mean,
       round(min(runtime_seconds), 6) AS "min", round(quantile_cont(runtime_seconds, 0.25), 6) AS q1,
       round(quantile_cont(runtime_seconds, 0.5), 6) AS median,
       round(quantile_cont(runtime_seconds, 0.75), 6) AS q3, round(max(runtime_seconds), 6) AS "max"
FROM runtimes WHERE runtime_seconds IS NOT NULL GROUP BY tool_path
""",
)
_oracle(
    "disagreement_counts",
    ["frame"],
    """
SELECT count(*) FILTER (WHERE predicted_topic <> mapped_topic) AS n_topic,
       count(*) FILTER (WHERE predicted_urgency <> mapped_urgency) AS n_urgency FROM frame
""",
)


def _examples(focus: str, predicted: str, mapped: str, label: str) -> str:
    return f"""
(SELECT '{focus}' AS focus, ticket_id, substr(snippet, 1, 140) AS snippet, {predicted} AS predicted,
        {mapped} AS mapped, {label} AS label, action, tool_path, substr(reasoning, 1, 140) AS reasoning
 FROM frame WHERE {predicted} <> {mapped} ORDER BY ticket_id LIMIT 5)
"""


_oracle(
    "disagreements",
    ["frame"],
    _examples("topic", "predicted_topic", "mapped_topic", "gt_queue").strip()
    + " UNION ALL "
    + _examples("urgency", "predicted_urgency", "mapped_urgency", "gt_priority").strip(),
)


def _kpis(name: str, where: str) -> None:
    hit, specific = "predicted_topic = mapped_topic", "mapped_topic <> 'Other'"
    _oracle(
        name,
        ["frame"],
        f"""
SELECT count(*) AS n, {_pct(f'count(*) FILTER (WHERE {hit})', 'count(mapped_topic)')} AS topic_pct,
       {_pct(f'count(*) FILTER (WHERE {specific} AND {hit})', f'count(*) FILTER (WHERE {specific})')} AS topic_specific_pct,
       {_pct('count(*) FILTER (WHERE predicted_urgency = mapped_urgency)', 'count(mapped_urgency)')} AS urgency_pct,
       count(*) FILTER (WHERE contains(tool_path, '__fallback__')) AS n_fallback,
       count(*) FILTER (WHERE contains(tool_path, '__loop_break__')) AS n_loop_break
FROM frame WHERE {where}
""",
    )


_kpis("headline_kpis", "true")
_kpis(
    "headline_kpis_filtered",
    "action IN ('FORWARD', 'ESCALATE', 'CLARIFY') AND predicted_topic IN ('Policy', 'Claims', 'Other') "
    "AND predicted_urgency IN ('medium', 'high')",
)

# --- profile ---------------------------------------------------------------------------------


def _priorities(name: str, source: str) -> None:
    _oracle(
        name,
        [source],
        f"""
SELECT priority, count(*) AS n,
       CASE WHEN priority IS NULL THEN '(missing)'
            ELSE coalesce({_priority_urgency('priority')}, 'UNMAPPED') END AS mapped
FROM {source} GROUP BY priority
""",
    )


_priorities("priority_inspection", "valid")
_priorities("order_priority_inspection", "order_priorities")
_dense("urgency_shares", "valid", "urgency", _priority_urgency("priority"), URGENCY_DISPLAY)
_oracle(
    "unmapped_priorities",
    ["valid"],
    f"""
SELECT priority, count(*) AS n FROM valid
WHERE priority IS NOT NULL AND {_priority_urgency('priority')} IS NULL GROUP BY priority
""",
)
_oracle(
    "queue_inspection",
    ["valid"],
    f"""
SELECT mapped_topic, queue, CAST(grouping(queue) AS INT) AS is_subtotal, count(*) AS n,
       count(DISTINCT q) AS n_queues,
       CASE WHEN grouping(queue) = 0 THEN max(CASE WHEN q IN ({_explicit}) THEN 0 ELSE 1 END) END AS is_default
FROM (SELECT {_queue_topic('queue')} AS mapped_topic, queue, queue AS q FROM valid WHERE queue IS NOT NULL)
GROUP BY GROUPING SETS ((mapped_topic, queue), (mapped_topic))
""",
)
_dense("topic_shares", "valid", "mapped_topic", _queue_topic("queue"), TOPICS)
_top("unmapped_queues", "valid", "queue", 10, f"queue NOT IN ({_explicit})", pct=False)
_oracle(
    "profile_kpis",
    ["valid"],
    """
SELECT count(*) AS n, count(DISTINCT language) AS n_languages, count(DISTINCT queue) AS n_queues,
       count(DISTINCT priority) AS n_priorities, count(DISTINCT type) AS n_types FROM valid
""",
)
_oracle("languages", ["valid"], "SELECT DISTINCT language FROM valid WHERE language IS NOT NULL")
_shares("language_dist", "valid", "language", "language IS NOT NULL")
_oracle(
    "priority_order",
    ["valid"],
    f"""
SELECT priority, count(*) AS n,
       {_case('priority', {p: i + 1 for i, p in enumerate(PRIORITY_DISPLAY)})} AS known_ord
FROM valid WHERE priority IS NOT NULL GROUP BY priority
""",
)
_top("top_queues", "valid", "queue", 20)
_oracle(
    "mapping_coverage",
    ["valid"],
    f"""
SELECT mapped_topic, count(*) AS n, count(DISTINCT queue) AS n_queues,
       count(DISTINCT queue) FILTER (WHERE queue IN ({_explicit})) AS n_explicit,
       {_pct('count(*)', 'sum(count(*)) OVER ()')} AS pct
FROM (SELECT queue, {_queue_topic('queue')} AS mapped_topic FROM valid WHERE queue IS NOT NULL)
GROUP BY mapped_topic
""",
)
_oracle(
    "queue_coverage",
    ["valid"],
    f"""
SELECT count(DISTINCT queue) AS n_queues,
       count(DISTINCT queue) FILTER (WHERE queue IN ({_explicit})) AS n_explicit FROM valid
""",
)
_histogram("length_histogram", "prepared", "text_length", 40)
_box = {"min": 0.0, "q1": 0.25, "median": 0.5, "q3": 0.75, "max": 1.0}


def _quantiles(probs: dict[str, float]) -> str:
    return ", ".join(
        f"quantile_cont(text_length, {p})::DOUBLE AS {_ident(n)}" for n, p in probs.items()
    )


_oracle(
    "length_box",
    ["prepared"],
    f"SELECT language, {_quantiles(_box)} FROM prepared GROUP BY language",
)
_oracle(
    "length_summary",
    ["prepared"],
    f"SELECT count(text_length) AS n, round(avg(text_length), 6) AS mean, {_quantiles(_probs)} FROM prepared",
)
_shares("type_dist", "valid", "type", "type IS NOT NULL")
_shares("version_dist", "valid", "version")
_oracle(
    "sample_browser",
    ["valid"],
    """
SELECT ticket_id, ticket_id || ' - ' || substr(subject, 1, 60)
       || CASE WHEN length(subject) > 60 THEN '...' ELSE '' END AS label
FROM valid ORDER BY ticket_id LIMIT 50
""",
)
_cte(
    "shortlist",
    ["deduped"],
    "SELECT * FROM deduped WHERE language IN ('en', 'de')",
)
ORACLE["prepared_topic_shares"] = _with(
    f"""
SELECT {_queue_topic('p.queue')} AS mapped_topic, count(*) AS n, CAST(sum(p.text_length) AS BIGINT) AS n_chars
FROM prepared p JOIN shortlist s USING (ticket_id) GROUP BY 1
""",
    "prepared",
    "shortlist",
)

# two loads, or folds of two runs, give what one gives
for _name, _of in (
    ("dedup_two_loads", "dedup_version"),
    ("merged_runs_kpis", "headline_kpis_filtered"),
    ("merged_runs_confusion", "topic_confusion"),
    ("merged_runs_buckets", "bucket_quality"),
):
    ORACLE[_name] = ORACLE[_of]


def _gaps(field: str, value: str, entries: dict) -> str:
    listed = ", ".join(f"({_q(k)})" for k in entries)
    return f"""
SELECT '{field}' AS field, 'unmapped' AS side, {value} AS label, count(*) AS n FROM tickets_raw
WHERE {value} IS NOT NULL AND {value} NOT IN (SELECT * FROM (VALUES {listed})) GROUP BY ALL
UNION ALL
SELECT '{field}', 'unused', label, 0 FROM (VALUES {listed}) e(label)
WHERE NOT EXISTS (FROM tickets_raw WHERE {value} = label)
"""


_oracle(
    "mapping_gaps",
    ["tickets_raw"],
    _gaps("queue", "queue", QUEUE_TOPICS) + "UNION ALL" + _gaps("priority", f"lower({_strip('priority')})", PRIORITY_URGENCY),
)
_oracle(
    "mapped_by_table",
    ["tickets_raw"],
    f"SELECT ticket_id, queue, priority, {_queue_topic('queue')} AS mapped_topic, {_priority_urgency('priority')} AS mapped_urgency FROM tickets_raw",
)


def _runs(table: str, key: str) -> str:
    """Words, and pairs of words with what stands between them, of each text in lower case."""
    word = r"[\p{L}\p{N}_]+"
    return f"""
SELECT {key}, unnest(w) AS entry FROM (
  SELECT {key}, regexp_extract_all(lower(text), '{word}') AS w FROM {table})
UNION
SELECT {key}, w[i] || b[i + 1] || w[i + 1] FROM (
  SELECT {key}, w, b, unnest(range(1, len(w))) AS i FROM (
    SELECT {key}, regexp_extract_all(lower(text), '{word}') AS w, string_split_regex(lower(text), '{word}') AS b FROM {table}))
"""


_oracle(
    "lexicon_table_signals",
    [],
    f"""
SELECT doc_id AS ticket_id, count(*)::INT AS n_signals, md5(string_agg(entry, '|' ORDER BY md5(entry))) AS digest
FROM ({_runs('documents', 'doc_id')})
WHERE entry IN (SELECT entry FROM ({_runs('benchmark', 'item_id')}) WHERE regexp_matches(entry, '^[^ ]+( [^ ]+)?$'))
GROUP BY doc_id
""",
)


_oracle(
    "runtime_sketches",
    ["runtimes"],
    """
SELECT tool_path, count(*) AS n, p::DOUBLE AS p, 1 AS within
FROM runtimes, (VALUES (0.05), (0.25), (0.5), (0.75), (0.95)) v(p)
WHERE runtime_seconds IS NOT NULL GROUP BY tool_path, p
""",
)
