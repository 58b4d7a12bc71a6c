"""Declared schemas and the fixed values of the ticket domain."""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Enumerations. Order is meaningful (display order, tie order).
# ---------------------------------------------------------------------------
TOPICS = ["Policy", "Claims", "Billing", "Technical", "Other"]
URGENCY_LEVELS = ["low", "medium", "high"]  # ordinals 0, 1, 2
URGENCY_DISPLAY = ["high", "medium", "low"]
ACTIONS = ["FORWARD", "ESCALATE", "CLARIFY", "FAQ", "CLAIM"]
HELPER_TOOLS = ["missing_info"]
TERMINAL_TOOLS = ["forward", "escalate", "clarify", "faq", "claim"]
TOOLS = HELPER_TOOLS + TERMINAL_TOOLS
FALLBACK_MARK = "__fallback__"
LOOP_BREAK_MARK = "__loop_break__"
MAX_TURNS = 4
MAX_ATTEMPTS = 3

# Known ticket files, the version each one carries, and how
# versions rank when the same ticket occurs in several of them.
FILE_VERSIONS = {
    "dataset-tickets-multi-lang3-4k.csv": "v3",
    "dataset-tickets-multi-lang-4-20k.csv": "v4",
    "aa_dataset-tickets-multi-lang-5-2-50-version.csv": "v5",
    "dataset-tickets-german_normalized.csv": "de_norm",
    "dataset-tickets-german_normalized_50_5_2.csv": "de_norm_50_5_2",
}
GERMAN_ONLY_FILES = [
    "dataset-tickets-german_normalized.csv",
    "dataset-tickets-german_normalized_50_5_2.csv",
]
HEADER_ALIASES = {"text": "body"}
VERSION_RANKS = {"v5": 5, "v4": 4, "v3": 3, "de_norm_50_5_2": 2, "de_norm": 1}
TARGET_LANGUAGES = ["en", "de"]

# Label mappings.
QUEUE_TOPICS = {
    "Technical Support": "Technical",
    "IT Support": "Technical",
    "IT & Technology/Security Operations": "Technical",
    "IT & Technology/Network Infrastructure": "Technical",
    "IT & Technology/Software Development": "Technical",
    "Network Infrastructure": "Technical",
    "Security Operations": "Technical",
    "Software Development": "Technical",
    "Product Support": "Technical",
    "Billing and Payments": "Billing",
    "Account & Billing Management": "Billing",
    "Returns and Exchanges": "Claims",
    "Service Outages and Maintenance": "Claims",
    "IT & Technology/Hardware Support": "Claims",
    "Health/Medical Services": "Claims",
    "Sales and Pre-Sales": "Policy",
    "Change Management": "Policy",
    "Release Management": "Policy",
}
PRIORITY_URGENCY = {
    "low": "low",
    "medium": "medium",
    "high": "high",
    "critical": "high",
    "urgent": "high",
    "normal": "medium",
    "standard": "medium",
    "very_low": "low",
}
PRIORITY_DISPLAY = ["very_low", "low", "medium", "high", "critical"]

# Routing.
ACTION_STEPS = {
    "ESCALATE": "ESCALATE_SUPERVISOR",
    "CLARIFY": "ASK_CLARIFICATION",
    "FAQ": "SEND_FAQ_LINK",
    "CLAIM": "CREATE_OR_UPDATE_CLAIM",
}
FORWARD_STEPS = {
    "Policy": "FORWARD_POLICY",
    "Claims": "FORWARD_CLAIMS",
    "Billing": "FORWARD_BILLING",
    "Technical": "FORWARD_TECHNICAL",
    "Other": "FORWARD_GENERAL",
}

# Urgency lexicon, English then German.
URGENCY_WORDS = [
    "urgent",
    "asap",
    "emergency",
    "immediately",
    "critical",
    "deadline",
    "stolen",
    "accident",
    "hospital",
    "locked out",
    "dringend",
    "sofort",
    "eilig",
    "notfall",
    "frist",
    "gestohlen",
    "unfall",
    "krankenhaus",
    "gesperrt",
    "schaden",
]
URGENT_LABEL = "urgent and critical"
CALM_LABEL = "general inquiry"

# Scoring thresholds.
TOPIC_MARGIN_THRESHOLD = 0.01
TOPIC_SCORE_THRESHOLD = 0.45
URGENCY_HIGH = 0.66
URGENCY_MEDIUM = 0.33

# The texts the topic anchors are embedded from.
TOPIC_DESCRIPTIONS = {
    "Policy": "Insurance policy and contract matters: policy details, coverage scope, contract changes, renewals, cancellations, terms and conditions, tariff changes, plan upgrades or downgrades.",
    "Claims": "Damage claims, incidents, and benefit requests: reporting damage, theft, accidents, medical incidents, requesting reimbursement for losses, claim status updates, hardware or service failures the customer wants compensated.",
    "Billing": "Payments, invoices, and account finance: invoice questions, payment failures, direct debit issues, premium adjustments, refunds for overcharges, dunning, subscription billing disputes.",
    "Technical": "Online portal, app, and account access: login failures, password resets, app errors, portal unavailability, account lockouts, technical issues with self-service tools.",
    "Other": "Off-topic or unrelated to insurance support: general inquiries, sales questions, feedback, requests outside our service scope, vague messages, or topics like fitness, hobbies, books, travel, or unrelated industries.",
}

# Texts of the deterministic fallback decision.
NO_REASONING = "No reasoning provided."
FALLBACK_REASONS = {
    "ESCALATE": "Fallback decision (LLM unavailable): high urgency triggers conservative escalation.",
    "CLAIM": "Fallback decision (LLM unavailable): topic=Claims routes to claim creation.",
    "CLARIFY": "Fallback decision (LLM unavailable): ticket did not match any specific topic.",
    "FORWARD": "Fallback decision (LLM unavailable): routing by topic.",
}
FALLBACK_QUESTIONS = [
    "Which product or service does this concern?",
    "What specifically is the issue you are facing?",
]

# Request text formats (printf style).
FIRST_TURN_FORMAT = "Ticket: %s\nTopic: %s\nUrgency: %s\nTurn: 1"
FOLLOW_UP_FORMAT = (
    "Ticket: %s\nTopic: %s\nUrgency: %s\nPrevious tool: %s returned %s\nTurn: %d"
)
COMPLETENESS_FORMAT = "Ticket: %s\nPre-classified topic: %s\nUrgency: %s"
RETRY_FORMAT = (
    "Your previous response failed validation: %s. "
    "Fix the specific issue above and respond with valid JSON of "
    'the form {"thought": "...", "tool": "...", "args": {...}}.'
)

# ---------------------------------------------------------------------------
# Table schemas
# ---------------------------------------------------------------------------
_S, _L, _I, _D, _B = (
    T.StringType(),
    T.LongType(),
    T.IntegerType(),
    T.DoubleType(),
    T.BooleanType(),
)

TICKET_COLUMNS = ["subject", "body", "language", "version", "queue", "priority", "type"]

CANONICAL = T.StructType(
    [
        T.StructField("ticket_id", _L, False),
        T.StructField("subject", _S, False),
        T.StructField("body", _S, False),
        T.StructField("language", _S, False),
        T.StructField("version", _S, False),
        T.StructField("queue", _S),
        T.StructField("priority", _S),
        T.StructField("type", _S),
    ]
)

REJECT = T.StructType(
    [
        T.StructField("file", _S),
        T.StructField("row_index", _L),
        T.StructField("error", _S),
    ]
)

PREPARED = T.StructType(
    CANONICAL.fields
    + [T.StructField("text", _S, False), T.StructField("text_length", _I, False)]
)

GROUND_TRUTH = T.StructType(
    [
        T.StructField("queue", _S),
        T.StructField("priority", _S),
        T.StructField("type", _S),
    ]
)

RESULT = T.StructType(
    [
        T.StructField("ticket_id", _L),
        T.StructField("text_snippet", _S),
        T.StructField("topic", _S),
        T.StructField("topic_margin", _D),
        T.StructField("topic_all_scores", T.MapType(_S, _D)),
        T.StructField("urgency", _S),
        T.StructField("urgency_score", _D),
        T.StructField("action", _S),
        T.StructField("next_step", _S),
        T.StructField("reasoning", _S),
        T.StructField("clarification_questions", T.ArrayType(_S)),
        T.StructField("faq_topic", _S),
        T.StructField("tools_used", T.ArrayType(_S)),
        T.StructField("runtime_seconds", _D),
        T.StructField("text_length", _I),
        T.StructField("ground_truth", GROUND_TRUTH),
    ]
)

STEP_LOG = T.StructType(
    [
        T.StructField("ticket_id", _L),
        T.StructField("turn", _I),
        T.StructField("attempt", _I),
        T.StructField("raw_json", _S),
    ]
)

HELPER_LOG = T.StructType([T.StructField("ticket_id", _L), T.StructField("raw_json", _S)])
MESSAGE = T.StructType([T.StructField("role", _S), T.StructField("content", _S)])
