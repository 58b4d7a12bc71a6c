import pytest
from pyspark.sql import functions as F

from ticketlake import schemas as sc
from ticketlake.functions import labels


def _map(spark, fn, values):
    df = spark.createDataFrame(list(enumerate(values)), "i int, v string")
    return [r[0] for r in df.orderBy("i").select(fn(F.col("v"))).collect()]


def test_queues(spark):
    queues = {
        "Technical Support": "Technical",
        "IT Support": "Technical",
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
        "Customer Service": "Other",
        "Home & Garden/Landscaping": "Other",
        "it support": "Other",
        " IT Support": "Other",
        "": "Other",
        None: None,
    }
    assert _map(spark, labels.queue_topic, queues) == list(queues.values())


def test_priorities(spark):
    priorities = {
        "low": "low", "medium": "medium", "high": "high", "LOW": "low", " High\n": "high",
        "critical": "high", "urgent": "high", "normal": "medium", "standard": "medium",
        "very_low": "low", "weird-value": None, "": None, None: None,
    }
    assert _map(spark, labels.priority_urgency, priorities) == list(priorities.values())


def test_ordinals_and_version_ranks(spark):
    assert _map(spark, labels.urgency_ordinal, ["low", "medium", "high", None, "x"]) == [0, 1, 2, None, None]
    assert _map(spark, labels.version_rank, ["v5", "v4", "v3", "de_norm_50_5_2", "de_norm", "v9", None]) == [5, 4, 3, 2, 1, 0, 0]


@pytest.mark.parametrize("action,step", [
    ("ESCALATE", "ESCALATE_SUPERVISOR"), ("CLARIFY", "ASK_CLARIFICATION"),
    ("FAQ", "SEND_FAQ_LINK"), ("CLAIM", "CREATE_OR_UPDATE_CLAIM"),
])
def test_actions_with_one_step_ignore_the_topic(spark, action, step):
    assert _map(spark, lambda t: labels.next_step(F.lit(action), t), sc.TOPICS) == [step] * 5


def test_forward_goes_by_topic(spark):
    got = _map(spark, lambda t: labels.next_step(F.lit("FORWARD"), t), sc.TOPICS)
    assert got == ["FORWARD_POLICY", "FORWARD_CLAIMS", "FORWARD_BILLING", "FORWARD_TECHNICAL", "FORWARD_GENERAL"]


def test_tables_cover_their_enumerations():
    assert set(sc.FORWARD_STEPS) == set(sc.TOPICS) == set(sc.TOPIC_DESCRIPTIONS)
    assert set(sc.ACTION_STEPS) | {"FORWARD"} == set(sc.ACTIONS) == set(sc.FALLBACK_REASONS) | {"FAQ"}
    assert set(sc.QUEUE_TOPICS.values()) <= set(sc.TOPICS)
    assert set(sc.PRIORITY_URGENCY.values()) == set(sc.URGENCY_LEVELS) == set(sc.URGENCY_DISPLAY)
    assert {t.upper() for t in sc.TERMINAL_TOOLS} == set(sc.ACTIONS)
    assert set(sc.FILE_VERSIONS.values()) == set(sc.VERSION_RANKS)
