"""Profile: statistics of a prepared sample and coverage of the label mappings.

Every report takes prepared tickets, or the same folded by ``fold``; the job folds
once and makes all reports but the ticket list from that.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.labels import has_explicit_topic, priority_urgency, queue_topic
from ..functions.text import sample_label
from ..operators.canonical import with_text_length
from ..operators.quantiles import (
    bounded_quantiles,
    histogram,
    value_weights,
    weighted_quantiles,
)
from ..operators.tables import (
    dense_distribution,
    distribution,
    percent,
    top_values,
    value_counts,
)
from ..schemas import PRIORITY_DISPLAY, TOPICS, URGENCY_DISPLAY
from ..storage import stage


def _position(values: Sequence[str], col: str):
    """1-based place in the list, 0 for other values."""
    return F.array_position(F.array(*(F.lit(v) for v in values)), F.col(col))


KEYS = ["language", "version", "queue", "priority", "type", "text_length"]


def fold(df: DataFrame) -> DataFrame:
    """One row per combination of KEYS with ``_n``, the tickets it stands for.

    All keys are from short lists but queue, and lengths are capped.
    """
    return with_text_length(df).groupBy(*KEYS).agg(F.count("*").alias("_n"))


def _weight(df: DataFrame) -> str | None:
    return "_n" if "_n" in df.columns else None


def _counts(df: DataFrame, col: str) -> DataFrame:
    return value_counts(df, col, _weight(df))


def _kept(df: DataFrame, *cols) -> DataFrame:
    """Some columns, and the weight where there is one."""
    return df.select(*cols, *([_weight(df)] if _weight(df) else []))


# --- label inspection --------------------------------------------------------


def priority_inspection(df: DataFrame) -> DataFrame:
    """Every priority value, null included: tickets and what it maps to."""
    counts = _counts(df, "priority")
    mapped = F.when(F.col("priority").isNull(), "(missing)").otherwise(
        F.coalesce(priority_urgency(F.col("priority")), F.lit("UNMAPPED"))
    )
    return counts.withColumn("mapped", mapped).orderBy(F.desc("n"), "priority")


def urgency_shares(df: DataFrame) -> DataFrame:
    """Tickets per mapped urgency, over mapped priorities only."""
    counted = _kept(df, priority_urgency(F.col("priority")).alias("urgency"))
    return dense_distribution(counted, "urgency", URGENCY_DISPLAY, _weight(df))


def unmapped_priorities(df: DataFrame) -> DataFrame:
    counts = _counts(df.where(F.col("priority").isNotNull()), "priority")
    return counts.where(priority_urgency(F.col("priority")).isNull()).orderBy(
        F.desc("n"), "priority"
    )


def queue_inspection(df: DataFrame) -> DataFrame:
    """Queues under their mapped topic, with subtotals per topic.

    Rows with is_subtotal = 1 hold a topic's tickets and number of queues;
    is_default marks queues that only fall through to Other.
    """
    queues = (
        _counts(df.where(F.col("queue").isNotNull()), "queue")
        .withColumn("mapped_topic", queue_topic(F.col("queue")))
        .withColumn(
            "is_default", (~has_explicit_topic(F.col("queue"))).cast("int")
        )
    )
    rolled = queues.rollup("mapped_topic", "queue").agg(
        F.grouping("mapped_topic").alias("_all"),
        F.grouping("queue").cast("int").alias("is_subtotal"),
        F.sum("n").alias("n"),
        F.count("*").alias("n_queues"),
        F.max("is_default").alias("is_default"),
    )
    return (
        rolled.where("_all = 0")
        .withColumn("is_default", F.when(F.col("is_subtotal") == 0, F.col("is_default")))
        .drop("_all")
        .orderBy(
            _position(TOPICS, "mapped_topic"), F.desc("is_subtotal"), F.desc("n"), "queue"
        )
    )


def topic_shares(df: DataFrame) -> DataFrame:
    """Tickets per mapped topic in fixed order, 0 where none."""
    counted = _kept(df, queue_topic(F.col("queue")).alias("mapped_topic"))
    return dense_distribution(counted, "mapped_topic", TOPICS, _weight(df))


def unmapped_queues(df: DataFrame, k: int = 10) -> DataFrame:
    """Queues falling to Other by default: the k largest, and how many more."""
    unmapped = df.where(
        F.col("queue").isNotNull() & ~has_explicit_topic(F.col("queue"))
    )
    return top_values(unmapped, "queue", k, _weight(df)).drop("pct")


# --- dataset statistics ------------------------------------------------------


def kpis(df: DataFrame) -> DataFrame:
    """Rows and distinct labels, nulls not counted.

    Rows fold to label combinations first, so the distinct counts do not
    multiply the table.
    """
    n = F.sum("_n") if _weight(df) else F.count("*")
    combos = df.groupBy("language", "queue", "priority", "type").agg(n.alias("n"))
    return combos.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n"),
        F.count_distinct("language").alias("n_languages"),
        F.count_distinct("queue").alias("n_queues"),
        F.count_distinct("priority").alias("n_priorities"),
        F.count_distinct("type").alias("n_types"),
    )


def languages(df: DataFrame) -> DataFrame:
    return df.select("language").where("language is not null").distinct().orderBy("language")


def language_distribution(df: DataFrame) -> DataFrame:
    known = df.where(F.col("language").isNotNull())
    return distribution(known, "language", _weight(df)).orderBy(F.desc("n"), "language")


def priority_distribution(df: DataFrame) -> DataFrame:
    """Known levels in their order, then other values by count; ``ord`` numbers them."""
    counts = _counts(df.where(F.col("priority").isNotNull()), "priority")
    place = F.nullif(_position(PRIORITY_DISPLAY, "priority"), F.lit(0))
    return counts.withColumn("known_ord", place.cast("int")).orderBy(
        F.asc_nulls_last("known_ord"), F.desc("n"), "priority"
    )


def top_queues(df: DataFrame, k: int = 20) -> DataFrame:
    return top_values(df, "queue", k, _weight(df))


def mapping_coverage(df: DataFrame) -> DataFrame:
    """Tickets per mapped topic with the number of queues and of explicit ones."""
    queues = _counts(df.where(F.col("queue").isNotNull()), "queue").withColumn(
        "mapped_topic", queue_topic(F.col("queue"))
    )
    topics = queues.groupBy("mapped_topic").agg(
        F.sum("n").alias("n"),
        F.count("*").alias("n_queues"),
        F.count_if(has_explicit_topic(F.col("queue"))).alias("n_explicit"),
    )
    total = queues.agg(F.sum("n")).scalar()
    return topics.withColumn("pct", percent(F.col("n"), total)).orderBy(
        F.desc("n"), "mapped_topic"
    )


def queue_coverage(df: DataFrame) -> DataFrame:
    """Distinct queues, and how many of them have a mapping of their own."""
    queues = df.where(F.col("queue").isNotNull()).select("queue").distinct()
    return queues.agg(
        F.count("*").alias("n_queues"),
        F.count_if(has_explicit_topic(F.col("queue"))).alias("n_explicit"),
    )


def length_histogram(df: DataFrame, bins: int = 40) -> DataFrame:
    folded = value_weights(with_text_length(df), "text_length", weight=_weight(df))
    return histogram(folded, "text_length", bins, weight="_n")


def length_box(df: DataFrame) -> DataFrame:
    """Box statistics of the text length per language."""
    q = bounded_quantiles(
        with_text_length(df),
        "text_length",
        [0.0, 0.25, 0.5, 0.75, 1.0],
        ["language"],
        _weight(df),
    )
    names = ["min", "q1", "median", "q3", "max"]
    return q.select("language", *(F.col("q")[i].alias(n) for i, n in enumerate(names)))


def length_summary(df: DataFrame) -> DataFrame:
    """Rows, mean and quantiles of the text length."""
    folded = value_weights(with_text_length(df), "text_length", weight=_weight(df))
    probs = {"min": 0.0, "p25": 0.25, "median": 0.5, "p75": 0.75, "p95": 0.95, "max": 1.0}
    n, total = F.sum("_n"), F.sum(F.col("text_length") * F.col("_n"))
    return folded.agg(
        F.coalesce(n, F.lit(0)).alias("n"),
        (total / n).alias("mean"),
        weighted_quantiles("text_length", list(probs.values())).alias("q"),
    ).select("n", "mean", *(F.col("q")[i].alias(p) for i, p in enumerate(probs)))


def type_distribution(df: DataFrame) -> DataFrame:
    known = df.where(F.col("type").isNotNull())
    return distribution(known, "type", _weight(df)).orderBy(F.desc("n"), "type")


def version_distribution(df: DataFrame) -> DataFrame:
    return distribution(df, "version", _weight(df)).orderBy(F.desc("n"), "version")


def sample_browser(df: DataFrame, n: int = 50) -> DataFrame:
    """The first n tickets by id with their list labels."""
    return (
        df.orderBy("ticket_id")
        .limit(n)
        .select(
            "ticket_id", sample_label(F.col("ticket_id"), F.col("subject")).alias("label")
        )
    )


REPORTS = {
    "priority_inspection": priority_inspection,
    "urgency_shares": urgency_shares,
    "unmapped_priorities": unmapped_priorities,
    "queue_inspection": queue_inspection,
    "topic_shares": topic_shares,
    "unmapped_queues": unmapped_queues,
    "kpis": kpis,
    "languages": languages,
    "language_distribution": language_distribution,
    "priority_distribution": priority_distribution,
    "top_queues": top_queues,
    "mapping_coverage": mapping_coverage,
    "queue_coverage": queue_coverage,
    "length_histogram": length_histogram,
    "length_box": length_box,
    "length_summary": length_summary,
    "type_distribution": type_distribution,
    "version_distribution": version_distribution,
    "sample_browser": sample_browser,
}


def profile(
    df: DataFrame, only_languages: Sequence[str] | None = None
) -> dict[str, DataFrame]:
    """All statistics of a prepared sample, or of its tickets in some languages.

    The sample is read twice: to fold it, and for the list of tickets.
    """
    if only_languages is not None:
        df = df.where(F.col("language").isin(list(only_languages)))
    folded = stage(fold(df), "profile")
    made = {name: make(folded) for name, make in REPORTS.items() if name != "sample_browser"}
    return {**made, "sample_browser": sample_browser(df)}
