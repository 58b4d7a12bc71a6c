"""Score: topic and urgency for every ticket."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.topic import anchor_matrix, cosine_scores, with_topic
from ..functions.urgency import signal_score, signals, urgency_level, urgency_score
from ..operators.decisions import with_text_figures
from ..schemas import TOPIC_DESCRIPTIONS, URGENCY_WORDS


def embed_anchors(spark, embedder, descriptions=TOPIC_DESCRIPTIONS) -> DataFrame:
    """Anchor table (topic, anchor) from the topic texts and an embedding UDF."""
    rows = F.array(
        *(
            F.struct(F.lit(t).alias("topic"), F.lit(d).alias("description"))
            for t, d in descriptions.items()
        )
    )
    texts = spark.range(1).select(F.inline(rows))
    return texts.select("topic", embedder("description").alias("anchor"))


def score_topics(
    df: DataFrame, anchors: DataFrame, vector: str = "embedding"
) -> DataFrame:
    """Replace the vector column by topic, topic_margin and topic_all_scores."""
    scores = cosine_scores(anchor_matrix(anchors))
    return with_topic(df.withColumn("topic_scores", scores(vector)).drop(vector))


def with_signals(
    df: DataFrame, lexicon: Sequence[str] = URGENCY_WORDS, text: str = "text"
) -> DataFrame:
    return df.withColumn("signals_found", signals(F.col(text), lexicon))


def with_urgency(df: DataFrame, classifier: Column) -> DataFrame:
    """Add urgency_score and urgency to rows that have signals_found."""
    score = urgency_score(signal_score(F.col("signals_found")), classifier)
    return df.withColumn("urgency_score", score).withColumn(
        "urgency", urgency_level(F.col("urgency_score"))
    )


def score_urgency(
    df: DataFrame,
    classifier: Column,
    lexicon: Sequence[str] = URGENCY_WORDS,
    text: str = "text",
) -> DataFrame:
    """Add signals_found, urgency_score and urgency; ``classifier`` is in [0, 1]."""
    return with_urgency(with_signals(df, lexicon, text), classifier)


def one_score(classifier_scores: DataFrame) -> DataFrame:
    """(ticket_id, zs_score), the highest one of tickets that have several."""
    return classifier_scores.groupBy("ticket_id").agg(F.max("zs_score").alias("zs_score"))


def one_topic(topics: DataFrame) -> DataFrame:
    """The topic columns by ticket_id, the clearest ones of tickets that have several vectors.

    Equal margins go by the topic's name.
    """
    cells = ["topic", "topic_margin", "topic_all_scores"]
    best = F.max_by(F.struct(*cells), F.struct("topic_margin", "topic"))
    return topics.groupBy("ticket_id").agg(best.alias("_t")).select(
        "ticket_id", *(F.col("_t")[c].alias(c) for c in cells)
    )


def score(
    tickets: DataFrame,
    vectors: DataFrame,
    anchors: DataFrame,
    classifier_scores: DataFrame,
    lexicon: Sequence[str] = URGENCY_WORDS,
    keep_text: bool = False,
) -> DataFrame:
    """Prepared tickets with topic and urgency.

    ``vectors`` is (ticket_id, embedding), ``classifier_scores`` (ticket_id,
    zs_score). Tickets without a vector count as Other, those without a classifier
    score go by their keywords. Several vectors or scores of a ticket are folded
    to one, so tickets are never multiplied. All that depends on the text is
    computed before the joins; unless ``keep_text`` is set, only text_snippet and
    text_length go through them. Each input is shuffled once, by ticket_id, and
    the decide job's joins use the same partitioning.
    """
    own = with_signals(tickets, lexicon)
    if not keep_text:
        own = with_text_figures(own)
    topics = score_topics(vectors.select("ticket_id", "embedding"), anchors)
    joined = own.join(one_score(classifier_scores), "ticket_id", "left").join(
        one_topic(topics), "ticket_id", "left"
    )
    topic = F.coalesce("topic", F.lit("Other"))
    return with_urgency(joined.withColumn("topic", topic), F.col("zs_score")).drop(
        "zs_score"
    )
