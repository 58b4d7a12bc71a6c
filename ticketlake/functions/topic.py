"""Topic by cosine similarity between a ticket's vector and five anchors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import TOPIC_MARGIN_THRESHOLD, TOPIC_SCORE_THRESHOLD, TOPICS

_TINY = 1e-12  # floor for a vector's norm, so a zero vector scores 0


def anchor_matrix(anchors: DataFrame) -> np.ndarray:
    """The anchor table (topic, anchor) as unit rows in topic order.

    The table holds one row per topic; anything else is an error, so what is
    fetched here is bounded by the enumeration.
    """
    rows = anchors.select("topic", "anchor").limit(len(TOPICS) + 1).collect()
    by_topic = {r.topic: r.anchor for r in rows}
    if len(rows) != len(TOPICS) or set(by_topic) != set(TOPICS):
        raise ValueError(f"anchors must cover exactly {TOPICS}, got {sorted(by_topic)}")
    matrix = np.asarray([by_topic[t] for t in TOPICS], dtype=np.float64)
    return matrix / np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), _TINY)


def cosine_scores(matrix: np.ndarray):
    """Arrow UDF: vector -> its similarity to each anchor, in topic order."""
    n_topics, dim = matrix.shape

    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def scores(vectors: pa.Array) -> pa.Array:
        known = vectors.drop_null()
        flat = known.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        if len(flat) != len(known) * dim or not all(
            n in (None, dim) for n in vectors.value_lengths().unique().to_pylist()
        ):
            raise ValueError(f"embedding length differs from the anchors' {dim}")
        if not np.isfinite(flat).all():
            raise ValueError("embedding holds a null, NaN or infinite component")
        block = flat.reshape(len(known), dim)
        norms = np.maximum(np.linalg.norm(block, axis=1, keepdims=True), _TINY)
        sims = pa.array(((block / norms) @ matrix.T).ravel())
        # one offset per row; a null offset marks a null row
        valid = vectors.is_valid().to_numpy(zero_copy_only=False)
        ends = np.concatenate([[0], np.cumsum(valid)]) * n_topics
        gaps = np.concatenate([~valid, [False]])
        offsets = pa.array(ends.astype(np.int32), mask=gaps)
        return pa.ListArray.from_arrays(offsets, sims)

    return scores


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two array columns in built-in expressions, to check the UDF against."""
    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(
            F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")),
            F.lit(0.0),
            lambda acc, v: acc + v,
        )

    return dot(a, b) / F.greatest(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(_TINY))


def ranked_topics(scores: Column) -> Column:
    """Array of (neg, ord, topic, score): best first, ties in declared order."""
    return F.array_sort(
        F.array(
            *(
                F.struct(
                    (-scores[i]).alias("neg"),
                    F.lit(i).alias("ord"),
                    F.lit(t).alias("topic"),
                    scores[i].alias("score"),
                )
                for i, t in enumerate(TOPICS)
            )
        )
    )


def margin(ranked: Column) -> Column:
    return ranked[0]["score"] - ranked[1]["score"]


def decided_topic(ranked: Column) -> Column:
    """The best topic, or Other when neither its lead nor its score convinces.

    Without scores, because there is no vector, it is Other as well.
    """
    unsure = (margin(ranked) < TOPIC_MARGIN_THRESHOLD) & (
        ranked[0]["score"] < TOPIC_SCORE_THRESHOLD
    )
    return F.when(unsure | margin(ranked).isNull(), "Other").otherwise(ranked[0]["topic"])


def all_scores(ranked: Column) -> Column:
    """topic -> score; null without scores."""
    return F.when(
        margin(ranked).isNotNull(),
        F.map_from_entries(F.transform(ranked, lambda r: F.struct(r["topic"], r["score"]))),
    )


def top_scores_text(ranked: Column, k: int = 3) -> Column:
    return F.array_join(
        F.transform(
            F.slice(ranked, 1, k),
            lambda r: F.format_string("%s=%.2f", r["topic"], r["score"]),
        ),
        ", ",
    )


def margin_label(value: Column) -> Column:
    """Null without a margin."""
    return F.when(value < TOPIC_MARGIN_THRESHOLD, "weak separation").when(
        value.isNotNull(), "confident"
    )


def with_topic(df: DataFrame, scores: str = "topic_scores") -> DataFrame:
    """Replace the score array by topic, topic_margin and topic_all_scores."""
    ranked = df.withColumn("_ranked", ranked_topics(F.col(scores)))
    return ranked.select(
        *(c for c in df.columns if c != scores),
        decided_topic(F.col("_ranked")).alias("topic"),
        margin(F.col("_ranked")).alias("topic_margin"),
        all_scores(F.col("_ranked")).alias("topic_all_scores"),
    )
