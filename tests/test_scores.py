import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ticketlake.functions import scorers, topic, urgency
from ticketlake.plans.score import embed_anchors, score, score_topics, score_urgency
from ticketlake.schemas import TOPICS, URGENCY_WORDS


def _signals(spark, texts, lexicon=URGENCY_WORDS):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    found = urgency.signals(F.col("t"), lexicon)
    rows = df.select("i", found.alias("f"), urgency.signal_score(found).alias("s")).orderBy("i").collect()
    return [(r.f, r.s) for r in rows]


def test_signals_follow_the_lexicon(spark):
    got = _signals(spark, [
        "Please send me my invoice for May.",
        "Mein Auto wurde gestohlen, brauche sofort Hilfe!",
        "URGENT: my account is locked out and I need access ASAP.",
        "urgent emergency critical asap immediately deadline stolen accident hospital",
        "URGENT",
        "Wasserschaden und urgently, äfrist frist_x",
        "urgent urgent urgent",
    ])
    assert got == [
        ([], 0.0),
        (["sofort", "gestohlen"], 1.0),
        (["urgent", "asap", "locked out"], 1.0),
        (["urgent", "asap", "emergency", "immediately", "critical", "deadline", "stolen", "accident", "hospital"], 1.0),
        (["urgent"], 0.5),
        ([], 0.0),
        (["urgent"], 0.5),
    ]


def test_overlapping_entries_are_all_found(spark):
    lexicon = ["locked", "locked out", "out of order", "asap"]
    assert urgency.split_lexicon(lexicon) == (["asap"], ["locked", "locked out", "out of order"])
    assert urgency.split_lexicon(URGENCY_WORDS) == (URGENCY_WORDS, [])
    got = _signals(spark, ["locked out of order asap", "just locked"], lexicon)
    assert [g[0] for g in got] == [lexicon, ["locked"]]


def test_level_thresholds(spark):
    df = spark.createDataFrame(
        [("none", 1.0), ("urgent", 0.81), ("urgent", 0.83), ("urgent asap", 0.31), ("urgent asap", 0.32), ("none", 0.65), ("none", 0.66)],
        "text string, zs double",
    )
    got = [(r.urgency_score, r.urgency) for r in score_urgency(df, F.col("zs")).collect()]
    assert [g[1] for g in got] == ["medium", "medium", "high", "medium", "high", "low", "medium"]
    assert got[0][0] == 0.5


def _vectors(spark, vectors):
    return spark.createDataFrame(
        [(i, None if v is None else [float(x) for x in v]) for i, v in enumerate(vectors)],
        "ticket_id long, embedding array<float>",
    )


def _anchors(spark, vectors):
    return spark.createDataFrame([(t, [float(x) for x in v]) for t, v in zip(TOPICS, vectors)], "topic string, anchor array<float>")


def test_scores_match_numpy_and_the_builtin_form(spark):
    rng = random.Random(1)
    vecs = [[rng.uniform(-1, 1) for _ in range(8)] for _ in range(60)]
    anchors = [[rng.uniform(-1, 1) for _ in range(8)] for _ in TOPICS]
    a = _anchors(spark, anchors)
    udf = topic.cosine_scores(topic.anchor_matrix(a))
    df = _vectors(spark, vecs)
    got = np.array([r[0] for r in df.select(udf("embedding")).collect()])
    v, m = np.float32(vecs).astype(float), np.float32(anchors).astype(float)
    want = (v / np.linalg.norm(v, axis=1, keepdims=True)) @ (m / np.linalg.norm(m, axis=1, keepdims=True)).T
    assert np.allclose(got, want)
    lits = [F.array(*(F.lit(float(np.float32(x))) for x in an)) for an in anchors]
    native = np.array([list(r) for r in df.select(*(topic.cosine(F.col("embedding"), x) for x in lits)).collect()])
    assert np.allclose(native, want)


def test_rank_margin_ties_and_fallback(spark):
    eye = np.eye(5)
    vectors = [
        [1, 0, 0, 0, 0],
        [1, 1, 0, 0, 0],  # tie, high score: declared order decides
        [1, 1, 1, 1, 1],  # tie at 0.447: neither lead nor score
        [0, 0, 0, 0, 0],
        None,
    ]
    rows = score_topics(_vectors(spark, vectors), _anchors(spark, eye)).orderBy("ticket_id").collect()
    assert [r.topic for r in rows] == ["Policy", "Policy", "Other", "Other", "Other"]
    assert rows[0].topic_margin == 1.0 and rows[1].topic_margin == pytest.approx(0.0)
    assert rows[0].topic_all_scores == {"Policy": 1.0, "Claims": 0, "Billing": 0, "Technical": 0, "Other": 0}
    assert rows[4].topic_margin is None and rows[4].topic_all_scores is None


def test_display_text(spark):
    df = spark.createDataFrame([([0.1, 0.5, 0.3, 0.2, 0.4],)], "s array<double>")
    ranked = topic.ranked_topics(F.col("s"))
    (r,) = df.select(topic.top_scores_text(ranked), topic.margin_label(topic.margin(ranked)), topic.margin_label(F.lit(0.001))).collect()
    assert tuple(r) == ("Claims=0.50, Other=0.40, Billing=0.30", "confident", "weak separation")


def test_anchors_must_cover_the_topics(spark):
    with pytest.raises(ValueError):
        topic.anchor_matrix(_anchors(spark, np.eye(5)).where("topic <> 'Other'"))


def test_wrong_vector_length_is_an_error(spark):
    df = score_topics(_vectors(spark, [[1, 0, 0]]), _anchors(spark, np.eye(5)))
    with pytest.raises(Exception, match="embedding length"):
        df.collect()


@pytest.mark.parametrize("bad", [float("nan"), float("inf")])
def test_non_finite_vector_is_an_error(spark, bad):
    df = score_topics(_vectors(spark, [[1, 0, 0, bad, 0]]), _anchors(spark, np.eye(5)))
    with pytest.raises(Exception, match="embedding holds"):
        df.collect()


def test_missing_and_repeated_inputs(spark):
    tickets = spark.createDataFrame([(i, "urgent asap" if i == 3 else "calm") for i in range(1, 5)], "ticket_id long, text string")
    eye = np.eye(5)
    vectors = _vectors(spark, [None, eye[1], eye[2]]).unionByName(_vectors(spark, [None, None, [0, 1, 1, 0, 0]]))
    scores = spark.createDataFrame([(1, 0.2), (1, 0.9), (2, 0.4)], "ticket_id long, zs_score double")
    got = score(tickets, vectors, _anchors(spark, eye), scores).orderBy("ticket_id").collect()
    assert [(r.ticket_id, r.topic, r.urgency_score, r.urgency) for r in got] == [
        (1, "Claims", 0.45, "medium"), (2, "Billing", 0.2, "low"), (3, "Other", 1.0, "high"), (4, "Other", 0.0, "low")]


def test_scorers_apply_the_model_per_batch(spark):
    # factories are local, so that they travel by value and not by module name
    def load_vectors():
        return lambda texts: [[float(len(t)), 1.0] for t in texts]

    def load_lengths():
        return lambda texts: [len(t) / 10 for t in texts]

    df = spark.createDataFrame([("a",), (None,), ("ccc",)], "t string").coalesce(1)
    embed = scorers.text_embedder("test-embed", load_vectors)
    assert [r[0] for r in df.select(embed("t")).collect()] == [[1.0, 1.0], None, [3.0, 1.0]]
    anchors = embed_anchors(spark, embed)
    assert [r.topic for r in anchors.collect()] == TOPICS
    prob = scorers.scorer("test-prob", load_lengths, T.DoubleType())
    assert [r[0] for r in df.select(prob("t")).collect()] == [0.1, None, 0.3]


def test_a_model_is_loaded_once_per_worker():
    loads = []

    def factory():
        loads.append(1)
        return len

    assert scorers._model("once", factory) is scorers._model("once", factory)
    assert loads == [1]
