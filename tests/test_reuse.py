"""Scores per distinct text: how often the model is called, and that the rows get the right ones."""

import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ticketlake.functions.scorers import text_classifier, text_embedder
from ticketlake import jobs
from ticketlake.operators import reuse

ROWS = [(1, "a"), (2, "bb"), (3, "a"), (4, None), (5, ""), (6, "a"), (7, "bb"), (7, "dddd"), (8, "é" * 9), (None, "a")]
LENGTHS = sorted(((i, None if t is None else len(t) / 10) for i, t in ROWS), key=str)


class Calls:
    """Texts a model was called with, noted by its workers in a local file."""

    def __init__(self, path):
        self.path = str(path)

    @property
    def value(self):
        return sum(1 for _ in open(self.path)) if os.path.exists(self.path) else 0


def counted(folder, name):
    """A classifier that notes each text it is called with."""
    calls = Calls(folder / f"{name}.calls")
    path = calls.path

    def load():
        def model(texts):
            with open(path, "a") as f:
                f.write("call\n" * len(texts))
            return [len(t) / 10 for t in texts]

        return model

    return text_classifier(path, load), calls


def pairs(frame):
    return sorted(((r["ticket_id"], r["score"]) for r in frame.collect()), key=str)


@pytest.mark.parametrize("hot", [reuse.HOT, 1])
def test_each_distinct_text_is_scored_once(spark, tmp_path, hot):
    model, calls = counted(tmp_path, "once")
    rows = spark.createDataFrame(ROWS, "ticket_id long, text string").repartition(4)
    got = reuse.score_texts(rows, model, T.DoubleType(), hot=hot)
    assert pairs(got) == LENGTHS and pairs(got) == LENGTHS
    assert calls.value == len({t for _, t in ROWS if t is not None})


def test_a_store_answers_for_known_texts(spark, tmp_path):
    model, calls = counted(tmp_path, "stored")
    store = lambda name="m1": reuse.ScoreStore(spark, str(tmp_path / "store"), name, T.DoubleType())
    rows = spark.createDataFrame(ROWS, "ticket_id long, text string")
    some = rows.where("ticket_id < 4")
    reuse.score_texts(some, model, T.DoubleType(), store()).count()
    assert calls.value == 2
    assert pairs(reuse.score_texts(rows, model, T.DoubleType(), store())) == LENGTHS
    assert calls.value == 5
    assert pairs(reuse.score_texts(rows, model, T.DoubleType(), store())) == LENGTHS
    assert calls.value == 5
    assert store().read().count() == 5
    # another model's scores are its own
    assert pairs(reuse.score_texts(some, model, T.DoubleType(), store("m2"))) == [r for r in LENGTHS if r[0] in (1, 2, 3)]
    assert calls.value == 7


def test_vectors_and_empty_tables(spark, tmp_path):
    embed = text_embedder("reused-vectors", lambda: lambda texts: [[float(len(t)), 1.0] for t in texts])
    kind = T.ArrayType(T.FloatType())
    rows = spark.createDataFrame(ROWS, "ticket_id long, text string")
    store = reuse.ScoreStore(spark, str(tmp_path), "vectors", kind)
    for _ in range(2):
        got = reuse.score_texts(rows, embed, kind, store, score_col="embedding")
        assert got.columns == ["ticket_id", "embedding"]
        assert {tuple(r["embedding"]) for r in got.where("ticket_id IN (1, 3, 6)").collect()} == {(1.0, 1.0)}
    assert reuse.score_texts(rows.limit(0), embed, kind, store).count() == 0


def test_texts_stay_out_of_the_join(spark, tmp_path):
    model, _ = counted(tmp_path, "plan")
    rows = spark.createDataFrame(ROWS, "ticket_id long, text string")
    plan = reuse.score_texts(rows, model, T.DoubleType())._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" not in plan  # scored before, and stored


def test_digest(spark):
    got = spark.createDataFrame([("a",), (None,)], "t string").select(F.length(reuse.text_digest(F.col("t"))).alias("n"))
    assert [r["n"] for r in got.collect()] == [16, None]


def test_job(spark, tmp_path):
    rows = [(1, "a b"), (2, "a b"), (3, "c")]
    sample = str(tmp_path / "sample")
    spark.createDataFrame(rows, "ticket_id long, text string").write.parquet(sample)
    args = ["score-texts", "--sample", sample, "--model", "ticketlake.registry.queries:_load_toy_model", "--store", str(tmp_path / "store"), "--out", str(tmp_path / "out")]
    for _ in range(2):
        jobs.main(args)
        got = spark.read.parquet(str(tmp_path / "out")).collect()
        assert sorted((r["ticket_id"], r["zs_score"]) for r in got) == [(1, 0.03), (2, 0.03), (3, 0.01)]
    assert sum(1 for _ in (tmp_path / "store").glob("model=*/run=*")) == 2
