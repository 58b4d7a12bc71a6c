"""Inputs the test tables do not hold: texts in several chunks, tiny sources, clashing columns."""

import random
import time

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline
from ticketlake.llm import mixing, token_count

MODEL = public_tokenizers.path("piece_bpe_32k.model")
SP = sentencepiece.SentencePieceProcessor(model_file=MODEL)


@pytest.mark.parametrize("size", [1, 3, 7, 50, 1000])
def test_token_counts_of_texts_in_chunks(spark, monkeypatch, size):
    monkeypatch.setattr(token_count, "LONG", size)
    rng = random.Random(size)
    parts = ["information", " the", " ", "  ", "\n", "é", "日本", "▁", "==", "😀", "internationalisation", "x" * 40, " a", "1234567"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 12 if size < 9 else 60))) for _ in range(40)]
    texts += ["information" * 30, "a b " * 50, texts[0], texts[0]]
    rows = [(i % 41, t) for i, t in enumerate(texts)]  # ids that repeat, with equal and with other texts
    got = token_count.count_tokens(spark.createDataFrame(rows, "doc_id long, text string"), MODEL).collect()
    want = sorted((i, len(t.encode()), len(SP.encode(t))) for i, t in rows)
    assert sorted((r["doc_id"], r["n_bytes"], r["n_tokens"]) for r in got) == want


def test_a_torn_word_at_the_end_of_a_long_text(spark):
    text = ("some words of a text " * 60_000)[: token_count.LONG - 9] + " information and more"
    got = token_count.count_tokens(spark.createDataFrame([(1, text)], "doc_id long, text string"), MODEL).first()
    assert len(text.encode()) > token_count.LONG
    assert got["n_tokens"] == len(SP.encode(text))


def test_texts_without_spaces_take_linear_time():
    own = token_count.counter(open(MODEL, "rb").read())
    rng = random.Random(4)
    text = "".join(rng.choice("abcdefghij") for _ in range(400_000))

    def timed(n):
        chunks = [own.chunk(text[i : i + 1000]) for i in range(0, n, 1000)]
        start = time.process_time()
        own.total(own.join(chunks))
        return time.process_time() - start

    timed(400_000)  # states are made
    short, long = timed(100_000), timed(400_000)
    assert long < 8 * short + 0.05


def test_small_sources_beside_a_large_one(spark):
    words = lambda n: " ".join(["w"] * n)
    rows = [(i, words(500), "big") for i in range(2000)] + [(9001, words(1), "a"), (9002, words(30), "c"), (9003, words(29), None), (9004, words(1), None), (9005, None, "none")]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    for source in ("big", "a", "c", None):
        own = [r for r in got if r["source"] == source]
        taken, target = sum(r["taken"] for r in own), own[0]["target"]
        assert abs(taken - target) <= 1, source
        assert all(r["taken"] <= 2 * r["size"] for r in own)
    assert sum(r["taken"] for r in got if r["source"] == "a") == 2


def test_schedule_gives_each_block_once(spark):
    sizes = [("a", 100_000), ("b", 7), ("c", 3_000), (None, 1)]
    sized = spark.createDataFrame([(i, s, n) for i, (s, n) in enumerate(sizes)], "doc_id long, source string, size long")
    sources = mixing.targets(sized)
    slots = mixing.schedule(sources).collect()
    wanted = {r["src"]: -(-r["target"] // mixing.BLOCK) for r in sources.collect()}
    for src, blocks in wanted.items():
        own = sorted(r["block"] for r in slots if r["src"] == src)
        assert own == list(range(len(own))) and blocks <= len(own) <= blocks + 3


CLASHING = ("__score", "__spans", "__likely", "__bit", "__bucket", "__items", "__n_words", "__byte", "others", "one", "component_id", "kept", "label", "size")


def test_stages_leave_clashing_columns_alone(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name in CLASHING:
        docs = docs.withColumn(name, F.concat(F.lit(name), F.col("doc_id").cast("string")))
    plain = spark.read.parquet(f"{sf}/documents.parquet")
    for _, apply in corpus_pipeline.STAGES[:-1]:
        docs, plain = apply(spark, docs, sf).cache(), apply(spark, plain, sf).cache()
        assert docs.columns[-len(CLASHING) :] == list(CLASHING)
        assert docs.select(plain.columns).exceptAll(plain).count() == 0 and docs.count() == plain.count()
        for name in CLASHING:
            assert docs.where(F.col(name) != F.concat(F.lit(name), F.col("doc_id").cast("string"))).count() == 0


def test_rows_that_share_an_id_but_not_the_text(spark):
    rows = [(1, "one two three four five six", "a"), (1, "quite another text stands here now", "b"), (2, "", "c"), (2, "", "c"), (None, "x", "d"), (None, "x", "d")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    sf = "/root/testdata/sf0.001"
    runs = {tuple(sorted(map(repr, corpus_pipeline.drop_near_duplicates(spark, frame.repartition(n), sf).collect()))) for n in (1, 2, 5)}
    assert len(runs) == 1 and len(next(iter(runs))) == 4
