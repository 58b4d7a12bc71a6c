"""Large lexicons: lookups of word runs against one search per entry."""

import random
import re
import time

from pyspark.sql import functions as F

from ticketlake.functions import urgency as ur

WORDS = ["locked", "out", "of", "my", "account", "now", "é", "straße", "a1", "x_y", "asap"]


def _text(rng, n):
    return "".join(rng.choice(WORDS + ["Locked", "OUT"]) + rng.choice([" ", " ", " ", "  ", ", ", "-", "\n", ""]) for _ in range(n))


def _entries(rng, n):
    out = {}
    while len(out) < n:
        k = rng.randint(1, 4)
        out["".join(rng.choice(WORDS) + (rng.choice([" ", " ", "-"]) if i < k - 1 else "") for i in range(k))] = None
    return list(out)


def _searched(text, lexicon):
    return [e for e in lexicon if re.search(rf"(?<!\w){re.escape(e)}(?!\w)", text.lower())]


def test_2000_overlapping_entries_equal_one_search_each(spark):
    rng = random.Random(12)
    lexicon = _entries(rng, 2000)
    texts = [_text(rng, rng.randint(0, 60)) for _ in range(60)] + ["", None]
    frame = spark.createDataFrame(list(enumerate(texts)), "ticket_id long, text string")
    got = {r["ticket_id"]: r["s"] for r in frame.select("ticket_id", ur.signals(F.col("text"), lexicon).alias("s")).collect()}
    for i, t in enumerate(texts):
        assert got[i] == (None if t is None else _searched(t, lexicon))
    table = spark.createDataFrame([(e, i) for i, e in enumerate(lexicon)] + [(lexicon[0], 5000)], "entry string, ord long")
    found = {r["ticket_id"]: r["signals_found"] for r in ur.table_signals(frame, table, 4).collect()}
    assert found == {i: s for i, s in got.items() if s}


def test_both_ways_agree_on_small_lexicons(spark):
    rng = random.Random(13)
    frame = spark.createDataFrame([(_text(rng, 30),) for _ in range(40)], "text string")
    for n in (9, 30):
        lexicon = _entries(rng, n)
        together, alone = ur.split_lexicon(lexicon)
        both = frame.select("text", ur.indexed_signals(F.col("text"), lexicon).alias("s")).collect()
        assert [r["s"] for r in both] == [_searched(r["text"], lexicon) for r in both]


def test_entries_that_are_no_words_are_searched(spark):
    lexicon = ["!!!", *_entries(random.Random(1), 12)]
    frame = spark.createDataFrame([("now !!! locked",)], "text string")
    assert frame.select(ur.signals(F.col("text"), lexicon).alias("s")).first()["s"][0] == "!!!"


def test_time_does_not_follow_the_number_of_entries(spark):
    rng = random.Random(14)
    frame = spark.createDataFrame([(_text(rng, 300),) for _ in range(800)], "text string").repartition(8).cache()
    frame.count()

    def timed(n):
        found = frame.select(F.size(ur.signals(F.col("text"), _entries(random.Random(n), n))).alias("n"))
        best = 1e9
        for _ in range(3):
            start = time.perf_counter()
            found.agg(F.sum("n")).collect()
            best = min(best, time.perf_counter() - start)
        return best

    few, many = timed(250), timed(4000)
    assert many < 6 * few + 1
