import hashlib
import random
import re

from pyspark.sql import functions as F

from ticketlake.functions import text as tx

PIECES = [" ", "\n", "\t", "\x0b", "\x1c", "\x1f", "\x85", "\xa0", " ", "　", "​",
          "a", "Ä", "ß", "😀", "word", "Ticket 42", "\r\n", "."]


def _random_texts(n, longest, seed=3):
    rng = random.Random(seed)
    return ["".join(rng.choices(PIECES, k=rng.randint(0, longest))) for _ in range(n)]


def _apply(spark, values, *cols):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i long, s string")
    return [tuple(r)[1:] for r in df.select("i", *cols).orderBy("i").collect()]


def test_strip_and_squeeze_match_python(spark):
    texts = _random_texts(400, 12) + ["", "   ", " x "]
    got = _apply(spark, texts, tx.strip(F.col("s")), tx.squeeze(F.col("s")), tx.is_blank(F.col("s")))
    want = [(t.strip(), re.sub(r"\s+", " ", t).strip(), t.strip() == "") for t in texts]
    assert got == want


def test_merge_and_flat_text(spark):
    subjects, bodies = _random_texts(200, 6, 1), _random_texts(200, 6, 2)
    df = spark.createDataFrame(list(zip(range(200), subjects, bodies)), "i long, a string, b string")
    merged = tx.merge_subject_body(F.col("a"), F.col("b"))
    rows = df.select("i", merged, tx.squeeze(merged), tx.flat_text(F.col("a"), F.col("b"))).orderBy("i").collect()
    for r, a, b in zip(rows, subjects, bodies):
        a, b = a.strip(), b.strip()
        want = f"{a}\n\n{b}" if a and b else a or b
        assert r[1] == want
        assert r[2] == r[3] == re.sub(r"\s+", " ", want).strip()


def test_cap_length_keeps_head_and_tail(spark):
    texts = ["x" * 2000, "y" * 2001, "ab" * 3000, "😀" * 2500, "short"]
    got = [r[0] for r in _apply(spark, texts, tx.cap_length(F.col("s")))]
    want = [t if len(t) <= 2000 else t[:1800] + "\n[...]\n" + t[-200:] for t in texts]
    assert got == want
    assert [len(g) for g in got] == [2000, 2007, 2007, 2007, 5]


def test_snippet_marks_what_was_cut(spark):
    texts = ["x" * 200, "x" * 201, ""]
    got = [r[0] for r in _apply(spark, texts, tx.snippet(F.col("s")))]
    assert got == ["x" * 200, "x" * 200 + "...", ""]


def test_ticket_id_is_the_first_48_bits_of_the_hash(spark):
    df = spark.range(50).select(tx.ticket_id(F.lit("a file.csv"), F.col("id")).alias("t"), "id")
    for r in df.collect():
        digest = hashlib.md5(f"a file.csv:{r.id}".encode()).hexdigest()
        assert r.t == int(digest[:12], 16)


def test_sample_label(spark):
    df = spark.createDataFrame([(1, " Hello "), (2, None), (3, "z" * 61)], "t long, s string")
    got = [r[0] for r in df.select(tx.sample_label(F.col("t"), F.col("s"))).collect()]
    assert got == ["1 - Hello", "2 - ", "3 - " + "z" * 60 + "..."]
