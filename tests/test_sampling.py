import hashlib

import pytest
from pyspark.sql import functions as F

from ticketlake.operators import sampling as sm


def _key(i, seed):
    return hashlib.md5(f"{i}:{seed}".encode()).hexdigest()


def _brute(rows, n, seed):
    """Sampling by definition, over the list of (id, stratum)."""
    strata = {}
    for i, s in rows:
        if s is not None:
            strata.setdefault(s, []).append(i)
    if not strata:
        return sorted(sorted((i for i, _ in rows), key=lambda i: (_key(i, seed), i))[:n])
    quota = n // len(strata)
    picked = set()
    for ids in strata.values():
        picked |= set(sorted(ids, key=lambda i: (_key(i, seed), i))[:quota])
    rest = [i for i, _ in rows if i not in picked]
    fill = sorted(rest, key=lambda i: (_key(i, f"{seed}:fill"), i))[: n - len(picked)]
    return sorted(picked | set(fill))


def _rows(n):
    # one stratum holds half of all rows, one has three, some have none
    return [(i, None if i % 10 == 9 else "tiny" if i in (5, 15, 25) else "hot" if i % 2 else f"s{i % 4}") for i in range(n)]


@pytest.mark.parametrize("n", [0, 2, 40, 41, 500, 2000])
def test_sizes_and_members_match_the_definition(spark, n):
    rows = _rows(1500)
    df = spark.createDataFrame(rows, "ticket_id long, queue string")
    got = [r[0] for r in sm.stratified_ids(df, n).collect()]
    assert len(got) == len(set(got)) == min(n, 1500)
    assert sorted(got) == _brute(rows, n, 42)


def test_no_stratum_values_means_an_unstratified_draw(spark):
    df = spark.createDataFrame([(i, None) for i in range(60)], "ticket_id long, queue string")
    want = _brute([(i, None) for i in range(60)], 20, 42)
    assert sorted(r[0] for r in sm.stratified_ids(df, 20).collect()) == want
    assert sorted(r[0] for r in sm.stratified_ids(df.drop("queue"), 20).collect()) == want
    assert sm.stratified_ids(df.limit(0), 20).count() == 0


def test_sample_keeps_rows_whole_and_adds_an_order(spark):
    rows = [(i, s, f"text {i}") for i, s in _rows(300)]
    df = spark.createDataFrame(rows, "ticket_id long, queue string, text string")
    out = sm.stratified_sample(df, 50, seed=7)
    assert out.columns == ["ticket_id", "queue", "text", "sample_order"]
    got = out.collect()
    assert len(got) == 50 and all(r.text == f"text {r.ticket_id}" for r in got)
    first = [r.ticket_id for r in sorted(got, key=lambda r: r.sample_order)][:10]
    assert {r.ticket_id for r in sm.head(out, 10).collect()} == set(first)


def test_seed_decides_the_draw(spark):
    df = spark.range(1000).select(F.col("id").alias("ticket_id"), F.lit("q").alias("queue"))
    ids = [sorted(r[0] for r in sm.stratified_ids(df, 100, seed=s).collect()) for s in (1, 1, 2)]
    assert ids[0] == ids[1] != ids[2]


def test_random_row(spark):
    df = spark.range(100).withColumnRenamed("id", "ticket_id")
    one = [sm.random_row(df, s).collect() for s in (1, 1, 2)]
    assert one[0] == one[1] and len(one[0]) == 1
