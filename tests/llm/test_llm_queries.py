"""Whole queries against SQL, or against brute force where SQL cannot express them."""

import hashlib
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
import sentencepiece
from compare import TABLES, connect, spark_rows, sql_rows

import __spark_entry__ as entry_point
import corpus_pipeline
from ticketlake.llm import mixing, pii, quality
from ticketlake.llm.registry import ORACLE, QUERIES, TOKENIZER
from ticketlake.storage import staged_run

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


def rows_of(name, *columns):
    table = pq.read_table(f"{SF_DIR}/{name}.parquet")
    return list(zip(*[table.column(c).to_pylist() for c in columns]))


def result(spark, name):
    return {r[0]: r for r in map(tuple, QUERIES[name](spark, SF_DIR).collect())}


def test_all_are_registered():
    assert set(QUERIES) | {"pipeline"} <= set(entry_point.queries())
    assert {n.split("_")[0] for n in QUERIES} == {f"op{i}" for i in range(1, 14)}


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_sql(spark, con, name):
    with staged_run(spark):
        assert spark_rows(QUERIES[name](spark, SF_DIR)) == sql_rows(con, ORACLE[name])


def test_token_counts_are_those_of_the_library(spark):
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(TOKENIZER))
    docs = rows_of("documents", "doc_id", "text")
    got = result(spark, "op1_token_counts")
    assert len(got) == len(docs)
    for doc_id, text in docs:
        n = len(sp.encode(text))
        assert got[doc_id][1:] == (len(text.encode()), n, n > 4096)


def plain_spans(text):
    out = []
    for kind, pattern in (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
        ("card", r"[0-9]([\x20-]?[0-9])+"),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
    ):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            good = {
                "email": True,
                "ip": kind == "ip" and all(int(p) <= 255 for p in m.group().split(".")),
                "card": 13 <= len(digits) <= 19 and pii.luhn(digits),
                "phone": 9 <= len(digits) <= 15,
            }[kind]
            if good:
                out.append((kind, m.start(), m.end()))
    return out


def test_pii_base_spans_are_those_of_the_patterns(spark):
    got = result(spark, "op4_pii_spans")
    for doc_id, text in rows_of("documents", "doc_id", "text"):
        want = plain_spans(text)
        row = got[doc_id]
        assert row[5] == hashlib.sha256(pii.joined(want).encode()).hexdigest()
        assert set(pii.joined(want).split(",")) <= set(row[6].split(","))
        assert row[1:5] == tuple(row[6].count(f"{k}:") for k in pii.KINDS)


@pytest.mark.parametrize(
    "name, label, divisor, rest, least",
    [("op5_quality", "quality", 5, 0, 0.97), ("op8_toxicity", "toxic", 4, 2, 0.85)],
)
def test_held_out_accuracy(spark, name, label, divisor, rest, least):
    sf = "/root/testdata/sf0.1"
    got = {r["doc_id"]: r for r in QUERIES[name](spark, sf).collect()}
    table = pq.read_table(f"{sf}/labels.parquet")
    assert len(got) == pq.read_metadata(f"{sf}/documents.parquet").num_rows
    right = {0: [], 1: []}
    for doc_id, value in zip(table.column("doc_id").to_pylist(), table.column(label).to_pylist()):
        row = got[doc_id]
        assert row["held_out"] == (zlib.crc32(str(doc_id).encode()) % divisor == rest)
        assert 0 <= row["score"] <= 1 and row["predicted"] == (row["score"] >= 0.3)
        if row["held_out"]:
            right[value].append(row["predicted"] == value)
    assert min(np.mean(right[0]), np.mean(right[1])) >= least


def brute_groups(texts, width, num, den):
    """doc_id -> smallest linked id, by comparing all pairs."""
    sets = {}
    for doc_id, text in texts.items():
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        n = max(1, len(words) - width + 1) if words else 0
        sets[doc_id] = {tuple(words[i : i + width]) for i in range(n)}
    group = {d: d for d in texts}

    def root(d):
        while group[d] != d:
            d = group[d]
        return d

    ids = sorted(texts)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and den * len(x & y) >= num * len(x | y):
                low, high = sorted((root(a), root(b)))
                group[high] = low
    return {d: root(d) for d in ids}


def windows(words, size):
    if not words:
        return []
    return [tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))]


def test_pipeline_matches_brute_force(spark):
    docs = pq.read_table(f"{SF_DIR}/documents.parquet").to_pylist()
    frame = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    model = quality.fit(frame, spark.read.parquet(f"{SF_DIR}/labels.parquet"))
    import pyarrow as pa

    scores = 1 / (1 + np.exp(-model.logits(pa.array([d["text"] for d in docs]))))
    docs = [d for d, s in zip(docs, scores) if s >= 0.3]
    group = brute_groups({d["doc_id"]: d["text"] for d in docs}, 5, 80, 100)
    docs = [d for d in docs if group[d["doc_id"]] == d["doc_id"]]

    def words(text):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))

    items = {w for (t,) in rows_of("benchmark", "text") for w in windows(words(t), 10)}
    sizes = {len(w) for w in items}
    docs = [
        d
        for d in docs
        if not any(tuple(w[i : i + n]) in items for w in [words(d["text"])] for n in sizes for i in range(len(w) - n + 1))
    ]
    masked = []
    for d in docs:
        text = d["text"]
        for kind, a, b in sorted(plain_spans(text), key=lambda s: -s[1]):
            text = text[:a] + f"[{kind}]" + text[b:]
        masked.append({**d, "text": text, "n_chars": len(text)})
    con = duckdb.connect()
    con.register("rows", pa.Table.from_pylist(masked))
    con.execute("CREATE VIEW documents AS SELECT * FROM rows")
    got = corpus_pipeline.run(spark, SF_DIR)
    assert spark_rows(got) == sql_rows(con, mixing.SQL)
    assert "documents" in TABLES


def test_stages_keep_columns(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    for _, apply in corpus_pipeline.STAGES[:-1]:
        out = apply(spark, docs, SF_DIR)
        assert out.dtypes == docs.dtypes
