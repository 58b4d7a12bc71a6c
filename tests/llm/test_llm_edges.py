"""Nulls, empty and long texts, repeated rows, empty tables and clashing names, per operator."""

import hashlib
import random

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline
from ticketlake.llm import (
    decontaminate,
    embedding_dedup,
    mixing,
    ngram_join,
    pii,
    quality,
    substring_dedup,
    token_count,
    toxicity,
    url_filter,
)
from ticketlake.llm.components import components
from ticketlake.llm.training import sample

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
MODEL = public_tokenizers.path("piece_bpe_32k.model")
LONG = " ".join(f"w{i % 997}x{i % 31}" for i in range(20000))
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi".split()


def docs(spark, rows):
    """Documents with further columns whose names operators use themselves."""
    rows = [(i, t, "en", s, None if t is None else len(t)) for i, t, s in rows]
    frame = spark.createDataFrame(rows, DOCS)
    for name in ("id", "key", "token", "n", "size", "target", "start", "spans", "score", "words", "bucket"):
        frame = frame.withColumn(name, F.lit("other"))
    return frame


@pytest.fixture(scope="module")
def odd(spark):
    text = " ".join(WORDS)
    return docs(
        spark,
        [
            (1, text, "a"),
            (2, None, None),
            (3, "", "a"),
            (4, " \n\t ", "b"),
            (5, text, "b"),
            (5, text, "b"),
            (6, LONG, None),
            (7, LONG + " end", "a"),
            (8, "one", "c"),
            (9, "one", "c"),
            (None, text, "a"),
        ],
    ).cache()


@pytest.fixture(scope="module")
def none(spark):
    return docs(spark, [])


def by_id(frame, key="doc_id"):
    out = {}
    for r in frame.collect():
        out.setdefault(r[key], []).append(r)
    return out


def test_token_counts(spark, odd, none, monkeypatch):
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    for limit in (token_count.LONG, 1000):
        monkeypatch.setattr(token_count, "LONG", limit)
        got = by_id(token_count.count_tokens(odd, MODEL))
        for r in odd.collect():
            for row in got[r["doc_id"]]:
                assert row["n_tokens"] == len(sp.encode(r["text"] or ""))
                assert row["n_bytes"] == len((r["text"] or "").encode())
        assert len(got[5]) == 2 and got[6][0]["over_limit"]
        assert token_count.count_tokens(none, MODEL).count() == 0


def test_token_states_compose(monkeypatch):
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    own = token_count.counter(open(MODEL, "rb").read())
    rng = random.Random(3)
    parts = ["a", "the", " ", "  ", "\n", "é", "日", "▁", "==", "0", "😀", "tion", "****", "①", "</s>", " the"]
    for size in (3, 7, 1 << 16):
        monkeypatch.setattr(token_count, "CHUNK", size)
        for _ in range(400):
            text = "".join(rng.choice(parts) for _ in range(rng.randint(1, 25)))
            want = len(sp.encode(text))
            assert own.count(text) == want
            maps = own.pieces_of(text)
            assert own.total(own.scan(maps)[-1]) == want
    monkeypatch.setattr(token_count, "MAX_STATES", 5)
    monkeypatch.setattr(token_count, "MAX_WORDS", 5)
    small = token_count.Counter(open(MODEL, "rb").read())
    assert small.count("some words that are not kept " * 9) == len(sp.encode("some words that are not kept " * 9))


def test_embeddings(spark):
    base = [1.0, 2.0, -1.0, 0.5]
    rows = [
        (1, base), (2, base), (3, [2 * x for x in base]), (4, [0.0] * 4), (5, None), (6, [1.0, None, 1.0, 1.0]),
        (7, [float("nan"), 1.0, 1.0, 1.0]), (8, [float("inf"), 1.0, 1.0, 1.0]), (9, []), (10, [-x for x in base]),
        (11, base[:3]), (2, base), (None, base), (12, [0.0] * 4), (13, [1.0, 2.0, -1.0, 0.6]),
    ]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    frame = frame.withColumn("id", F.lit(0)).withColumn("links", F.lit(0)).withColumn("label", F.lit(1))
    got = by_id(embedding_dedup.dedup(frame), "vec_id")
    for i in (1, 2, 3, 13):
        assert (got[i][0]["n_links"], got[i][0]["component_id"]) == (3, 1)
    for i in (4, 5, 6, 7, 8, 9, 10, 11, 12):
        assert got[i][0]["n_links"] == 0 and got[i][0]["component_id"] == i and got[i][0]["kept"]
    assert len(got[2]) == 2 and got[None][0]["component_id"] is None
    assert embedding_dedup.dedup(frame.limit(0)).count() == 0


def test_embeddings_in_large_buckets(spark, monkeypatch):
    """A group that fills many cells, against all pairs; and pairs near the threshold."""
    import numpy as np

    rng = np.random.default_rng(1)
    centre = rng.normal(size=32)
    x = np.concatenate([centre + 0.28 * rng.normal(size=(900, 32)), rng.normal(size=(600, 32))]).astype(np.float32)
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    monkeypatch.setattr(embedding_dedup, "CELL", 100)
    unit = embedding_dedup.unit(x)
    want = (unit @ unit.T >= 0.9).sum(1) - 1
    shapes = embedding_dedup.SHAPES
    for own in shapes[:2]:  # as for few and for many vectors
        monkeypatch.setattr(embedding_dedup, "SHAPES", (own,))
        got = {r["vec_id"]: r["n_links"] for r in embedding_dedup.dedup(frame).collect()}
        assert sum(got.values()) >= 0.995 * want.sum()
        assert all(got[i] <= want[i] for i in got)


def test_hashes_follow_the_number_of_vectors():
    hashes = [embedding_dedup.shape(n, 64).hashes for n in (0, 1000, 10**6, 10**7, 10**9, 10**12)]
    assert hashes == [2, 2, 2, 3, 4, 4]


def test_mixing(odd, none):
    got = mixing.mix(odd).collect()
    assert len(got) == odd.count()
    sizes = {r["doc_id"]: r["size"] for r in got}
    assert (sizes[1], sizes[2], sizes[3], sizes[4], sizes[8]) == (16, 0, 0, 0, 1)
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in got)
    sources = {r["source"]: (r["source_size"], r["target"]) for r in got}
    assert sources[None][0] == 20000
    assert sum(t for _, t in sources.values()) == pytest.approx(1.5 * sum(s for s, _ in sources.values()))
    assert all(t <= 2 * s for s, t in sources.values())
    assert sorted(mixing.mix(odd).collect(), key=str) == sorted(got, key=str)
    assert mixing.mix(none).count() == 0
    assert mixing.mix(odd.where("doc_id IN (2, 3)")).agg(F.sum("taken")).first()[0] == 0


def test_mixing_comes_near_its_targets(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(["w"] * rng.randint(1, 400)), f"s{min(i % 7, 4)}") for i in range(700)]
    got = mixing.mix(docs(spark, rows)).collect()
    for source in {r["source"] for r in got}:
        own = [r for r in got if r["source"] == source]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 4 * mixing.BLOCK


def test_pii(odd, none, spark):
    got = by_id(pii.report(odd))
    assert got[2][0]["spans"] == "" and got[2][0]["base_sha256"] == hashlib.sha256(b"").hexdigest()
    assert len(got[5]) == 2
    assert pii.report(none).count() == 0
    masked = pii.mask(odd)
    assert masked.dtypes == odd.dtypes and masked.count() == odd.count()


@pytest.mark.parametrize(
    "text, kind, found",
    [
        ("mail john dot smith at example dot com now", "email", "john dot smith at example dot com"),
        ("write jane [at] example.com please", "email", "jane [at] example.com"),
        ("x (at) site (dot) org", "email", "x (at) site (dot) org"),
        ("see jоhn@exаmple.com", "email", "jоhn@exаmple.com"),
        ("joe＠site．com", "email", "joe＠site．com"),
        ("call plus one four one five five five five two six seven one ok", "phone", "plus one four one five five five five two six seven one"),
        ("ip one nine two dot one six eight dot one dot one done", "ip", "one nine two dot one six eight dot one dot one"),
        ("card " + "four" + " one" * 15, "card", "four" + " one" * 15),
        ("plain a.b@c.de", "email", "a.b@c.de"),
    ],
)
def test_pii_disguises(text, kind, found):
    _, spans = pii.find(text)
    assert [(k, text[a:b]) for k, a, b in spans] == [(kind, found)]


@pytest.mark.parametrize(
    "text",
    [
        "we met at noon. At ten he left at 3.5 miles", "look at example.com", "four five six seven eight",
        "the dot on the i", "at dot at dot", "stone tone one zone nine", "Привет мир. Как дела", "1.2.3",
    ],
)
def test_pii_leaves_prose_alone(text):
    assert pii.find(text) == ([], [])


@pytest.mark.parametrize(
    "text, kind, found",
    [
        ("call +1 555 one two three 4567 now", "phone", "+1 555 one two three 4567"),
        ("host 10.zero.zero.one is up", "ip", "10.zero.zero.one"),
        ("host 10 . 0 . 0 . 1 is up", "ip", "10 . 0 . 0 . 1"),
        ("card 4111 1111 1111 1 one one one", "card", "4111 1111 1111 1 one one one"),
        ("call plus one 4155552671", "phone", "plus one 4155552671"),
        ("mail joe@example . com, please", "email", "joe@example . com"),
        ("mail JOE@EXAMPLE . COM, please", "email", "JOE@EXAMPLE . COM"),
        ("mail Joe@Example . Com, please", "email", "Joe@Example . Com"),
        ("mail joe at example . com", "email", "joe at example . com"),
        ("mail joe@example . com . The rest", "email", "joe@example . com"),
        ("reach me at joe.smith@example dot com", "email", "joe.smith@example dot com"),
    ],
)
def test_pii_disguises_in_otherwise_plain_texts(text, kind, found):
    _, spans = pii.find(text)
    assert [(k, text[a:b]) for k, a, b in spans] == [(kind, found)]


@pytest.mark.parametrize(
    "text, kind, found, plain",
    [
        ("see jоhn.smith@example.com now", "email", "jоhn.smith@example.com", "hn.smith@example.com"),
        ("reach me at jоhn.smith@example.com now", "email", "jоhn.smith@example.com", "hn.smith@example.com"),
        ("see john@example.cоm now", "email", "john@example.cоm", "john@example.c"),
        ("host 192.168.1.2５ is up", "ip", "192.168.1.2５", "192.168.1.2"),
        ("host one92.168.1.1 is up", "ip", "one92.168.1.1", "92.168.1.1"),
        ("see joe@mail.example dot com now", "email", "joe@mail.example dot com", "joe@mail.example"),
        ("call +1 555 123 456 seven now", "phone", "+1 555 123 456 seven", "+1 555 123 456"),
    ],
)
def test_pii_disguises_around_plain_findings(text, kind, found, plain):
    base, spans = pii.find(text)
    assert [(k, text[a:b]) for k, a, b in base] == [(kind, plain)]
    assert {(k, text[a:b]) for k, a, b in spans} == {(kind, plain), (kind, found)}
    assert len(spans) == 2 and pii.masked(text) == text.replace(found, f"[{kind}]")


def test_pii_rewritten_text_beside_a_plain_finding_adds_nothing():
    for text in ("see joe@site.com and оne", "nine hosts: 10.0.0.1 and 10.0.0.2 at noon"):
        base, spans = pii.find(text)
        assert base and spans == base


def test_pii_spaced_dots_end_sentences():
    assert pii.find("we arrived at noon . Then we left") == ([], [])
    base, spans = pii.find("write to joe@example.com . The rest is known")
    assert spans == base == [("email", 9, 24)]


def test_pii_is_linear_on_long_runs():
    for piece in ("1", " ", "a", ".", "1.", "+1", "@", " [", "one "):
        pii.find(piece * 200_000)


@pytest.mark.parametrize("operator, label", [(quality, "quality"), (toxicity, "toxic")])
def test_classifiers(spark, odd, none, operator, label):
    rows = [(i, i % 2, i % 2) for i in range(1, 10)] + [(None, 1, 1), (3, None, None)]
    labels = spark.createDataFrame(rows, "doc_id long, quality int, toxic int").withColumn("text", F.lit("x"))
    got = by_id(operator.judge(odd, labels))
    assert sum(map(len, got.values())) == odd.count()
    for rows in got.values():
        assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in rows)
    one = labels.where(f"{label} = 1")
    assert {r["predicted"] for r in operator.judge(odd, one).collect()} == {1}
    assert operator.judge(odd, labels.limit(0)).count() == odd.count()
    assert operator.judge(none, labels).count() == 0
    assert operator.judge(odd.where("doc_id = 6"), labels.where("doc_id <> 6")).count() == 1


@pytest.mark.parametrize("operator, label", [(quality, "quality"), (toxicity, "toxic")])
def test_classifiers_learn_from_2500_documents_a_class(spark, operator, label):
    rows = spark.range(5200).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"), (F.col("id") % 2).alias(label))
    chosen, counts = sample(rows, rows, label, F.lit(True), operator.PER_CLASS)
    assert counts.tolist() == [2600, 2600]
    assert {r["label"]: r["count"] for r in chosen.groupBy("label").count().collect()} == {0: 2500, 1: 2500}


def test_urls(spark):
    urls = {
        1: "http://A.ORG/x", 2: None, 3: "", 4: "no scheme", 5: "https://example.org/es/1?q#f", 6: "x://example.org/en/12",
        7: "http://notexample.org.com/de/", 8: "http://com/de", 9: "http://a.com/de/#x", 10: "http://org", 11: "http://org?/",
        12: "http://x.example.org/es/", 13: "http://" + "a." * 5000 + "com/fr/" + "p" * 5000, 14: "http:///org/", 15: "http://É.org/a",
    }
    frame = spark.createDataFrame(list(urls.items()) + [(5, urls[5])], "page_id long, url string").withColumn("host", F.lit("h"))
    got = by_id(url_filter.judge(frame), "page_id")
    rule = {i: r[0]["rule"] for i, r in got.items()}
    assert rule == {
        1: "org/", 2: None, 3: None, 4: None, 5: "example.org/es/", 6: "example.org/en/1", 7: "com/de/", 8: None, 9: "com/de/",
        10: None, 11: None, 12: "example.org/es/", 13: "com/fr/", 14: None, 15: "org/",
    }
    assert {i for i, r in got.items() if r[0]["verdict"] == "block"} == {5, 6, 7, 9, 12}
    assert (got[2][0]["host"], got[2][0]["path"], got[1][0]["host"]) == ("", "", "a.org")
    assert len(got[5]) == 2 and got[10][0]["path"] == "" and got[11][0]["path"] == ""
    assert url_filter.judge(frame.limit(0)).count() == 0
    assert url_filter.judge(frame, rules=()).where("verdict = 'allow'").count() == frame.count()


def test_filter_cascade_is_exact(spark):
    universe = spark.range(20000).select(F.concat(F.lit("k"), "id").alias("key"))
    listed = universe.where("key LIKE '%7'")
    cascade = url_filter.build(listed, universe)
    assert len(cascade) > 1
    wrong = universe.where(url_filter.contains(F.col("key"), cascade) != F.col("key").endswith("7"))
    assert wrong.count() == 0
    assert url_filter.build(listed.limit(0), universe) == []


def test_ngram_join(odd, none):
    got = by_id(ngram_join.join(odd, 3, 90, 100))
    assert {i: r[0]["component_id"] for i, r in got.items() if i} == {1: 1, 2: 2, 3: 3, 4: 4, 5: 1, 6: 6, 7: 6, 8: 8, 9: 8}
    assert [got[i][0]["n_shingles"] for i in (1, 2, 3, 4, 8)] == [14, 0, 0, 0, 1]
    assert len(got[5]) == 2 and got[None][0]["component_id"] is None and got[None][0]["n_shingles"] == 14
    assert ngram_join.join(none).count() == 0


@pytest.mark.parametrize(
    "rare, wide, width, num", [(64, 64, 3, 90), (64, 64, 5, 80), (2, 64, 3, 90), (2, 2, 2, 60)]
)
def test_ngram_join_of_near_copies(spark, monkeypatch, rare, wide, width, num):
    """Chains and groups around the threshold, with shared passages, against all pairs."""
    from test_llm_queries import brute_groups

    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(300)]
    passage = [rng.choice(vocabulary) for _ in range(40)]
    texts = {}
    for group in range(12):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(4, 120))]
        if group % 3 == 0:
            words += passage
        for _ in range(8):
            words = list(words)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 6])):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            texts[len(texts) * 3 % 301] = " ".join(words)
    monkeypatch.setattr(ngram_join, "RARE", rare)
    monkeypatch.setattr(ngram_join, "WIDE", wide)
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.join(frame, width, num, 100).collect()}
    assert got == brute_groups(texts, width, num, 100)


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 160)] + [(7, 7), (160, 100)]
    random.Random(1).shuffle(edges)
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 161)}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def removed(docs):
    return by_id(substring_dedup.remove(docs, substring_dedup.spans(docs)))


def test_substrings(odd, none):
    got = removed(odd)
    assert [got[i][0]["n_removed"] for i in (1, 2, 3, 4, 6, 8, 9, None)] == [0] * 8
    assert [r["n_removed"] for r in got[5]] == [16, 16]
    assert (got[7][0]["n_removed"], got[7][0]["kept"]) == (20000, "end")
    assert got[None][0]["kept"] == " ".join(WORDS)
    assert removed(none) == {}


def brute_removed(texts, width=13):
    first = {}
    for i, words in texts.items():
        for at in range(len(words) - width + 1):
            key = tuple(words[at : at + width])
            first[key] = min(first.get(key, i), i)
    out = {}
    for i, words in texts.items():
        gone = set()
        for at in range(len(words) - width + 1):
            if first[tuple(words[at : at + width])] < i:
                gone |= set(range(at, at + width))
        out[i] = " ".join(w for at, w in enumerate(words) if at not in gone)
    return out


def test_substrings_against_all_windows(spark):
    rng = random.Random(4)
    vocabulary = [f"v{i}" for i in range(40)]
    passages = [[rng.choice(vocabulary) for _ in range(rng.randint(10, 40))] for _ in range(6)]
    texts = {}
    for i in range(150):
        words = []
        for _ in range(rng.randint(0, 5)):
            words += [rng.choice(vocabulary) for _ in range(rng.randint(0, 9))]
            part = rng.choice(passages)
            at = rng.randrange(len(part))
            words += part[: at + 8] if rng.random() < 0.5 else part[at:]
        texts[i * 7 % 151] = words
    frame = spark.createDataFrame([(i, " ".join(w)) for i, w in texts.items()], "doc_id long, text string").repartition(7)
    got = removed(frame)
    assert {i: r[0]["kept"] for i, r in got.items()} == brute_removed(texts)


def test_decontamination(spark, odd, none):
    items = spark.createDataFrame(
        [(1, " ".join(WORDS[:12])), (2, None), (3, ""), (4, "One!"), (5, "--- ..."), (1, " ".join(WORDS[:12])), (10, " ".join(WORDS[:12])), (None, "w1x1 w2x2")],
        "item_id long, text string",
    ).withColumn("words", F.lit(0))
    got = by_id(decontaminate.digest(decontaminate.mark(odd, items)))
    assert (got[1][0]["n_hit"], got[1][0]["n_items"]) == (12, 2)
    assert got[1][0]["items_sha256"] == hashlib.sha256(b"1,10").hexdigest()
    assert got[8][0]["n_hit"] == 1 and got[2][0]["n_words"] == 0 and not got[3][0]["contaminated"]
    assert len(got[5]) == 2
    marked = decontaminate.mark(odd, items)
    assert marked.columns[: len(odd.columns)] == odd.columns
    assert decontaminate.mark(none, items).count() == 0
    assert decontaminate.digest(decontaminate.mark(odd, items.limit(0))).where("contaminated").count() == 0


def test_decontamination_in_blocks(spark, odd):
    """A benchmark of several blocks gives what one block gives."""
    rng = random.Random(6)
    texts = [" ".join(rng.choice("abcd") for _ in range(rng.randint(0, 30))) for _ in range(60)]
    items = spark.createDataFrame([(i, " ".join(rng.choice("abcd") for _ in range(rng.randint(1, 6)))) for i in range(12)], "item_id long, text string")
    frame = docs(spark, [(i, t, "a") for i, t in enumerate(texts)])
    one = decontaminate.digest(decontaminate.mark(frame, items, width=4)).collect()
    many = decontaminate.digest(decontaminate.mark(frame, items, width=4, block=5)).collect()
    assert sorted(one) == sorted(many)
    parts = {r["item_id"]: r["text"].split() for r in items.collect()}
    for r in one:
        words = texts[r["doc_id"]].split()
        hit, found = set(), set()
        for item, own in parts.items():
            for at in range(max(1, len(own) - 3)):
                w = own[at : at + 4]
                for i in range(len(words) - len(w) + 1):
                    if words[i : i + len(w)] == w:
                        hit |= set(range(i, i + len(w)))
                        found.add(str(item))
        assert (r["n_hit"], r["n_items"]) == (len(hit), len(found))


def test_pipeline_stages(spark, odd, none):
    sf = "/root/testdata/sf0.001"
    for frame in (odd, none):
        rows = frame
        for _, apply in corpus_pipeline.STAGES[:-1]:
            rows = apply(spark, rows, sf)
            assert rows.dtypes == frame.dtypes
        out = corpus_pipeline.STAGES[-1][1](spark, rows, sf)
        assert {"doc_id", "taken"} <= set(out.columns)
        out.collect()
    left = corpus_pipeline.drop_near_duplicates(spark, odd, sf).collect()
    assert sorted(str(r["doc_id"]) for r in left) == ["1", "2", "3", "4", "6", "8", "None"]
