"""Conversation repair against an exhaustive search and a plain Python reading of the contract."""

import hashlib
import random
import re
import zlib
from functools import lru_cache

import pytest
from pyspark.sql import functions as F

from ticketlake.llm import conversation_repair as C

LEGAL = re.compile("(s?(ua)+)?")
BEGINS = re.compile("s?(ua)*u?")


def cheapest(codes):
    """All edits with at most two insertions in a row, by cost and then by ASCII order."""
    best = None

    def walk(at, initials, cost, audit, run):
        nonlocal best
        if not BEGINS.fullmatch(initials) or best is not None and cost > best[0]:
            return
        if at == len(codes) and LEGAL.fullmatch(initials):
            best = min(best, (cost, audit)) if best else (cost, audit)
        if run < 2:
            for letter in "ua":
                walk(at, initials + letter, cost + 5, audit + "I", run + 1)
        if at < len(codes):
            code = codes[at]
            more = 5 if code in "SUAX" else 0
            walk(at + 1, initials, cost + 2, audit + "D", 0)
            if code != "D":
                walk(at + 1, initials + code.lower(), cost + more, audit + "K", 0)
                for letter in "ua":
                    walk(at + 1, initials + letter, cost + more + 1, audit + "R", 0)

    walk(0, "", 0, "", 0)
    return best


def test_search_is_cheapest_and_least():
    rng = random.Random(5)
    for _ in range(250):
        codes = "".join(rng.choice("DsuuaaxSUAX") for _ in range(rng.randint(0, 4)))
        assert C.search(codes, C.START, C.ACCEPTED) == cheapest(codes), codes


def test_blocks_compose(monkeypatch):
    rng = random.Random(6)
    for _ in range(150):
        codes = "".join(rng.choice("DsuauauaxSUAX") for _ in range(rng.randint(0, 11)))
        whole = C.search(codes, C.START, C.ACCEPTED)
        for size in (1, 2, 3, 7):
            monkeypatch.setattr(C, "BLOCK", size)
            assert C.plan(codes) == whole
            maps = [C.state_map(codes[i : i + 3]) for i in range(0, len(codes), 3)]
            assert C.settle(maps) == whole[1]
            assert C.settle([*maps, C.state_map("")]) == whole[1]


def test_long_conversations_take_linear_work(monkeypatch):
    rng = random.Random(7)
    met = []
    search = C.search.__wrapped__
    monkeypatch.setattr(C, "search", lru_cache(None)(lambda *a: met.append(1) or search(*a)))
    codes = "".join(rng.choice("uaD") if rng.random() < 0.3 else "ua"[i % 2] for i in range(4000))
    cost, audit = C.plan(codes)
    assert len(met) <= 16 * (len(codes) // C.BLOCK + 1)
    assert len(audit) - audit.count("I") == len(codes)


def words_of(cost_audit_rows):
    return {r[0]: tuple(r)[1:] for r in cost_audit_rows}


def expected(rows, harm=True):
    """conv_id -> gaps, blank, duplicate, truncated, illegal, cost, audit, sha, in plain Python."""
    by = {}
    for conv, turn, role, text in rows:
        kept = by.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        pick = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20 if harm else 9
        if pick == 0:
            continue
        text = "" if pick == 1 else re.sub("[.!?]", "", text) if pick == 2 else text
        role = "user" if pick == 4 else role
        kept += [(turn, role, text)] * (2 if pick == 3 else 1)
    out = {}
    for conv, kept in by.items():
        kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        turns = [t for t, _, _ in kept if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        seen, codes, counts = set(), "", {"b": 0, "d": 0, "t": 0}
        for _, role, text in kept:
            solid = re.findall(r"[^\x20\x09-\x0D]", text)
            fault = "b" if not solid else "d" if (role, text) in seen else "t" if solid[-1] not in ".!?" else ""
            seen.add((role, text))
            if fault:
                counts[fault] += 1
            letter = role[:1] if role[:1] in tuple("sua") else "x"
            codes += "D" if fault in ("b", "d") else letter.upper() if fault else letter
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(kept, kept[1:]))
        cost, audit = C.plan(codes)
        lines, initials, at = [], "", 0
        for edit in audit:
            want = "user" if not initials or initials[-1] in "sa" else "assistant"
            if edit == "I":
                lines.append(f"{want}:")
                initials += want[0]
                continue
            _, role, text = kept[at]
            at += 1
            if edit != "D":
                role = want if edit == "R" else role
                initials += role[0]
                lines.append(f"{role}:{text}")
        assert LEGAL.fullmatch(initials)
        sha = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        out[conv] = (gaps, counts["b"], counts["d"], counts["t"], illegal, cost, audit, sha)
    return out


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(8)
    out = []
    for conv in (None, 0, 1, 2, 3, 4, 5, 6, 7, -8):
        for i in range(rng.choice((1, 2, 5, 9, 40))):
            turn = rng.choice((None, i, i, i, i, i + 3, i // 2))
            role = rng.choice(("user", "assistant", "system", "tool", "", None) if rng.random() < 0.3 else (("user", "assistant")[i % 2],))
            text = rng.choice((None, "", " \n\t", "Same text.", "cut", "Ends. ", "né!\n", "日本?", f"Line {i}.", f"Line {i}.", "a\x0bb", "x" * 5000 + "."))
            out.append((conv, turn, role, text))
    out += [(9, 1, "user", "Again.")] * 7 + [(9, None, "user", "Again.")] * 3
    return out


SCHEMA = "conv_id long, turn long, role string, text string"


def clashing(frame):
    for name in ("gone", "fault", "part", "block", "place", "edits", "is_long", "conv_key", "code", "copy", "n"):
        frame = frame.withColumn(name, F.lit("other"))
    return frame


def report(frame):
    return words_of(frame.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256").collect())


@pytest.mark.parametrize("long", [4096, 6, 0])
def test_report(spark, rows, monkeypatch, long):
    monkeypatch.setattr(C, "LONG", long)
    monkeypatch.setattr(C, "WIDE", 3 if long < 10 else C.WIDE)
    frame = clashing(spark.createDataFrame(rows, SCHEMA).repartition(3))
    assert report(C.report(C.damage(frame))) == expected(rows)
    assert report(C.report(C.conversations(frame))) == expected(rows, harm=False)


def test_everything_dropped_and_empty(spark):
    conv = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    frame = spark.createDataFrame([(conv, 0, "user", "Hello.")], SCHEMA)
    assert report(C.report(C.damage(frame))) == {conv: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
    assert C.report(C.damage(frame.limit(0))).count() == 0
    assert C.repair(C.damage(frame.limit(0))).count() == 0


@pytest.mark.parametrize("long", [4096, 2])
def test_repaired_rows(spark, rows, monkeypatch, long):
    monkeypatch.setattr(C, "LONG", long)
    frame = spark.createDataFrame(rows, SCHEMA)
    want = {k: v[7] for k, v in expected(rows).items()}
    got = {}
    for r in C.repair(C.damage(frame)).orderBy("conv_id", "place").collect():
        got.setdefault(r["conv_id"], []).append(f"{r['role']}:{r['text']}")
        assert r["place"] == len(got[r["conv_id"]]) - 1
        assert (r["edit"] == "I") <= (r["turn"] is None and r["text"] == "")
    for conv, sha in want.items():
        assert hashlib.sha256("\n".join(got.get(conv, [])).encode()).hexdigest() == sha


def test_string_ids(spark):
    frame = spark.createDataFrame([("a", 0, "user", "Hi."), ("a", 1, "assistant", "Yes.")], "conv_id string, turn int, role string, text string")
    got = C.report(C.conversations(frame)).first()
    assert (got["conv_id"], got["cost"], got["audit"]) == ("a", 0, "KK")
