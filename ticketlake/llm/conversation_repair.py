"""Cheapest repair of damaged conversations, found by iterative-deepening A*.

Rows are kept (K), given the role the structure asks for (R, cost 1), deleted (D, cost 2) or rows with
an empty text are inserted (I, cost 5), so that the role initials read ``(s?(ua)+)?``. Blank rows
and rows whose role and text came before must go; a truncated row that stays costs 5 more.

The search is depth-first in ASCII order of the edits under a cost bound. The least cost each remaining
row can have is the heuristic. A table keeps, per row and state of the structure,
the cost that a failed visit has shown to be needed, so a state is entered again only with more than that left.
Where a bound fails, the next one is the smallest cost beyond it that was met; so the first path that is
accepted is the cheapest one and, of those, the least in ASCII order.

A conversation is searched in blocks of ``BLOCK`` rows. For each state before a block and each after
it, the block's cheapest path is one search; blocks compose state by state, by cost and then by the edits
so far. Of two paths with the same rows, state and cost none begins with the other, so
the least path is made of least paths. Work is thus linear in the rows.

Conversations of up to ``LONG`` rows and ``LONG_BYTES`` are brought together by id, sorted and
repaired by one task each. Longer ones are counted beforehand and take another way with the
same result: their rows are sorted over all tasks by range, the blocks are searched where they
are, and only the blocks' state maps and the edits, a byte a row, are put in
line per conversation. One task per conversation then reads its rows in order, one at a time,
for the digest, as that of one text needs. There, equal rows are told by 128-bit hashes.

Null ids are one conversation; null turns come first, and rows with equal turns are ordered by role and text. A null
role or text counts as one space: such a role fits nowhere, such a text is blank. The initial of an
empty role is empty and fits nowhere either. Repeated rows are duplicates. An
empty table gives an empty result. Columns other than id, turn, role and text are not
read, so they may have any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import groupby
from os.path import commonprefix

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import stage
from . import words as W
from .common import likely

#: rows of a block; blocks of a long conversation hold WIDE rows; what counts as long
BLOCK, WIDE = 16, 512
LONG, LONG_BYTES = 4096, 1 << 25
MAX_LONG = (1 << 63) - 1

# costs of the edits, and what a truncated row that stays costs more
RENAME, DELETE, INSERT, CUT = 1, 2, 5, 5

# states of (s?(ua)+)?: before anything, after s, after u, after a
START, AFTER_S, AFTER_U, AFTER_A = STATES = range(4)
STEPS = {(START, "s"): AFTER_S, (START, "u"): AFTER_U, (AFTER_S, "u"): AFTER_U, (AFTER_U, "a"): AFTER_A, (AFTER_A, "u"): AFTER_U}
ACCEPTED = frozenset((START, AFTER_A))
ROLES = {"u": "user", "a": "assistant"}
LEGAL = frozenset(("su", "ua", "au"))


def wanted(state: int) -> str:
    """The initial that a row given a role, or inserted, gets."""
    return "a" if state == AFTER_U else "u"


# --- the search -------------------------------------------------------------------------------
# A row is a letter: its initial (x: one that fits nowhere), upper case if truncated, D if it must go.


def moves(code: str | None, state: int) -> Iterator[tuple[str, int, int]]:
    """Edits in ASCII order: letter, cost, next state; ``code`` null: after the last row."""
    if code:
        yield "D", DELETE, state
    yield "I", INSERT, STEPS[state, wanted(state)]
    if code and code != "D":
        letter, more = code.lower(), CUT if code.isupper() else 0
        if (state, letter) in STEPS:
            yield "K", more, STEPS[state, letter]
        if letter != wanted(state):  # else K does the same for less
            yield "R", RENAME + more, STEPS[state, wanted(state)]


def least(code: str) -> int:
    """At least what a row costs, whatever the state."""
    if code.isupper():
        return DELETE
    return RENAME if code == "x" else 0


@lru_cache(maxsize=1 << 16)
def search(codes: str, entry: int, goals: frozenset) -> tuple[int, str]:
    """Cost and edits of the cheapest, then ASCII-least, path through ``codes`` that ends in ``goals``."""
    n = len(codes)
    floor = [0] * (n + 1)
    for i in range(n - 1, -1, -1):
        floor[i] = floor[i + 1] + least(codes[i])
    needed: dict[tuple[int, int], int] = {}  # of failed states: more than any budget they failed with
    path: list[str] = []

    def visit(at: int, state: int, left: int) -> int:
        """0 if accepted within ``left``; else a cost beyond it that is needed from here on."""
        need = needed.get((at, state), floor[at])
        if need > left:
            return need
        if at == n and state in goals:
            return 0
        lowest = None
        for edit, cost, then in moves(codes[at] if at < n else None, state):
            path.append(edit)
            need = visit(at if edit == "I" else at + 1, then, left - cost)
            if need <= left - cost:
                return 0
            path.pop()
            lowest = need + cost if lowest is None else min(lowest, need + cost)
        needed[at, state] = lowest
        return lowest

    bound = floor[0]
    while (need := visit(0, entry, bound)) > bound:
        bound = need
    return bound, "".join(path)


def reachable(codes: str, entry: int) -> list[int]:
    """States a path through ``codes`` can end in."""
    out = [AFTER_U, AFTER_A]
    if entry == START:
        out.append(START)
    if entry == AFTER_S or entry == START and ("s" in codes or "S" in codes):
        out.append(AFTER_S)
    return out


Best = dict[int, tuple[int, str]]


def advance(best: Best, codes: str) -> Best:
    """The best (cost, edits) per state after the block ``codes``, from those before it."""
    out: Best = {}
    for entry, (cost, edits) in best.items():
        for state in reachable(codes, entry):
            more, added = search(codes, entry, frozenset((state,)))
            found = (cost + more, edits + added)
            out[state] = min(out.get(state, found), found)
    return out


def finish(best: Best, codes: str = "") -> tuple[int, str]:
    """The best accepted path once ``codes``, the last block, is through."""
    ends = []
    for entry, (cost, edits) in best.items():
        more, added = search(codes, entry, ACCEPTED)
        ends.append((cost + more, edits + added))
    return min(ends)


def plan(codes: str) -> tuple[int, str]:
    """Cost and edits of a whole conversation."""
    best: Best = {START: (0, "")}
    blocks = [codes[i : i + BLOCK] for i in range(0, len(codes), BLOCK)] or [""]
    for block in blocks[:-1]:
        best = advance(best, block)
    return finish(best, blocks[-1])


def state_map(codes: str) -> dict[int, Best]:
    """Per state before ``codes``: the best per state after it."""
    out = {}
    for entry in STATES:
        best: Best = {entry: (0, "")}
        for i in range(0, len(codes), BLOCK):
            best = advance(best, codes[i : i + BLOCK])
        out[entry] = best
    return out


# --- rows -------------------------------------------------------------------------------------


def damage(rows: DataFrame, id_col="conv_id", turn_col="turn", role_col="role", text_col="text") -> DataFrame:
    """conv_id, turn, role, text after the damage that crc32 of ``id:turn`` picks; dropped rows are ``gone``."""
    named = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    role, text = named(role_col), named(text_col)
    picked = F.crc32(F.concat(named(id_col), F.lit(":"), named(turn_col)).cast("binary")) % 20
    return rows.select(
        F.col(id_col).alias("conv_id"),
        F.col(turn_col).cast("long").alias("turn"),
        F.when(picked == 4, "user").otherwise(role).alias("role"),
        F.when(picked == 1, "").when(picked == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        (picked == 0).alias("gone"),
        F.explode(F.when(picked == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    ).drop("copy")


def conversations(rows: DataFrame, id_col="conv_id", turn_col="turn", role_col="role", text_col="text") -> DataFrame:
    """The rows as they are, in the form ``repair`` and ``report`` take."""
    named = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    return rows.select(
        F.col(id_col).alias("conv_id"),
        F.col(turn_col).cast("long").alias("turn"),
        named(role_col).alias("role"),
        named(text_col).alias("text"),
        F.lit(False).alias("gone"),
    )


_SPACE = " \t\n\x0b\x0c\r"


def _judged(rows: DataFrame) -> DataFrame:
    """With ``fault`` (b blank, t truncated, empty neither); texts and roles of rows that are gone go too."""
    end = F.substring(F.rtrim(F.col("text"), F.lit(_SPACE)), -1, 1)
    fault = F.when(end == "", "b").when(end.isin(".", "!", "?"), "").otherwise("t")
    there = lambda c: F.when(~F.col("gone"), c)
    return rows.select(
        "conv_id", there(F.col("turn")).alias("turn"), there(F.col("role")).alias("role"),
        there(F.col("text")).alias("text"), "gone", fault.alias("fault"),
    )


def code_of(role: str, fault: str, repeated: bool) -> str:
    if fault == "b" or repeated:
        return "D"
    letter = role[:1] if role[:1] in ("s", "u", "a") else "x"
    return letter.upper() if fault == "t" else letter


class Repair:
    """One conversation, row by row: counts of what was wrong, and the repaired rows."""

    def __init__(self):
        self.blank = self.repeated = self.truncated = self.illegal = 0
        self.turns = 0
        self.first = self.last = self.before = None
        self.state = START
        self.cost = 0
        self.audit: list[str] = []

    def see(self, turn: int | None, role: str, fault: str, repeated: bool) -> None:
        """Count a row as it came."""
        if fault == "b":
            self.blank += 1
        elif repeated:
            self.repeated += 1
        elif fault == "t":
            self.truncated += 1
        if self.before is not None and self.before + role[:1] not in LEGAL:
            self.illegal += 1
        self.before = role[:1]
        if turn is not None and turn != self.last:
            self.turns += 1
            self.first = turn if self.first is None else self.first
            self.last = turn

    def inserted(self, edits: str) -> Iterator[tuple]:
        for _ in edits:
            self.cost += INSERT
            letter = wanted(self.state)
            self.state = STEPS[self.state, letter]
            yield None, "I", ROLES[letter], ""

    def edited(self, edit: str, turn, role: str, text: str, fault: str) -> Iterator[tuple]:
        """Apply one edit to a row: turn, edit, role and text of what is left of it."""
        if edit == "D":
            self.cost += DELETE
            return
        letter = role[:1]
        if edit == "R":
            letter = wanted(self.state)
            role = ROLES[letter]
            self.cost += RENAME
        self.cost += CUT if fault == "t" else 0
        self.state = STEPS[self.state, letter]
        yield turn, edit, role, text

    def gaps(self) -> int:
        return 0 if self.first is None else min(MAX_LONG, self.last - self.first + 1 - self.turns)

    def summary(self) -> tuple:
        return (self.gaps(), self.blank, self.repeated, self.truncated, self.illegal, self.cost, "".join(self.audit))


def _rows(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for part in W.batches(batch, "text"):
            yield from zip(*[c.to_pylist() for c in part.columns])


def _repaired_short(rows: list[tuple], out: Repair) -> Iterator[tuple]:
    """Rows of one conversation (conv_id, turn, role, text, gone, fault), in order."""
    seen, codes, kept = set(), [], []
    for _, turn, role, text, gone, fault in rows:
        if not gone:
            repeated = (role, text) in seen
            seen.add((role, text))
            codes.append(code_of(role, fault, repeated))
            kept.append((turn, role, text, fault))
            out.see(turn, role, fault, repeated)
    _, audit = plan("".join(codes))
    out.audit.append(audit)
    at = 0
    for edit in audit:
        if edit == "I":
            yield from out.inserted(edit)
        else:
            turn, role, text, fault = kept[at]
            at += 1
            yield from out.edited(edit, turn, role, text, fault)


def _repaired_long(rows: Iterable[tuple], out: Repair) -> Iterator[tuple]:
    """Rows of one conversation, each block's edits before its rows; one row is held at a time."""
    edits, at = "", 0
    for _, turn, role, text, gone, fault, repeated, more in rows:
        if more is not None:
            yield from out.inserted(edits[at:])
            out.audit.append(more)
            edits, at = more, 0
        elif not gone:
            out.see(turn, role, fault, repeated)
            run = len(edits) - at - len(edits[at:].lstrip("I"))
            yield from out.inserted(edits[at : at + run])
            at += run
            yield from out.edited(edits[at], turn, role, text, fault)
            at += 1
    yield from out.inserted(edits[at:])


SUMMARY = (
    "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
)
REPAIRED = "place long, turn long, edit string, role string, text string"


def _batch(rows: list[tuple], kind: pa.DataType, fields: str) -> pa.RecordBatch:
    names = ["conv_id"] + [f.split()[0] for f in fields.split(", ")]
    kinds = [kind] + [pa.int64() if f.endswith("long") else pa.string() for f in fields.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)


def _each(long: bool, summary: bool):
    """Repairs what comes sorted by conversation: a row per conversation, or the repaired rows."""
    steps = _repaired_long if long else _repaired_short

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind: list[pa.DataType] = []

        def noted():
            for batch in batches:
                kind[:] = [batch.schema.field("conv_id").type]
                yield batch

        held, size = [], 0
        for conv, group in groupby(_rows(noted()), key=lambda r: r[0]):
            out = Repair()
            digest, first = hashlib.sha256(), True
            for place, (turn, edit, role, text) in enumerate(steps(group if long else list(group), out)):
                if summary:
                    digest.update((f"{role}:{text}" if first else f"\n{role}:{text}").encode())
                    first = False
                else:
                    held.append((conv, place, turn, edit, role, text))
                    size += len(text)
                    if size > 1 << 22 or len(held) >= 8192:
                        yield _batch(held, kind[0], REPAIRED)
                        held, size = [], 0
            if summary:
                held.append((conv, *out.summary(), digest.hexdigest()))
                size += len(held[-1][7])
                if size > 1 << 22 or len(held) >= 8192:
                    yield _batch(held, kind[0], SUMMARY)
                    held, size = [], 0
        if held:
            yield _batch(held, kind[0], SUMMARY if summary else REPAIRED)

    return rows


# --- long conversations -----------------------------------------------------------------------


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """With each row's place in its part."""
    at = 0
    for batch in batches:
        place = pa.array(range(at, at + batch.num_rows), pa.int64())
        at += batch.num_rows
        yield pa.RecordBatch.from_arrays([*batch.columns, place], [*batch.schema.names, "place"])


def _mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each block's state map: per state before and after it cost and edits."""
    for batch in batches:
        for lo in range(0, batch.num_rows, 64):
            part = batch.slice(lo, 64)
            found, at = [], []
            for i, codes in enumerate(part.column("codes").to_pylist()):
                for entry, best in state_map(codes).items():
                    found += [(entry, state, cost, edits) for state, (cost, edits) in best.items()]
                    at += [i] * len(best)
            keys = part.select(["conv_id", "part", "block"]).take(pa.array(at, pa.int64()))
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.string())
            columns = [pa.array(c, k) for c, k in zip(zip(*found), kinds)]
            yield pa.RecordBatch.from_arrays([*keys.columns, *columns], [*keys.schema.names, "entry", "after", "cost", "edits"])


def settle(maps: Iterable[dict[int, Best]]) -> str:
    """The edits of a conversation from its blocks' state maps, in order.

    What all candidates begin with is settled and put aside, so only short ends are compared.
    """
    settled, best = [], {START: (0, "")}
    for state_of in maps:
        out: Best = {}
        for entry, (cost, edits) in best.items():
            for state, (more, added) in state_of[entry].items():
                found = (cost + more, edits + added)
                out[state] = min(out.get(state, found), found)
        common = len(commonprefix([edits for _, edits in out.values()]))
        settled.append(next(iter(out.values()))[1][:common])
        best = {state: (cost, edits[common:]) for state, (cost, edits) in out.items()}
    return "".join(settled) + finish(best)[1]


def _settled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each block's edits, from the state maps of a conversation's blocks in order."""
    kind: list[pa.DataType] = []

    def entries():
        for batch in batches:
            kind[:] = [batch.schema.field("conv_id").type]
            yield from zip(*[batch.column(c).to_pylist() for c in ("conv_id", "part", "block", "n", "entry", "after", "cost", "edits")])

    def block_maps(rows, blocks):
        for (part, block, n), own in groupby(rows, key=lambda r: r[1:4]):
            blocks.append((part, block, n))
            out: dict[int, Best] = {}
            for *_, entry, state, cost, edits in own:
                out.setdefault(entry, {})[state] = (cost, edits)
            yield out

    def cut(conv, blocks, edits):
        at = 0
        for i, (part, block, n) in enumerate(blocks):
            end = at
            while n:
                n -= edits[end] != "I"
                end += 1
            end = len(edits) if i == len(blocks) - 1 else end
            yield conv, part, block, edits[at:end]
            at = end

    names = ["conv_id", "part", "block", "edits"]
    for conv, rows in groupby(entries(), key=lambda r: r[0]):
        blocks: list[tuple] = []
        edits = settle(block_maps(rows, blocks))
        held = []
        for row in cut(conv, blocks, edits):
            held.append(row)
            if len(held) == 4096:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), (kind[0], pa.int32(), pa.int64(), pa.string()))], names)
                held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), (kind[0], pa.int32(), pa.int64(), pa.string()))], names)


def _order() -> list[Column]:
    return [F.asc_nulls_first(c) for c in ("conv_id", "turn", "role", "text")]


def _long_rows(rows: DataFrame, kind: str) -> DataFrame:
    """Rows of long conversations in order, each block's edits in a row of its own before them."""
    own = ("conv_id", "role", "text")
    signed = rows.withColumns({"sig_a": F.xxhash64(*own), "sig_b": F.xxhash64(F.lit(1), *own)})
    first = F.min(F.struct(F.col("turn").isNotNull().alias("known"), "turn")).alias("first")
    # the earliest turn of texts that come several times; the others need no partner
    firsts = signed.where(~F.col("gone")).groupBy("sig_a", "sig_b").agg(first, F.count("*").alias("n")).where("n > 1")
    turned = signed.join(firsts.drop("n"), ["sig_a", "sig_b"], "left").select(
        "conv_id", "turn", "role", "text", "gone", "fault",
        (F.col("first").isNotNull() & ~F.col("turn").eqNullSafe(F.col("first.turn"))).alias("later"),
        F.when(F.col("first").isNotNull(), F.col("sig_a")).alias("sig_a"),
    )
    ranged = turned.repartitionByRange(*_order()).sortWithinPartitions(*_order())
    placed = ranged.withColumn("part", F.spark_partition_id()).mapInArrow(
        _placed,
        f"conv_id {kind}, turn long, role string, text string, gone boolean, fault string, later boolean, sig_a long, part int, place long",
    )
    placed = stage(placed.withColumn("block", F.floor(F.col("place") / WIDE)), "placed")
    # equal rows of one turn stand side by side, in one part as they are equal
    before = placed.where("sig_a IS NOT NULL AND NOT gone").select(
        "conv_id", "part", (F.col("place") + 1).alias("place"), F.col("sig_a").alias("sig"), F.col("turn").alias("turn_before"), F.col("role").alias("role_before"),
    )
    known = ["conv_id", "part", "place"]
    same = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in known]
    beside = F.col("sig").isNotNull() & (F.col("sig") == F.col("sig_a")) & F.col("turn").eqNullSafe(F.col("turn_before")) & (F.col("role") == F.col("role_before"))
    marked = stage(
        placed.alias("l").join(before.alias("r"), (same[1] & same[2] & same[0]), "left").select(
            "l.conv_id", "l.part", "l.block", "l.place", "turn", "role", "text", "gone", "fault",
            (F.col("later") | beside).alias("repeated"),
        ),
        "marked",
    )
    initial = F.substring("role", 1, 1)
    letter = F.when(initial.isin("s", "u", "a"), initial).otherwise("x")
    code = (
        F.when(F.col("gone"), "")
        .when((F.col("fault") == "b") | F.col("repeated"), "D")
        .when(F.col("fault") == "t", F.upper(letter))
        .otherwise(letter)
    )
    lines = F.array_sort(F.collect_list(F.struct("place", code.alias("code"))))  # WIDE rows at most
    blocks = marked.groupBy("conv_id", "part", "block").agg(
        F.array_join(F.transform(lines, lambda x: x["code"]), "").alias("codes")
    )
    blocks = stage(blocks, "blocks")
    maps = blocks.select("conv_id", "part", "block", "codes").mapInArrow(
        _mapped, f"conv_id {kind}, part int, block long, entry int, after int, cost long, edits string"
    )
    sizes = blocks.select("conv_id", "part", "block", F.length("codes").alias("n"))
    line = [F.asc_nulls_first("conv_id"), "part", "block"]
    same = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in ("conv_id", "part", "block")]
    sized = maps.alias("l").join(sizes.alias("r"), same[1] & same[2] & same[0]).select("l.*", "n")
    edits = (
        sized.repartition("conv_id").sortWithinPartitions(*line)
        .mapInArrow(_settled, f"conv_id {kind}, part int, block long, edits string")
    )
    none = lambda t: F.lit(None).cast(t)
    markers = edits.select(
        "conv_id", none("long").alias("turn"), none("string").alias("role"), none("string").alias("text"),
        F.lit(False).alias("gone"), F.lit("").alias("fault"), F.lit(False).alias("repeated"), "edits",
        "part", "block", F.lit(-1).cast("long").alias("place"),
    )
    rows = marked.select(
        "conv_id", "turn", "role", "text", "gone", "fault", "repeated", none("string").alias("edits"), "part", "block", "place"
    )
    return rows.unionByName(markers).repartition("conv_id").sortWithinPartitions(*line, "place").drop("part", "block", "place")


def _run(rows: DataFrame, summary: bool) -> DataFrame:
    kind = rows.schema["conv_id"].dataType.simpleString()
    fields = f"conv_id {kind}, {SUMMARY if summary else REPAIRED}"
    judged = _judged(rows)
    key = F.xxhash64("conv_id")  # null ids too
    length = F.coalesce(F.octet_length("text"), F.lit(0))
    long = (
        judged.where(~F.col("gone")).groupBy(key.alias("conv_key")).agg(F.count("*").alias("n"), F.sum(length).alias("bytes"))
        .where((F.col("n") > LONG) | (F.col("bytes") > LONG_BYTES)).select("conv_key")
    )
    long = stage(long, "long")
    some = not long.isEmpty()
    short = judged
    if some:
        flagged = likely(judged.withColumn("conv_key", key), long, "conv_key", "is_long").drop("conv_key")
        short = flagged.where(~F.col("is_long")).drop("is_long")
    short = short.repartition("conv_id").sortWithinPartitions(*_order())
    done = short.mapInArrow(_each(False, summary), fields)
    if some:
        longer = _long_rows(flagged.where("is_long").drop("is_long"), kind)
        done = done.unionByName(longer.mapInArrow(_each(True, summary), fields))
    return done


def repair(rows: DataFrame) -> DataFrame:
    """conv_id, place (from 0), turn (null if inserted), edit, role and text of the repaired rows.

    ``rows`` come from ``conversations`` or ``damage``.
    """
    return _run(rows, False)


def report(rows: DataFrame) -> DataFrame:
    """One row per conversation: gaps, faults, cost, audit and repaired_sha256."""
    return _run(rows, True)


def _sql() -> str:
    """The same by dynamic programming over rows and states."""
    steps, ends = [], []
    for state in STATES:
        runs, at, lines = [], state, []
        for n in range(3):  # more insertions in a row never pay
            runs.append((n, at, list(lines)))
            lines.append(f"{ROLES[wanted(at)]}:")
            at = STEPS[at, wanted(at)]
        for n, at, lines in runs:
            quoted = "[" + ", ".join(f"'{x}'" for x in lines) + "]::VARCHAR[]"
            for code in "DsuaxSUAX":
                for edit, cost, then in moves(code, at):
                    if edit != "I":
                        role = f"'{ROLES[wanted(at)]}'" if edit == "R" else "NULL"
                        steps.append(f"({state}, '{code}', '{'I' * n}{edit}', {n * INSERT + cost}, {then}, {quoted}, {role}, {str(edit != 'D').lower()})")
            if at in ACCEPTED:
                ends.append(f"({state}, '{'I' * n}', {n * INSERT}, {quoted})")
    values = lambda rows: ",\n    ".join(rows)
    return f"""
WITH RECURSIVE keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         xor(list_reduce(list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda c: ascii(c)::BIGINT),
             lambda crc, b: list_reduce(range(8), lambda x, i: xor(x // 2, 3988292384 * (x % 2)), xor(crc, b)), 4294967295::BIGINT), 4294967295) % 20 AS pick
  FROM conversations),
damaged AS (
  SELECT conv_id, turn, CASE WHEN pick = 4 THEN 'user' ELSE role END AS role,
         CASE WHEN pick = 1 THEN '' WHEN pick = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(range(CASE WHEN pick = 3 THEN 2 ELSE 1 END)) AS copy
  FROM keyed WHERE pick <> 0),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i FROM damaged),
judged AS (
  SELECT *, CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 'b'
                 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'd'
                 WHEN regexp_replace(text, '[\\x20\\x09-\\x0D]+$', '')[-1] NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault,
         role[1] AS initial, lag(role[1]) OVER (PARTITION BY conv_id ORDER BY i) AS before
  FROM placed),
coded AS MATERIALIZED (
  SELECT *, CASE WHEN fault IN ('b', 'd') THEN 'D' WHEN fault = 't' THEN upper(letter) ELSE letter END AS code
  FROM (SELECT *, CASE WHEN initial IN ('s', 'u', 'a') THEN initial ELSE 'x' END AS letter FROM judged)),
steps(state, code, edits, cost, next, lines, role, stays) AS (VALUES
    {values(steps)}),
ends(state, edits, cost, lines) AS (VALUES
    {values(ends)}),
paths AS (
  SELECT DISTINCT conv_id, 0::BIGINT AS i, 0 AS state, 0::BIGINT AS cost, {{'audit': '', 'lines': []::VARCHAR[]}} AS done FROM conversations
  UNION ALL
  SELECT conv_id, i, state, min(cost) AS cost, arg_min(done, (cost, done.audit)) AS done
  FROM (SELECT p.conv_id, p.i + 1 AS i, s.next AS state, p.cost + s.cost AS cost,
               {{'audit': p.done.audit || s.edits,
                 'lines': list_concat(list_concat(p.done.lines, s.lines),
                                      CASE WHEN s.stays THEN [coalesce(s.role, c.role) || ':' || c.text] ELSE []::VARCHAR[] END)}} AS done
        FROM paths p JOIN coded c ON c.conv_id IS NOT DISTINCT FROM p.conv_id AND c.i = p.i + 1
        JOIN steps s ON s.state = p.state AND s.code = c.code)
  GROUP BY conv_id, i, state),
counts AS (
  SELECT k.conv_id, count(c.i) AS n, coalesce(max(c.turn) - min(c.turn) + 1 - count(DISTINCT c.turn), 0) AS gaps,
         count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated,
         count(*) FILTER (before IS NOT NULL AND (before || initial) NOT IN ('su', 'ua', 'au')) AS illegal
  FROM (SELECT DISTINCT conv_id FROM conversations) k LEFT JOIN coded c ON c.conv_id IS NOT DISTINCT FROM k.conv_id
  GROUP BY k.conv_id),
best AS (
  SELECT p.conv_id, min(p.cost + e.cost) AS cost,
         arg_min({{'audit': p.done.audit || e.edits, 'lines': list_concat(p.done.lines, e.lines)}}, (p.cost + e.cost, p.done.audit || e.edits)) AS done
  FROM paths p JOIN ends e USING (state) JOIN counts k ON k.conv_id IS NOT DISTINCT FROM p.conv_id AND k.n = p.i
  GROUP BY p.conv_id)
SELECT k.conv_id, gaps::BIGINT AS gaps, blank, duplicate, truncated, illegal, cost::BIGINT AS cost, done.audit AS audit,
       sha256(array_to_string(done.lines, chr(10))) AS repaired_sha256
FROM counts k JOIN best b ON b.conv_id IS NOT DISTINCT FROM k.conv_id
"""


SQL = _sql()
