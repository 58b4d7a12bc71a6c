"""Token counts by a compiled transducer, without segmenting texts.

A merge-based (BPE) tokenizer is compiled to a deterministic transducer over
characters. Its segmentation has one property this rests on: a sequence of pieces is the
segmentation of its text iff each neighbouring pair is the segmentation of its own two
pieces. So the last piece of every prefix of a text is determined by the prefixes
before it. A state holds the places where a piece may still begin: the characters read
since, the piece that ends there, and the count there relative to now. A transition
carries the change of the token count; the counts along a path add up to the number of
tokens. States are made when first met and kept in a table of bounded size.

Where no piece holds a space after another character, the state after such a
boundary does not depend on what came before. This gives chunks of a text small state
maps: the text before the first boundary (still a function of the entry state), the
count between the boundaries, and the text after the last one (the exit state). State
maps compose associatively, so the chunks of a text are combined by a prefix scan in
any grouping; a chunk without a boundary is its own map, as text, and is read once when all are joined.
Texts of more than LONG bytes are spread as chunks over tasks, the others are scanned
where they are. What a prefix counts need not grow with it (a torn word may take more pieces than the
whole one), so the count of a text is that of the last prefix.

Null texts count as empty: no bytes, no tokens. Repeated rows are counted one by one,
an empty table gives an empty result, and only the id and text columns are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W

SPACE = "▁"
#: characters in a chunk; texts beyond LONG characters are spread over tasks
CHUNK, LONG = 1 << 16, 1 << 20
#: entries of the tables before they are emptied: states of the transducer, words
MAX_STATES, MAX_WORDS = 200_000, 400_000


class Pieces:
    """The merge rules of a sentencepiece BPE model: pieces by score."""

    def __init__(self, model: bytes):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        usable = [
            i
            for i in range(sp.get_piece_size())
            if not (sp.is_unknown(i) or sp.is_control(i) or sp.is_byte(i) or sp.is_unused(i))
        ]
        self.score = {sp.id_to_piece(i): sp.get_score(i) for i in usable}
        # a piece in front of the text that is not there: the model's dummy prefix
        self.prefix = " " if sp.encode("a", out_type=str)[0] == SPACE + "a" else ""
        self.resets = not any(SPACE in p.lstrip(SPACE) for p in self.score)
        if not self.resets or sp.encode("  a ", out_type=str) == sp.encode("a", out_type=str):
            raise ValueError("the model normalises white space; its counts cannot be compiled this way")

    def segment(self, text: str) -> list[str]:
        """The pieces of a short text, by merging the best pair until none is left."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                score = self.score.get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts


class Transducer:
    """States and transitions, made on demand; ``count`` runs it over a text."""

    def __init__(self, model: bytes):
        self.pieces = Pieces(model)
        score = self.pieces.score
        self.alive = {p[:i] for p in score for i in range(1, len(p) + 1)}
        letters = set("".join(score))
        # a letter without a piece of its own costs its bytes
        self.weight = {c: len(c.encode()) for c in letters if c not in score}
        self.known = letters
        self.pairs: dict[tuple[str | None, str], bool] = {}
        self._empty()

    def _empty(self) -> None:
        self.states: dict[tuple, int] = {}
        self.keys: list[tuple] = []
        self.moves: list[dict[str, tuple[int, int]]] = []
        self.start = self._state((("", None, 0),))

    def _state(self, key: tuple) -> int:
        at = self.states.get(key)
        if at is None:
            at = self.states[key] = len(self.keys)
            self.keys.append(key)
            self.moves.append({})
        return at

    def _follows(self, last: str | None, piece: str) -> bool:
        """Whether ``piece`` can be the piece after ``last`` (null: the first one)."""
        found = self.pairs.get((last, piece))
        if found is None:
            want = [piece] if last is None else [last, piece]
            found = self.pairs[last, piece] = self.pieces.segment("".join(want)) == want
            if len(self.pairs) > 1_000_000:
                self.pairs.clear()
        return found

    def _move(self, state: int, c: str) -> tuple[int, int]:
        """The transition of ``state`` on ``c``: next state and emitted count."""
        if c not in self.known:  # never part of a piece: its bytes, and a fresh start
            return self.start, len(c.encode())
        live, here = [], None
        for read, last, count in self.keys[state]:
            now = read + c
            if now not in self.alive:
                continue
            live.append((now, last, count))
            if here is None and (now in self.pieces.score or now in self.weight) and self._follows(last, now):
                here = (now, count + self.weight.get(now, 1))
        piece, count = here
        key = tuple((read, last, n - count) for read, last, n in live) + (("", piece, 0),)
        return self._state(key), count

    def count(self, text: str) -> int:
        """Tokens of ``text``, read from a boundary (spaces written as in the pieces)."""
        if len(self.keys) > MAX_STATES:
            self._empty()
        state, total, moves = self.start, 0, self.moves
        for c in text:
            step = moves[state].get(c)
            if step is None:
                step = moves[state][c] = self._move(state, c)
            state, n = step
            total += n
        return total


class WordCounts(dict):
    """Token count of a word after one space; a transition of the start state on a word."""

    def __init__(self, transducer: Transducer):
        self.transducer = transducer

    def __missing__(self, word: str) -> int:
        if len(self) >= MAX_WORDS:
            self.clear()
        n = self[word] = self.transducer.count(SPACE + word)
        return n


_RUN = re.compile(" +[^ ]+| +$|^[^ ]+")
_BOUNDARY = re.compile("(?<=[^ ]) ")


class Counter:
    """State maps of chunks. A map is (head, count, tail); tail None: no boundary inside."""

    def __init__(self, model: bytes):
        self.transducer = Transducer(model)
        self.words = WordCounts(self.transducer)
        self.prefix = self.transducer.pieces.prefix

    def tokens(self, text: str) -> int:
        """Tokens of a text that begins at a boundary; spaces are plain here."""
        if not text:
            return 0
        if text[0] == " " and "  " not in text and text[-1] != " ":
            return sum(map(self.words.__getitem__, text[1:].split(" ")))
        return sum(self.transducer.count(run.replace(" ", SPACE)) for run in _RUN.findall(text))

    def chunk(self, text: str) -> tuple[str, int, str | None]:
        first = _BOUNDARY.search(text)
        if not first:
            return text, 0, None
        at = first.start()
        last = text.rindex(" ")
        while text[last - 1] == " ":
            last -= 1
        if last <= at:
            return text[:at], 0, text[at:]
        return text[:at], self.tokens(text[at:last]), text[last:]

    def compose(self, a: tuple, b: tuple) -> tuple:
        if b[2] is None:
            return (a[0] + b[0], 0, None) if a[2] is None else (a[0], a[1], a[2] + b[0])
        if a[2] is None:
            return a[0] + b[0], b[1], b[2]
        return a[0], a[1] + self.tokens(a[2] + b[0]) + b[1], b[2]

    def scan(self, maps: list[tuple]) -> list[tuple]:
        """Inclusive prefix scan; pairs are composed first, so it takes log n rounds."""
        if len(maps) < 2:
            return maps
        pairs = [self.compose(maps[i], maps[i + 1]) for i in range(0, len(maps) - 1, 2)]
        sums = self.scan(pairs)
        out = [maps[0]]
        for i in range(1, len(maps)):
            out.append(sums[i // 2] if i % 2 else self.compose(sums[i // 2 - 1], maps[i]))
        return out

    def total(self, state_map: tuple) -> int:
        head, count, tail = state_map
        return self.tokens(head) + count + (self.tokens(tail) if tail else 0)

    def pieces_of(self, text: str) -> list[tuple]:
        """The maps of the chunks of a whole text."""
        if not text:
            return []
        text = self.prefix + text.replace(SPACE, " ")
        return [self.chunk(text[i : i + CHUNK]) for i in range(0, len(text), CHUNK)]

    def join(self, maps: list[tuple]) -> tuple:
        """The last sum of the scan alone; neighbours are composed first, so no text is copied more than log n times."""
        while len(maps) > 1:
            maps = [
                self.compose(maps[i], maps[i + 1]) if i + 1 < len(maps) else maps[i]
                for i in range(0, len(maps), 2)
            ]
        return maps[0]

    def count(self, text: str) -> int:
        maps = self.pieces_of(text)
        return self.total(self.join(maps)) if maps else 0


_counters: dict[bytes, Counter] = {}


def counter(model: bytes) -> Counter:
    """The worker's compiled tokenizer."""
    if model not in _counters:
        _counters[model] = Counter(model)
    return _counters[model]


def _count_texts(shared):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(shared.value)
        for batch in batches:
            for part in W.batches(batch, "text"):
                n = [own.count(t) if t else 0 for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("n_bytes"), pa.array(n, pa.int64())],
                    ["doc_id", "n_bytes", "n_tokens"],
                )

    return rows


def _map_chunks(shared):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(shared.value)
        for batch in batches:
            maps = []
            for text, number in zip(batch.column("text").to_pylist(), batch.column("chunk").to_pylist()):
                text = text.replace(SPACE, " ")
                maps.append(own.chunk(text if number else own.prefix + text))
            columns = [c for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in columns]
                + [pa.array([m[0] for m in maps], pa.string()), pa.array([m[1] for m in maps], pa.int64()), pa.array([m[2] for m in maps], pa.string())],
                [*columns, "head", "n", "tail"],
            )

    return rows


def _join_chunks(shared):
    """One row per text: the maps of its chunks composed in order, and only the whole one totalled."""

    def rows(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        own = counter(shared.value)
        part = part.sort_values("chunk")
        whole = own.join([(h, int(n), t) for h, n, t in zip(part["head"], part["n"], part["tail"])])
        first = part.iloc[0]
        return pd.DataFrame(
            {"doc_id": part["doc_id"][:1], "n_bytes": [first["n_bytes"]], "copies": [first["copies"]], "n_tokens": [own.total(whole)]}
        )

    return rows


def chunk_counts(docs: DataFrame, model: bytes, size: int | None = None) -> DataFrame:
    """doc_id, n_bytes, copies (equal rows) and n_tokens of each text, cut into chunks of ``size`` (LONG) characters.

    The chunks of a text are spread over tasks; only their state maps meet again.
    """
    size = size or LONG
    shared = docs.sparkSession.sparkContext.broadcast(model)
    starts = F.sequence(F.lit(0), F.floor((F.length("text") - 1) / size))
    cut = (
        docs.withColumn("hash", F.xxhash64("text"))
        .groupBy("doc_id", "hash", "n_bytes")
        .agg(F.count("*").alias("copies"), F.first("text").alias("text"))
        .withColumn("chunk", F.explode(starts))
        .withColumn("text", F.expr(f"substring(text, CAST(chunk * {size} + 1 AS INT), {size})"))
        .repartition("doc_id", "chunk")
    )
    maps = cut.mapInArrow(
        _map_chunks(shared),
        "doc_id long, hash long, n_bytes long, copies long, chunk long, head string, n long, tail string",
    )
    return maps.groupBy("doc_id", "hash").applyInPandas(
        _join_chunks(shared), "doc_id long, n_bytes long, copies long, n_tokens long"
    )


def count_tokens(docs: DataFrame, model_path: str, limit: int = 4096,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (more than ``limit`` tokens) of every row."""
    with open(model_path, "rb") as f:  # the tokenizer's own file, installed beside its package
        model = f.read()
    text = F.col(text_col)
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        text.alias("text"),
        F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"),
    )
    shared = docs.sparkSession.sparkContext.broadcast(model)
    short = rows.where(F.col("text").isNull() | (F.col("n_bytes") <= LONG)).mapInArrow(
        _count_texts(shared), "doc_id long, n_bytes long, n_tokens long"
    )
    long = (
        chunk_counts(rows.where(F.col("n_bytes") > LONG), model)
        .withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
        .select("doc_id", "n_bytes", "n_tokens")
    )
    return short.unionByName(long).withColumn("over_limit", F.col("n_tokens") > limit)
