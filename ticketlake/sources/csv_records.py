"""CSV files cut into records in parallel, line breaks inside cells included.

Spark's own reader gives a whole file to one task once cells may hold line
breaks. Here files are read as splittable text. Whether a line starts inside a
quoted cell depends on all lines before it, so each line is first described by
what it does to that state: keep it, flip it, or set it. The lines of a block of the
file (one input split) come to one task in order, which composes these effects for
both possible opening states as they pass; composing the few block summaries then
settles which opening state each block really has, and how many records come before
it. Records of one line are complete at this point and never shuffled; only the lines
of records with line breaks are brought together.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..storage import stage

_BROADCAST_BLOCKS = 100_000

# A cell is quoted only if the quote comes first; quotes elsewhere are text.
# Possessive throughout, so long lines neither backtrack nor recurse.
_IN_QUOTES = r'[^"]*+(?:""[^"]*+)*+'
_CELLS = rf'(?:(?:"{_IN_QUOTES}"[^,]*+|[^",][^,]*+|),)*+'
_OPENS = rf'^{_CELLS}"{_IN_QUOTES}$'
_STAYS_OPEN = rf"^{_IN_QUOTES}$"
_REOPENS = rf'^{_IN_QUOTES}"[^,]*+,{_CELLS}"{_IN_QUOTES}$'


def _inside_after(line: Column) -> tuple[Column, Column]:
    """Whether a line ends inside a quoted cell, if it starts outside / inside one."""
    quoted = F.contains(line, F.lit('"'))

    def matches(pattern: str) -> Column:
        return F.regexp_like(line, F.lit(f"(?s){pattern}"))

    outside = quoted & matches(_OPENS)
    inside = ~quoted | matches(_STAYS_OPEN) | matches(_REOPENS)
    return outside, inside


def _composed(window, opening: bool) -> Column:
    """State before the current row, given the state at the start of the window.

    A row with after_out = after_in sets the state, otherwise ``flip`` tells
    whether it turns it over.
    """
    earlier = window.rowsBetween(Window.unboundedPreceding, -1)
    last_set = F.last(F.col("set"), ignorenulls=True).over(earlier)
    flips = F.coalesce(F.sum("flip").over(earlier), F.lit(0))
    since = flips - F.coalesce(last_set["flips"], F.lit(0))
    base = F.coalesce(last_set["state"], F.lit(int(opening)))
    return (base + since) % 2 == 1


def _with_effect(df: DataFrame, window) -> DataFrame:
    """Describe each row by ``set`` (state and flips so far) or ``flip`` (0/1)."""
    sets = F.col("after_out") == F.col("after_in")
    flips = F.sum("flip").over(window.rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn(
        "flip", (F.col("after_out") & ~F.col("after_in")).cast("int")
    ).withColumn(
        "set",
        F.when(
            sets,
            F.struct(F.col("after_out").cast("int").alias("state"), flips.alias("flips")),
        ),
    )


LINES = (
    "part string, block long, at long, value string, "
    "in_0 boolean, in_1 boolean, end_0 boolean, end_1 boolean, n_0 long, n_1 long"
)


class _Opening:
    """State and record count of a block while its lines pass, for one opening state."""

    def __init__(self, inside: bool):
        self.inside, self.records = inside, 0

    def pass_lines(self, after_out: np.ndarray, after_in: np.ndarray, blank: np.ndarray):
        """Inside before and after each line, and records begun up to and with it."""
        place = np.arange(len(blank))
        flip = after_out & ~after_in
        flips = np.cumsum(flip)
        # the last line so far that fixes the state, whatever it was
        fixed = np.maximum.accumulate(np.where(after_out == after_in, place, -1))
        base = np.where(fixed >= 0, after_out[fixed], self.inside)
        since = flips - np.where(fixed >= 0, flips[fixed], 0)
        end = base ^ (since % 2 == 1)
        before = np.append(self.inside, end[:-1])
        n = self.records + np.cumsum(~before & ~blank)
        self.inside, self.records = bool(end[-1]), int(n[-1])
        return before, end, n


def _numbered_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now, openings = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        flags = [
            batch.column(c).to_numpy(zero_copy_only=False) for c in ("after_out", "after_in", "blank")
        ]
        blocks = batch.column("block").to_numpy()
        parts = batch.column("part").dictionary_encode()
        part = parts.indices.to_numpy()
        names = parts.dictionary.to_pylist()
        edges = np.flatnonzero((np.diff(blocks) != 0) | (np.diff(part) != 0)) + 1
        done = []
        for lo, hi in zip([0, *edges], [*edges, len(blocks)]):
            key = (names[part[lo]], blocks[lo])
            if key != now:
                now, openings = key, [_Opening(False), _Opening(True)]
            cut = [f[lo:hi] for f in flags]
            (in_0, end_0, n_0), (in_1, end_1, n_1) = (o.pass_lines(*cut) for o in openings)
            done.append((in_0, in_1, end_0, end_1, n_0, n_1))
        added = [pa.array(np.concatenate(x)) for x in zip(*done)]
        kept = [batch.column(c) for c in ("part", "block", "at", "value")]
        yield pa.RecordBatch.from_arrays(kept + added, [c.split()[0] for c in LINES.split(", ")])


def _described_lines(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Every line with its state and record count under both opening states.

    Nothing is shuffled: a block is read by one task from its first line to its last.
    """
    outside, inside = _inside_after(F.col("value"))
    # paths come percent-encoded, a plus sign standing for itself
    encoded = F.replace("_metadata.file_path", F.lit("+"), F.lit("%2B"))
    lines = (
        spark.read.option("lineSep", "\n")
        .text(list(paths))
        .select(
            F.url_decode(encoded).alias("part"),
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("at"),
            "value",
            outside.alias("after_out"),
            inside.alias("after_in"),
            (F.btrim("value", F.lit(" \t\r")) == "").alias("blank"),
        )
    )
    return lines.mapInArrow(_numbered_lines, LINES)


def _block_offsets(lines: DataFrame) -> DataFrame:
    """part, block, opening state, records before the block, and in the whole part."""
    in_part = Window.partitionBy("part").orderBy("block")
    last = F.max_by(F.struct("end_0", "end_1", "n_0", "n_1"), "at")
    blocks = (
        lines.groupBy("part", "block")
        .agg(last.alias("l"))
        .select(
            "part",
            "block",
            F.col("l.end_0").alias("after_out"),
            F.col("l.end_1").alias("after_in"),
            F.col("l.n_0").alias("n_0"),
            F.col("l.n_1").alias("n_1"),
        )
    )
    opened = _with_effect(blocks, in_part).withColumn(
        "opening", _composed(in_part, False)
    )
    own = F.when(F.col("opening"), F.col("n_1")).otherwise(F.col("n_0"))
    counted = opened.withColumn("own", own).withColumn(
        "records", F.sum("own").over(Window.partitionBy("part"))
    )
    before = F.sum("own").over(in_part) - F.col("own")
    ends_open = F.when(F.col("opening"), F.col("after_in")).otherwise(F.col("after_out"))
    return counted.select(
        "part",
        "block",
        "opening",
        before.alias("before"),
        "records",
        ends_open.alias("ends_open"),
    )


def _records(lines: DataFrame, blocks: DataFrame) -> DataFrame:
    """part, rec, record; blank lines between records are left out."""
    opening = F.col("opening")
    inside = F.when(opening, F.col("in_1")).otherwise(F.col("in_0"))
    ends = F.when(opening, F.col("end_1")).otherwise(F.col("end_0"))
    number = F.when(opening, F.col("n_1")).otherwise(F.col("n_0"))
    placed = lines.join(blocks, ["part", "block"]).select(
        "part",
        (F.col("before") + number - 1).alias("rec"),
        "block",
        "at",
        "value",
        inside.alias("inside"),
        ends.alias("ends"),
        (F.btrim("value", F.lit(" \t\r")) == "").alias("blank"),
    )
    whole = placed.where("NOT inside AND NOT ends AND NOT blank").select(
        "part", "rec", F.col("value").alias("text")
    )
    line = F.struct("block", "at", "value")
    text = F.array_join(
        F.transform(F.array_sort(F.collect_list(line)), lambda x: x["value"]), "\n"
    )
    # inside a record, or opening one that goes on
    joined = placed.where("inside OR ends").groupBy("part", "rec").agg(text.alias("text"))
    return whole.unionByName(joined).select(
        "part", "rec", F.regexp_replace("text", r"\r\z", "").alias("record")
    )


@dataclass
class CsvRecords:
    """Records of CSV files.

    ``records`` is (part, rec, record): the text of each record and its number
    in its file from 0, the header. ``headers`` holds the records numbered 0.
    ``parts`` is (part, records), the number of records per file.
    """

    records: DataFrame
    headers: DataFrame
    parts: DataFrame


def csv_records(spark: SparkSession, paths: Sequence[str]) -> CsvRecords:
    """Cut files, or folders of files, into records.

    Blank lines between records are skipped. A file that ends inside a quoted
    cell is an error.
    """
    lines = stage(_described_lines(spark, paths), "csv-lines")
    blocks = stage(_block_offsets(lines), "csv-blocks")
    seen = (
        blocks.groupBy("part")
        .agg(
            F.count("*").alias("n"),
            F.max_by("ends_open", "block").alias("open"),
            F.max(F.when(F.col("before") <= 1, F.col("block"))).alias("head"),
        )
        .agg(
            F.sum("n").alias("n"),
            F.max(F.when(F.col("open"), F.col("part"))).alias("open"),
            F.max("head").alias("head"),
        )
        .first()
    )
    if seen.open:
        raise ValueError(f"{seen.open} ends inside a quoted cell")
    parts = blocks.select("part", "records").distinct()
    if (seen.n or 0) <= _BROADCAST_BLOCKS:
        blocks = F.broadcast(blocks)
    # the stored lines are clustered by block, so this reads the first ones only
    first_blocks = lines.where(F.col("block") <= (seen.head or 0))
    return CsvRecords(
        records=_records(lines, blocks),
        headers=_records(first_blocks, blocks).where("rec = 0"),
        parts=parts,
    )
