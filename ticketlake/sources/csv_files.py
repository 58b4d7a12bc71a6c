"""Ticket CSV files of known names, read into raw ticket rows.

Each known name may be one file or a folder of part files, as Spark writes
them. Either way the content is cut into records in parallel.
"""

from __future__ import annotations

import csv

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.labels import lookup
from ..functions.text import ticket_id
from ..operators.canonical import canonicalise
from ..schemas import (
    FILE_VERSIONS,
    GERMAN_ONLY_FILES,
    HEADER_ALIASES,
    TICKET_COLUMNS,
)
from ..storage import stage
from .csv_records import csv_records

CSV_OPTIONS = {"header": True, "multiLine": True, "quote": '"', "escape": '"'}
BAD = "_bad_row"
# a quoted cell with the comma before it
_QUOTED = r'(?s)(^|,)"(?:[^"]|"")*+"'
_BROADCAST_PARTS = 100_000


def _listing(spark: SparkSession, pattern: str) -> DataFrame:
    """Paths under ``pattern``; only names are listed, no content is read."""
    return spark.read.format("binaryFile").load(pattern).select("path")


def csv_names(spark: SparkSession, folder: str) -> DataFrame:
    """Names ending in .csv directly under ``folder``, files and part folders alike."""
    name = F.regexp_extract("path", r"/([^/]+\.csv)(?:/[^/]*)?$", 1)
    try:
        found = _listing(spark, f"{folder.rstrip('/')}/*.csv")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "file string")
    return found.select(name.alias("file")).distinct()


def file_coverage(spark: SparkSession, folder: str) -> DataFrame:
    """file, status: ``known``, ``missing`` (expected only) or ``unknown`` (found only)."""
    names = F.array(*(F.lit(n) for n in FILE_VERSIONS))
    expected = spark.range(1).select(F.explode(names).alias("file"))
    found = csv_names(spark, folder)
    return (
        expected.withColumn("e", F.lit(True))
        .join(found.withColumn("f", F.lit(True)), "file", "full")
        .select(
            "file",
            F.when(F.col("f").isNull(), "missing")
            .when(F.col("e").isNull(), "unknown")
            .otherwise("known")
            .alias("status"),
        )
        .orderBy("file")
    )


def _normalised_header(columns: list[str]) -> list[str]:
    names = [c.lower().strip() for c in columns]
    names = [HEADER_ALIASES.get(c, c) for c in names]
    twice = sorted({c for c in names if names.count(c) > 1})
    if twice:
        raise ValueError(f"header names the same column more than once: {twice}")
    return names


def _file_of(part: Column, paths: dict[str, str]) -> Column:
    """Name of the file a part belongs to; a folder may be called differently."""
    name = F.lit(None).cast("string")
    for file, path in paths.items():
        under = path.rstrip("/").removeprefix("file://").removeprefix("file:")
        hit = part.endswith(under) | F.contains(part, F.lit(under + "/"))
        name = F.when(hit, file).otherwise(name)
    return name


def _headers(headers: DataFrame, paths: dict[str, str]) -> dict[str, list[str]]:
    """Normalised header per file; all parts of a folder must have the same one."""
    found = (
        headers.groupBy(_file_of(F.col("part"), paths).alias("file"))
        .agg(F.min("record").alias("lo"), F.max("record").alias("hi"))
        .collect()
    )
    names = {}
    for r in found:  # one row per file
        if r.lo != r.hi:
            raise ValueError(f"parts of {r.file} differ in their header")
        (cells,) = csv.reader([r.lo.removeprefix("\ufeff")])
        names[r.file] = _normalised_header(cells)
    for file in paths:
        if file not in names:
            raise ValueError(f"{paths[file]} has no header")
    return names


def _cells(names: list[str], wanted: list[str]) -> Column:
    """The wanted columns of ``record`` and whether it has more cells than the header."""
    columns = [*(f"c{i}" for i in range(len(names))), BAD]
    options = {"multiLine": "true", "quote": '"', "escape": '"'}
    # what the parser marks has too few cells, which count as empty, or too many
    bare = F.regexp_replace("record", _QUOTED, "$1")
    too_many = F.length(bare) - F.length(F.replace(bare, F.lit(","))) >= len(names)
    ddl = ", ".join(f"{c} string" for c in columns)
    row = F.from_csv("record", ddl, {**options, "columnNameOfCorruptRecord": BAD})

    def pick(cells: Column) -> Column:
        known = {n: cells[f"c{i}"] for i, n in enumerate(names)}
        none = F.lit(None).cast("string")
        return F.struct(
            *(known.get(n, none).alias(n) for n in wanted),
            (cells[BAD].isNotNull() & too_many).alias(BAD),
        )

    # through a lambda, so that a record is parsed once and not once per column
    return F.transform(F.array(row), pick)[0]


def _read(
    spark: SparkSession, paths: dict[str, str], wanted: list[str] | None = None
) -> DataFrame:
    """file, row_index, the wanted columns and ``_bad_row`` of all files in one pass.

    Without ``wanted`` all columns of the first file are read.
    """
    cut = csv_records(spark, list(paths.values()))
    headers = _headers(cut.headers, paths)
    wanted = wanted or headers[next(iter(paths))]
    # data rows of a part are all its records but the header
    data_rows = F.col("records") - 1
    earlier = F.sum(data_rows).over(Window.partitionBy("file").orderBy("part"))
    offsets = stage(
        cut.parts.withColumn("file", _file_of(F.col("part"), paths)).withColumn(
            "before", earlier - data_rows
        ),
        "csv-parts",
    )
    if offsets.count() <= _BROADCAST_PARTS:
        offsets = F.broadcast(offsets)
    cells = None
    for file, names in headers.items():
        parsed = _cells(names, wanted)
        is_file = F.col("file") == file
        cells = F.when(is_file, parsed) if cells is None else cells.when(is_file, parsed)
    return (
        cut.records.where("rec > 0")
        .join(offsets.drop("records"), "part")
        .withColumn("_cells", cells)
        .select(
            "file",
            (F.col("rec") - 1 + F.col("before")).alias("row_index"),
            *(F.col("_cells")[n].alias(n) for n in [*wanted, BAD]),
        )
    )


def read_rows(spark: SparkSession, path: str) -> DataFrame:
    """All cells as strings under normalised names, with ``row_index`` and ``_bad_row``.

    ``row_index`` counts records from 0 through the file, or through the parts
    of a folder in name order. Rows with fewer cells than the header are filled
    up with empty ones, rows with more are marked bad.
    """
    return _read(spark, {path: path}).drop("file")


def read_ticket_files(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """Known files, given as name -> path, as one table of canonical rows.

    Columns: file, row_index, ticket_id, the ticket's fields, error.
    """
    if not paths:
        raise ValueError("no known ticket file found")
    file, row_index = F.col("file"), F.col("row_index")
    language = F.when(file.isin(GERMAN_ONLY_FILES), "de").otherwise(F.col("language"))
    rows = (
        _read(spark, paths, [c for c in TICKET_COLUMNS if c != "version"])
        .withColumn("language", language)
        .withColumn("version", lookup(FILE_VERSIONS, file))
        .withColumn("ticket_id", ticket_id(file, row_index))
    )
    return canonicalise(rows, malformed=BAD).select(
        "file", "row_index", "ticket_id", *TICKET_COLUMNS, "error"
    )


def read_ticket_file(spark: SparkSession, path: str, name: str) -> DataFrame:
    """One known file as canonical rows."""
    return read_ticket_files(spark, {name: path})


def read_ticket_folder(spark: SparkSession, folder: str) -> DataFrame:
    """Every known file in ``folder``; unknown names are skipped."""
    known = csv_names(spark, folder).where(F.col("file").isin(list(FILE_VERSIONS)))
    names = [r.file for r in known.collect()]  # at most the five known names
    return read_ticket_files(spark, {n: f"{folder.rstrip('/')}/{n}" for n in names})
