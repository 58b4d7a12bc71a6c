"""Prepare: ticket files -> rejects and a balanced, cleaned sample."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.canonical import (
    clean_text,
    filter_languages,
    load_counts,
    rejected_rows,
    valid_rows,
)
from ..operators.dedup import dedup_by_version
from ..operators.sampling import stratified_sample
from ..operators.tables import distribution, top_values
from ..sources.csv_files import file_coverage, read_ticket_folder
from ..sources.tables import read_prepared, write_prepared, write_rejects
from ..storage import stage
from .profile import length_summary


@dataclass
class Prepared:
    """What a run wrote and the summary tables read from it."""

    sample: DataFrame
    coverage: DataFrame
    counts: DataFrame
    languages: DataFrame
    versions: DataFrame
    queues: DataFrame
    lengths: DataFrame


def cleaned_tickets(canonical: DataFrame) -> DataFrame:
    """Valid rows -> one per text -> target languages -> cleaned text.

    Languages are filtered after the dedup: a copy in another language may be
    the one that wins, and then the ticket is gone.
    """
    one = dedup_by_version(valid_rows(canonical), tie=["file", "row_index"])
    return clean_text(filter_languages(one)).drop("file", "row_index")


def prepare(
    spark: SparkSession,
    folder: str,
    out: str,
    rejected_out: str,
    n: int,
    seed: int = 42,
) -> Prepared:
    """Run the job; ``n`` is the sample size."""
    rows = stage(read_ticket_folder(spark, folder), "canonical")
    write_rejects(rejected_rows(rows), rejected_out)
    cleaned = stage(cleaned_tickets(rows), "cleaned")
    write_prepared(stratified_sample(cleaned, n, "queue", seed), out)
    sample = read_prepared(spark, out)
    return Prepared(
        sample=sample,
        coverage=file_coverage(spark, folder),
        counts=load_counts(rows, "file"),
        languages=distribution(sample, "language").orderBy(F.desc("n"), "language"),
        versions=distribution(sample, "version").orderBy(F.desc("n"), "version"),
        queues=top_values(sample, "queue", 10),
        lengths=length_summary(sample),
    )
