"""Canonical tickets: defaults, normalisation, validation, reject split."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import (
    MAX_CHARS,
    cap_length,
    flat_text,
    is_blank,
    language_code,
    none_if_empty,
    strip,
)
from ..schemas import TARGET_LANGUAGES

EMPTY_TEXT = "subject and body cannot both be empty"
EMPTY_LANGUAGE = "language: must not be empty"
BAD_ROW = "row has more cells than the header"


def _text(name: str, present: bool) -> Column:
    return F.coalesce(F.col(name), F.lit("")) if present else F.lit("")


def canonicalise(df: DataFrame, malformed: str | None = None) -> DataFrame:
    """Normalise raw ticket columns and add ``error``, null for valid rows.

    Columns missing from the input get the same default as empty cells.
    ``malformed`` names a boolean column marking rows the reader could not fit.
    The rules exclude each other, so a row has one message at most.
    """
    own = {"subject", "body", "language", "queue", "priority", "type"}
    keep = [c for c in df.columns if c not in own and c != malformed]
    has = {c: c in df.columns for c in own}
    language = (
        F.coalesce(none_if_empty(F.col("language")), F.lit("unknown"))
        if has["language"]
        else F.lit("unknown")
    )

    def label(name: str) -> Column:
        value = none_if_empty(F.col(name)) if has[name] else F.lit(None).cast("string")
        return value.alias(name)

    subject, body = _text("subject", has["subject"]), _text("body", has["body"])
    # The text rule is only looked at once the single fields are sound. Rules
    # test the raw cells, so filtering on them never repeats the stripping.
    error = (
        F.when(F.col(malformed) if malformed else F.lit(False), BAD_ROW)
        .when(is_blank(language), EMPTY_LANGUAGE)
        .when(is_blank(subject) & is_blank(body), EMPTY_TEXT)
    )
    return df.select(
        *keep,
        strip(subject).alias("subject"),
        strip(body).alias("body"),
        language_code(strip(language)).alias("language"),
        label("queue"),
        label("priority"),
        label("type"),
        error.alias("error"),
    )


def valid_rows(df: DataFrame) -> DataFrame:
    return df.where("error IS NULL").drop("error")


def rejected_rows(df: DataFrame) -> DataFrame:
    """Audit rows: file, row_index, error."""
    return df.where("error IS NOT NULL").select("file", "row_index", "error")


def load_counts(df: DataFrame, by: str) -> DataFrame:
    """Valid and rejected rows per ``by`` value, and in total (null ``by``, is_total)."""
    counts = df.groupBy(by).agg(
        F.count_if(F.col("error").isNull()).alias("n_valid"),
        F.count("error").alias("n_rejected"),
    )
    return counts.rollup(by).agg(
        F.grouping(by).cast("int").alias("is_total"),
        F.coalesce(F.sum("n_valid"), F.lit(0)).alias("n_valid"),
        F.coalesce(F.sum("n_rejected"), F.lit(0)).alias("n_rejected"),
    )


def filter_languages(df: DataFrame, languages=TARGET_LANGUAGES) -> DataFrame:
    return df.where(F.col("language").isin(list(languages)))


def clean_text(df: DataFrame, limit: int = MAX_CHARS) -> DataFrame:
    """Add ``text`` (merged, squeezed, cut at ``limit`` characters) and ``text_length``.

    Empty texts are dropped.
    """
    subject, body = F.col("subject"), F.col("body")
    return (
        df.where(~(is_blank(subject) & is_blank(body)))
        .withColumn("text", flat_text(subject, body))
        .withColumn("text", cap_length(F.col("text"), limit))
        .withColumn("text_length", F.length("text"))
    )


def with_text_length(df: DataFrame) -> DataFrame:
    """Tables written without ``text_length`` get it from ``text``."""
    if "text_length" in df.columns:
        return df
    return df.withColumn("text_length", F.length("text"))
