"""Stored tables: prepared sample, rejects, result records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import REJECT, RESULT


def write_prepared(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def read_prepared(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_rejects(df: DataFrame, path: str) -> None:
    """CSV with a header, also when there are no rejects."""
    df.select(*REJECT.names).write.mode("overwrite").options(
        header=True, quote='"', escape='"'
    ).csv(path)


def read_rejects(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(REJECT).options(
        header=True, multiLine=True, quote='"', escape='"'
    ).csv(path)


def write_results(df: DataFrame, path: str) -> None:
    """JSON Lines, one file per task; null fields are written out."""
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def read_results(spark: SparkSession, path: str, as_array: bool = False) -> DataFrame:
    """Result records from JSON Lines, or from files holding one JSON array each.

    Fields absent from a record are null.
    """
    rows = spark.read.schema(RESULT).option("multiLine", as_array).json(path)
    none = F.array().cast("array<string>")
    return rows.withColumns(
        {
            "clarification_questions": F.coalesce("clarification_questions", none),
            "tools_used": F.coalesce("tools_used", none),
        }
    )
