"""Label maps as tables: any size, checked against the values they are for.

A map has columns ``label`` and ``target``. The maps of ``schemas`` are such tables through
``as_table``; a project's own come from files. Applying one is a join, by broadcast where the map is counted
to be small and by shuffle beyond; values that many tickets share are then counted or split by
the engine, never gathered.

Maps are checked before they are used: ``gaps`` names, by an anti-join each way, labels that
occur without an entry and entries that no label uses, ``uncovered`` targets outside an enumeration and
names of the enumeration that no entry leads to, ``conflicts`` labels with several targets.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import strip

BROADCAST_ROWS = 100_000


class MapError(ValueError):
    """A map that does not cover what it should; the findings have been written."""


def as_table(spark: SparkSession, entries: Mapping[str, str]) -> DataFrame:
    rows = F.array(*(F.struct(F.lit(k).alias("label"), F.lit(v).alias("target")) for k, v in entries.items()))
    return spark.range(1).select(F.inline(rows))


def folded(label: Column) -> Column:
    """Trimmed and in lower case, as priorities are compared."""
    return F.lower(strip(label))


def _small(table: DataFrame, limit: int) -> DataFrame:
    return F.broadcast(table) if table.limit(limit + 1).count() <= limit else table


def conflicts(table: DataFrame) -> DataFrame:
    """label and its targets where there are several."""
    return (
        table.groupBy("label")
        .agg(F.array_sort(F.collect_set("target")).alias("targets"))  # one entry's targets
        .where(F.size("targets") > 1)
    )


def apply_map(
    rows: DataFrame,
    label: Column,
    table: DataFrame,
    name: str,
    default: str | None = None,
    limit: int = BROADCAST_ROWS,
) -> DataFrame:
    """``rows`` with the target of ``label`` as column ``name``.

    Labels without an entry get ``default``, null labels none. Repeated entries count once; of several targets
    of a label the smallest counts (``conflicts`` tells which those are), so rows are never multiplied.
    """
    one = table.where("label IS NOT NULL").groupBy(F.col("label").alias("_label")).agg(F.min("target").alias("_target"))
    out = rows.withColumn("_own", label).join(_small(one, limit), F.col("_own") == F.col("_label"), "left")
    target = F.when(F.col("_own").isNotNull(), F.coalesce("_target", F.lit(default)))
    return out.withColumn(name, target).drop("_own", "_label", "_target")


def gaps(rows: DataFrame, label: Column, table: DataFrame, field: str) -> DataFrame:
    """field, side (``unmapped`` or ``unused``), label and n: rows with a label the map lacks, and entries without rows."""
    counts = rows.select(label.alias("label")).where("label IS NOT NULL").groupBy("label").agg(F.count("*").alias("n"))
    entries = table.select("label").distinct()
    unmapped = counts.join(entries, "label", "left_anti").select(F.lit("unmapped").alias("side"), "label", "n")
    unused = entries.join(counts, "label", "left_anti").select(
        F.lit("unused").alias("side"), "label", F.lit(0).cast("long").alias("n")
    )
    return unmapped.unionByName(unused).select(F.lit(field).alias("field"), "side", "label", "n")


def uncovered(table: DataFrame, names: DataFrame, field: str) -> DataFrame:
    """field, side (``unknown`` targets, ``unreached`` names) and name; ``names`` has a column ``name``."""
    targets = table.select(F.col("target").alias("name")).distinct()
    unknown = targets.join(names, "name", "left_anti").select(F.lit("unknown").alias("side"), "name")
    unreached = names.distinct().join(targets, "name", "left_anti").select(F.lit("unreached").alias("side"), "name")
    return unknown.unionByName(unreached).select(F.lit(field).alias("field"), "side", "name")


def names_of(spark: SparkSession, names: Sequence[str]) -> DataFrame:
    return spark.range(1).select(F.explode(F.array(*map(F.lit, names))).alias("name"))


def check(found: DataFrame, path: str, wrong: Column | None = None) -> None:
    """Write findings as JSON Lines, also when there are none; stop if any is ``wrong`` (all are by default)."""
    found.write.mode("overwrite").json(path)
    if not (found if wrong is None else found.where(wrong)).isEmpty():
        raise MapError(f"label maps do not cover their values: see {path}")
