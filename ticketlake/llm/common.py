"""Helpers the operators of this subpackage share."""

from __future__ import annotations

import os
import shutil
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

# one bit per residue of an id: 2**25 bits are 4 MB, whatever the number of ids
ID_BITS = 1 << 25


def ship(spark: SparkSession) -> None:
    """Hand the package to the Python workers, unless this session already did.

    On a cluster the package is installed or passed with ``--py-files``.
    """
    sc = spark.sparkContext
    if not any(f.endswith("/ticketlake.zip") for f in sc.listFiles):
        base = os.path.join(tempfile.mkdtemp(prefix="ticketlake-"), "ticketlake")
        sc.addPyFile(shutil.make_archive(base, "zip", ROOT, "ticketlake"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(c: Column) -> Column:
    """A-Z to a-z, nothing else."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def likely(rows: DataFrame, ids: DataFrame, key: str, flag: str = "__likely") -> DataFrame:
    """``rows`` with a flag: false means that ``key`` is not in ``ids``; true that it may be.

    A bit table of the ids (hashes modulo ``ID_BITS``, 4 MB at most whatever
    their number) goes to every task, so nothing is shuffled. Ids far beyond
    ``ID_BITS`` only make the flag true more often.
    """
    bit = F.pmod(F.xxhash64(F.col(key).cast("long")), F.lit(ID_BITS))
    bits = (
        ids.where(F.col(key).isNotNull())
        .select(bit.alias("__bit"))
        .groupBy(F.expr("bitmap_bucket_number(__bit)").alias("__bucket"))
        .agg(F.expr("bitmap_construct_agg(bitmap_bit_position(__bit))").alias("__bits"))
    )
    place = "CAST(bitmap_bit_position(__bit) AS INT)"
    byte = F.conv(F.hex(F.expr(f"substring(__bits, {place} DIV 8 + 1, 1)")), 16, 10).cast("int")
    hit = F.expr(f"(shiftright(__byte, {place} % 8) & 1) = 1")
    return (
        rows.withColumn("__bit", bit)
        .withColumn("__bucket", F.expr("bitmap_bucket_number(__bit)"))
        .join(F.broadcast(bits), "__bucket", "left")
        .withColumn("__byte", byte)
        .withColumn(flag, F.coalesce(hit, F.lit(False)))
        .drop("__bit", "__bucket", "__bits", "__byte")
    )


def among(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """The rows of ``rows`` whose ``key`` is in ``ids``; the others are not shuffled."""
    some = likely(rows, ids, key).where("__likely").drop("__likely")
    return some.join(ids.select(key).distinct(), key, "left_semi")


def as_small(rows: DataFrame, limit: int = 100_000) -> DataFrame:
    """``rows``, broadcast in a join if counted to be at most ``limit``; else joined by shuffle."""
    return F.broadcast(rows) if rows.limit(limit + 1).count() <= limit else rows
