"""One ticket per text over many loads, kept bucketed by text so that a new load alone is shuffled.

A store holds a folder per load, each the whole deduplicated table after that load, bucketed
and sorted by the MD5 digest of (subject, body). Merging a load joins it with the last
folder on the digest: the stored side is read bucket by bucket without an exchange, the new side
is shuffled into the same buckets, and the result is written bucket by bucket. A folder counts once it is
written completely, so a load that fails leaves the store as it was.
"""

from __future__ import annotations

from collections.abc import Sequence
from hashlib import md5

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.labels import version_rank
from ..operators.dedup import dedup_by_version

KEY = "text_key"


def text_key(subject: Column, body: Column) -> Column:
    """Digest of both texts; a length keeps them apart, and null from empty."""
    part = lambda c: F.concat(F.coalesce(F.length(c).cast("string"), F.lit("-")), F.lit(":"), F.coalesce(c, F.lit("")))
    return F.md5(F.concat(part(subject), part(body)).cast("binary"))


class TicketStore:
    """``buckets`` is fixed when the store is made; a bucket should fit a task's memory."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 200, tie: Sequence[str] = ("file", "row_index")):
        self.spark, self.path, self.buckets, self.tie = spark, path.rstrip("/"), buckets, list(tie)

    def _folders(self) -> list[str]:
        hadoop = self.spark.sparkContext._jsc.hadoopConfiguration()
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        files = path.getFileSystem(hadoop)
        found = [s.getPath() for s in files.listStatus(path)] if files.exists(path) else []
        done = [p for p in found if files.exists(self.spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
        return sorted(p.toString() for p in done)

    def _table(self, folder: str) -> DataFrame:
        """The folder as a bucketed table of this session's catalog."""
        name = f"tickets_{md5(folder.encode()).hexdigest()}"
        columns = self.spark.read.parquet(folder).schema.toDDL()
        self.spark.sql(
            f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet "
            f"CLUSTERED BY ({KEY}) SORTED BY ({KEY}) INTO {self.buckets} BUCKETS LOCATION '{folder}'"
        )
        return self.spark.table(name)

    def tickets(self) -> DataFrame:
        """The tickets after the last load."""
        folders = self._folders()
        if not folders:
            raise ValueError(f"no load is complete in {self.path}")
        return self._table(folders[-1]).drop(KEY)

    def merged(self, load: DataFrame) -> DataFrame:
        """What is stored and ``load`` as one: of a text in both the higher version stays, then the lower tie."""
        keyed = dedup_by_version(load, self.tie).withColumn(KEY, text_key(F.col("subject"), F.col("body")))
        folders = self._folders()
        if not folders:
            return keyed
        names = load.columns
        own = F.struct(*names)
        order = lambda side: F.struct((-version_rank(F.col(f"{side}.version"))).alias("rank"), *(F.col(f"{side}.{c}") for c in self.tie))
        stored = self._table(folders[-1]).select(KEY, own.alias("old"))
        both = stored.join(keyed.select(KEY, own.alias("new")), KEY, "full_outer")
        stays = F.col("new").isNull() | (F.col("old").isNotNull() & (order("old") <= order("new")))
        kept = both.select(KEY, F.when(stays, F.col("old")).otherwise(F.col("new")).alias("kept"))
        return kept.select(*(F.col(f"kept.{c}") for c in names), KEY)

    def add(self, load: DataFrame) -> DataFrame:
        """Merge valid rows of a load into the store; the tickets after it."""
        folders = self._folders()
        number = int(folders[-1].rpartition("=")[2]) + 1 if folders else 0
        folder = f"{self.path}/load={number:06d}"
        name = f"writing_{md5(folder.encode()).hexdigest()}"
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        rows = self.merged(load)
        if not folders:
            rows = rows.repartition(self.buckets, KEY)
        writer = rows.write.format("parquet").bucketBy(self.buckets, KEY).sortBy(KEY)
        writer.option("path", folder).mode("overwrite").saveAsTable(name)
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")  # the files stay
        return self.tickets()
