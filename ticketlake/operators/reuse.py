"""Model scores per distinct text: equal texts are scored once, and never again where a store holds their score.

Texts are told apart by their MD5 digest (128 bits). The digests of all rows are folded map-side, so copies of
one text leave a row per task; those the store knows are taken out by an anti-join, and only the
texts of the rest meet the model, one of each, sorted by length within a task so that a batch holds texts of about
one size. Scores go back to the rows by digest: ids, digests and scores move, texts do not.
A digest that many rows share is spread over ``SALTS`` partitions on its way back.

Null texts have no score and are not sent to the model. Rows that repeat an id are scored each.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..storage import stage

#: rows of one text beyond which its digest is salted, and over how many partitions
HOT, SALTS = 100_000, 32
#: digests that go to every task instead of being joined by shuffle
BROADCAST_ROWS = 100_000


def text_digest(text: Column) -> Column:
    """16 bytes; null for a null text."""
    return F.unhex(F.md5(text.cast("binary")))


class ScoreStore:
    """Scores by model and digest, kept in Parquet below ``path``; runs only ever add to it."""

    def __init__(self, spark: SparkSession, path: str, model: str, kind: T.DataType):
        self.spark, self.kind = spark, kind
        self.path = f"{path.rstrip('/')}/model={model}"

    def _exists(self) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path)

    def read(self) -> DataFrame:
        """digest, score; one row per digest, also where two runs scored a text at the same time."""
        schema = T.StructType([T.StructField("digest", T.BinaryType()), T.StructField("score", self.kind)])
        if not self._exists():
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(schema).option("recursiveFileLookup", True).parquet(self.path)
        return rows.dropDuplicates(["digest"])

    def add(self, scores: DataFrame) -> DataFrame:
        """Write ``scores`` as a folder of their own; a run that fails leaves nothing that is read."""
        folder = f"{self.path}/run={uuid.uuid4().hex}"
        scores.write.parquet(folder)
        return self.spark.read.schema(scores.schema).parquet(folder)


def _small(rows: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``rows``, a stored table, marked for broadcast if it holds at most ``limit``."""
    return F.broadcast(rows) if rows.limit(limit + 1).count() <= limit else rows


def score_texts(
    rows: DataFrame,
    model,
    kind: T.DataType,
    store: ScoreStore | None = None,
    id_col: str = "ticket_id",
    text_col: str = "text",
    score_col: str = "score",
    hot: int = HOT,
) -> DataFrame:
    """(id, score) of every row; ``model`` is a UDF of ``functions.scorers``, ``kind`` what it returns.

    The model sees each distinct text once that ``store`` has no score of, and nothing else. What it
    gives is stored before it is joined, so later passes and lost executors do not call it again.
    """
    keyed = rows.select(F.col(id_col), text_digest(F.col(text_col)).alias("digest"), F.col(text_col).alias("text"))
    counts = stage(
        keyed.where("digest IS NOT NULL").groupBy("digest").agg(F.count("*").alias("n")), "digests"
    )
    known = store.read() if store else None
    new = counts.select("digest")
    if known is not None:
        new = stage(new.join(known, "digest", "left_anti"), "new-digests")
    # one text of each; where all digests are new there is nothing to look up
    texts = keyed.where("digest IS NOT NULL").select("digest", "text")
    if known is not None:
        texts = texts.join(_small(new), "digest", "left_semi")
    one = texts.groupBy("digest").agg(F.first("text").alias("text"))
    fresh = one.sortWithinPartitions(F.length("text")).select("digest", model("text").alias("score"))
    fresh = store.add(fresh) if store else stage(fresh, "scores")
    scores = fresh if known is None else fresh.unionByName(known.join(_small(counts), "digest", "left_semi").select("digest", "score"))
    return _joined(keyed.select(id_col, "digest"), scores, counts, id_col, hot).select(
        id_col, F.col("score").cast(kind).alias(score_col)
    )


def _joined(rows: DataFrame, scores: DataFrame, counts: DataFrame, id_col: str, hot: int) -> DataFrame:
    """Rows with their digest's score; hot digests are salted by the row's id."""
    often = counts.where(F.col("n") > hot).select("digest", F.lit(True).alias("often"))
    if often.isEmpty():
        return rows.join(scores, "digest", "left")
    often = _small(often)
    salt = F.pmod(F.xxhash64(id_col), F.lit(SALTS))
    spread = rows.join(often, "digest", "left").withColumn("salt", F.when(F.col("often"), salt).otherwise(F.lit(0).cast("long")))
    every = F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))
    copies = scores.join(often, "digest", "left").withColumn(
        "salt", F.explode(F.when(F.col("often"), every).otherwise(F.array(F.lit(0).cast("long"))))
    )
    return spread.drop("often").join(copies.drop("often"), ["digest", "salt"], "left")
