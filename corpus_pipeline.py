"""From raw documents to a training mix: five stages, each one of the corpus operators.

A stage takes (spark, docs, sf_dir) and returns its rows. All but the last return the
columns of ``documents``, so each can be written as Parquet and read as the next one's
input. The last returns what the mix takes of each document that is left.

The operators see id and text only; a document's other columns go with it in a struct, so
they may have any name and keep their values. Null texts count as empty; an empty table gives an empty
result at every stage; very long texts are treated like others. What a stage does with repeated rows, and
with empty texts, is said there.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ticketlake.llm import decontaminate, mixing, ngram_join, pii, quality
from ticketlake.llm.common import likely, ship, table
from ticketlake.storage import stage

# The classifier and the 64-bit token sets have no SQL form.
ORACLE_SQL = None


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _apart(stage_of: Stage) -> Stage:
    """The stage over doc_id, text and one struct of all other columns, which are put back after it."""

    @wraps(stage_of)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        others = [c for c in docs.columns if c not in ("doc_id", "text")]
        packed = F.struct(*(F.col(f"`{c}`") for c in others)) if others else F.lit(0)
        kept = stage_of(spark, docs.select("doc_id", "text", packed.alias("others")), sf_dir)
        back = {c: F.col("others").getField(c).alias(c) for c in others}
        return kept.select(*(back.get(c, F.col(c)) for c in docs.columns))

    return run


@_apart
def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the quality classifier rejects.

    Empty texts are scored like others, repeated rows each; without labels of both kinds all get
    the labels' share.
    """
    ship(spark)
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, model).where(F.col("__score") >= quality.CUT).select(*docs.columns)


@_apart
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest id, of each group linked by five-word shingles.

    Texts without words are linked with nothing and stay. Documents with a null id stay, as nothing can be
    said about them. Of rows that share an id one stays: the one with the smallest hash of its columns.
    """
    ship(spark)
    groups = ngram_join.join(docs, width=5, num=80, den=100)
    gone = stage(groups.where("doc_id <> component_id").select("doc_id").distinct(), "gone")
    repeated = (
        docs.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id")
    )
    touched = stage(gone.unionByName(repeated), "touched")
    flagged = likely(docs, touched, "doc_id")  # the others are not shuffled
    left = (
        flagged.where("__likely AND doc_id IS NOT NULL")
        .join(gone, "doc_id", "left_anti")
        .groupBy("doc_id")
        .agg(F.min_by(F.struct("text", "others"), F.xxhash64("text", "others")).alias("one"))
        .select("doc_id", "one.text", "one.others")
    )
    others = flagged.where("NOT __likely OR doc_id IS NULL")
    return others.select(*docs.columns).unionByName(left.select(*docs.columns))


@_apart
def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that hold a window of a benchmark item.

    Texts without words hold none; repeated rows are judged each.
    """
    ship(spark)
    marked = decontaminate.mark(docs, table(spark, sf_dir, "benchmark"))
    return marked.where(F.size("__spans") == 0).select(*docs.columns)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """With each identifier in the text replaced by its kind, and n_chars to match.

    Null and empty texts stay as they are; repeated rows are treated each.
    """
    ship(spark)
    masked = pii.mask(docs)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        masked = masked.withColumn("n_chars", F.length("text").cast(kind))
    return masked.select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target, taken, source of every document left.

    Documents without words are returned with nothing taken, repeated rows each; null sources are one source.
    """
    return mixing.mix(docs)


STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", drop_near_duplicates),
    ("decontaminate", drop_contaminated),
    ("pii", mask_personal_data),
    ("mix", mix_sources),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``; each result but the last is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, apply in STAGES[:-1]:
        docs = stage(apply(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
