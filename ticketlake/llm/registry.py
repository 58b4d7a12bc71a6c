"""The registered queries of this subpackage, by name, and their SQL where there is any."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import (
    conversation_repair,
    credentials,
    decontaminate,
    embedding_dedup,
    mixing,
    ngram_join,
    pii,
    quality,
    substring_dedup,
    token_count,
    toxicity,
    url_filter,
    vector_codes,
)
from .common import table

TOKENIZER = "piece_bpe_32k.model"


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers  # names the place of the tokenizer's files

    docs = table(spark, sf_dir, "documents")
    return token_count.count_tokens(docs, public_tokenizers.path(TOKENIZER))


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.dedup(table(spark, sf_dir, "embeddings"))


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op4_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"))


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(table(spark, sf_dir, "documents"), width=3, num=90, den=100)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    kept = substring_dedup.remove(docs, substring_dedup.spans(docs), digest=True)
    return kept.withColumnRenamed("kept", "kept_sha256")


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.digest(decontaminate.mark(docs, table(spark, sf_dir, "benchmark")))


def op11_credentials(spark: SparkSession, sf_dir: str) -> DataFrame:
    return credentials.report(table(spark, sf_dir, "documents"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(table(spark, sf_dir, "embeddings"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    damaged = conversation_repair.damage(table(spark, sf_dir, "conversations"))
    return conversation_repair.report(damaged)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_counts": op1_token_counts,
    "op2_embedding_dedup": op2_embedding_dedup,
    "op3_mix_sources": op3_mix_sources,
    "op4_pii_spans": op4_pii_spans,
    "op5_quality": op5_quality,
    "op6_url_filter": op6_url_filter,
    "op7_ngram_join": op7_ngram_join,
    "op8_toxicity": op8_toxicity,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_decontaminate": op10_decontaminate,
    "op11_credentials": op11_credentials,
    "op12_vector_codes": op12_vector_codes,
    "op13_conversation_repair": op13_conversation_repair,
}

ORACLE: dict[str, str] = {
    "op2_embedding_dedup": embedding_dedup.SQL,
    "op3_mix_sources": mixing.SQL,
    "op6_url_filter": url_filter.SQL,
    "op7_ngram_join": ngram_join.SQL,
    "op9_substring_dedup": substring_dedup.SQL,
    "op10_decontaminate": decontaminate.SQL,
    "op11_credentials": credentials.SQL,
    "op12_vector_codes": vector_codes.SQL,
    "op13_conversation_repair": conversation_repair.SQL,
}
