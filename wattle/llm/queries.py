"""The queries that apply the operators to the supplied tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from wattle.llm import (
    ann,
    automaton_dedup,
    bpe,
    conversations,
    decontaminate,
    html_text,
    jaccard,
    merkle,
    pii,
    secret_scan,
    suffix_dedup,
    toxicity,
    urls,
)
from wattle.llm.textkit import table


def op1_collision_counting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"))


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_pages(table(spark, sf_dir, "pages"))


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan_secrets(table(spark, sf_dir, "documents")).drop("live", "key")


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge_urls(table(spark, sf_dir, "pages"))


def op6_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_texts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(table(spark, sf_dir, "documents"),
                                       table(spark, sf_dir, "benchmark")).drop("spans")


def op9_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeated_bytes(table(spark, sf_dir, "documents")).drop("kept")


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return automaton_dedup.remove_repeated_words(table(spark, sf_dir, "documents")).drop("kept")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repair_damaged(table(spark, sf_dir, "conversations"))


def op12_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_personal_data(table(spark, sf_dir, "documents")).drop("found")


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.merkle_manifest(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_collision_counting, op2_html_extraction, op3_ngram_jaccard_join, op4_secret_scan,
                              op5_url_filter, op6_bpe_codec,
                              op7_toxicity, op8_benchmark_decontamination,
                              op9_suffix_array_dedup, op10_substring_dedup,
                              op11_conversation_repair, op12_personal_data, op13_merkle_manifest)
}
