"""The corpus pipeline: five stages over ``documents``, each written to
Parquet and read again as the next one's input. Needs the subpackage llm."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from wattle.llm import bpe, decontaminate, jaccard, secret_scan, toxicity
from wattle.llm.textkit import table
from wattle.session import scratch_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity score rejects (0.7 or more) go."""
    scored = toxicity.score_documents(docs, table(spark, sf_dir, "labels"),
                                      carry=tuple(c for c in docs.columns if c != "doc_id"))
    return scored.where("predicted = 0").select("doc_id", "carried.*").select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of the Jaccard join the document of the least doc_id
    stays. Rows that share a doc_id are told apart by their texts; rows without
    a doc_id can't be told apart and stay."""
    return jaccard.one_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    found = decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"),
                                        carry=tuple(c for c in docs.columns if c != "doc_id"))
    return found.where("not contaminated").select("doc_id", "carried.*").select(*docs.columns)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets become [SECRET], save values that the counts of owners and
    repositories over all documents prove to be examples; every document stays."""
    return secret_scan.redact(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every text that stayed as tokens."""
    tokens = bpe.encode_texts(docs, public_tokenizers.path("word_bpe_49k.json"), carry=("lang", "source"))
    return tokens.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "carried.*")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("benchmark_decontamination", drop_contaminated),
    ("secret_scan", redact_secrets),
    ("bpe_codec", encode),
]
# Learned scores and a tokenizer's merges are beyond SQL; the tests hold the
# stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared
    folder and read again, so a lost executor costs one stage at most."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
