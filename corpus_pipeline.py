"""Training-data pipeline: each stage is one operator, written as Parquet and read again by the next."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from waymark.durable import remove, shared_folder
from waymark.llm import decontaminate, jaccard, packing, secrets, toxicity
from waymark.llm.common import table
from waymark.shipping import ship


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier rejects go."""
    ship(spark)
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the one with the smallest id."""
    ship(spark)
    return jaccard.keep_one_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that repeat benchmark passages go."""
    ship(spark)
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced in the texts; every document stays."""
    words = secrets.word_list(public_tokenizers.path("word_bpe_49k.json"))
    return secrets.redact(docs, secrets.train(secrets.seed_findings(spark), words=words), path="source", words=words)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' token pieces and their places in training sequences."""
    ship(spark)
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_copies),
    ("benchmark_decontamination", drop_contaminated),
    ("secret_scan", redact_secrets),
    ("best_fit_packing", pack_sequences),
]

#: SQL cannot express the classifiers and the tokenizer; the stages are tested one by one against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each result is written to the shared folder of spark.checkpoint.dir.

    A stage's folder goes once the next stage has written its own, so a run leaves
    its last one; a run that failed leaves one, and the next run has folders of its own.
    """
    shared, last = shared_folder(spark), None
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        at = f"{shared}/pipeline-{uuid.uuid4().hex}-{k}"
        stage(spark, docs, sf_dir).write.parquet(at)
        docs = spark.read.parquet(at)
        if last:
            remove(spark, last)
        last = at
    return docs
