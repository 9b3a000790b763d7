"""A training corpus from raw documents: five stages, each one operator of `pagemill.llm`.

Language identification drops texts without letters and texts in which no
language dominates; near-duplicates keep one document of each group; secrets are
replaced by their kind; the mix repeats, cuts and orders documents by
curriculum; encoding gives each document's token ids. Each stage reads what the
one before wrote. doc_ids that repeat, nulls and extra columns pass as the
operators define it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pagemill.llm import curriculum_mix, language_mixture, secret_cnn, simhash_bktree, transducer_bpe
from pagemill.llm.common import materialise

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language_mixture.keep_identified(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash_bktree.keep_one(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secret_cnn.blank_secrets(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return curriculum_mix.mix(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return transducer_bpe.encode(docs)


STAGES: list[tuple[str, Stage]] = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("secrets", secrets),
    ("mixing", mixing),
    ("encoding", encoding),
]

#: Neither language models, fingerprints nor merges can be stated in SQL; tests compare with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
