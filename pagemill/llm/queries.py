"""Registered queries of the training-data operators, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import adaptive_ann, curriculum_mix, exact_topk, hard_negatives, language_mixture, license_rules, phrase_growth
from . import secret_cnn, semi_markov_pii, simhash_bktree, toxic_automata, transducer_bpe, warc_chunks

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def op1_exact_topk(spark: SparkSession, sf: str) -> DataFrame:
    return exact_topk.top_k(_table(spark, sf, "embeddings"), F.col("vec_id") % exact_topk.QUERY_EVERY == 0)


def op2_semi_markov_pii(spark: SparkSession, sf: str) -> DataFrame:
    return semi_markov_pii.find_pii(_table(spark, sf, "documents"))


def op3_secret_cnn(spark: SparkSession, sf: str) -> DataFrame:
    return secret_cnn.scan_secrets(_table(spark, sf, "documents"))


def op4_warc_chunks(spark: SparkSession, sf: str) -> DataFrame:
    chunks = warc_chunks.archive(_table(spark, sf, "pages"), payload=False)
    return warc_chunks.record_table(chunks)


def op5_language_mixture(spark: SparkSession, sf: str) -> DataFrame:
    return language_mixture.identify(_table(spark, sf, "documents"), full=False)


def op6_license_rules(spark: SparkSession, sf: str) -> DataFrame:
    return license_rules.scan_licenses(_table(spark, sf, "documents"), full=False)


def op7_transducer_bpe(spark: SparkSession, sf: str) -> DataFrame:
    return transducer_bpe.encode(_table(spark, sf, "documents"), full=False)


def op8_adaptive_ann(spark: SparkSession, sf: str) -> DataFrame:
    return adaptive_ann.search(_table(spark, sf, "embeddings"), F.col("vec_id") % adaptive_ann.QUERY_EVERY == 0)


def op9_curriculum_mix(spark: SparkSession, sf: str) -> DataFrame:
    return curriculum_mix.mix_report(_table(spark, sf, "documents"))


def op10_simhash_bktree(spark: SparkSession, sf: str) -> DataFrame:
    found = simhash_bktree.near_duplicates(_table(spark, sf, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op11_hard_negatives(spark: SparkSession, sf: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = _table(spark, sf, "embeddings").withColumn("label", label)
    return hard_negatives.mine(vectors, F.col("vec_id") % hard_negatives.ANCHOR_EVERY == 0)


def op12_phrase_growth(spark: SparkSession, sf: str) -> DataFrame:
    return phrase_growth.collocations(_table(spark, sf, "documents"))


def op13_toxic_automata(spark: SparkSession, sf: str) -> DataFrame:
    documents, labels = _table(spark, sf, "documents"), _table(spark, sf, "labels")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    model = toxic_automata.fit(documents, labels.where(~held_out))
    scored = toxic_automata.score(documents, model)
    return scored.withColumn("held_out", F.coalesce(held_out, F.lit(False)))


def queries() -> dict[str, Query]:
    found = (
        op1_exact_topk,
        op2_semi_markov_pii,
        op3_secret_cnn,
        op4_warc_chunks,
        op5_language_mixture,
        op6_license_rules,
        op7_transducer_bpe,
        op8_adaptive_ann,
        op9_curriculum_mix,
        op10_simhash_bktree,
        op11_hard_negatives,
        op12_phrase_growth,
        op13_toxic_automata,
    )
    return {q.__name__: q for q in found}
