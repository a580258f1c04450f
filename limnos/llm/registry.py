"""Queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import balls, bpe, digests, hmm, jaccard, latent, merkle, quality, secrets, sharding, toxicity, web_queries
from .common import table


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(table(spark, sf_dir, "documents"))


def op1_hidden_markov(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.score_texts(table(spark, sf_dir, "documents"))


def op3_forest_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.findings(table(spark, sf_dir, "documents"), secrets.Forest.standard(spark))


def op4_weak_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_chunked_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(bpe.encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")))


def op6_external_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.digests(sharding.written_shards(sharding.shuffle_records(table(spark, sf_dir, "documents"), shards=8)))
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_join(table(spark, sf_dir, "documents"), size=4, percent=85)


def op7_latent_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latent.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_ball_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return balls.clusters(*balls.ball_kmeans(table(spark, sf_dir, "embeddings")))


def op12_digest_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests.exact_duplicates(table(spark, sf_dir, "documents"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return merkle.checked(merkle.Manifest(docs, forged=merkle.seventh(docs["doc_id"])))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_hidden_markov": op1_hidden_markov,
    "op2_dated_lists": web_queries.op2_dated_lists,
    "op3_forest_secrets": op3_forest_secrets,
    "op4_weak_toxicity": op4_weak_toxicity,
    "op5_chunked_bpe": op5_chunked_bpe,
    "op6_external_shuffle": op6_external_shuffle,
    "op7_latent_decontamination": op7_latent_decontamination,
    "op8_revisits": web_queries.op8_revisits,
    "op9_quality_rules": op9_quality_rules,
    "op10_ngram_jaccard": op10_ngram_jaccard,
    "op11_ball_kmeans": op11_ball_kmeans,
    "op12_digest_index": op12_digest_index,
    "op13_merkle_manifest": op13_merkle_manifest,
}

SQL: dict[str, Callable[[], str]] = {
    "op2_dated_lists": web_queries.op2_sql,
    "op8_revisits": web_queries.op8_sql,
    "op9_quality_rules": quality.oracle,
    "op10_ngram_jaccard": lambda: jaccard.oracle(size=4, percent=85),
    "op11_ball_kmeans": balls.oracle,
    "op12_digest_index": digests.oracle,
    "op13_merkle_manifest": merkle.oracle,
}
