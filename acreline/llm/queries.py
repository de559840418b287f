"""One query per operator over the given tables, and SQL where SQL can state the result."""

from __future__ import annotations

import os
from pathlib import Path

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from acreline.llm import (
    language, lexical, lm, manifest, mixing, packing, pii, quality, sharding, simhash, sketch, token_counts, topk)

TOKENIZER = "word_bpe_49k.json"
#: The pseudonyms' key; a real one comes from the environment and is not kept in code.
PII_KEY = os.environ.get("PII_KEY", "example key")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Let Python workers find this package where the session did not put it on their path."""
    root = str(Path(__file__).resolve().parents[2])
    workers = spark.sparkContext.environment
    if root not in workers.get("PYTHONPATH", "").split(os.pathsep):
        workers["PYTHONPATH"] = os.pathsep.join(p for p in (root, workers.get("PYTHONPATH")) if p)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(read(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = pii.pseudonymize(read(spark, sf_dir, "documents"), PII_KEY)
    return done.select("doc_id", "text", "n_replaced", *[f"n_{k}" for k in pii.KINDS])


def op4_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op5_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(read(spark, sf_dir, "documents"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read(spark, sf_dir, "documents"), width=3, radius=2)
    return found.select("doc_id", simhash.hex_digits("fp").alias("fingerprint"), "component_id")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = sharding.reshard(read(spark, sf_dir, "documents"))
    return plan.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                       F.lit(None).cast("int").alias("grown_shard"), "old_shard", "moved")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    scored = quality.score(docs, quality.train(docs, read(spark, sf_dir, "labels")))
    return scored.select("doc_id", quality.held_out("doc_id").alias("held_out"),
                         F.col("_llm_score").alias("score"),
                         (F.col("_llm_score") >= 0.5).cast("int").alias("predicted"))


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketch.fingerprint_edits(read(spark, sf_dir, "documents"))


def op11_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(read(spark, sf_dir, "documents"))


def op12_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.manifest(read(spark, sf_dir, "documents"))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(read(spark, sf_dir, "benchmark"), read(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (
    op1_token_counts, op2_packing, op3_pii, op4_top_k, op5_lm_scores, op6_simhash, op7_mixing,
    op8_sharding, op9_quality, op10_fingerprints, op11_language, op12_manifest, op13_lexical_search)}
ORACLE_SQL = {"op4_top_k": topk.TOP_K_SQL, "op10_fingerprints": sketch.FINGERPRINT_SQL,
              "op12_manifest": manifest.MANIFEST_SQL, "op13_lexical_search": lexical.SEARCH_SQL}
