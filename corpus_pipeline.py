"""A corpus pipeline of five stages over `documents`, each stage one operator.

Each function takes (spark, docs, sf_dir) and returns a DataFrame; its rows are written as
Parquet and read again as the next one's `docs`. Every stage but the last returns the columns
of `docs`.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from acreline.llm import mixing, packing, pii, quality, simhash
from acreline.llm.queries import PII_KEY, TOKENIZER, read, ship
from acreline.sources.extracts import shared_dir

#: Documents go when the classifier is this sure that they are bad.
REJECT_BELOW = 0.5


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep what the compression classifier does not reject; it learns from `labels`."""
    model = quality.train(docs, read(spark, sf_dir, "labels"))
    scored = quality.score(docs, model, keep=docs.columns)
    return scored.filter(F.col("_llm_score") >= REJECT_BELOW).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest id of each group of near copies."""
    return simhash.keep_one(docs)


def pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal values; n_chars follows the text."""
    done = pii.pseudonymize(docs, PII_KEY, counts=False)
    return done.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The blocks of words that the mix of sources takes, document by document."""
    return mixing.mixed_texts(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of training sequences; small groups of texts and an encoder for each task, as the workers serve all stages."""
    return packing.pack(docs, public_tokenizers.path(TOKENIZER), group_bytes=1 << 20, task_words=100_000)


STAGES = [("quality classifier", quality_filter), ("near-dedup", near_dedup), ("pii", pseudonyms),
          ("mixing", mix_sources), ("packing", pack_sequences)]

#: Models, hashes and tokenizers are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; what lies between is written below the shared folder."""
    ship(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_dir(spark)}/corpus-{uuid.uuid4().hex[:12]}"
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs.write.parquet(f"{folder}/{k}")
            docs = spark.read.parquet(f"{folder}/{k}")
    return docs
