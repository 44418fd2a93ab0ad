"""Corpus preparation: five stages from raw documents to token ids.

Every stage reads all that the one before it kept and is written as Parquet before the next one
starts.  The first four return the columns of ``documents``; the last one returns the mixed corpus as
token ids.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from markbook.llm import bpe, minhash, mixing, pii, toxicity
from markbook.llm.common import in_small_batches, stored, table


#: Percent of shared five-word shingles from which the stage links; the query ``op3`` has its own.
NEAR_COPIES = 80


def drop_toxic(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that compression distance doesn't predict to be toxic."""
    return toxicity.clean(docs, table(spark, folder, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One document of each group of near duplicates, linked from 80 % of their shingles up."""
    return minhash.deduplicated(docs, NEAR_COPIES)


def redact_personal_data(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Personal data in the texts replaced by its kind."""
    return pii.redacted(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Token ids (little-endian unsigned 32-bit), and whether they decode to the text."""
    codec = bpe.Codec(spark, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    kept = [c for c in docs.columns if c not in ("text", "n_tokens", "ids", "exact")]
    coded = in_small_batches(docs).select(F.struct(*(F.col(f"`{c}`") for c in kept)).alias("own"), codec.round_trip("text").alias("coded"))
    return coded.select(
        *(F.col(f"own.`{c}`") for c in kept),
        F.expr("octet_length(coded.ids) div 4").cast("long").alias("n_tokens"),
        "coded.ids",
        "coded.exact",
    )


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_copies),
    ("personal_data", redact_personal_data),
    ("mix_sources", mix_sources),
    ("byte_bpe", encode),
]

#: Hash functions, trained models and tokenizers are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, folder), name)
    return docs
