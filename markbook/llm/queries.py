"""Registered queries of the corpus operators, with the SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, html_text, language, minhash, mixing, pii, prefix_trie, ranking, simhash, suffix_tree, topk, toxicity
from .common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(function):
    QUERIES[function.__name__] = function
    return function


@query
def op2_mix_sources(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.taken(table(spark, folder, "documents"))


SQL["op2_mix_sources"] = mixing.TAKEN_SQL


@query
def op4_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    codec = bpe.Codec(spark, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return bpe.digests(table(spark, folder, "documents"), codec)


@query
def op9_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.scored(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query
def op8_personal_data(spark: SparkSession, folder: str) -> DataFrame:
    return pii.found(table(spark, folder, "documents"))


@query
def op3_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return minhash.grouped(table(spark, folder, "documents"))


@query
def op1_html_text(spark: SparkSession, folder: str) -> DataFrame:
    return html_text.extracted(table(spark, folder, "pages"))


@query
def op7_language(spark: SparkSession, folder: str) -> DataFrame:
    return language.predicted(table(spark, folder, "documents"))


@query
def op5_near_vectors(spark: SparkSession, folder: str) -> DataFrame:
    return ann.nearest(table(spark, folder, "embeddings"), F.col("vec_id") % 20 == 0)


@query
def op10_exact_top(spark: SparkSession, folder: str) -> DataFrame:
    return topk.nearest(table(spark, folder, "embeddings"), F.col("vec_id") % 100 == 0)


SQL["op10_exact_top"] = topk.NEAREST_SQL


@query
def op6_suffix_tree(spark: SparkSession, folder: str) -> DataFrame:
    return suffix_tree.scored(table(spark, folder, "documents"))


@query
def op13_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.grouped(table(spark, folder, "documents"))


@query
def op12_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    return prefix_trie.nodes(table(spark, folder, "conversations"))


SQL["op12_prefix_trie"] = prefix_trie.NODES_SQL


@query
def op11_ranked_search(spark: SparkSession, folder: str) -> DataFrame:
    return ranking.ranked(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


SQL["op11_ranked_search"] = ranking.RANKED_SQL
