"""The registered queries of this package and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from velometric.llm import (
    byte_bpe,
    factor_machine,
    html_cut,
    mixing,
    multi_index,
    quality_rules,
    rank_bpe,
    secret_scan,
    sharding,
    simhash,
    spelling,
    strata_rank,
    token_counts,
)
from velometric.llm.common import read_table

VOCABULARY = "word_bpe_49k.json"
RANKS = "byte_bpe_50k.tiktoken"


def documents(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    return read_table(spark, folder, "documents").select(*columns)


def op1_secrets(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder, "doc_id", "text", "source", "lang")
    return secret_scan.digest(secret_scan.scan_secrets(docs))


def op2_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder, "doc_id", "text", "lang", "source")
    return quality_rules.digest(quality_rules.quality_report(docs))


def op3_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.digest(simhash.near_duplicates(documents(spark, folder, "doc_id", "text")))


def op4_multi_index(spark: SparkSession, folder: str) -> DataFrame:
    vectors = read_table(spark, folder, "embeddings").select("vec_id", "embedding")
    return multi_index.search(vectors, multi_index.every_hundredth(vectors))


def op5_bpe(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder, "doc_id", "text")
    return rank_bpe.digest(rank_bpe.round_trip(docs, public_tokenizers.path(VOCABULARY)))


def op6_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.digest(mixing.mix(documents(spark, folder, "doc_id", "text", "source"), carry=["doc_id"]))


def op7_sharding(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.digest(sharding.assign_shards(documents(spark, folder, "doc_id", "text"), 8))


def op8_factor_machine(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder, "doc_id", "text")
    labels = read_table(spark, folder, "labels").select("doc_id", "quality")
    return factor_machine.score_quality(docs, factor_machine.train(docs, labels))


def op9_html(spark: SparkSession, folder: str) -> DataFrame:
    return html_cut.extract_pages(read_table(spark, folder, "pages").select("page_id", "url", "html"))


def op10_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder, "doc_id", "text")
    return token_counts.count_tokens(docs, public_tokenizers.path(VOCABULARY))


def op11_strata_rank(spark: SparkSession, folder: str) -> DataFrame:
    items = read_table(spark, folder, "benchmark").select("item_id", "text")
    return strata_rank.digest(strata_rank.search(documents(spark, folder, "doc_id", "text"), items))


def op12_spelling(spark: SparkSession, folder: str) -> DataFrame:
    return spelling.spelling_variants(documents(spark, folder, "doc_id", "text"))


def op13_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder, "doc_id", "text")
    return byte_bpe.digest(byte_bpe.round_trip(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_secrets, op2_quality, op3_simhash, op4_multi_index, op5_bpe, op6_mixing, op7_sharding, op8_factor_machine,
        op9_html, op10_token_counts, op11_strata_rank, op12_spelling, op13_byte_bpe,
    )
}
