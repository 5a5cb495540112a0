"""A corpus from `documents` in five stages; each takes what the one before kept.

Each stage gets the whole output of its predecessor, written as Parquet and read again. All but the last return the columns
of documents; the last returns the encoded corpus.

Every stage defines its result for odd rows: null texts are empty and fail the quality rules; null sources, languages and ids
are values like any other; ties between copies go to the least id, nulls last, then to the row's key; equal rows are one class,
of which one stays; very long texts are taken whole; further columns pass through under their names, whatever these are; an
empty table gives empty ones.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from velometric.llm import mixing, quality_rules, rank_bpe, secret_scan, similar_sets
from velometric.llm.common import Scratch, read_table

VOCABULARY = "word_bpe_49k.json"


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality_rules.quality_filter(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of texts with a similarity of 0.8 of their five-word shingles.

    SimHash fingerprints propose pairs, the whole sets confirm them, and an exact check by rare shingles finds what
    fingerprints miss; of a class the least id stays.
    """
    return similar_sets.keep_one(docs, shingle=5, similarity=0.8)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Owner-specific live-looking credentials masked, everything else unchanged."""
    return secret_scan.mask_secrets(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of their source takes them."""
    return mixing.mixed(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packed token ids with what the contract of the encoding asks for."""
    rows = rank_bpe.round_trip(docs, public_tokenizers.path(VOCABULARY))
    return rows.select(
        "doc_id", "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality),
    ("SimHash near-dedup", near_duplicates),
    ("secret scans", secrets),
    ("mixing sources to target weights", mixture),
    ("BPE encoding and decoding", encoded),
]

#: SimHash classes and BPE have no SQL; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark)
    docs = read_table(spark, sf_dir, "documents")
    for place, (_, stage) in enumerate(STAGES):
        before, docs = docs, scratch.keep(stage(spark, docs, sf_dir), f"pipeline-{place}")
        scratch.drop(before)
    return docs
