"""Corpus pipeline: STAGES in order, each written and read again as the next one's documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from brinefield.llm import byte_bpe, exact_dedup, jaccard_join, mixing, toxicity
from brinefield.llm.common import documents, labels, ship, vocabulary
from brinefield.runtime import cut


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below one half, by a model fitted on this stage's own input."""
    ship(spark)
    return toxicity.reject(docs, toxicity.fit(docs, labels(spark, sf_dir)))


def without_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id."""
    ship(spark)
    return exact_dedup.keep_one(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each linked group the smallest doc_id."""
    ship(spark)
    return jaccard_join.keep_one(docs, width=5, percent=80)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as its source's rate takes it."""
    ship(spark)
    return mixing.emit(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids and byte offsets of every row, and a digest of the bytes that they decode to."""
    ship(spark)
    return byte_bpe.round_trip(docs, vocabulary("byte_bpe_50k.tiktoken"))


STAGES = [("toxicity", without_toxic), ("exact_dedup", without_exact_copies), ("jaccard_join", without_near_copies), ("mix", mixed), ("byte_bpe", encoded)]

#: A learned score, link components and token ids are beyond SQL; tests/llm compares the stages after the learned one with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for _, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir))
    return docs
