"""A training-corpus pipeline over ``documents``: toxicity, quality rules, near duplicates, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the
next stage's ``docs``; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from veilscan.llm import mixing, order_minhash, packing, quality_rules, registry, toxicity
from veilscan.llm.common import BATCH_ROWS, crc_bucket, table, written

#: Rows that a Python worker is sent at once: texts are long, and five stages share an executor's memory.
ROWS_AT_ONCE = 1_000


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go; it learns from labels outside the held-out quarter."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels").where(crc_bucket("doc_id", 4) != 2))
    return toxicity.keep(docs, model)


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or that the learned list rejects go."""
    rules = quality_rules.fit(docs, table(spark, sf_dir, "labels"))
    return quality_rules.keep(docs, rules)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates the document with the least id stays, once."""
    return order_minhash.keep(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes, in whole or in part, once for each time it takes them."""
    return mixing.keep(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents that the mix holds, and where they lie in the training sequences."""
    return packing.pack(docs, registry.vocabulary("word_bpe_49k.json"))


def _in_small_batches(stage: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """The stage, with the session set to send few rows at once."""

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        spark.conf.set(BATCH_ROWS, str(ROWS_AT_ONCE))
        return stage(spark, docs, sf_dir)

    return run_stage


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", _in_small_batches(drop_toxic)),
    ("quality_rules", _in_small_batches(drop_poor)),
    ("near_duplicates", _in_small_batches(drop_near_duplicates)),
    ("mixing", _in_small_batches(mix_sources)),
    ("packing", _in_small_batches(pack_sequences)),
]

#: Learned models and packing cannot be put in SQL; tests hold the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
