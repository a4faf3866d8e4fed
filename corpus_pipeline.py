"""The corpus pipeline: toxicity, near-dedup, decontamination, secrets, packing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import public_tokenizers as tokenizers
from spindex.llm.common import discard, table, written
from spindex.llm.decontamination import remove_benchmark
from spindex.llm.near_copies import drop_near_copies
from spindex.llm.packing import pack
from spindex.llm.secrets import redact_secrets
from spindex.llm.simhash import keep_one
from spindex.llm.toxicity import drop_toxic, train


# Stages such as toxicity and simhash are trained or linked on what came before
# them.  No SQL: hashing, training and packing have no counterpart there.
ORACLE_SQL: str | None = None


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below one half; null and empty texts stay."""
    return drop_toxic(docs, train(docs, table(spark, sf_dir, "labels")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, that of smallest id.

    Equal and almost equal fingerprints go first (op2's operator); of the others,
    no two stay whose 5-word shingles are alike by 0.8 or more, and each that goes
    is alike to one of smaller id.
    """
    return drop_near_copies(written(keep_one(docs), "one_of_each"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without contaminated documents; benchmark spans are cut from the others."""
    return remove_benchmark(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets masked."""
    return redact_secrets(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of every document in windows of 2048 tokens, with their ids."""
    return pack(docs, tokenizers.path("byte_bpe_50k.json"), tokenizers.path("byte_bpe_50k.tiktoken"), tokenizers.PATTERN)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("secrets", secrets),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; each stage's are written and read again before the next, and go when that is written."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, written(stage(spark, docs, sf_dir), name)
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
