"""Schemas and fixed values of the index."""

from __future__ import annotations

from pyspark.sql import types as T

# Fixed values of the relevance formulas and of the data model.
SIZE_MALUS = 2000
NORM_FACTOR = 200
DEFAULT_WEIGHT = 10
MAX_WEIGHT = 100
WORD_LENGTH = 50  # words are shorter
FLUSH_IDLE_FACTOR = 60
FLUSH_LIMIT = 10_000
FLUSH_PERIOD_S = 200

HIT = T.StructType([T.StructField("pos", T.IntegerType()), T.StructField("weight", T.ShortType())])
POSTINGS = T.StructType([
    T.StructField("word", T.StringType()), T.StructField("doc_id", T.LongType()), T.StructField("doc_size", T.LongType()),
    T.StructField("tf", T.IntegerType()), T.StructField("sum_w", T.LongType()), T.StructField("hits", T.ArrayType(HIT)),
])
DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("doc_size", T.LongType())])


def should_flush(idle_s: float, n_docs: int, forced: bool = False) -> bool:
    """Whether a word's buffered documents are due to be written."""
    return forced or idle_s * FLUSH_IDLE_FACTOR + n_docs > FLUSH_LIMIT
