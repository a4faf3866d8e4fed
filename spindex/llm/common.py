"""Shared plumbing of the training-data operators."""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from spindex.sources.files import delete
from spindex.sources.folders import shared_dir

#: Rows and bytes in one Arrow batch handed to Python; they bound a worker's
#: memory by a few hundred texts, or one text that is larger, whatever the partition's size.
BATCH_ROWS, BATCH_BYTES = 400, 16 << 20


def bounded_batches(spark: SparkSession, rows: int = BATCH_ROWS, size: int = BATCH_BYTES) -> None:
    """Hand Python at most `rows` rows, or about `size` bytes, at once.

    Never raises a lower setting.  Spark reads these when a plan is run, after
    the operator has returned it, so they hold for the session from then on.
    """
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", size)):
        now = spark.conf.get(key).lower().removesuffix("b")
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, what: str, **options: str) -> DataFrame:
    """Cut lineage: write `df` to the shared folder and read it back.

    Parquet in the shared folder survives lost executors, is smaller than a
    checkpoint of rows, and gives later plans real sizes.  `options` are the
    writer's.  A table stays until `discard`, or until the folder is emptied.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/spindex-{what}-{uuid.uuid4().hex}"
    df.write.options(compression="zstd", **options).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._spindex_written = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables of `written` that nothing unwritten depends on any more; others are left alone."""
    for t in tables:
        if path := t.__dict__.get("_spindex_written"):
            delete(t.sparkSession, path)


#: Rows of ids that may be broadcast: a few dozen MB.
FEW_ROWS = 1_000_000


def if_few(ids: DataFrame, rows: int = FEW_ROWS) -> DataFrame:
    """`ids`, a written table of a few numbers a row, marked for broadcast if it has no more than `rows`."""
    return F.broadcast(ids) if ids.count() <= rows else ids


def texts_of(batch: pa.RecordBatch, name: str) -> list:
    """str or None for each row."""
    return batch.column(name).to_pylist()


def bytes_of(batch: pa.RecordBatch, name: str) -> list:
    """UTF-8 bytes for each row; null is empty."""
    col = batch.column(name)
    binary = pa.large_binary() if pa.types.is_large_string(col.type) else pa.binary()
    return [b"" if x is None else x for x in col.cast(binary).to_pylist()]


def renamed(df: DataFrame, **cols: str) -> DataFrame:
    """Select `source` columns under fixed names, dropping all others.

    Extra input columns can therefore never clash with an operator's own.
    """
    return df.select(*[F.col(f"`{src}`").alias(dst) for dst, src in cols.items()])


def hash_sample(df: DataFrame, key: str, rows: int) -> DataFrame:
    """About `rows` rows of `df`, chosen by a hash of `key`, at most a fifth more.

    One cheap count, then a filter: the choice depends on neither partitions nor
    order, and never gathers rows.  All rows when there are no more than `rows`.
    """
    total = df.select(key).count()
    if total <= rows:
        return df
    cut = int(rows / total * (1 << 40))
    return df.filter(F.pmod(F.xxhash64(F.lit(7), F.col(key)), F.lit(1 << 40)) < F.lit(cut))


def equal_shares(df: DataFrame, key: str, kind: str, rows: int) -> DataFrame:
    """About `rows` rows of `df`, of each `kind` as many, or all that it has.

    Counts by kind are joined back, so the choice by a hash of `key` depends on
    neither partitions nor order.  Rows without a kind are left out.
    """
    counts = df.groupBy(kind).agg(F.count(F.lit(1)).alias("__n"))
    kinds = max(1, counts.count())
    share = counts.select(F.col(kind).alias("__kind"), (F.lit(max(1, rows // kinds)) / F.col("__n") * F.lit(1 << 40)).cast("long").alias("__cut"))
    picked = df.join(F.broadcast(share) if kinds <= FEW_ROWS else share, F.col(kind) == F.col("__kind"))
    return picked.filter(F.pmod(F.xxhash64(F.lit(7), F.col(key)), F.lit(1 << 40)) < F.col("__cut")).select(*df.columns)
