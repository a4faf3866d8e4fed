"""Continuous ingestion: each micro-batch becomes a segment and is published."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from spindex.operators.documents import text_postings, weighted_postings
from spindex.schema import DEFAULT_WEIGHT, FLUSH_PERIOD_S
from spindex.sources.index import StoredIndex


def publish_batch(index: StoredIndex, batch: DataFrame, batch_id: int, text_col: str | None = "text", words_col: str | None = None, id_col: str = "doc_id", weight: int = DEFAULT_WEIGHT, stream: str = "stream") -> None:
    """Write a micro-batch as the segment of its number and publish it once.

    The manifest notes the stream's last batch, so a retried batch is not added
    again, even after its segment was merged with others.  Segments are merged as
    they become many.
    """
    if batch_id <= index.manifest().streams.get(stream, -1):
        return
    postings = weighted_postings(batch, id_col, words_col) if words_col else text_postings(batch, id_col, text_col, weight)
    index.add([index.write(postings, f"{stream}-{batch_id:012d}", built=True)], (stream, batch_id))
    index.upkeep()


def start_ingest(index: StoredIndex, stream: DataFrame, checkpoint: str, available_now: bool = False, every_s: int = FLUSH_PERIOD_S, name: str = "stream", **columns) -> StreamingQuery:
    """Start the query; `available_now` takes what is there and ends."""
    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda df, n: publish_batch(index, df, n, stream=name, **columns))
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=f"{every_s} seconds")).start()
