"""The engine: documents in, ranked documents out."""

from __future__ import annotations

import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation, Row, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from spindex.operators.documents import text_postings, weighted_postings
from spindex.operators.postings import document_frequency, integrity_violations, max_document
from spindex.plans import commands
from spindex.plans.nodes import Node
from spindex.plans.parser import parse
from spindex.plans.pivot import evaluate
from spindex.schema import DEFAULT_WEIGHT, should_flush
from spindex.sources.index import StoredIndex
from spindex.streaming.ingest import start_ingest


@dataclass
class Top:
    """A page of results, and over how many matches it was taken."""

    matches: DataFrame
    size: int
    start: int = 0
    _total: int | None = field(default=None, repr=False)

    @property
    def page(self) -> DataFrame:
        return commands.top(self.matches, self.size, self.start)

    def fetch(self) -> list[Row]:
        """The page's rows by rank; the same run counts the matches for `total`."""
        if not self.size:
            return []
        seen = Observation()
        rows = commands.top(self.matches.observe(seen, F.count(F.lit(1)).alias("total")), self.size, self.start).orderBy("rank").collect()
        self._total = seen.get["total"]
        return rows

    @property
    def total(self) -> int:
        """Matches, those of no relevance included; after `fetch` without another run."""
        if self._total is None:
            self._total = self.matches.count()
        return self._total


class Engine:
    """A stored index with the reference command surface: add, flush, query, compact."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64, auto_flush: bool = False):
        self.spark, self.auto_flush = spark, auto_flush
        self.index = StoredIndex(spark, path, buckets)
        self.pending: dict[str, int] = {}  # segments not visible yet: their documents
        self.added_at = time.monotonic()
        self.streams: list[StreamingQuery] = []

    def add_documents(self, docs: DataFrame, text_col: str | None = None, words_col: str | None = None, id_col: str = "doc_id", weight: int = DEFAULT_WEIGHT, on_duplicate: str = "merge") -> None:
        """Write documents; queries see them after `flush`.

        A document that was added before gains the new hits and keeps its size;
        with on_duplicate="error" it is refused instead.  An engine that flushes
        by itself does so here as soon as a flush is due.
        """
        if (text_col is None) == (words_col is None):
            raise ValueError("either text_col or words_col")
        if on_duplicate not in ("merge", "error"):
            raise ValueError("on_duplicate is merge or error")
        if on_duplicate == "error":
            ids = docs.select(F.col(id_col).cast("long").alias("doc_id"))
            known = self.index.docs([*self.index.segments(), *self.pending])
            twice = ids.groupBy("doc_id").count().filter("count > 1").select("doc_id").unionByName(ids.join(known, "doc_id", "left_semi"))
            if (found := twice.first()) is not None:
                raise ValueError(f"document {found['doc_id']} was added before")
        idle_s = time.monotonic() - self.added_at
        postings = text_postings(docs, id_col, text_col, weight) if text_col else weighted_postings(docs, id_col, words_col)
        name = self.index.write(postings, built=True)
        self.pending[name] = self.index.size(name)
        self.added_at = time.monotonic()
        if self.auto_flush:
            self.flush_if_due(idle_s)

    def buffered(self, words: list[str] | None = None) -> DataFrame:
        """(word, df): documents with each word that wait for a flush."""
        waiting = self.index.postings(words, list(self.pending))
        return waiting.groupBy("word").agg(F.count(F.lit(1)).alias("df"))

    def flush_if_due(self, idle_s: float | None = None) -> bool:
        """Flush if the documents that wait, or the time since the last came, call for it."""
        idle_s = time.monotonic() - self.added_at if idle_s is None else idle_s
        if self.pending and should_flush(idle_s, sum(self.pending.values())):
            self.flush()
            return True
        return False

    def flush(self) -> None:
        """Make what was added visible, all at once; merge small segments when there are many."""
        if self.pending:
            self.index.add(list(self.pending))
            self.pending = {}
            self.index.upkeep()

    def compact(self, purge_before: int | None = None) -> None:
        """Rewrite the index as one segment; see StoredIndex.compact."""
        self.index.compact(purge_before)

    def start_ingest(self, stream: DataFrame, checkpoint: str, **options) -> StreamingQuery:
        """Ingest a stream into the index; see spindex.streaming.ingest."""
        self.streams.append(start_ingest(self.index, stream, checkpoint, **options))
        return self.streams[-1]

    def matches(self, query: str | Node, docID_start: int = 0, docID_stop: int = 0, universe: str = "docs", compat: bool = False) -> DataFrame:
        """(doc_id, relevance) of all matches."""
        node = parse(query, compat) if isinstance(query, str) else query
        segments = self.index.segments()
        docs = self.index.docs(segments) if node.matches_nothing_present() and universe == "docs" else None
        return evaluate(node, self.index.postings(node.words(), segments), docs, docID_start, docID_stop, universe)

    def query_top(self, query: str | Node, size: int, start: int = 0, docID_start: int = 0, docID_stop: int = 0, **options) -> Top:
        found = self.matches(query, docID_start, docID_stop, **options)
        commands.check_page(size, start)
        return Top(found, size, start)

    def query_filter(self, query: str | Node, min_relevance: float = 0, docID_start: int = 0, docID_stop: int = 0, single_precision: bool = False, **options) -> DataFrame:
        """(doc_id, relevance) at `min_relevance` percent or more, by doc_id."""
        return commands.at_least(self.matches(query, docID_start, docID_stop, **options), min_relevance, single_precision).orderBy("doc_id")

    def document_frequency(self, words: list[str]) -> DataFrame:
        return document_frequency(self.index.postings(words), words)

    def max_document(self, words: list[str]) -> DataFrame:
        return max_document(self.index.postings(words), words)

    def check_integrity(self) -> DataFrame:
        return integrity_violations(self.index.postings())

    def stop(self) -> None:
        """Stop the engine's streams and drop what was not flushed."""
        for q in self.streams:
            q.stop()
        self.streams, self.pending = [], {}
