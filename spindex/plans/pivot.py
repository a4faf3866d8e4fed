"""Leaf-pivot plans: one scan, one aggregation by document, then plain expressions.

Every leaf word becomes columns of its document's row (weight sum, size and,
under Exact and Approx, hits); matches and relevances are expressions over
those.  The only exchange is that on doc_id, after partial aggregation.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from spindex.functions import score
from spindex.operators.postings import in_range, scan
from spindex.plans.nodes import And, Approx, Exact, Kw, Node, Not, Or

NO_HITS = "array<struct<pos:int,weight:smallint>>"


def _of_word(word: str):
    return lambda x: x["word"] == word


@dataclass
class Compiled:
    match: Column
    relevance: Column
    size: Column | None = None
    hits: Column | None = None


class Pivot:
    """The pivoted rows of a query, to which `compile` may add columns."""

    def __init__(self, query: Node, postings: DataFrame, doc_start: int = 0, doc_stop: int = 0, buckets: int | None = None):
        self.query = query
        self.place = {w: i for i, w in enumerate(query.words())}
        positional = {w for n in query.walk() if isinstance(n, (Exact, Approx)) for w in n.words()}
        columns = []
        for w, i in self.place.items():
            here = F.col("word") == w
            columns += [F.max(F.when(here, F.col("sum_w"))).alias(f"s{i}"), F.max(F.when(here, F.col("doc_size"))).alias(f"d{i}")]
        if positional:
            columns.append(F.collect_list(F.when(F.col("word").isin(sorted(positional)), F.struct("word", "hits"))).alias("positional"))
        self.rows = scan(postings, list(self.place), doc_start, doc_stop, buckets).groupBy("doc_id").agg(*columns)
        for w in sorted(positional):
            self.rows = self.rows.withColumn(f"h{self.place[w]}", F.get(F.filter("positional", _of_word(w)), F.lit(0))["hits"])
        self.rows = self.rows.drop("positional")
        self.steps = 0

    def cover(self, universe: DataFrame) -> None:
        """Add the documents of `universe` that have none of the words."""
        self.rows = universe.select("doc_id").join(self.rows, "doc_id", "left")

    def column(self, c: Column) -> Column:
        """`c` as a column of its own, so that later steps do not repeat it."""
        self.steps += 1
        name = f"x{self.steps}"
        self.rows = self.rows.withColumn(name, c)
        return F.col(name)

    def compile(self, node: Node) -> Compiled:
        if isinstance(node, Kw):
            i = self.place[node.word]
            s, d = F.col(f"s{i}"), F.col(f"d{i}")
            hits = F.col(f"h{i}") if f"h{i}" in self.rows.columns else None
            return Compiled(s.isNotNull(), score.kw_relevance(s, d), d, hits)
        if isinstance(node, Not):
            return Compiled(~self.compile(node.node).match, F.lit(1.0))
        if isinstance(node, (And, Or)):
            a, b = self.compile(node.left), self.compile(node.right)
            if isinstance(node, And):
                return Compiled(a.match & b.match, a.relevance * b.relevance)
            relevance = F.when(a.match & b.match, a.relevance + b.relevance).when(a.match, a.relevance).otherwise(b.relevance)
            hits = None
            if a.hits is not None and b.hits is not None:
                none = F.array().cast(NO_HITS)
                hits = F.when(a.match & b.match, score.merge_hits(F.coalesce(a.hits, none), F.coalesce(b.hits, none))).when(a.match, a.hits).otherwise(b.hits)
            size = F.coalesce(F.when(a.match, a.size), b.size) if a.size is not None and b.size is not None else None
            return Compiled(a.match | b.match, relevance, size, hits)
        parts = [self.compile(n) for n in node.children()]
        present = parts[0].match
        for p in parts[1:]:
            present = present & p.match
        size = parts[0].size
        if isinstance(node, Exact):
            weight = self.column(F.when(present, score.phrase_weight([p.hits for p in parts])))
            return Compiled(present & (F.coalesce(weight, F.lit(0)) > 0), score.phrase_relevance(weight, size, len(parts)))
        chain = self.column(F.when(present, score.chain_start(parts[0].hits)))
        for p in parts[1:]:
            chain = self.column(F.when(present, score.chain_step(chain, p.hits)))
        return Compiled(present, score.proximity_relevance(chain, [F.size(p.hits) for p in parts], size))


def evaluate(query: Node, postings: DataFrame, docs: DataFrame | None = None, doc_start: int = 0, doc_stop: int = 0, universe: str = "docs", buckets: int | None = None) -> DataFrame:
    """(doc_id, relevance) of all matching documents.

    A query that documents without any of its words match takes those from
    `docs`, or, with universe="range", from all ids of doc_start (1 if none) to
    doc_stop.
    """
    pivot = Pivot(query, postings, doc_start, doc_stop, buckets)
    if query.matches_nothing_present():
        pivot.cover(whole_universe(postings, docs, doc_start, doc_stop, universe))
    found = pivot.compile(query)
    return pivot.rows.filter(found.match).select("doc_id", found.relevance.alias("relevance"))


def whole_universe(postings: DataFrame, docs: DataFrame | None, doc_start: int, doc_stop: int, universe: str) -> DataFrame:
    if universe == "range":
        if not doc_stop:
            raise ValueError('universe="range" needs an end of the range')
        return postings.sparkSession.range(doc_start or 1, doc_stop + 1).withColumnRenamed("id", "doc_id")
    if universe != "docs":
        raise ValueError(f"a universe of docs or range, not {universe!r}")
    return in_range(docs if docs is not None else postings.select("doc_id").distinct(), doc_start, doc_stop)
