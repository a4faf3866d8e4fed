"""Join plans: each node a DataFrame of its matches, combined by joins on doc_id.

Slower than leaf-pivot plans for most queries; it shares only the formulas with
them, so the tests hold one against the other.  Proximity is summed over joined
pairs of hits here, phrases are equi-joins on positions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from spindex.functions import score
from spindex.operators.postings import scan
from spindex.plans.nodes import And, Approx, Exact, Kw, Node, Not, Or
from spindex.plans.pivot import whole_universe
from spindex.schema import NORM_FACTOR, SIZE_MALUS


def evaluate(query: Node, postings: DataFrame, docs: DataFrame | None = None, doc_start: int = 0, doc_stop: int = 0, universe: str = "docs") -> DataFrame:
    """(doc_id, relevance), as the leaf-pivot plan gives it."""

    def leaf(word: str) -> DataFrame:
        return scan(postings, [word], doc_start, doc_stop)

    def hit_rows(node: Node, at: int) -> DataFrame:
        """(doc_id, n, k, size, pos, weight): k orders hits of one position."""
        if isinstance(node, Kw):
            rows = leaf(node.word).select("doc_id", F.col("doc_size").alias("size"), F.posexplode("hits").alias("k", "h"))
            return rows.select("doc_id", "size", F.array("k").alias("k"), F.col("h.pos").alias("pos"), F.col("h.weight").cast("long").alias("weight"))
        left, right = hit_rows(node.left, at), hit_rows(node.right, at)
        sizes = left.select("doc_id", F.col("size").alias("left_size")).distinct()
        side = lambda df, s: df.withColumn("k", F.concat(F.array(F.lit(s)), F.col("k")))
        both = side(right, 0).unionByName(side(left, 1)).join(sizes, "doc_id", "left")
        return both.withColumn("size", F.coalesce("left_size", "size")).drop("left_size")

    def run(node: Node) -> DataFrame:
        if isinstance(node, Kw):
            return leaf(node.word).select("doc_id", score.kw_relevance(F.col("sum_w"), F.col("doc_size")).alias("relevance"))
        if isinstance(node, Not):
            everything = whole_universe(postings, docs, doc_start, doc_stop, universe)
            return everything.select("doc_id").join(run(node.node), "doc_id", "left_anti").withColumn("relevance", F.lit(1.0))
        if isinstance(node, (And, Or)):
            a, b = run(node.left), run(node.right).withColumnRenamed("relevance", "other")
            if isinstance(node, And):
                return a.join(b, "doc_id").select("doc_id", (F.col("relevance") * F.col("other")).alias("relevance"))
            both = F.col("relevance").isNotNull() & F.col("other").isNotNull()
            return a.join(b, "doc_id", "full").select("doc_id", F.when(both, F.col("relevance") + F.col("other")).otherwise(F.coalesce("relevance", "other")).alias("relevance"))
        n = len(node.children())
        lists = [hit_rows(c, j) for j, c in enumerate(node.children())]
        size = lists[0].groupBy("doc_id").agg(F.max("size").alias("size"))
        norm = F.lit(float(NORM_FACTOR)) / ((F.col("size") + SIZE_MALUS) * n)
        if isinstance(node, Exact):
            rows = lists[0].select("doc_id", F.col("pos").alias("p"), F.col("weight").alias("w"))
            for j, later in enumerate(lists[1:], 1):
                firsts = later.groupBy("doc_id", (F.col("pos") - j).alias("p")).agg(F.min_by("weight", "k").alias("more"))
                rows = rows.join(firsts, ["doc_id", "p"]).select("doc_id", "p", (F.col("w") + F.col("more")).alias("w"))
            total = rows.groupBy("doc_id").agg(F.sum("w").alias("w")).filter("w > 0")
            return total.join(size, "doc_id").select("doc_id", (F.col("w") * norm).alias("relevance"))
        assert isinstance(node, Approx)
        rows = lists[0].select("doc_id", F.col("pos").alias("p"), F.col("weight").cast("double").alias("f"))
        counts = lists[0].groupBy("doc_id").agg(F.count(F.lit(1)).alias("c0"))
        for j, later in enumerate(lists[1:], 1):
            counts = counts.join(later.groupBy("doc_id").agg(F.count(F.lit(1)).alias(f"c{j}")), "doc_id")
            pairs = rows.join(later.select("doc_id", F.col("pos").alias("q"), F.col("weight").alias("w"), "k"), "doc_id")
            rows = pairs.groupBy("doc_id", F.col("q").alias("p"), "k").agg(F.sum(F.col("f") * F.col("w") * score.proximity(F.col("p"), F.col("q"))).alias("f")).drop("k")
        product, total = F.lit(1.0), F.lit(0)
        for j in range(n):
            product, total = product * F.col(f"c{j}"), total + F.col(f"c{j}")
        raw = rows.groupBy("doc_id").agg(F.sum("f").alias("raw"))
        return raw.join(counts, "doc_id").join(size, "doc_id").select("doc_id", (F.col("raw") / product * total / n * norm).alias("relevance"))

    return run(query)
