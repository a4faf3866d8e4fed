"""Relevance formulas as Columns over a document's hit lists.

A hit list is ARRAY<STRUCT<pos, weight>> sorted by pos.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from spindex.schema import NORM_FACTOR, SIZE_MALUS


def kw_relevance(sum_w: Column, doc_size: Column) -> Column:
    """Weighted frequency of a word against the document's size."""
    return sum_w * F.lit(float(NORM_FACTOR)) / (doc_size + SIZE_MALUS)


def merge_hits(left: Column, right: Column) -> Column:
    """Bag union of two hit lists by position; at equal positions the right one's come first."""

    def tagged(hits: Column, side: int) -> Column:
        return F.transform(hits, lambda h, i: F.struct(h["pos"].alias("pos"), F.lit(side).alias("side"), i.alias("i"), h["weight"].alias("weight")))

    both = F.array_sort(F.concat(tagged(right, 0), tagged(left, 1)))
    return F.transform(both, lambda h: F.struct(h["pos"].alias("pos"), h["weight"].alias("weight")))


def phrase_weight(hits: list[Column]) -> Column:
    """Sum over all places p, where the j-th word stands at p + j for each j, of the words' weights.

    Hits are brought to a common start and sorted, and one pass over them finds
    the complete starts.  Of several hits of a later word at one place the first
    counts; each hit of the first word begins a match of its own.
    """
    n = len(hits)

    def moved(h: Column, j: int) -> Column:
        return F.transform(h, lambda x, i: F.struct((x["pos"] - j).alias("start"), F.lit(j).alias("j"), i.alias("i"), x["weight"].cast("long").alias("w")))

    zero, none = F.lit(0).cast("long"), F.lit(-1)
    first = F.struct(F.lit(None).cast("int").alias("start"), none.alias("j"), F.lit(0).alias("later"), zero.alias("rest"), zero.alias("begins"), zero.alias("own"), zero.alias("total"))

    def closed(acc: Column) -> Column:
        return acc["total"] + F.when(acc["later"] == n - 1, acc["own"] + acc["begins"] * acc["rest"]).otherwise(zero)

    def step(acc: Column, x: Column) -> Column:
        same = acc["start"].eqNullSafe(x["start"])
        is_first = x["j"] == 0
        counts = ~is_first & ~(same & (acc["j"] == x["j"]))

        def kept(name: str, more: Column) -> Column:
            return F.when(same, acc[name]).otherwise(zero) + more

        return F.struct(
            x["start"].alias("start"), x["j"].alias("j"),
            (F.when(same, acc["later"]).otherwise(F.lit(0)) + F.when(counts, F.lit(1)).otherwise(F.lit(0))).alias("later"),
            kept("rest", F.when(counts, x["w"]).otherwise(zero)).alias("rest"),
            kept("begins", F.when(is_first, F.lit(1).cast("long")).otherwise(zero)).alias("begins"),
            kept("own", F.when(is_first, x["w"]).otherwise(zero)).alias("own"),
            F.when(same, acc["total"]).otherwise(closed(acc)).alias("total"),
        )

    return F.aggregate(F.array_sort(F.concat(*[moved(h, j) for j, h in enumerate(hits)])), first, step, closed)


def phrase_relevance(weight: Column, doc_size: Column, n: int) -> Column:
    return weight * F.lit(float(NORM_FACTOR)) / ((doc_size + SIZE_MALUS) * F.lit(n))


def proximity(p: Column, q: Column) -> Column:
    """1 / distance in order, 0.3 / distance reversed; nothing at one place."""
    return F.when(q > p, F.lit(1.0) / (q - p)).when(q < p, F.lit(0.3) / (p - q)).otherwise(F.lit(0.0))


def chain_start(hits: Column) -> Column:
    """(pos, f) of the first word of a proximity chain."""
    return F.transform(hits, lambda h: F.struct(h["pos"].alias("pos"), h["weight"].cast("double").alias("f")))


def chain_step(before: Column, hits: Column) -> Column:
    """(pos, f) of the next word: f(p) = weight(p) * sum over q of f(q) * proximity(q, p)."""

    def sum_to(h: Column) -> Column:
        return F.aggregate(before, F.lit(0.0), lambda acc, b: acc + b["f"] * proximity(b["pos"], h["pos"]))

    return F.transform(hits, lambda h: F.struct(h["pos"].alias("pos"), (h["weight"].cast("double") * sum_to(h)).alias("f")))


def proximity_relevance(last: Column, sizes: list[Column], doc_size: Column) -> Column:
    """The sum over all combinations of hits, averaged, times the mean list length."""
    n = len(sizes)
    raw = F.aggregate(last, F.lit(0.0), lambda acc, b: acc + b["f"])
    product, total = F.lit(1.0), F.lit(0)
    for s in sizes:
        product, total = product * s, total + s
    return raw / product * total / n * F.lit(float(NORM_FACTOR)) / ((doc_size + SIZE_MALUS) * F.lit(n))
