"""Ranking, paging and thresholds over (doc_id, relevance)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

#: Decimals of a relevance that is shown, compared and ordered by.
DECIMALS = 6


def rounded(found: DataFrame) -> DataFrame:
    return found.select("doc_id", F.round("relevance", DECIMALS).alias("relevance"))


def check_page(size: int, start: int) -> None:
    if size < 0 or start < 0:
        raise ValueError("size and start are 0 or more")


def top(found: DataFrame, size: int, start: int = 0) -> DataFrame:
    """(rank, doc_id, relevance) of `size` documents after the best `start`.

    Documents of no relevance are left out; of equal ones the larger id comes
    first.  Only size + start rows of each task meet.
    """
    check_page(size, start)
    best = rounded(found.filter("relevance > 0")).orderBy(F.desc("relevance"), F.desc("doc_id")).limit(start + size)
    rank = F.row_number().over(Window.orderBy(F.desc("relevance"), F.desc("doc_id")))  # over start + size rows
    return best.select(rank.alias("rank"), "doc_id", "relevance").filter(F.col("rank") > start)


def total(found: DataFrame) -> DataFrame:
    """One row: the number of matches, those of no relevance included."""
    return found.agg(F.count(F.lit(1)).alias("total"))


def at_least(found: DataFrame, min_percent: float = 0, single_precision: bool = False) -> DataFrame:
    """Documents of a relevance of min_percent / 100 or more; all of them at 0."""
    if min_percent < 0:
        raise ValueError("a least relevance of 0 or more")
    if not min_percent:
        return rounded(found)
    if single_precision:
        return rounded(found.filter(F.col("relevance").cast("float") >= F.lit(min_percent / 100).cast("float")))
    return rounded(found.filter(F.col("relevance") >= min_percent / 100))
