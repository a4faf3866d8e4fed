"""From documents to hits to postings, and what can be asked of postings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from spindex.functions.text import tokens
from spindex.schema import DEFAULT_WEIGHT, MAX_WEIGHT, WORD_LENGTH


def _own(docs: DataFrame, id_col: str, by_document: bool, *columns: Column) -> DataFrame:
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), *columns)
    return own.repartition("doc_id") if by_document else own


def check_weight(weight: int) -> None:
    if not 0 <= weight <= MAX_WEIGHT:
        raise ValueError(f"a weight of 0 to {MAX_WEIGHT}, not {weight}")


def weight_of(item: Column) -> Column:
    return F.coalesce(item["weight"].cast("long"), F.lit(DEFAULT_WEIGHT).cast("long"))


def good_word(item: Column) -> Column:
    """The word of a struct<word, weight>; a word or weight out of range fails."""
    good = item["word"].isNotNull() & (F.length(item["word"]) < WORD_LENGTH) & (F.length(item["word"]) > 0) & ~item["word"].contains("/") & weight_of(item).between(0, MAX_WEIGHT)
    return F.when(good, item["word"]).otherwise(F.raise_error(F.concat(F.lit("not a weighted word: "), F.to_json(item))))


def text_hits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", weight: int = DEFAULT_WEIGHT, by_document: bool = False) -> DataFrame:
    """(word, doc_id, pos, weight, doc_size) of every token.

    With `by_document` the texts are dealt by id first: postings are then built
    where the tokens are, and no token is shuffled.
    """
    check_weight(weight)
    words = _own(docs, id_col, by_document, F.col(text_col).alias("text")).select("doc_id", tokens(F.col("text")).alias("words"))
    sized = words.withColumn("doc_size", F.size("words").cast("long") * weight)
    return sized.select("doc_id", "doc_size", F.posexplode("words").alias("pos", "word")).select("word", "doc_id", "pos", F.lit(weight).cast("short").alias("weight"), "doc_size")


def weighted_hits(docs: DataFrame, id_col: str = "doc_id", words_col: str = "words", by_document: bool = False) -> DataFrame:
    """The same from ARRAY<STRUCT<word, weight>>; a null weight is the default one.

    A word or weight out of range fails the query that reads it.
    """
    item = F.col("item")
    given = F.coalesce(F.col("words"), F.array().cast(docs.schema[words_col].dataType))
    own = _own(docs, id_col, by_document, F.col(words_col).alias("words"))
    sized = own.select("doc_id", given.alias("words"), F.aggregate(given, F.lit(0).cast("long"), lambda n, x: n + weight_of(x)).alias("doc_size"))
    rows = sized.select("doc_id", "doc_size", F.posexplode("words").alias("pos", "item"))
    return rows.select(good_word(item).alias("word"), "doc_id", "pos", weight_of(item).cast("short").alias("weight"), "doc_size")


def documents(postings: DataFrame) -> DataFrame:
    """(doc_id, doc_size), each document once."""
    return postings.groupBy("doc_id").agg(F.max("doc_size").alias("doc_size"))


def text_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", weight: int = DEFAULT_WEIGHT) -> DataFrame:
    """The same from texts, without their words being shuffled; without tokens, no document."""
    sized = docs.select(F.col(id_col).cast("long").alias("doc_id"), (F.size(tokens(F.col(text_col))).cast("long") * weight).alias("doc_size"))
    return documents(sized.filter("doc_size > 0"))


def _bag(hits: Column) -> Column:
    return F.sort_array(hits).cast("array<struct<pos:int,weight:smallint>>").alias("hits")


def build_postings(hits: DataFrame) -> DataFrame:
    """One row for each document and word, with its hits in order of position.

    Hits dealt by document are grouped where they are.
    """
    return hits.groupBy("doc_id", "word").agg(
        F.max("doc_size").alias("doc_size"), F.count(F.lit(1)).cast("int").alias("tf"), F.sum(F.col("weight").cast("long")).alias("sum_w"), _bag(F.collect_list(F.struct("pos", "weight")))
    )


def merge_postings(batches: DataFrame, order_col: str) -> DataFrame:
    """Postings of several batches as one: hits in one bag, the oldest size."""
    return batches.groupBy("word", "doc_id").agg(
        F.min_by("doc_size", order_col).alias("doc_size"), F.sum("tf").cast("int").alias("tf"), F.sum("sum_w").alias("sum_w"), _bag(F.flatten(F.collect_list("hits")))
    )


def scan(postings: DataFrame, words: list[str], doc_start: int = 0, doc_stop: int = 0, buckets: int | None = None) -> DataFrame:
    """Postings of some words and documents; every condition reaches the scan.

    An unknown word has none.  Bounds include; 0 is no bound.
    """
    out = postings
    if buckets and "bucket" in postings.columns:
        # literals once folded, so that partitions are pruned
        out = out.filter(F.col("bucket").isin(*[bucket(F.lit(w), buckets) for w in words]))
    return in_range(out.filter(F.col("word").isin(words)), doc_start, doc_stop)


def in_range(df: DataFrame, doc_start: int, doc_stop: int) -> DataFrame:
    if doc_start:
        df = df.filter(F.col("doc_id") >= doc_start)
    if doc_stop:
        df = df.filter(F.col("doc_id") <= doc_stop)
    return df


def bucket(word: Column, buckets: int) -> Column:
    return F.pmod(F.hash(word), F.lit(buckets))


def document_frequency(postings: DataFrame, words: list[str]) -> DataFrame:
    return scan(postings, words).groupBy("word").agg(F.count(F.lit(1)).alias("df"))


def max_document(postings: DataFrame, words: list[str]) -> DataFrame:
    return scan(postings, words).groupBy("word").agg(F.max("doc_id").alias("max_doc_id"))


def integrity_violations(postings: DataFrame) -> DataFrame:
    """(word, doc_id, problem) of each posting that contradicts itself or another."""
    ordered = F.forall(F.sequence(F.lit(1), F.greatest(F.size("hits") - 1, F.lit(1))), lambda i: F.coalesce(F.get("hits", i)["pos"] >= F.get("hits", i - 1)["pos"], F.lit(True)))
    sum_w = F.aggregate("hits", F.lit(0).cast("long"), lambda n, h: n + h["weight"])
    rules = {
        "hits out of order": ~ordered, "tf differs": F.col("tf") != F.size("hits"), "sum_w differs": F.col("sum_w") != sum_w,
        "weight out of range": F.exists("hits", lambda h: ~h["weight"].between(0, MAX_WEIGHT)), "size below weights": F.col("doc_size") < F.col("sum_w"),
        "empty": F.size("hits") == 0, "word": (F.length("word") >= WORD_LENGTH) | F.col("word").contains("/") | F.col("word").isNull(),
    }
    each = postings.select("word", "doc_id", F.explode(F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in rules.items()]))).alias("problem"))
    twice = postings.groupBy("word", "doc_id").count().filter("count > 1").select("word", "doc_id", F.lit("twice").alias("problem"))
    return each.unionByName(twice)


