"""Registered queries of the retrieval engine, over whole tables, with their SQL.

Every query builds its postings from `documents`; only the words it asks for
reach the shuffle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from spindex.functions.text import ACCENTED, FOLDED
from spindex.operators import postings as P
from spindex.operators.documents import text_postings
from spindex.plans import commands
from spindex.plans.nodes import And, Approx, Exact, Kw, Node, Not, Or
from spindex.plans.parser import parse
from spindex.plans.pivot import evaluate

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

#: Rare enough words for a brute-force oracle of proximity.
RARE = ("be", "as", "that")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _postings(spark: SparkSession, sf_dir: str, only: list[str] | None = None) -> DataFrame:
    """All postings, or those of some words, whose hits alone are shuffled then."""
    docs = _documents(spark, sf_dir)
    return text_postings(docs) if only is None else P.build_postings(P.text_hits(docs).filter(F.col("word").isin(only)))


def _found(spark: SparkSession, sf_dir: str, node: Node, **options) -> DataFrame:
    docs = P.text_documents(_documents(spark, sf_dir)) if node.matches_nothing_present() else None
    return evaluate(node, _postings(spark, sf_dir, node.words()), docs, **options)


def _add(name: str, run: Query, sql: str) -> None:
    QUERIES[name] = run
    ORACLE_SQL[name] = sql


def _node(name: str, node: Node, sql: str, **options) -> None:
    """All matches of a tree; `sql` is an expression over the CTEs that gives (doc_id, rel)."""
    _add(name, lambda spark, d: commands.rounded(_found(spark, d, node, **options)), f"{TOK} SELECT doc_id, round(CAST(rel AS DOUBLE), 6) AS relevance FROM ({sql})")


TOK = (
    "WITH words AS (SELECT doc_id, list_filter(regexp_extract_all(translate(lower(coalesce(text, '')), "
    f"'{ACCENTED}', '{FOLDED}'), '[a-z0-9]+'), lambda x: length(x) < 50) AS w FROM documents), "
    "ds AS (SELECT doc_id, CAST(10 * len(w) AS BIGINT) AS doc_size FROM words WHERE len(w) > 0), "
    "tok AS (SELECT doc_id, CAST(unnest(range(len(w))) AS INT) AS pos, unnest(w) AS word FROM words), "
    "kw AS (SELECT word, doc_id, count(*) AS tf, 10.0::DOUBLE * count(*) * 200 / (doc_size + 2000) AS rel, doc_size FROM tok JOIN ds USING (doc_id) GROUP BY word, doc_id, doc_size) "
)


def _kw(word: str) -> str:
    return f"SELECT doc_id, rel FROM kw WHERE word = '{word}'"


def _and(*parts: str) -> str:
    joined = " ".join(f"JOIN ({p}) p{i} USING (doc_id)" for i, p in enumerate(parts[1:], 1))
    return f"SELECT doc_id, {' * '.join(f'p{i}.rel' for i in range(len(parts)))} AS rel FROM ({parts[0]}) p0 {joined}"


def _or(*parts: str) -> str:
    return f"SELECT doc_id, sum(rel) AS rel FROM ({' UNION ALL '.join(parts)}) GROUP BY doc_id"


def _not(part: str, universe: str = "SELECT doc_id FROM ds") -> str:
    return f"SELECT doc_id, 1.0::DOUBLE AS rel FROM ({universe}) WHERE doc_id NOT IN (SELECT doc_id FROM ({part}))"


def _exact(*words: str) -> str:
    """Each word may be several, separated by |, of which a place takes one."""
    n = len(words)
    tests = [f"t{j}.word IN ({', '.join(repr(x) for x in w.split('|'))})" for j, w in enumerate(words)]
    joined = " ".join(f"JOIN tok t{j} ON t{j}.doc_id = t0.doc_id AND t{j}.pos = t0.pos + {j} AND {tests[j]}" for j in range(1, n))
    return f"SELECT t0.doc_id AS doc_id, count(*) * {10 * n} * 200.0::DOUBLE / ((doc_size + 2000) * {n}) AS rel FROM tok t0 {joined} JOIN ds ON ds.doc_id = t0.doc_id WHERE {tests[0]} GROUP BY t0.doc_id, doc_size"


def _approx(*words: str) -> str:
    n = len(words)
    near = " * ".join(f"CASE WHEN t{j}.pos > t{j - 1}.pos THEN 1.0::DOUBLE / (t{j}.pos - t{j - 1}.pos) ELSE 0.3::DOUBLE / (t{j - 1}.pos - t{j}.pos) END" for j in range(1, n))
    joined = " ".join(f"JOIN tok t{j} ON t{j}.doc_id = t0.doc_id AND t{j}.word = '{words[j]}'" for j in range(1, n))
    raw = f"SELECT t0.doc_id AS doc_id, sum({10**n}::DOUBLE * {near}) AS raw FROM tok t0 {joined} WHERE t0.word = '{words[0]}' GROUP BY t0.doc_id"
    counts = " ".join(f"JOIN kw k{j} ON k{j}.doc_id = r.doc_id AND k{j}.word = '{w}'" for j, w in enumerate(words))
    product, total = " * ".join(f"k{j}.tf" for j in range(n)), " + ".join(f"k{j}.tf" for j in range(n))
    return f"SELECT r.doc_id AS doc_id, raw / ({product}) * ({total}) / {n} * 200 / ((k0.doc_size + 2000) * {n}) AS rel FROM ({raw}) r {counts}"


def _top(inner: str, size: int, start: int = 0) -> str:
    ranked = f"SELECT doc_id, round(rel, 6) AS relevance, row_number() OVER (ORDER BY round(rel, 6) DESC, doc_id DESC) AS rank FROM ({inner}) WHERE rel > 0"
    return f"{TOK} SELECT CAST(rank AS INT) AS rank, doc_id, relevance FROM ({ranked}) WHERE rank > {start} AND rank <= {start + size}"


# Tokens, documents and postings.
_add("tokenize_hits", lambda s, d: P.text_hits(_documents(s, d)).select("word", "doc_id", "pos", F.col("weight").cast("int").alias("weight"), "doc_size"), f"{TOK} SELECT word, doc_id, pos, 10 AS weight, doc_size FROM tok JOIN ds USING (doc_id)")
_add("docs_size", lambda s, d: P.text_documents(_documents(s, d)), f"{TOK} SELECT doc_id, doc_size FROM ds")


def _hit_text(postings: DataFrame) -> DataFrame:
    # [{0, 10}, {7, 10}] as 0:10 7:10
    shown = F.btrim(F.replace(F.replace(F.col("hits").cast("string"), F.lit("}, {"), F.lit(" ")), F.lit(", "), F.lit(":")), F.lit("[{}]"))
    return postings.select("word", "doc_id", "doc_size", F.col("tf").cast("long").alias("tf"), "sum_w", shown.alias("hit_list"))


_POSTINGS_SQL = f"{TOK} SELECT word, doc_id, doc_size, count(*) AS tf, CAST(10 * count(*) AS BIGINT) AS sum_w, string_agg(pos || ':10', ' ' ORDER BY pos) AS hit_list FROM tok JOIN ds USING (doc_id) GROUP BY word, doc_id, doc_size"
_add("postings_build", lambda s, d: _hit_text(_postings(s, d)), _POSTINGS_SQL)
_add("word_df", lambda s, d: P.document_frequency(_postings(s, d), ["the", "of", "de"]), f"{TOK} SELECT word, count(*) AS df FROM kw WHERE word IN ('the', 'of', 'de') GROUP BY word")
_add("word_max_doc", lambda s, d: P.max_document(_postings(s, d), ["the", "of", "de"]), f"{TOK} SELECT word, max(doc_id) AS max_doc_id FROM kw WHERE word IN ('the', 'of', 'de') GROUP BY word")


def _planted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Postings with a fault in most of them, by the id's remainder by 7."""
    good, kind = _postings(spark, sf_dir), F.pmod("doc_id", F.lit(7))
    bad = good.withColumns({
        "tf": F.when(kind == 0, F.col("tf") + 1).otherwise(F.col("tf")), "sum_w": F.when(kind == 1, F.col("sum_w") + 1).otherwise(F.col("sum_w")),
        "hits": F.when(kind == 2, F.reverse("hits")).otherwise(F.col("hits")), "doc_size": F.when(kind == 3, F.col("sum_w") - 1).otherwise(F.col("doc_size")),
    })
    # twice in one pass over the documents
    times = F.when(kind == 4, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return P.integrity_violations(bad.withColumn("time", F.explode(times)).drop("time"))


_add(
    "integrity_violations", _planted,
    f"{TOK}, p AS (SELECT word, doc_id, tf, doc_size, doc_id % 7 AS kind FROM kw) SELECT word, doc_id, 'tf differs' AS problem FROM p WHERE kind = 0 "
    "UNION ALL SELECT word, doc_id, 'sum_w differs' FROM p WHERE kind = 1 UNION ALL SELECT word, doc_id, 'size below weights' FROM p WHERE kind = 3 OR kind = 1 AND doc_size < 10 * tf + 1 "
    "UNION ALL SELECT word, doc_id, 'hits out of order' FROM p WHERE kind = 2 AND tf > 1 UNION ALL SELECT word, doc_id, 'twice' FROM p WHERE kind = 4",
)

# Trees.
_node("kw_score", Kw("the"), _kw("the"))
_node("kw_missing_word", Kw("zzzunknownzzz"), _kw("zzzunknownzzz"))
_node("and2", And(Kw("of"), Kw("the")), _and(_kw("of"), _kw("the")))
_node("and3", And(Kw("of"), And(Kw("the"), Kw("in"))), _and(_kw("of"), _kw("the"), _kw("in")))
_node("or2", Or(Kw("of"), Kw("de")), _or(_kw("of"), _kw("de")))
_node("or3", Or(Kw("of"), Or(Kw("de"), Kw("und"))), _or(_kw("of"), _kw("de"), _kw("und")))
_node("and_not", And(Kw("in"), Not(Kw("the"))), _and(_kw("in"), _not(_kw("the"))))
_node("not_docs", Not(Kw("the")), _not(_kw("the")))
_node("not_range", Not(Kw("the")), _not(_kw("the"), "SELECT unnest(range(1, 2001)) AS doc_id"), universe="range", doc_stop=2000)
_node("or_not", Or(Kw("of"), Not(Kw("the"))), _or(_kw("of"), _not(_kw("the"))))
_node("exact2", Exact((Kw("of"), Kw("the"))), _exact("of", "the"))
_node("exact3", Exact((Kw("of"), Kw("the"), Kw("on"))), _exact("of", "the", "on"))
_node("exact_or_child", Exact((Or(Kw("of"), Kw("in")), Kw("the"))), _exact("of|in", "the"))
_node("exact_repeat", Exact((Kw("the"), Kw("the"))), _exact("the", "the"))
_node("approx2", Approx((Kw(RARE[0]), Kw(RARE[1]))), _approx(*RARE[:2]))
_node("approx3", Approx(tuple(map(Kw, RARE))), _approx(*RARE))
_node("approx_frequent", Approx((Kw("of"), Kw("the"))), _approx("of", "the"))
_node("dict_tree", Node.from_dict({"and": [{"or": [{"kw": "of"}, {"exact": [{"kw": "in"}, {"kw": "the"}]}]}, {"not": {"approx": [{"kw": "er"}, {"kw": "und"}]}}]}), _and(_or(_kw("of"), _exact("in", "the")), _not(_and(_kw("er"), _kw("und")))))
_node("nested_bool", And(Or(Kw("in"), Kw("is")), And(Exact((Kw("of"), Kw("the"))), Not(Kw("er")))), _and(_or(_kw("in"), _kw("is")), _exact("of", "the"), _not(_kw("er"))))

# Commands.
_OF_OR_DE = Or(Kw("of"), Kw("de"))
_OF_OR_DE_SQL = _or(_kw("of"), _kw("de"))
_add("query_top_k", lambda s, d: commands.top(_found(s, d, _OF_OR_DE), 20), _top(_OF_OR_DE_SQL, 20))
_add("query_top_page", lambda s, d: commands.top(_found(s, d, _OF_OR_DE), 20, 40), _top(_OF_OR_DE_SQL, 20, 40))
_add("query_total", lambda s, d: commands.total(_found(s, d, _OF_OR_DE)), f"{TOK} SELECT count(*) AS total FROM ({_OF_OR_DE_SQL})")
_add("query_filter_min", lambda s, d: commands.at_least(_found(s, d, Kw("the")), 30), f"{TOK} SELECT doc_id, round(rel, 6) AS relevance FROM ({_kw('the')}) WHERE rel >= 0.3")
_add("query_filter_zero", lambda s, d: commands.at_least(_found(s, d, Kw("the"))), f"{TOK} SELECT doc_id, round(rel, 6) AS relevance FROM ({_kw('the')})")
_add("query_filter_single", lambda s, d: commands.at_least(_found(s, d, Kw("the")), 30, single_precision=True), f"{TOK} SELECT doc_id, round(rel, 6) AS relevance FROM ({_kw('the')}) WHERE CAST(rel AS FLOAT) >= CAST(0.3 AS FLOAT)")
_add("query_filter_range", lambda s, d: commands.at_least(_found(s, d, Kw("the"), doc_start=100, doc_stop=700), 10), f"{TOK} SELECT doc_id, round(rel, 6) AS relevance FROM ({_kw('the')}) WHERE rel >= 0.1 AND doc_id BETWEEN 100 AND 700")

# Query text.
for _name, _text, _sql in (
    ("parse_or_tighter", "the AND of OR de", _and(_kw("the"), _or(_kw("of"), _kw("de")))),
    ("parse_implicit_and", "of the NOT er", _and(_kw("of"), _kw("the"), _not(_kw("er")))),
    ("parse_multi_token_phrase", "of-the", _exact("of", "the")),
    ("parse_approx", "`be as` OR [as that]", _or(_approx("be", "as"), _approx("as", "that"))),
    ("parse_groups", '("of the" OR de) in', _and(_or(_exact("of", "the"), _kw("de")), _kw("in"))),
):
    _node(_name, parse(_text), _sql)

for _name, _text, _sql in (
    ("compat_or_first", "of AND de OR und", _and(_or(_kw("und"), _kw("de")), _kw("of"))),
    ("compat_group_in_phrase", '"of (in) the"', _and(_exact("of", "the"), _kw("in"))),
    ("compat_not_lost", "(NOT of) the", _and(_kw("the"), _kw("of"))),
    ("compat_open_group", "of the AND in (de", _and(_kw("of"), _kw("the"), _kw("in"))),
):
    _node(_name, parse(_text, compat=True), _sql)


# Writing.
def _merge_readd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document, and then every document once more."""
    docs = _documents(spark, sf_dir)
    return _hit_text(text_postings(docs.withColumn("batch", F.lit(0)).unionByName(docs.withColumn("batch", F.lit(1))), order_col="batch"))


_add(
    "merge_readd", _merge_readd,
    f"{TOK} SELECT word, doc_id, doc_size, count(*) AS tf, CAST(10 * count(*) AS BIGINT) AS sum_w, string_agg(pos || ':10', ' ' ORDER BY pos) AS hit_list "
    "FROM (SELECT * FROM tok UNION ALL SELECT * FROM tok) JOIN ds USING (doc_id) GROUP BY word, doc_id, doc_size",
)


def _weighted_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first ten words of a document weigh 50."""
    from spindex.functions.text import tokens

    words = F.transform(tokens(F.col("text")), lambda w, i: F.struct(w.alias("word"), F.when(i < 10, 50).otherwise(10).alias("weight")))
    hits = P.weighted_hits(_documents(spark, sf_dir).select("doc_id", words.alias("words"))).filter("word = 'the'")
    return commands.rounded(evaluate(Kw("the"), P.build_postings(hits)))


_add(
    "weighted_title", _weighted_title,
    f"{TOK}, sized AS (SELECT doc_id, sum(CASE WHEN pos < 10 THEN 50 ELSE 10 END) AS size FROM tok GROUP BY doc_id) "
    "SELECT doc_id, round(sum(CASE WHEN pos < 10 THEN 50 ELSE 10 END) * 200.0::DOUBLE / (size + 2000), 6) AS relevance FROM tok JOIN sized USING (doc_id) WHERE word = 'the' GROUP BY doc_id, size",
)


def _stored(spark: SparkSession, sf_dir: str):
    """A stored index of the documents, in a folder of its own."""
    import uuid

    from spindex.engine import Engine
    from spindex.sources.folders import shared_dir

    return Engine(spark, f"{shared_dir(spark)}/spindex-index-{uuid.uuid4().hex}", buckets=16)


def _stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = _stored(spark, sf_dir)
    docs = _documents(spark, sf_dir)
    stream = spark.readStream.schema(docs.schema).parquet(f"{sf_dir}/documents.parquet*")
    engine.start_ingest(stream, f"{engine.index.path}/stream", available_now=True).awaitTermination()
    return _hit_text(engine.index.postings())


def _stored_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """English documents and all others added, flushed and compacted, then asked."""
    engine = _stored(spark, sf_dir)
    docs = _documents(spark, sf_dir)
    engine.add_documents(docs.filter("lang <=> 'en'"), text_col="text")
    engine.add_documents(docs.filter("not (lang <=> 'en')"), text_col="text")
    engine.flush()
    engine.compact()
    return engine.query_top('"of the" OR de', 50).page


def _stored_purge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents stored in two segments, then rewritten without ids below 500."""
    engine = _stored(spark, sf_dir)
    docs = _documents(spark, sf_dir)
    for own in ("doc_id % 3 = 0", "doc_id % 3 > 0"):
        engine.add_documents(docs.filter(own), text_col="text")
        engine.flush()
    engine.compact(purge_before=500)
    return _hit_text(engine.index.postings())


def _stored_readd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents added, and again with their first 40 letters alone, read from two segments: a word keeps the older size."""
    engine = _stored(spark, sf_dir)
    docs = _documents(spark, sf_dir)
    for again in (docs, docs.withColumn("text", F.substring("text", 1, 40))):
        engine.add_documents(again, text_col="text")
        engine.flush()
    return _hit_text(engine.index.postings())


def _buffered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of the words that wait for a flush, those of flushed ones not counted."""
    engine = _stored(spark, sf_dir)
    docs = _documents(spark, sf_dir)
    engine.add_documents(docs.filter("doc_id % 2 = 0"), text_col="text")
    engine.flush()
    engine.add_documents(docs.filter("doc_id % 2 = 1"), text_col="text")
    return engine.buffered()


_add("stream_ingest", _stream_ingest, _POSTINGS_SQL)
_add("stored_query", _stored_query, _top(_or(_exact("of", "the"), _kw("de")), 50))
_add("stored_purge", _stored_purge, f"SELECT * FROM ({_POSTINGS_SQL}) WHERE doc_id >= 500")
_add(
    "stored_readd", _stored_readd,
    TOK.replace("FROM documents)", "FROM documents), cut AS (SELECT doc_id, list_filter(regexp_extract_all(translate(lower(substring(coalesce(text, ''), 1, 40)), "
    f"'{ACCENTED}', '{FOLDED}'), '[a-z0-9]+'), lambda x: length(x) < 50) AS w FROM documents)", 1)
    + ", every AS (SELECT doc_id, pos, word, doc_size, 0 AS batch FROM tok JOIN ds USING (doc_id) UNION ALL SELECT doc_id, CAST(unnest(range(len(w))) AS INT) AS pos, unnest(w) AS word, CAST(10 * len(w) AS BIGINT) AS doc_size, 1 AS batch FROM cut) "
    "SELECT word, doc_id, arg_min(doc_size, batch) AS doc_size, count(*) AS tf, CAST(10 * count(*) AS BIGINT) AS sum_w, string_agg(pos || ':10', ' ' ORDER BY pos) AS hit_list FROM every GROUP BY word, doc_id",
)
_add("delta_count", _buffered, f"{TOK} SELECT word, count(*) AS df FROM kw WHERE doc_id % 2 = 1 GROUP BY word")
