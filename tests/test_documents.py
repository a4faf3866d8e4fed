"""Postings of whole documents against those of their hits, one row a token."""

import random

from pyspark.sql import functions as F

from spindex import Engine
from spindex.operators import documents as D
from spindex.operators import postings as P
from spindex.queries import QUERIES
from spindex.sources import index
from tests.test_engine import WORDS

ODD = ["", None, "  ", "a" * 49, "a" * 50 + " b", "été Été ÀÂ ß×÷ ñandú", "Kelvin İx ÃŸ", "日本 a1 b-2", "é", "x", "ÿ" * 49, "ÿ" * 50, "tailÂ", "ä", "end a", "a start"]


def rows(df):
    return sorted((repr(r.asDict(True)) for r in df.select("word", "doc_id", "doc_size", "tf", "sum_w", "hits").collect()))


def texts(spark, seed=1):
    r = random.Random(seed)
    many = [(i % 61 if i % 4 else None if i % 40 == 0 else i, " ".join(r.choice(["the", "of", "été", "a-b", "z" * 50, "x1"]) for _ in range(r.randint(0, 30)))) for i in range(200)]
    return spark.createDataFrame(many + [(1000 + i, t) for i, t in enumerate(ODD)], "doc_id long, text string")


def test_texts_as_their_hits(spark):
    docs = texts(spark)
    want = rows(P.build_postings(P.text_hits(docs)))
    assert rows(D.text_postings(docs)) == want
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        assert rows(D.text_postings(docs)) == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_weighted_words_as_their_hits(spark):
    r = random.Random(2)
    docs = spark.createDataFrame([(i % 37, None if i % 9 == 0 else [(r.choice("abcé"), r.choice([None, 0, 10, 50, 100])) for _ in range(r.randint(0, 9))]) for i in range(90)], WORDS)
    assert rows(D.weighted_postings(docs)) == rows(P.build_postings(P.weighted_hits(docs)))


def test_batches_of_texts_as_merged_postings(spark):
    batches = [texts(spark, seed).withColumn("batch", F.lit(seed)) for seed in (3, 1, 2)]
    built = [P.build_postings(P.text_hits(b)).withColumn("batch", F.lit(n)) for b, n in zip(batches, (3, 1, 2))]
    every = batches[0].unionByName(batches[1]).unionByName(batches[2])
    assert rows(D.text_postings(every, order_col="batch")) == rows(P.merge_postings(built[0].unionByName(built[1]).unionByName(built[2]), "batch"))


def test_small_pieces_keep_documents_whole():
    import pyarrow as pa

    ids = [1, 1, 2, 3, 3, 3, 4, None, None, 5]
    whole = pa.record_batch({"doc_id": pa.array(ids, pa.int64()), "text": ["x" * 100] * len(ids)})
    for step in (1, 2, 3, 10):
        for size in (50, 250, 10**6):
            old, D.IN_BYTES = D.IN_BYTES, size
            try:
                out = [b["doc_id"].to_pylist() for b in D._whole(whole.slice(i, step) for i in range(0, len(ids), step))]
            finally:
                D.IN_BYTES = old
            assert sum(out, []) == ids and all(a[-1] != b[0] for a, b in zip(out, out[1:]))


def test_no_token_is_a_row(spark):
    """Tokens as rows were sorted, and spilled, by task: nothing but the texts may be exchanged or sorted."""
    plan = D.text_postings(texts(spark))._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "Aggregate" not in plan


def test_blocks_keep_every_posting(spark):
    postings = D.text_postings(texts(spark))
    moved = D.dealt(postings, F.pmod(F.hash("word"), F.lit(5)), lambda df: df.hint("rebalance", "key"))
    assert rows(moved) == rows(postings)
    plan = moved._jdf.queryExecution().optimizedPlan().toString().splitlines()
    at = next(i for i, line in enumerate(plan) if "RebalancePartitions" in line)
    assert "_pack" in plan[at + 1]


def test_segments_of_other_documents_are_not_grouped(spark, tmp_path):
    engine = Engine(spark, f"file://{tmp_path}/index", buckets=3)
    docs = texts(spark).filter("doc_id is not null").dropDuplicates(["doc_id"])
    for k in (0, 1):
        engine.add_documents(docs.filter(f"doc_id % 2 = {k}"), text_col="text")
        engine.flush()
    apart = engine.index.postings()
    assert "Aggregate" not in apart._jdf.queryExecution().optimizedPlan().toString()
    want = rows(P.build_postings(P.text_hits(docs)))
    assert rows(apart) == want
    engine.compact()
    assert rows(engine.index.postings()) == want and engine.index.docs().count() == P.text_documents(docs).count()


def test_segments_with_some_documents_again(spark, tmp_path, monkeypatch):
    engine = Engine(spark, f"file://{tmp_path}/index", buckets=3)
    batches = [texts(spark, 1), texts(spark, 2).filter("doc_id % 3 = 0 or doc_id is null"), texts(spark, 3).filter("doc_id < 9")]
    for b in batches:
        engine.add_documents(b, text_col="text")
        engine.flush()
    built = [P.build_postings(P.text_hits(b)).withColumn("batch", F.lit(n)) for n, b in enumerate(batches)]
    want = rows(P.merge_postings(built[0].unionByName(built[1]).unionByName(built[2]), "batch"))
    assert rows(engine.index.postings()) == want
    monkeypatch.setattr(index, "MOST_IDS", 1)
    assert rows(engine.index.postings()) == want
    engine.compact()
    assert rows(engine.index.postings()) == want


def test_planted_faults_build_postings_once_a_use(spark, tmp_path):
    texts(spark).write.parquet(f"{tmp_path}/documents.parquet")
    plan = QUERIES["integrity_violations"](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 2
