"""Golden scores on five documents, both plans against brute force, the stored index and streams."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from spindex import And, Approx, Engine, Exact, Kw, Not, Or
from spindex.operators import postings as P
from spindex.plans import commands, pivot
from spindex.schema import should_flush
from spindex.sources.index import Manifest, StoredIndex
from tests import joins

MICRO = {1: [("cat", 10), ("dog", 10), ("cat", 10)], 2: [("dog", 10), ("cat", 10)], 3: [("cat", 50), ("bird", 10)], 4: [("dog", 10), ("bird", 10), ("fish", 10)], 7: [("cat", 10), ("x", 10), ("dog", 10)]}
WORDS = "doc_id long, words array<struct<word:string,weight:int>>"


@pytest.fixture(scope="module")
def micro(spark):
    return P.build_postings(P.weighted_hits(spark.createDataFrame(list(MICRO.items()), WORDS))).cache()


def ids(postings):
    return postings.select("doc_id").distinct()


def scores(df):
    return {r["doc_id"]: round(r["relevance"], 6) for r in df.collect()}


CAT, DOG, BIRD = Kw("cat"), Kw("dog"), Kw("bird")
GOLDEN = [
    (CAT, {1: 1.970443, 2: 0.990099, 3: 4.854369, 7: 0.985222}),
    (DOG, {1: 0.985222, 2: 0.990099, 4: 0.985222, 7: 0.985222}),
    (BIRD, {3: 0.970874, 4: 0.985222}),
    (And(CAT, DOG), {1: 1.941323, 2: 0.980296, 7: 0.970662}),
    (Or(CAT, DOG), {1: 2.955665, 2: 1.980198, 3: 4.854369, 4: 0.985222, 7: 1.970443}),
    (And(CAT, Not(DOG)), {3: 4.854369}),
    (Exact((CAT, DOG)), {1: 0.985222}),
    (Approx((CAT, DOG)), {1: 4.802956, 2: 1.485149, 7: 2.463054}),
    (Not(CAT), {4: 1.0}),
    (Kw("missing"), {}),
]


@pytest.mark.parametrize("plan", [pivot.evaluate, joins.evaluate])
@pytest.mark.parametrize("query,expected", GOLDEN, ids=lambda x: str(x)[:40])
def test_golden(micro, plan, query, expected):
    assert scores(plan(query, micro, ids(micro))) == expected


@pytest.mark.parametrize("plan", [pivot.evaluate, joins.evaluate])
def test_not_over_a_range(micro, plan):
    assert scores(plan(Not(CAT), micro, universe="range", doc_start=1, doc_stop=7)) == {4: 1.0, 5: 1.0, 6: 1.0}
    with pytest.raises(ValueError):
        plan(Not(CAT), micro, universe="range")


def test_commands(micro):
    def ids(df):  # noqa: F811
        return [r["doc_id"] for r in df.orderBy("rank").collect()]

    cat = pivot.evaluate(CAT, micro)
    assert ids(commands.top(cat, 2)) == [3, 1] and commands.total(cat).first()[0] == 4
    assert ids(commands.top(cat, 2, 2)) == [2, 7]
    assert ids(commands.top(cat, 2, 9)) == [] and ids(commands.top(cat, 0)) == []
    assert ids(commands.top(pivot.evaluate(DOG, micro), 4)) == [2, 7, 4, 1]
    assert sorted(scores(commands.at_least(cat, 100))) == [1, 3]
    assert sorted(scores(commands.at_least(cat, 98.52216, single_precision=True))) == [1, 2, 3, 7]
    assert sorted(scores(pivot.evaluate(CAT, micro, doc_start=2, doc_stop=3))) == [2, 3]
    for bad in (lambda: commands.at_least(cat, -1), lambda: commands.top(cat, -1)):
        with pytest.raises(ValueError):
            bad()


# Brute force over word lists.


def brute(node, docs):
    """{doc_id: relevance} as the formulas say, straight from the word lists."""
    size = {d: sum(w for _, w in ws) for d, ws in docs.items()}

    def hits(n, d):
        if isinstance(n, Kw):
            return [(p, w) for p, (x, w) in enumerate(docs[d]) if x == n.word]
        return sorted(hits(n.right, d) + hits(n.left, d), key=lambda h: h[0])

    def run(n):
        if isinstance(n, Kw):
            return {d: sum(w for _, w in hits(n, d)) * 200 / (size[d] + 2000) for d in docs if hits(n, d)}
        if isinstance(n, Not):
            gone = run(n.node)
            return {d: 1.0 for d in docs if d not in gone}
        if isinstance(n, (And, Or)):
            a, b = run(n.left), run(n.right)
            if isinstance(n, And):
                return {d: a[d] * b[d] for d in a if d in b}
            return {d: a.get(d, 0) + b.get(d, 0) for d in {*a, *b}}
        out, k = {}, len(n.nodes)
        for d in docs:
            lists = [hits(c, d) for c in n.nodes]
            if not all(lists):
                continue
            norm = 200 / ((size[d] + 2000) * k)
            if isinstance(n, Exact):
                total = 0
                for p, w in lists[0]:
                    later = [next((x for q, x in h if q == p + j), None) for j, h in enumerate(lists[1:], 1)]
                    if None not in later:
                        total += w + sum(later)
                if total:
                    out[d] = total * norm
            else:
                raw = 0
                for combo in itertools.product(*lists):
                    raw += math.prod(w for _, w in combo) * math.prod(1 / (q - p) if q > p else 0.3 / (p - q) for (p, _), (q, _) in zip(combo, combo[1:]))
                out[d] = raw / math.prod(map(len, lists)) * sum(map(len, lists)) / k * norm
        return out

    return run(node)


def tree(r, depth):
    kind = r.choice(["kw"] if not depth else ["kw", "and", "or", "not", "exact", "approx"])
    word = lambda: Kw(r.choice("abcde"))
    if kind == "kw":
        return word()
    if kind == "not":
        return Not(tree(r, depth - 1))
    if kind in ("and", "or"):
        return (And if kind == "and" else Or)(tree(r, depth - 1), tree(r, depth - 1))
    if kind == "exact":
        return Exact(tuple(Or(word(), word()) if r.random() < 0.3 else word() for _ in range(r.randint(2, 3))))
    chosen = r.sample("abcde", 3)
    return Approx((Or(Kw(chosen[0]), Kw(chosen[1])), Kw(chosen[2]))) if r.random() < 0.3 else Approx(tuple(map(Kw, chosen[: r.randint(2, 3)])))


def test_both_plans_against_brute_force(spark):
    r = random.Random(5)
    docs = {d: [(r.choice("abcdefgh"), r.choice([0, 10, 10, 50])) for _ in range(r.randint(1, 14))] for d in range(25)}
    postings = P.build_postings(P.weighted_hits(spark.createDataFrame(list(docs.items()), WORDS))).cache()
    universe = ids(postings).cache()
    for _ in range(14):
        query = tree(r, 3)
        expected = brute(query, docs)
        for plan in (pivot.evaluate, joins.evaluate):
            got = {x["doc_id"]: x["relevance"] for x in plan(query, postings, universe).collect()}
            assert got.keys() == expected.keys(), (plan.__module__, query)
            assert all(math.isclose(got[d], expected[d], rel_tol=1e-9, abs_tol=1e-12) for d in got), (plan.__module__, query)


def test_properties(micro):
    docs = ids(micro)
    run = lambda q: scores(pivot.evaluate(q, micro, docs))
    assert run(And(CAT, DOG)) == run(And(DOG, CAT)) and run(Or(CAT, DOG)) == run(Or(DOG, CAT))
    assert len(run(Or(CAT, DOG))) == len(run(CAT)) + len(run(DOG)) - len(run(And(CAT, DOG)))
    assert run(Exact((CAT, DOG))).keys() <= run(And(CAT, DOG)).keys() == run(Approx((CAT, DOG))).keys()


def test_one_scan_one_exchange(micro, spark, tmp_path):
    micro.write.parquet(str(tmp_path / "p"))
    stored = spark.read.parquet(str(tmp_path / "p"))
    plan = pivot.evaluate(And(CAT, Not(DOG)), stored, doc_start=2)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation") == 1 and "Join" not in plan
    physical = pivot.evaluate(And(CAT, Not(DOG)), stored, doc_start=2)._jdf.queryExecution().executedPlan().toString()
    assert physical.count("Exchange") == 1 and "GreaterThanOrEqual(doc_id,2)" in physical and "hits" not in physical.split("ReadSchema")[1].split("\n")[0]


# Stored index.


def text_docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_engine(spark, tmp_path):
    engine = Engine(spark, f"file://{tmp_path}/index", buckets=4)
    assert engine.query_top("cat", 5).total == 0
    engine.add_documents(text_docs(spark, [(1, "cat dog cat"), (2, "dog cat"), (5, None)]), text_col="text")
    assert engine.query_top("cat", 5).total == 0  # not flushed yet
    engine.flush()
    engine.add_documents(spark.createDataFrame([(3, MICRO[3]), (4, MICRO[4]), (7, MICRO[7])], WORDS), words_col="words")
    engine.flush()
    top = engine.query_top("cat", 2)
    assert [(r["rank"], r["doc_id"]) for r in top.fetch()] == [(1, 3), (2, 1)] and top._total == 4
    assert [r["doc_id"] for r in engine.query_top("cat", 2, 2).fetch()] == [2, 7] and engine.query_top("cat", 0).fetch() == [] and engine.query_top("cat", 0).total == 4
    assert [r["doc_id"] for r in top.page.orderBy("rank").collect()] == [3, 1] and top.total == 4
    assert [r["doc_id"] for r in engine.query_filter("cat", 100).collect()] == [1, 3]
    assert [r["doc_id"] for r in engine.query_filter("cat", docID_start=2, docID_stop=3).collect()] == [2, 3]
    assert scores(engine.matches("NOT cat")) == {4: 1.0}
    assert {r["word"]: r["df"] for r in engine.document_frequency(["cat", "dog"]).collect()} == {"cat": 4, "dog": 4}
    assert engine.max_document(["bird"]).first()["max_doc_id"] == 4
    plan = engine.index.postings(["cat", "dog"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan and "hash(" not in plan.split("PartitionFilters")[1].split("]")[0] and "In(word, [cat,dog])" in plan
    before = scores(engine.matches('"cat dog" OR bird'))
    assert engine.check_integrity().count() == 0
    engine.compact()
    assert len(engine.index.segments()) == 1 and scores(engine.matches('"cat dog" OR bird')) == before
    with pytest.raises(ValueError):
        engine.add_documents(text_docs(spark, [(1, "again")]), text_col="text", on_duplicate="error")
    engine.add_documents(text_docs(spark, [(1, "bird cat")]), text_col="text")
    engine.flush()
    one = engine.index.postings().filter("doc_id = 1 and word = 'cat'").first()
    assert (one["tf"], one["doc_size"], [h["pos"] for h in one["hits"]]) == (3, 30, [0, 1, 2])
    engine.compact(purge_before=3)
    assert sorted(r["doc_id"] for r in engine.index.docs().collect()) == [3, 4, 7]


def test_two_batches_equal_one(spark):
    docs = text_docs(spark, [(i, f"w{i % 3} w{i % 5} x") for i in range(30)])
    halves = [P.build_postings(P.text_hits(docs.filter(f"doc_id % 2 = {k}"))).withColumn("batch", F.lit(k)) for k in (0, 1)]
    merged = P.merge_postings(halves[0].unionByName(halves[1]), "batch")
    whole = P.build_postings(P.text_hits(docs))
    assert sorted(map(str, merged.select(whole.columns).collect())) == sorted(map(str, whole.collect()))


def test_retried_batch_counts_once(spark, tmp_path):
    from spindex.streaming.ingest import publish_batch

    engine = Engine(spark, f"file://{tmp_path}/index", buckets=2)
    batch = text_docs(spark, [(1, "cat dog cat")])
    for _ in range(2):
        publish_batch(engine.index, batch, 7)
    assert engine.index.postings(["cat"]).first()["tf"] == 2 and len(engine.index.segments()) == 1
    publish_batch(engine.index, text_docs(spark, [(2, "cat")]), 8)
    engine.compact()
    publish_batch(engine.index, text_docs(spark, [(2, "cat")]), 8)  # its segment has been merged away
    publish_batch(engine.index, text_docs(spark, [(3, "cat")]), 8, stream="another")
    assert {r["doc_id"]: r["tf"] for r in engine.index.postings(["cat"]).collect()} == {1: 2, 2: 1, 3: 1}


def test_stream(spark, tmp_path):
    text_docs(spark, [(1, "cat dog"), (2, "bird")]).write.parquet(f"{tmp_path}/in")
    engine = Engine(spark, f"file://{tmp_path}/index", buckets=2)
    stream = spark.readStream.schema("doc_id long, text string").parquet(f"{tmp_path}/in")
    engine.start_ingest(stream, f"{tmp_path}/checkpoint", available_now=True).awaitTermination()
    assert {r["doc_id"] for r in engine.matches("cat OR bird").collect()} == {1, 2}


def test_weights_are_checked(spark):
    with pytest.raises(ValueError):
        P.text_hits(text_docs(spark, []), weight=101)
    with pytest.raises(Exception, match="not a weighted word"):
        P.weighted_hits(spark.createDataFrame([(1, [("a", 101)])], WORDS)).collect()


def test_integrity_finds_faults(spark):
    schema = "word string, doc_id long, doc_size long, tf int, sum_w long, hits array<struct<pos:int,weight:smallint>>"
    bad = spark.createDataFrame([("a", 1, 20, 2, 20, [(3, 10), (1, 10)]), ("b", 1, 20, 1, 20, [(3, 10), (4, 10)]), ("c", 1, 5, 1, 10, [(3, 10)]), ("d", 1, 10, 1, 10, [(0, 10)]), ("d", 1, 10, 1, 10, [(0, 10)])], schema)
    assert {(r["word"], r["problem"]) for r in P.integrity_violations(bad).collect()} == {("a", "hits out of order"), ("b", "tf differs"), ("c", "size below weights"), ("d", "twice")}


def test_flush_rule():
    assert not should_flush(166, 40) and should_flush(167, 0) is True and should_flush(0, 10_001) and should_flush(0, 0, forced=True)


def test_postings_are_built_without_a_shuffle_of_tokens(spark):
    docs = text_docs(spark, [(1, "b a b"), (1, "b c"), (2, "a"), (3, None), (4, ""), (None, "a"), (None, "a")])
    for by_document in (True, False):
        built = P.build_postings(P.text_hits(docs, by_document=by_document))
        plan = built._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == 1 and (plan.index("Exchange") > plan.index("Generate")) == by_document  # below the tokens, or above
        assert sorted((r["word"], r["doc_id"] or 0, r["tf"], r["doc_size"], [h["pos"] for h in r["hits"]]) for r in built.collect()) == [("a", 0, 2, 10, [0, 0]), ("a", 1, 1, 30, [1]), ("a", 2, 1, 10, [0]), ("b", 1, 3, 30, [0, 0, 2]), ("c", 1, 1, 20, [1])]


def test_many_segments_are_one_relation(spark, tmp_path):
    index = StoredIndex(spark, f"file://{tmp_path}/index", buckets=2)
    name = index.write_hits(P.text_hits(text_docs(spark, [(1, "cat dog")])))
    import shutil

    names = [name]
    for i in range(199):
        for kind in ("postings", "docs"):
            shutil.copytree(f"{tmp_path}/index/{kind}/segment={name}", f"{tmp_path}/index/{kind}/segment=s{i:03d}")
        names.append(f"s{i:03d}")
    index.publish(lambda m: m.segments.update({n: 1 for n in names}))
    found = pivot.evaluate(CAT, index.postings(["cat"]))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation") == 1 and "Union" not in plan and index.postings(["cat"]).first()["tf"] == 200


def test_upkeep_merges_tiers_and_keeps_what_was_added(spark, tmp_path):
    engine = Engine(spark, f"file://{tmp_path}/index", buckets=2)
    for i in range(11):
        engine.add_documents(text_docs(spark, [(i, f"cat w{i}"), (100, "bird" + " bird" * i)]), text_col="text")
        engine.flush()
        assert len(engine.index.segments()) <= 8
    assert {r["doc_id"] for r in engine.matches("cat").collect()} == set(range(11))
    bird = engine.index.postings(["bird"]).first()
    assert bird["tf"] == sum(range(1, 12)) and bird["doc_size"] == 10  # the oldest size, whatever was merged
    assert StoredIndex._run({"a": 900, "b": 3, "c": 4, "d": 2, "e": 70}, 3) == [] and StoredIndex._run({"a": 900, "b": 3, "c": 4, "d": 5}, 3) == ["b", "c", "d"]
    visible = set(engine.index.segments())
    assert engine.index.vacuum(keep_s=3600) == []
    engine.index.vacuum(keep_s=-1)
    assert {p.name for p in (tmp_path / "index" / "postings").iterdir()} == {f"segment={s}" for s in visible} and len(list((tmp_path / "index" / "manifest").glob("*.json"))) == 1
    assert {r["doc_id"] for r in engine.matches("cat").collect()} == set(range(11))


def test_writers_at_once_lose_nothing(spark, tmp_path):
    one, other = (StoredIndex(spark, f"file://{tmp_path}/index", buckets=2) for _ in range(2))
    first = one.write_hits(P.text_hits(text_docs(spark, [(1, "cat")])))
    second = other.write_hits(P.text_hits(text_docs(spark, [(2, "cat")])))
    stale, calls = Manifest(), []
    fresh = other.manifest

    def late():
        calls.append(1)
        return stale if len(calls) == 1 else fresh()

    one.add([first])
    other.manifest = late  # has read the manifest before the first one published
    other.publish(lambda m: m.segments.update({second: 1}))
    assert one.segments() == [first, second] and len(calls) == 2


def test_flush_when_due(spark, tmp_path):
    engine = Engine(spark, f"file://{tmp_path}/index", buckets=2)
    engine.add_documents(text_docs(spark, [(1, "cat"), (2, "cat dog")]), text_col="text")
    assert {r["word"]: r["df"] for r in engine.buffered().collect()} == {"cat": 2, "dog": 1} and engine.query_top("cat", 5).total == 0
    assert not engine.flush_if_due(idle_s=100) and engine.flush_if_due(idle_s=167) and engine.query_top("cat", 5).total == 2
    assert engine.buffered().count() == 0 and not engine.flush_if_due(idle_s=1e6)
    own = Engine(spark, f"file://{tmp_path}/own", buckets=2, auto_flush=True)
    own.add_documents(spark.range(10_001).selectExpr("id AS doc_id", "'cat' AS text"), text_col="text")
    assert own.query_top("cat", 1).total == 10_001


def test_stop_drops_what_waits(spark, tmp_path):
    engine = Engine(spark, f"file://{tmp_path}/index", buckets=2)
    engine.add_documents(text_docs(spark, [(1, "cat")]), text_col="text")
    engine.stop()
    engine.flush()
    assert engine.query_top("cat", 5).total == 0
