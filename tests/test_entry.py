"""The registered queries against their SQL on the smallest tables, where these are there."""

import os

import pytest

import __spark_entry__ as entry

SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
ENGINE = [
    "postings_build", "integrity_violations", "kw_score", "nested_bool", "exact_or_child", "approx3", "approx_frequent", "dict_tree", "query_top_page", "query_filter_single", "not_range", "weighted_title", "parse_approx",
    "compat_or_first", "compat_group_in_phrase", "compat_not_lost", "compat_open_group", "merge_readd", "stream_ingest", "stored_query", "stored_purge", "stored_readd", "delta_count",
]

pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="needs the test tables")


def test_every_sql_has_a_query():
    assert entry.oracle_sql().keys() <= entry.queries().keys()


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", ENGINE)
def test_against_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    df = entry.queries()[name](spark, SMALL)
    cur = con.execute(entry.oracle_sql()[name])
    names = [c[0] for c in cur.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted(map(str, (tuple(r[names.index(c)] for c in df.columns) for r in cur.fetchall())))
    assert sorted(map(str, map(tuple, df.collect()))) == want
