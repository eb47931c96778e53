"""The corpus queries that SQL can express, against DuckDB."""

import os

import pytest

duckdb = pytest.importorskip("duckdb")

from spanloom.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="the given tables are not here")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings", "conversations"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.execute(ORACLES[name])
    columns = [c[0] for c in want.description]
    got = QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(columns)
    assert sorted(map(str, map(tuple, got.select(*columns).collect()))) == sorted(map(str, want.fetchall()))


@pytest.mark.parametrize("name", sorted(n for n, sql in ORACLES.items() if "documents" in sql))
def test_query_equals_sql_on_odd_texts(spark, name, tmp_path):
    long = " ".join(f"w{i % 97}x{i % 89}" for i in range(3000))
    texts = [None, "", "  \t ", "one", "One", "one two", "a\u00a0b c\x1cd", long, long + " end", long.upper(), "token=abcdefg é password: '12345678'", "deadbeef" * 4 + " AKIA" + "Q7" * 9]
    rows = [(i, t, ("x", "y", None)[i % 3], ("en", None)[i % 2]) for i, t in enumerate(texts * 2)]
    spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(ORACLES[name])
    columns = [c[0] for c in want.description]
    got = QUERIES[name](spark, str(tmp_path))
    assert sorted(map(str, map(tuple, got.select(*columns).collect()))) == sorted(map(str, want.fetchall()))
