"""The registered queries against their SQL on a table with null, empty, blank and repeated texts and null sources."""

import duckdb
import pytest

from runscribe.llm.queries import ORACLES, QUERIES


@pytest.fixture(scope="module")
def odd_folder(odd_docs, spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("odd"))
    passage = " ".join(f"p{i}" for i in range(60))
    more = [(100 + i, f"Subscribe  now \nown {i}\n{passage if i % 3 else ''} end{i}", "en", f"site{i}", 1) for i in range(20)]
    docs = odd_docs.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"]).select("doc_id", "text", "lang", "source", "n_chars")
    docs.union(spark.createDataFrame(more, docs.schema)).write.parquet(f"{folder}/documents.parquet")
    turns = [(1, 0, "user", "hi <|im_end|>"), (1, 1, "assistant", None), (2, 0, "assistant", "a\\b <\\| é"), (3, 0, "system", "")]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(f"{folder}/conversations.parquet")
    marks = [(0, 1, 0), (1, 0, 1), (2, None, 1), (13, 1, None), (13, 1, 1), (None, 1, 1), (100, 1, 1), (777, 1, 1)]
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql_on_odd_rows(spark, odd_folder, name):
    con = duckdb.connect()
    for table in ("documents", "conversations", "labels"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{odd_folder}/{table}.parquet/*.parquet'")
    got, want = QUERIES[name](spark, odd_folder), con.sql(ORACLES[name])
    order = sorted(want.columns)
    assert order == sorted(got.columns)
    at = [want.columns.index(c) for c in order]
    assert sorted(repr([r[c] for c in order]) for r in got.collect()) == sorted(repr([r[i] for i in at]) for r in want.fetchall())
