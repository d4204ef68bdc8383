"""Every registered query against its SQL on the small tables, and the registry itself."""

import decimal
import os
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__
from runscribe.registry import ORACLES as S
from runscribe.registry import QUERIES as Q

SF = "/root/testdata/sf0.001"
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{name}'")
    return con


def plain(v):
    return [plain(x) for x in v] if isinstance(v, list) else round(float(v), 6) if isinstance(v, float | decimal.Decimal) else v


@pytest.mark.parametrize("name", sorted(S))
def test_query_equals_sql(spark, tables, name):
    got = Q[name](spark, SF)
    want = tables.sql(S[name])
    assert sorted(got.columns) == sorted(want.columns)
    order = sorted(got.columns)
    at = [want.columns.index(c) for c in order]
    assert sorted(repr([plain(r[c]) for c in order]) for r in got.collect()) == sorted(repr([plain(r[i]) for i in at]) for r in want.fetchall())


def test_entry_has_rows(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_nothing_imports_the_corpus_subpackage():
    """With it hidden, the registry imports, without a session, and keeps the other queries."""
    code = "import sys; sys.modules['runscribe.llm'] = None; import __spark_entry__ as e; print(len(e.queries()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, check=True)
    assert int(out.stdout) == len(Q)
