"""The registered corpus queries over the smallest tables: SQL where there is some, else rows and their defined columns."""

from collections import Counter
from pathlib import Path

import duckdb
import pytest
import test_near_dedup

from sparktoire.llm.queries import QUERIES
from sparktoire.llm.sql import ORACLES

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables")


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for path in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_sql(spark, tables, name):
    df = QUERIES[name](spark, str(DATA))
    columns = sorted(df.columns)
    result = tables.execute(ORACLES[name])
    names = [x[0] for x in result.description]
    assert sorted(names) == columns
    assert Counter(tuple(r[c] for c in columns) for r in df.collect()) == Counter(tuple(dict(zip(names, r, strict=True))[c] for c in columns) for r in result.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_one_row_for_each_of_the_table(spark, tables, name):
    source, key = ("pages", "page_id") if name.startswith("op9") else ("documents", "doc_id")
    got = [r[key] for r in QUERIES[name](spark, str(DATA)).collect()]
    assert sorted(got) == [r[0] for r in tables.execute(f"SELECT {key} FROM {source} ORDER BY 1").fetchall()]


def test_classes_of_the_documents_equal_brute_force(spark, tables):
    rows = tables.execute("SELECT doc_id, text FROM documents").fetchall()
    got = {(r.doc_id, r.class_id) for r in QUERIES["op6_minhash_near_dedup"](spark, str(DATA)).collect()}
    assert sorted(got, key=repr) == test_near_dedup.brute(rows)
