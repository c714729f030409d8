"""Every registered repertoire query against its SQL, on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

from sparktoire.plans.registry import FLAGSHIP, ORACLES, QUERIES

DATA = Path("/root/testdata/sf0.001")
#: Fits a model for its importances, which test_models.py looks at.
SEARCHES = {"t04_importances"}


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for path in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6) + 0.0
    return value


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_sql(spark, tables, name):
    df = QUERIES[name](spark, str(DATA))
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    result = tables.execute(ORACLES[name])
    names = [x[0] for x in result.description]
    assert sorted(names) == columns
    want = sorted((tuple(plain(dict(zip(names, r, strict=True))[c]) for c in columns) for r in result.fetchall()), key=repr)
    assert got == want


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES) - SEARCHES))
def test_gives_rows(spark, name):
    df = QUERIES[name](spark, str(DATA))
    assert len(set(df.columns)) == len(df.columns) and df.count() > 0


def test_flagship_is_registered():
    assert FLAGSHIP in QUERIES and set(ORACLES) <= set(QUERIES)
