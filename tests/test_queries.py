"""Every query with SQL, beside DuckDB, at the smallest scale; the others by their shape."""

from pathlib import Path

import duckdb
import pytest

from panelforge.plans import catalogue

DATA = "/root/testdata/sf0.001"

SLOW = {"cross_validate", "forest_cv"}


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return con


def cells(row):
    return tuple(round(x, 6) if isinstance(x, float) else x for x in row)


def close(a, b):
    return all(x == y or (isinstance(x, float) and isinstance(y, float) and abs(x - y) <= 2e-6 * max(1, abs(x))) for x, y in zip(a, b, strict=True))


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_same_as_sql(spark, con, name):
    df = catalogue.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted((cells(r) for r in df.select(*columns).collect()), key=repr)
    want = con.execute(f"SELECT {', '.join(columns)} FROM ({catalogue.SQL[name]}) q").fetchall()
    want = sorted(map(cells, want), key=repr)
    assert len(got) == len(want)
    assert all(close(a, b) for a, b in zip(got, want, strict=True)), [(a, b) for a, b in zip(got, want, strict=True) if not close(a, b)][:3]


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.SQL) - SLOW))
def test_gives_rows(spark, name):
    assert catalogue.QUERIES[name](spark, DATA).count() > 0
