"""Every registered query of the engine against DuckDB."""

import math
import os

import duckdb
import pytest

from lodestar import catalogue

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        path = f"{DATA}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.10g}")
    return v


def ordered(rows):
    return sorted((tuple(map(plain, r)) for r in rows), key=lambda r: tuple((v is None, str(type(v)) if not isinstance(v, (int, float)) else "", v if v is not None else 0) for v in r))


@pytest.mark.parametrize("name", list(catalogue.queries()))
def test_against_duckdb(spark, duck, name):
    df = catalogue.queries()[name](spark, DATA)
    result = duck.execute(catalogue.oracle_sql()[name])
    names = [d[0] for d in result.description]
    assert len(names) == len(df.columns)
    if len(set(names)) == len(names):
        assert sorted(names) == sorted(df.columns)
        df = df.select(*(f"`{n}`" for n in names))
    assert ordered(df.collect()) == ordered(result.fetchall())
