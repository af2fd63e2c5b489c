"""Every registered query against its own SQL in DuckDB, on the smallest tables."""

import duckdb
import pytest

from starloom.plans import catalogue

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows(names, values, columns):
    at = [names.index(c) for c in columns]
    return sorted((tuple(round(v[i], 6) if isinstance(v[i], float) else v[i] for i in at) for v in values), key=repr)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, name):
    df, want = catalogue.QUERIES[name](spark, SF), duck.sql(catalogue.ORACLES[name])
    columns = sorted(df.columns)
    assert sorted(want.columns) == columns
    assert rows(df.columns, df.collect(), columns) == rows(want.columns, want.fetchall(), columns)
