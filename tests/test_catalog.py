"""Every query of the catalogue against its SQL in DuckDB, on the smallest tables."""

import duckdb
import pytest

from tessera.plans.catalog import QUERIES, SQL  # the package registers those of its other modules there

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def rows(df):
    df = df[sorted(df.columns)]
    cell = lambda x: "~" if x is None or x != x else f"{x:.5f}" if isinstance(x, float) else str(x).replace(" 00:00:00", "")
    return list(df.columns), sorted(tuple(cell(x) for x in r) for r in df.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, db):
    got = rows(QUERIES[name](spark, SF).toPandas())
    if name in SQL:
        assert got == rows(db.sql(SQL[name]).df())
    else:
        assert got[0]
