"""Every query with SQL gives the same rows as DuckDB; none is empty."""

import duckdb
import pytest
from sparloom.plans.queries import ORACLE, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def rows(df, columns):
    return sorted(tuple(repr(round(v, 9) if isinstance(v, float) else v) for v in r) for r in df[columns].astype(object).where(df[columns].notna(), None).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SF).toPandas()
    assert len(got)
    if name in ORACLE:
        want = duck.sql(ORACLE[name]).df()
        columns = sorted(got.columns)
        assert sorted(want.columns) == columns
        a, b = rows(got, columns), rows(want, columns)
        assert len(a) == len(b)
        assert a == b, [x for x in zip(a, b) if x[0] != x[1]][:3]
