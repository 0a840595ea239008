"""Every query of the flow operators against its SQL in DuckDB."""

import math

import duckdb
import pytest
from brookline import queries

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return c


def plain(rows):
    def value(x):
        return round(float(x), 5) + 0.0 if isinstance(x, float) and not math.isnan(x) else x

    return sorted((tuple(map(value, r)) for r in rows), key=str)


@pytest.mark.parametrize("name", list(queries.ORACLE_SQL))
def test_query_matches_sql(spark, sf_dir, con, name):
    df, rel = queries.QUERIES[name](spark, sf_dir), con.sql(queries.ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(rel.columns)
    at = [rel.columns.index(c) for c in df.columns]
    assert plain(df.collect()) == plain(tuple(r[i] for i in at) for r in rel.fetchall())


@pytest.mark.parametrize("name", [q for q in queries.QUERIES if q not in queries.ORACLE_SQL])
def test_other_queries_give_rows(spark, sf_dir, name):
    assert queries.QUERIES[name](spark, sf_dir).count() > 0
