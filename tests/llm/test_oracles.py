"""The operators' queries against their SQL, on the smallest tables."""

import math

import duckdb
import pytest
from brookline.llm.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", list(ORACLE_SQL))
def test_query_matches_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    df, rel = QUERIES[name](spark, sf_dir), con.sql(ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(rel.columns)
    at = [rel.columns.index(c) for c in df.columns]
    plain = lambda rows: sorted((tuple(round(x, 5) if isinstance(x, float) and not math.isnan(x) else x for x in r) for r in rows), key=str)
    assert plain(df.collect()) == plain(tuple(r[i] for i in at) for r in rel.fetchall())


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_has_its_rows(spark, sf_dir, name):
    table = {"op1": "pages", "op11": "embeddings"}.get(name.split("_")[0], "documents")
    n, got = spark.read.parquet(f"{sf_dir}/{table}.parquet").count(), QUERIES[name](spark, sf_dir)
    assert got.count() == n * (4 if table == "embeddings" else 1) or name in ("op8_packing", "op9_bm25_topk")
