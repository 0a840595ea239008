"""The mixture's margins, its draws and its SQL."""

import duckdb
import pytest
from brookline.llm import mixing as mx
from brookline.llm.queries import ORACLE_SQL, QUERIES
from pyspark.sql import functions as F

ROWS = [(i, "w " * (10 * (i % 7) + 1), "hot" if i % 3 else f"s{i % 5}", "en" if i % 2 else "de", "t", 0.5) for i in range(400)]
SCHEMA = "doc_id long, text string, source string, lang string, topic string, probability double"


def test_raked_shares_are_the_targets(spark):
    cells = spark.createDataFrame([(s, g, t, 10 * (i + 1)) for i, (s, g, t) in enumerate((s, g, t) for s in "abc" for g in "xy" for t in "pq")], "source string, lang string, topic string, tokens long")
    want = {"source": {"a": 0.5, "b": 0.3, "c": 0.2}, "lang": {"x": 0.6, "y": 0.4}, "topic": {"p": 0.1, "q": 0.9}}
    rows = mx.rake(cells, targets=want, keep=0.1).collect()
    assert all(r.weight <= r.tokens for r in rows) and sum(r.weight for r in rows) == pytest.approx(78, abs=1e-6)
    total = sum(r.weight for r in rows)
    for m, goal in want.items():
        for k, v in goal.items():
            assert sum(r.weight for r in rows if r[m] == k) / total == pytest.approx(v, abs=1e-6)


def test_probabilities_and_draws(spark):
    rows = mx.mix(spark.createDataFrame(ROWS, SCHEMA)).collect()
    assert len(rows) == len(ROWS) and all(0 < r.probability <= 1 for r in rows)
    assert sum(r.probability * r.tokens for r in rows) / sum(r.tokens for r in rows) == pytest.approx(mx.KEEP, abs=1e-6)
    kept = [r for r in rows if r.sampled]
    assert abs(len(kept) - sum(r.probability for r in rows)) < 40
    again = {r.doc_id: r.sampled for r in mx.mix(spark.createDataFrame(ROWS, SCHEMA).repartition(5)).collect()}
    assert again == {r.doc_id: r.sampled for r in rows}


def test_a_small_group_is_taken_whole_and_slows_nobody_else(spark):
    """A target beyond what a group has takes all of it; the other margins are met all the same."""
    cells = spark.createDataFrame([("tiny", "x", "p", 10), ("big", "x", "p", 5000), ("big", "y", "p", 4990)], "source string, lang string, topic string, tokens long")
    rows = mx.rake(cells, targets={"source": {"tiny": 0.5, "big": 0.5}, "lang": {"x": 0.5, "y": 0.5}, "topic": {"p": 1.0}}, keep=0.5, rounds=8).collect()
    by = {(r.source, r.lang): r.weight for r in rows}
    assert by["tiny", "x"] == pytest.approx(10) and by["big", "y"] == pytest.approx(2500, rel=1e-2) and by["big", "x"] == pytest.approx(2490, rel=1e-2)


def test_shares_report_goals_and_what_is_expected(spark):
    mixed = mx.mix(spark.createDataFrame(ROWS, SCHEMA))
    for m in mx.MARGINS:
        for r in mx.shares(mixed, m).collect():
            assert r.expected == pytest.approx(r.goal, rel=1e-4) or r.expected == pytest.approx(r.tokens, rel=1e-4)


def test_columns_with_clashing_names(spark):
    frame = spark.createDataFrame(ROWS, SCHEMA)
    for m in mx.MARGINS:
        frame = frame.withColumn(f"cell_{m}", F.lit("x")).withColumn(f"cell_{m}_", F.lit(1)).withColumn(f"factor_{m}", F.lit(2))
    frame = frame.withColumns({c: F.lit(0) for c in ("weight", "goal", "tokens", "sampled", "ratio")})
    plain = sorted((r.doc_id, r.probability, r.sampled) for r in mx.mix(spark.createDataFrame(ROWS, SCHEMA)).collect())
    assert sorted((r.doc_id, r.probability, r.sampled) for r in mx.mix(frame).collect()) == plain


def test_sql_agrees(spark, sf_dir):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from read_parquet('{sf_dir}/documents.parquet')")
    want = sorted(con.sql(ORACLE_SQL["op3_mixing"]).fetchall())
    df = QUERIES["op3_mixing"](spark, sf_dir)
    assert df.columns == con.sql(ORACLE_SQL["op3_mixing"]).columns
    assert sorted(map(tuple, df.collect())) == want


def test_odd_rows(spark):
    odd = [(None, None, None, None, None, None), (1, "", "a", None, "t", 0.1), (1, "", "a", None, "t", 0.1)]
    got = mx.mix(spark.createDataFrame(odd, SCHEMA))
    assert got.columns == ["doc_id", "text", "source", "lang", "topic", "tokens", "probability", "sampled"] and got.count() == 3
    assert mx.mix(spark.createDataFrame([], SCHEMA)).count() == 0
