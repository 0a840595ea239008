"""Random numbers in any row against the sequential generator, and searches for many entities against searches for one."""

import pytest
from brookline.functions import pcg
from brookline.functions.rng import Pcg32, Pmf
from brookline.plans import searches
from brookline.plans.model import ModelError
from pyspark.sql import functions as F

from .test_models import model

KEYS = ("scenario_id", "who")


def test_every_row_draws_what_the_sequence_has(spark):
    seeds = [0, 1, 42, 2**31 - 1, 2**63 - 1, -1, -(2**63)]
    df = spark.createDataFrame([(s, n) for s in seeds for n in (0, 1, 2, 63, 64, 1000)], "seed long, n long")
    got = {(r.seed, r.n): (r.v, r.u) for r in df.select("seed", "n", pcg.draw(F.col("seed"), F.col("n")).alias("v"), pcg.uniform(F.col("seed"), F.col("n")).alias("u")).collect()}
    for s in seeds:
        g = Pcg32(s)
        want = [g.next32() for _ in range(1001)]
        assert all(got[s, n] == (want[n], want[n] / 2**32) for n in (0, 1, 2, 63, 64, 1000))


def test_a_place_far_along_is_as_cheap(spark):
    far = 10**12
    a, c = 1, 0
    fa, fc, n = pcg.MULTIPLIER, pcg.INCREMENT, far + 1
    while n:
        if n & 1:
            a, c = a * fa % 2**64, (c * fa + fc) % 2**64
        fa, fc, n = fa * fa % 2**64, (fa + 1) * fc % 2**64, n >> 1
    x = (a * 7 + c) % 2**64
    v, turn = ((x >> 18 ^ x) >> 27) & 0xFFFFFFFF, x >> 59
    got = spark.range(1).select(pcg.draw(F.lit(7), F.lit(far).cast("long"))).first()[0]
    assert got == (v >> turn | v << (-turn & 31)) & 0xFFFFFFFF


def test_samples_and_bounded_numbers(spark):
    pmf = Pmf([1, 2, 5], [0.5, 0.3, 0.2])
    df = spark.range(500).select(pcg.sample(pmf, pcg.uniform(F.lit(9), F.col("id"))).alias("v"), pcg.below(F.lit(3), F.col("id"), 6).alias("b"), pcg.below(F.lit(3), F.col("id"), 2_000_000_000).alias("w"))
    rows = df.collect()
    assert [r.v for r in rows] == pmf.sample(500, 9)
    assert {r.b for r in rows} == set(range(6)) and all(0 <= r.w < 2_000_000_000 for r in rows) and max(r.w for r in rows) > 1_900_000_000


def table(spark, rows):
    """rows: who to a list of arrivals."""
    return spark.createDataFrame([(0, w, b, float(x), 0.0) for w, xs in rows.items() for b, x in enumerate(xs)], "scenario_id long, who string, bin long, arrivals double, capacity double")


M = {"arrivals": [0.0] * 4, "capacity": [0.0] * 4, "same": "capacity", "fixed": "5", "short": "MAX(0, arrivals - capacity)", "bowl": "(capacity - arrivals) * (capacity - arrivals)"}


def test_goal_seeking_of_many(spark):
    m = model(4, M)
    data = table(spark, {"a": [1, 2, 3, 4], "b": [8, 8, 8, 8], "c": [0, 0, 0, 0]})
    goals = spark.createDataFrame([(0, "a", 1.0, 0.0, 10.0), (0, "b", 3.0, 0.0, 10.0), (0, "c", 3.0, 0.0, 10.0)], "scenario_id long, who string, target double, low double, high double")
    got = {r.who: r for r in searches.goal_seek_each(m, data, KEYS, goals, "capacity", "short").collect()}
    assert got["a"].converged and sum(max(0, x - got["a"].value) for x in (1, 2, 3, 4)) / 4 == pytest.approx(1.0, abs=1e-6)
    assert got["b"].converged and got["b"].value == pytest.approx(5, abs=1e-5)
    assert not got["c"].converged and (got["c"].value, got["c"].iterations) == (0.0, 0)  # not bracketed: both ends are alike, the lower counts
    linear = goals.withColumn("target", F.lit(50.0)).withColumn("high", F.lit(100.0))
    assert {(r.converged, r.value, r.iterations) for r in searches.goal_seek_each(m, data, KEYS, linear, "capacity", "same").collect()} == {(True, 50.0, 1)}
    at_end = goals.withColumn("target", F.lit(0.0))
    assert {(r.converged, r.value, r.iterations) for r in searches.goal_seek_each(m, data, KEYS, at_end, "capacity", "same").collect()} == {(True, 0.0, 0)}
    few = searches.goal_seek_each(m, data, KEYS, goals.withColumn("target", F.col("target") * 0.37), "capacity", "short", most=4).where("who = 'b'").first()
    assert not few.converged and few.iterations == 4
    with pytest.raises(ModelError):
        searches.goal_seek_each(m, data, KEYS, goals, "short", "short")
    with pytest.raises(ModelError):
        searches.goal_seek_each(m, data, KEYS, goals, "capacity", "nothing")


def test_sensitivity_of_many(spark):
    m = model(4, {"a": 0.0, "b": 0.0, "y": "a * b"})
    data = spark.createDataFrame([(0, w, b, 0.0, 0.0) for w in "xy" for b in range(4)], "scenario_id long, who string, bin long, a double, b double")
    bases = spark.createDataFrame([(0, "x", 3.0, 2.0), (0, "y", 0.0, 7.0)], "scenario_id long, who string, a double, b double")
    got = {(r.who, r.parameter): (round(r.gradient, 9), r["rank"]) for r in searches.sensitivity_each(m, data, KEYS, bases, "y").collect()}
    assert got == {("x", "b"): (3, 1), ("x", "a"): (2, 2), ("y", "a"): (0, 1), ("y", "b"): (0, 2)}


def test_nelder_mead_of_many(spark):
    nodes = {"p": 0.0, "q": 0.0, "c": 0.0, "d": 0.0, "f": "(p - c) * (p - c) + 2 * (q - d) * (q - d)", "g": "0 - (p - 9) * (p - 9)"}
    m = model(2, nodes)
    data = spark.createDataFrame([(0, w, b, float(c), float(d)) for w, c, d in (("x", 3, -1), ("y", -4, 2)) for b in range(2)], "scenario_id long, who string, bin long, c double, d double")
    got = {r.who: r for r in searches.optimise_each(m, data, KEYS, data, {"p": (-10, 10), "q": (-10, 10)}, "f").collect()}
    for who, c, d in (("x", 3, -1), ("y", -4, 2)):
        assert got[who].converged and abs(got[who].p - c) < 0.05 and abs(got[who].q - d) < 0.05
    top = searches.optimise_each(m, data, KEYS, data, {"p": (0, 5)}, "g", maximise=True).collect()
    assert {round(r.p, 3) for r in top} == {5.0} and all(r.mean == pytest.approx(-16, abs=1e-2) for r in top)
    assert {(r.converged, r.iterations) for r in searches.optimise_each(m, data, KEYS, data, {"p": (-10, 10), "q": (-10, 10)}, "f", most=3).collect()} == {(False, 3)}


def test_rounds_do_not_make_their_data_again(spark, monkeypatch):
    """A search's data is made once; before, each round read and aggregated the events anew."""
    from brookline.plans import searches
    from pyspark.sql import functions as F

    plans, mean_at = [], searches.mean_at

    def noted(model, data, *rest):
        plans.append(data._jdf.queryExecution().optimizedPlan().toString())
        return mean_at(model, data, *rest)

    monkeypatch.setattr(searches, "mean_at", noted)
    model = {"grid": {"bins": 2, "binSize": 1, "binUnit": "days"}, "nodes": [*({"id": i, "kind": "const", "values": [0.0, 0.0]} for i in ("a", "x")), {"id": "y", "kind": "expr", "expr": "(a - x) * (a - x)"}]}
    data = spark.range(6).groupBy(F.lit(0).cast("long").alias("scenario_id"), (F.col("id") % 3).alias("who"), (F.col("id") % 2).alias("bin")).agg(F.count("*").cast("double").alias("a"))
    searches.optimise_each(model, data, ("scenario_id", "who"), data.select("scenario_id", "who"), {"x": (0.0, 4.0)}, "y", most=2)
    goals = data.select("scenario_id", "who", F.lit(0.5).alias("target"), F.lit(0.0).alias("low"), F.lit(1.0).alias("high")).distinct()
    searches.goal_seek_each(model, data, ("scenario_id", "who"), goals, "x", "y", most=2, depth=1)
    assert len(plans) > 3 and not any("Range" in p or "Aggregate" in p for p in plans)
