"""Models with known series (inputs made anew here), the language, validation, and searches."""

import pytest
from brookline.operators import classes
from brookline.plans import scenarios as sc
from brookline.plans.compiler import by_class, evaluate, evaluate_staged, plan
from brookline.plans.graph import levels
from brookline.plans.expr import ExpressionError, parse, references, to_column, to_sql
from pyspark.sql.functions import expr as spark_expr
from brookline.plans.model import ModelError, bin_times, load, model_hash, outputs, queue_series, run_id, schema_errors, snake, substitute, validate


def model(bins, nodes, topo=(), constraints=(), **more):
    made = [{"id": k, "kind": "expr", "expr": v} if isinstance(v, str) else {"id": k, **v} if isinstance(v, dict) else {"id": k, "kind": "const", "values": v if isinstance(v, list) else [v] * bins} for k, v in nodes.items()]
    return {"grid": {"bins": bins, "binSize": 1, "binUnit": "hours"}, "nodes": made, "topology": {"nodes": list(topo), "edges": [], "constraints": list(constraints)}, **more}


def swb(i, arrivals, served, **more):
    return {"id": i, "kind": "serviceWithBuffer", "semantics": {"arrivals": arrivals, "served": served}, **more}


def series(spark, m, *names):
    rows = evaluate(spark, m).orderBy("bin").collect()
    return [[round(r[n], 9) for r in rows] for n in names] if len(names) > 1 else [round(r[names[0]], 9) for r in rows]


def test_constants_expressions_and_pmf(spark):
    m = model(5, {"a": [10.0, 20, 30, 40, 50], "served": "a * 0.8", "s2": "SHIFT(a, 2)", "late": "served + SHIFT(served, 1)", "imp": [100.0, 0, 0, 0, 0], "echo": "CONV(imp, [0, .6, .3, .1])", "p": {"kind": "pmf", "pmf": {"values": [1, 2, 3], "probabilities": [0.2, 0.5, 0.3]}}, "neg": "-a + [1, 2, 3, 4, 5]"})
    assert series(spark, m, "served", "s2", "echo", "p", "neg") == [[8, 16, 24, 32, 40], [0, 0, 10, 20, 30], [0, 60, 30, 10, 0], [2.1] * 5, [-9, -18, -27, -36, -45]]
    assert series(spark, m, "late") == [8, 24, 40, 56, 72]


def test_queues(spark):
    assert series(spark, model(4, {"i": 10.0, "o": 3.0}, [swb("Q", "i", "o")]), "q_queue") == [7, 14, 21, 28]
    m = model(4, {"i": 10.0, "o": 2.0}, [swb("Q", "i", "o", wipLimit=20)])
    assert series(spark, m, "q_queue", "Q__overflow") == [[8, 16, 20, 20], [0, 0, 4, 8]]
    m = model(6, {"i": 10.0, "o": 5.0}, [swb("Q", "i", "o", dispatchSchedule={"kind": "periodic", "periodBins": 3, "phaseOffset": 0})])
    assert series(spark, m, "q_queue") == [5, 15, 25, 30, 40, 50]
    m = model(3, {"i": 1.0, "o": 3.0}, [swb("Q", "i", "o", initialCondition={"queueDepth": 5})])
    assert series(spark, m, "q_queue") == [3, 1, 0]


def test_overflow_cascade(spark):
    m = model(3, {"ai": 20.0, "ao": 5.0, "z": 0.0}, [swb("A", "ai", "ao", wipLimit=10, wipOverflow="B"), swb("B", "z", "z", wipLimit=5, wipOverflow="C"), swb("C", "z", "z")])
    assert series(spark, m, "a_queue", "A__overflow", "b_queue", "B__overflow", "c_queue") == [[10] * 3, [5, 15, 15], [5] * 3, [0, 15, 15], [0, 15, 30]]


def test_back_pressure_cycle(spark):
    m = model(6, {"raw": 100.0, "served": 20.0, "cap": 50.0, "pressure": "CLAMP(depth / cap, 0, 1)", "late": "SHIFT(pressure, 1)", "eff": "raw * (1 - late)"}, [{"id": "Q", "kind": "serviceWithBuffer", "semantics": {"arrivals": "eff", "served": "served", "queueDepth": "depth"}}])
    assert series(spark, m, "depth") == [80, 60, 40, 40, 40, 40]


def test_routers_and_constraints(spark):
    traffic = {"arrivals": [{"nodeId": "src", "classId": c, "pattern": {"kind": "const", "ratePerBin": v}} for c, v in (("Alpha", 40), ("Beta", 60))]}
    router = lambda *routes: {"kind": "router", "router": {"inputs": {"queue": "src"}, "routes": list(routes)}}
    m = model(3, {"src": 100.0, "r": router({"target": "a", "classes": ["Alpha"]}, {"target": "b", "weight": 0.75}, {"target": "c", "weight": 0.25})}, traffic=traffic)
    assert series(spark, m, "a", "b", "c") == [[40] * 3, [45] * 3, [15] * 3]
    m = model(3, {"src": 100.0, "r": router({"target": "a", "weight": 0.6}, {"target": "b", "weight": 0.4}), "cap": 50.0, "five": 5.0}, [swb("Qa", "a", "five", constraints=["x"]), swb("Qb", "b", "five", constraints=["x"])], [{"id": "x", "semantics": {"served": "cap"}}])
    assert series(spark, m, "qa_queue", "qb_queue") == [[25, 50, 75], [15, 30, 45]]
    m = model(3, {"a": 30.0, "b": 40.0, "cap": 80.0, "ten": 10.0}, [swb("Qa", "a", "ten", constraints=["x"]), swb("Qb", "b", "ten", constraints=["x"])], [{"id": "x", "semantics": {"served": "cap"}}])
    assert series(spark, m, "qa_queue", "qb_queue") == [[20, 40, 60], [30, 60, 90]]


def test_retry_echo_of_a_node(spark):
    m = model(5, {"i": 10.0, "o": 3.0, "e": 10.0}, [{"id": "S", "kind": "service", "semantics": {"arrivals": "i", "served": "o", "errors": "e", "retryKernel": [0, 0.6, 0.3, 0.1], "retryEcho": "echo"}}])
    assert series(spark, m, "echo") == [0, 6, 9, 10, 10]


def test_overrides_are_scenarios_of_one_plan(spark):
    m = model(4, {"i": 10.0, "o": 3.0}, [swb("Q", "i", "o")])
    df = sc.sweep(spark, m, "o", [0.0, 5.0, 20.0])
    got = {r.scenario_id: r.q for r in df.where("bin = 3").selectExpr("scenario_id", "q_queue as q").collect()}
    assert got == {0: 40, 1: 20, 2: 0}
    single = spark.createDataFrame([(0, "i", 1, 100.0), (0, "nothing", None, 1.0)], "scenario_id long, series string, bin long, value double")
    assert [r.i for r in evaluate(spark, m, single).orderBy("bin").collect()] == [10, 100, 10, 10]
    with pytest.raises(ModelError):
        sc.sweep(spark, m, "q_queue", [1.0])


def test_session(spark):
    s = sc.Session(spark, model(3, {"i": 10.0, "o": 4.0}, [swb("Q", "i", "o")]))
    assert s.parameters() == {"i": 10.0, "o": 4.0}
    assert [r.q_queue for r in s.series("q_queue").orderBy("bin").collect()] == [6, 12, 18]
    assert [r.q_queue for r in s.eval(o=10.0).orderBy("bin").collect()] == [0, 0, 0]


def test_sensitivity_and_searches(spark):
    m = model(4, {"a": 3.0, "b": 2.0, "zero": 0.0, "y": "a * b + zero"})
    rows = sc.sensitivity(spark, m, "y", ["a", "b", "zero", "y"]).collect()
    assert [(r.parameter, round(r.gradient, 6)) for r in rows] == [("b", 3.0), ("a", 2.0), ("zero", 0.0)]
    calls = []

    def at(xs):
        calls.append(len(xs))
        return [x * x for x in xs]

    got = sc.goal_seek(at, 2.0, 0.0, 4.0)
    assert got["converged"] and abs(got["value"] - 2**0.5) < 1e-5 and len(calls) < 12
    assert not sc.goal_seek(at, 99.0, 0.0, 4.0)["converged"]
    best = sc.optimise(lambda ps: [(p["x"] - 3) ** 2 + (p["y"] + 1) ** 2 for p in ps], {"x": (-10, 10), "y": (-10, 10)})
    assert abs(best["parameters"]["x"] - 3) < 0.05 and abs(best["parameters"]["y"] + 1) < 0.05
    assert sc.optimise(lambda ps: [-abs(p["x"] - 9) for p in ps], {"x": (0, 5)}, maximise=True)["parameters"]["x"] == pytest.approx(5)


@pytest.mark.parametrize("text", ["a +", "foo(a)", "MIN(a)", "a > b", "a ** 2", "'x'", "a if b else c", "a.b", "SHIFT(a, -1)", "SHIFT(a, 1.5)", "PULSE(0)"])
def test_expressions_outside_the_language(spark, text):
    with pytest.raises((ExpressionError, ValueError)):
        to_column(parse(text))


def test_references():
    assert references(parse("a + SHIFT(b, 1) + SHIFT(a, 2) + SHIFT(c, 0)")) == ({"a", "c"}, {"b"})


def test_validation():
    assert "2 values for 3 bins" in " ".join(schema_errors(model(3, {"a": [1.0, 2.0]})))
    assert schema_errors({"grid": {"bins": 0}}) and schema_errors(model(2, {"a": 1.0, "A": 2.0})) and schema_errors(model(2, {"p": {"kind": "pmf", "pmf": {"values": [1, 1], "probabilities": [0.5, 0.5]}}}))
    assert schema_errors(model(2, {"i": 1.0}, [swb("A", "i", "i", wipLimit=1, wipOverflow="B"), swb("B", "i", "i", wipLimit=1, wipOverflow="A")]))
    assert "nothing makes" in validate(model(2, {"a": "b + 1"}))[0]
    assert "within a bin" in validate(model(2, {"a": "b + 1", "b": "a"}))[0]
    assert "initial value" in validate(model(2, {"a": 1.0, "b": "a + SHIFT(b, 1)"}))[0]
    assert len(plan(model(2, {"a": 1.0, "b": "a", "c": "b"}))) == 3


def test_model_text():
    text = '{"grid": {"bins": ${n}, "binSize": 1, "binUnit": "hours"}, "nodes": []}'
    m = load(substitute(text, {"n": {"default": 4, "min": 1, "max": 9}}))
    assert m["grid"]["bins"] == 4 and run_id("My run!", m) == run_id("My run!", dict(reversed(m.items()))) and len(model_hash(m)) == 64
    for bad in ({"n": 10}, {"x": 1}):
        with pytest.raises(ModelError):
            substitute(text, {"n": {"default": 4, "min": 1, "max": 9}}, bad)
    assert outputs({"outputs": [{"series": "A/*"}, {"series": "B"}]}, ["a/x", "a/y", "b", "c"]) == ["a/x", "a/y", "b"] and outputs({}, ["z"]) == ["z"]
    assert snake("OrderService") == "order_service" and queue_series({"id": "DLQ"}) == "dlq_queue"


def test_times_and_levels(spark):
    grid = {"bins": 3, "binSize": 2, "binUnit": "weeks", "start": "2024-01-01T00:00:00Z"}
    rows = bin_times(spark, grid).orderBy("bin").selectExpr("cast(bin_start as string) as s", "bin_ms").collect()
    assert [r.s for r in rows] == ["2024-01-01 00:00:00", "2024-01-15 00:00:00", "2024-01-29 00:00:00"] and rows[0].bin_ms == 1_209_600_000
    assert bin_times(spark, {**grid, "start": None}).where("bin_start is null").count() == 3
    assert "UTC" in " ".join(schema_errors({"grid": {**grid, "start": "2024-01-01T00:00:00+02:00"}, "nodes": []}))
    nodes = [{"id": i} for i in "abcxy"]
    edges = [{"source": s, "target": t} for s, t in ("ab", "bc", "ac", "xy", "yx")]
    assert levels({"topology": {"nodes": nodes, "edges": edges}}) == {"a": 0, "b": 1, "c": 2, "x": 3, "y": 4}


def test_class_clamp_and_pulse(spark):
    rows = [(0, b, c, 10.0, v) for b in range(4) for c, v in (("A", 8.0), ("B", 2.0))]
    a = spark.createDataFrame(rows, "scenario_id long, bin long, class_id string, total double, value double")
    plain = lambda v: spark.createDataFrame([(0, b, None, v, None) for b in range(4)], a.schema)
    got = {(r.bin, r.class_id): round(r.value, 9) for r in classes.clamped(a, plain(2.0), plain(5.0)).collect()}
    assert got == {(b, c): v for b in range(4) for c, v in (("A", 4.0), ("B", 1.0))}
    assert {r.bin for r in classes.pulsed(a, 2, 1).where("value > 0").collect()} == {1, 3}


def test_classes_of_a_model(spark):
    rates = {"arrivals": [{"nodeId": "ingest", "classId": c, "pattern": {"kind": "constant", "ratePerBin": v}} for c, v in (("Order", 20), ("Refund", 5))]}
    m = model(2, {"ingest": 10.0, "served": "MIN(ingest, 8)", "other": 3.0}, traffic=rates)
    got = {(r.series_id, r.class_id): (r.total, round(r.value, 9)) for r in by_class(evaluate(spark, m, with_classes=True), m).where("bin = 1").collect()}
    assert got == {("ingest", "Order"): (10, 8), ("ingest", "Refund"): (10, 2), ("served", "Order"): (8, 6.4), ("served", "Refund"): (8, 1.6)}
    more = spark.createDataFrame([(0, "ingest__class_Refund", None, 20.0)], "scenario_id long, series string, bin long, value double")
    assert {r.class_id: r.value for r in by_class(evaluate(spark, m, more, with_classes=True), m).where("bin = 0 and series_id = 'ingest'").collect()} == {"Order": 5, "Refund": 5}


def vectors(spark, m, bin_=None):
    rows = by_class(evaluate(spark, m, with_classes=True), m)
    return {(r.series_id, r.class_id, r.bin): round(r.value, 9) for r in rows.collect() if bin_ is None or r.bin == bin_}


def one_class(**classes):
    return {"arrivals": [{"nodeId": n, "classId": c, "pattern": {"kind": "constant", "ratePerBin": 1.0}} for n, c in classes.items()]}


def test_classes_behind_routers(spark):
    router = lambda *routes: {"kind": "router", "router": {"inputs": {"queue": "total"}, "routes": list(routes)}}
    m = model(2, {"a": [4.0, 6], "b": [6.0, 4], "total": "a + b", "airport": "total * 0.4", "general": "total * 0.6", "r": router({"target": "airport", "classes": ["Alpha"]}, {"target": "general", "weight": 1})}, traffic=one_class(a="Alpha", b="Beta"))
    assert series(spark, m, "airport", "general") == [[4, 6], [6, 4]]
    got = vectors(spark, m)
    assert {k: v for k, v in got.items() if k[0] in ("airport", "general")} == {("airport", "Alpha", 0): 4, ("airport", "Alpha", 1): 6, ("general", "Beta", 0): 6, ("general", "Beta", 1): 4}
    m = model(2, {"a": [8.0, 4], "b": [2.0, 6], "total": "a + b", "r": router({"target": "x", "weight": 2}, {"target": "y", "weight": 1})}, traffic=one_class(a="Alpha", b="Beta"))
    got = vectors(spark, m)
    assert [got["x", c, i] for c in ("Alpha", "Beta") for i in (0, 1)] == [round(v, 9) for v in (16 / 3, 8 / 3, 4 / 3, 4)]
    assert [got["y", c, i] for c in ("Alpha", "Beta") for i in (0, 1)] == [round(v, 9) for v in (8 / 3, 4 / 3, 2 / 3, 2)]
    two = router({"target": "x", "classes": ["Alpha"]}, {"target": "y", "classes": ["Beta"]})
    m = model(1, {"a": 6.0, "b": 4.0, "total": "a + b", "r": two, "inflow": "x + y", "zero": 0.0}, [swb("Q", "inflow", "zero", initialCondition={"queueDepth": 0})], traffic=one_class(a="Alpha", b="Beta"))
    got = vectors(spark, m)
    assert (got["q_queue", "Alpha", 0], got["q_queue", "Beta", 0]) == (6, 4)


def test_classes_of_what_is_served_and_lost(spark):
    m = model(1, {"a": 6.0, "b": 4.0, "inflow": "a + b", "out": 5.0, "loss": 1.0, "line": "out", "last": "line"}, [{"id": "Q", "kind": "serviceWithBuffer", "semantics": {"arrivals": "inflow", "served": "out", "errors": "loss"}}], traffic=one_class(a="Alpha", b="Beta"))
    got = vectors(spark, m)
    assert [got[s, c, 0] for s in ("out", "loss", "line", "last") for c in ("Alpha", "Beta")] == [3, 2, 0.6, 0.4, 3, 2, 3, 2]


@pytest.mark.parametrize(("more", "depth"), [({"wipLimit": 8}, [6, 8, 8, 8]), ({}, [5, 10, 15, 20]), ({"dispatchSchedule": {"periodBins": 2, "phaseOffset": 0}}, [6, 16, 22, 32])])
def test_classes_sum_to_a_queues_depth(spark, more, depth):
    loss = {} if more else {"errors": "one"}
    m = model(4, {"a": 7.0, "b": 3.0, "inflow": "a + b", "out": 4.0, "one": 1.0}, [{"id": "Q", "kind": "serviceWithBuffer", "semantics": {"arrivals": "inflow", "served": "out", **loss}, **more}], traffic=one_class(a="A", b="B"))
    got = vectors(spark, m)
    assert [round(got["q_queue", "A", i] + got["q_queue", "B", i], 6) for i in range(4)] == depth == series(spark, m, "q_queue")
    assert all(got["q_queue", "A", i] > got["q_queue", "B", i] for i in range(4))


def test_a_classed_model_reads_its_input_once(spark):
    data = spark.range(8).selectExpr("0L as scenario_id", "id % 2 as k", "id div 2 as bin", "1.0D + id as a", "2.0D as b")
    m = model(4, {"a": 0.0, "b": 0.0, "inflow": "a + b", "top": "MIN(inflow, 4) + SHIFT(inflow, 1)", "again": "inflow + 0.5 * SHIFT(q_queue, 1)"}, [swb("Q", "again", "b", wipLimit=9)], traffic=one_class(a="A", b="B"))
    df = by_class(evaluate(spark, m, data=data, keys=("scenario_id", "k"), with_classes=True), m, ("scenario_id", "k"))
    text = df._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("Range (0, 8") == 1 and "Join" not in text
    assert {r.series_id for r in df.collect()} == {"a", "b", "inflow", "top", "again", "q_queue", "Q__overflow"}


@pytest.mark.parametrize("text", ["a * 1.5 - 2 / b", "-a + b", "a / (b - 3)", "MIN(a, MAX(b, 2))", "CLAMP(a, b, 4)", "MOD(a - b, -3) + MOD(a, b - 3)", "FLOOR(a / 3) + CEIL(b / 3) + ROUND((a - b) / 2)", "STEP(a, b) + STEP(nan, 0)", "PULSE(3, 1, a) + PULSE(2)", "SHIFT(a, 2) + SHIFT(b, 0)", "CONV(a, [0, 0.5, 0.25]) + CONV(b, 2)", "CONV(nan, [1, 1])", "a + [1, 2, 3, 4, 5, 6]", "MOD(nan, 2)", "1e-7 * a + 0.1"])
def test_expressions_as_sql_are_those_as_columns(spark, text):
    df = spark.createDataFrame([(s, b, float(s + b), float(3 * b - 4 * s), float("nan")) for s in (0, 1) for b in range(6)], "scenario_id long, bin long, a double, b double, nan double")
    got = df.select("scenario_id", "bin", to_column(text).alias("x"), spark_expr(to_sql(parse(text))).alias("y")).collect()
    assert all(r.x == r.y or r.x != r.x and r.y != r.y for r in got) and len(got) == 12


def test_a_wide_model_in_stages(spark):
    import random

    r, nodes = random.Random(3), {f"c{i}": [float((7 * i + b) % 23 + 1) for b in range(6)] for i in range(8)}
    for i in range(60):
        a, b = r.choice(list(nodes)), r.choice(list(nodes))
        nodes[f"e{i}"] = r.choice([f"{a} * 1.5 - {b}", f"MIN({a} * 2, {b})", f"{a} + SHIFT({b}, 1)", f"CONV({a}, [0.5, 0.5])"])
    m = model(6, nodes, [swb("Q", "e1", "c0"), swb("R", "e2", "c1", wipLimit=4)])
    m["nodes"].append({"id": "last", "kind": "expr", "expr": "q_queue + SHIFT(r_queue, 1)"})
    staged = evaluate_staged(spark, m, width=12)
    names = [s for s in staged.where if s != "bin"]
    assert max(staged.where.values()) >= 4 and {"q_queue", "R__overflow", "last"} <= set(names)
    want = {x.bin: x for x in evaluate(spark, m).collect()}
    for row in staged.series(names).collect():
        assert all(round(row[n], 9) == round(want[row.bin][n], 9) for n in names)
    assert staged.long().count() == 6 * len(names)
    assert all(len(spark.read.parquet(f"{staged.folder}/{i}").columns) < 50 for i in set(staged.where.values()))
    data = spark.range(12).selectExpr("id % 2 as who", "id div 2 as bin", "cast(id as double) as c0")
    per = evaluate_staged(spark, m, 12, data, ("who",))
    assert [x.last for x in per.series(["last"]).orderBy("who", "bin").collect()] == [x.last for x in evaluate(spark, m, data=data, keys=("who",)).orderBy("who", "bin").collect()]


def test_overrides_of_entities_reach_only_what_they_change(spark):
    data = spark.range(12).selectExpr("0L as scenario_id", "id % 2 as who", "id div 2 as bin", "cast(id as double) as a")
    m = model(6, {"a": 0.0, "k": 2.0, "base": "SHIFT(a, 1) + 1", "y": "base * k"})
    rows = spark.createDataFrame([(s, "k", None, float(s)) for s in (1, 2, 3)] + [(3, "k", 4, 10.0)], "scenario_id long, series string, bin long, value double")
    got = {(r.scenario_id, r.who, r.bin): r.y for r in evaluate(spark, m, rows, data, ("scenario_id", "who")).collect()}
    base = {(w, b): (2 * (b - 1) + w if b else 0) + 1 for w in (0, 1) for b in range(6)}
    assert got == {(s, w, b): base[w, b] * (10 if (s, b) == (3, 4) else s) for s in (1, 2, 3) for w in (0, 1) for b in range(6)}
    plan_ = evaluate(spark, m, rows, data, ("scenario_id", "who"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan_.index("Join") < plan_.index("lag(")  # the shift is below the join with scenarios
