"""The state of models: edges by type and port, latency along flows, warnings, and the plan that gives them."""

import pytest
from brookline.plans.compiler import evaluate
from brookline.plans.model import validate
from brookline.plans.run_state import edge_rows, edges_of, flow_order, node_rows, state_of, warnings

from .test_models import model, one_class, swb


def codes(spark, m, **more):
    df = evaluate(spark, m, with_classes=bool(m.get("traffic")), **more)
    return {(r.node_id, r.code): (list(r.bins), r.start_bin, r.end_bin) for r in warnings(node_rows(df, m, internal=True)).collect()}


def edges(spark, m):
    rows = edge_rows(evaluate(spark, m, with_classes=bool(m.get("traffic"))), m).orderBy("bin").collect()
    return {e: [{k: r[k] for k in ("flow", "attempts_volume", "failures_volume", "retry_volume", "retry_rate", "classes")} for r in rows if r.edge_id == e] for e in {r.edge_id for r in rows}}


def with_edges(m, *rows):
    m["topology"]["edges"] = list(rows)
    return m


def node(i, kind, **semantics):
    return {"id": i, "kind": kind, "semantics": semantics}


def test_edges_by_type_and_port(spark):
    m = model(3, {"a": 10.0, "s": 8.0, "tries": [4.0, 6, 8], "fails": [1.0, 3, 4], "errs": 2.0, "echo": [0.0, 5, 6], "none": 0.0}, [node("S", "service", arrivals="a", served="s", attempts="tries", failures="fails", errors="errs"), node("T", "service", arrivals="s", served="s", retryEcho="echo"), node("Z", "service", arrivals="none", served="none"), node("D", "dlq", arrivals="errs", served="none")])
    m = with_edges(
        m, {"id": "st", "source": "S:out", "target": "T", "weight": 3}, {"id": "sd", "source": "S", "target": "D", "weight": 0}, {"id": "side", "source": "S:errors", "target": "D"}, {"id": "zt", "source": "Z", "target": "T"},
        {"id": "eff", "source": "S", "target": "T", "type": "effort", "measure": "attempts", "multiplier": 2, "lag": 1}, {"id": "term", "source": "S", "target": "D", "type": "terminal", "measure": "failures", "multiplier": 0.5},
    )
    got = edges(spark, m)
    assert [r["flow"] for r in got["st"]] == [6.0] * 3 and [r["flow"] for r in got["sd"]] == [2.0] * 3  # a weight of 0 counts 1
    assert {r["flow"] for r in got["side"]} == {None} and [r["failures_volume"] for r in got["term"]] == [0.5, 1.5, 2]
    assert [r["attempts_volume"] for r in got["eff"]] == [None, 8, 12] and [r["retry_rate"] for r in got["eff"]] == [None, 0.25, 0.5]
    assert [r["retry_volume"] for r in got["eff"]] == [None, 0, 4]  # what is tried beyond the flow of 8
    assert [r["retry_volume"] for r in got["st"]] == [0, 5, 6] and [r["retry_volume"] for r in got["zt"]] == [0, 0, 0]


def test_router_edges_carry_what_their_targets_get_with_classes(spark):
    m = model(1, {"a": 6.0, "b": 4.0, "total": "a + b", "r": {"kind": "router", "router": {"inputs": {"queue": "total"}, "routes": [{"target": "x", "classes": ["A"]}, {"target": "y", "weight": 1}]}}}, [node("r", "router", arrivals="total", served="total"), node("X", "service", arrivals="x", served="x"), node("Y", "service", arrivals="y", served="y")], traffic=one_class(a="A", b="B"))
    m = with_edges(m, {"id": "rx", "source": "r", "target": "X"}, {"id": "ry", "source": "r", "target": "Y"})
    got = edges(spark, m)
    assert (got["rx"][0]["flow"], got["rx"][0]["classes"]) == (6, {"A": 6}) and (got["ry"][0]["flow"], got["ry"][0]["classes"]) == (4, {"B": 4})
    assert not {c for c in codes(spark, m) if "mismatch" in c[1] or "class" in c[1]}


def test_latency_along_flows(spark):
    m = model(1, {"a": 4.0, "s": 2.0, "t": 1.0, "u": 3.0, "z": 0.0}, [swb("A", "a", "s"), swb("B", "a", "t"), node("C", "service", arrivals="u", served="u"), node("N", "service", arrivals="z", served="z"), node("E", "sink", arrivals="u")])
    m = with_edges(m, *({"id": s + t, "source": s, "target": t} for s, t in ("AC", "BC", "CE", "CN")))
    rows = {r.node_id: r.flow_latency_ms for r in node_rows(evaluate(spark, m), m).where("topology").collect()}
    a, b = 1.0 * 3_600_000, 3.0 * 3_600_000
    assert (rows["A"], rows["B"]) == (a, b) and rows["C"] == pytest.approx((2 * a + 1 * b) / 3) and rows["E"] == rows["C"] and rows["N"] is None
    ring = with_edges(model(1, {"a": 4.0, "s": 2.0}, [swb("A", "a", "s"), swb("B", "a", "s")]), {"source": "A", "target": "B"}, {"source": "B", "target": "A"})
    assert flow_order(ring) == ["A", "B"]  # a cycle: as declared, what comes later counts for nothing
    rows = {r.node_id: r.flow_latency_ms for r in node_rows(evaluate(spark, ring), ring).where("topology").collect()}
    assert rows == {"A": a, "B": 2 * a}


def test_a_reported_depth_is_made_again_with_loss_schedule_and_limit(spark):
    base = {"i": 10.0, "o": 4.0, "l": 1.0}
    queue = lambda **more: {"id": "Q", "kind": "serviceWithBuffer", "semantics": {"arrivals": "i", "served": "o", "errors": "l", "queueDepth": "depth"}, **more}
    for more, depth in (({}, [5.0, 10, 15, 20]), ({"wipLimit": 8}, [5.0, 8, 8, 8]), ({"dispatchSchedule": {"periodBins": 2}}, [5.0, 14, 19, 28]), ({"initialCondition": {"queueDepth": 3}}, [8.0, 13, 18, 23])):
        m = model(4, base, [queue(**more)])
        assert [r.depth for r in evaluate(spark, m).orderBy("bin").collect()] == depth
        assert ("Q", "queue_depth_mismatch") not in codes(spark, m)
        given = evaluate(spark, m).drop("Q__overflow").withColumn("depth", __import__("pyspark").sql.functions.expr("depth + if(bin = 2, 1, 0)"))
        assert {(r.node_id, r.code): list(r.bins) for r in warnings(node_rows(given, m, internal=True)).collect()}["Q", "queue_depth_mismatch"] == [2]


def test_codes_of_bins_and_runs(spark):
    m = model(6, {"a": [1.0, 2, 3, 4, 5, 6], "s": [2.0, 2, 2, -1, 2, 2], "cap": 3.0, "z": 0.0, "neg": -2.0}, [
        {"id": "S", "kind": "service", "semantics": {"arrivals": "a", "served": "s", "capacity": "cap", "maxAttempts": 3}}, {"id": "Q", "kind": "queue", "semantics": {"arrivals": "a", "served": "z", "queueDepth": "self"}, "dispatchSchedule": {"periodBins": 2}},
        {"id": "N", "kind": "service", "semantics": {"arrivals": "a", "served": "a", "capacity": "z", "queueDepth": "neg"}}, {"id": "P", "kind": "dependency", "semantics": {"arrivals": "a", "errors": "z"}},
    ])
    got = codes(spark, with_edges(m, {"source": "S", "target": "P", "type": "effort"}))
    assert got["S", "served_exceeds_arrivals"][0] == [0] and got["S", "served_negative"][0] == [3]
    assert got["Q", "backlog_growth_streak"][1:] == (0, 5) and got["Q", "queue_latency_gate_closed"][0] == [0, 1, 2, 3, 4, 5] and ("Q", "dispatch_never_releases") in got
    assert got["N", "queue_negative"][0] == [0, 1, 2, 3, 4] and ("N", "capacity_all_zero") in got
    for pair in (("S", "missing_retry_budget_series"), ("S", "missing_exhausted_failures_series"), ("S", "missing_served_count_series"), ("P", "missing_dependency_served"), ("P", "dependency_retry_pressure_missing")):
        assert pair in got, pair
    assert ("S", "capacity_all_zero") not in got and ("Q", "queue_latency_unreported") not in got


def test_series_that_the_model_does_not_make(spark):
    m = model(2, {"a": 1.0}, [node("S", "service", arrivals="a", served="a")])
    df = evaluate(spark, m).withColumn("stranger", __import__("pyspark").sql.functions.lit(1.0))
    assert ("engine", "post_eval_injection") in {(r.node_id, r.code) for r in warnings(node_rows(df, m, internal=True)).collect()}
    assert {r.node_id for r in node_rows(df, m).collect()} == {"S", "a"}


def test_validation_analyses(spark):
    m = model(3, {"a": 5.0, "s": 7.0}, [node("S", "service", arrivals="a", served="s")])
    assert validate(m) == [] and "S: served_exceeds_arrivals" in validate(m, "analyse", spark)
    assert validate(model(2, {"a": {"kind": "expr", "expr": "SHIFT(a, 1) + 1", "initial": 5}}))[0].startswith("a: a series takes no initial value")


def test_state_reads_and_deals_its_input_once(spark):
    data = spark.range(40).selectExpr("0L as scenario_id", "id % 10 as k", "id div 10 as bin", "1.0D + id as a", "2.0D as s")
    m = with_edges(model(4, {"a": 0.0, "s": 0.0}, [swb("A", "a", "s"), swb("B", "s", "s")]), {"source": "A", "target": "B", "lag": 1})
    keys = ("scenario_id", "k")
    st = state_of(evaluate(spark, m, data=data, keys=keys), m, keys)
    for df, exchanges in ((st.nodes, 1), (st.edges, 0), (st.warnings, 1)):
        text = df._jdf.queryExecution().executedPlan().toString()
        assert text.count("Range (0, 40") == 1 and "Join" not in text and text.count("Exchange hashpartitioning") == exchanges
    assert st.nodes.where("topology").count() == 80 and st.edges.count() == 40
    assert edges_of(m)[0].edge_id == "A->B"


def test_fixtures(spark, tmp_path):
    import json

    from brookline.plans.model import ModelError
    from brookline.sources.fixtures import load_fixture, model_of

    node_ = {"id": "S", "kind": "queue", "semantics": {"arrivals": "file:a.csv", "served": "file:b.csv", "queueDepth": "file:a.csv", "errors": " ", "slaMinutes": 5}}
    document = {"window": {"bins": 3, "binSize": 5}, "topology": {"nodes": [node_], "edges": [{"source": "S:out", "target": "S", "weight": 0}]}}
    (tmp_path / "model.json").write_text(json.dumps(document))
    (tmp_path / "a.csv").write_text("bin_index,value\n0,4\n2,6\n")
    (tmp_path / "b.csv").write_text("bin_index,value\n0,2\n1,2\n2,3\n")
    m, frame = load_fixture(spark, str(tmp_path))
    assert m["grid"] == {"bins": 3, "binSize": 5, "binUnit": "minutes"} and m["topology"]["edges"][0]["weight"] == 1.0 and len(m["nodes"]) == 2
    got = {r.bin: (r.arrivals, r.served, r.queue_depth, r.latency_min) for r in node_rows(frame, m).where("topology").collect()}
    assert got == {0: (4, 2, 4, 10), 1: (0, 2, 0, 0), 2: (6, 3, 6, 10)}
    for broken in ({"topology": {}}, {"window": {"bins": 1, "binSize": 1}}, {**document, "topology": {"nodes": [{"id": "x"}]}}, {**document, "topology": {"nodes": [{**node_, "semantics": {"arrivals": "file:a.csv"}}]}}, {**document, "topology": {"nodes": [], "edges": [{"source": "a"}]}, "window": {"bins": 1, "binSize": 1}}):
        with pytest.raises(ModelError):
            model_of(broken)
