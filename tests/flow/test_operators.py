"""Operators against plain loops on random series, metrics and checks on small cases, files, registry, streams."""

import random

import pytest
from brookline.functions import metrics as M
from brookline.functions.rng import Pcg32, Pmf
from brookline.operators import checks, routing, series, state, summary
from brookline.plans.compiler import evaluate
from brookline.plans.graph import graph, implied
from brookline.sources import registry, series_files
from brookline.streaming.queues import binned_stream, dropped_rows, queue_stream
from pyspark.sql import functions as F


def random_frame(spark, seed, scenarios=4, bins=60):
    r = random.Random(seed)
    rows = [(s, b, float(r.randint(0, 40)), float(r.randint(0, 40)), float(r.randint(0, 30))) for s in range(scenarios) for b in range(bins)]
    return rows, spark.createDataFrame(rows, "scenario_id long, bin long, i double, o double, cap double")


@pytest.mark.parametrize("seed", [1, 2])
def test_recurrences_match_loops(spark, seed):
    rows, df = random_frame(spark, seed)
    df = series.queue_depth(df, F.col("i"), F.col("o"), 7.0, "q")
    df = series.queue_with_limit(df, "i", "o", F.col("cap"), 3.0, "w", "over")
    df = series.queue_depth(df, F.col("i"), series.gate("o", 4, 9), name="g")
    df = series.back_pressure(df, "i", "o", 25.0)
    got = {(r.scenario_id, r.bin): r for r in df.withColumns({"s": series.shift("i", 3), "c": series.convolve("i", [0.5, 0, 0.25])}).collect()}
    for s in range(4):
        q, w, g, bp, i_ = 7.0, 3.0, 0.0, None, []
        for _, b, i, o, cap in [r for r in rows if r[0] == s]:
            r = got[s, b]
            i_.append(i)
            q = max(0.0, q + i - o)
            d = max(0.0, w + i - o)
            w = min(d, cap)
            g = max(0.0, g + i - (o if b >= 1 and (b - 1) % 4 == 0 else 0.0))
            eff = i * (1 - (min(1.0, bp / 25) if bp is not None else 0.0))
            bp = max(0.0, (bp or 0.0) + eff - o)
            assert (r.q, r.w, r.over, r.g) == (q, w, max(0.0, d - cap), g)
            assert r.queue == pytest.approx(bp) and r.effective == pytest.approx(eff)
            assert r.s == (i_[-4] if b >= 3 else 0.0) and r.c == pytest.approx(0.5 * i + (0.25 * i_[-3] if b >= 2 else 0.0))


def test_routing_and_allocation_conserve(spark):
    r = random.Random(3)
    demand = spark.createDataFrame([(0, "c", str(n), b, float(r.randint(-2, 30)), float(r.randint(-1, 60))) for b in range(1) for n in range(9)], "scenario_id long, constraint_id string, node_id string, bin long, demand double, capacity double").withColumn("capacity", F.lit(50.0))
    rows = routing.allocate(demand).collect()
    assert sum(x.allocated for x in rows) <= 50 + 1e-9 and all(x.allocated >= 0 for x in rows)
    source = spark.createDataFrame([(0, b, "r", 100.0 + b) for b in range(5)], "scenario_id long, bin long, router string, value double")
    routes = spark.createDataFrame([("r", "a", 1.0, None), ("r", "b", None, None), ("r", "c", 0.0, None), ("r", "a", 2.0, None)], "router string, target string, weight double, class_id string")
    flows = routing.route(source, routes)
    assert routing.router_leakage(source, flows, routes.select("router", "target").distinct()).first().leakage == pytest.approx(0)
    cf = spark.createDataFrame([(0, 0, "r", "x", 5.0), (0, 0, "r", "y", 5.0)], "scenario_id long, bin long, router string, class_id string, value double")
    only = spark.createDataFrame([("r", "a", None, "x")], "router string, target string, weight double, class_id string")
    assert [r.class_id for r in routing.unrouted_classes(cf, only).collect()] == ["y"]


def test_metrics(spark):
    df = spark.createDataFrame([(9.0, 12.0, 10.0, 2250.0, 9.0), (0.0, 0.0, 5.0, None, 0.0)], "served double, cap double, queue double, ms double, n double")
    q, s = M.queue_time_ms("queue", "served", 300_000.0), M.service_time_ms("ms", "n")
    c = M.cycle_time_ms(q, s)
    a, b = df.select(M.utilization("served", "cap").alias("u"), q.alias("q"), s.alias("s"), c.alias("c"), M.flow_efficiency(s, c).alias("e"), M.kingman_wait(F.lit(0.5), 1.0, 1.0, 2.0).alias("k"), M.kingman_wait(F.lit(1.0), 1.0, 1.0, 2.0).alias("k1")).collect()
    assert (a.u, a.s, a.k, a.k1) == (0.75, 250.0, 2.0, None) and a.c == pytest.approx(a.q + 250) and a.e == pytest.approx(250 / a.c)
    assert (b.u, b.q, b.s, b.c, b.e) == (None,) * 5
    assert M.retry_kernel([0.5, -1, 1.5])[0] == [0.25, 0.0, 0.75] and M.retry_kernel(None)[1] == ["default"]
    sla = spark.createDataFrame([(9.0, 9.0), (6.0, 7.0), (9.0, 9.0), (4.0, 5.0)], "s double, a double").select(M.sla_met("s", "a").alias("m")).collect()
    assert [r.m for r in sla] == [1, 0, 1, 0]


def test_checks_skip_what_is_no_number(spark):
    nan = float("nan")
    rows = [(0, "n", 0, 5.0, nan, 1.0), (0, "n", 1, nan, 4.0, 1.0), (0, "n", 2, 5.0, 3.0, 1.0)]
    df = spark.createDataFrame(rows, "scenario_id long, node_id string, bin long, attempts double, served double, errors double")
    assert {r.code: list(r.bins) for r in checks.check(df).collect()} == {"attempts_conservation_mismatch": [2]}


def test_built_in_profiles(spark):
    for name, hourly in summary.PROFILES.items():
        got = [r.weight for r in summary.built_in_profile(spark, name, 288).orderBy("bin").collect()]
        mean = sum(hourly) / 24
        assert got == pytest.approx([x / mean for x in hourly for _ in range(12)])
    with pytest.raises(ValueError):
        summary.built_in_profile(spark, "none", 24)


def test_detect_period(spark):
    rows = [(s, b, float(b % 4 if s == 0 else b % 28 if s == 1 else 0)) for s in range(3) for b in range(84)]
    df = spark.createDataFrame(rows, "k long, bin long, x double")
    got = {r.k: (r.label, r.period, r.score, r.periodic) for r in summary.detect_period(df, "x", 4, ["k"]).collect()}
    assert got == {0: ("daily", 4, 1.0, True), 1: ("weekly", 28, 1.0, True), 2: (None, None, None, False)}


def test_presence(spark):
    rows = [(0, n, b, 5.0, 0.0 if n == "gate" else None, 0.0) for n in ("gate", "dep", "svc") for b in range(3)]
    df = spark.createDataFrame(rows, "scenario_id long, node_id string, bin long, arrivals double, served double, capacity double")
    expected = spark.createDataFrame([("gate", "queue", ["queue_depth"], False, True, True), ("dep", "dependency", [], False, False, False), ("svc", "service", None, True, False, False)], "node_id string, kind string, declared array<string>, retries boolean, scheduled boolean, schedule_capacity boolean")
    got: dict = {}
    for r in checks.presence(df, expected).collect():
        got.setdefault(r.node_id, set()).add(r.code)
    assert got["gate"] == {"capacity_all_zero", "missing_queue_depth_series", "dispatch_capacity_missing", "dispatch_never_releases"}
    assert got["dep"] == {"capacity_all_zero", "missing_dependency_served"}
    assert got["svc"] == {"missing_served_series", "missing_processing_time_series", "missing_served_count_series", "missing_exhausted_failures_series", "missing_retry_budget_series"}


def test_checks(spark):
    rows = [(0, "n", b, 5.0, 6.0 if b % 2 else 4.0, -1.0) for b in range(14)]
    df = spark.createDataFrame(rows, "scenario_id long, node_id string, bin long, arrivals double, served double, errors double").withColumn("kind", F.lit("service"))
    got = {r.code: (list(r.bins), r.worst, r.n) for r in checks.check(df).collect()}
    assert got["served_exceeds_arrivals"] == ([1, 3, 5, 7, 9], 1.0, 7) and got["errors_negative"][2] == 14
    assert "served_exceeds_arrivals" not in {r.code for r in checks.check(df, {"served_exceeds_arrivals": ["service"]}).collect()}
    assert checks.missing_series(["served"], "serviceWithBuffer", {}) == ["missing_queue_depth_series"]
    nodes = spark.createDataFrame([("d", "dlq"), ("x", "dependency"), ("s", "service")], "node_id string, kind string")
    edges = spark.createDataFrame([("s", "d", "throughput", 1), ("s", "x", "throughput", 0)], "source string, target string, type string, lag int")
    assert {(r.node_id, r.code) for r in checks.edge_rules(edges, nodes).collect()} == {("d", "dlq_non_terminal_inbound"), ("s", "edge_behavior_violation_lag"), ("x", "dependency_missing_effort_edges")}
    blind = spark.createDataFrame([("x", "dependency", True, False), ("y", "dependency", True, False), ("s", "service", False, False), ("t", "service", False, True)], "node_id string, kind string, errors boolean, attempts boolean")
    effort = spark.createDataFrame([("s", "x", "effort", 0), ("t", "y", "effort", 0)], "source string, target string, type string, lag int")
    assert {(r.node_id, r.code) for r in checks.edge_rules(effort, blind).collect()} == {("x", "dependency_retry_pressure_missing")}
    assert checks.missing_series(["arrivals"], "dependency", {"retries": True}) == ["missing_dependency_served", "missing_exhausted_failures_series", "missing_retry_budget_series"]
    assert checks.never_releases(df.withColumn("served", F.lit(0.0))).count() == 1


def test_streaks_and_periods(spark):
    df = spark.createDataFrame([(0, b, float(v)) for b, v in enumerate([0, 1, 2, 3, 0, 1, 2, 3, 4, 4, 0])], "scenario_id long, bin long, x double")
    g = series.growth_streak(df, "x").collect()
    assert [(r.start_bin, r.end_bin, r.length) for r in g] == [(4, 8, 4)]
    first = series.longest_streak(df, F.col("x") > 0).collect()[0]
    assert (first.start_bin, first.length) == (5, 5)
    wave = spark.createDataFrame([(0, b, float(b % 4)) for b in range(16)], "scenario_id long, bin long, x double")
    assert summary.periodicity(wave, "x", 4, ["scenario_id"]).first().score == 1.0 and summary.periodicity(wave, "x", 9, ["scenario_id"]).first().score is None
    with pytest.raises(ValueError):
        series.between(df, 5, 2)


def test_numbers():
    r = Pcg32(42)
    again = Pcg32(42)
    xs = [r.double() for _ in range(2000)]
    assert xs == [again.double() for _ in range(2000)] and 0.47 < sum(xs) / 2000 < 0.53
    assert {Pcg32(7).below(6) for _ in range(3)} <= set(range(6))
    p = Pmf([1, 2, 3], [2, 5, 3])
    assert p.mean == pytest.approx(2.1) and p.variance == pytest.approx(0.49) and Pmf.from_summary(3, 3).mean == 3
    assert Pmf.from_summary(0, 10, 0).mean == 2.5 and Pmf.from_summary(0, 10, None, 4).mean == 4.5 and Pmf.from_summary(0, 10).mean == 5
    p.fits(9)
    for bins, policy in ((8, "repeat"), (9, "error")):
        with pytest.raises(ValueError):
            p.fits(bins, policy)
    for bad in (([1, 1], [1, 1]), ([1], [-1]), ([], []), ([1, 2], [1])):
        with pytest.raises(ValueError):
            Pmf(*bad)


def test_series_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("bin_index,value\n0,1.5\n2,\n")
    got = [r.value for r in series_files.read_series(spark, f"{tmp_path}/a.csv", 4).orderBy("bin").collect()]
    assert got[0] == 1.5 and got[1] == 0 and got[2] != got[2] and got[3] == 0
    (tmp_path / "b.csv").write_text("bin_index,classId,value\n0,x,1\n0,x,2\n")
    (tmp_path / "c.csv").write_text("bin_index,value\n9,1\n")
    for f in "bc":
        with pytest.raises(series_files.SeriesError):
            series_files.read_series(spark, f"{tmp_path}/{f}.csv", 4)
    (tmp_path / "e.csv").write_text("bin_index,value\n0,3\n")
    roles = series_files.read_roles(spark, {"served": f"{tmp_path}/a.csv", "errors": f"{tmp_path}/e.csv"}, 4)
    assert [r.failures for r in roles.orderBy("bin").collect()] == [3, 0, 0, 0]
    more = series_files.read_roles(spark, {"served": f"{tmp_path}/a.csv", "limit": None}, 4, parallelism=-1).orderBy("bin").collect()
    assert all(r.limit != r.limit and r.parallelism is None for r in more) and more[0].served == 1.5
    (tmp_path / "t.csv").write_text("t,value\n20,2\n10,1\n")
    assert [r.value for r in series_files.read_ordered(spark, f"{tmp_path}/t.csv", 2).orderBy("bin").collect()] == [1, 2]
    (tmp_path / "i.tsv").write_text("bin\tvalue\n1\t1,200\n0\t3\n")
    assert [r.value for r in series_files.ingest(spark, f"{tmp_path}/i.tsv").orderBy("bin").collect()] == [3, 1200]
    assert series_files.resolve("file:x.csv", "/m") == "/m/x.csv"
    with pytest.raises(series_files.SeriesError):
        series_files.resolve("http://x", "/m")


def test_runs_and_exports(spark, tmp_path):
    df = spark.createDataFrame([(0, b, float(b), 2.0) for b in range(3)], "scenario_id long, bin long, `served@web@DEFAULT` double, `queue@web@gold` double")
    names = df.columns[2:]
    series_files.write_run(df, names, f"{tmp_path}/runs", "r1", {"grid": 1}, ["nightly"])
    back = series_files.read_run(spark, f"{tmp_path}/runs", "r1")
    assert back.count() == 6 and {r.class_id for r in back.collect()} == {"DEFAULT", "gold"}
    m = series_files.read_manifest(spark, f"{tmp_path}/runs", "r1")
    assert m["tags"] == ["nightly"] and [s["kind"] for s in m["series"]] == ["flow", "stock"]
    for form in ("csv", "ndjson", "parquet"):
        series_files.export(back, f"{tmp_path}/x-{form}", form, "2024-01-01 00:00:00", 60)
    assert spark.read.parquet(f"{tmp_path}/x-parquet").columns == ["time_bin", "component_id", "measure", "value"]
    assert spark.read.json(f"{tmp_path}/x-ndjson").count() == spark.read.option("header", True).csv(f"{tmp_path}/x-csv").count() == 6
    gaps = spark.createDataFrame([(0, 1.0), (1, None), (2, float("nan"))], "bin long, v double")
    assert {r.gap: r.n for r in series_files.capture(gaps, "v", f"{tmp_path}/cap").collect()} == {"data_gap": 1, "nan_fill": 1}


def test_registry(spark):
    rows = [(str(i), "run", f"Title {i}", f"2024-01-01 0{i}:00:00", 10.0 * i, ["a"] if i % 2 else ["b"], i == 4, "T") for i in range(6)]
    t = spark.createDataFrame(rows, "id string, kind string, title string, created string, size double, tags array<string>, archived boolean, template_id string").withColumn("created", F.col("created").cast("timestamp"))
    assert [r.id for r in registry.page(registry.search(t, tags=["b"]), limit=5).collect()] == ["2", "0"]
    assert [r.id for r in registry.page(registry.search(t, text="title 3", template="t")).collect()] == ["3"]
    near = {(r.id, r.other) for r in registry.related(t, 1.5, 1).collect()}
    assert ("0", "1") in near and ("5", "4") in near


def test_streams(spark, tmp_path):
    rows = [(1, "2024-01-01 00:10:00", "view"), (1, "2024-01-01 00:20:00", "view"), (1, "2024-01-01 00:30:00", "click"), (2, "2024-01-01 01:10:00", "view"), (1, "2024-01-02 00:00:00", "view")]
    events = spark.createDataFrame(rows, "user_id long, ts string, event_type string").withColumn("ts", F.col("ts").cast("timestamp"))
    events.coalesce(1).write.parquet(f"{tmp_path}/events")
    stream = spark.readStream.schema(events.schema).parquet(f"{tmp_path}/events")
    q = binned_stream(stream).writeStream.format("memory").queryName("closed_bins").outputMode("append").start()
    q.processAllAvailable()
    q.processAllAvailable()
    q.stop()
    got = {(r.user_id, r.arrivals, r.served) for r in spark.table("closed_bins").collect()}
    assert got == {(1, 2.0, 1.0), (2, 1.0, 0.0)}
    bins = spark.createDataFrame([(1, b, 5.0, 3.0) for b in range(4)] + [(2, 0, 1.0, 9.0), (2, 0, 7.0, 0.0), (2, 1, 3.0, 1.0)], "user_id long, bin long, arrivals double, served double")
    bins.coalesce(1).write.parquet(f"{tmp_path}/bins")
    q = queue_stream(spark.readStream.schema(bins.schema).parquet(f"{tmp_path}/bins")).writeStream.format("memory").queryName("depths").outputMode("append").option("checkpointLocation", f"{tmp_path}/cp").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("depths").collect()))[:4] == [(1, 0, 2.0, 0), (1, 1, 4.0, 0), (1, 2, 6.0, 0), (1, 3, 8.0, 0)]
    assert [r.late for r in spark.table("depths").where("user_id = 2").orderBy("bin").collect()] == [0, 1]  # the second row of bin 0 is left out
    assert dropped_rows(q) == 0


def test_state_and_edges(spark):
    rows = [("n", "service", b, float(b), 2.0, 4.0, 8.0, 100.0, 2.0) for b in range(6)] + [("e", "expr", b, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0) for b in range(6)]
    df = spark.createDataFrame(rows, "node_id string, kind string, bin long, arrivals double, served double, queue_depth double, capacity double, processing_time_ms_sum double, served_count double")
    w = state.window(state.with_metrics(df, 1000.0), 2, 4, ["arrivals", "cycle_time_ms"], mode="operational").collect()
    assert [(r.node_id, r.arrivals, r.cycle_time_ms) for r in w] == [("n", [2, 3, 4], [2050] * 3)]
    assert state.snapshot(df, 3).count() == 2 and state.aggregation("served") == "sum" and state.aggregation("utilization") == "avg" and state.aggregation("x") == "unknown"
    edges = spark.createDataFrame([("A->B", "flow", "x"), ("B->C", "flow", "y")], "edge_id string, metric string, class_id string")
    assert state.keep_edges(edges, ["a->b"], ["FLOW"]).count() == 1 and state.keep_edges(edges).count() == 2
    with pytest.raises(ValueError):
        state.window(df, 4, 2, ["arrivals"])


def test_graph_and_implied_series(spark):
    m = {"grid": {"bins": 2, "binSize": 1, "binUnit": "hours"}, "nodes": [{"id": "i", "kind": "const", "values": [3.0, 4.0]}, {"id": "e", "kind": "expr", "expr": "i + SHIFT(e, 1)"}], "topology": {"nodes": [{"id": "Q", "kind": "queue", "semantics": {"arrivals": "i", "errors": "i", "retryEcho": "echo"}}, {"id": "S", "kind": "sink", "semantics": {"arrivals": "i", "served": "taken"}}], "edges": [{"source": "Q:served", "target": "S:arrivals"}]}}
    nodes, edges = graph(spark, m)
    assert {r.edge_id: r.type for r in edges.collect()} == {"Q:served->S:arrivals": "throughput", "i->e": "reference", "e->e": "lagged", "i->Q": "errors", "i->S": "arrivals"}
    assert graph(spark, m, "operational")[1].count() == 1 and graph(spark, m, kinds=["sink"])[0].count() == 1
    assert implied(m) == {"q_queue": "queue", "echo": "retry_echo", "taken": "sink_served"}
    rows = evaluate(spark, m).orderBy("bin").collect()
    assert [r.taken for r in rows] == [3, 4] and [r.e for r in rows] == [3, 7] and [round(r.echo, 6) for r in rows] == [0, 1.8]


def test_storage_index_and_bundle(spark, tmp_path):
    at = lambda h: f"timestamp '2024-01-01 0{h}:00:00'"
    for h, v in ((1, "old"), (2, "new")):
        registry.put(spark.sql(f"select 'run' as kind, 'a' as id, '{v}' as hash, 1L as size_bytes, {at(h)} as updated_utc, 't' as content_type, map('k', 'v') as metadata"), f"{tmp_path}/idx")
    assert [(r.id, r.hash) for r in registry.index(spark, f"{tmp_path}/idx", "run").collect()] == [("a", "new")] and registry.index(spark, f"{tmp_path}/idx", "model").count() == 0
    df = spark.createDataFrame([(0, 0, 1.0, None), (0, 1, float("nan"), 2.0)], "scenario_id long, bin long, x double, y double")
    got = series_files.bundle(df, ["x", "y"], f"{tmp_path}/runs", {"m": 1})
    assert got["gaps"] == {"x": 1, "y": 1} and series_files.read_run(spark, f"{tmp_path}/runs", got["run_id"]).count() == 4
    m = {"grid": {"bins": 2, "binSize": 1, "binUnit": "hours"}, "nodes": [{"id": i, "kind": "const", "values": [0.0, 0.0]} for i in "xy"], "topology": {"nodes": [{"id": "S", "kind": "service", "semantics": {"arrivals": "x", "served": "y"}}]}}
    assert series_files.bundle(df, ["x", "y"], f"{tmp_path}/runs", m)["conservation"]["S: served_exceeds_arrivals"] == 1


def test_more_checks(spark):
    c = spark.createDataFrame([("a", None, "s"), ("b", "x", None), ("c", "x", "s")], "constraint_id string, arrivals string, served string")
    assert {(r.constraint_id, r.code) for r in checks.constraint_errors(c).collect()} == {("a", "constraint_missing_arrivals"), ("b", "constraint_missing_served")}


def scans(df):
    """How often the optimised plan reads files."""
    return df._jdf.queryExecution().optimizedPlan().toString().count("Relation [")


def test_plans_read_their_input_once(spark, sf_dir, tmp_path):
    """However many limits, levels or conditions: the plan does not grow with them."""
    from brookline import queries as q

    df = q.users(spark, sf_dir)
    one = scans(df)
    for i in range(5):
        df = series.queue_with_limit(df, "arrivals" if not i else f"o{i - 1}", "served", 2.0, name=f"q{i}", overflow=f"o{i}", keys=q.KIND)
    assert scans(df) == one
    assert scans(q.QUERIES["overflow_cascade"](spark, sf_dir)) == 1
    assert scans(q.QUERIES["constraint_at_query"](spark, sf_dir)) <= 3 and scans(q.QUERIES["warn_edge_rules"](spark, sf_dir)) <= 7
    assert scans(q.QUERIES["warn_window"](spark, sf_dir)) <= 2
    nodes = spark.createDataFrame([(0, f"n{i}", b, i, 1.0, 1.0) for i in range(6) for b in range(3)], "scenario_id long, node_id string, bin long, level int, cycle_ms double, carried double")
    flows = spark.createDataFrame([(0, f"n{i}", f"n{i + 1}", b, 1.0) for i in range(5) for b in range(3)], "scenario_id long, source string, target string, bin long, flow double")
    nodes.write.parquet(f"{tmp_path}/n")
    flows.write.parquet(f"{tmp_path}/f")
    done = routing.flow_latency(spark.read.parquet(f"{tmp_path}/n"), spark.read.parquet(f"{tmp_path}/f"), 6)
    assert done._jdf.queryExecution().optimizedPlan().toString().count("Relation") == 1 and "Join" not in done._jdf.queryExecution().optimizedPlan().toString()  # every level is written
    assert {(r.node_id, r.latency) for r in done.collect()} == {(f"n{i}", i + 1.0) for i in range(6)}


def test_related_runs_of_one_time_and_one_tag(spark):
    from brookline.sources import registry

    rows = [(i, ["hot"] if i % 2 else ["hot", f"t{i % 7}"], f"2024-01-01 00:{i % 6:02d}:00") for i in range(120)] + [(500, ["x"], "2024-03-01 00:00:00"), (501, ["y"], "2024-03-01 00:59:59"), (502, ["x"], "2024-05-01 00:00:00")]
    runs = spark.createDataFrame(rows, "id long, tags array<string>, created string")
    at = {i: (set(t), int(c[14:16]) * 60 + int(c[17:19]) + {"1": 0, "3": 10**7, "5": 2 * 10**7}[c[6]]) for i, t, c in rows}
    want = []
    for i, (t, x) in at.items():
        near = sorted((abs(x - y), j) for j, (u, y) in at.items() if j != i and (t & u or abs(x - y) < 3600))
        want += [(i, n + 1, j, g if g < 10**6 else None) for n, (g, j) in enumerate(near[:5])]
    got = [(r.id, r.rank, r.other, r.gap if r.gap < 10**6 else None) for r in registry.related(runs).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_related_runs_are_made_pairs_only_where_their_rows_have_met(spark):
    r = random.Random(5)
    rows = [(i, ["a", "b", "a"] if i % 3 else ["b"], 1_000_000 + 1800 * r.randrange(60), i % 4 or None) for i in range(90)] + [(900, ["z"], None, 1), (901, None, 1_000_000, 2)]
    runs = spark.createDataFrame(rows, "id long, tags array<string>, at long, model_id long").select("id", "tags", F.timestamp_seconds("at").alias("created"), "model_id")
    related = registry.related(runs, hours=1.0, model_hours=2.0)
    want = []
    for i, t, x, m in rows:
        known = [(abs(x - y), j, u, n) for j, u, y, n in rows if j != i and x is not None and y is not None]
        near = sorted((g, j) for g, j, u, n in known if set(t or ()) & set(u or ()) or g < 3600 or (m is not None and m == n and g < 7200))
        want += [(i, rank, j, g) for rank, (g, j) in enumerate(near[:5], 1)]
    assert sorted(map(tuple, related.collect())) == sorted(want)
    # By id travels a row for each reason: pairs are neither counted out before that exchange nor sent through it.
    plan = related._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("explode(near") < plan.index("RepartitionByExpression [id") < plan.index("Union") and "Aggregate [id" not in plan


GOOD = "bin_index,value\n0,10\n2,30\n\n1,\n"


@pytest.mark.parametrize(
    ("text", "says"),
    [("", "header"), ("bad_header\n0,10\n", "header"), ("0,10\n1,20\n", "header"), ("bin_index,value\nabc,5\n", "bin"), ("bin_index,value\n2\n", "row"), ("bin_index,value\n1,2,3\n", "row"), ("bin_index,value\n3,oops\n", "value"), ("bin_index,value\n1,5d\n", "value"), ("bin_index,value\n4,1\n", "range"), ("bin_index,value\n-1,1\n", "range"), ("bin_index,value\n0,1\n0,1\n", "twice"), ("bin_index,classId,value\n0,1\n", "row"), ("bin_index,value\n1.5,1\n", "bin")],
)
def test_malformed_series_files_raise(spark, tmp_path, text, says):
    (tmp_path / "x y+z.csv").write_text(text)
    with pytest.raises(series_files.SeriesError, match=says):
        series_files.read_series(spark, f"{tmp_path}/x y+z.csv", 4)


def test_series_files_as_they_may_be(spark, tmp_path):
    values = lambda text: (
        (tmp_path / "f.csv").write_text(text), [r.value for r in series_files.read_series(spark, f"{tmp_path}/f.csv", 4).orderBy("bin").collect()])[1]
    got = values(GOOD)
    assert got[0] == 10 and got[1] != got[1] and got[2:] == [30, 0]
    got = values("﻿Bin_Index,Value\r\n 0 , 1e2 \r\n3,NaN\r\n1,-.5\r\n")
    assert got[:3] == [100, -0.5, 0] and got[3] != got[3]
    assert values("bin_index,classId,value\n1,vip,7\n") == [0, 7, 0, 0]
    with pytest.raises(Exception, match="(?i)path|exist"):
        series_files.read_series(spark, f"{tmp_path}/missing.csv", 4)


def test_run_directories_round_trip(spark, tmp_path):
    df = spark.range(5).selectExpr("0L as scenario_id", "id as bin", "id * 1.5D as `a@x`", "2.0D as b", "0.0D as __temp_1")
    m = {"grid": {"bins": 5, "binSize": 1, "binUnit": "hours"}, "nodes": []}
    series_files.write_run_dir(df, ["a@x", "b", "__temp_1"], f"{tmp_path}/run", m, [{"code": "w"}])
    assert (tmp_path / "run/series/a@x.csv").read_text().startswith("bin_index,value\n0,0.0\n1,1.5\n")
    import json

    assert json.loads((tmp_path / "run/run.json").read_text())["warnings"] == [{"code": "w"}] and set(json.loads((tmp_path / "run/manifest.json").read_text())["seriesHashes"]) == {"a@x", "b"}
    grid, rows = series_files.read_run_dir(spark, f"{tmp_path}/run")
    assert grid == m["grid"] and {(r.series_id, r.bin): r.value for r in rows.collect()} == {**{("a@x", i): 1.5 * i for i in range(5)}, **{("b", i): 2.0 for i in range(5)}}
    (tmp_path / "run/series/b.csv").write_text("bin_index,value\n0,1\nnope,2\n")
    (tmp_path / "run/series/.b.csv.crc").unlink(missing_ok=True)
    with pytest.raises(series_files.SeriesError, match="b.csv, line 3"):
        series_files.read_run_dir(spark, f"{tmp_path}/run")
    assert {r.bin: r.value for r in series_files.read_run_dir(spark, f"{tmp_path}/run", strict=False)[1].where("series_id = 'b'").collect()} == {0: 1, 1: 0, 2: 0, 3: 0, 4: 0}


def test_digests_do_not_depend_on_partitioning(spark, tmp_path):
    rows = spark.range(3 * 3000 * 2).selectExpr("(id % 3) * 1500 as scenario_id", "if(id % 2 = 0, 'x', 'y') as series_id", "'DEFAULT' as class_id", "id div 6 as bin", "cast(id as double) as value")
    a = {tuple(r) for r in series_files.digests(rows.repartition(1)).collect()}
    assert a == {tuple(r) for r in series_files.digests(rows.repartition(7, "value")).collect()} and len(a) == 2 and {r[2] for r in a} == {9000}
    changed = rows.withColumn("value", F.expr("if(scenario_id = 3000 and bin = 2999, value + 1, value)"))
    assert not a & {tuple(r) for r in series_files.digests(changed).collect()}


def test_a_models_run_has_classes_and_edges_and_is_there_whole(spark, tmp_path):
    from brookline.plans.compiler import evaluate

    m = {
        "grid": {"bins": 3, "binSize": 1, "binUnit": "hours"}, "classes": [{"id": "A"}, {"id": "B"}], "nodes": [{"id": i, "kind": "const", "values": [v] * 3} for i, v in (("a", 6.0), ("b", 4.0), ("z", 0.0))] + [{"id": "all", "kind": "expr", "expr": "a + b"}],
        "topology": {"nodes": [{"id": "S", "kind": "service", "semantics": {"arrivals": "all", "served": "all"}}, {"id": "T", "kind": "service", "semantics": {"arrivals": "all", "served": "all"}}], "edges": [{"id": "s->t", "source": "S", "target": "T"}]},
        "traffic": {"arrivals": [{"nodeId": n, "classId": c, "pattern": {"kind": "constant", "ratePerBin": 1.0}} for n, c in (("a", "A"), ("b", "B"))]},
    }
    df = evaluate(spark, m, with_classes=True)
    about = series_files.write_model_run(df, m, f"{tmp_path}/r", "one")
    got = {(r.series_id, r.class_id): r.value for r in series_files.read_run(spark, f"{tmp_path}/r", "one").where("bin = 1").collect()}
    assert got["all", "DEFAULT"] == 10 and got["all", "A"] == 6 and got["edge_s_t_flowVolume", "B"] == 4 and got["edge_s_t_flowVolume", "DEFAULT"] == 10
    assert about["class_coverage"] == "partial" and about["grid"]["bins"] == 3 and len(about["run_hash"]) == 64
    assert series_files.write_model_run(df.repartition(5), m, f"{tmp_path}/r", "two")["run_hash"] == about["run_hash"]
    assert series_files.verify_run(spark, f"{tmp_path}/r", "one") == []
    # Another attempt that ends before its manifest changes nothing.
    (tmp_path / "r/runs/one/lost").mkdir()
    assert series_files.read_run(spark, f"{tmp_path}/r", "one").count() == len(got) * 3


def test_a_tag_with_half_of_all_runs_lies_in_several_tasks(spark, monkeypatch):
    monkeypatch.setattr(registry, "CHUNK", 16)
    r = random.Random(4)
    runs = [(i, ["hot"] if i % 2 else [f"t{i % 9}"], 1_000_000 + r.randrange(40_000) * 60) for i in range(600)]
    df = spark.createDataFrame(runs, "id long, tags array<string>, at long").select("id", "tags", F.timestamp_seconds("at").alias("created"))
    got = {}
    for row in registry.related(df, hours=0.0001).collect():
        got.setdefault(row.id, []).append((row.gap, row.other))
    for i, tags, at in runs:
        want = sorted((abs(at - a), j) for j, t, a in runs if j != i and (t == tags or abs(at - a) < 0.36))[:5]
        assert sorted(got[i]) == want
    times = spark.createDataFrame([("hot", t) for t in range(500)] + [("a", 3), ("z", 1)], "tag string, at long")
    parts = registry.in_chunks(times, ("tag", "at"), 5, 16)
    own = parts.where("own").collect()
    assert sorted(x.place for x in own) == list(range(502)) and len({x.chunk for x in own if x.tag == "hot"}) > 30
    assert max(x["count"] for x in parts.groupBy("chunk").count().collect()) <= 26


def test_nodes_that_say_their_limits_are_held_as_by_members(spark):
    r = random.Random(8)
    rows = [(0, n, b, float(r.randint(0, 9))) for n in range(6) for b in range(5)]
    nodes = spark.createDataFrame(rows, "scenario_id long, node_id long, bin long, served double")
    of = {0: ["x"], 1: ["x", "y"], 2: ["y"], 3: [], 4: ["x"], 5: []}
    cap = {"x": 7.0, "y": 3.0}
    members = spark.createDataFrame([(c, n) for n, cs in of.items() for c in cs], "constraint_id string, node_id long")
    caps = spark.createDataFrame([(0, c, b, v) for c, v in cap.items() for b in range(5)], "scenario_id long, constraint_id string, bin long, capacity double")
    want = {(x.node_id, x.bin): round(x.served, 9) for x in routing.enforce(nodes, members, caps, "served").collect()}
    limits = F.expr("case " + " ".join(f"when node_id = {n} then array({', '.join(f'''named_struct('constraint_id', '{c}', 'capacity', {cap[c]}D)''' for c in cs)})" for n, cs in of.items() if cs) + " end")
    got = {(x.node_id, x.bin): round(x.served, 9) for x in routing.hold(nodes.withColumn("limits", limits)).collect()}
    assert got == want and len(got) == 30


def test_telemetry_that_has_no_classes(spark):
    totals = spark.createDataFrame([("n", 0, 1.0), ("m", 0, float("nan"))], "node_id string, bin long, value double")
    classes = spark.createDataFrame([("m", "a", 0, 5.0), ("m", "b", 1, None)], "node_id string, class_id string, bin long, value double")
    got = lambda *a, **k: {(x.node_id, x.code, x.detail) for x in checks.telemetry_class_errors(totals, *a, **k).collect()}
    assert got(classes, ["a", "DEFAULT", "b", "c"]) == {("n", "class_series_missing", None), ("m", "class_series_partial", "c")}
    assert got(classes.limit(0), []) == {("n", "class_series_missing", None), ("m", "class_series_missing", None), (None, "class_manifest_missing", None), (None, "class_data_missing", None)}
    assert got(classes.limit(0), [], supported=False) == set()


def test_an_echo_of_nothing_is_nothing(spark):
    df = spark.createDataFrame([(0, b, v) for b, v in enumerate([None, 4.0, float("nan"), float("inf"), 2.0, 0.0])], "scenario_id long, bin long, x double")
    got = [r.e for r in df.select("bin", series.echo("x", [0, 0.5, 0.25]).alias("e")).orderBy("bin").collect()]
    assert got == [None, None, 2.0, 1.0, None, 1.0]


def test_a_grid_that_the_events_give(spark, tmp_path):
    from brookline.sources.events import binned_whole, span_of

    rows = [("1999-12-31 23:10:00", 1, "view"), ("2000-01-01 02:00:00", 1, "click"), ("2000-01-01 01:59:59", 2, "view"), (None, 2, "view")]
    spark.createDataFrame(rows, "t string, user_id long, event_type string").select(F.col("t").cast("timestamp_ntz").alias("ts"), "user_id", "event_type").write.parquet(f"{tmp_path}/events.parquet")
    assert span_of(spark, str(tmp_path)) == ("1999-12-31 23:00:00", 4)
    got = binned_whole(spark, str(tmp_path)).orderBy("bin").collect()
    assert [(r.arrivals, r.served) for r in got] == [(1, 0), (0, 0), (1, 0), (0, 1)] and str(got[3].bin_start) == "2000-01-01 02:00:00"
    assert binned_whole(spark, str(tmp_path), by=["user_id"]).count() == 8


def test_captured_files_are_written_by_several_tasks(spark, tmp_path):
    """Few bytes, many files: by size they were one task's, however many nodes there were."""
    from brookline.sources import series_files
    from pyspark.sql import functions as F

    n = spark.range(40).select(F.lit(0).cast("long").alias("scenario_id"), F.col("id").alias("node_id"), F.lit(0).cast("long").alias("bin"), F.lit("a").alias("class_id"), F.lit(1.0).alias("value"), F.lit(1.0).alias("total"))
    made = series_files.capture_classes(n.repartition("node_id"), ["a"], str(tmp_path / "c"))
    assert made.count() == 40 and {r.coverage for r in made.collect()} == {"full"}
    files = [f.name for f in (tmp_path / "c" / "series").rglob("part-*.csv")]
    assert len(files) == 40 and len({f.split("-")[1] for f in files}) > 1
